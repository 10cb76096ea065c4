"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_SCRATCH: dict[str, str] = {}
#: Stored tables that were not discarded, in the order of writing.
WRITTEN: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; a folder of our own only where that is unset and everything runs on one machine."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_SCRATCH:
        _OWN_SCRATCH[app] = "file://" + tempfile.mkdtemp(prefix="tidefence-")
    return _OWN_SCRATCH[app]


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again: cuts the lineage and survives lost executors."""
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    WRITTEN.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Deletes stored tables that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
        WRITTEN.remove(path)


def small_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Batches between the JVM and Python hold at most about ``most`` bytes from now on in this session; a smaller limit that it has already stays.
    Results do not depend on it: a worker's memory does, as it holds a batch several times."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    has = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
    spark.conf.set(name, str(min(most, has)))


def fresh(df: DataFrame, base: str) -> str:
    """A column name that df does not have yet, ignoring case."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name += "_"
    return name


def remainder(key: Column, m: int) -> Column:
    """crc32(key as text) mod m; null keys give null."""
    return F.crc32(key.cast("string").cast("binary")) % m


def skew_join(rows: DataFrame, stats: DataFrame, key: str, count: str, heavy_share: int = 256) -> DataFrame:
    """Inner join of rows with stats (one row per key; count: how many rows have it).

    Keys that hold over 1/heavy_share of all rows are fewer than heavy_share by construction,
    so their stats are broadcast and the hot rows never move; all other keys meet in a shuffle.
    """
    total = stats.agg(F.sum(count)).first()[0] or 0
    heavy = stats.filter(F.col(count) * heavy_share > F.lit(total))
    light = stats.filter(F.col(count) * heavy_share <= F.lit(total))
    hot = rows.join(F.broadcast(heavy), key)
    rest = rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(light, key)
    return hot.unionByName(rest)


def literal_rows(spark: SparkSession, values: list[int], name: str, position: str) -> DataFrame:
    """A small list of integers as a DataFrame (position, value), without leaving SQL."""
    text = F.lit(",".join(map(str, values)))
    rows = spark.range(1).select(F.posexplode(F.split(text, ",")).alias(position, name))
    return rows.withColumn(name, F.col(name).cast("long"))


def text_blocks(text: str, size: int = 500_000) -> Iterator[str]:
    """The whole text in blocks of about size characters, cut only where a character is not a letter, digit or mark."""
    at = 0
    while len(text) - at > size:
        end = at + size
        while end < len(text) and not text[end].isspace():
            end += 1
        yield text[at:end]
        at = end
    yield text[at:]
