"""A table of points that is filled by bulk loads, as a data source for reading and writing.

``load`` writes the rows of a table, each task files of its own with the point as well-known binary in the column ``geometry``. A load counts from the moment at which the driver puts the next
manifest into the folder; files that no manifest names are never read, so a load that fails, or a task that runs twice, leaves no rows. A load has a name: the same name again replaces that load's
files and keeps its place, so a repeated load changes nothing. ``current`` gives the newest row of each key: that of the load which came later.

The folder is any that pyarrow opens and all executors share. Loads of one table are run one after another; a load that finds another one's manifest in its place fails and leaves no rows.

Cases: a null or missing coordinate gives a null geometry; NaN and infinite ones are an error; rows with a null in the key are stored, but are no one's newest row; of a key's repeats in one load the greatest row
counts; an empty load replaces its earlier files by none; other columns than in earlier loads are an error, and so are columns named geometry or load_number; a folder without loads has no schema and cannot be read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import BinaryType, DoubleType, LongType, StructType

NAME = "tidefence_points"
#: Little-endian well-known binary of a point.
POINT = np.dtype([("order", "u1"), ("kind", "<u4"), ("x", "<f8"), ("y", "<f8")])


def _folder(path: str) -> tuple:
    from pyarrow import fs

    found, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return found, inner.rstrip("/")


def _listed(path: str, sub: str) -> list[str]:
    from pyarrow import fs

    found, inner = _folder(path)
    return [f.path for f in found.get_file_info(fs.FileSelector(f"{inner}/{sub}", allow_not_found=True)) if f.is_file]


def manifest(path: str) -> dict:
    """The newest manifest: its number, the schema, and the loads in order as (name, files)."""
    numbers = sorted(int(f.rsplit("/", 1)[1].removesuffix(".json")) for f in _listed(path, "manifests") if f.endswith(".json"))
    if not numbers:
        return {"number": 0, "schema": None, "loads": []}
    found, inner = _folder(path)
    with found.open_input_stream(f"{inner}/manifests/{numbers[-1]:012d}.json") as f:
        return json.loads(f.read())


def _put(path: str, made: dict) -> None:
    from pyarrow import fs

    found, inner = _folder(path)
    found.create_dir(f"{inner}/manifests", recursive=True)
    final = f"{inner}/manifests/{made['number']:012d}.json"
    if found.get_file_info(final).type != fs.FileType.NotFound:
        raise RuntimeError(f"another load has put manifest {made['number']}")
    part = f"{final}.{uuid.uuid4().hex}"
    with found.open_output_stream(part) as f:
        f.write(json.dumps(made).encode())
    found.move(part, final)


def _remove(path: str, files: list[str]) -> None:
    found, inner = _folder(path)
    for name in files:
        try:
            found.delete_file(f"{inner}/data/{name}")
        except FileNotFoundError:
            pass


def binaries(x: pa.Array, y: pa.Array) -> pa.Array:
    """Points as well-known binary; null where an ordinate is null."""
    valid = np.asarray(x.is_valid()) & np.asarray(y.is_valid())
    rows = np.zeros(len(x), POINT)
    rows["order"], rows["kind"] = 1, 1
    for c, v in (("x", x), ("y", y)):
        rows[c] = v.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)
        if not np.isfinite(rows[c]).all():
            raise ValueError(f"a point needs a finite {c}")
    size = POINT.itemsize
    offsets = pa.py_buffer(np.arange(len(x) + 1, dtype=np.int32) * np.int32(size))
    bits = pa.py_buffer(np.packbits(valid, bitorder="little").tobytes())
    return pa.Array.from_buffers(pa.binary(), len(x), [bits, offsets, pa.py_buffer(rows.tobytes())])


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, schema: StructType) -> None:
        self.path, self.load, self.x, self.y = options["path"], options["load"], options.get("x", "x"), options.get("y", "y")
        self.schema = schema.jsonValue()
        taken = {"geometry", "load_number"} & {f.name for f in schema.fields}
        if taken:
            raise ValueError(f"columns of the table itself: {', '.join(sorted(taken))}")
        self.before = manifest(self.path)
        known = self.before["schema"]
        plain = lambda s: [(f["name"], f["type"]) for f in s["fields"]]
        if known and plain(known) != plain(self.schema):
            raise ValueError("the columns differ from those of earlier loads")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        import pyarrow.parquet as pq

        found, inner = _folder(self.path)
        name, out = f"{uuid.uuid4().hex}.parquet", None
        try:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                column = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: B023, E731
                whole = pa.Table.from_batches([batch]).append_column("geometry", binaries(column(self.x), column(self.y)))
                if out is None:
                    found.create_dir(f"{inner}/data", recursive=True)
                    out = pq.ParquetWriter(f"{inner}/data/{name}", whole.schema, filesystem=found)
                out.write_table(whole)
        except BaseException:
            if out is not None:
                out.close()
                _remove(self.path, [name])
            raise
        if out is None:
            return Written([])
        out.close()
        return Written([name])

    def commit(self, messages: list) -> None:
        files = [f for m in messages if m is not None for f in m.files]
        loads = [list(e) for e in self.before["loads"]]
        same = [e for e in loads if e[0] == self.load]
        if same:
            same[0][1] = files
        else:
            loads.append([self.load, files])
        try:
            _put(self.path, {"number": self.before["number"] + 1, "schema": self.schema, "loads": loads})
        except BaseException:
            _remove(self.path, files)
            raise

    def abort(self, messages: list) -> None:
        _remove(self.path, [f for m in messages if m is not None for f in m.files])


@dataclass
class _File(InputPartition):
    name: str
    load: int


class _Reader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path, self.loads = path, manifest(path)["loads"]

    def partitions(self) -> list[_File]:
        return [_File(name, k) for k, (_, files) in enumerate(self.loads) for name in files] or [_File("", 0)]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        if not partition.name:
            return
        found, inner = _folder(self.path)
        with found.open_input_file(f"{inner}/data/{partition.name}") as f:
            for batch in pq.ParquetFile(f).iter_batches():
                numbers = pa.array(np.full(batch.num_rows, partition.load, np.int64))
                yield pa.RecordBatch.from_arrays([*batch.columns, numbers], names=[*batch.schema.names, "load_number"])


class PointTable(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> StructType:
        known = manifest(self.options["path"])["schema"]
        if known is None:
            raise ValueError(f"nothing was loaded into {self.options['path']}")
        return StructType.fromJson(known).add("geometry", BinaryType()).add("load_number", LongType())

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        if overwrite:
            raise ValueError("loads are appended; a load of the same name replaces the earlier one")
        return _Writer(dict(self.options), schema)


def load(df: DataFrame, path: str, name: str, x: str = "x", y: str = "y") -> None:
    """Loads df under a name, with the point of the columns x and y."""
    df.sparkSession.dataSource.register(PointTable)
    df.write.format(NAME).mode("append").options(load=name, x=x, y=y).save(path)


def loaded(spark: SparkSession, path: str) -> DataFrame:
    """All rows of all loads, with geometry and load_number (0 for the first load), a task for each file."""
    spark.dataSource.register(PointTable)
    return spark.read.format(NAME).load(path)


def current(spark: SparkSession, path: str, *key: str) -> DataFrame:
    """The newest row of each key: one shuffle by key, with partial maxima before it."""
    rows = loaded(spark, path)
    rest = [c for c in rows.columns if c not in (*key, "load_number")]
    newest = rows.dropna(subset=list(key)).groupBy(*key).agg(F.max(F.struct("load_number", *rest)).alias("newest"))
    return newest.select(*key, *[F.col("newest")[c].alias(c) for c in (*rest, "load_number")])


def vacuum(path: str) -> int:
    """Deletes files that the newest manifest does not name, and tells how many; not while loads or readers run."""
    named = {name for _, files in manifest(path)["loads"] for name in files}
    gone = [n for n in (f.rsplit("/", 1)[1] for f in _listed(path, "data")) if n not in named]
    _remove(path, gone)
    return len(gone)


@F.pandas_udf(StructType().add("x", DoubleType()).add("y", DoubleType()))
def ordinates(geometry: pd.Series) -> pd.DataFrame:
    """The ordinates that a point's well-known binary holds; null for null."""
    blank = np.zeros(1, POINT)
    blank["x"] = blank["y"] = np.nan
    rows = np.frombuffer(b"".join(blank.tobytes() if g is None else g for g in geometry), POINT)
    return pd.DataFrame({c: pd.Series(rows[c]).where(geometry.notna().to_numpy(), None) for c in "xy"})
