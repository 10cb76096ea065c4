"""Running a stream over what is there and reading the result as a table."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the cluster names it; a folder of our own only where it is unset and everything runs on one machine."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (shared or "file://" + tempfile.mkdtemp(prefix="tidefence-")).rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again, which cuts its lineage."""
    folder = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def replay(df: DataFrame, name: str) -> DataFrame:
    """A table as a stream of its rows, through files in the shared folder."""
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return spark.readStream.schema(df.schema).parquet(folder)


def drain(stream: DataFrame, name: str, timeout_s: int = 3600) -> DataFrame:
    """Writes all that the stream's sources hold now to Parquet in the shared folder, exactly once, and reads it."""
    spark = stream.sparkSession
    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    q = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    try:
        if not q.awaitTermination(timeout_s):
            raise TimeoutError(f"stream {name!r} did not end in {timeout_s} s")
        if q.exception() is not None:
            raise q.exception()
    finally:
        q.stop()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
