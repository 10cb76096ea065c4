"""Load-generator logs and container samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Unit factors.
UNITS = {"": 1, "B": 1, "kB": 10**3, "KB": 10**3, "MB": 10**6, "GB": 10**9, "TB": 10**12, "KiB": 2**10, "MiB": 2**20, "GiB": 2**30, "TiB": 2**40}


def log_lines(lines: DataFrame) -> DataFrame:
    """lines(value): client, transaction, latency_us or a failure word, script, epoch, microsecond, [schedule lag], [retries].

    With eight fields the seventh is the lag and the eighth the retries; with seven the seventh is the retries.
    """
    f = lines.select(F.split(F.trim("value"), r"\s+").alias("f")).filter(F.size("f") >= 6)
    at = lambda i: F.get("f", F.lit(i))
    whole = lambda c: F.when(c.rlike("^[0-9]+$"), c.cast("long"))
    eight = F.size("f") >= 8
    return f.select(
        at(0).cast("long").alias("client"),
        at(3).cast("int").alias("script"),
        (whole(at(2)) / 1000.0).alias("latency_ms"),
        F.when(whole(at(2)).isNull(), at(2)).alias("failure"),
        F.when(eight, whole(at(6)) / 1000.0).alias("lag_ms"),
        F.coalesce(F.when(eight, whole(at(7))).otherwise(whole(at(6))), F.lit(0)).alias("retries"),
    )


def log_summary(parsed: DataFrame, *keys: str) -> DataFrame:
    """Transactions, latencies, schedule lag, retries and failures per key."""
    p = lambda c, q: F.percentile(c, q)
    return parsed.groupBy(*keys).agg(
        F.count("latency_ms").alias("transactions"),
        F.avg("latency_ms").alias("mean_ms"),
        p("latency_ms", 0.5).alias("p50_ms"),
        p("latency_ms", 0.95).alias("p95_ms"),
        p("latency_ms", 0.99).alias("p99_ms"),
        F.max("latency_ms").alias("max_ms"),
        p("lag_ms", 0.99).alias("lag_p99_ms"),
        F.sum("retries").alias("retries"),
        F.count("failure").alias("failures"),
    )


def failures(parsed: DataFrame) -> DataFrame:
    return parsed.filter("failure is not null").groupBy("failure").agg(F.count("*").alias("n"))


def late(parsed: DataFrame, limit_ms: float) -> DataFrame:
    return parsed.agg(F.count_if(F.col("latency_ms") > limit_ms).alias("late"))


def byte_count(text: Column) -> Column:
    """1.5MiB, 2 GB and the like as whole bytes; null for anything else."""
    number, unit = F.regexp_extract(text, r"^\s*([0-9.]+)\s*([A-Za-z]*)\s*$", 1), F.regexp_extract(text, r"^\s*([0-9.]+)\s*([A-Za-z]*)\s*$", 2)
    factors = F.create_map(*[F.lit(v) for k, f in UNITS.items() for v in (k, float(f))])
    return F.when(number != "", F.bround(number.cast("double") * F.element_at(factors, unit)).cast("long"))


def container_samples(lines: DataFrame) -> DataFrame:
    """lines(elapsed_s, value): a JSON sample with CPUPerc, MemUsage, NetIO, BlockIO, PIDs."""
    s = lines.select("elapsed_s", F.from_json("value", "CPUPerc string, MemUsage string, NetIO string, BlockIO string, PIDs string").alias("s"))
    side = lambda c, i: byte_count(F.trim(F.get(F.split(F.col(f"s.{c}"), "/"), F.lit(i))))
    return s.select(
        "elapsed_s",
        F.regexp_replace("s.CPUPerc", "%", "").cast("double").alias("cpu_percent"),
        side("MemUsage", 0).alias("memory_bytes"),
        side("NetIO", 0).alias("net_read_bytes"),
        side("NetIO", 1).alias("net_write_bytes"),
        side("BlockIO", 0).alias("read_bytes"),
        side("BlockIO", 1).alias("write_bytes"),
        F.col("s.PIDs").cast("int").alias("pids"),
    )


def last_rate(texts: DataFrame) -> DataFrame:
    """The last ``tps = N`` of each text."""
    found = F.regexp_extract_all("value", F.lit(r"tps = ([0-9.]+)"), F.lit(1))
    return texts.select(F.try_element_at(found, F.lit(-1)).cast("double").alias("tps"))


def substantive_lines(lines: DataFrame) -> DataFrame:
    """How many lines of text files are neither blank nor comments."""
    t = F.trim("value")
    return lines.agg(F.count_if((t != "") & ~t.startswith("#") & ~t.startswith("//")).alias("lines"))
