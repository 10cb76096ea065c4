"""Generated inputs: alternating moves, observations, bounded move sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def alternating_moves(spark: SparkSession, n: int, subjects: int = 1, inside: tuple[float, float] = (5.0, 5.0), outside: tuple[float, float] = (12.0, 5.0)) -> DataFrame:
    """n moves per subject, in and out by turns, a second apart."""
    k = F.floor(F.col("id") / subjects)
    even = k % 2 == 0
    return spark.range(n * subjects).select(
        F.concat(F.lit("s"), (F.col("id") % subjects).cast("string")).alias("subject"),
        k.alias("seq"),
        F.timestamp_seconds(k).alias("ts"),
        F.when(even, inside[0]).otherwise(outside[0]).alias("x"),
        F.when(even, inside[1]).otherwise(outside[1]).alias("y"),
    )


def observations(spark: SparkSession, n: int, crs: str) -> DataFrame:
    """n sensor observations of one subject."""
    i = F.col("id")
    return spark.range(n).select(
        i.alias("seq"),
        F.lit("asset").alias("subject"),
        F.lit("position").alias("property"),
        F.concat(F.lit("sensor"), (i % 10).cast("string")).alias("source"),
        (i % 180 / 2).alias("x"),
        (i % 90 / 2).alias("y"),
        F.lit(crs).alias("crs"),
        F.timestamp_seconds(i).alias("observed_at"),
        F.date_format(F.timestamp_seconds(i), "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("observed_at_text"),
        F.lit(0.5).alias("confidence"),
        F.lit(None).cast("double").alias("accuracy_m"),
    )


def bounded_sequences(spark: SparkSession, positions: list[tuple[str, float, float]], depth: int) -> DataFrame:
    """Every sequence of 1..depth positions as moves of its own subject, a second apart after the first position as the start."""
    base, out = len(positions), None
    xs, ys = (F.array(*[F.lit(float(p[k])) for p in positions]) for k in (1, 2))
    for length in range(1, depth + 1):
        digits = [F.floor(F.col("id") / base ** (length - 1 - k) % base).cast("int") for k in range(length)]
        steps = F.array(F.lit(0), *digits)
        part = spark.range(base**length).select(F.concat(F.lit(f"{length}-"), F.col("id").cast("string")).alias("subject"), F.posexplode(steps).alias("seq", "p"))
        part = part.select("subject", F.col("seq").cast("long"), F.timestamp_seconds(F.col("seq")).alias("ts"), F.get(xs, F.col("p")).alias("x"), F.get(ys, F.col("p")).alias("y"))
        out = part if out is None else out.unionByName(part)
    return out
