"""Comparisons of outcomes, of artefacts that should say the same, and of configurations."""

from __future__ import annotations

from dataclasses import fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .machine import Semantics


def crossing_name(kind: str | Column, subject: str | Column, region: str | Column) -> Column:
    return F.concat_ws("__", kind, subject, region)


def changed_switches(s: Semantics) -> list[str]:
    """Which switches differ from the contract."""
    return [f.name for f in fields(Semantics) if getattr(s, f.name) != getattr(Semantics(), f.name)]


def outcomes(trace: DataFrame) -> DataFrame:
    """Per subject: final state, crossings and sustained events as sorted text lists."""
    line = F.concat_ws(" ", "kind", "region", "name", F.col("started_us").cast("string"), F.col("effective_us").cast("string"), F.col("emitted_us").cast("string"))
    event = F.col("entry") == "event"
    return trace.groupBy("subject").agg(
        F.max(F.when((F.col("entry") == "final") & (F.col("kind") == "state"), F.col("to_state"))).alias("final_state"),
        F.sort_array(F.collect_list(F.when(event & (F.col("phase") == 1), line))).alias("instantaneous"),
        F.sort_array(F.collect_list(F.when(event & (F.col("phase") == 0), line))).alias("sustained"),
    )


def outcome_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Subjects whose outcomes differ, and in which of the three parts."""
    parts = ("final_state", "instantaneous", "sustained")
    j = a.alias("a").join(b.alias("b"), "subject", "full_outer")
    different = F.array_compact(F.array(*[F.when(~F.col(f"a.{p}").eqNullSafe(F.col(f"b.{p}")), F.lit(p)) for p in parts]))
    return j.select("subject", different.alias("differs")).filter(F.size("differs") > 0)


def binding_differences(left: DataFrame, right: DataFrame, key: str, parts: list[str]) -> DataFrame:
    """Rows of two artefacts that should be bound alike by key: missing on a side, or with differing fields."""
    j = left.select(key, *parts).withColumn("l", F.lit(True)).alias("l").join(right.select(key, *parts).withColumn("r", F.lit(True)).alias("r"), key, "full_outer")
    fields_ = F.array_compact(F.array(*[F.when(~F.col(f"l.{p}").eqNullSafe(F.col(f"r.{p}")), F.lit(p)) for p in parts]))
    missing = F.when(F.col("r.r").isNull(), F.array(F.lit("missing right"))).when(F.col("l.l").isNull(), F.array(F.lit("missing left")))
    return j.select(key, F.coalesce(missing, fields_).alias("differences")).filter(F.size("differences") > 0)


def outside_domain(bindings: DataFrame, domain: DataFrame, state: str) -> DataFrame:
    """Bindings that use a state that the domain does not have."""
    return bindings.join(domain.select(F.col("value").alias(state)).distinct(), state, "left_anti")


def snapshot(*tables: DataFrame) -> str:
    """One hash of tables as sets of rows, whatever their order; sums of row hashes, so nothing is gathered."""
    sums = []
    for t in tables:
        h = F.xxhash64(F.to_json(F.struct(*sorted(t.columns)))).cast("decimal(38,0)")
        row = t.agg(F.count("*").alias("n"), F.sum(h).alias("h")).first()
        sums.append(f"{row.n}:{row.h}")
    return "|".join(sums)
