"""Summaries of events, memberships and run measurements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..streaming.sinks import stored
from .events import bit_of, crossings_of_steps, sustained_of_crossings, with_steps
from .regions import Region


def nearest_rank(column: str, p: float) -> Column:
    """The smallest value that at least a share p of all values do not exceed; null without values."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {column})")


def counts_by(df: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias(name))


def zone_breakdown(moves: DataFrame, regions: list[Region], durations: dict[str, int]) -> DataFrame:
    """Per region: pairs (moves after a subject's first), inside, outside, distinct subjects, events, moves without one, enters, leaves, sustained.

    All come from one table of moves with masks: a row per subject counts memberships, and crossings and sustained events are taken from it.
    """
    steps, n = with_steps(moves, regions), len(regions)
    after = steps.filter("step > 0")
    # a row for each subject first, so subjects are counted without a distinct
    per = after.groupBy("subject").agg(F.count("*").alias("pairs"), *[F.count_if(bit_of(F.col("mask"), i, n)).alias(f"in{i}") for i in range(n)])
    rows = [F.struct(F.lit(r.name).alias("region"), F.col(f"in{i}").alias("inside")) for i, r in enumerate(regions)]
    a = per.select("pairs", F.inline(F.array(*rows))).groupBy("region").agg(F.sum("pairs").alias("pairs"), F.sum("inside").alias("inside"), F.count("*").alias("subjects"))
    crossed = crossings_of_steps(steps, regions)
    b = crossed.groupBy("region").agg(F.count_if(F.col("kind") == "enters").alias("enters"), F.count_if(F.col("kind") == "leaves").alias("leaves"))
    c = sustained_of_crossings(crossed, moves, durations).groupBy("region").agg(F.count("*").alias("sustained"))
    out = a.join(b, "region", "left").join(c, "region", "left").na.fill(0, ["enters", "leaves", "sustained"]).withColumn("outside", F.col("pairs") - F.col("inside"))
    out = out.withColumn("events", F.col("enters") + F.col("leaves")).withColumn("quiet", F.col("pairs") - F.col("events"))
    return out.select("region", "pairs", "inside", "outside", "subjects", "enters", "leaves", "sustained", "events", "quiet")


def lag_summary(held: DataFrame, coarse_us: int = 60_000_000) -> DataFrame:
    """Seconds from deadline to emission: how many events, how many on time, median, nearest-rank p95, maximum; zeros without events.

    Percentiles come from a histogram of lags: ranks by a running sum over coarse steps (few rows) and another inside each step, so no task holds all lags.
    """
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    lags = held.groupBy((us("emitted_at") - us("effective_at")).alias("us")).agg(F.count("*").alias("n")).withColumn("step", F.floor(F.col("us") / coarse_us))
    lags = stored(lags, "lags")  # read four times below; what they derive from is worked out once
    steps = lags.groupBy("step").agg(F.sum("n").alias("n"))
    below = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.select("step", F.coalesce(F.sum("n").over(below), F.lit(0)).alias("before"))
    total = lags.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    inside = F.sum("n").over(Window.partitionBy("step").orderBy("us"))
    ranked = lags.withColumn("inside", inside).join(steps, "step").withColumn("upto", F.col("before") + F.col("inside")).join(F.broadcast(total))  # one row
    at = lambda rank: F.min(F.when(F.col("upto") >= rank, F.col("us"))) / 1e6
    middle = (F.col("total") + 1) / 2
    out = ranked.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("events"),
        F.coalesce(F.sum(F.when(F.col("us") == 0, F.col("n"))), F.lit(0)).alias("on_time"),
        ((at(F.floor(middle)) + at(F.ceil(middle))) / 2).alias("median_s"),
        at(F.ceil(F.col("total") * 0.95)).alias("p95_s"),
        (F.max("us") / 1e6).alias("max_s"),
    )
    return out.na.fill(0.0)


def latency_stats(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """Count, mean, interpolated p50, p95 and p99, and maximum per key."""
    v = F.col(value)
    return df.groupBy(*keys).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), *[F.percentile(v, p / 100).alias(f"p{p}") for p in (50, 95, 99)], F.max(v).alias("max"))


def level_summary(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """Runs, mean, extremes, population deviation and coefficient of variation per level."""
    v = F.col(value)
    out = df.groupBy(*keys).agg(F.count(v).alias("runs"), F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"), F.stddev_pop(v).alias("deviation"))
    return out.withColumn("variation", F.try_divide("deviation", "mean"))


def counter_delta(samples: DataFrame, at: str, counter: str, *keys: str) -> DataFrame:
    """Last minus first reading of a counter per key, never below zero."""
    last, first = F.max_by(counter, at), F.min_by(counter, at)
    return samples.groupBy(*keys).agg(F.greatest(F.lit(0), last - first).alias("delta"), F.count("*").alias("samples"))


def counter_difference(before: DataFrame, after: DataFrame, *keys: str) -> DataFrame:
    """After minus before of every numeric column both have, by key; a key of one side only counts as zero on the other. Other columns are left out."""
    whole = {"int", "bigint", "double", "float", "smallint", "tinyint"}
    kinds = dict(after.dtypes)
    shared = [c for c, k in before.dtypes if c not in keys and k in whole and kinds.get(c) in whole]
    j = before.withColumn("in_b", F.lit(True)).alias("b").join(after.withColumn("in_a", F.lit(True)).alias("a"), list(keys), "full")
    zero = F.lit(0)
    return j.select(*keys, *[(F.coalesce(F.col(f"a.{c}"), F.when(F.col("in_a").isNull(), zero)) - F.coalesce(F.col(f"b.{c}"), F.when(F.col("in_b").isNull(), zero))).alias(c) for c in shared])


def resource_summary(samples: DataFrame, *keys: str) -> DataFrame:
    """samples(elapsed_s, cpu_percent, memory_bytes, read_bytes): load, memory, and bytes read, with the mean sampling gap."""
    gap = F.col("elapsed_s") - F.lag("elapsed_s").over(Window.partitionBy(*keys).orderBy("elapsed_s"))
    s = samples.withColumn("gap", gap)
    return s.groupBy(*keys).agg(
        F.count("*").alias("samples"),
        F.avg("gap").alias("mean_gap_s"),
        F.avg("cpu_percent").alias("cpu_mean"),
        nearest_rank("cpu_percent", 0.95).alias("cpu_p95"),
        F.max("cpu_percent").alias("cpu_max"),
        F.max("memory_bytes").alias("memory_max"),
        F.greatest(F.lit(0), F.max_by("read_bytes", "elapsed_s") - F.min_by("read_bytes", "elapsed_s")).alias("read_delta"),
    )


def slo_levels(runs: DataFrame, p99_limit_ms: float, skip_limit: float) -> DataFrame:
    """runs(target, p99_ms, done, skipped, failed): a row per target with its skip rate and whether all its runs pass."""
    tried = F.col("done") + F.col("skipped")
    ok = (F.col("p99_ms") <= p99_limit_ms) & (F.coalesce(F.try_divide("skipped", tried), F.lit(0.0)) <= skip_limit) & (F.col("failed") == 0)
    r = runs.withColumn("ok", ok)
    return r.groupBy("target").agg(F.count("*").alias("runs"), F.bool_and("ok").alias("passed"), F.avg("p99_ms").alias("p99_mean"), F.max("p99_ms").alias("p99_max"), F.try_divide(F.sum("skipped"), F.sum(tried)).alias("skip_rate"))


def slo_prefix(levels: DataFrame) -> DataFrame:
    """levels(target, passed) with standing: prefix (all up to here pass), first failure, later pass, later failure.

    A row per target, so the window over all of them is small.
    """
    w = Window.orderBy("target").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    failures = F.sum(F.when(F.col("passed"), 0).otherwise(1)).over(w)
    standing = F.when(failures == 0, "prefix").when(~F.col("passed") & (failures == 1), "first failure").when(F.col("passed"), "later pass").otherwise("later failure")
    return levels.withColumn("standing", standing)


def same_protocol(runs: DataFrame, *fields: str) -> DataFrame:
    """One row: how many different protocols the runs have, and whether they have one."""
    return runs.agg(F.countDistinct(F.struct(*fields)).alias("protocols")).withColumn("homogeneous", F.col("protocols") == 1)


def roll_up(probes: DataFrame, *keys: str) -> DataFrame:
    """probes(status): per key error before fail before manual; pass only if all pass."""
    has = lambda s: F.bool_or(F.col("status") == s)
    status = F.when(has("error"), "error").when(has("fail"), "fail").when(F.bool_and(F.col("status") == "pass"), "pass").otherwise("manual")
    return probes.groupBy(*keys).agg(F.count("*").alias("probes"), status.alias("status"))


def jump_audit(moves: DataFrame, limit: float, *, group: str | None = None) -> DataFrame:
    """Consecutive moves of a subject whose x differs by more than limit (a seam crossing, for longitudes): jumps and subjects."""
    w = Window.partitionBy("subject").orderBy("ts", "seq")
    j = moves.withColumn("jump", F.abs(F.col("x") - F.lag("x").over(w))).filter(F.col("jump") > limit)
    out = j.groupBy(group) if group else j.groupBy()
    return out.agg(F.count("*").alias("jumps"), F.countDistinct("subject").alias("subjects"), F.max("jump").alias("largest"))


def seam_memberships(moves: DataFrame, crossed: DataFrame, limit: float) -> DataFrame:
    """Per region: changes of membership, and those that happen at a jump over limit only."""
    w = Window.partitionBy("subject").orderBy("ts", "seq")
    j = moves.select("subject", "seq", (F.abs(F.col("x") - F.lag("x").over(w)) > limit).alias("seam"))
    c = crossed.join(j, ["subject", "seq"])
    return c.groupBy("region").agg(F.count("*").alias("changes"), F.count_if("seam").alias("at_seam"))


def symmetric_difference(a: DataFrame, b: DataFrame, keep: int = 20) -> tuple[DataFrame, DataFrame]:
    """Rows that only one side has, with the side; and a sorted report of the first keep of them."""
    only = lambda x, y, side: x.exceptAll(y).withColumn("side", F.lit(side))
    all_ = only(a, b, "left").unionByName(only(b, a, "right"))
    return all_, all_.orderBy(*all_.columns).limit(keep)


def compare_rows(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer comparison by keys, nulls equal: same, different, left only or right only."""
    values = [c for c in a.columns if c not in keys]
    left, right = a.withColumn("in_left", F.lit(True)), b.select(*keys, *[F.col(c).alias(f"{c}_right") for c in values], F.lit(True).alias("in_right"))
    j = left.join(right, keys, "full_outer")
    same = F.lit(True)
    for c in values:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_right"))
    status = F.when(F.col("in_right").isNull(), "left only").when(F.col("in_left").isNull(), "right only").when(same, "same").otherwise("different")
    return j.select(*keys, status.alias("status"))
