"""Asserted, observed, normative and hypothetical data as separate tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G


def latest_assertions(moves: DataFrame) -> DataFrame:
    """The last position of every subject by (ts, seq)."""
    last = F.max_by(F.struct("ts", "seq", "x", "y"), F.struct("ts", "seq")).alias("p")
    return moves.groupBy("subject").agg(last).select("subject", "p.ts", "p.seq", "p.x", "p.y")


def record(observations: DataFrame, new: DataFrame) -> DataFrame:
    """Evidence is only ever appended; positions are another table and do not change."""
    ok = F.col("confidence").isNull() | F.col("confidence").between(0.0, 1.0)
    fine = ok & (F.col("accuracy_m").isNull() | (F.col("accuracy_m") >= 0))
    checked = new.withColumn("confidence", F.when(fine, F.col("confidence")).otherwise(F.raise_error(F.lit("confidence or accuracy out of range"))))
    return observations.unionByName(checked, allowMissingColumns=True)


def accept(positions: DataFrame, observations: DataFrame) -> DataFrame:
    """The explicit second step: the latest observation of a subject becomes its position."""
    best = observations.groupBy("subject").agg(F.max_by(F.struct("x", "y", "crs"), F.struct("observed_at", "seq")).alias("o")).select("subject", "o.x", "o.y", "o.crs")
    return best.unionByName(positions.select("subject", "x", "y", "crs").join(best, "subject", "left_anti"))


def unaccepted(observations: DataFrame, positions: DataFrame) -> DataFrame:
    """Observations that are not their subject's asserted position."""
    return observations.join(positions.select("subject", "x", "y"), ["subject", "x", "y"], "left_anti")


def split_declared(moves: DataFrame, declared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Moves of declared subjects, and rejects of all others."""
    known = declared.select("subject").distinct()
    return moves.join(known, "subject", "left_semi"), moves.join(known, "subject", "left_anti").withColumn("code", F.lit("unknown_subject"))


def violations(constraints: DataFrame, positions: DataFrame, states: DataFrame, regions: DataFrame) -> DataFrame:
    """constraints(name, rank, subject, region, predicate, while_state): a row for each one that is broken, in declaration order.

    A constraint whose guard state does not hold says nothing. A missing position or region breaks it. Small rule
    and region tables are left to Spark's own choice of join.
    """
    p = positions.select("subject", "x", "y", F.lit(True).alias("has_position"))
    r = regions.select(F.col("name").alias("region"), "edges", F.lit(True).alias("has_region"))
    j = constraints.join(states, "subject", "left").filter("while_state is null or state <=> while_state")
    j = j.join(p, "subject", "left").join(r, "region", "left")
    x, y, e = F.col("x"), F.col("y"), F.col("edges")
    holds = (
        F.when(F.col("predicate") == "inside", G.within(x, y, e))
        .when(F.col("predicate") == "coveredBy", G.covered_by(x, y, e))
        .otherwise(F.raise_error(F.concat(F.lit("unknown predicate "), F.col("predicate"))).cast("boolean"))
    )
    message = (
        F.when(F.col("has_position").isNull(), F.concat(F.lit("no position of "), "subject"))
        .when(F.col("has_region").isNull(), F.concat(F.lit("no region "), "region"))
        .when(~holds, F.concat_ws(" ", F.lit("not"), "predicate", "region"))
    )
    return j.withColumn("message", message).filter("message is not null").select("name", "rank", "subject", "region", "message").orderBy("rank", "subject")


def answers(questions: DataFrame, positions: DataFrame, states: DataFrame, regions: DataFrame, values: DataFrame) -> DataFrame:
    """questions(seq, kind, subject, region, member) with kind inside, coveredBy, position, state or value: an answer text for each."""
    q = questions.join(positions.select("subject", "x", "y"), "subject", "left").join(states.select("subject", "state"), "subject", "left")
    q = q.join(regions.select(F.col("name").alias("region"), "edges"), "region", "left")
    q = q.join(values.select(F.col("instance").alias("subject"), "member", F.col("text").alias("value_text")), ["subject", "member"], "left")
    x, y, e = F.col("x"), F.col("y"), F.col("edges")
    kind = F.col("kind")
    text = (
        F.when(kind == "inside", G.within(x, y, e).cast("string"))
        .when(kind == "coveredBy", G.covered_by(x, y, e).cast("string"))
        .when(kind == "position", F.concat(F.lit("("), x.cast("string"), F.lit(", "), y.cast("string"), F.lit(")")))
        .when(kind == "state", F.col("state"))
        .when(kind == "value", F.col("value_text"))
    )
    return q.select("seq", "kind", "subject", "region", "member", text.alias("answer"))


def ground_rules(processes: DataFrame, instances: DataFrame) -> DataFrame:
    """processes(name, rank, entity, ...) and instances(instance, entity, rank): a rule ``name@instance`` for every instance of a
    process's entity, ranked by process and then by instance."""
    i = instances.select(F.col("instance").alias("subject"), "entity", F.col("rank").alias("instance_rank"))
    j = processes.join(i, "entity")
    return j.withColumn("rule", F.concat_ws("@", "name", F.col("subject").cast("string"))).withColumnRenamed("rank", "process_rank")


def topology_matrix(points: DataFrame, regions: DataFrame) -> DataFrame:
    """Every point against every region of the other table: inside, covered, disjoint, boundary. Meant for small corpora."""
    r = regions.select(F.col("name").alias("region"), F.col("crs").alias("region_crs"), "edges")
    x, y, e = F.col("x"), F.col("y"), F.col("edges")
    pairs = points.crossJoin(r)
    if "crs" in points.columns:
        pairs = pairs.filter(F.col("crs") == F.col("region_crs"))
    pairs = pairs.withColumn("on_boundary", G.on_boundary(x, y, e)).withColumn("covered", G.covered_by(x, y, e))
    return pairs.withColumn("inside", F.col("covered") & ~F.col("on_boundary")).withColumn("disjoint", ~F.col("covered")).drop("edges", "region_crs")


def closed_window(x: Column, y: Column, min_x: float, min_y: float, max_x: float, max_y: float) -> Column:
    """Overlap of a point with a closed window; both ranges reach the Parquet scan."""
    return x.between(min_x, max_x) & y.between(min_y, max_y)


def upsert(current: DataFrame, changes: DataFrame, key: str, version: str) -> DataFrame:
    """Keyed update: for each key the row with the highest version, whichever side has it."""
    both = current.unionByName(changes)
    columns = [c for c in current.columns if c != key]
    return both.groupBy(key).agg(F.max_by(F.struct(*columns), F.col(version)).alias("row")).select(key, "row.*")
