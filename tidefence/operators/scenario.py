"""What-if runs: assumed moves on a branch of the world, then some time, then questions. Tables are immutable, so a branch is free."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .machine import Program, run
from .regions import Region


def what_if(positions: DataFrame, assumed: DataFrame, regions: list[Region], program: Program, *, initial_state: str | None = None, states: DataFrame | None = None, run_us: int = 0) -> DataFrame:
    """The trace of assumed(subject, x, y, ts[, seq]) from the asserted positions, with a last tick run_us after each subject's last assumption.

    The tick is a move that repeats the last assumed point, so it exposes timers and crosses nothing.
    """
    a = assumed if "seq" in assumed.columns else assumed.withColumn("seq", F.lit(0).cast("long"))
    last = a.groupBy("subject").agg(F.max_by(F.struct("x", "y", "ts", "seq"), F.struct("ts", "seq")).alias("l"))
    tick = last.select("subject", "l.x", "l.y", (F.col("l.ts") + F.make_dt_interval(secs=F.lit(run_us / 1e6).cast("decimal(18,6)"))).alias("ts"), (F.col("l.seq") + 1).alias("seq"))
    moves = a.select("subject", "x", "y", "ts", "seq").unionByName(tick)
    start = positions.select("subject", "x", "y").join(a.select("subject").distinct(), "subject", "left_semi")
    return run(moves, regions, program, initial_state=initial_state, states=states, positions=start)
