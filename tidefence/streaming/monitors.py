"""The state machine on a stream: the batch fold, one per subject, kept as state.

Late moves are not dropped: a move behind its subject's clock comes out as a ``reject`` row. With a watermark, a subject
idle for ``idle`` fires the timers that the watermark has passed. The clock is the subject's own; a clock shared
by all subjects cannot be rebuilt key by key.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.geometry import ring_covers
from ..operators.events import mask_of, whole_mask
from ..operators.machine import TRACE, Fold, Program, to_frame
from ..operators.regions import Region


def monitor(moves: DataFrame, regions: list[Region], program: Program, *, initial_state: str | None = None, watermark: str | None = None) -> DataFrame:
    """The trace rows of a stream of moves(subject, seq, ts, x, y)."""
    key = moves.schema["subject"].dataType.simpleString()
    rows = moves.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp"))).withColumn("mask", mask_of(moves, regions))
    if watermark:
        rows = rows.withColumn("event_time", F.col("ts").cast("timestamp")).withWatermark("event_time", watermark)

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fold = pickle.loads(state.get[0]) if state.exists else Fold(program, k[0], initial_state)
        out: list[tuple] = []
        if state.hasTimedOut:
            now = state.getCurrentWatermarkMs() * 1000
            if fold.clock is None or now >= fold.clock:
                out = [(k[0], fold.step, None, r) for r in fold.advance(now)]
        else:
            batch = pd.concat(list(batches), ignore_index=True).sort_values("seq", kind="stable")
            for us, seq, mask in zip(batch["us"].tolist(), batch["seq"].tolist(), batch["mask"].tolist(), strict=True):
                got = fold.move(us, whole_mask(mask))
                out += [(k[0], fold.step, seq, r) for r in got]
        state.update((pickle.dumps(fold),))
        if watermark and fold.pending:
            due = min(b + fold._span(r) for r, b in fold.pending.items()) // 1000 + 1
            state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        if out:
            yield to_frame(out)

    timeout = GroupStateTimeout.EventTimeTimeout if watermark else GroupStateTimeout.NoTimeout
    return rows.groupBy("subject").applyInPandasWithState(step, TRACE.format(key=key), "fold binary", "append", timeout)


def windowed_crossings(crossed: DataFrame, window: str, watermark: str) -> DataFrame:
    """Crossings per region, kind and tumbling window of a stream of crossings(region, kind, ts)."""
    c = crossed.withColumn("event_time", F.col("ts").cast("timestamp")).withWatermark("event_time", watermark)
    return c.groupBy(F.window("event_time", window), "region", "kind").agg(F.count("*").alias("n")).select("window.start", "window.end", "region", "kind", "n")


def zone_stays(moves: DataFrame, regions: list[Region], gap: str, watermark: str) -> DataFrame:
    """Stays of subjects in regions, of a table or a stream of moves(subject, ts, x, y): covered moves less than ``gap`` apart are one stay, which ends a gap after its last move.

    On a stream a stay comes out once, when the watermark has passed its end; the state is one row for each open stay, and moves behind the watermark are dropped
    (``late_moves`` counts them). On a table all stays come out.
    """
    m = moves.withColumn("event_time", F.col("ts").cast("timestamp")).withWatermark("event_time", watermark)
    inside = F.array_compact(F.array(*[F.when(ring_covers(F.col("x"), F.col("y"), r.shell), F.lit(r.name)) for r in regions]))
    inside = m.select("subject", "event_time", F.explode(inside).alias("region"))
    stays = inside.groupBy("subject", "region", F.session_window("event_time", gap).alias("stay")).agg(F.count("*").alias("n"))
    return stays.select("subject", "region", F.col("stay.start").alias("start"), F.col("stay.end").alias("end"), "n")


def late_moves(progress: list) -> int:
    """Rows behind the watermark, from the progress of a query."""
    return sum(op.numRowsDroppedByWatermark for p in progress for op in p.stateOperators)
