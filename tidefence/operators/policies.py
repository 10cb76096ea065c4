"""The grid of short traces on which single switches of the engine's semantics are told apart."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .machine import Fold, Program, Rule, Semantics

MINUTE = 60_000_000
# The grid and the switches that the mutants flip.
LENGTHS, GAPS = (2, 3, 4, 5), (1, 5, 10, 11)
MUTANTS = {
    "keep pending after opposite": Semantics(cancel_opposite=False),
    "move before timers": Semantics(timers_first=False),
    "no guard at start": Semantics(guard_start=False),
    "no guard at deadline": Semantics(guard_deadline=False),
    "deadline excluded": Semantics(deadline_included=False),
    "half duration": Semantics(duration_scale=0.5),
    "double duration": Semantics(duration_scale=2.0),
    "emit at deadline": Semantics(emit_at_deadline=True),
    "transition on start": Semantics(move_on_start=True),
    "start after rules": Semantics(start_after_rules=True),
}


def grid(spark: SparkSession) -> DataFrame:
    """trace_id (1..37440), minutes, inside, initial_state, immediate_to: every combination, numbered in declaration order."""
    parts, base = [], 0
    for n in LENGTHS:
        combos = 2**n * len(GAPS) ** (n - 1) * 4
        i = F.col("id")
        digit = lambda k, n=n: F.floor(i / (4 * len(GAPS) ** (n - 2 - k)) % len(GAPS)).cast("int")
        gaps = F.array(*[F.get(F.array(*map(F.lit, GAPS)), digit(k)) for k in range(n - 1)])
        minutes = F.aggregate(gaps, F.array(F.lit(0)), lambda past, gap: F.concat(past, F.array(F.element_at(past, -1) + gap)))
        inside = F.array(*[F.floor(i / (4 * len(GAPS) ** (n - 1) * 2 ** (n - 1 - k)) % 2) == 1 for k in range(n)])
        parts.append(
            spark.range(combos).select(
                (i + base + 1).alias("trace_id"),
                minutes.alias("minutes"),
                inside.alias("inside"),
                F.when(F.floor(i / 2) % 2 == 0, "Safe").otherwise("Maintenance").alias("initial_state"),
                F.when(i % 2 == 1, "Maintenance").alias("immediate_to"),
            )
        )
        base += combos
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def outcome(minutes: list[int], inside: list[bool], initial: str, immediate: str | None, semantics: Semantics) -> str:
    """Final state, crossings and sustained events (with the duration that was used) of one trace, as text."""
    rules = [Rule("late", "leaves", "Z", "Safe", "AtRisk", 10 * MINUTE)]
    if immediate:
        rules.insert(0, Rule("now", "leaves", "Z", "Safe", immediate))
    fold = Fold(Program(("Z",), tuple(rules), (), semantics), "s", initial)
    rows = [r for m, i in zip(minutes, inside, strict=True) for r in fold.move(m * MINUTE, int(i))]
    events = [f"{r[4]} {r[7]} {r[8]} {r[9]}" for r in rows if r[0] == "event"]
    return "; ".join([str(fold.state), *sorted(events), str(semantics.duration_scale) if any("sustained" in e for e in events) else ""])


def kill_matrix(traces: DataFrame) -> DataFrame:
    """mutant, distinguished traces, first witness."""

    def compare(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in it:
            rows = []
            for t, minutes, inside, initial, immediate in batch.itertuples(index=False):
                args = ([int(m) for m in minutes], [bool(i) for i in inside], initial, immediate)
                want = outcome(*args, Semantics())
                rows += [(name, t) for name, s in MUTANTS.items() if outcome(*args, s) != want]
            yield pd.DataFrame(rows, columns=["mutant", "trace_id"])

    n = traces.sparkSession.sparkContext.defaultParallelism
    told = traces.repartition(n).mapInPandas(compare, "mutant string, trace_id long")
    return told.groupBy("mutant").agg(F.count("*").alias("distinguished"), F.min("trace_id").alias("first_witness"))
