"""Guarded rules and duration monitors: a fold over each subject's moves.

A rule names only its own subject's events, guard and target, so subjects are folded independently. Moves are
partitioned by subject, sorted by arrival (seq) and streamed through ``mapInPandas``: memory is one batch and one subject's
state however long its history, and no per-subject call is paid. Memberships come in as bit masks made in the JVM.

At time t: due timers fire first in the order (deadline, spec rank); then crossings are found; then, crossing by crossing, monitors
of the opposite kind are cancelled and matching ones start (a guarded one only in its source state); then immediate
rules apply in declaration order, each seeing what earlier ones wrote. A guard is checked again at the deadline for
the transition; the sustained event is emitted either way. A re-triggered monitor replaces its pending one.

A move that goes back in time, comes from an unknown subject, or changes the reference system is rejected in that order of
checks and changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ModelError
from .events import mask_of, whole_mask, words_of
from .regions import Region

KINDS = ("enters", "leaves")
TRACE = (
    "subject {key}, entry string, step long, phase int, k1 long, k2 int, kind string, region string, name string, started_us long, "
    "effective_us long, emitted_us long, from_state string, to_state string, seq long"
)


@dataclass(frozen=True)
class Rule:
    """On kind at region: from_state -> to_state, at once or after duration_us. subject None: holds for every subject."""

    name: str
    kind: str
    region: str
    from_state: str
    to_state: str
    duration_us: int | None = None
    subject: str | None = None

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise ModelError(f"rule {self.name!r}: unknown event kind {self.kind!r}")
        if self.duration_us is not None and self.duration_us <= 0:
            raise ModelError(f"rule {self.name!r}: a duration must be positive")


@dataclass(frozen=True)
class Spec:
    """A sustained event that no rule is bound to."""

    name: str
    kind: str
    region: str
    duration_us: int
    subject: str | None = None

    def __post_init__(self) -> None:
        if self.duration_us <= 0:
            raise ModelError(f"event {self.name!r}: a duration must be positive")


@dataclass(frozen=True)
class Semantics:
    """The engine's switches; the defaults are the contract, other values are for comparison."""

    # The switches and defaults that the published comparison of semantics names.
    timers_first: bool = True
    cancel_opposite: bool = True
    guard_start: bool = True
    guard_deadline: bool = True
    deadline_included: bool = True
    duration_scale: float = 1.0
    emit_at_deadline: bool = False
    move_on_start: bool = False
    start_after_rules: bool = False


@dataclass(frozen=True)
class Program:
    regions: tuple[str, ...]
    rules: tuple[Rule, ...] = ()
    specs: tuple[Spec, ...] = ()
    semantics: Semantics = Semantics()

    def __post_init__(self) -> None:
        names = [m[0] for m in self.monitors()]
        if len(set(names)) != len(names):
            raise ModelError("names of sustained events must be unique")

    def monitors(self) -> list[tuple[str, str, str, int, Rule | None, str | None]]:
        """(name, kind, region, duration, rule, subject) in rank order: specs first, then rules with a duration."""
        free = [(s.name, s.kind, s.region, s.duration_us, None, s.subject) for s in self.specs]
        return free + [(r.name, r.kind, r.region, r.duration_us, r, r.subject) for r in self.rules if r.duration_us is not None]


@dataclass
class Fold:
    """The state of one subject. Pending: monitor rank -> start in microseconds."""

    program: Program
    subject: object = None
    state: str | None = None
    mask: int | None = None
    known: int = -1
    crs: str | None = None
    clock: int | None = None
    pending: dict[int, int] = field(default_factory=dict)
    step: int = -1

    def __post_init__(self) -> None:
        mine = lambda s: s is None or s == str(self.subject)
        self.monitors = [(rank, *m[:5]) for rank, m in enumerate(self.program.monitors()) if mine(m[5])]
        self.by_rank = {m[0]: m for m in self.monitors}
        self.immediate = [r for r in self.program.rules if r.duration_us is None and mine(r.subject)]

    def _span(self, rank: int) -> int:
        return round(self.by_rank[rank][4] * self.program.semantics.duration_scale)

    def advance(self, now: int) -> list[tuple]:
        """Fires due timers and sets the clock."""
        s, out = self.program.semantics, []
        due = []
        for rank, begun in self.pending.items():
            deadline = begun + self._span(rank)
            if deadline < now or deadline == now and s.deadline_included:
                due.append((deadline, rank))
        for deadline, rank in sorted(due):
            _, name, kind, region, _, rule = self.by_rank[rank]
            out.append(("event", 0, deadline, rank, f"sustained {kind}", region, name, self.pending.pop(rank), deadline, deadline if s.emit_at_deadline else now, None, None))
            if rule is not None and (not s.guard_deadline or self.state == rule.from_state):
                out.append(("state", 0, deadline, rank, "transition", region, name, None, deadline, now, self.state, rule.to_state))
                self.state = rule.to_state
        self.clock = now
        return out

    def move(self, now: int, mask: int, known: int = -1, crs: str | None = None) -> list[tuple]:
        """known: bits of regions in this move's reference system."""
        self.step += 1
        if self.clock is not None and now < self.clock:
            self.step -= 1
            return [("reject", 9, 0, 0, "backwards_time", None, None, None, now, now, None, None)]
        if self.crs is not None and crs is not None and crs != self.crs:
            self.step -= 1
            return [("reject", 9, 0, 0, "crs_mismatch", None, None, None, now, now, None, None)]
        s, out = self.program.semantics, []
        if s.timers_first:
            out += self.advance(now)
        before, self.mask, self.crs = self.mask, mask, crs or self.crs
        changed = 0 if before is None else (before ^ mask) & known
        if changed:
            events = []
            for i, region in enumerate(self.program.regions):
                if changed >> i & 1:
                    kind = "enters" if mask >> i & 1 else "leaves"
                    events.append((kind, region))
                    out.append(("event", 1, 0, i, kind, region, None, None, now, now, None, None))
            if s.start_after_rules:
                self._apply(events, now, out)
            for kind, region in events:
                self._reconcile(kind, region, now, out)
            if not s.start_after_rules:
                self._apply(events, now, out)
        if not s.timers_first:
            out += self.advance(now)
        self.clock = now
        return out

    def _reconcile(self, kind: str, region: str, now: int, out: list[tuple]) -> None:
        s = self.program.semantics
        if s.cancel_opposite:
            for rank in [r for r in self.pending if self.by_rank[r][3] == region and self.by_rank[r][2] != kind]:
                del self.pending[rank]
        for rank, name, k, r, _, rule in self.monitors:
            if (k, r) != (kind, region) or rule is not None and s.guard_start and self.state != rule.from_state:
                continue
            self.pending[rank] = now
            if s.move_on_start and rule is not None:
                out.append(("state", 1, 0, rank, "transition", region, name, None, now, now, self.state, rule.to_state))
                self.state = rule.to_state

    def _apply(self, events: list[tuple[str, str]], now: int, out: list[tuple]) -> None:
        for k, rule in enumerate(self.immediate):
            if self.state == rule.from_state and (rule.kind, rule.region) in events:
                out.append(("state", 2, 0, k, "transition", rule.region, rule.name, None, now, now, self.state, rule.to_state))
                self.state = rule.to_state

    def final(self) -> list[tuple]:
        """The state and every pending monitor."""
        rows = [("final", 9, 0, 0, "state", None, None, None, None, self.clock, None, self.state)]
        return rows + [("final", 9, 0, r, "pending", self.by_rank[r][3], self.by_rank[r][1], b, b + self._span(r), None, None, None) for r, b in sorted(self.pending.items())]


COLUMNS = [c.split()[0] for c in TRACE.split(", ")]


def to_frame(rows: list[tuple]) -> pd.DataFrame:
    """rows: (subject, step, seq, *fold row)."""
    fixed = [(s, r[0], step, *r[1:], seq) for s, step, seq, r in rows]
    out = pd.DataFrame(fixed, columns=COLUMNS)
    whole = ["step", "phase", "k1", "k2", "started_us", "effective_us", "emitted_us", "seq"]
    return out.astype({c: "Int64" for c in whole})


def run(moves: DataFrame, regions: list[Region], program: Program, *, initial_state: str | None = None, states: DataFrame | None = None, positions: DataFrame | None = None, horizon_us: int | None = None, declared: DataFrame | None = None, on_error: str = "reject", order: str = "arrival") -> DataFrame:
    """The trace of all subjects as rows of TRACE, with rows ``final`` for states and pending monitors.

    moves(subject, seq, ts, x, y[, crs]); states(subject, state) overrides initial_state; positions(subject, x, y[, crs]) are
    asserted before the first move; declared(subject) is the set of known subjects; horizon_us is a last tick for all.
    on_error ``reject`` writes rejected moves as rows and goes on, ``fail`` raises. Moves arrive in the order of seq, so one that goes back in time
    is late; with order ``time`` they are sorted by (ts, seq) first and none is.
    """
    if order not in ("arrival", "time"):
        raise ValueError("order is arrival or time")
    if on_error not in ("reject", "fail"):
        raise ValueError("on_error is reject or fail")
    names = tuple(r.name for r in regions)
    if names != program.regions:
        raise ModelError("the program was made for other regions")
    key = moves.schema["subject"].dataType.simpleString()
    us = F.unix_micros(F.col("ts").cast("timestamp")) if dict(moves.dtypes)["ts"] != "bigint" else F.col("ts")
    crs = F.col("crs") if "crs" in moves.columns else F.lit(None).cast("string")

    def known(df: DataFrame):
        if "crs" not in df.columns:
            return words_of([F.lit(True)] * len(regions))
        return words_of([F.col("crs") == r.crs for r in regions])

    rows = moves.select("subject", F.lit(1).alias("what"), us.alias("us"), F.col("seq").cast("long").alias("seq"), mask_of(moves, regions).alias("mask"), known(moves).alias("known"), crs.alias("crs"), F.lit(None).cast("string").alias("state"))
    first = F.lit(-(2**62)).cast("long")
    none = F.lit(None).cast("long")
    no_mask = F.lit(None).cast(rows.schema["mask"].dataType)
    if positions is not None:
        c = F.col("crs") if "crs" in positions.columns else F.lit(None).cast("string")
        rows = rows.unionByName(positions.select("subject", F.lit(0).alias("what"), first.alias("us"), none.alias("seq"), mask_of(positions, regions).alias("mask"), known(positions).alias("known"), c.alias("crs"), F.lit(None).cast("string").alias("state")))
    if states is not None:
        rows = rows.unionByName(states.select("subject", F.lit(-1).alias("what"), first.alias("us"), none.alias("seq"), no_mask.alias("mask"), no_mask.alias("known"), F.lit(None).cast("string").alias("crs"), "state"))
    if declared is not None:
        marked = declared.select("subject").distinct().select("subject", F.lit(-2).alias("what"), first.alias("us"), none.alias("seq"), no_mask.alias("mask"), no_mask.alias("known"), F.lit(None).cast("string").alias("crs"), F.lit(None).cast("string").alias("state"))
        rows = rows.unionByName(marked)
    check = declared is not None

    def fold(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current: Fold | None = None
        allowed = False

        def closing(f: Fold) -> list[tuple]:
            last = [(f.subject, f.step + 1, None, r) for r in f.advance(horizon_us)] if horizon_us is not None and f.clock is not None and horizon_us >= f.clock else []
            return last + [(f.subject, f.step, None, r) for r in f.final()]

        for batch in it:
            out: list[tuple] = []
            for subject, what, now, seq, mask, bits, system, state in zip(*(batch[c].tolist() for c in ("subject", "what", "us", "seq", "mask", "known", "crs", "state")), strict=True):
                if current is None or subject != current.subject:
                    if current is not None and (allowed or not check):
                        out += closing(current)
                    current, allowed = Fold(program, subject, initial_state), False
                system = system if isinstance(system, str) else None
                if what == -2:
                    allowed = True
                elif what == -1:
                    current.state = state
                elif what == 0:
                    current.mask, current.crs = whole_mask(mask), system
                elif check and not allowed:
                    out.append((subject, None, int(seq), ("reject", 9, 0, 0, "unknown_subject", None, None, None, now, now, None, None)))
                else:
                    got = current.move(int(now), whole_mask(mask), whole_mask(bits), system)
                    out += [(subject, current.step, int(seq), r) for r in got]
            if on_error == "fail":
                for r in out:
                    if r[3][0] == "reject":
                        raise ModelError(f"{r[3][4]}: subject {r[0]!r}, seq {r[2]}")
            if out:
                yield to_frame(out)
        if current is not None and (allowed or not check):
            yield to_frame(closing(current))

    sort = ["subject", "what", "seq"] if order == "arrival" else ["subject", "what", "us", "seq"]
    return rows.repartition("subject").sortWithinPartitions(*sort).mapInPandas(fold, TRACE.format(key=key))
