import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidefence.errors import ModelError
from tidefence.operators import events as E
from tidefence.operators import machine as M
from tidefence.operators import policies
from tidefence.operators.regions import Region, region_table

U = "urn:u"
Z = Region.closed("Z", ((0, 0), (10, 0), (10, 10), (0, 10)), U, 0)
Y = Region.closed("Y", ((5, 0), (20, 0), (20, 10), (5, 10)), U, 1)
T0 = datetime(2026, 1, 1)
MIN = 60_000_000


def frame(spark, rows):
    """rows: (subject, minute, x)."""
    data = [(s, i, T0 + timedelta(minutes=m), float(x), 5.0) for i, (s, m, x) in enumerate(rows)]
    return spark.createDataFrame(data, "subject string, seq long, ts timestamp_ntz, x double, y double")


def reference(rows, regions, program, state):
    """A direct machine of one clock per subject: its events as (subject, kind, region, effective, emitted), and states."""
    world, out = {}, []
    ranks = program.monitors()
    for s, m, x in rows:
        w = world.setdefault(s, {"x": None, "state": state, "pending": {}})
        due = sorted((b + ranks[r][3], r) for r, b in w["pending"].items() if b + ranks[r][3] <= m * MIN)
        for at, r in due:
            del w["pending"][r]
            out.append((s, f"sustained {ranks[r][1]}", ranks[r][2], at, m * MIN))
            if ranks[r][4] is not None and w["state"] == ranks[r][4].from_state:
                w["state"] = ranks[r][4].to_state
        happened = []
        if w["x"] is not None:
            for region in regions:
                lo, hi = region.box[0], region.box[2]
                was, now = lo <= w["x"] <= hi, lo <= x <= hi
                if was != now:
                    happened.append(("enters" if now else "leaves", region.name))
                    out.append((s, *happened[-1], m * MIN, m * MIN))
        w["x"] = x
        for kind, region in happened:
            w["pending"] = {r: b for r, b in w["pending"].items() if ranks[r][2] != region or ranks[r][1] == kind}
            for r, (_, k, g, _, rule, _) in enumerate(ranks):
                if (k, g) == (kind, region) and (rule is None or w["state"] == rule.from_state):
                    w["pending"][r] = m * MIN
        for rule in program.rules:
            if rule.duration_us is None and w["state"] == rule.from_state and (rule.kind, rule.region) in happened:
                w["state"] = rule.to_state
    return out, {s: w["state"] for s, w in world.items()}, {s: len(w["pending"]) for s, w in world.items()}


def random_rows(seed, n=400):
    r = random.Random(seed)
    clock, rows = {}, []
    for _ in range(n):
        s = f"s{r.randint(0, 6)}"
        clock[s] = clock.get(s, 0) + r.choice([0, 1, 2, 5, 10])
        rows.append((s, clock[s], r.choice([-5, 0, 3, 5, 7, 10, 15, 20, 25])))
    return rows


PROGRAM = M.Program(
    ("Z", "Y"),
    (M.Rule("late", "leaves", "Z", "Safe", "AtRisk", 5 * MIN), M.Rule("now", "enters", "Y", "Safe", "Busy"), M.Rule("chain", "enters", "Y", "Busy", "AtRisk"), M.Rule("heal", "enters", "Z", "AtRisk", "Safe")),
    (M.Spec("stay", "enters", "Z", 10 * MIN), M.Spec("gone", "leaves", "Y", 3 * MIN)),
)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_machine_against_direct_fold(spark, seed):
    rows = random_rows(seed)
    want, states, pending = reference(rows, [Z, Y], PROGRAM, "Safe")
    t = M.run(frame(spark, rows), [Z, Y], PROGRAM, initial_state="Safe").collect()
    base = int((T0 - datetime(1970, 1, 1)).total_seconds()) * 1_000_000
    got = [(r.subject, r.kind, r.region, r.effective_us - base, r.emitted_us - base) for r in t if r.entry == "event"]
    assert sorted(got) == sorted(want)
    assert {r.subject: r.to_state for r in t if r.entry == "final" and r.kind == "state"} == states
    left = {s: 0 for s in states}
    for r in t:
        left[r.subject] += r.kind == "pending"
    assert left == pending


@pytest.mark.parametrize("seed", [4, 5])
def test_set_based_sustained_against_fold(spark, seed):
    rows = random_rows(seed)
    durations = {"3m": 3 * MIN, "10m": 10 * MIN}
    specs = tuple(M.Spec(f"{z.name} {k} {n}", k, z.name, us) for z in (Z, Y) for k in M.KINDS for n, us in durations.items())
    want, _, _ = reference(rows, [Z, Y], M.Program(("Z", "Y"), (), specs), None)
    s = E.sustained(frame(spark, rows), [Z, Y], durations).collect()
    us = lambda t: int((t - T0).total_seconds()) * 1_000_000
    got = [(r.subject, f"sustained {r.kind}", r.region, us(r.effective_at), us(r.emitted_at)) for r in s]
    assert sorted(got) == sorted(x for x in want if x[1].startswith("sustained"))
    c = E.crossings(frame(spark, rows), [Z, Y]).collect()
    assert sorted((r.subject, r.kind, r.region, us(r.ts)) for r in c) == sorted(x[:4] for x in want if not x[1].startswith("sustained"))


def test_time_buckets_change_nothing(spark):
    m = frame(spark, random_rows(11))
    columns = ["subject", "seq", "step", "region", "kind"]
    want = sorted(E.crossings(m, [Z, Y]).select(columns).collect())
    for bucket in ("minute", "hour", "year"):
        assert sorted(E.crossings(m, [Z, Y], bucket).select(columns).collect()) == want


def test_first_sample_and_segments_emit_nothing(spark):
    c = E.crossings(frame(spark, [("a", 0, 5), ("b", 0, -5), ("b", 1, 25)]), [Z, Y])
    assert c.count() == 0


def test_other_reference_systems_are_skipped(spark):
    other = Region.closed("O", Z.shell[:-1], "urn:other", 1)
    m = frame(spark, [("a", 0, -5), ("a", 1, 5)]).withColumn("crs", F.lit(U))
    assert [r.region for r in E.crossings(m, [Z, other]).collect()] == ["Z"]
    assert E.membership(m, [Z, other]).filter("region = 'O'").count() == 0


def test_global_clock_exposes_at_any_subjects_tick(spark):
    rows = [("a", 0, 5), ("a", 1, 15), ("b", 7, 5), ("a", 30, 15)]
    one = E.sustained(frame(spark, rows), [Z], {"5m": 5 * MIN}, kinds=("leaves",)).first()
    both = E.sustained(frame(spark, rows), [Z], {"5m": 5 * MIN}, clock="global", kinds=("leaves",)).first()
    assert one.emitted_at == T0 + timedelta(minutes=30) and both.emitted_at == T0 + timedelta(minutes=7)


def test_deadline_at_opposite_crossing_still_fires(spark):
    rows = [("a", 0, 5), ("a", 1, 15), ("a", 6, 5)]
    assert E.sustained(frame(spark, rows), [Z], {"5m": 5 * MIN}, kinds=("leaves",)).count() == 1
    assert E.sustained(frame(spark, [("a", 0, 5), ("a", 1, 15), ("a", 5, 5), ("a", 9, 5)]), [Z], {"5m": 5 * MIN}, kinds=("leaves",)).count() == 0


def test_membership_joins_agree(spark):
    m = frame(spark, random_rows(9, 100))
    table = region_table(spark, [Z, Y])
    wide = E.membership(m, [Z, Y]).filter("covered").select("seq", "region").collect()
    broadcast = E.membership_join(m, table).select("seq", "region").collect()
    grid = E.membership_join(m, table, unrolled_edges=0).select("seq", "region").collect()
    assert sorted(wide) == sorted(broadcast) == sorted(grid)
    plan = E.membership_join(m, table, unrolled_edges=0)._jdf.queryExecution().optimizedPlan().toString()
    assert "cx" in plan


def test_crossings_from_positive_rows(spark):
    m = frame(spark, random_rows(10, 100))
    positive = E.membership(m, [Z, Y]).filter("covered").select("subject", "seq", "region")
    names = region_table(spark, [Z, Y]).select(F.col("name").alias("region"), "rank")
    a = E.crossings_of_memberships(m, positive, names).select("subject", "seq", "region", "kind").collect()
    assert sorted(a) == sorted(E.crossings(m, [Z, Y]).select("subject", "seq", "region", "kind").collect())


def test_rejects_leave_everything_unchanged(spark):
    data = [("a", 0, T0, 5.0, 5.0, U), ("a", 1, T0 + timedelta(minutes=5), 15.0, 5.0, U), ("a", 2, T0 + timedelta(minutes=1), 5.0, 5.0, U), ("a", 3, T0 + timedelta(minutes=6), 5.0, 5.0, "urn:x"), ("ghost", 4, T0, 5.0, 5.0, U)]
    m = spark.createDataFrame(data, "subject string, seq long, ts timestamp_ntz, x double, y double, crs string")
    p = M.Program(("Z",), (M.Rule("r", "leaves", "Z", "Safe", "Out"),))
    known = spark.createDataFrame([("a",)], "subject string")
    t = M.run(m, [Z], p, initial_state="Safe", declared=known).collect()
    assert sorted((r.seq, r.kind) for r in t if r.entry == "reject") == [(2, "backwards_time"), (3, "crs_mismatch"), (4, "unknown_subject")]
    assert [(r.subject, r.to_state) for r in t if r.entry == "final"] == [("a", "Out")]
    with pytest.raises(Exception, match="backwards_time"):
        M.run(m.filter("seq < 3"), [Z], p, initial_state="Safe", on_error="fail").collect()


def test_late_moves_are_rejects_unless_sorted_by_time(spark):
    m = frame(spark, [("a", 0, 5), ("a", 9, 15), ("a", 4, 5)])
    p = M.Program(("Z",), (M.Rule("r", "leaves", "Z", "Safe", "Out"),))
    late = M.run(m, [Z], p, initial_state="Safe").filter("entry = 'reject'").collect()
    assert [(r.seq, r.kind) for r in late] == [(2, "backwards_time")]
    assert M.run(m, [Z], p, initial_state="Safe", order="time").filter("entry = 'reject'").count() == 0
    with pytest.raises(ValueError):
        M.run(m, [Z], p, order="id")


def many_regions(n):
    return [Region.closed(f"R{i:03d}", ((i, 0), (i + 2, 0), (i + 2, 10), (i, 10)), U, i) for i in range(n)]


def test_masks_of_several_words(spark):
    """More regions than a word holds give the same crossings, sustained events and fold as fewer at a time."""
    regions = many_regions(66)
    r = random.Random(12)
    m = frame(spark, [(f"s{i % 3}", i, r.randint(0, 70)) for i in range(40)])
    got = sorted((x.subject, x.seq, x.region, x.kind) for x in E.crossings(m, regions).collect())
    want = sorted((x.subject, x.seq, x.region, x.kind) for part in (regions[:33], regions[33:]) for x in E.crossings(m, part).collect())
    assert got == want and any(x[2] > "R060" for x in got)
    p = M.Program(tuple(z.name for z in regions), (M.Rule("x", "enters", "R063", "A", "B"), M.Rule("y", "leaves", "R063", "B", "C")))
    t = M.run(m, regions, p, initial_state="A").collect()
    assert sorted((x.subject, x.seq, x.region, x.kind) for x in t if x.entry == "event") == got


def test_mask_words():
    assert E.whole_mask(5) == 5 and E.whole_mask([1, 2, 4]) == 1 + (2 << 60) + (4 << 120)


def test_wide_and_narrow_regions_share_a_grid(spark):
    """A region of any size stands in four cells at most."""
    regions = [Region.closed("wide", ((-1e6, -1e6), (1e6, -1e6), (1e6, 1e6), (-1e6, 1e6)), U, 0), *many_regions(40)]
    m = frame(spark, random_rows(13, 100))
    table = region_table(spark, regions)
    got = E.membership_join(m, table, unrolled_edges=0).select("seq", "region").collect()
    assert sorted(got) == sorted(E.membership(m, regions).filter("covered").select("seq", "region").collect())


def test_equal_deadlines_follow_rank(spark):
    p = M.Program(("Z",), (), (M.Spec("zeta", "leaves", "Z", MIN), M.Spec("alpha", "leaves", "Z", MIN)))
    t = M.run(frame(spark, [("a", 0, 5), ("a", 1, 15), ("a", 9, 15)]), [Z], p).filter("kind = 'sustained leaves'").orderBy("k1", "k2").collect()
    assert [r.name for r in t] == ["zeta", "alpha"]


def test_horizon_fires_last_timers(spark):
    p = M.Program(("Z",), (M.Rule("r", "leaves", "Z", "Safe", "Out", 10 * MIN),))
    m = frame(spark, [("a", 0, 5), ("a", 1, 15)])
    base = int((T0 - datetime(1970, 1, 1)).total_seconds()) * 1_000_000
    t = M.run(m, [Z], p, initial_state="Safe", horizon_us=base + 60 * MIN).filter("entry = 'final'").collect()
    assert [(r.kind, r.to_state) for r in t] == [("state", "Out")]


def test_programs_are_checked():
    with pytest.raises(ModelError):
        M.Rule("r", "inside", "Z", "a", "b")
    with pytest.raises(ModelError):
        M.Rule("r", "enters", "Z", "a", "b", 0)
    with pytest.raises(ModelError):
        M.Program(("Z",), (M.Rule("x", "enters", "Z", "a", "b", 1),), (M.Spec("x", "enters", "Z", 1),))


def test_grid_of_switches(spark):
    g = policies.grid(spark)
    assert g.count() == 37_440
    got = {r.mutant: (r.distinguished, r.first_witness) for r in policies.kill_matrix(g).collect()}
    assert got["keep pending after opposite"] == (1680, 3145) and got["move before timers"] == (3896, 393) and got["half duration"] == (10224, 325)
    assert len(got) == 10


#: What the two-subject table gives, worked out from the rules: (first asset move, second asset move) -> (asset's events).
ASSET_EVENTS = {
    # starts inside
    (1, 1, 1): [],
    (1, 1, 0): [("leaves", 2, 2), ("sustained leaves", 4, 4)],
    (1, 0, 1): [("leaves", 1, 1), ("enters", 2, 2)],
    (1, 0, 0): [("leaves", 1, 1), ("sustained leaves", 3, 4)],
    # starts outside
    (0, 0, 0): [],
    (0, 0, 1): [("enters", 2, 2)],
    (0, 1, 0): [("enters", 1, 1), ("leaves", 2, 2), ("sustained leaves", 4, 4)],
    (0, 1, 1): [("enters", 1, 1)],
}


@pytest.mark.parametrize("start, first, second", ASSET_EVENTS)
@pytest.mark.parametrize("immediate", [0, 1])
@pytest.mark.parametrize("dual", [0, 1])
def test_two_subjects_with_one_clock_in_all_32_cases(spark, start, first, second, immediate, dual):
    """An asset moves at 1 and 2 and has a rule of two units after leaving, perhaps one at once; a second subject, inside at first, leaves
    at 1 under a rule of its own, perhaps; time ends at 4."""
    rules = [M.Rule("slow", "leaves", "Z", "Safe", "AtRisk", 2, "asset")]
    rules += [M.Rule("now", "leaves", "Z", "Safe", "Maintenance", None, "asset")] * immediate
    rules += [M.Rule("other", "leaves", "Z", "Safe", "AtRisk", 2, "second")] * dual
    p = M.Program(("Z",), tuple(rules))
    plan = {"asset": [(1, first), (2, second)], "second": [(1, 0)] * dual}
    got = {}
    for name, moves in plan.items():
        f = M.Fold(p, name, "Safe", clock=0)
        f.mask = start if name == "asset" else 1
        out = [r for t, inside in moves for r in f.move(t, inside)] + f.advance(4)
        got[name] = f.state, [(r[4], r[8], r[9]) for r in out if r[0] == "event"], len(f.pending)
    want = ASSET_EVENTS[start, first, second]
    left = any(kind == "leaves" for kind, _, _ in want)
    if immediate and left:
        # a guard is asked when a monitor starts and at its deadline: it started in Safe, so the event stays and the transition goes
        assert got["asset"] == ("Maintenance", want, 0)
    else:
        assert got["asset"] == ("AtRisk" if any(k.startswith("sustained") for k, _, _ in want) else "Safe", want, 0)
    assert got["second"] == (("AtRisk", [("leaves", 1, 1), ("sustained leaves", 3, 4)], 0) if dual else ("Safe", [], 0))
