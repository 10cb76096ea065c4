"""Set-based event derivation: membership, crossings and sustained events.

Moves are (subject, seq, ts, x, y[, crs]). Order within a subject is (ts, seq). Membership of all regions is kept as one
bit mask per move, so there is one window over moves whatever the number of regions, and only changes are exploded. Later windows
by (subject, region) reuse the partitioning by subject.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from .regions import Region

#: Regions a mask word can hold, and edges up to which expressions are unrolled.
MASK_REGIONS, UNROLLED_EDGES = 60, 400


def _same_crs(moves: DataFrame, crs: str) -> Column:
    return F.col("crs") == crs if "crs" in moves.columns else F.lit(True)


def words_of(bits: list[Column]) -> Column:
    """A long with bit i set where bits[i] holds; beyond MASK_REGIONS bits an array of such words."""
    zero = F.lit(0).cast("long")
    word = lambda part: reduce(lambda a, b: a.bitwiseOR(b), [F.when(b, F.lit(1 << i).cast("long")).otherwise(zero) for i, b in enumerate(part)], zero)
    words = [word(bits[at : at + MASK_REGIONS]) for at in range(0, max(1, len(bits)), MASK_REGIONS)]
    return words[0] if len(words) == 1 else F.array(*words)


def bit_of(mask: Column, i: int, n: int) -> Column:
    """Whether bit i of a mask of n regions is set."""
    word = mask if n <= MASK_REGIONS else F.get(mask, F.lit(i // MASK_REGIONS))
    return word.bitwiseAND(F.lit(1 << i % MASK_REGIONS).cast("long")) != 0


def whole_mask(mask: object) -> int:
    """One integer of a mask as Python gets it."""
    return int(mask) if not hasattr(mask, "__len__") else sum(int(w) << MASK_REGIONS * k for k, w in enumerate(mask))


def mask_of(moves: DataFrame, regions: list[Region]) -> Column:
    """Bit i is set if regions[i] covers the point; regions in another reference system stay unset."""
    x, y = F.col("x"), F.col("y")
    unrolled = sum(len(r.shell) for r in regions) <= UNROLLED_EDGES

    def covers(r: Region) -> Column:
        return G.ring_covers(x, y, r.shell) if unrolled else G.covered_by(x, y, G.edges_literal(r.shell))

    return words_of([_same_crs(moves, r.crs) & covers(r) for r in regions])


def relations(moves: DataFrame, regions: list[Region]) -> Column:
    """An array with a struct for each region: region, rank, same (system), on_boundary, odd (passed by a ray)."""
    x, y = F.col("x"), F.col("y")
    rows = []
    for r in regions:
        box = x.between(r.box[0], r.box[2]) & y.between(r.box[1], r.box[3])
        edge = F.when(box, G.ring_boundary(x, y, r.shell)).otherwise(False)
        odd = F.when(box, G.ring_odd(x, y, r.shell)).otherwise(False)
        rows.append(F.struct(F.lit(r.name).alias("region"), F.lit(r.rank).alias("rank"), _same_crs(moves, r.crs).alias("same"), edge.alias("on_boundary"), odd.alias("odd")))
    return F.array(*rows)


def membership(moves: DataFrame, regions: list[Region]) -> DataFrame:
    """A row for each move and region of the same system: covered (boundary included), strict, on_boundary."""
    # as a column of its own the array is compiled, which a generator's argument is not if it holds a lambda; the outer form as Spark
    # filters by the array's size before the plain one, which computes it, and what the points come from, once more
    out = moves.withColumn("_relations", relations(moves, regions)).select("*", F.inline_outer("_relations")).filter("same").drop("_relations", "same")
    return out.withColumn("strict", ~F.col("on_boundary") & F.col("odd")).withColumn("covered", F.col("on_boundary") | F.col("odd")).drop("odd")


def membership_join(points: DataFrame, regions: DataFrame, unrolled_edges: int = UNROLLED_EDGES) -> DataFrame:
    """Pairs of points(x, y, ...) and regions(name, rank, crs, edges, boxes) where the region covers the point.

    The region table is measured. With at most unrolled_edges edges it is read and compiled into the scan of the points. A larger one is joined by equality on
    cells of grids, so neither side is ever broadcast or paired with all of the other: a region stands in the grid whose cells are at least as wide
    as its box, so in four cells at most, and a point in its cell of each width that occurs.
    """
    extent = F.greatest(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y"), F.lit(1e-9))
    level = F.ceil(F.log2(extent)).cast("int")
    found = regions.agg(F.sum(F.size("edges")).alias("edges"), F.collect_set(level).alias("levels")).first()  # levels are exponents of doubles: few
    if (found["edges"] or 0) <= unrolled_edges:
        known = [Region(r["name"], tuple((p["x1"], p["y1"]) for p in r["edges"]) + ((r["edges"][0]["x1"], r["edges"][0]["y1"]),), r["crs"], r["rank"]) for r in regions.collect()]
        if not known:
            return points.withColumns({"region": F.lit(None).cast("string"), "rank": F.lit(None).cast("int")}).filter(F.lit(False))
        covered = membership(points, known).filter("covered")
        return covered.select(*[F.col(f"`{c}`") for c in points.columns], "region", "rank")
    r = regions.select(F.col("name").alias("region"), "rank", F.col("crs").alias("region_crs"), "edges", "min_x", "min_y", "max_x", "max_y", level.alias("level"))
    box = F.col("x").between(F.col("min_x"), F.col("max_x")) & F.col("y").between(F.col("min_y"), F.col("max_y"))
    same = F.col("crs") == F.col("region_crs") if "crs" in points.columns else F.lit(True)
    cell = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("level"))).cast("long")
    r = r.withColumn("cx", F.explode(F.sequence(cell("min_x"), cell("max_x")))).withColumn("cy", F.explode(F.sequence(cell("min_y"), cell("max_y"))))
    p = points.withColumn("level", F.explode(F.array(*[F.lit(v) for v in sorted(found["levels"])])))
    pairs = p.withColumn("cx", cell("x")).withColumn("cy", cell("y")).join(r, ["level", "cx", "cy"]).filter(box & same)
    return pairs.filter(G.covered_by(F.col("x"), F.col("y"), F.col("edges"))).drop("level", "cx", "cy", "edges", "min_x", "min_y", "max_x", "max_y", "region_crs")


def _by_subject(*order: str) -> Window:
    return Window.partitionBy("subject").orderBy(*order)


def with_steps(moves: DataFrame, regions: list[Region], bucket: str | None = None) -> DataFrame:
    """Adds mask, prev_mask (null for a subject's first move) and step (0 for the first).

    bucket (hour, day, month, ...) splits long histories: windows then run within (subject, bucket), and what a bucket needs from
    the ones before it (one mask, one count) comes from a table of a row per subject and bucket. Use it where
    single subjects hold a large share of all moves.
    """
    m = moves.withColumn("mask", mask_of(moves, regions))
    if bucket is None:
        w = _by_subject("ts", "seq")
        return m.withColumn("prev_mask", F.lag("mask").over(w)).withColumn("step", F.row_number().over(w) - 1)
    m = m.withColumn("bucket", F.date_trunc(bucket, "ts"))
    w = Window.partitionBy("subject", "bucket").orderBy("ts", "seq")
    m = m.withColumn("prev_mask", F.lag("mask").over(w)).withColumn("nth", F.row_number().over(w))
    ends = m.groupBy("subject", "bucket").agg(F.max_by("mask", F.struct("ts", "seq")).alias("last_mask"), F.count("*").alias("rows"))
    before = Window.partitionBy("subject").orderBy("bucket")
    earlier = F.coalesce(F.sum("rows").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = ends.select("subject", "bucket", F.lag("last_mask").over(before).alias("before_mask"), earlier.alias("before_rows"))
    m = m.join(ends, ["subject", "bucket"])
    m = m.withColumn("prev_mask", F.when(F.col("nth") == 1, F.col("before_mask")).otherwise(F.col("prev_mask")))
    return m.withColumn("step", F.col("before_rows") + F.col("nth") - 1).drop("bucket", "nth", "before_mask", "before_rows")


def crossings(moves: DataFrame, regions: list[Region], bucket: str | None = None) -> DataFrame:
    """subject, seq, ts, step, region, rank, kind for every change of membership between a subject's consecutive moves."""
    return crossings_of_steps(with_steps(moves, regions, bucket), regions)


def crossings_of_steps(steps: DataFrame, regions: list[Region]) -> DataFrame:
    """The same from what with_steps gives."""
    changed = steps.filter("prev_mask is not null and mask <> prev_mask")
    rows = []
    for i, r in enumerate(regions):
        was, now = bit_of(F.col("prev_mask"), i, len(regions)), bit_of(F.col("mask"), i, len(regions))
        kind = F.when(~was & now, "enters").when(was & ~now, "leaves")
        rows.append(F.struct(F.lit(r.name).alias("region"), F.lit(r.rank).alias("rank"), kind.alias("kind")))
    out = changed.select("subject", "seq", "ts", "step", F.inline(F.array(*rows)))
    return out.filter("kind is not null")


def crossings_of_memberships(samples: DataFrame, positive: DataFrame, names: DataFrame) -> DataFrame:
    """Crossings from positive rows only: samples(subject, seq, ts), positive(subject, seq, region), names(region, rank).

    Samples without a positive row count as outside. names is a region list: small by nature, but joined by Spark's own choice.
    """
    held = positive.groupBy("subject", "seq").agg(F.collect_set("region").alias("held"))
    s = samples.join(held, ["subject", "seq"], "left").withColumn("held", F.coalesce("held", F.array().cast("array<string>")))
    s = s.withColumn("before", F.lag("held").over(_by_subject("ts", "seq"))).filter("before is not null")
    gone, come = F.array_except("before", "held"), F.array_except("held", "before")
    kinds = F.concat(F.transform(come, lambda r: F.struct(r.alias("region"), F.lit("enters").alias("kind"))), F.transform(gone, lambda r: F.struct(r.alias("region"), F.lit("leaves").alias("kind"))))
    return s.select("subject", "seq", "ts", F.inline(kinds)).join(names, "region")


def first_tick(due: DataFrame, ticks: DataFrame, deadline: str, clock: str = "subject") -> DataFrame:
    """due with emitted_at: the first tick at or after the deadline, null if there is none.

    With the subject's clock, deadlines and moves of a subject are merged and one running value in descending time finds the next
    tick: O(n log n), no range join. With the global clock they are merged by minute, and a minute's last resort is the first tick
    of a later minute of the day or else of a later day, found on a table of a row per minute.
    """
    t = ticks.select(F.col("ts").alias("tick"), *(["subject"] if clock == "subject" else []))
    d = due
    if clock == "subject":
        keys = ["subject"]
    else:
        keys = ["minute"]
        d, t = d.withColumn("minute", F.date_trunc("minute", deadline)), t.withColumn("minute", F.date_trunc("minute", "tick"))
    both = d.withColumn("at", F.col(deadline)).withColumn("is_tick", F.lit(0)).unionByName(t.withColumn("at", F.col("tick")).withColumn("is_tick", F.lit(1)).drop("tick"), allowMissingColumns=True)
    after = Window.partitionBy(*keys).orderBy(F.col("at").desc(), F.col("is_tick").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = both.withColumn("emitted_at", F.last(F.when(F.col("is_tick") == 1, F.col("at")), ignorenulls=True).over(after)).filter("is_tick = 0")
    if clock != "subject":
        later = lambda w: F.last("first", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
        minutes = t.groupBy("minute").agg(F.min("tick").alias("first")).unionByName(d.select("minute").distinct(), allowMissingColumns=True)
        minutes = minutes.groupBy("minute").agg(F.min("first").alias("first")).withColumn("day", F.date_trunc("day", "minute"))
        days = minutes.groupBy("day").agg(F.min("first").alias("first"))
        days = days.select("day", later(Window.orderBy(F.col("day").desc())).alias("later_day"))  # a row per day
        minutes = minutes.withColumn("later", later(Window.partitionBy("day").orderBy(F.col("minute").desc()))).join(days, "day")
        out = out.join(minutes.select("minute", "later", "later_day"), "minute", "left")
        out = out.withColumn("emitted_at", F.coalesce("emitted_at", "later", "later_day")).drop("minute", "later", "later_day")
    return out.drop("at", "is_tick")


def sustained(moves: DataFrame, regions: list[Region], durations: dict[str, int], clock: str = "subject", kinds: tuple[str, ...] = ("enters", "leaves")) -> DataFrame:
    """Sustained events of unguarded specs: for each crossing and duration (microseconds), one that no opposite crossing cuts
    short before the deadline (one at the deadline comes too late to cancel) and whose deadline some tick reaches.

    subject, region, rank, kind, duration, started_at, effective_at, emitted_at, seq, step (of the crossing).
    """
    return sustained_of_crossings(crossings(moves, regions), moves, durations, clock, kinds)


def sustained_of_crossings(crossed: DataFrame, moves: DataFrame, durations: dict[str, int], clock: str = "subject", kinds: tuple[str, ...] = ("enters", "leaves")) -> DataFrame:
    """The same from crossings(subject, seq, ts, region, kind, ...), however they were found; moves are the ticks."""
    c = crossed.withColumn("next_ts", F.lead("ts").over(Window.partitionBy("subject", "region").orderBy("ts", "seq")))
    c = c.filter(F.col("kind").isin(*kinds))
    specs = F.array(*[F.struct(F.lit(n).alias("duration"), F.lit(us).cast("long").alias("us"), F.lit(k).alias("spec_rank")) for k, (n, us) in enumerate(durations.items())])
    c = c.select("*", F.inline(specs)).withColumnRenamed("ts", "started_at")
    c = c.withColumn("effective_at", F.col("started_at") + F.make_dt_interval(secs=(F.col("us") / 1_000_000).cast("decimal(18,6)")))
    c = c.filter("next_ts is null or effective_at <= next_ts")
    return first_tick(c.drop("next_ts", "us"), moves, "effective_at", clock).filter("emitted_at is not null")


def trace(instant: DataFrame, held: DataFrame, moves: DataFrame) -> DataFrame:
    """Both kinds of event in one table with the order key (step, phase, k1, k2): at a move, sustained events that it exposes come
    first, by deadline and spec rank, then crossings by region rank."""
    steps = moves.select("subject", "seq", "ts", (F.row_number().over(_by_subject("ts", "seq")) - 1).alias("at_step"))
    exposing = steps.groupBy("subject", F.col("ts").alias("emitted_at")).agg(F.min("at_step").alias("at_step"))
    a = instant.select("subject", F.col("step"), F.lit(1).alias("phase"), F.lit(None).cast("timestamp_ntz").alias("k1"), F.col("rank").alias("k2"), "kind", "region", F.lit(None).cast("string").alias("duration"), F.col("ts").alias("effective_at"), F.col("ts").alias("emitted_at"))
    b = held.join(exposing, ["subject", "emitted_at"]).select("subject", F.col("at_step").alias("step"), F.lit(0).alias("phase"), F.col("effective_at").cast("timestamp_ntz").alias("k1"), F.col("spec_rank").alias("k2"), F.concat(F.lit("sustained "), "kind").alias("kind"), "region", "duration", "effective_at", "emitted_at")
    return a.unionByName(b)
