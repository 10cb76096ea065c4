"""Rings as rows of edges: whether they are simple, and the outline of polygons that lie side by side. Everything runs in the JVM, and no ring is ever one row or one task.

Edges that may meet are found by strips. For each key (a ring, a group of polygons) there are strips along one of four directions (x, y, x + y, x - y): as many as keep the
entries of edges in strips below five an edge, and of the four directions the one that allows most. So a ring of n edges whose teeth run along one of these costs about n pairs.
A sum of two doubles is rounded in order, so edges that share a point share a strip.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..streaming.sinks import stored

#: Entries that edges may have beyond one each, as a multiple of their number.
SPREAD = 4
_ENDS = ("x1", "y1", "x2", "y2")


def _along(k: int, end: int) -> Column:
    x, y = F.col(f"x{end}"), F.col(f"y{end}")
    return (x, y, x + y, x - y)[k]


def in_strips(edges: DataFrame, key: str) -> DataFrame:
    """edges(key, i, x1, y1, x2, y2) once for each strip that they reach, with strip and first, the lowest one."""
    low, high = (lambda k, f=f: f(_along(k, 1), _along(k, 2)) for f in (F.least, F.greatest))
    sums = [F.count("*").alias("n")]
    for k in range(4):
        sums += [F.min(low(k)).alias(f"lo{k}"), F.max(high(k)).alias(f"hi{k}"), F.sum(high(k) - low(k)).alias(f"s{k}")]
    count = lambda k: F.when(F.col(f"hi{k}") > F.col(f"lo{k}"), F.greatest(F.lit(1), F.floor(F.least(F.lit(1.0), SPREAD * (F.col(f"hi{k}") - F.col(f"lo{k}")) / F.col(f"s{k}")) * F.col("n")).cast("int"))).otherwise(F.lit(1))
    options = F.array(*[F.struct(count(k).alias("strips"), F.lit(k).alias("k"), F.col(f"lo{k}").alias("lo"), F.col(f"hi{k}").alias("hi")) for k in range(4)])
    e = edges.join(edges.groupBy(key).agg(*sums).select(key, F.array_max(options).alias("o")), key)
    pick = lambda f: reduce(lambda rest, k: F.when(F.col("o.k") == k, f(k)).otherwise(rest), range(1, 4), f(0))
    strip = lambda u: F.when(F.col("o.strips") > 1, F.least(F.col("o.strips") - 1, F.floor((u - F.col("o.lo")) / (F.col("o.hi") - F.col("o.lo")) * F.col("o.strips")).cast("int"))).otherwise(F.lit(0))
    e = e.withColumn("first", strip(pick(low))).withColumn("last", strip(pick(high)))
    return e.select(*edges.columns, "first", F.explode(F.sequence("first", "last")).alias("strip"))


def meeting_edges(edges: DataFrame, key: str) -> DataFrame:
    """Pairs of edges of a key that share a point, each once: key, a and b (structs of i and the ends, a.i < b.i), s1..s4 (exact sides: b's ends to a, a's ends to b), cross (in a point inside both)."""
    entries = in_strips(edges, key)
    side = lambda s: entries.select(key, "strip", F.struct("i", *_ENDS, "first").alias(s))
    p = side("a").join(side("b"), [key, "strip"]).filter((F.col("a.i") < F.col("b.i")) & (F.col("strip") == F.greatest("a.first", "b.first")))
    meets = [f(F.col(f"{s}.{c}1"), F.col(f"{s}.{c}2")) <= g(F.col(f"{t}.{c}1"), F.col(f"{t}.{c}2")) for c in "xy" for f, g, s, t in ((F.least, F.greatest, "a", "b"), (F.least, F.greatest, "b", "a"))]
    p = p.filter(reduce(lambda x, y: x & y, meets))
    ends = lambda s: [F.col(f"{s}.{c}") for c in _ENDS]
    a, b = ends("a"), ends("b")
    names = ("x1", "y1", "x2", "y2", "px", "py")
    turns = F.array(*[F.struct(*[c.alias(n) for c, n in zip((*line, *dot), names, strict=True)]) for line, dot in ((a, b[:2]), (a, b[2:]), (b, a[:2]), (b, a[2:]))])
    at_end = lambda t: (t["px"] == t["x2"]) & (t["py"] == t["y2"])
    p = p.withColumn("s", F.transform(turns, lambda t: F.when(at_end(t), 0).otherwise(G.orientation(*[t[n] for n in names]))))
    p = p.withColumns({f"s{k + 1}": F.get("s", F.lit(k)) for k in range(4)})
    p = p.withColumn("cross", (F.col("s1") * F.col("s2") < 0) & (F.col("s3") * F.col("s4") < 0))
    # boxes meet, so two edges share a point unless one lies on one side of the other
    return p.filter((F.col("s1") * F.col("s2") <= 0) & (F.col("s3") * F.col("s4") <= 0)).select(key, "a", "b", "s1", "s2", "s3", "s4", "cross")


def edges_of(corners: DataFrame) -> DataFrame:
    """Edges of closed rings from corners(ring, pos, x, y), pos from 0 without gaps and the first corner not repeated: ring, i, x1, y1, x2, y2."""
    sizes = corners.groupBy("ring").agg(F.count("*").alias("n"))
    start = corners.join(sizes, "ring").select("ring", F.col("pos").alias("i"), F.col("x").alias("x1"), F.col("y").alias("y1"), ((F.col("pos") + 1) % F.col("n")).alias("to"))
    end = corners.select("ring", F.col("pos").alias("to"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    return start.join(end, ["ring", "to"]).select("ring", "i", *_ENDS)


def ring_faults(corners: DataFrame) -> DataFrame:
    """ring, corners, fault, crossings of corners(ring, pos, x, y), as ``edges_of`` takes them: the first rule that a ring breaks, null if none.

    In this order: ``coordinate`` (null, NaN or infinite), ``corners`` (fewer than three different ones), ``edge`` (one without length), ``line`` (all corners on one line),
    ``crossing`` (edges that are no neighbours cross or touch). crossings counts such pairs of edges; it is null for rings with another fault, which are not searched.
    Rows with a null ring or pos are left out; gaps or repeats of pos are an error of the caller. Other columns are ignored. An empty table gives no rows.
    """
    c = corners.filter("ring IS NOT NULL AND pos IS NOT NULL").select("ring", "pos", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    finite = lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False)) & ~F.isnan(v)
    c = c.withColumn("fine", finite(F.col("x")) & finite(F.col("y")))
    # three different corners: one differs from both the least and the greatest
    dot = F.struct("x", "y")
    ends = c.groupBy("ring").agg(F.count("*").alias("corners"), F.min("fine").alias("fine"), F.min(dot).alias("low"), F.max(dot).alias("high"))
    between = c.join(ends.filter("fine"), "ring").filter((dot != F.col("low")) & (dot != F.col("high")))
    off = G.orientation(F.col("low.x"), F.col("low.y"), F.col("high.x"), F.col("high.y"), F.col("x"), F.col("y"))
    between = between.select("ring", (off != 0).alias("off")).groupBy("ring").agg(F.max("off").alias("off"))
    e = edges_of(c.filter("fine"))
    short = e.filter("x1 = x2 AND y1 = y2").select("ring").distinct().withColumn("short", F.lit(True))
    known = ends.join(between, "ring", "left").join(short, "ring", "left")
    fault = F.when(~F.col("fine"), "coordinate").when(F.col("off").isNull(), "corners").when(F.col("short"), "edge").when(~F.col("off"), "line")
    known = stored(known.select("ring", "corners", fault.alias("fault")), "rings")
    searched = e.join(known.filter("fault IS NULL").select("ring", "corners"), "ring")
    m = meeting_edges(searched.select("ring", "i", *_ENDS), "ring").join(known.select("ring", "corners"), "ring")
    gap = F.col("b.i") - F.col("a.i")
    crossed = m.filter((gap > 1) & (gap < F.col("corners") - 1)).groupBy("ring").agg(F.count("*").alias("crossings"))
    out = known.join(crossed, "ring", "left")
    crossings = F.when(F.col("fault").isNull(), F.coalesce("crossings", F.lit(0)))
    return out.select("ring", "corners", F.coalesce("fault", F.when(F.col("crossings") > 0, "crossing")).alias("fault"), crossings.alias("crossings"))


# -- outlines -------------------------------------------------------------------------------------------


def _cancelled(edges: DataFrame) -> DataFrame:
    """Segments that only one polygon of the group has, with the interior on the left: grp, x1, y1, x2, y2."""
    met = stored(meeting_edges(edges, "grp"), "meetings")
    wrong = F.when(F.col("cross"), F.raise_error(F.lit("polygons of a group overlap")).cast("double"))
    on = lambda px, py, s: px.between(F.least(f"{s}.x1", f"{s}.x2"), F.greatest(f"{s}.x1", f"{s}.x2")) & py.between(F.least(f"{s}.y1", f"{s}.y2"), F.greatest(f"{s}.y1", f"{s}.y2"))
    cuts = []
    for k, (own, other, n) in enumerate((("a", "b", 1), ("a", "b", 2), ("b", "a", 1), ("b", "a", 2))):
        px, py = F.col(f"{other}.x{n}"), F.col(f"{other}.y{n}")
        cut = met.filter(F.col("cross") | ((F.col(f"s{k + 1}") == 0) & on(px, py, own)))
        cuts.append(cut.select("grp", F.col(f"{own}.i").alias("i"), F.coalesce(wrong, px).alias("x"), py.alias("y")))
    up = F.when((F.col("x1") < F.col("x2")) | ((F.col("x1") == F.col("x2")) & (F.col("y1") < F.col("y2"))), 1).otherwise(-1)
    dots = [edges.select("grp", "i", F.col(f"x{n}").alias("x"), F.col(f"y{n}").alias("y")) for n in (1, 2)]
    dots = reduce(DataFrame.unionByName, cuts + dots).distinct()
    w = Window.partitionBy("grp", "i").orderBy("x", "y")  # of an edge, in a line
    pieces = dots.select("grp", "i", "x", "y", F.lead("x").over(w).alias("qx"), F.lead("y").over(w).alias("qy")).filter("qx IS NOT NULL")
    pieces = pieces.join(edges.select("grp", "i", up.alias("way")), ["grp", "i"])
    net = pieces.groupBy("grp", "x", "y", "qx", "qy").agg(F.sum("way").alias("net")).filter("net <> 0")
    net = net.withColumn("net", F.when(F.abs("net") > 1, F.raise_error(F.lit("polygons of a group overlap")).cast("long")).otherwise(F.col("net")))
    ahead = F.col("net") > 0
    ends = [F.when(ahead, F.col(p)).otherwise(F.col(q)).alias(n) for p, q, n in (("x", "qx", "x1"), ("y", "qy", "y1"), ("qx", "x", "x2"), ("qy", "y", "y2"))]
    return net.select("grp", *ends)


def _jumped(links: DataFrame) -> DataFrame:
    """seg, next to seg, ring (the least seg of the cycle) and pos (steps from it), by doubling: as many joins as the longest cycle's length has bits, twice."""
    step = links.select("seg", F.col("next").alias("to"), F.least("seg", "next").alias("ring"))
    while True:
        ahead = step.select(F.col("seg").alias("to"), F.col("to").alias("to2"), F.col("ring").alias("ring2"))
        step = stored(step.join(ahead, "to").select("seg", F.col("to2").alias("to"), F.least("ring", "ring2").alias("ring"), (F.col("ring2") < F.col("ring")).alias("moved")), "cycles")
        # where no least one changes, it is that of the whole cycle
        if step.filter("moved").limit(1).count() == 0:
            break
        step = step.drop("moved")
    rings = step.select("seg", "ring")
    # steps to the segment before the least one; that one has none
    left = links.join(rings, "seg").select("seg", "ring", F.when(F.col("next") == F.col("ring"), F.lit(None)).otherwise(F.col("next")).alias("to"), F.when(F.col("next") == F.col("ring"), 0).otherwise(1).cast("long").alias("left"))
    left = stored(left, "order")
    while left.filter("to IS NOT NULL").limit(1).count():
        ahead = left.select(F.col("seg").alias("to"), F.col("to").alias("to2"), F.col("left").alias("left2"))
        left = stored(left.join(ahead, "to", "left").select("seg", "ring", F.col("to2").alias("to"), (F.col("left") + F.coalesce("left2", F.lit(0))).alias("left")), "order")
    longest = left.filter("seg = ring").select("ring", F.col("left").alias("all"))
    return left.join(longest, "ring").select("seg", "ring", (F.col("all") - F.col("left")).alias("pos"))


def outlines(edges: DataFrame) -> DataFrame:
    """The rings around groups of polygons that lie side by side: grp, ring, pos, x, y, area (of the ring's step, so that a ring's sum is its area), straight.

    edges(grp, i, x1, y1, x2, y2): those of all polygons of a group, numbered uniquely in it, each with its polygon's interior on the left. Edges are cut at corners that lie on them, opposite pieces
    cancel, and what is left is stitched: at a corner that several rings share, the sharpest left turn stays in the same interior. Shells have a positive area, holes a negative one. pos counts
    from 0 along the ring; ``straight`` marks corners at which it goes on in the same line. The ring is its least segment's number.

    Cases: rows with a null and edges without length are left out; the same edge twice, and polygons that cross, are an error; a polygon wholly inside another one that it does not touch is not noticed.
    Groups may be of any size: each step is a join or aggregation by edge or corner, never by group alone. An empty table gives no rows.
    """
    e = edges.select("grp", "i", *_ENDS).dropna().filter("x1 <> x2 OR y1 <> y2")
    s = stored(_cancelled(e), "segments").withColumn("seg", F.monotonically_increasing_id())
    s = stored(s, "segments")
    out = s.select("grp", F.col("x1").alias("x2"), F.col("y1").alias("y2"), F.col("seg").alias("next"), F.col("x2").alias("nx"), F.col("y2").alias("ny"))
    turn = F.atan2(F.col("y1") - F.col("y2"), F.col("x1") - F.col("x2")) - F.atan2(F.col("ny") - F.col("y2"), F.col("nx") - F.col("x2"))
    turn = F.when(turn <= 0, turn + 2 * F.lit(3.141592653589793)).otherwise(turn)
    best = s.join(out, ["grp", "x2", "y2"]).groupBy("grp", "seg", *_ENDS).agg(F.min(F.struct(turn.alias("turn"), "next", "nx", "ny")).alias("n"))
    straight = G.orientation(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), F.col("n.nx"), F.col("n.ny")) == 0
    linked = stored(best.select("grp", "seg", *_ENDS, F.col("n.next").alias("next"), straight.alias("straight")), "linked")
    area = (F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")) / 2
    return linked.join(_jumped(linked.select("seg", "next")), "seg").select("grp", "ring", "pos", F.col("x2").alias("x"), F.col("y2").alias("y"), area.alias("area"), "straight")
