import itertools
import math
import random

import pytest

from tidefence.errors import GeometryError
from tidefence.operators import rings as R
from tidefence.operators.regions import Region

CORNERS = "ring string, pos int, x double, y double"
EDGES = "grp string, i long, x1 double, y1 double, x2 double, y2 double"


def table(spark, rings):
    return spark.createDataFrame([(name, k, float(x), float(y)) for name, ring in rings.items() for k, (x, y) in enumerate(ring)], CORNERS)


def plain(ring):
    """The number of pairs that meet, by all pairs."""
    from tidefence.operators.regions import segments_meet

    n = len(ring)
    edges = [(ring[i], ring[(i + 1) % n]) for i in range(n)]
    return sum(segments_meet(*edges[i], *edges[j]) for i in range(n) for j in range(i + 2, n) if (i, j) != (0, n - 1))


def test_faults_equal_all_pairs_and_the_single_region(spark):
    rng = random.Random(5)
    rings = {f"r{k}": [(rng.randrange(9), rng.randrange(9)) for _ in range(rng.randrange(3, 9))] for k in range(120)}
    rings |= {"bow": [(0, 0), (4, 4), (4, 0), (0, 4)], "spike": [(0, 0), (10, 0), (5, 0), (5, 5)], "line": [(0, 0), (1, 1), (3, 3)], "two": [(0, 0), (1, 1), (0, 0)], "nan": [(0, 0), (math.nan, 1), (1, 0)], "one": [(1, 1)]}
    got = {r.ring: r for r in R.ring_faults(table(spark, rings)).collect()}
    assert set(got) == set(rings)
    for name, ring in rings.items():
        r = got[name]
        assert r.corners == len(ring)
        try:
            Region.closed(name, ring, "c")
            valid = True
        except GeometryError:
            valid = False
        if ring[0] != ring[-1]:  # a region's closing corner is not repeated here
            assert (r.fault is None) == valid, (name, ring, r)
        if r.fault in (None, "crossing"):
            assert r.crossings == plain(ring), (name, ring, r)
    assert [got[n].fault for n in ("bow", "spike", "line", "two", "nan", "one")] == ["crossing", "crossing", "line", "corners", "coordinate", "corners"]


def test_empty_and_null_rows(spark):
    assert R.ring_faults(table(spark, {})).count() == 0
    rows = [("a", 0, 0.0, 0.0), ("a", 1, None, 1.0), ("a", 2, 2.0, 0.0), (None, 0, 1.0, 1.0)]
    assert [(r.ring, r.fault, r.crossings) for r in R.ring_faults(spark.createDataFrame(rows, CORNERS)).collect()] == [("a", "coordinate", None)]
    assert R.outlines(spark.createDataFrame([], EDGES)).count() == 0


@pytest.mark.parametrize("turn", [(1, 0), (0, 1), (1, 1)])
def test_long_rings_cost_few_pairs(spark, turn, n=25_000):
    """A comb of 4 n edges with its teeth in three directions; one tooth is then bent over another."""
    (c, s), out = turn, {}
    for name in ("comb", "bent"):
        ring = [p for k in range(n) for p in ((4 * k, 10), (4 * k, 5000), (4 * k + 2, 5000), (4 * k + 2, 10))] + [(4 * n, 10), (4 * n, 0), (0, 0)]
        if name == "bent":
            ring[4001] = (ring[4001][0] + 5, 4000)  # over the tooth to its right
        out[name] = [(c * x - s * y, s * x + c * y) for x, y in ring]
    t = table(spark, out).cache()
    e = R.edges_of(t)
    entries = R.in_strips(e.withColumnRenamed("ring", "key"), "key")
    assert entries.count() <= 6 * e.count()
    assert entries.groupBy("key", "strip").count().selectExpr("sum(count * count) AS pairs").first().pairs < 60 * e.count()
    got = {r.ring: (r.fault, r.crossings) for r in R.ring_faults(t).collect()}
    assert got["comb"] == (None, 0) and got["bent"][0] == "crossing" and 1 <= got["bent"][1] <= 8
    t.unpersist()


def boxes(cells):
    out = []
    for x, y, w in cells:
        ring = [(x, y), (x + w, y), (x + w, y + w), (x, y + w)]
        out += [(*ring[k], *ring[(k + 1) % 4]) for k in range(4)]
    return out


def outlined(spark, groups):
    rows = [(g, k, *map(float, e)) for g, edges in groups.items() for k, e in enumerate(edges)]
    return R.outlines(spark.createDataFrame(rows, EDGES))


def test_outlines_of_cells_of_several_sizes(spark):
    rng = random.Random(8)
    groups, areas = {}, {}
    for g in "pqr":
        cells = []
        for x, y in itertools.product(range(0, 16, 4), repeat=2):
            cells += [(x, y, 4)] if rng.random() < 0.4 else [(x + i, y + j, 1) for i in range(4) for j in range(4) if rng.random() < 0.6]
        groups[g], areas[g] = boxes(cells), sum(w * w for _, _, w in cells)
    rows = outlined(spark, groups).collect()
    for g in groups:
        assert sum(r.area for r in rows if r.grp == g) == areas[g]
    rings = {}
    for r in rows:
        rings.setdefault((r.grp, r.ring), []).append(r)
    for ring in rings.values():
        ring.sort(key=lambda r: r.pos)
        assert [r.pos for r in ring] == list(range(len(ring)))
        for a, b in zip(ring, ring[1:] + ring[:1], strict=True):  # steps go along one axis, and areas are those of the steps
            assert (a.x == b.x) != (a.y == b.y)
            assert b.area == (a.x * b.y - b.x * a.y) / 2


def test_pinch_holes_and_slanted_neighbours(spark):
    frame = [(x, y, 1) for x in range(3) for y in range(3) if (x, y) != (1, 1)]
    triangles = [(0, 0, 4, 0), (4, 0, 2, 4), (2, 4, 0, 0), (4, 0, 6, 4), (6, 4, 2, 4), (2, 4, 4, 0)]
    rows = outlined(spark, {"pinch": boxes([(0, 0, 1), (1, 1, 1)]), "frame": boxes(frame), "slant": triangles}).collect()
    got = {}
    for r in rows:
        got.setdefault(r.grp, {}).setdefault(r.ring, [0.0, 0])
        got[r.grp][r.ring][0] += r.area
        got[r.grp][r.ring][1] += not r.straight
    plain = {g: sorted(map(tuple, v.values())) for g, v in got.items()}
    assert plain == {"pinch": [(1.0, 4), (1.0, 4)], "frame": [(-1.0, 4), (9.0, 4)], "slant": [(16.0, 4)]}


@pytest.mark.parametrize("edges", [boxes([(0, 0, 2), (1, 1, 2)]), boxes([(0, 0, 1), (0, 0, 1)])])
def test_overlaps_are_errors(spark, edges):
    with pytest.raises(Exception, match="overlap"):
        outlined(spark, {"g": edges}).collect()
