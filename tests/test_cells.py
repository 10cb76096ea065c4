import random

import pytest
from pyspark.sql import functions as F

from tidefence.functions import cells as C
from tidefence.operators.regions import Region, Point, region_table

GRID = C.Grid("urn:test:quad", 0.0, 0.0, 64.0, 32.0)


def number(ix, iy, level):
    return (1 << 2 * level) + sum(((ix >> b & 1) << 2 * b) + ((iy >> b & 1) << 2 * b + 1) for b in range(level))


def test_cells_parents_and_bounds(spark):
    r = random.Random(3)
    points = [(r.uniform(0, 64), r.uniform(0, 32)) for _ in range(60)] + [(0.0, 0.0), (64.0, 32.0), (32.0, 16.0), (-1.0, 3.0), (3.0, 33.0)]
    df = spark.createDataFrame(points, "x double, y double")
    for level in (0, 3, 30):
        n = 1 << level
        rows = df.select("x", "y", GRID.cell(F.col("x"), F.col("y"), level).alias("c")).select("x", "y", "c", C.level_of(F.col("c")).alias("l"), GRID.bounds(F.col("c")).alias("b"), C.parent(F.col("c"), min(level, 2) or 1).alias("p"), C.contains(C.parent(F.col("c"), min(level, 2)), F.col("c")).alias("in")).collect()
        for row in rows:
            if not (0 <= row.x <= 64 and 0 <= row.y <= 32):
                assert row.c is None
                continue
            ix, iy = min(n - 1, int(row.x / 64 * n)), min(n - 1, int(row.y / 32 * n))
            assert row.c == number(ix, iy, level) and row.l == level and row["in"]
            assert row.b.x1 <= row.x <= row.b.x2 and row.b.y1 <= row.y <= row.b.y2
            assert row.p == (number(ix >> 2, iy >> 2, 1) if level == 3 else None if level == 0 else number(ix >> 2, iy >> 2, 28))
    with pytest.raises(ValueError, match="levels"):
        GRID.cell(F.col("x"), F.col("y"), 31)


def test_neighbours_and_texts(spark):
    cells = [(number(0, 0, 2),), (number(3, 3, 2),), (number(1, 2, 2),), (1,)]
    df = spark.createDataFrame(cells, "c long")
    wrapped = C.Grid("urn:w", 0.0, 0.0, 64.0, 32.0, wraps=True)
    rows = df.select("c", GRID.neighbours(F.col("c")).alias("n"), wrapped.neighbours(F.col("c")).alias("w"), GRID.text(F.array(F.col("c"), F.lit(4), F.lit(4))).alias("t")).withColumn("back", GRID.cells_of(F.col("t"))).withColumn("no", wrapped.cells_of(F.col("t"))).collect()
    around = lambda x, y, wrap: sorted({number((x + i) % 4, y + j, 2) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i or j) and 0 <= y + j < 4 and (wrap or 0 <= x + i < 4)})
    for row, (x, y) in zip(rows, [(0, 0), (3, 3), (1, 2)]):
        assert row.n == around(x, y, False) and row.w == around(x, y, True)
    assert rows[3].n == [] and rows[3].w == []
    assert all(row.back == sorted({row.c, 4}) and row.no is None for row in rows)
    m = df.groupBy().agg(F.collect_list("c").alias("cs")).select(*[v.alias(k) for k, v in GRID.measures(F.filter("cs", lambda c: c > 1)).items()]).first()
    assert (m.num_geometries, m.area, m.min_x, m.max_x, m.max_y) == (3, 3 * 64 * 32 / 16, 0.0, 64.0, 32.0)


def test_covers_hold_what_the_polygon_holds(spark):
    region = Region.closed("slanted", [(3, 2), (50, 7), (41, 30), (20, 15), (9, 28)], "c")
    level = 5
    rows = GRID.cover(region_table(spark, [region]), level).collect()
    found = {r.cell: r.whole for r in rows}
    assert len(found) == len(rows)
    for ix in range(1 << level):
        for iy in range(1 << level):
            c = number(ix, iy, level)
            held = next((found[c >> 2 * k] for k in range(level + 1) if c >> 2 * k in found), None)
            x, y, w, h = 2 * ix, iy, 2, 1
            corners = [region.covers(Point(x + i * w / 4, y + j * h / 4, "c")) for i in range(5) for j in range(5)]
            if held is True:
                assert all(corners)
            elif held is None:
                assert not any(region.contains(Point(x + i * w / 4, y + j * h / 4, "c")) for i in range(1, 4) for j in range(1, 4))
    assert any(c < 1 << 2 * level for c, whole in found.items() if whole)  # inner cells are coarse


def test_coarsening(spark):
    r = random.Random(5)
    leaves = [(k, number(ix, iy, 3)) for k in "ab" for ix in range(8) for iy in range(8) if r.random() < 0.8 or ix < 4]
    df = spark.createDataFrame([*leaves, *leaves[:5], ("a", number(0, 0, 1)), ("c", None), ("d", 1), ("d", number(1, 1, 2))], "k string, cell long")
    got = sorted(map(tuple, C.coarsened(df, "k").collect()))
    want = []
    for k in "abd":
        cells = {c for key, c in df.collect() if key == k and c is not None}
        while True:
            full = {c >> 2 for c in cells if c > 1 and all((c >> 2) * 4 + i in cells for i in range(4))}
            new = (cells | full) - {f * 4 + i for f in full for i in range(4)}
            if new == cells:
                break
            cells = new
        want += [(k, c) for c in cells if not any(c >> 2 * i in cells for i in range(1, 4) if c >> 2 * i)]
    assert got == sorted(want)


def test_points_meet_a_cover_without_one_task_per_cell(spark, monkeypatch):
    """Nearly all points lie in one coarse cell; they are neither dealt by that cell alone nor asked for at levels that the cover lacks."""
    cover = spark.createDataFrame([("a", number(0, 0, 1), None), ("b", number(7, 7, 3), [1.0])], "region string, cell long, edges array<double>")
    points = spark.range(800).select("id", F.when(F.col("id") < 790, F.lit(number(1, 2, 3))).otherwise(F.lit(number(7, 7, 3))).alias("own"))
    want = sorted([(i, "a") for i in range(790)] + [(i, "b") for i in range(790, 800)])
    small = C.in_cover(points, cover, 3)
    assert sorted((r.id, r.region) for r in small.collect()) == want
    monkeypatch.setattr(C, "SMALL_COVER", 0)
    large = C.in_cover(points, cover, 3)
    assert sorted((r.id, r.region) for r in large.collect()) == want
    empty = C.in_cover(points, cover.filter("false"), 3)
    assert empty.count() == 0
    for df in (small, large):
        asked = df._jdf.queryExecution().optimizedPlan().toString()
        assert "sequence(" not in asked  # one row for each of two levels, not for all four
    dealt = large.groupBy("region").agg(F.count_distinct(F.pmod(F.xxhash64("id", "own"), F.lit(C.DEALT))).alias("n")).collect()
    assert {r.region: r.n > 4 for r in dealt}["a"] and "deal" in large._jdf.queryExecution().optimizedPlan().toString()
