import math
import random

import pytest
from pyspark.sql import functions as F

from tidefence.errors import GeometryError
from tidefence.functions import geometry as G
from tidefence.functions import text as T
from tidefence.functions import wkt as W
from tidefence.operators import corpus, world
from tidefence.operators.regions import Point, Region, region_table, side, with_edges

CRS = "http://www.opengis.net/def/crs/OGC/1.3/CRS84"
SQUARE = corpus.SQUARE


def profile():
    return [(list(r.shell), p, *flags) for _, r, p, flags in corpus.cases()]


def test_corpus_of_89_cases(spark):
    cases = profile()
    assert len(cases) == 89
    rows = []
    for i, (shell, (x, y), _, _) in enumerate(cases):
        r = Region.closed(f"r{i}", shell, CRS)
        p = Point(float(x), float(y), CRS)
        assert (r.contains(p), r.boundary_has(p)) == cases[i][2:], i
        rows.append((i, float(x), float(y), [(*a, *b) for a, b in zip(r.shell, r.shell[1:], strict=False)]))
    df = spark.createDataFrame(rows, f"i int, x double, y double, e {G.EDGE_TYPE}")
    x, y, e = F.col("x"), F.col("y"), F.col("e")
    got = df.select("i", G.within(x, y, e), G.on_boundary(x, y, e), G.covered_by(x, y, e)).collect()
    for i, within, edge, covered in got:
        assert (within, edge, covered) == (*cases[i][2:], cases[i][2] or cases[i][3]), i


def test_unrolled_rings_agree_with_edge_arrays(spark):
    for shell, (x, y), within, edge in profile():
        r = Region.closed("r", shell, CRS)
        row = spark.range(1).select(G.ring_contains(F.lit(float(x)), F.lit(float(y)), r.shell), G.ring_boundary(F.lit(float(x)), F.lit(float(y)), r.shell), G.ring_covers(F.lit(float(x)), F.lit(float(y)), r.shell))
        if (x, y) in ((5, 5), (2, 2), (3, 3)):
            assert tuple(row.first()) == (within, edge, within or edge)


def test_orientation_is_exact_near_lines(spark):
    r = random.Random(3)
    rows = []
    for i in range(400):
        ax, ay, bx, by = (r.uniform(-100, 100) for _ in range(4))
        t = r.random()
        px, py = ax + t * (bx - ax), ay + t * (by - ay)
        for _ in range(r.randint(0, 2)):
            px = math.nextafter(px, r.choice([-math.inf, math.inf]))
        rows.append((i, ax, ay, bx, by, px, py))
    for i in range(400, 440):
        k = r.uniform(1, 3)
        rows.append((i, -k, 2 * k, 3 * k, -2 * k, k, 0.0))  # exactly on the line
    df = spark.createDataFrame(rows, "i int, ax double, ay double, bx double, by double, px double, py double")
    got = df.select("i", G.orientation(*map(F.col, ("ax", "ay", "bx", "by", "px", "py")))).collect()
    for i, sign in got:
        _, ax, ay, bx, by, px, py = rows[i]
        assert sign == side((ax, ay), (bx, by), (px, py)), rows[i]
    assert any(s == 0 for _, s in got)


def test_cross_product_of_crs84_cases(spark):
    cases = [c for i, c in enumerate(profile()) if i not in (14, 15, 16)]
    assert len(cases) == 86
    regions = [Region.closed(f"r{i:02d}", c[0], CRS, i) for i, c in enumerate(cases)]
    points = spark.createDataFrame([(f"r{i:02d}", float(c[1][0]), float(c[1][1]), CRS) for i, c in enumerate(cases)], "subject string, x double, y double, crs string")
    m = world.topology_matrix(points, region_table(spark, regions))
    assert m.count() == 7396
    assert m.filter("subject = region and on_boundary").count() == 38
    assert m.filter("covered = disjoint").count() == 0


@pytest.mark.parametrize(
    "shell, message",
    [
        (((0, 0), (1, 0), (0, 0)), "at least four"),
        (((0, 0), (1, 0), (1, 1), (0, 1)), "not closed"),
        (((0, 0), (1, 0), (1, math.nan), (0, 0)), "finite"),
        (((0, 0), (1, 0), (0, 0), (1, 0), (0, 0)), "three distinct"),
        (((0, 0), (0, 0), (1, 0), (1, 1), (0, 0)), "no length"),
        (((0, 0), (1, 1), (2, 2), (0, 0)), "one line"),
        (((0, 0), (2, 2), (2, 0), (0, 2), (0, 0)), "cross"),
    ],
)
def test_rejected_shells(shell, message):
    with pytest.raises(GeometryError, match=message):
        Region("bad", shell, CRS)


def test_points_and_systems():
    with pytest.raises(GeometryError):
        Point(math.inf, 0, CRS)
    with pytest.raises(GeometryError):
        Point(0, 0, "")
    with pytest.raises(GeometryError, match="urn:other"):
        Region.closed("r", SQUARE, CRS).covers(Point(1, 1, "urn:other"))


def test_with_edges_closes_shells(spark):
    df = spark.createDataFrame([("a", 0, CRS, [(0.0, 0.0), (4.0, 0.0), (0.0, 3.0)])], "name string, rank int, crs string, shell array<struct<x:double,y:double>>")
    row = with_edges(df).first()
    assert len(row.edges) == 3 and (row.max_x, row.max_y) == (4.0, 3.0)


def test_longitudes_and_numbers(spark):
    row = spark.range(1).select(*[G.normal_longitude(F.lit(v)) for v in (180.4, -180.0, 180.0, 359.5, -200.25)]).first()
    assert tuple(row) == (-179.6, -180.0, 180.0, -0.5, 159.75)
    values = [121.5, 0.1, 1e-5, 123456789.125, 1e20, -0.0, 0.0, 2.0 / 3, 1e15, 99999.0, -7.25e-4, 1e-4, 3e-200]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (10, 15):
        got = [r[0] for r in df.select(T.short_number(F.col("v"), digits)).collect()]
        assert got == [f"{v:.{digits}g}" for v in values]


def test_text_functions(spark):
    from urllib.parse import quote
    import json

    values = ["a b*~/@é", "plain", 'q"\\\n\x1f\x0b', "ü#?&"]
    df = spark.createDataFrame([(v,) for v in values], "s string")
    assert [r[0] for r in df.select(T.iri_part(F.col("s"))).collect()] == [quote(v, safe="") for v in values]
    assert [r[0] for r in df.select(T.json_string(F.col("s"))).collect()] == [json.dumps(v, ensure_ascii=False) for v in values]
    row = spark.range(1).select(T.padded(F.lit(7)), T.padded(F.lit(12345)), T.duration_us(F.lit(1.5), F.lit("min")), T.iri_local_name(F.lit("http://a/b#c"))).first()
    assert tuple(row) == ("0007", "12345", 90_000_000, "c")


def test_wkt_relations_as_columns_and_sql(spark):
    W.register(spark)
    poly = f"<{CRS}> POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0))"
    df = spark.createDataFrame([(f"<{CRS}> POINT (5 5)", poly), (f"<{CRS}> POINT (10 5)", poly), ("POINT (11 5)", poly)], "a string, b string")
    want = [(True, True, False, False), (False, True, True, False), (False, False, False, True)]
    assert [tuple(r) for r in df.select(W.sf_within("a", "b"), W.sf_intersects("a", "b"), W.sf_touches("a", "b"), W.sf_disjoint("a", "b")).collect()] == want
    df.createOrReplaceTempView("pairs")
    assert [tuple(r) for r in spark.sql("select sf_within(a, b), sf_intersects(a, b), sf_touches(a, b), sf_disjoint(a, b) from pairs").collect()] == want
    other = spark.createDataFrame([("<urn:x> POINT (5 5)", poly)], "a string, b string")
    with pytest.raises(Exception, match="different reference systems"):
        other.select(W.sf_within("a", "b")).collect()


def test_exponents_are_no_words(spark):
    """Numbers with an exponent, as short_number prints small and large ones, are read whole."""
    text = f"<{CRS}> POINT (1e-07 -2.5E+15)"
    row = spark.createDataFrame([(text, "MULTIPOINT Z((1 2e3 7),(-4 .5 8))")], "a string, b string").select(W.first_point("a").alias("p"), W.coordinates("a").alias("a"), W.coordinates("b").alias("b"), W.first_point("b").alias("q")).first()
    assert tuple(row.p) == (1e-07, -2.5e15) and [tuple(c) for c in row.a] == [tuple(row.p)]
    assert [tuple(c) for c in row.b] == [(1.0, 2000.0), (-4.0, 0.5)] and tuple(row.q) == (1.0, 2000.0)


def test_wkt_relations_compute_a_move_once(spark, tmp_path):
    """Relations are compiled and inlined from one array, and no step derives points a second time."""
    from tidefence.queries import wkt_relations

    rows = [(i, i % 2, float(x), f'{{"k": {y}}}') for i, (x, y) in enumerate([(10, 10), (30, 60), (1e-7, 30), (2000, 5)])]
    spark.createDataFrame(rows, "event_id long, user_id long, value double, props string").selectExpr("*", "timestamp '2026-01-01' AS ts", "'view' AS event_type").write.parquet(str(tmp_path / "events.parquet"))
    df = wkt_relations(spark, str(tmp_path))
    plan = df._jdf.queryExecution().executedPlan()
    assert "NestedLoop" not in plan.toString() and "Filter (size(" not in plan.toString()
    got = {(r.seq, r.region): (r.within, r.intersects, r.touches) for r in df.collect()}
    inside, outside, edge = (True, True, False), (False, False, False), (False, True, True)
    assert len(got) == 20 and got[0, "Notch"] == inside and got[1, "Tri"] == edge and got[2, "BandLow"] == got[2, "BandMid"] == edge
    assert got[2, "Tri"] == outside and all(v == outside for (seq, _), v in got.items() if seq == 3)


def test_sql_relations_of_a_pair_are_one_expression(spark):
    W.register(spark)
    df = spark.createDataFrame([("POINT (1e-07 0)", "POLYGON ((0 0, 1 0, 1 1, 0 0))"), (f"<{W.CRS84}> POINT (2 1.5E-1)", "POLYGON((0 0, 4 0, 0 4, 0 0))")], "p string, g string")
    out = df.selectExpr("sf_within(p, g)", "sf_touches(p, g)", "sf_intersects(p, g)", "sf_disjoint(p, g)")
    # nothing is parsed in a step of its own for each function: all four stand over the two texts, and Spark shares what is equal
    assert out._jdf.queryExecution().executedPlan().toString().count("Project") == 1
    assert [tuple(r) for r in out.collect()] == [(False, True, True, False), (True, False, True, False)]


def test_wkt_polygons_with_holes(spark):
    from tidefence.functions import wkt as W

    W.register(spark)
    frame = "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0), (4 4, 6 4, 6 6, 4 6, 4 4))"
    points = {(2, 2): "within", (5, 5): "outside", (4, 5): "touches", (10, 3): "touches", (11, 1): "outside", (6, 6): "touches", (8, 2): "within", (3, 3): "within"}
    df = spark.createDataFrame([(f"POINT ({x} {y})", frame, want) for (x, y), want in points.items()], "p string, g string, want string")
    sql = df.selectExpr("want", "sf_within(p, g) w", "sf_touches(p, g) t", "sf_intersects(p, g) i", "sf_disjoint(p, g) d")
    columns = df.select("want", W.sf_within("p", "g").alias("w"), W.sf_touches("p", "g").alias("t"), W.sf_intersects("p", "g").alias("i"), W.sf_disjoint("p", "g").alias("d"))
    for r in sql.collect() + columns.collect():
        assert (r.w, r.t, r.i, r.d) == (r.want == "within", r.want == "touches", r.want != "outside", r.want == "outside"), r
