import json
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tidefence.errors import GeometryError
from tidefence.functions import geosparql as S
from tidefence.functions import planar as P

W = P.from_wkt
SQ = "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0))"


def square(x, y, s):
    return W(f"POLYGON (({x} {y}, {x + s} {y}, {x + s} {y + s}, {x} {y + s}, {x} {y}))")


# pairs and the relations that hold for them
CASES = [
    (SQ, SQ, {"sfEquals", "sfIntersects", "sfWithin", "sfContains", "ehEquals", "rcc8eq"}),
    (SQ, "POLYGON ((20 0, 30 0, 30 10, 20 10, 20 0))", {"sfDisjoint", "ehDisjoint", "rcc8dc"}),
    (SQ, "POLYGON ((10 0, 20 0, 20 10, 10 10, 10 0))", {"sfTouches", "sfIntersects", "ehMeet", "rcc8ec"}),
    (SQ, "POLYGON ((5 5, 15 5, 15 15, 5 15, 5 5))", {"sfOverlaps", "sfIntersects", "ehOverlap", "rcc8po"}),
    (SQ, "POLYGON ((2 2, 4 2, 4 4, 2 4, 2 2))", {"sfContains", "sfIntersects", "ehContains", "rcc8ntppi"}),
    ("POLYGON ((2 2, 4 2, 4 4, 2 4, 2 2))", SQ, {"sfWithin", "sfIntersects", "ehInside", "rcc8ntpp"}),
    (SQ, "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0))", {"sfContains", "sfIntersects", "ehCovers", "rcc8tppi"}),
    ("POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0))", SQ, {"sfWithin", "sfIntersects", "ehCoveredBy", "rcc8tpp"}),
    ("POINT (5 5)", SQ, {"sfWithin", "sfIntersects"}),
    ("POINT (10 5)", SQ, {"sfTouches", "sfIntersects", "ehMeet"}),
    ("LINESTRING (-5 5, 5 5)", SQ, {"sfCrosses", "sfIntersects"}),
    ("LINESTRING (0 0, 10 10)", "LINESTRING (0 10, 10 0)", {"sfCrosses", "sfIntersects"}),
    ("LINESTRING (0 0, 10 0)", "LINESTRING (5 0, 15 0)", {"sfOverlaps", "sfIntersects"}),
    ("LINESTRING (0 0, 10 0)", "LINESTRING (10 0, 15 5)", {"sfTouches", "sfIntersects", "ehMeet"}),
]


@pytest.mark.parametrize("a, b, want", CASES)
def test_relations(a, b, want):
    held = {n for n in P.NAMES if P.related(n, W(a), W(b))}
    families = {n for n in held if n.startswith("sf")}
    assert families == {n for n in want if n.startswith("sf")}
    assert {n for n in want if not n.startswith("sf")} <= held
    assert P.matrix(W(a), W(b)) == "".join(P.matrix(W(b), W(a))[i] for i in (0, 3, 6, 1, 4, 7, 2, 5, 8))


def test_matrix_and_patterns():
    assert P.matrix(W(SQ), W("POLYGON ((5 5, 15 5, 15 15, 5 15, 5 5))")) == "212101212"
    assert P.matrix(W("POINT (5 5)"), W(SQ)) == "0FFFFF212"
    assert P.relates("212101212", "T*T***T**") and not P.relates("212101212", "F********")
    with pytest.raises(GeometryError):
        P.matrix(W("<urn:a> POINT (0 0)"), W("<urn:b> POINT (0 0)"))


@pytest.mark.parametrize("seed", range(6))
def test_overlays_against_point_tests(seed):
    r = random.Random(seed)

    def shape():
        kind = r.randint(0, 2)
        x, y = r.randint(0, 6), r.randint(0, 6)
        if kind == 0:
            return square(x, y, r.randint(2, 6))
        if kind == 1:
            return W(f"POLYGON (({x} {y}, {x + 5} {y + 1}, {x + 2} {y + 6}, {x} {y}))")
        return W(f"POLYGON (({x} {y}, {x + 8} {y}, {x + 8} {y + 8}, {x} {y + 8}, {x} {y}), ({x + 2} {y + 2}, {x + 2} {y + 5}, {x + 5} {y + 5}, {x + 5} {y + 2}, {x + 2} {y + 2}))")

    a, b = shape(), shape()
    in_a, in_b = P.Located(a), P.Located(b)
    areas = {}
    for name, keep in P.OVERLAYS.items():
        out = P.overlay(a, b, keep)
        inside = P.Located(out)
        areas[name] = P.area(out)
        for _ in range(150):
            p = Fraction(r.randint(-100, 1600), 101), Fraction(r.randint(-100, 1600), 103)
            if "B" in (in_a(p), in_b(p)) or inside(p) == "B":
                continue
            assert (inside(p) == "I") == keep(in_a(p) == "I", in_b(p) == "I"), (name, p)
    assert abs(areas["union"] + areas["intersection"] - P.area(a) - P.area(b)) < 1e-9
    assert abs(areas["symDifference"] + areas["intersection"] - areas["union"]) < 1e-9


def test_text_forms():
    for t in ("POINT (1 2)", "LINESTRING (0 0, 1 1.5)", SQ, "MULTIPOINT ((0 0), (1 1))", "MULTILINESTRING ((0 0, 1 1), (2 2, 3 3))", "MULTIPOLYGON (((0 0, 1 0, 0 1, 0 0)), ((5 5, 6 5, 5 6, 5 5)))", "GEOMETRYCOLLECTION (POINT (0 0), LINESTRING (0 0, 1 1))", "POINT Z (1 2 3)", "POINT M (1 2 3)", "POINT ZM (1 2 3 4)", "POLYGON EMPTY"):
        assert P.to_wkt(W(t), False) == t
    assert W("").empty and W("<urn:x> POINT (0 0)").crs == "urn:x" and W("POINT (0 0)").crs == P.CRS84
    assert json.loads(P.to_geojson(W(f"<{P.LAT_LON}> POINT (50 8)"))) == {"type": "Point", "coordinates": [8.0, 50.0]}
    assert P.to_gml(W("POINT (1 2)")).endswith(f'srsName="{P.CRS84}"><gml:pos>1 2</gml:pos></gml:Point>')
    assert P.to_kml(W("LINESTRING (0 0, 1 2)")) == "<LineString><coordinates>0,0 1,2</coordinates></LineString>"
    assert P.to_wkt(P.transform(W("POINT (8 50)"), P.LAT_LON)) == f"<{P.LAT_LON}> POINT (50 8)"
    for bad in ("CIRCLE (0 0)", "POINT (0 0) x", "123"):
        with pytest.raises(GeometryError):
            W(bad)


def test_measures_and_constructions():
    assert P.area(W(SQ)) == 100 and P.perimeter(W(SQ)) == 40 and P.length(W("LINESTRING (0 0, 3 4)")) == 5
    assert P.distance(W(SQ), W("POINT (13 14)")) == 5 and P.distance(W(SQ), W("POINT (5 5)")) == 0 and P.distance(W(SQ), W("POLYGON EMPTY")) is None
    assert P.to_wkt(P.centroid(W(SQ)), False) == "POINT (5 5)" and P.to_wkt(P.envelope(W("LINESTRING (0 0, 3 4)")), False) == "POLYGON ((0 0, 3 0, 3 4, 0 4, 0 0))"
    assert P.related("sfEquals", P.convex_hull(W("MULTIPOINT ((0 0), (10 0), (10 10), (0 10), (5 5), (5 0))")), W(SQ))
    x, y, radius = P.bounding_circle([(0, 0), (10, 0), (10, 10), (0, 10)])
    assert (x, y) == (5, 5) and abs(radius - 50**0.5) < 1e-12
    assert abs(P.area(P.buffer(W("POINT (0 0)"), 1, 64)) - 3.1366) < 0.001
    grown = P.area(P.buffer(W(SQ), 1, 32))
    assert 140 < grown < 100 + 40 + 3.15
    assert P.to_wkt(P.boundary(W("LINESTRING (0 0, 1 1)")), False) == "MULTIPOINT ((0 0), (1 1))" and P.boundary(W(SQ)).kind == "LINESTRING"
    assert P.simple(W("LINESTRING (0 0, 1 1, 2 0)")) and not P.simple(W("LINESTRING (0 0, 2 2, 2 0, 0 2)")) and not P.simple(W("MULTIPOINT ((0 0), (0 0))"))
    dug = P.concave_hull(W("MULTIPOINT ((0 0), (10 0), (10 10), (0 10), (5 3))"), 0.5)
    assert P.area(dug) < 100 and P.simple(dug)
    metre = P.length(P.metric(W("LINESTRING (0 60, 1 60)")))
    assert abs(metre - 55_660) < 1


def test_column_functions(spark):
    df = spark.createDataFrame([(SQ, "POINT (5 5)", 1), (None, "POINT (5 5)", 1), ("MULTIPOINT ((1 2), (3 4))", "POINT (3 4)", 2)], "a string, b string, n int")
    r = df.select(*[S.call(n, "a").alias(n) for n in ("area", "geometryType", "isEmpty", "dimension", "getSRID", "numGeometries", "maxX", "minZ", "boundingCircle")], S.call("sfContains", "a", "b").alias("c"), S.call("geometryN", "a", "n").alias("g"), S.relate("b", "a", "T*F**F***").alias("w")).collect()
    assert (r[0].area, r[0].dimension, r[0].c, r[0].w, r[0].maxX, r[0].minZ) == (100.0, 2, True, True, 10.0, None)
    assert r[1].area is None and r[1].c is None and r[2].numGeometries == 2 and r[2].g.endswith("POINT (3 4)")
    with pytest.raises(GeometryError):
        S.call("nope", "a")
    with pytest.raises(GeometryError):
        S.relate("a", "b", "XX")
    S.register(spark)
    df.createOrReplaceTempView("geometries")
    assert spark.sql("select geo_sfContains(a, b) c, geo_asGeoJSON(b) j from geometries").first().c


def test_every_function_runs(spark):
    df = spark.createDataFrame([("POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0))", "POLYGON ((2 2, 6 2, 6 6, 2 6, 2 2))")], "a string, b string")
    second = {"buffer": F.lit(1.0), "metricBuffer": F.lit(1000.0), "geometryN": F.lit(1), "transform": F.lit(P.LAT_LON)}
    row = df.select(*[S.call(n, *(["a", second.get(n, F.col("b"))] if k == 2 else ["a"])).alias(n) for n, (_, _, k) in S.FUNCTIONS.items()]).first()
    assert all(row[n] is not None for n in S.FUNCTIONS if n not in ("minZ", "maxZ"))
    assert P.area(W(row["intersection"])) == 4 and P.area(W(row["union"])) == 28


def test_aggregates(spark):
    rows = [("k", f"POINT ({x} {y})") for x in range(5) for y in range(5)] + [("m", "POLYGON ((0 0, 2 0, 2 2, 0 2, 0 0))"), ("m", "POLYGON ((1 0, 3 0, 3 2, 1 2, 1 0))"), ("m", None)]
    df = spark.createDataFrame(rows, "k string, w string").repartition(3)
    get = lambda f: {r.k: W(r.geometry) for r in f(df, ["k"], "w").collect()}
    assert P.area(get(S.agg_convex_hull)["k"]) == 16 and P.area(get(S.agg_bounding_box)["m"]) == 6
    assert P.area(get(S.agg_union)["m"]) == 6 and get(S.agg_centroid)["k"].coordinates == [(2.0, 2.0)] and get(S.agg_centroid)["m"].coordinates == [(1.5, 1.0)]
    assert get(S.agg_bounding_circle)["k"].kind == "POLYGON" and P.area(get(S.agg_concave_hull)["k"]) == 16


def test_features_and_geometries_mix(spark):
    geo = "http://www.opengis.net/ont/geosparql#"
    t = spark.createDataFrame(
        [("f", geo + "hasDefaultGeometry", "fg", None), ("f", geo + "hasGeometry", "other", None), ("fg", geo + "asWKT", SQ, None), ("other", geo + "asWKT", "POINT (99 99)", None), ("p", geo + "asWKT", "POINT (5 5)", None), ("q", geo + "hasGeometry", "p", None)],
        "s string, p string, o string, datatype string",
    )
    pairs = spark.createDataFrame([("p", "f"), ("q", "f"), ("p", "fg"), ("q", "fg"), ("other", "f")], "a string, b string")
    got = {(r.a, r.b): r.holds for r in S.related_nodes(t, "sfWithin", pairs).collect()}
    assert got == {("p", "f"): True, ("q", "f"): True, ("p", "fg"): True, ("q", "fg"): True, ("other", "f"): False}
