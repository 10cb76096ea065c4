import json
from urllib.parse import quote

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidefence.functions import geometry as G
from tidefence.functions import planar as P
from tidefence.functions import text as T
from tidefence.operators.regions import side

few = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
finite = st.floats(-1e6, 1e6, allow_nan=False, width=64)
ordinate = finite.map(lambda v: v if abs(v) > 1e-6 else 0.0)  # products of smaller ones may underflow


TIES = [2.5, 0.5, 1.005, 0.001953125, -10.939453125, -108.0578087362285, 999999.5, 5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, 0.1, 1e22, 1e23, -0.0, 0.0, float("inf"), -float("inf"), float("nan")]


@few
@given(st.lists(st.one_of(finite, st.floats(width=64), st.integers(-(10**6), 10**6).map(lambda n: n / 1024)), min_size=20, max_size=60))
def test_numbers_print_as_in_c(spark, values):
    values = values + TIES
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    for digits in (1, 6, 10, 15, 17):
        assert [r[0] for r in df.select(T.short_number(F.col("v"), digits)).collect()] == [f"{v:.{digits}g}" for v in values] + [None]
    # in the JVM alone, for sizes of coordinates
    plain = [v for v in values if v == 0 or 1e-7 <= abs(v) < 1e9] + [round(v, 13) for v in values if 1 <= abs(v) < 1000]
    df = spark.createDataFrame([(v,) for v in plain], "v double")
    for digits in (6, 10, 15):
        assert [r[0] for r in df.select(T.short_number(F.col("v"), digits, arrow=False)).collect()] == [f"{v:.{digits}g}" for v in plain]


@few
@given(st.lists(st.text(st.characters(blacklist_categories=["Cs"], blacklist_characters="\x7f  "), max_size=12), min_size=10, max_size=40))
def test_texts_are_encoded_as_in_python(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "s string")
    got = df.select(T.iri_part(F.col("s")), T.json_string(F.col("s"))).collect()
    assert [tuple(r) for r in got] == [(quote(v, safe=""), json.dumps(v, ensure_ascii=False)) for v in values]


@few
@given(st.lists(st.tuples(ordinate, ordinate, ordinate, ordinate, st.integers(-8, 8), st.integers(1, 8)), min_size=20, max_size=60))
def test_orientation_is_exact(spark, rows):
    data = [(i, ax, ay, bx, by, ax + (bx - ax) * k / n, ay + (by - ay) * k / n) for i, (ax, ay, bx, by, k, n) in enumerate(rows)]
    df = spark.createDataFrame(data, "i int, ax double, ay double, bx double, by double, px double, py double")
    got = df.select(G.orientation(*map(F.col, ("ax", "ay", "bx", "by", "px", "py")))).collect()
    assert [r[0] for r in got] == [side((d[1], d[2]), (d[3], d[4]), (d[5], d[6])) for d in data]


corner = st.tuples(st.integers(0, 8), st.integers(0, 8))


@settings(max_examples=60, deadline=None)
@given(corner, st.integers(1, 5), corner, st.integers(1, 5))
def test_relations_are_symmetric_and_exclusive(a, n, b, m):
    square = lambda p, s: P.from_wkt(f"POLYGON (({p[0]} {p[1]}, {p[0] + s} {p[1]}, {p[0] + s} {p[1] + s}, {p[0]} {p[1] + s}, {p[0]} {p[1]}))")
    x, y = square(a, n), square(b, m)
    rcc = [r for r in P.NAMES if r.startswith("rcc8") and P.related(r, x, y)]
    assert len(rcc) == 1
    assert P.related("sfWithin", x, y) == P.related("sfContains", y, x)
    assert P.related("sfIntersects", x, y) != P.related("sfDisjoint", x, y)
    assert P.area(P.overlay(x, y, P.OVERLAYS["union"])) + P.area(P.overlay(x, y, P.OVERLAYS["intersection"])) == P.area(x) + P.area(y)
