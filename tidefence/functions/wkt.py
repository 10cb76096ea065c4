"""WKT literals of points and polygons in SQL: parsing and the Simple Features relations on them."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from . import geometry as G

CRS84 = "http://www.opengis.net/def/crs/OGC/1.3/CRS84"
#: An IRI before the geometry, its name, words and brackets (a letter after a digit is an exponent), the first coordinates, and what is in innermost brackets.
_IRI, _IRI_NAME, _WORDS = r"^\s*<[^>]*>", r"^\s*<([^>]*)>", r"(?i)(?<![\d.])[a-z]+|[()]+"
_FIRST, _RING = r"^\s*(?:<[^>]*>)?[\sa-zA-Z(]*([^,()]*)", r"\(([^()]*)\)"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def crs_of(wkt: str | Column) -> Column:
    """The IRI before the geometry; CRS84 without one."""
    found = F.regexp_extract(_col(wkt), _IRI_NAME, 1)
    return F.when(found == "", CRS84).otherwise(found)


def coordinates(wkt: str | Column) -> Column:
    """All coordinate pairs, in order."""
    body = F.regexp_replace(_col(wkt), _IRI, "")
    pairs = F.split(F.regexp_replace(body, _WORDS, " "), ",")
    numbers = F.transform(pairs, lambda p: F.split(F.trim(p), r"\s+"))
    return F.transform(numbers, lambda n: F.struct(F.get(n, F.lit(0)).cast("double").alias("x"), F.get(n, F.lit(1)).cast("double").alias("y")))


def first_point(wkt: str | Column) -> Column:
    """The first coordinate pair."""
    numbers = F.split(F.regexp_extract(_col(wkt), _FIRST, 1), r"\s+")
    return G._let(numbers, lambda n: F.struct(F.get(n, F.lit(0)).cast("double").alias("x"), F.get(n, F.lit(1)).cast("double").alias("y")))


def edges_of(wkt: str | Column) -> Column:
    """Edges of all rings or lines; none between one ring and the next."""

    def of_ring(shell: Column) -> Column:
        corner = lambda i, k: F.get(shell, i + k)
        edge = lambda i: F.struct(corner(i, 0)["x"].alias("x1"), corner(i, 0)["y"].alias("y1"), corner(i, 1)["x"].alias("x2"), corner(i, 1)["y"].alias("y2"))
        return F.when(F.size(shell) < 2, F.array().cast(G.EDGE_TYPE)).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(F.size(shell) - 2, F.lit(0))), edge))

    rings = F.regexp_extract_all(F.regexp_replace(_col(wkt), _IRI, ""), F.lit(_RING), F.lit(1))
    return F.flatten(F.transform(F.transform(rings, coordinates), of_ring))


def _relation(a: str | Column, b: str | Column, test) -> Column:
    same = crs_of(a) == crs_of(b)
    held = G._let(F.struct(first_point(a).alias("p"), edges_of(b).alias("e")), lambda t: test(t["p"]["x"], t["p"]["y"], t["e"]))
    return F.when(same, held).otherwise(F.raise_error(F.lit("geometries in different reference systems")).cast("boolean"))


def sf_within(point: str | Column, polygon: str | Column) -> Column:
    return _relation(point, polygon, G.within)


def sf_intersects(point: str | Column, polygon: str | Column) -> Column:
    return _relation(point, polygon, G.covered_by)


def sf_touches(point: str | Column, polygon: str | Column) -> Column:
    return _relation(point, polygon, G.on_boundary)


def sf_disjoint(point: str | Column, polygon: str | Column) -> Column:
    return ~sf_intersects(point, polygon)


def register(spark: SparkSession) -> None:
    """SQL functions sf_within, sf_intersects, sf_touches and sf_disjoint over WKT texts, and covered_by over edges.

    They are SQL functions, so Catalyst inlines them.
    """
    sql = lambda pattern: "'" + pattern.replace("\\", "\\\\") + "'"
    edges = "transform(sequence(0, size(c) - 2), i -> named_struct('x1', c[i].x, 'y1', c[i].y, 'x2', c[i + 1].x, 'y2', c[i + 1].y))"
    xy = "named_struct('x', cast(n[0] as double), 'y', cast(n[1] as double))"
    corners = lambda text: f"transform(transform(split({text}, ','), p -> split(trim(p), '\\\\s+')), n -> {xy})"
    body = f"regexp_replace({{0}}, {sql(_IRI)}, '')"
    rings = f"regexp_extract_all({body}, {sql(_RING)}, 1)"
    point = f"transform(array(split(regexp_extract({{0}}, {sql(_FIRST)}, 1), '\\\\s+')), n -> {xy})[0]"
    crs = f"coalesce(if(regexp_extract({{0}}, {sql(_IRI_NAME)}, 1) = '', '{CRS84}', regexp_extract({{0}}, {sql(_IRI_NAME)}, 1)), '{CRS84}')"
    # SQL functions take no lambda's variable, so texts of expressions stand here more than once
    of_rings = f"flatten(transform(transform({rings}, r -> {corners('r')}), c -> if(size(c) < 2, cast(array() as {G.EDGE_TYPE}), {edges})))"
    words = f"regexp_replace({body.format('w')}, {sql(_WORDS)}, ' ')"
    spark.sql(f"create or replace temporary function wkt_corners(w string) returns array<struct<x:double,y:double>> return {corners(words)}")
    spark.sql(f"create or replace temporary function corner_edges(c array<struct<x:double,y:double>>) returns {G.EDGE_TYPE} return {edges}")
    spark.sql(f"create or replace temporary function wkt_edges(w string) returns {G.EDGE_TYPE} return {of_rings.format('w')}")
    spark.sql(f"create or replace temporary function wkt_crs(w string) returns string return {crs.format('w')}")

    def tests(px: str, py: str, es: str) -> tuple[str, str]:
        box = f"{px} >= least(e.x1, e.x2) and {px} <= greatest(e.x1, e.x2) and {py} >= least(e.y1, e.y2) and {py} <= greatest(e.y1, e.y2)"
        left, right = f"(e.x2 - e.x1) * ({py} - e.y1)", f"(e.y2 - e.y1) * ({px} - e.x1)"
        clear = f"abs({left} - {right}) > (abs({left}) + abs({right})) * {G.DOUBT!r}"
        # decimals of 38 digits hold every sum and product of ordinates of up to 9 whole and 9 decimal places; others go by the sign of the doubles
        exact = lambda v: f"cast({v} as decimal(18,9))"
        whole = " and ".join(f"try_cast({v} as decimal(18,9)) = {v}" for v in (px, py, "e.x1", "e.y1", "e.x2", "e.y2"))
        product = lambda a, b, c, d: f"({exact(a)} - {exact(b)}) * ({exact(c)} - {exact(d)})"
        equal = f"{product('e.x2', 'e.x1', py, 'e.y1')} = {product('e.y2', 'e.y1', px, 'e.x1')}"
        on = f"exists({es}, e -> {box} and (e.x1 = e.x2 or e.y1 = e.y2 or (case when {clear} then false when {whole} then {equal} else {left} = {right} end)))"
        odd = f"aggregate({es}, false, (a, e) -> a != ((e.y1 > {py}) != (e.y2 > {py}) and {px} < coalesce(try_divide((e.x2 - e.x1) * ({py} - e.y1), e.y2 - e.y1), 0) + e.x1))"
        return on, odd

    on, odd = tests("px", "py", "es")
    arguments = f"px double, py double, es {G.EDGE_TYPE}"
    spark.sql(f"create or replace temporary function on_edges({arguments}) returns boolean return {on}")
    spark.sql(f"create or replace temporary function covered_by({arguments}) returns boolean return ({on}) or ({odd})")
    spark.sql(f"create or replace temporary function strictly_within({arguments}) returns boolean return not ({on}) and ({odd})")
    # one expression of the two texts in all of them, so that Spark evaluates it once for all relations of a pair
    on, odd = tests("t.p.x", "t.p.y", "t.e")
    parsed = f"array(named_struct('p', {point.format('a')}, 'e', {of_rings.format('b')}))"
    wrong = "raise_error('geometries in different reference systems')"
    same = f"regexp_extract(a, {sql(_IRI_NAME)}, 1) = regexp_extract(b, {sql(_IRI_NAME)}, 1) or {crs.format('a')} = {crs.format('b')}"
    pair = f"case when {same} then transform({parsed}, t -> named_struct('edge', {on}, 'odd', {odd}))[0] else {wrong} end"
    for name, test in (("sf_within", "not {0}.edge and {0}.odd"), ("sf_intersects", "{0}.edge or {0}.odd"), ("sf_touches", "{0}.edge"), ("sf_disjoint", "not ({0}.edge or {0}.odd)")):
        spark.sql(f"create or replace temporary function {name}(a string, b string) returns boolean return {test.format(f'({pair})')}")
