"""General geometry functions over WKT literal columns.

Points against polygons have JVM expressions (``functions.wkt``); everything else here runs in Arrow batches on the exact
planar library. Nulls give nulls. Aggregates reduce each task's rows first, so no group is gathered whole
except for the concave hull, whose result depends on all points.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import GeometryError
from . import planar as P

@lru_cache(maxsize=4096)
def parse(text: str) -> P.Geometry:
    return P.from_wkt(text)


def _udf(kind: str, f: Callable, n: int = 1):
    if n == 1:

        @F.pandas_udf(kind)
        def one(a: pd.Series) -> pd.Series:
            return pd.Series([None if x is None else f(x) for x in a], dtype=object)

        return one

    @F.pandas_udf(kind)
    def two(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None or y != y else f(x, y) for x, y in zip(a, b, strict=True)], dtype=object)

    return two


def _ordinate(i: int, pick: Callable, wants: Callable[[P.Geometry], bool] = lambda g: True) -> Callable[[str], float | None]:
    def value(text: str) -> float | None:
        g = parse(text)
        found = [c[i] for c in g.coordinates if len(c) > i] if wants(g) else []
        return float(pick(found)) if found else None

    return value


def _nth(text: str, n: int) -> str | None:
    g = parse(text)
    if g.kind == "GEOMETRYCOLLECTION":
        members = list(g.members)
    else:
        members = [P.Geometry(g.base, (part,), g.crs, g.z, g.m) for part in g.parts]
    return P.to_wkt(members[int(n) - 1]) if 1 <= n <= len(members) else None


def _circle(text: str) -> str:
    g = parse(text)
    return P.to_wkt(P.disc(*P.bounding_circle([c[:2] for c in g.coordinates]), g.crs)) if not g.empty else P.to_wkt(P.Geometry("POLYGON", (), g.crs))


def _metric_distance(a: str, b: str) -> float | None:
    x, y = parse(a), parse(b)
    if x.empty or y.empty:
        return None
    both = P.Geometry("GEOMETRYCOLLECTION", (), x.crs, members=(x, y))
    kx, ky = P._scale(both)
    scaled = [P.Geometry(g.kind, tuple(tuple(tuple((c[0] * kx, c[1] * ky) for c in r) for r in p) for p in g.parts), g.crs, members=g.members) for g in map(P.lon_lat, (x, y))]
    return P.distance(*scaled)


def _metric_buffer(text: str, radius: float) -> str:
    g = P.lon_lat(parse(text))
    kx, ky = P._scale(g)
    grown = P.buffer(P.metric(g), radius)
    back = P.Geometry(grown.kind, tuple(tuple(tuple((c[0] / kx, c[1] / ky) for c in r) for r in p) for p in grown.parts), g.crs)
    return P.to_wkt(back)


#: name -> (result type, function of WKT texts, number of arguments)
FUNCTIONS: dict[str, tuple[str, Callable, int]] = {
    "boundary": ("string", lambda a: P.to_wkt(P.boundary(parse(a))), 1),
    "boundingCircle": ("string", _circle, 1),
    "buffer": ("string", lambda a, r: P.to_wkt(P.buffer(parse(a), float(r))), 2),
    "metricBuffer": ("string", lambda a, r: _metric_buffer(a, float(r)), 2),
    "centroid": ("string", lambda a: P.to_wkt(P.centroid(parse(a))), 1),
    "convexHull": ("string", lambda a: P.to_wkt(P.convex_hull(parse(a))), 1),
    "concaveHull": ("string", lambda a: P.to_wkt(P.concave_hull(parse(a))), 1),
    "envelope": ("string", lambda a: P.to_wkt(P.envelope(parse(a))), 1),
    "coordinateDimension": ("int", lambda a: 2 + parse(a).z + parse(a).m, 1),
    "spatialDimension": ("int", lambda a: 2 + parse(a).z, 1),
    "dimension": ("int", lambda a: parse(a).dimension, 1),
    "geometryType": ("string", lambda a: "http://www.opengis.net/ont/sf#" + P.JSON_NAMES[parse(a).kind], 1),
    "is3D": ("boolean", lambda a: parse(a).z, 1),
    "isMeasured": ("boolean", lambda a: parse(a).m, 1),
    "isEmpty": ("boolean", lambda a: parse(a).empty, 1),
    "isSimple": ("boolean", lambda a: P.simple(parse(a)), 1),
    "getSRID": ("string", lambda a: parse(a).crs, 1),
    "numGeometries": ("int", lambda a: len(parse(a).members) or len(parse(a).parts), 1),
    "geometryN": ("string", _nth, 2),
    "minX": ("double", _ordinate(0, min), 1),
    "maxX": ("double", _ordinate(0, max), 1),
    "minY": ("double", _ordinate(1, min), 1),
    "maxY": ("double", _ordinate(1, max), 1),
    "minZ": ("double", _ordinate(2, min, lambda g: g.z), 1),
    "maxZ": ("double", _ordinate(2, max, lambda g: g.z), 1),
    "length": ("double", lambda a: P.length(parse(a)), 1),
    "perimeter": ("double", lambda a: P.perimeter(parse(a)), 1),
    "area": ("double", lambda a: P.area(parse(a)), 1),
    "metricLength": ("double", lambda a: P.length(P.metric(parse(a))), 1),
    "metricPerimeter": ("double", lambda a: P.perimeter(P.metric(parse(a))), 1),
    "metricArea": ("double", lambda a: P.area(P.metric(parse(a))), 1),
    "distance": ("double", lambda a, b: P.distance(parse(a), parse(b)), 2),
    "metricDistance": ("double", _metric_distance, 2),
    "relateMatrix": ("string", lambda a, b: P.matrix(parse(a), parse(b)), 2),
    "transform": ("string", lambda a, crs: P.to_wkt(P.transform(parse(a), crs)), 2),
    "asWKT": ("string", lambda a: P.to_wkt(parse(a)), 1),
    "asGML": ("string", lambda a: P.to_gml(parse(a)), 1),
    "asGeoJSON": ("string", lambda a: P.to_geojson(parse(a)), 1),
    "asKML": ("string", lambda a: P.to_kml(parse(a)), 1),
}
for _name, _op in P.OVERLAYS.items():
    FUNCTIONS[_name] = ("string", lambda a, b, op=_op: P.to_wkt(P.overlay(parse(a), parse(b), op)), 2)
for _name in P.NAMES:
    FUNCTIONS[_name] = ("boolean", lambda a, b, name=_name: P.related(name, parse(a), parse(b)), 2)


def call(name: str, *columns: str | Column) -> Column:
    """A function by its standard name."""
    if name not in FUNCTIONS:
        raise GeometryError(f"unknown geometry function {name!r}")
    kind, f, n = FUNCTIONS[name]
    if len(columns) != n:
        raise GeometryError(f"{name} takes {n} arguments")
    return _udf(kind, f, n)(*columns)


def relate(a: str | Column, b: str | Column, pattern: str) -> Column:
    """Whether the nine dimensions fit a pattern of T, F, *, 0, 1 and 2."""
    if len(pattern) != 9 or set(pattern.upper()) - set("TF*012"):
        raise GeometryError(f"not a pattern: {pattern!r}")
    return _udf("boolean", lambda x, y: P.relates(P.matrix(parse(x), parse(y)), pattern), 2)(a, b)


def register(spark: SparkSession, prefix: str = "geo_") -> None:
    """All functions for SQL, as prefix + name."""
    for name, (kind, f, n) in FUNCTIONS.items():
        spark.udf.register(prefix + name, _udf(kind, f, n))


# -- aggregates -----------------------------------------------------------------------------------------


def _reduce(df: DataFrame, keys: list[str], wkt: str, step: Callable[[list[P.Geometry]], P.Geometry], last: Callable[[P.Geometry], P.Geometry] = lambda g: g) -> DataFrame:
    """step over each task's rows of a key, then over the tasks' results."""
    schema = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys) + ", geometry string"
    rows = df.select(*keys, F.col(wkt).alias("geometry")).filter("geometry is not null")

    def partial(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, P.Geometry] = {}
        for batch in it:
            for key, part in batch.groupby(keys, dropna=False) if keys else [((), batch)]:
                made = [held[key]] if key in held else []
                held[key] = step(made + [parse(t) for t in part["geometry"]])
        if held:
            yield pd.DataFrame([(*k, P.to_wkt(g)) for k, g in held.items()], columns=[*keys, "geometry"])

    def final(part: pd.DataFrame) -> pd.DataFrame:
        g = last(step([parse(t) for t in part["geometry"]]))
        return part.iloc[:1][keys].assign(geometry=P.to_wkt(g))

    return rows.mapInPandas(partial, schema).groupBy(*keys).applyInPandas(final, schema)


def _collected(gs: list[P.Geometry]) -> P.Geometry:
    return P.Geometry("GEOMETRYCOLLECTION", (), gs[0].crs, members=tuple(gs))


def _union(gs: list[P.Geometry]) -> P.Geometry:
    out = gs[0]
    for g in gs[1:]:
        out = P.overlay(out, g, P.OVERLAYS["union"])
    return out


def agg_bounding_box(df: DataFrame, keys: list[str], wkt: str) -> DataFrame:
    return _reduce(df, keys, wkt, lambda gs: P.envelope(_collected(gs)))


def agg_convex_hull(df: DataFrame, keys: list[str], wkt: str) -> DataFrame:
    return _reduce(df, keys, wkt, lambda gs: P.convex_hull(_collected(gs)))


def agg_bounding_circle(df: DataFrame, keys: list[str], wkt: str) -> DataFrame:
    circle = lambda g: P.disc(*P.bounding_circle([c[:2] for c in g.coordinates]), g.crs)
    return _reduce(df, keys, wkt, lambda gs: P.convex_hull(_collected(gs)), circle)


def agg_union(df: DataFrame, keys: list[str], wkt: str) -> DataFrame:
    return _reduce(df, keys, wkt, _union)


def agg_concave_hull(df: DataFrame, keys: list[str], wkt: str, share: float = 0.5) -> DataFrame:
    points = lambda gs: P.Geometry("MULTIPOINT", tuple(((c,),) for c in sorted({c[:2] for g in gs for c in g.coordinates})), gs[0].crs)
    return _reduce(df, keys, wkt, points, lambda g: P.concave_hull(g, share))


def agg_centroid(df: DataFrame, keys: list[str], wkt: str) -> DataFrame:
    """Of the highest dimension in a group, by sums of weights."""

    @F.pandas_udf("dim int, w double, wx double, wy double, crs string")
    def weights(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            g = None if t is None else parse(t)
            if g is None or g.empty:
                rows.append((-1, 0.0, 0.0, 0.0, None))
                continue
            x, y = P.centroid(g).coordinates[0]
            w = (float(len(g.points())), P.length(g), P.area(g))[g.dimension]
            rows.append((g.dimension, w, w * x, w * y, g.crs))
        return pd.DataFrame(rows, columns=["dim", "w", "wx", "wy", "crs"])

    s = df.select(*keys, weights(wkt).alias("s")).select(*keys, "s.*").filter("dim >= 0")
    per = s.groupBy(*keys, "dim").agg(*[F.sum(c).alias(c) for c in ("w", "wx", "wy")], F.first("crs").alias("crs"))
    top = per.groupBy(*keys).agg(F.max_by(F.struct("w", "wx", "wy", "crs"), "dim").alias("t"))
    from .text import point_wkt

    return top.select(*keys, point_wkt(F.col("t.wx") / F.col("t.w"), F.col("t.wy") / F.col("t.w"), F.col("t.crs")).alias("geometry"))


# -- features in graphs -----------------------------------------------------------------------------------


def resolve(triples: DataFrame) -> DataFrame:
    """(node, wkt): a geometry's own literal, or a feature's through its default geometry, else through any geometry."""
    geo = "http://www.opengis.net/ont/geosparql#"
    literal = triples.filter(F.col("p") == geo + "asWKT").select(F.col("s").alias("node"), F.col("o").alias("wkt"))
    link = triples.filter(F.col("p").isin(geo + "hasDefaultGeometry", geo + "hasGeometry")).select("s", "o", (F.col("p") == geo + "hasGeometry").alias("any"))
    best = link.groupBy("s").agg(F.min_by("o", F.struct("any", "o")).alias("node"))
    through = best.join(literal, "node").select(F.col("s").alias("node"), "wkt")
    return literal.unionByName(through)


def related_nodes(triples: DataFrame, relation: str, pairs: DataFrame) -> DataFrame:
    """pairs(a, b) of features or geometries in any mix, with whether the relation holds between them."""
    known = resolve(triples)
    left, right = known.select(F.col("node").alias("a"), F.col("wkt").alias("wkt_a")), known.select(F.col("node").alias("b"), F.col("wkt").alias("wkt_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", call(relation, "wkt_a", "wkt_b").alias("holds"))
