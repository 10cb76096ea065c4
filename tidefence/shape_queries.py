"""Registered queries of relations between shapes, in tables and in SQL functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import wkt as W
from .operators import relate as R
from .queries import CRS, _MOVES, moves, query

#: Shapes that the events' shapes are related to: slanted edges, holes, a line, points, and nothing. Coordinates are hundredths and whole numbers.
FIXED = {
    1: "POLYGON ((0 0, 9000 0, 9000 60, 0 60, 0 0))",
    2: "POLYGON ((0 0, 20000 0, 20000 100, 0 100, 0 0), (3000 20, 12000 20, 12000 80, 3000 80, 3000 20))",
    3: "POLYGON ((3000 20, 12000 20, 12000 80, 3000 80, 3000 20))",
    4: "POLYGON ((0 50, 5000 0, 10000 50, 5000 100, 0 50))",
    5: "POLYGON ((0 0, 40000 80, 0 80, 0 0))",
    6: "LINESTRING (0 0, 20000 100)",
    7: "LINESTRING (0 60, 9000 60, 9000 0)",
    8: "MULTIPOINT ((3000 20), (5000 50), (1000 2))",
    9: "POLYGON EMPTY",
}


def _text(*corners: tuple[Column, Column]) -> Column:
    number = lambda v: v.cast("string")
    return F.concat_ws(", ", *[F.concat_ws(" ", number(x), number(y)) for x, y in corners])


def event_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shape for each event, of seven kinds in turn: triangle, square on a corner, frame, line, bent line, point, nothing; at x = value in hundredths, y = k."""
    m = moves(spark, sf_dir).filter("x IS NOT NULL AND y IS NOT NULL")
    x, y = F.bround(F.col("x") * 100).cast("long"), F.col("y").cast("long")
    at = lambda dx, dy: (x + dx, y + dy)
    ring = lambda *c: F.concat(F.lit("("), _text(*c, c[0]), F.lit(")"))
    polygon = lambda *rings: F.concat(F.lit("POLYGON ("), F.concat_ws(", ", *rings), F.lit(")"))
    line = lambda *c: F.concat(F.lit("LINESTRING ("), _text(*c), F.lit(")"))
    kind = F.col("seq") % 7
    wkt = (
        F.when(kind == 0, polygon(ring(at(0, 0), at(1000, 10), at(200, 30))))
        .when(kind == 1, polygon(ring(at(0, -10), at(500, 0), at(0, 10), at(-500, 0))))
        .when(kind == 2, polygon(ring(at(0, 0), at(900, 0), at(900, 30), at(0, 30)), ring(at(300, 10), at(300, 20), at(600, 20), at(600, 10))))
        .when(kind == 3, line(at(0, 0), at(2000, 10)))
        .when(kind == 4, line(at(0, 0), at(0, 20), at(1000, 20)))
        .when(kind == 5, F.concat(F.lit("POINT ("), _text(at(0, 0)), F.lit(")")))
        .otherwise("LINESTRING EMPTY")
    )
    return m.select(F.col("seq").alias("id"), wkt.alias("wkt"))


def fixed_shapes(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.explode(F.create_map(*[F.lit(v) for kv in FIXED.items() for v in kv])).alias("id", "wkt"))


def _fixed_rings() -> list[tuple[int, int, int, list[tuple[int, int]]]]:
    """(id, dimension, ring, corners), rings turned with the interior on the left."""
    out = []
    for i, text in FIXED.items():
        dim = 2 if "POLYGON" in text else 1 if "LINE" in text else 0
        parts = [] if "EMPTY" in text else text[text.index("(") :].replace("(", "").split(")")
        rings = [[tuple(map(int, p.split())) for p in part.strip(", ").split(",")] for part in parts if part.strip(", ")]
        for k, ring in enumerate([[c] for r in rings for c in r] if dim == 0 else rings):
            area = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:], strict=False))
            out.append((i, dim, k, ring[::-1] if dim == 2 and (area > 0) != (k == 0) else ring))
    return out


_KINDS = [
    (0, 2, [[(0, 0), (1000, 10), (200, 30), (0, 0)]]),
    (1, 2, [[(0, -10), (500, 0), (0, 10), (-500, 0), (0, -10)]]),
    (2, 2, [[(0, 0), (900, 0), (900, 30), (0, 30), (0, 0)], [(300, 10), (300, 20), (600, 20), (600, 10), (300, 10)]]),
    (3, 1, [[(0, 0), (2000, 10)]]),
    (4, 1, [[(0, 0), (0, 20), (1000, 20)]]),
    (5, 0, [[(0, 0)]]),
]
_A_EDGES = ", ".join(f"({k}, {r}, {n}, {p[0]}, {p[1]}, {q[0]}, {q[1]})" for k, d, rings in _KINDS if d for r, ring in enumerate(rings) for n, (p, q) in enumerate(zip(ring, ring[1:], strict=False)))
_B_EDGES = ", ".join(f"({i}, {k}, {n}, {p[0]}, {p[1]}, {q[0]}, {q[1]})" for i, d, k, ring in _fixed_rings() if d for n, (p, q) in enumerate(zip(ring, ring[1:], strict=False)))
_B_DOTS = ", ".join([*(f"({i}, {c[0]}, {c[1]})" for i, d, _, ring in _fixed_rings() if d == 0 for c in ring), *(f"({i}, {c[0]}, {c[1]})" for i, d, _, ring in _fixed_rings() if d == 1 for c in (ring[0], ring[-1]))])
_TURN = "(({c}.x2 - {c}.x1) * ({p}y - {c}.y1) - ({c}.y2 - {c}.y1) * ({p}x - {c}.x1))"


def _role(own: str, dots: str, ids: str) -> str:
    """Boundary or interior: of an area or a line's end, or else."""
    return f"CASE WHEN {own}.dim = 2 OR EXISTS (SELECT 1 FROM {dots} z WHERE z.id = {ids} AND z.x = p.x AND z.y = p.y) THEN 'B' ELSE 'I' END"


def _located(side: str, edges: str) -> str:
    """Points p(a, b, x, y in doubled coordinates) of one side against the edges of the other: on an edge, and how often a ray to the right passes one."""
    return f"""SELECT p.*, coalesce(bool_or({_TURN.format(c='e', p='p.')} = 0 AND p.x BETWEEN least(e.x1, e.x2) AND greatest(e.x1, e.x2) AND p.y BETWEEN least(e.y1, e.y2) AND greatest(e.y1, e.y2)), FALSE) AS on_edge,
coalesce(sum(CASE WHEN (e.y1 > p.y) <> (e.y2 > p.y) AND ({_TURN.format(c='e', p='p.')} > 0) = (e.y2 > e.y1) AND {_TURN.format(c='e', p='p.')} <> 0 THEN 1 ELSE 0 END), 0) % 2 = 1 AS odd
FROM p{side} p LEFT JOIN {edges} e ON e.id = p.{'b' if side == 'a' else 'a'} GROUP BY ALL"""


# Every edge of a shape against every edge of a fixed one, in whole numbers (coordinates doubled, so that middles are whole).
_SHAPES = f"""WITH {_MOVES},
kinds(kind, ring, n, x1, y1, x2, y2) AS (VALUES {_A_EDGES}),
placed AS (SELECT seq AS id, seq % 7 AS kind, CAST(round_even(x * 100, 0) AS HUGEINT) AS x, CAST(y AS HUGEINT) AS y FROM moves),
shapes AS (SELECT *, CASE WHEN kind < 3 THEN 2 WHEN kind < 5 THEN 1 WHEN kind = 5 THEN 0 ELSE -1 END AS dim FROM placed),
ea AS (SELECT id, ring, n, 2 * (x + x1) AS x1, 2 * (y + y1) AS y1, 2 * (x + x2) AS x2, 2 * (y + y2) AS y2 FROM placed JOIN kinds USING (kind)),
fixed(id, dim) AS (VALUES {', '.join(f"({i}, {-1 if 'EMPTY' in t else 2 if 'POLYGON' in t else 1 if 'LINE' in t else 0})" for i, t in FIXED.items())}),
eb AS (SELECT id, ring, n, CAST(2 * x1 AS HUGEINT) AS x1, CAST(2 * y1 AS HUGEINT) AS y1, CAST(2 * x2 AS HUGEINT) AS x2, CAST(2 * y2 AS HUGEINT) AS y2 FROM (VALUES {_B_EDGES}) v(id, ring, n, x1, y1, x2, y2)),
da AS (SELECT id, 2 * (x + dx) AS x, 2 * (y + dy) AS y FROM placed JOIN (VALUES (3, 0, 0), (3, 2000, 10), (4, 0, 0), (4, 1000, 20), (5, 0, 0)) v(kind, dx, dy) USING (kind)),
db AS (SELECT id, CAST(2 * x AS HUGEINT) AS x, CAST(2 * y AS HUGEINT) AS y FROM (VALUES {_B_DOTS}) v(id, x, y)),
pairs AS (SELECT a.id AS a, a.dim AS adim, b.id AS b, b.dim AS bdim FROM shapes a, fixed b),
signs AS (
  SELECT a.id AS a, b.id AS b, a.ring AS ar, a.n AS an, b.ring AS br, b.n AS bn, a.x1, a.y1, a.x2, a.y2, b.x1 AS u1, b.y1 AS v1, b.x2 AS u2, b.y2 AS v2,
    sign((a.x2 - a.x1) * (b.y1 - a.y1) - (a.y2 - a.y1) * (b.x1 - a.x1)) AS s1, sign((a.x2 - a.x1) * (b.y2 - a.y1) - (a.y2 - a.y1) * (b.x2 - a.x1)) AS s2,
    sign((b.x2 - b.x1) * (a.y1 - b.y1) - (b.y2 - b.y1) * (a.x1 - b.x1)) AS s3, sign((b.x2 - b.x1) * (a.y2 - b.y1) - (b.y2 - b.y1) * (a.x2 - b.x1)) AS s4
  FROM ea a JOIN eb b ON least(a.x1, a.x2) <= greatest(b.x1, b.x2) AND least(b.x1, b.x2) <= greatest(a.x1, a.x2) AND least(a.y1, a.y2) <= greatest(b.y1, b.y2) AND least(b.y1, b.y2) <= greatest(a.y1, a.y2)
),
crossing AS (SELECT DISTINCT a, b FROM signs WHERE s1 * s2 < 0 AND s3 * s4 < 0),
corners AS (
  SELECT a, b, ar, an, br, bn, u1 AS x, v1 AS y FROM signs WHERE s1 = 0 AND u1 BETWEEN least(x1, x2) AND greatest(x1, x2) AND v1 BETWEEN least(y1, y2) AND greatest(y1, y2)
  UNION SELECT a, b, ar, an, br, bn, u2, v2 FROM signs WHERE s2 = 0 AND u2 BETWEEN least(x1, x2) AND greatest(x1, x2) AND v2 BETWEEN least(y1, y2) AND greatest(y1, y2)
  UNION SELECT a, b, ar, an, br, bn, x1, y1 FROM signs WHERE s3 = 0 AND x1 BETWEEN least(u1, u2) AND greatest(u1, u2) AND y1 BETWEEN least(v1, v2) AND greatest(v1, v2)
  UNION SELECT a, b, ar, an, br, bn, x2, y2 FROM signs WHERE s4 = 0 AND x2 BETWEEN least(u1, u2) AND greatest(u1, u2) AND y2 BETWEEN least(v1, v2) AND greatest(v1, v2)
),
lapped AS (
  SELECT s.a, s.b, sign(s.x2 - s.x1) = sign(s.u2 - s.u1) AND sign(s.y2 - s.y1) = sign(s.v2 - s.v1) AS same
  FROM signs s JOIN corners c USING (a, b, ar, an, br, bn) WHERE s1 = 0 AND s2 = 0 GROUP BY ALL HAVING count(*) > 1
),
ca AS (SELECT a, b, ar AS r, an AS n, x, y FROM corners UNION SELECT p.a, p.b, e.ring, e.n, unnest([e.x1, e.x2]), unnest([e.y1, e.y2]) FROM pairs p JOIN ea e ON e.id = p.a WHERE p.bdim > 0),
cb AS (SELECT a, b, br AS r, bn AS n, x, y FROM corners UNION SELECT p.a, p.b, e.ring, e.n, unnest([e.x1, e.x2]), unnest([e.y1, e.y2]) FROM pairs p JOIN eb e ON e.id = p.b WHERE p.adim > 0),
pa AS (SELECT a, b, (x + nx) // 2 AS x, (y + ny) // 2 AS y FROM (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM ca WINDOW w AS (PARTITION BY a, b, r, n ORDER BY x, y)) WHERE nx IS NOT NULL AND (a, b) NOT IN (SELECT (a, b) FROM crossing)),
pb AS (SELECT a, b, (x + nx) // 2 AS x, (y + ny) // 2 AS y FROM (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM cb WINDOW w AS (PARTITION BY a, b, r, n ORDER BY x, y)) WHERE nx IS NOT NULL AND (a, b) NOT IN (SELECT (a, b) FROM crossing)),
la AS ({_located('a', 'eb')}),
lb AS ({_located('b', 'ea')}),
parts_a AS (SELECT l.a, l.b, adim, bdim, CASE WHEN adim = 2 THEN 'B' ELSE 'I' END AS role, CASE WHEN bdim = 2 AND odd THEN 'I' ELSE 'E' END AS place FROM la l JOIN pairs USING (a, b) WHERE NOT on_edge),
parts_b AS (SELECT l.a, l.b, adim, bdim, CASE WHEN bdim = 2 THEN 'B' ELSE 'I' END AS role, CASE WHEN adim = 2 AND odd THEN 'I' ELSE 'E' END AS place FROM lb l JOIN pairs USING (a, b) WHERE NOT on_edge),
dots_a AS (SELECT p.a, p.b, p.adim, p.bdim, d.x, d.y FROM pairs p JOIN da d ON d.id = p.a),
dots_b AS (SELECT p.a, p.b, p.adim, p.bdim, d.x, d.y FROM pairs p JOIN db d ON d.id = p.b),
ka AS ({_located('a', 'eb').replace('FROM pa p', 'FROM dots_a p')}),
kb AS ({_located('b', 'ea').replace('FROM pb p', 'FROM dots_b p')}),
points_a AS (SELECT *, CASE WHEN adim = 1 THEN 'B' ELSE 'I' END AS role, CASE WHEN bdim = 2 THEN CASE WHEN on_edge THEN 'B' WHEN odd THEN 'I' ELSE 'E' END
  WHEN EXISTS (SELECT 1 FROM db z WHERE z.id = k.b AND z.x = k.x AND z.y = k.y) THEN CASE WHEN bdim = 1 THEN 'B' ELSE 'I' END WHEN on_edge THEN 'I' ELSE 'E' END AS place FROM ka k),
points_b AS (SELECT *, CASE WHEN bdim = 1 THEN 'B' ELSE 'I' END AS role, CASE WHEN adim = 2 THEN CASE WHEN on_edge THEN 'B' WHEN odd THEN 'I' ELSE 'E' END
  WHEN EXISTS (SELECT 1 FROM da z WHERE z.id = k.a AND z.x = k.x AND z.y = k.y) THEN CASE WHEN adim = 1 THEN 'B' ELSE 'I' END WHEN on_edge THEN 'I' ELSE 'E' END AS place FROM kb k),
touches AS (
  SELECT DISTINCT c.a, c.b, CASE WHEN adim = 2 OR za.id IS NOT NULL THEN 'B' ELSE 'I' END || CASE WHEN bdim = 2 OR zb.id IS NOT NULL THEN 'B' ELSE 'I' END AS e
  FROM corners c JOIN pairs USING (a, b) LEFT JOIN da za ON za.id = c.a AND za.x = c.x AND za.y = c.y AND adim = 1 LEFT JOIN db zb ON zb.id = c.b AND zb.x = c.x AND zb.y = c.y AND bdim = 1
),
edged AS (SELECT p.*, CASE WHEN adim = 2 THEN 'B' ELSE 'I' END AS ra, CASE WHEN bdim = 2 THEN 'B' ELSE 'I' END AS rb, c.a IS NOT NULL AS crossed FROM pairs p LEFT JOIN crossing c USING (a, b)),
said AS (
  SELECT a, b, 'EE' AS e, 2 AS d FROM pairs
  UNION ALL SELECT a, b, 'IE', adim FROM pairs WHERE adim > bdim UNION ALL SELECT a, b, 'EI', bdim FROM pairs WHERE bdim > adim
  UNION ALL SELECT a, b, 'BE', 1 FROM pairs WHERE adim = 2 AND bdim < 1 UNION ALL SELECT a, b, 'EB', 1 FROM pairs WHERE bdim = 2 AND adim < 1
  UNION ALL SELECT a, b, 'BE', 0 FROM pairs WHERE adim = 1 AND bdim < 0 UNION ALL SELECT a, b, 'EB', 0 FROM pairs WHERE bdim = 1 AND adim < 0
  UNION ALL SELECT a, b, ra || rb, 0 FROM edged WHERE crossed UNION ALL SELECT a, b, ra || 'E', 1 FROM edged WHERE crossed UNION ALL SELECT a, b, 'E' || rb, 1 FROM edged WHERE crossed
  UNION ALL SELECT a, b, ra || 'I', 1 FROM edged WHERE crossed AND bdim = 2 UNION ALL SELECT a, b, 'I' || rb, 1 FROM edged WHERE crossed AND adim = 2
  UNION ALL SELECT a, b, unnest(['II', 'IE', 'EI']), 2 FROM edged WHERE crossed AND adim = 2 AND bdim = 2
  UNION ALL SELECT a, b, ra || rb, 1 FROM edged JOIN lapped USING (a, b) UNION ALL SELECT a, b, unnest(CASE WHEN same THEN ['II'] ELSE ['IE', 'EI'] END), 2 FROM edged JOIN lapped USING (a, b) WHERE adim = 2 AND bdim = 2
  UNION ALL SELECT a, b, e, 0 FROM touches
  UNION ALL SELECT a, b, role || place, 1 FROM parts_a UNION ALL SELECT a, b, place || role, 1 FROM parts_b
  UNION ALL SELECT a, b, unnest(CASE WHEN place = 'I' THEN ['II', 'EI'] ELSE ['IE'] END), 2 FROM parts_a WHERE adim = 2 AND bdim = 2
  UNION ALL SELECT a, b, unnest(CASE WHEN place = 'I' THEN ['II', 'IE'] ELSE ['EI'] END), 2 FROM parts_b WHERE adim = 2 AND bdim = 2
  UNION ALL SELECT a, b, role || place, 0 FROM points_a UNION ALL SELECT a, b, place || role, 0 FROM points_b
),
boxes_a AS (SELECT id, min(x) AS x1, max(x) AS x2, min(y) AS y1, max(y) AS y2 FROM (SELECT id, unnest([x1, x2]) AS x, unnest([y1, y2]) AS y FROM ea UNION ALL SELECT * FROM da) GROUP BY id),
boxes_b AS (SELECT id, min(x) AS x1, max(x) AS x2, min(y) AS y1, max(y) AS y2 FROM (SELECT id, unnest([x1, x2]) AS x, unnest([y1, y2]) AS y FROM eb UNION ALL SELECT * FROM db) GROUP BY id),
asked AS (
    SELECT a.id AS a, b.id AS b FROM boxes_a a JOIN boxes_b b ON a.x1 <= b.x2 AND b.x1 <= a.x2 AND a.y1 <= b.y2 AND b.y1 <= a.y2 UNION SELECT a, b FROM pairs WHERE adim < 0 OR bdim < 0
),
matrices AS (
  SELECT a, b, {" || ".join(f"coalesce(CAST(max(d) FILTER (e = '{n}') AS VARCHAR), 'F')" for n in R.NAMES)} AS matrix FROM said JOIN asked USING (a, b) GROUP BY a, b
)"""


@query(_SHAPES + " SELECT a AS seq, b AS shape, matrix FROM matrices")
def shape_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nine intersections of every event's shape with each fixed one whose box it meets, and of empty shapes with all."""
    events, fixed = event_shapes(spark, sf_dir), fixed_shapes(spark)
    left, right = R.prepared(events), R.prepared(fixed)
    nothing = [i for i, t in FIXED.items() if "EMPTY" in t]
    stated = left.select(F.col("id").alias("a"), F.explode(F.when(F.col("dim") == R.EMPTY, F.array(*map(F.lit, FIXED))).otherwise(F.array(*map(F.lit, nothing)))).alias("b"))
    return R.relate(left, right, R.box_pairs(left, right).unionByName(stated)).select(F.col("a").alias("seq"), F.col("b").alias("shape"), "matrix")


_FRAME = "x BETWEEN 0 AND 200 AND y BETWEEN 0 AND 100"
_HOLE = "x > 30 AND x < 120 AND y > 20 AND y < 80"


@query(
    f"""WITH {_MOVES}, m AS (SELECT seq, x, y, {_FRAME} AND NOT ({_HOLE}) AS covered,
  {_FRAME} AND (x IN (0, 200) OR y IN (0, 100)) OR x BETWEEN 30 AND 120 AND y BETWEEN 20 AND 80 AND (x IN (30, 120) OR y IN (20, 80)) AS touches FROM moves)
SELECT seq, covered AND NOT touches AS within, touches, covered AS intersects, NOT covered AS disjoint_ FROM m"""
)
def hole_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SQL functions over every move's point and a polygon with a hole."""
    W.register(spark)
    point = F.concat(F.lit(f"<{CRS}> POINT ("), F.col("x").cast("string"), F.lit(" "), F.col("y").cast("string"), F.lit(")"))
    frame = f"<{CRS}> POLYGON ((0 0, 200 0, 200 100, 0 100, 0 0), (30 20, 120 20, 120 80, 30 80, 30 20))"
    m = moves(spark, sf_dir).select("seq", point.alias("p"), F.lit(frame).alias("g"))
    return m.selectExpr("seq", "sf_within(p, g) AS within", "sf_touches(p, g) AS touches", "sf_intersects(p, g) AS intersects", "sf_disjoint(p, g) AS disjoint_")
