"""Registered queries of rings of the events: which are simple, and the outline of the cells that a kind of event fills."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cell_queries import _LEVEL, GRID, _placed
from .functions import cells as C
from .operators import rings as R
from .queries import _MOVES, events, moves, query

#: Consecutive events that make a ring.
SIDES = 5


@query(
    f"""WITH {_MOVES},
corners AS (SELECT seq // {SIDES} AS ring, CAST(row_number() OVER (PARTITION BY seq // {SIDES} ORDER BY seq) - 1 AS INT) AS pos, CAST(round_even(x * 100, 0) AS HUGEINT) AS x, CAST(y AS HUGEINT) AS y FROM moves WHERE x IS NOT NULL AND y IS NOT NULL),
sizes AS (SELECT ring, count(*) AS corners, count(DISTINCT (x, y)) AS different FROM corners GROUP BY ring),
edges AS (SELECT a.ring, a.pos AS i, corners, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM corners a JOIN sizes s USING (ring) JOIN corners b ON b.ring = a.ring AND b.pos = (a.pos + 1) % s.corners),
short AS (SELECT DISTINCT ring FROM edges WHERE x1 = x2 AND y1 = y2),
off AS (SELECT DISTINCT a.ring FROM edges a JOIN corners c ON c.ring = a.ring WHERE (a.x2 - a.x1) * (c.y - a.y1) <> (a.y2 - a.y1) * (c.x - a.x1)),
signs AS (
  SELECT a.ring,
    sign((a.x2 - a.x1) * (b.y1 - a.y1) - (a.y2 - a.y1) * (b.x1 - a.x1)) * sign((a.x2 - a.x1) * (b.y2 - a.y1) - (a.y2 - a.y1) * (b.x2 - a.x1)) AS s,
    sign((b.x2 - b.x1) * (a.y1 - b.y1) - (b.y2 - b.y1) * (a.x1 - b.x1)) * sign((b.x2 - b.x1) * (a.y2 - b.y1) - (b.y2 - b.y1) * (a.x2 - b.x1)) AS t
  FROM edges a JOIN edges b ON a.ring = b.ring AND b.i - a.i BETWEEN 2 AND a.corners - 2
    AND least(a.x1, a.x2) <= greatest(b.x1, b.x2) AND least(b.x1, b.x2) <= greatest(a.x1, a.x2) AND least(a.y1, a.y2) <= greatest(b.y1, b.y2) AND least(b.y1, b.y2) <= greatest(a.y1, a.y2)
),
crossed AS (SELECT ring, count(*) AS n FROM signs WHERE s <= 0 AND t <= 0 GROUP BY ring),
told AS (
  SELECT ring, corners, CASE WHEN different < 3 THEN 'corners' WHEN ring IN (FROM short) THEN 'edge' WHEN ring NOT IN (FROM off) THEN 'line' END AS fault, coalesce(n, 0) AS n FROM sizes LEFT JOIN crossed USING (ring)
)
SELECT ring, corners, coalesce(fault, CASE WHEN n > 0 THEN 'crossing' END) AS fault, CASE WHEN fault IS NULL THEN n END AS crossings FROM told"""
)
def ring_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rule that the ring of every five consecutive events breaks, and how many of its edges cross or touch."""
    m = moves(spark, sf_dir).filter("x IS NOT NULL AND y IS NOT NULL").withColumn("ring", F.expr(f"seq div {SIDES}"))
    packed = F.transform(F.sort_array(F.collect_list(F.struct("seq", "x", "y"))), lambda e: F.struct(F.bround(e["x"] * 100).alias("x"), e["y"].alias("y")))  # five events at most
    corners = m.groupBy("ring").agg(packed.alias("c")).select("ring", F.posexplode("c").alias("pos", "c")).select("ring", "pos", "c.x", "c.y")
    return R.ring_faults(corners)


_N = 1 << _LEVEL


@query(
    f"""WITH RECURSIVE {_placed(_LEVEL)},
cells AS (SELECT DISTINCT event_type, ix, iy FROM placed JOIN events ON seq = event_id),
dots AS (SELECT event_type, vx, vy, count(*) AS n, sum(bit) AS mask FROM (
  SELECT event_type, ix + dx AS vx, iy + dy AS vy, bit FROM cells, (VALUES (0, 0, 1), (1, 0, 2), (0, 1, 4), (1, 1, 8)) v(dx, dy, bit)) GROUP BY ALL),
turns AS (SELECT event_type, count(*) FILTER (n = 1) AS q1, count(*) FILTER (n = 3) AS q3, count(*) FILTER (n = 2 AND mask IN (6, 9)) AS qd FROM dots GROUP BY event_type),
sides AS (SELECT c.event_type, sum(CASE WHEN dx <> 0 THEN {128 // _N}.0 ELSE {1024 // _N}.0 END) AS length FROM cells c, (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) v(dx, dy)
  WHERE NOT EXISTS (SELECT 1 FROM cells o WHERE o.event_type = c.event_type AND o.ix = c.ix + dx AND o.iy = c.iy + dy) GROUP BY c.event_type),
reach AS (
  SELECT event_type, ix, iy, ix * {_N} + iy AS label FROM cells
  UNION SELECT o.event_type, o.ix, o.iy, label FROM reach r JOIN cells o ON o.event_type = r.event_type AND abs(o.ix - r.ix) + abs(o.iy - r.iy) = 1 AND o.ix * {_N} + o.iy > label
),
shells AS (SELECT event_type, count(*) AS shells FROM (SELECT event_type, ix, iy, min(label) AS label FROM reach GROUP BY ALL) WHERE label = ix * {_N} + iy GROUP BY event_type),
areas AS (SELECT event_type, count(*) * {1024 // _N * (128 // _N)}.0 AS area FROM cells GROUP BY event_type)
SELECT event_type, CAST(area AS DOUBLE) AS area, CAST(length AS DOUBLE) AS length, shells, shells - (q1 - q3 + 2 * qd) // 4 AS holes, q1 + q3 + 2 * qd AS corners FROM areas JOIN sides USING (event_type) JOIN shells USING (event_type) JOIN turns USING (event_type)"""
)
def cell_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area, length, shells, holes and corners of the outline of all cells that a kind of event fills; the cells are coarsened first, so neighbours differ in size."""
    y = F.get_json_object("props", "$.k").cast("double")
    filled = C.coarsened(events(spark, sf_dir).select("event_type", GRID.cell(F.col("value"), y, _LEVEL).alias("cell")), "event_type")
    b = GRID.bounds(F.col("cell"))
    corner = lambda x, y: (b[x], b[y])
    ring = [corner("x1", "y1"), corner("x2", "y1"), corner("x2", "y2"), corner("x1", "y2")]
    side = lambda k: F.struct((F.col("cell") * 4 + k).alias("i"), *[v.alias(n) for v, n in zip((*ring[k], *ring[(k + 1) % 4]), ("x1", "y1", "x2", "y2"), strict=True)])
    edges = filled.filter("cell IS NOT NULL").select(F.col("event_type").alias("grp"), F.inline(F.array(*map(side, range(4)))))
    rows = R.outlines(edges)
    # a step's length is that from the corner before it
    ends = rows.groupBy("grp", "ring").agg(F.count("*").alias("steps"), F.sum("area").alias("area"), F.sum(F.when(~F.col("straight"), 1).otherwise(0)).alias("corners"))
    step = rows.join(ends.select("grp", "ring", "steps"), ["grp", "ring"]).select("grp", "ring", ((F.col("pos") + 1) % F.col("steps")).alias("pos"), F.col("x").alias("px"), F.col("y").alias("py"))
    long = rows.join(step, ["grp", "ring", "pos"]).groupBy("grp", "ring").agg(F.sum(F.abs(F.col("x") - F.col("px")) + F.abs(F.col("y") - F.col("py"))).alias("length"))
    each = ends.join(long, ["grp", "ring"])
    return each.groupBy(F.col("grp").alias("event_type")).agg(
        F.sum("area").alias("area"), F.sum("length").alias("length"), F.count_if(F.col("area") > 0).alias("shells"), F.count_if(F.col("area") < 0).alias("holes"), F.sum("corners").alias("corners")
    )
