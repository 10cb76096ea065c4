"""Registered queries over grid cells of the moves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import cells as C
from .functions import geometry as G
from .operators.regions import region_table
from .queries import _MEMBERS, _MOVES, ZONES, events, moves, query

GRID = C.Grid("urn:local:event-grid", 0.0, 0.0, 1024.0, 128.0)


def _bits(level: int) -> str:
    return f"CAST({1 << 2 * level} + " + " + ".join(f"(((ix >> {b}) & 1) << {2 * b}) + (((iy >> {b}) & 1) << {2 * b + 1})" for b in range(level)) + " AS BIGINT)"


def _placed(level: int) -> str:
    n = 1 << level
    return f"""{_MOVES}, placed AS (SELECT *, CAST(least({n - 1}, floor(x / 1024 * {n})) AS BIGINT) AS ix, CAST(least({n - 1}, floor(y / 128 * {n})) AS BIGINT) AS iy FROM moves WHERE x BETWEEN 0 AND 1024 AND y BETWEEN 0 AND 128)"""


@query(
    f"""WITH {_placed(12)} SELECT seq, {_bits(12)} AS cell, {_bits(12)} >> 12 AS up, CAST((3 - CAST(ix IN (0, 4095) AS INT)) * (3 - CAST(iy IN (0, 4095) AS INT)) - 1 AS INT) AS neighbours,
  '<urn:local:event-grid> CELLLIST ((' || lower(to_hex({_bits(12)})) || '))' AS literal, ix / 4.0 AS x1, iy / 32.0 AS y1 FROM placed"""
)
def move_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cell of every move, the cell six levels up, how many cells are next to it, its literal and its corner, read back from the literal."""
    m = moves(spark, sf_dir).select("seq", GRID.cell(F.col("x"), F.col("y"), 12).alias("cell")).filter("cell IS NOT NULL")
    m = m.withColumn("literal", GRID.text(F.array("cell")))
    box = GRID.bounds(F.get(GRID.cells_of(F.col("literal")), F.lit(0)))
    return m.select("seq", "cell", C.parent(F.col("cell"), 6).alias("up"), F.size(GRID.neighbours(F.col("cell"))).alias("neighbours"), "literal", box["x1"].alias("x1"), box["y1"].alias("y1"))


@query(f"WITH {_MEMBERS} SELECT subject, seq, region FROM members WHERE covered")
def cell_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moves in zones by equality of cells: a move's cell and those above it meet the zones' covers; only in cells on a boundary is the point tested."""
    level = 8
    zones = region_table(spark, ZONES)
    cover = GRID.cover(zones, level).join(zones.select("name", "edges"), "name").select(F.col("name").alias("region"), "cell", F.when(~F.col("whole"), F.col("edges")).alias("edges"))
    m = moves(spark, sf_dir).withColumn("own", GRID.cell(F.col("x"), F.col("y"), level))
    met = C.in_cover(m, cover, level)
    inside = F.col("edges").isNull() | G.covered_by(F.col("x"), F.col("y"), F.col("edges"))
    # a point on the border of a whole cell and of a cell on the boundary lies in one cell only, so no pair comes twice
    return met.filter(inside).select("subject", "seq", "region")


_LEVEL = 5
_STEPS = "".join(
    f""",
up{k} AS (SELECT event_type, cell >> 2 AS cell FROM cells{k} GROUP BY event_type, cell >> 2 HAVING count(*) = 4),
rest{k} AS (SELECT event_type, cell FROM cells{k} c WHERE NOT EXISTS (SELECT 1 FROM up{k} u WHERE u.event_type = c.event_type AND u.cell = c.cell >> 2)),
cells{k - 1} AS (SELECT * FROM up{k})"""
    for k in range(_LEVEL, 0, -1)
)


@query(
    f"WITH {_placed(_LEVEL)}, cells{_LEVEL} AS (SELECT DISTINCT event_type, {_bits(_LEVEL)} AS cell FROM placed JOIN events ON seq = event_id){_STEPS}"
    + " SELECT * FROM cells0"
    + "".join(f" UNION ALL SELECT * FROM rest{k}" for k in range(1, _LEVEL + 1))
)
def coarsened_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells that each kind of event fills, as coarse as possible."""
    y = F.get_json_object("props", "$.k").cast("double")
    return C.coarsened(events(spark, sf_dir).select("event_type", GRID.cell(F.col("value"), y, _LEVEL).alias("cell")), "event_type")
