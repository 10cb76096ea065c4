"""A discrete grid of quadratic subdivision: cell identifiers as Columns, all in the JVM.

A ``Grid`` divides an extent into 2^level by 2^level cells. A cell's identifier is a 1 followed by two bits for each level (y, then x), so it carries its level, its
parent is itself shifted by two bits, and cells of a parent stand next to each other in order. Points on a border belong to the cell above or right of it; points on the extent's
upper borders to the last cell; points outside of the extent have no cell (null).

Cell lists are also texts: ``<profile> CELLLIST ((id id ...))`` with identifiers in hexadecimal, in rising order and each once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..streaming.sinks import stored
from . import geometry as G

DEEPEST = 30
EVENS = 0x5555555555555555
#: Cells and edges of a cover up to which each task gets it whole; a larger one is dealt by cell, and each cell's points to so many tasks.
SMALL_COVER, DEALT = 200_000, 16


def _spread(v: Column) -> Column:
    """The bits of a number in every second place: its binary digits read to base four."""
    return F.conv(F.bin(v), 4, 10).cast("long")


def _gathered(v: Column) -> Column:
    """Every second bit of a number: what is left of it to base four read as binary digits."""
    return F.conv(F.conv(v.bitwiseAND(F.lit(EVENS)).cast("string"), 10, 4), 2, 10).cast("long")


def level_of(cell: Column) -> Column:
    return ((F.length(F.bin(cell)) - 1) / 2).cast("int")


def parent(cell: Column, levels: int | Column = 1) -> Column:
    """The cell so many levels up; null beyond the whole extent."""
    up = F.call_function("shiftright", cell, 2 * F.lit(levels) if isinstance(levels, int) else 2 * levels)
    return F.when(up > 0, up)


def children(cell: Column) -> Column:
    return F.transform(F.array(*map(F.lit, range(4))), lambda k: cell * 4 + k)


def contains(outer: Column, inner: Column) -> Column:
    """Whether a cell is the other or one of those it is divided into."""
    deeper = level_of(inner) - level_of(outer)
    return (deeper >= 0) & (F.call_function("shiftright", inner, F.greatest(2 * deeper, F.lit(0))) == outer)


def _position(cell: Column) -> tuple[Column, Column]:
    bits = cell - F.call_function("shiftleft", F.lit(1).cast("long"), 2 * level_of(cell))
    return _gathered(bits), _gathered(F.shiftright(bits, 1))


def _at(ix: Column, iy: Column, level: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), 2 * level) + _spread(ix) + 2 * _spread(iy)


@dataclass(frozen=True)
class Grid:
    profile: str
    min_x: float
    min_y: float
    max_x: float
    max_y: float
    wraps: bool = False  # whether the left border is the right one, as for longitudes

    def cell(self, x: Column, y: Column, level: int) -> Column:
        if not 0 <= level <= DEEPEST:
            raise ValueError(f"levels go from 0 to {DEEPEST}")
        n = 1 << level
        place = lambda v, low, high: F.least(F.lit(n - 1), F.floor((v - low) / (high - low) * n)).cast("long")
        inside = x.between(self.min_x, self.max_x) & y.between(self.min_y, self.max_y)
        return F.when(inside, _at(place(x, self.min_x, self.max_x), place(y, self.min_y, self.max_y), F.lit(level)))

    def bounds(self, cell: Column) -> Column:
        """struct(x1, y1, x2, y2)."""
        ix, iy = _position(cell)
        n = F.pow(F.lit(2.0), level_of(cell))
        at = lambda i, low, high: low + (high - low) * i / n
        return F.struct(
            at(ix, self.min_x, self.max_x).alias("x1"), at(iy, self.min_y, self.max_y).alias("y1"), at(ix + 1, self.min_x, self.max_x).alias("x2"), at(iy + 1, self.min_y, self.max_y).alias("y2")
        )

    def neighbours(self, cell: Column) -> Column:
        """Cells of the same level that share a border or a corner, in rising order; none beyond the extent, unless it wraps."""
        ix, iy = _position(cell)
        level = level_of(cell)
        n = F.call_function("shiftleft", F.lit(1).cast("long"), level)

        def moved(d: Column) -> Column:
            x, y = ix + d["x"], iy + d["y"]
            ok = y.between(F.lit(0), n - 1) & (F.lit(self.wraps) | x.between(F.lit(0), n - 1))
            return F.when(ok, _at(F.pmod(x, n), y, level))

        steps = F.array(*[F.struct(F.lit(dx).alias("x"), F.lit(dy).alias("y")) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if dx or dy])
        return F.array_sort(F.array_distinct(F.filter(F.transform(steps, moved), lambda c: c.isNotNull() & (c != cell))))

    def text(self, cells: Column) -> Column:
        """The literal of an array of cells."""
        listed = F.transform(F.array_sort(F.array_distinct(cells)), lambda c: F.lower(F.hex(c)))
        return F.concat(F.lit(f"<{self.profile}> CELLLIST (("), F.array_join(listed, " "), F.lit("))"))

    def cells_of(self, text: Column) -> Column:
        """The cells of a literal; null if it is none of this profile."""
        start = f"<{self.profile}> CELLLIST (("
        body = F.substr(text, F.lit(len(start) + 1), F.length(text) - len(start) - 2)
        cells = F.transform(F.filter(F.split(body, " "), lambda t: t != ""), lambda t: F.conv(t, 16, 10).cast("long"))
        return F.when(F.startswith(text, F.lit(start)) & F.endswith(text, F.lit("))")), cells)

    def measures(self, cells: Column) -> dict[str, Column]:
        """Number of cells, area and box of an array of cells none of which contains another."""
        boxes = F.transform(cells, self.bounds)
        edge: Callable[[str], Column] = lambda c: F.transform(boxes, lambda b: b[c])
        area = F.aggregate(boxes, F.lit(0.0), lambda s, b: s + (b["x2"] - b["x1"]) * (b["y2"] - b["y1"]))
        return {"num_geometries": F.size(cells), "area": area, "min_x": F.array_min(edge("x1")), "min_y": F.array_min(edge("y1")), "max_x": F.array_max(edge("x2")), "max_y": F.array_max(edge("y2"))}

    def cover(self, polygons: DataFrame, level: int) -> DataFrame:
        """name, cell, whole for polygons(name, edges, ...): cells that lie in a polygon as a whole, as coarse as possible, and those of ``level`` that its boundary meets.

        Cells are divided level by level from the extent on, and only those that a boundary meets are divided further; each level is stored.
        """
        open_ = polygons.select("name", "edges").withColumn("cell", F.lit(1).cast("long"))
        done = None
        for depth in range(level + 1):
            judged = open_.withColumn("b", self.bounds(F.col("cell"))).withColumn("met", F.exists("edges", lambda e: _meets_box(e, F.col("b"))))
            inside = G.ray_parity((F.col("b.x1") + F.col("b.x2")) / 2, (F.col("b.y1") + F.col("b.y2")) / 2, F.col("edges"))
            # stored, as the next level and the result both need it
            judged = stored(judged.filter(F.when(F.col("met"), True).otherwise(inside)).select("name", "edges", "cell", "met"), "cover")
            found = judged.filter(F.lit(depth == level) | ~F.col("met")).select("name", "cell", (~F.col("met")).alias("whole"))
            done = found if done is None else done.unionByName(found)
            open_ = judged.filter("met").select("name", "edges", F.explode(children(F.col("cell"))).alias("cell"))
        return done


def in_cover(points: DataFrame, cover: DataFrame, level: int) -> DataFrame:
    """Pairs of points(own, ...), own being a cell of ``level``, and cover(cell, edges, ...) whose cell is the point's own or above it.

    A point asks only for cells of levels that the cover has. Coarse cells hold a large share of all points, so points are not dealt by cell alone.
    """
    held = stored(cover, "covers")
    found = held.agg(F.sum(1 + F.coalesce(F.size("edges"), F.lit(0))).alias("n"), F.collect_set(level_of(F.col("cell"))).alias("levels")).first()  # at most 31 levels
    ups = F.array(*[F.lit(level - k) for k in sorted(found["levels"])]) if found["levels"] else F.array().cast("array<int>")
    at = points.withColumn("cell", F.explode(F.transform(ups, lambda k: F.call_function("shiftright", "own", 2 * k))))
    if (found["n"] or 0) <= SMALL_COVER:
        return at.join(F.broadcast(held), "cell")
    deal = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in points.columns]), F.lit(DEALT)).cast("int")
    every = held.withColumn("deal", F.explode(F.array(*map(F.lit, range(DEALT)))))
    return at.withColumn("deal", deal).join(every, ["cell", "deal"]).drop("deal")


def _meets_box(e: Column, b: Column) -> Column:
    """Whether a segment has a point in a closed box: their boxes meet and the box's corners do not all lie on one side of the segment's line."""
    boxes = (F.least(e["x1"], e["x2"]) <= b["x2"]) & (F.greatest(e["x1"], e["x2"]) >= b["x1"]) & (F.least(e["y1"], e["y2"]) <= b["y2"]) & (F.greatest(e["y1"], e["y2"]) >= b["y1"])
    turn = lambda x, y: (e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"])
    turns = [turn(b[x], b[y]) for x in ("x1", "x2") for y in ("y1", "y2")]
    # widened by more than the rounding, so a doubtful cell is divided or tested point by point
    slack = (F.abs(e["x2"] - e["x1"]) + F.abs(e["y2"] - e["y1"])) * F.greatest(*[F.abs(v) for v in (b["x1"], b["x2"], b["y1"], b["y2"], e["x1"], e["y1"])]) * 1e-14
    return boxes & (F.least(*turns) <= slack) & (F.greatest(*turns) >= -slack)


def coarsened(cells: DataFrame, *keys: str) -> DataFrame:
    """cells(keys, cell) with any four cells of one parent replaced by it, again and again, and cells inside of others left out; each once."""
    out = stored(cells.select(*keys, "cell").filter("cell IS NOT NULL").distinct().withColumn("level", level_of(F.col("cell"))), "cells")
    deepest = out.agg(F.max("level")).first()[0] or 0
    for level in range(deepest, 0, -1):
        here = F.col("level") == level
        up = out.filter(here).withColumn("up", parent(F.col("cell")))
        full = up.groupBy(*keys, "up").agg(F.count("*").alias("n")).filter("n = 4").select(*keys, F.col("up").alias("cell"), F.lit(level - 1).alias("level"))
        # a cell that stands there already holds its parts too
        whole = full.unionByName(out.filter(F.col("level") == level - 1)).distinct()
        rest = up.join(whole.select(*keys, F.col("cell").alias("up")), [*keys, "up"], "left_anti").select(*keys, "cell", "level")
        out = stored(out.filter(F.col("level") > level).unionByName(rest).unionByName(whole).unionByName(out.filter(F.col("level") < level - 1)), "cells")
    return _outermost(out, keys).drop("level")


def _outermost(cells: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Cells that lie in no other cell of their keys: each asks for all its ancestors by equality."""
    above = cells.withColumn("up", F.explode(F.sequence(F.lit(1), F.greatest(F.col("level"), F.lit(1))))).withColumn("up", parent(F.col("cell"), F.col("up")))
    inside = above.join(cells.select(*keys, F.col("cell").alias("up")), [*keys, "up"]).select(*keys, "cell").distinct()
    return cells.join(inside, [*keys, "cell"], "left_anti")
