"""Point-in-polygon predicates as Column expressions.

All predicates stay in the JVM. Orientation uses the double determinant where its error bound settles the sign;
the few doubtful cases take an exact expansion sum, also in the JVM, which CASE WHEN evaluates for those rows only.

``edges`` is an array of struct<x1, y1, x2, y2>. For polygons known on the driver the expressions are unrolled, edge by
edge, so that whole-stage code generation compiles them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bound of the rounding error of the determinant, relative to the sum of its two products' magnitudes.
DOUBT = 4 * 2.0**-52
EDGE_TYPE = "array<struct<x1:double,y1:double,x2:double,y2:double>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _difference(a: Column, b: Column) -> tuple[Column, Column]:
    d = a - b
    v = a - d
    return d, (a - (d + v)) + (v - b)


def _halves(a: Column) -> tuple[Column, Column]:
    c = a * 134217729.0
    high = c - (c - a)
    return high, a - high


def _product(a: Column, b: Column) -> list[Column]:
    p = a * b
    (ah, al), (bh, bl) = _halves(a), _halves(b)
    return [p, ((ah * bh - p) + ah * bl + al * bh) + al * bl]


def _grown(parts: Column, term: Column) -> Column:
    """Adds a term to a non-overlapping expansion without rounding."""
    start = F.struct(term.alias("q"), F.array().cast("array<double>").alias("low"))

    def add(state: Column, part: Column) -> Column:
        s = state["q"] + part
        b = s - state["q"]
        low = (state["q"] - (s - b)) + (part - b)
        return F.struct(s.alias("q"), F.concat(state["low"], F.array(low)).alias("low"))

    return F.aggregate(parts, start, add, lambda s: F.concat(s["low"], F.array(s["q"])))


def exact_orientation(x1: Column, y1: Column, x2: Column, y2: Column, px: Column, py: Column) -> Column:
    """-1, 0 or 1: the exact sign of (x2-x1)(py-y1) - (y2-y1)(px-x1) over the given doubles."""
    names = ("ax", "bx", "ay", "by", "cx", "dx", "cy", "dy")
    values = [v for a, b in ((x2, x1), (py, y1), (y2, y1), (px, x1)) for v in _difference(a, b)]

    def sign(d: Column) -> Column:
        terms = [t for a in ("ax", "bx") for b in ("ay", "by") for t in _product(d[a], d[b])]
        terms += [-t for a in ("cx", "dx") for b in ("cy", "dy") for t in _product(d[a], d[b])]
        total = F.aggregate(F.array(*terms), F.array(F.lit(0.0)), _grown)
        return F.aggregate(total, F.lit(0.0), lambda s, part: F.when(part != 0, F.signum(part)).otherwise(s))

    return _let(F.struct(*[v.alias(n) for v, n in zip(values, names, strict=True)]), sign).cast("int")


def orientation(x1: Column, y1: Column, x2: Column, y2: Column, px: Column, py: Column) -> Column:
    """-1, 0 or 1 for a point right of, on or left of the line through an edge; exact where no product of
    differences over- or underflows, so for ordinates of zero or between 1e-70 and 1e150 in size."""
    left, right = (x2 - x1) * (py - y1), (y2 - y1) * (px - x1)
    det = left - right
    # a product of zero leaves the other's sign, which is exact
    clear = (F.abs(det) > (F.abs(left) + F.abs(right)) * DOUBT) | (left == 0) | (right == 0)
    return F.when(clear, F.signum(det).cast("int")).otherwise(exact_orientation(x1, y1, x2, y2, px, py))


def _in_box(x1: Column, y1: Column, x2: Column, y2: Column, px: Column, py: Column) -> Column:
    return px.between(F.least(x1, x2), F.greatest(x1, x2)) & py.between(F.least(y1, y2), F.greatest(y1, y2))


def on_segment(x1: Column, y1: Column, x2: Column, y2: Column, px: Column, py: Column) -> Column:
    """Whether a point lies on a closed segment. Axis-parallel segments need no determinant."""
    inside = _in_box(x1, y1, x2, y2, px, py)
    axis = (x1 == x2) | (y1 == y2)
    return F.when(~inside, False).when(axis, True).otherwise(orientation(x1, y1, x2, y2, px, py) == 0)


def crosses_ray(x1: Column, y1: Column, x2: Column, y2: Column, px: Column, py: Column) -> Column:
    """Whether the ray from a point to larger x passes an edge (half-open in y)."""
    spans = (y1 > py) != (y2 > py)
    return F.when(spans, px < F.try_divide((x2 - x1) * (py - y1), y2 - y1) + x1).otherwise(False)


def on_boundary(px: Column, py: Column, edges: Column) -> Column:
    return F.exists(edges, lambda e: on_segment(e["x1"], e["y1"], e["x2"], e["y2"], px, py))


def ray_parity(px: Column, py: Column, edges: Column) -> Column:
    """Whether a ray from a point passes an odd number of edges."""
    return F.aggregate(edges, F.lit(False), lambda odd, e: odd != crosses_ray(e["x1"], e["y1"], e["x2"], e["y2"], px, py))


def within(px: Column, py: Column, edges: Column) -> Column:
    """Inside, boundary left out."""
    return F.when(on_boundary(px, py, edges), False).otherwise(ray_parity(px, py, edges))


def covered_by(px: Column, py: Column, edges: Column) -> Column:
    """Inside or on the boundary."""
    return F.when(on_boundary(px, py, edges), True).otherwise(ray_parity(px, py, edges))


# -- polygons known on the driver ---------------------------------------------------------------------

Ring = Sequence[tuple[float, float]]


def edge_list(ring: Ring) -> list[tuple[float, float, float, float]]:
    return [(*a, *b) for a, b in zip(ring, ring[1:], strict=False)]


def edges_literal(ring: Ring) -> Column:
    rows = [F.struct(*[F.lit(float(v)).alias(n) for v, n in zip(e, ("x1", "y1", "x2", "y2"), strict=True)]) for e in edge_list(ring)]
    return F.array(*rows)


def _any(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns)


def ring_boundary(px: Column, py: Column, ring: Ring) -> Column:
    """on_boundary, unrolled. The exact sum runs only for points in doubt and only once per polygon."""
    sure, doubtful = [], []
    for e in edge_list(ring):
        x1, y1, x2, y2 = map(F.lit, map(float, e))
        box = px.between(min(e[0], e[2]), max(e[0], e[2])) & py.between(min(e[1], e[3]), max(e[1], e[3]))
        if e[0] == e[2] or e[1] == e[3]:
            sure.append(box)
        else:
            left, right = (x2 - x1) * (py - y1), (y2 - y1) * (px - x1)
            doubtful.append(box & (F.abs(left - right) <= (F.abs(left) + F.abs(right)) * DOUBT))
    out = F.when(_any(sure), True) if sure else F.when(F.lit(False), True)
    if doubtful:
        out = out.when(_any(doubtful), on_boundary(px, py, edges_literal(ring)))
    return out.otherwise(False)


def ring_odd(px: Column, py: Column, ring: Ring) -> Column:
    crossings = []
    for e in edge_list(ring):
        if e[1] != e[3]:
            x1, y1, x2, y2 = map(F.lit, map(float, e))
            crossings.append(crosses_ray(x1, y1, x2, y2, px, py))
    return reduce(lambda a, b: a != b, crossings)


def _in_ring_box(px: Column, py: Column, ring: Ring) -> Column:
    xs, ys = [float(x) for x, _ in ring], [float(y) for _, y in ring]
    return px.between(min(xs), max(xs)) & py.between(min(ys), max(ys))


def ring_covers(px: Column, py: Column, ring: Ring) -> Column:
    return F.when(~_in_ring_box(px, py, ring), False).when(ring_boundary(px, py, ring), True).otherwise(ring_odd(px, py, ring))


def ring_contains(px: Column, py: Column, ring: Ring) -> Column:
    return F.when(~_in_ring_box(px, py, ring), False).when(ring_boundary(px, py, ring), False).otherwise(ring_odd(px, py, ring))


def normal_longitude(lon: Column) -> Column:
    """Into [-180, 180); values already within [-180, 180] stay."""
    turned = F.bround(F.pmod(lon + 180.0, F.lit(360.0)) - 180.0, 12)
    return F.when(lon.between(-180.0, 180.0), lon).otherwise(turned)
