"""Geometry on columns. A point is a pair of columns; a polygon is a Python list or an array column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Point = tuple[Column, Column]
Box = tuple[Column, Column, Column, Column]


def box(prefix: str = "") -> Box:
    return tuple(F.col(prefix + c) for c in ("x1", "y1", "x2", "y2"))


def lit_point(p: Sequence[float]) -> Point:
    return F.lit(float(p[0])), F.lit(float(p[1]))


def center(b: Box) -> Point:
    return (b[0] + b[2]) / 2, (b[1] + b[3]) / 2


def foot(b: Box) -> Point:
    return (b[0] + b[2]) / 2, b[3]


def distance(p: Point, q: Point) -> Column:
    dx, dy = p[0] - q[0], p[1] - q[1]
    return F.sqrt(dx * dx + dy * dy)


def _edge_hit(p: Point, a: Point, b: Point) -> Column:
    """Does the ray from p towards +x meet the half-open edge a-b?"""
    straddles = (a[1] > p[1]) != (b[1] > p[1])
    at_x = (b[0] - a[0]) * (p[1] - a[1]) / (b[1] - a[1]) + a[0]
    return F.when(straddles, p[0] < at_x).otherwise(F.lit(False))


def in_polygon(x: str, y: str, polygon: Sequence[Sequence[float]]) -> Column:
    """Even-odd test of the point in columns ``x``, ``y`` against a constant polygon, one term per edge."""
    if len(polygon) < 3:
        return F.lit(False)
    terms = []
    for k, (ax, ay) in enumerate(polygon):
        bx, by = polygon[k - 1]
        if ay == by:
            continue  # a flat edge never straddles the ray
        at_x = f"{float(bx - ax)!r}D * ({y} - {float(ay)!r}D) / {float(by - ay)!r}D + {float(ax)!r}D"
        terms.append(f"int((({float(ay)!r}D > {y}) <> ({float(by)!r}D > {y})) and {x} < {at_x})")
    return F.expr("(" + " + ".join(terms) + ") % 2 = 1")


def in_polygon_column(p: Point, polygon: Column) -> Column:
    """Even-odd test against an array<struct<x,y>> column; NULL polygon gives NULL."""
    n = F.size(polygon)
    shifted = F.concat(F.slice(polygon, n, 1), F.slice(polygon, 1, n - 1))
    hits = F.zip_with(
        polygon,
        shifted,
        lambda v, u: _edge_hit(p, (v["x"], v["y"]), (u["x"], u["y"])).cast("int"),
    )
    odd = F.aggregate(hits, F.lit(0), lambda s, h: s + h) % 2 == 1
    return F.when(n >= 3, odd).when(polygon.isNotNull(), F.lit(False))


def cross(o: Point, a: Point, b: Point) -> Column:
    return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])


def side_of_line(p: Point, a: Point, b: Point) -> Column:
    return F.signum(cross(a, b, p)).cast("int")


def _within(q: Point, a: Point, b: Point) -> Column:
    return q[0].between(F.least(a[0], b[0]), F.greatest(a[0], b[0])) & q[1].between(
        F.least(a[1], b[1]), F.greatest(a[1], b[1])
    )


def segments_meet(a: Point, b: Point, c: Point, d: Point) -> Column:
    """True when segments a-b and c-d share a point, touching and collinear overlap included."""
    a_side, b_side = cross(c, d, a), cross(c, d, b)
    c_side, d_side = cross(a, b, c), cross(a, b, d)

    def opposite(u: Column, v: Column) -> Column:
        return ((u > 0) & (v < 0)) | ((u < 0) & (v > 0))

    return (
        (opposite(a_side, b_side) & opposite(c_side, d_side))
        | ((a_side == 0) & _within(a, c, d))
        | ((b_side == 0) & _within(b, c, d))
        | ((c_side == 0) & _within(c, a, b))
        | ((d_side == 0) & _within(d, a, b))
    )


def crossing_sign(prev: Point, cur: Point, a: Point, b: Point) -> Column:
    """+1 / -1 by the side the move ends on; 0 when it does not cross or ends on the line."""
    return F.when(segments_meet(prev, cur, a, b), side_of_line(cur, a, b)).otherwise(F.lit(0))


def crossing_direction(sign: Column, orientation: Column) -> Column:
    """'in' / 'out' for a non-zero sign; NULL for 0 or NULL."""
    forward = orientation == "left_to_right"
    return F.when(sign == 0, None).when((sign > 0) == forward, "in").when(sign.isNotNull(), "out")


def overlap_area(a: Box, b: Box) -> Column:
    w = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    return w * h


def area(b: Box) -> Column:
    return (b[2] - b[0]) * (b[3] - b[1])


def iou(a: Box, b: Box) -> Column:
    shared = overlap_area(a, b)
    union = area(a) + area(b) - shared
    return F.when((shared == 0) | (union <= 0), F.lit(0.0)).otherwise(shared / union)


def boxes_touch(a: Box, b: Box, margin: float = 0.0) -> Column:
    """Inclusive overlap after widening by a margin."""
    m = F.lit(float(margin))
    return (a[0] - m <= b[2]) & (b[0] - m <= a[2]) & (a[1] - m <= b[3]) & (b[1] - m <= a[3])


def aspect_ratio(b: Box) -> Column:
    """Width over height; NULL for a box without height."""
    h = b[3] - b[1]
    return F.when(h > 0, (b[2] - b[0]) / h)


def shift_and_scale(b: Box, dx: Column, dy: Column, factor: float = 1.0) -> Box:
    """Map a box from crop coordinates back to the full frame."""
    k = F.lit(float(factor))
    return b[0] * k + dx, b[1] * k + dy, b[2] * k + dx, b[3] * k + dy
