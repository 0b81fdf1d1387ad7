"""Plane geometry as expressions: points are pairs of columns, polygons arrays of (x, y) structs."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Point = tuple[Column, Column]


def rotate(p: Point, centre: Point, degrees: Column) -> Point:
    a = F.radians(degrees.cast("double"))
    dx, dy = p[0] - centre[0], p[1] - centre[1]
    return centre[0] + dx * F.cos(a) - dy * F.sin(a), centre[1] + dx * F.sin(a) + dy * F.cos(a)


def scale_into(p: Point, box: tuple[Column, Column, Column, Column]) -> Point:
    """A point of the unit square in the box (x, y, w, h)."""
    x, y, w, h = box
    return x + p[0] * w, y + p[1] * h


def shear(p: Point, box: tuple[Column, Column, Column, Column], k: Column, side: Column) -> Point:
    """Shear of strength ``k``; ``side`` stays where it is (centre lines move both halves)."""
    x, y, w, h = box
    up = (y + h - p[1]) / F.greatest(F.lit(1.0), h)
    left = (x + w - p[0]) / F.greatest(F.lit(1.0), w)
    dx = F.when(side == "bottom", k * w * up).when(side == "top", k * w * (1 - up)).when(side == "center_h", k * w * (F.lit(0.5) - up)).otherwise(F.lit(0.0))
    dy = F.when(side == "right", k * h * left).when(side == "left", k * h * (1 - left)).when(side == "center_v", k * h * (F.lit(0.5) - left)).otherwise(F.lit(0.0))
    return p[0] + dx, p[1] + dy


def reflect(p: Point, a: Point, b: Point) -> Point:
    """Mirror image across the line through a and b (the point itself if they coincide)."""
    dx, dy = b[0] - a[0], b[1] - a[1]
    n = F.nullif(dx * dx + dy * dy, F.lit(0.0))
    t = ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / n
    return F.coalesce(2 * (a[0] + t * dx) - p[0], p[0]), F.coalesce(2 * (a[1] + t * dy) - p[1], p[1])


def corners(box: tuple[Column, Column, Column, Column], degrees: Column) -> list[Point]:
    """Corners of a box turned about its centre."""
    x, y, w, h = box
    c = (x + w / 2, y + h / 2)
    return [rotate(scale_into((F.lit(u), F.lit(v)), box), c, degrees) for u, v in ((0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0))]


def overlaps(a: list[Column], b: list[Column], margin: float, touching: bool) -> Column:
    """Do two boxes (x1, y1, x2, y2) come within ``margin``?  ``touching``: the margin itself counts."""
    apart = (lambda p, q: p + margin < q) if touching else (lambda p, q: p + margin <= q)
    return ~(apart(a[2], b[0]) | apart(b[2], a[0]) | apart(a[3], b[1]) | apart(b[3], a[1]))


def ngon(n: int, points: int | None = None) -> list[tuple[float, float]]:
    """Regular n-gon on the unit circle: odd n with a vertex on top, even n with a flat top."""
    start = -math.pi / 2 + (0 if n % 2 else math.pi / n)
    return [(math.cos(start + 2 * math.pi * k / n), math.sin(start + 2 * math.pi * k / n)) for k in range(points or n)]


def unit(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Moved and scaled so that the bounding box is the unit square."""
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    w, h = max(xs) - min(xs) or 1.0, max(ys) - min(ys) or 1.0
    return [((x - min(xs)) / w, (y - min(ys)) / h) for x, y in points]


def inside(px: Column, py: Column, polygon: Column) -> Column:
    """Even-odd rule: does a ray to the right cross the polygon's edges an odd number of times?"""
    n = F.size(polygon)

    def crosses(i: Column) -> Column:
        a, b = F.element_at(polygon, i), F.element_at(polygon, F.when(i == n, 1).otherwise(i + 1))
        at = a["x"] + (py - a["y"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)) * (b["x"] - a["x"])
        return F.when((a["y"] > py) != (b["y"] > py), F.when(px < at, 1).otherwise(0)).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + crosses(i)) % 2 == 1


def inside_fixed(px: Column, py: Column, points: list[tuple[float, float]]) -> Column:
    """``inside`` for a polygon known beforehand: its box first, then one plain term an edge."""
    xs, ys = zip(*points)
    crossed = F.lit(0)
    for (ax, ay), (bx, by) in zip(points, [*points[1:], points[0]]):
        if ay != by:
            at = float(ax) + (py - float(ay)) / float(by - ay) * float(bx - ax)
            crossed = crossed + F.when(((F.lit(float(ay)) > py) != (F.lit(float(by)) > py)) & (px < at), 1).otherwise(0)
    return px.between(float(min(xs)), float(max(xs))) & py.between(float(min(ys)), float(max(ys))) & (crossed % 2 == 1)
