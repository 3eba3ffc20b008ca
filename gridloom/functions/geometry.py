"""Column functions on rings: arrays of ``struct<x: double, y: double>``, the last point not repeated.

A multipolygon is an array of ``struct<shell: ring, holes: array<ring>>``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def ring(*points: tuple[Column, Column]) -> Column:
    return F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in points])


def _sides(r: Column, f) -> Column:
    """``f(from, to)`` of each side."""
    after = F.concat(F.slice(r, F.lit(2), F.greatest(F.size(r) - 1, F.lit(0))), F.slice(r, 1, 1))
    return F.zip_with(r, after, lambda p, q: f(p["x"], p["y"], q["x"], q["y"]))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, b: a + b)


def area(r: Column) -> Column:
    return F.abs(_sum(_sides(r, lambda px, py, qx, qy: px * qy - qx * py))) / 2


def perimeter(r: Column) -> Column:
    return _sum(_sides(r, lambda px, py, qx, qy: F.hypot(qx - px, qy - py)))


def compactness(r: Column) -> Column:
    """4 pi area / perimeter squared, 1 at most; null without a perimeter."""
    found = F.try_divide(F.lit(4 * math.pi) * area(r), perimeter(r) * perimeter(r))
    return F.when(found > 1, 1.0).otherwise(found)


def is_box(r: Column) -> Column:
    """Whether the ring is a rectangle along the axes, its four corners in either direction."""
    def along(first: str, second: str) -> Column:
        return (r[0][first] == r[1][first]) & (r[1][second] == r[2][second]) & (r[2][first] == r[3][first]) & (r[3][second] == r[0][second])

    return F.when(F.size(r) == 4, F.coalesce(along("x", "y") | along("y", "x"), F.lit(False))).otherwise(False)


def _on_side(x: Column, y: Column):
    def on_side(px, py, qx, qy):
        flat = (qx - px) * (y - py) == (qy - py) * (x - px)
        return flat & x.between(F.least(px, qx), F.greatest(px, qx)) & y.between(F.least(py, qy), F.greatest(py, qy))

    return on_side


def _odd(r: Column, x: Column, y: Column) -> Column:
    def crossed(px, py, qx, qy):
        return ((py > y) != (qy > y)) & F.coalesce(x < px + F.try_divide((qx - px) * (y - py), qy - py), F.lit(False))

    return F.aggregate(_sides(r, crossed), F.lit(False), lambda a, b: a != b)


def covers(r: Column, x: Column, y: Column) -> Column:
    """Whether the ring holds the point; points on a side count."""
    return _odd(r, x, y) | F.exists(_sides(r, _on_side(x, y)), lambda s: s)


def strictly_inside(r: Column, x: Column, y: Column) -> Column:
    """Whether the ring holds the point; points on a side do not count."""
    return _odd(r, x, y) & ~F.exists(_sides(r, _on_side(x, y)), lambda s: s)


def polygon(shell: Column, *holes: Column) -> Column:
    """A polygon of a multipolygon."""
    inner = F.array(*holes) if holes else F.array().cast("array<array<struct<x: double, y: double>>>")
    return F.struct(shell.alias("shell"), inner.alias("holes"))


def clipped(r: Column, window: Column) -> Column:
    """The part of a ring inside a convex ``window`` whose points go counter-clockwise; empty where they don't meet.

    Exact for convex rings; a concave one may keep sides of no width along the window.
    """

    def cut(poly: Column, s: Column) -> Column:
        away = lambda x, y: (s["bx"] - s["ax"]) * (y - s["ay"]) - (s["by"] - s["ay"]) * (x - s["ax"])
        point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))

        def kept(px, py, qx, qy):
            p, q = away(px, py), away(qx, qy)
            t = F.try_divide(p, p - q)
            meet = point(px + t * (qx - px), py + t * (qy - py))
            none = F.array().cast("array<struct<x: double, y: double>>")
            return F.when((p >= 0) & (q >= 0), F.array(point(qx, qy))).when(p >= 0, F.array(meet)).when(q >= 0, F.array(meet, point(qx, qy))).otherwise(none)

        return F.flatten(_sides(poly, kept))

    sides = _sides(window, lambda px, py, qx, qy: F.struct(px.alias("ax"), py.alias("ay"), qx.alias("bx"), qy.alias("by")))
    return F.aggregate(sides, r, cut)


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """A rectangle, counter-clockwise."""
    return ring((x0, y0), (x1, y0), (x1, y1), (x0, y1))
