"""Line segments ``(id, x1, y1, x2, y2)``: distances, crossings and cutting at crossings."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.spatial import spacing
from gridloom.operators.tables import discard, materialize


def point_distance(x: Column, y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """From a point to the nearest point of a segment."""
    dx, dy = x2 - x1, y2 - y1
    t = F.coalesce(F.try_divide((x - x1) * dx + (y - y1) * dy, dx * dx + dy * dy), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return F.hypot(x - (x1 + t * dx), y - (y1 + t * dy))


def _cells(segments: DataFrame, cell: float, margin: float) -> DataFrame:
    """``segments`` once for each cell of side ``cell`` that their box, widened by ``margin``, touches; boxes should touch few."""
    span = lambda a, b: F.explode(F.sequence(F.floor((F.least(a, b) - margin) / cell), F.floor((F.greatest(a, b) + margin) / cell)))
    dealt = segments.dropna(subset=["x1", "y1", "x2", "y2"]).select("*", span("x1", "x2").alias("cx")).select("*", span("y1", "y2").alias("cy"))
    if margin == 0:
        return dealt
    # Of the cells of its box, a slanted segment only passes those that are near it.
    middle = [(F.col(c) + 0.5) * cell for c in ("cx", "cy")]
    return dealt.filter(point_distance(*middle, *[F.col(c) for c in ("x1", "y1", "x2", "y2")]) <= (margin + cell * 0.75))


def within(points: DataFrame, segments: DataFrame, radius: float, cell: float) -> DataFrame:
    """``(point, line, distance)`` of points ``(id, x, y)`` at most ``radius`` from a segment: setbacks and snapping."""
    p = points.select(F.col("id").alias("point"), "x", "y", F.floor(F.col("x") / cell).alias("cx"), F.floor(F.col("y") / cell).alias("cy"))
    near = p.join(_cells(segments.withColumnRenamed("id", "line"), cell, radius), ["cx", "cy"])
    distance = point_distance(*[F.col(c) for c in ("x", "y", "x1", "y1", "x2", "y2")])
    return near.select("point", "line", distance.alias("distance")).filter(F.col("distance") <= radius)


def nearest(points: DataFrame, segments: DataFrame, radius: float, cell: float) -> DataFrame:
    """``(point, line, distance)``: each point's nearest segment within ``radius``; ties go to the smallest id.

    Where segments are dense, a search begins with a small part of ``radius`` and cells four times as wide, so that a segment is in few;
    points that found none look again twice as far. So a point meets few segments whatever lies within ``radius``.
    """
    steps = max(0, min(12, math.ceil(math.log2(radius / spacing(segments.select(F.col("x1").alias("x"), F.col("y1").alias("y")))))))
    found, pending = None, points.select("id", "x", "y") if steps == 0 else materialize(points.select("id", "x", "y"), "nearest-points")
    for i in range(steps, -1, -1):
        part = 0.5**i
        best = within(pending, segments, radius * part, min(cell, 4 * cell * part)).groupBy("point").agg(F.min(F.struct("distance", "line")).alias("best"))
        best = best.select("point", "best.line", "best.distance")
        best = materialize(best, "nearest-lines") if i else best
        found = best if found is None else found.unionByName(best)
        if i:
            before, pending = pending, materialize(pending.join(best, pending["id"].eqNullSafe(best["point"]), "left_anti"), "nearest-points")
            discard(before)
            if pending.isEmpty():
                break
    return found


def crossings(segments: DataFrame, cell: float) -> DataFrame:
    """``(a, b, t, u, x, y)``: where two segments ``a < b`` meet, at ``t`` of the one and ``u`` of the other (0 to 1).

    Segments on one line or parallel have no single point and are left out. A pair is
    found in every cell that both boxes touch and kept in the smallest of them.
    """
    s = _cells(segments, cell, 0.0)
    side = lambda n: s.select(F.col("id").alias(n), *[F.col(c).alias(f"{n}_{c}") for c in ("x1", "y1", "x2", "y2")], "cx", "cy")
    both = side("a").join(side("b"), ["cx", "cy"]).filter("a < b")
    c = lambda n, k: F.col(f"{n}_{k}")
    low = lambda k1, k2: F.floor(F.greatest(F.least(c("a", k1), c("a", k2)), F.least(c("b", k1), c("b", k2))) / cell)
    both = both.filter((F.col("cx") == low("x1", "x2")) & (F.col("cy") == low("y1", "y2")))
    rx, ry, sx, sy = c("a", "x2") - c("a", "x1"), c("a", "y2") - c("a", "y1"), c("b", "x2") - c("b", "x1"), c("b", "y2") - c("b", "y1")
    qx, qy = c("b", "x1") - c("a", "x1"), c("b", "y1") - c("a", "y1")
    cross = rx * sy - ry * sx
    t, u = F.try_divide(qx * sy - qy * sx, cross), F.try_divide(qx * ry - qy * rx, cross)
    found = both.select("a", "b", t.alias("t"), u.alias("u"), (c("a", "x1") + t * rx).alias("x"), (c("a", "y1") + t * ry).alias("y"))
    return found.filter(F.col("t").between(0, 1) & F.col("u").between(0, 1))


def noded(segments: DataFrame, cell: float) -> DataFrame:
    """``(id, piece, x1, y1, x2, y2)``: segments cut where they meet others; pieces count from 0.

    A segment's cuts are collected into one row, so it should cross a bounded number of others.
    """
    met = crossings(segments, cell)
    cuts = met.select(F.col("a").alias("id"), "t").unionByName(met.select(F.col("b").alias("id"), F.col("u").alias("t")))
    cuts = cuts.filter((F.col("t") > 0) & (F.col("t") < 1)).groupBy("id").agg(F.array_sort(F.collect_set("t")).alias("cuts"))
    whole = segments.dropna(subset=["x1", "y1", "x2", "y2"]).join(cuts, "id", "left")
    ends = F.concat(F.array(F.lit(0.0)), F.coalesce("cuts", F.array().cast("array<double>")), F.array(F.lit(1.0)))
    pieces = F.transform(F.sequence(F.lit(1), F.size(ends) - 1), lambda i: F.struct(F.get(ends, i - 1).alias("from"), F.get(ends, i).alias("to")))
    rows = whole.select("id", "x1", "y1", "x2", "y2", F.posexplode(pieces).alias("piece", "at"))
    along = lambda k, t: F.col(f"{k}1") + t * (F.col(f"{k}2") - F.col(f"{k}1"))
    return rows.select("id", "piece", *[along(k, F.col(f"at.{e}")).alias(f"{k}{i}") for i, e in ((1, "from"), (2, "to")) for k in ("x", "y")])
