"""Joins of points by distance, through a grid of cells."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.geometry import area, clipped, covers, is_box
from gridloom.operators.tables import discard, materialize

#: Left rows of a cell that one task compares with all right ones of it.
CROWDED = 2048


def within_distance(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """``(left_id, right_id, distance)`` of points ``(id, x, y)`` at most ``radius`` apart.

    Each right point goes to its cell of side ``radius`` and each left point to its own
    and the eight around it: an equi-join on cells, then the exact distance.
    """
    cell = lambda c: F.floor(F.col(c) / radius)
    around = F.explode(F.expr("flatten(transform(sequence(-1, 1), i -> transform(sequence(-1, 1), j -> struct(i as i, j as j))))")).alias("o")
    a = left.select(F.col("id").alias("left_id"), F.col("x").alias("ax"), F.col("y").alias("ay"), cell("x").alias("cx"), cell("y").alias("cy"), around)
    a = a.select("left_id", "ax", "ay", (F.col("cx") + F.col("o.i")).alias("cx"), (F.col("cy") + F.col("o.j")).alias("cy"))
    b = right.select(F.col("id").alias("right_id"), F.col("x").alias("bx"), F.col("y").alias("by"), cell("x").alias("cx"), cell("y").alias("cy"))
    distance = F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by"))
    return a.join(b, ["cx", "cy"]).withColumn("distance", distance).filter(F.col("distance") <= radius).select("left_id", "right_id", "distance")


def in_box(points: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """Points in a closed box; plain comparisons, so they reach the scan."""
    return points.filter((F.col("x") >= x0) & (F.col("x") <= x1) & (F.col("y") >= y0) & (F.col("y") <= y1))


def nearest_within(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """``(left_id, right_id, distance)``: the nearest right point within ``radius``; ties go to the smallest id."""
    best = within_distance(left, right, radius).groupBy("left_id").agg(F.min(F.struct("distance", "right_id")).alias("best"))
    return best.select("left_id", "best.right_id", "best.distance")


def first_polygon(points: DataFrame, polygons: DataFrame, cell: float) -> DataFrame:
    """``(id, polygon)``: the smallest polygon that covers each point of ``(id, x, y)``; points outside all are left out.

    ``polygons``: (polygon, ring). Each polygon goes to the cells of side ``cell`` that its
    box touches, which should be few; each point goes to one.
    """
    index = lambda c: F.floor(c / cell)
    side = lambda pick, k: pick(F.transform("ring", lambda p: p[k]))
    span = lambda k: F.explode(F.sequence(index(side(F.array_min, k)), index(side(F.array_max, k))))
    boxes = polygons.filter(F.size("ring") > 2).select("polygon", "ring", span("x").alias("cx")).select("polygon", "ring", "cx", span("y").alias("cy"))
    p = points.select("id", "x", "y", index(F.col("x")).alias("cx"), index(F.col("y")).alias("cy"))
    inside = p.join(boxes, ["cx", "cy"]).filter(covers(F.col("ring"), F.col("x"), F.col("y")))
    return inside.groupBy("id").agg(F.min("polygon").alias("polygon"))


def spacing(points: DataFrame) -> float:
    """The side of a square that holds one of ``points (x, y)`` on average over their box: a radius to begin a search with."""
    ends = [f(c).alias(f"{n}{c}") for c in "xy" for n, f in (("low_", F.min), ("high_", F.max))]
    known = points.filter(" and ".join(f"{c} is not null and not isnan({c}) and abs({c}) < double('infinity')" for c in "xy"))
    r = known.agg(F.count("*").alias("n"), *ends).first()
    wide = max(r["high_x"] - r["low_x"], r["high_y"] - r["low_y"]) if r["n"] else 0.0
    return math.sqrt((r["high_x"] - r["low_x"]) * (r["high_y"] - r["low_y"]) / r["n"]) or wide / r["n"] or 1.0 if wide else 1.0


def nearest(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """``(left_id, right_id, distance)``: the nearest right point at any distance; ties go to the smallest id.

    Points without a right one within ``radius`` look again with twice the radius, and so
    on, so rounds grow with the logarithm of the widest gap. Points with a null or
    non-finite coordinate have no nearest one; without right points there are no rows.
    """
    finite = lambda df: df.filter(" and ".join(f"{c} is not null and not isnan({c}) and abs({c}) < double('infinity')" for c in "xy"))
    right = finite(right)
    found, pending = None, materialize(finite(left).select("id", "x", "y"), "nearest-left")
    if right.isEmpty():
        return nearest_within(pending, right, radius)
    while not pending.isEmpty():
        near = materialize(nearest_within(pending, right, radius), "nearest-found")
        found = near if found is None else found.unionByName(near)
        before, pending = pending, materialize(pending.join(near, pending["id"] == near["left_id"], "left_anti"), "nearest-left")
        discard(before)
        radius *= 2
    return found if found is not None else nearest_within(pending, right, radius)


def overlaps(left: DataFrame, right: DataFrame, cell: float) -> DataFrame:
    """``(left_id, right_id, overlap, share)`` of convex rings ``(id, ring)`` that share an area; ``share`` is of the left one.

    Boxes go to the cells of side ``cell`` that they touch, which should be few, and a pair is kept in the smallest cell that both
    touch. Crowded cells are dealt to several tasks. Rings that are boxes need no more than their corners; of others, pairs whose boxes share
    an area meet with their rings and are clipped. Right rings go counter-clockwise. For concave rings and holes see ``overlay``.
    """
    bound = lambda pick, k: pick(F.transform("ring", lambda p: p[k]))
    index = lambda c: F.floor(c / cell)

    def dealt(df: DataFrame, n: str) -> DataFrame:
        box = [bound(pick, k).alias(f"{n}_{k}{i}") for i, pick in ((0, F.array_min), (1, F.array_max)) for k in "xy"]
        rows = df.filter(F.size("ring") > 2).select(F.col("id").alias(f"{n}_id"), *box, is_box(F.col("ring")).alias(f"{n}_flat"))
        span = lambda k: F.explode(F.sequence(index(F.col(f"{n}_{k}0")), index(F.col(f"{n}_{k}1"))))
        return rows.select("*", span("x").alias("cx")).select("*", span("y").alias("cy"))

    a, b = materialize(dealt(left, "left"), "overlap-left"), materialize(dealt(right, "right"), "overlap-right")
    parts = a.groupBy("cx", "cy").agg((F.floor(F.count("*") / CROWDED) + 1).cast("int").alias("parts"))
    cells, tasks = ["cx", "cy", "part"], int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def met(a: DataFrame, b: DataFrame) -> DataFrame:
        a = a.join(parts, ["cx", "cy"]).withColumn("part", F.pmod(F.xxhash64("left_id"), "parts").cast("int")).drop("parts")
        b = b.join(parts, ["cx", "cy"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        both = a.repartition(tasks, *cells).join(b.repartition(tasks, *cells), cells)
        for k in "xy":
            both = both.filter((F.col(f"left_{k}0") < F.col(f"right_{k}1")) & (F.col(f"right_{k}0") < F.col(f"left_{k}1")) & (F.col(f"c{k}") == index(F.greatest(f"left_{k}0", f"right_{k}0"))))
        return both

    shared = lambda k: F.least(f"left_{k}1", f"right_{k}1") - F.greatest(f"left_{k}0", f"right_{k}0")
    whole = (F.col("left_x1") - F.col("left_x0")) * (F.col("left_y1") - F.col("left_y0"))
    rows = met(a.filter("left_flat"), b.filter("right_flat")).select("left_id", "right_id", (shared("x") * shared("y")).alias("overlap"), whole.alias("whole"))
    if not (a.filter("not left_flat").isEmpty() and b.filter("not right_flat").isEmpty()):
        pairs = [met(x, y).select("left_id", "right_id") for x, y in ((a.filter("not left_flat"), b), (a.filter("left_flat"), b.filter("not right_flat")))]
        both = pairs[0].unionByName(pairs[1]).join(left.select(F.col("id").alias("left_id"), F.col("ring").alias("left_ring")), "left_id").join(right.select(F.col("id").alias("right_id"), F.col("ring").alias("right_ring")), "right_id")
        rows = rows.unionByName(both.select("left_id", "right_id", area(clipped(F.col("left_ring"), F.col("right_ring"))).alias("overlap"), area(F.col("left_ring")).alias("whole")))
    return rows.filter("overlap > 0").select("left_id", "right_id", "overlap", (F.col("overlap") / F.col("whole")).alias("share"))


def association(overlap: DataFrame, tolerance: float) -> DataFrame:
    """``(left_id, right_id, kind)`` from ``overlaps``: ``full`` where one ring covers the left one and no other does by more than ``tolerance``.

    Otherwise ``mixed``, with the ring of the largest share (ties: the smallest id).
    """
    best = F.max(F.struct("share", (-F.col("right_id")).alias("order"), "right_id"))
    # The share has a maximum of its own, so where only the kind is read, rows are counted and not sorted.
    rows = overlap.filter(F.col("share") > tolerance).groupBy("left_id").agg(best.alias("best"), F.max("share").alias("share"), F.count("*").alias("n"))
    return rows.select("left_id", "best.right_id", F.when((F.col("n") == 1) & (F.col("share") >= 1 - tolerance), "full").otherwise("mixed").alias("kind"))
