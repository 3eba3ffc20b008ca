"""Faces of a planar network: rings by the next side around each node, and polygons with their holes.

Sides are directed and have the face on their left. The side after ``u -> v`` is the first one out of
``v`` clockwise from the way back to ``u``; a window over each node's few sides finds it. These links
form cycles, and pointers that double their reach in each round label every side with its
cycle's smallest side and its distance from that one, so a ring of a million sides takes twenty rounds of one join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.geometry import strictly_inside
from gridloom.operators.ranges import running
from gridloom.operators.tables import discard, materialize

ENDS = ["x1", "y1", "x2", "y2"]


def trace(sides: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Directed ``sides`` (side, x1, y1, x2, y2), stored, with ``face`` (its smallest side) and ``back``: how many sides on that one follows.

    ``side`` is a number of its own; sides meet within a ``group`` where coordinates are equal. A node's sides are ordered in one task.
    """
    group = group or []
    here = [*group, "x", "y"]
    out = sides.select(*group, F.col("x1").alias("x"), F.col("y1").alias("y"), F.atan2(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1")).alias("angle"), F.col("side").alias("leaves"), F.lit(None).cast("long").alias("comes"))
    into = sides.select(*group, F.col("x2").alias("x"), F.col("y2").alias("y"), F.atan2(F.col("y1") - F.col("y2"), F.col("x1") - F.col("x2")).alias("angle"), F.lit(None).cast("long").alias("leaves"), F.col("side").alias("comes"))
    # At the angle of the way back the side that comes in goes first, so that way is taken only where there is no other.
    around = Window.partitionBy(*here).orderBy("angle", F.col("leaves").isNotNull(), "leaves", "comes")
    last = F.last("leaves", ignorenulls=True)
    before, wrapped = last.over(around.rowsBetween(Window.unboundedPreceding, -1)), last.over(around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    links = out.unionByName(into).withColumn("jump", F.coalesce(before, wrapped)).filter("comes is not null")
    state = materialize(links.select(F.col("comes").alias("side"), "jump", F.struct(F.col("comes").alias("face"), F.lit(0).cast("long").alias("back")).alias("least"), F.lit(True).alias("moved")), "face-links")
    reach = 1
    while not state.filter("moved").isEmpty():
        ahead = state.select(F.col("side").alias("jump"), F.col("jump").alias("far"), F.struct("least.face", (F.col("least.back") + reach).alias("back")).alias("other"))
        least = F.least("least", "other")
        before, state = state, materialize(state.join(ahead, "jump").select("side", F.col("far").alias("jump"), least.alias("least"), (least["face"] < F.col("least.face")).alias("moved")), "face-links")
        discard(before)
        reach *= 2
    return sides.join(state.select("side", "least.face", "least.back"), "side")


def rings(traced: DataFrame, group: list[str] | None = None) -> DataFrame:
    """``(face, area, ring)`` of ``trace``: counter-clockwise rings have a positive area. A ring is one row and begins at its smallest corner."""
    first = F.when(F.col("back") == 0, F.lit(None)).otherwise(-F.col("back"))
    cross = F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")) / 2
    points = F.array_sort(F.collect_list(F.struct(first.isNotNull().alias("later"), first.alias("at"), F.col("x1").alias("x"), F.col("y1").alias("y"))))
    found = traced.groupBy(*(group or []), "face").agg(cross.alias("area"), points.alias("points"))
    found = found.withColumn("loop", F.transform("points", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))).drop("points")
    at = F.array_position("loop", F.array_min("loop")).cast("int")
    return found.withColumn("ring", F.concat(F.slice("loop", at, F.size("loop")), F.slice("loop", F.lit(1), at - 1))).drop("loop")


def nested(faces: DataFrame, cell: float, group: list[str] | None = None) -> DataFrame:
    """``(face, area, ring, holes)``: rings of a positive area with the others that lie in them and in no smaller one; ``area`` is without the holes.

    ``faces`` is a stored result of ``rings``. Rings of a negative area in no other are left out. Rings go to the cells of side ``cell`` that their box touches.
    """
    group = group or []
    side = lambda pick, k: pick(F.transform("ring", lambda p: p[k]))
    span = lambda k: F.explode(F.sequence(F.floor(side(F.array_min, k) / cell), F.floor(side(F.array_max, k) / cell)))
    shells = faces.filter("area > 0")
    dealt = shells.select(*group, F.col("face").alias("shell"), F.col("area").alias("room"), F.col("ring").alias("around"), span("x").alias("cx"), "ring").select("*", span("y").alias("cy")).drop("ring")
    inner = faces.filter("area < 0").select(*group, "face", F.col("area").alias("gap"), "ring", F.get("ring", F.lit(0)).alias("p"))
    inner = inner.withColumn("cx", F.floor(F.col("p.x") / cell)).withColumn("cy", F.floor(F.col("p.y") / cell))
    inside = inner.join(dealt, [*group, "cx", "cy"]).filter((F.col("room") > -F.col("gap")) & strictly_inside(F.col("around"), F.col("p.x"), F.col("p.y")))
    of = inside.groupBy(*group, "face").agg(F.min(F.struct("room", "shell")).alias("of"), F.min_by(F.struct("gap", "ring"), "shell").alias("hole"))
    holes = of.groupBy(*group, F.col("of.shell").alias("face")).agg(F.sum("hole.gap").alias("gaps"), F.array_sort(F.collect_list("hole.ring")).alias("holes"))
    rows = shells.join(holes, [*group, "face"], "left")
    return rows.select(*group, "face", (F.col("area") + F.coalesce("gaps", F.lit(0.0))).alias("area"), "ring", F.coalesce("holes", F.array().cast(shells.select(F.array("ring")).schema[0].dataType)).alias("holes"))


def polygonize(segments: DataFrame, cell: float) -> tuple[DataFrame, DataFrame]:
    """``(face, area, ring, holes)`` of the faces that ``segments (x1, y1, x2, y2)`` enclose, and the segments that bound none.

    Segments must meet at ends only (see ``lines.noded``) and at equal coordinates. Repeated ones, in either direction,
    count once; those without length or with a null end are left out. Dangles and bridges, with the same face on both sides, are returned as
    ``(x1, y1, x2, y2)`` and bound nothing. A part of the network inside a face is a hole of it. Faces are numbered in the order of their
    smallest side, and a face that touches itself at a node is one ring.
    """
    forward = F.struct("x1", "y1") < F.struct("x2", "y2")
    ends = [F.when(forward, F.col(a)).otherwise(F.col(b)).alias(a) for a, b in zip(ENDS, [*ENDS[2:], *ENDS[:2]], strict=True)]
    edges = segments.dropna(subset=ENDS).filter("x1 <> x2 or y1 <> y2").select(*ends).distinct()
    edges = running(edges, [], [F.col(c).asc() for c in ENDS], {}, "edge").select("edge", *ENDS)
    both = F.array(F.struct((F.col("edge") * 2).alias("side"), *ENDS), F.struct((F.col("edge") * 2 + 1).alias("side"), *[F.col(b).alias(a) for a, b in zip(ENDS, [*ENDS[2:], *ENDS[:2]], strict=True)]))
    sides = materialize(edges.select("edge", F.inline(both)), "face-sides")
    traced = materialize(trace(sides), "face-traced")
    split = materialize(traced.groupBy("edge").agg((F.min("face") < F.max("face")).alias("bounds")), "face-edges")
    idle = sides.filter("side % 2 = 0").join(split.filter("not bounds"), "edge").select(*ENDS)
    if not split.filter("not bounds").isEmpty():
        sides = materialize(sides.join(split.filter("bounds"), "edge").drop("bounds"), "face-sides")
        traced = materialize(trace(sides), "face-traced")
    return nested(materialize(rings(traced), "face-rings"), cell), idle
