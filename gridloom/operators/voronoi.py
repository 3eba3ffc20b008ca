"""Voronoi cells of seeds by half-planes, in rounds of growing neighbourhoods, and classes dealt to cells."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.geometry import _sides, area, box
from gridloom.operators.spatial import nearest, spacing
from gridloom.operators.tables import discard, materialize


def nearer(r: Column, x: Column, y: Column, ox: Column, oy: Column) -> Column:
    """The part of a convex ring at least as near to (x, y) as to (ox, oy)."""
    a, b = ox - x, oy - y
    middle = (ox * ox + oy * oy - x * x - y * y) / 2
    point = lambda u, v: F.struct(u.alias("x"), v.alias("y"))

    def kept(px, py, qx, qy):
        p, q = middle - a * px - b * py, middle - a * qx - b * qy
        t = F.try_divide(p, p - q)
        meet = point(px + t * (qx - px), py + t * (qy - py))
        return F.when((p >= 0) & (q >= 0), F.array(point(qx, qy))).when(p >= 0, F.array(meet)).when(q >= 0, F.array(meet, point(qx, qy))).otherwise(F.array().cast("array<struct<x: double, y: double>>"))

    return F.flatten(_sides(r, kept))


def cells(seeds: DataFrame, x0: float, y0: float, x1: float, y1: float, cell: float) -> DataFrame:
    """``(seed, x, y, ring, area)``: the part of the rectangle that is nearer to each of ``seeds (seed, x, y)`` than to the others.

    A seed's ring is cut by the seeds of its own and the eight neighbouring cells of a grid, those first that are near. It is
    done when no corner is farther than half the distance within which all seeds were seen; the others see a grid twice as wide in the
    next round. So ``cell`` should fit the densest area, and sparse ones take a logarithmic number of rounds. A seed's
    neighbours of one round are in one row; only those within twice the reach of its ring so far are taken.
    Of seeds at the same place the smallest counts; seeds outside the rectangle or without coordinates are left out.
    """
    known = seeds.filter(F.col("x").between(x0, x1) & F.col("y").between(y0, y1)).groupBy("x", "y").agg(F.min("seed").alias("seed")).select("seed", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    known = materialize(known, "voronoi-seeds")
    whole = box(*[F.lit(float(v)) for v in (x0, y0, x1, y1)])
    reach = lambda ring: F.array_max(F.transform(ring, lambda p: F.hypot(p["x"] - F.col("x"), p["y"] - F.col("y"))))
    open_ = materialize(known.withColumn("ring", whole), "voronoi-open")
    done, widest = None, 2 * max(x1 - x0, y1 - y0)
    around = F.explode(F.expr("flatten(transform(sequence(-1, 1), i -> transform(sequence(-1, 1), j -> struct(i as i, j as j))))"))
    while not open_.isEmpty():
        index = lambda c: F.floor(F.col(c) / cell)  # noqa: B023, E731
        mine = open_.withColumn("far", 2 * reach(F.col("ring"))).select("seed", "x", "y", "far", index("x").alias("cx"), index("y").alias("cy"), around.alias("o"))
        mine = mine.select("seed", "x", "y", "far", (F.col("cx") + F.col("o.i")).alias("cx"), (F.col("cy") + F.col("o.j")).alias("cy"))
        others = known.select(F.col("seed").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"), index("x").alias("cx"), index("y").alias("cy"))
        distance = F.hypot(F.col("ox") - F.col("x"), F.col("oy") - F.col("y"))
        near = mine.join(others, ["cx", "cy"]).filter("seed <> other").withColumn("d", distance).filter("d <= far")
        lists = near.groupBy("seed").agg(F.array_sort(F.collect_list(F.struct("d", "ox", "oy"))).alias("near"))
        cut = F.aggregate(F.coalesce("near", F.array().cast("array<struct<d: double, ox: double, oy: double>>")), F.col("ring"), lambda r, n: nearer(r, F.col("x"), F.col("y"), n["ox"], n["oy"]))
        state = open_.join(lists, "seed", "left").select("seed", "x", "y", cut.alias("ring"))
        state = materialize(state.withColumn("done", (2 * reach(F.col("ring")) <= cell) | F.lit(cell > widest)), "voronoi-rings")
        found = state.filter("done").drop("done")
        done = found if done is None else done.unionByName(found)
        before, open_ = open_, materialize(state.filter("not done").drop("done"), "voronoi-open")
        discard(before)
        cell *= 2
    done = open_ if done is None else done
    return done.withColumn("area", area(F.col("ring")))


def members(points: DataFrame, seeds: DataFrame) -> DataFrame:
    """``(id, seed)``: the cell that each of ``points (id, x, y)`` lies in, which is that of its nearest of ``seeds (seed, x, y)``; ties go to the smallest.

    The search begins with the seeds' mean spacing, so no cells are built and a point meets the seeds around it only.
    """
    right = materialize(seeds.select(F.col("seed").alias("id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")), "member-seeds")
    return nearest(points, right, spacing(right)).select(F.col("left_id").alias("id"), F.col("right_id").alias("seed"))


def assign_classes(parts: DataFrame, shares: dict[str, float], group: str = "run") -> DataFrame:
    """``parts (group, cell, seed, area, score)`` with ``zone_class``: cells go by falling score (then seed) to the class whose target area lacks most.

    Targets are ``shares`` of the group's whole area, and ties go to the larger share and then to the order of ``shares``. Each cell depends on
    all before it, so a group is walked in order by one task, as a stream that holds one number a class.
    """
    names, weights = list(shares), [float(s) for s in shares.values()]
    totals = parts.groupBy(F.col(group).alias("__g")).agg(F.sum("area").alias("__total"))
    rows = parts.join(totals, F.col(group).eqNullSafe(F.col("__g"))).drop("__g")
    rows = rows.repartition(group).sortWithinPartitions(group, F.col("score").desc(), "seed")
    columns = parts.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, used = object(), []
        for batch in batches:
            groups, sizes, totals = (batch.column(c).to_pylist() for c in (group, "area", "__total"))
            picked = []
            for g, size, total in zip(groups, sizes, totals, strict=True):
                if g != last:
                    last, used = g, [0.0] * len(names)
                lacking = [(total * w - u, w, -i) for i, (w, u) in enumerate(zip(weights, used, strict=True))]
                best = -max(lacking)[2]
                used[best] += size
                picked.append(names[best])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(picked, pa.string())], [*columns, "zone_class"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema.fields)
    return rows.mapInArrow(run, f"{schema}, zone_class string")


def share_diagnostics(assigned: DataFrame, shares: dict[str, float], group: str = "run") -> DataFrame:
    """``(group, zone_class, cells, area, target, error)`` of every class of ``shares``, also of those without a cell."""
    listed = F.array(*[F.struct(F.lit(n).alias("zone_class"), F.lit(float(s)).alias("share")) for n, s in shares.items()])
    wanted = assigned.groupBy(group).agg(F.sum("area").alias("total")).select(group, "total", F.inline(listed))
    held = assigned.groupBy(F.col(group).alias("__g"), F.col("zone_class").alias("__c")).agg(F.count("*").alias("cells"), F.sum("area").alias("area"))
    rows = wanted.join(held, F.col(group).eqNullSafe(F.col("__g")) & (F.col("zone_class") == F.col("__c")), "left")
    target, found = F.col("total") * F.col("share"), F.coalesce("area", F.lit(0.0))
    return rows.select(group, "zone_class", F.coalesce("cells", F.lit(0).cast("long")).alias("cells"), found.alias("area"), target.alias("target"), F.abs(found - target).alias("error"))
