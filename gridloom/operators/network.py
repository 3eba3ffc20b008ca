"""Networks as edge tables ``(src, dst, length)``: nearest sources, least-cost rasters, pruning, degrees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators import paths
from gridloom.operators.tables import discard, materialize


def nearest_sources(edges: DataFrame, sources: DataFrame, max_distance: float, bands: int = 4) -> DataFrame:
    """``(node, distance, origin)``: the nearest of ``sources (node)`` for each node within ``max_distance``.

    Edges go both ways; of parallel ones the shortest counts. Ties go to the smallest
    origin. Distances are settled in ``bands``, and nodes of a settled band are not touched again (see ``paths.search``).
    Edges with a null end, or a length that is null or negative, are ignored.
    """
    found = paths.search(edges, sources.select(F.lit(1).alias("search"), "node"), max_distance, max_distance / bands if max_distance > 0 else 1.0)
    return found.select("node", "distance", "origin")


def raster_edges(cells: DataFrame, cell_size: float, weight: float, diagonal: bool = False) -> DataFrame:
    """Edges between neighbouring cells ``(row, col, score)`` with scores in 0 to 1.

    A step costs its length by the mean of ``1 + weight * (1 - score)`` of both cells. Cells
    without a score cannot be entered. With ``diagonal`` cells have eight neighbours instead of
    four, and a diagonal step needs a score in both cells beside it. Nodes are ``row << 32 | col``.
    """
    c = cells.dropna(subset=["row", "col", "score"]).select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), (1 + weight * (1 - F.col("score"))).alias("cost"))
    node = lambda dr, dc: F.shiftleft(F.col("row") + dr, 32).bitwiseOR(F.col("col") + dc)
    here = c.select(node(0, 0).alias("dst"), F.col("cost").alias("cost2"))
    steps = [(1, 0), (0, 1), (1, 1), (1, -1)] if diagonal else [(1, 0), (0, 1)]
    way = [F.struct(node(dr, dc).alias("dst"), F.lit(float((dr * dr + dc * dc) ** 0.5)).alias("steps"), (node(dr, 0) if dr and dc else F.lit(None).cast("long")).alias("left"), (node(0, dc) if dr and dc else F.lit(None).cast("long")).alias("right")) for dr, dc in steps]
    sent = c.select(node(0, 0).alias("src"), "cost", F.inline(F.array(*way)))
    open_ = here.select(F.col("dst").alias("cell"))
    for side in ("left", "right") if diagonal else ():
        straight, turned = sent.filter(F.col(side).isNull()), sent.filter(F.col(side).isNotNull())
        sent = straight.unionByName(turned.join(open_, F.col(side) == F.col("cell"), "left_semi"))
    return sent.join(here, "dst").select("src", "dst", (F.lit(cell_size) * F.col("steps") * (F.col("cost") + F.col("cost2")) / 2).alias("length"))


def degrees(edges: DataFrame) -> DataFrame:
    """``(node, degree)``; a loop counts twice."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node"))
    return ends.dropna().groupBy("node").agg(F.count("*").alias("degree"))


def prune_dangling(edges: DataFrame, shortest: float, passes: int = 16) -> DataFrame:
    """``edges (edge, src, dst, length, fixed)`` without short dead ends.

    Each pass removes the edges under ``shortest`` that are not fixed and have an end of
    degree 1, all at once, until none is left or after ``passes``.
    """
    left = materialize(edges, "network-prune")
    for _ in range(passes):
        dead = degrees(left).filter("degree = 1").select("node")
        ends = left.filter((F.col("length") < shortest) & ~F.col("fixed")).select("edge", F.explode(F.array("src", "dst")).alias("node"))
        gone = materialize(ends.join(dead, "node").select("edge").distinct(), "network-gone")
        if gone.isEmpty():
            break
        before, left = left, materialize(left.join(gone, "edge", "left_anti"), "network-prune")
        discard(before, gone)
    return left
