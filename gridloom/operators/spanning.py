"""Spanning trees and clusters of points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.graph import connected_components
from gridloom.operators.spatial import within_distance
from gridloom.operators.tables import discard, materialize


def minimum_spanning_forest(edges: DataFrame) -> DataFrame:
    """The edges ``(edge, src, dst, length)`` of the lightest forest that connects what ``edges`` connects.

    Each round every tree takes its lightest edge to another one (ties: the smallest edge),
    and trees that are joined become one, so rounds grow with the logarithm of the nodes.
    Edges that end inside a tree drop out. Loops, and edges with a null end or length, are left out.
    """
    good = edges.select("edge", "src", "dst", F.col("length").cast("double").alias("length")).dropna().filter("src != dst")
    left = materialize(good.select("*", F.col("src").alias("a"), F.col("dst").alias("b")), "spanning-edges")
    taken = None
    while not left.isEmpty():
        ends = left.select(F.explode(F.array("a", "b")).alias("tree"), F.struct("length", "edge", "src", "dst", "a", "b").alias("e"))
        best = materialize(ends.groupBy("tree").agg(F.min("e").alias("e")).select("e.*").distinct(), "spanning-best")
        parts = materialize(connected_components(best, "a", "b"), "spanning-parts")
        chosen = best.select("edge", "src", "dst", "length")
        taken = chosen if taken is None else taken.unionByName(chosen)
        to = lambda end: parts.select(F.col("node").alias(end), F.col("component").alias(f"{end}2"))  # noqa: B023, E731
        after = left.join(to("a"), "a").join(to("b"), "b").filter("a2 != b2").select("edge", "src", "dst", "length", F.col("a2").alias("a"), F.col("b2").alias("b"))
        before, left = left, materialize(after, "spanning-edges")
        discard(before, parts)
    return taken if taken is not None else good.select("edge", "src", "dst", "length")


def snapped(points: DataFrame, tolerance: float) -> DataFrame:
    """``(id, cluster, x, y)``: points ``(id, x, y)`` moved to the place of the smallest id of their cluster.

    Points at most ``tolerance`` apart are in one cluster, and so are chains of them.
    """
    near = within_distance(points, points, tolerance).filter("left_id < right_id")
    parts = connected_components(near, "left_id", "right_id")
    placed = points.select("id").join(parts, F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("cluster"))
    return placed.join(points.select(F.col("id").alias("cluster"), "x", "y"), "cluster").select("id", "cluster", "x", "y")
