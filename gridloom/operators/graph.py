"""Graph operators over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.tables import discard, materialize


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(node, component)``: the smallest node that each node of an edge reaches.

    Minimum labels spread over the edges, and each round then jumps to the label
    of the label, so long chains close in logarithmically many rounds. Each round
    is written to the shared folder, which cuts the lineage. Edges with a null
    end are ignored; loops give a component of their node alone. The label sides
    of the joins hold one row per node, so a hub is skew on one side only, which
    adaptive execution splits.
    """
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).dropna()
    e = materialize(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-edges")
    labels = e.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label"))
    labels = materialize(labels.withColumn("moved", F.lit(True)), "cc-labels")
    while not labels.filter("moved").isEmpty():
        near = (
            e.join(labels.select(F.col("node").alias("b"), "label"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("label").alias("near"))
        )
        spread = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("mid"))
        jump = labels.select(F.col("node").alias("mid"), F.col("label").alias("far"))
        before, labels = labels, materialize(
            spread.join(jump, "mid").select("node", F.least("mid", "far").alias("label"), (F.least("mid", "far") < F.col("old")).alias("moved")),
            "cc-labels",
        )
        discard(before)
    discard(e)
    return labels.select("node", F.col("label").alias("component"))
