"""Demand for infrastructure by block and type, what is served of it, and access to facilities."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class DemandType:
    """A type of infrastructure: ``rate`` units of demand for each unit of the column ``signal``."""

    code: str
    category: str
    signal: str
    rate: float


def unmet(blocks: DataFrame, types: list[DemandType], served: DataFrame, block: str = "block") -> DataFrame:
    """``(block, type, category, signal, gross, served, unmet)`` of every block and type.

    ``served``: (block, type, served), summed by both. Null signals count as 0. Fails where more
    is served than demanded, beyond rounding. The types are a fixed list, so blocks are
    stacked in place and meet only what is served to them.
    """
    stacked = F.inline(F.array(*[
        F.struct(
            F.lit(t.code).alias("type"), F.lit(t.category).alias("category"), F.coalesce(F.col(t.signal).cast("double"), F.lit(0.0)).alias("signal"),
            (F.coalesce(F.col(t.signal).cast("double"), F.lit(0.0)) * t.rate).alias("gross"),
        )
        for t in types
    ]))
    got = served.groupBy(F.col(block).alias("__block"), F.col("type").alias("__type")).agg(F.sum("served").cast("double").alias("__served"))
    rows = blocks.select(block, stacked).join(got, (F.col(block) == F.col("__block")) & (F.col("type") == F.col("__type")), "left")
    given = F.coalesce("__served", F.lit(0.0))
    beyond = given - F.col("gross") > F.greatest(F.lit(1e-9), F.col("gross") * 1e-12)
    checked = F.when(beyond, F.raise_error(F.lit("more is served than demanded")).cast("double")).otherwise(F.least(given, F.col("gross")))
    return rows.select(block, "type", "category", "signal", "gross", checked.alias("served")).withColumn("unmet", F.greatest(F.col("gross") - F.col("served"), F.lit(0.0)))


def summary(demands: DataFrame, facilities: DataFrame) -> DataFrame:
    """``(type, category, gross, served, unmet, capacity, utilization)``; ``facilities``: (type, capacity).

    Types without a facility have capacity 0 and no utilization.
    """
    sums = demands.groupBy("type", "category").agg(F.sum("gross").alias("gross"), F.sum("served").alias("served"), F.sum("unmet").alias("unmet"))
    held = facilities.groupBy(F.col("type").alias("__type")).agg(F.sum("capacity").cast("double").alias("capacity"))
    both = sums.join(held, F.col("type") == F.col("__type"), "left").withColumn("capacity", F.coalesce("capacity", F.lit(0.0)))
    return both.select("type", "category", "gross", "served", "unmet", "capacity", F.when(F.col("capacity") > 0, F.col("served") / F.col("capacity")).alias("utilization"))


def block_payload(demands: DataFrame, block: str = "block") -> DataFrame:
    """``(block, gross, unmet, coverage, items)``: sums of a block, and its types as a list by code."""
    item = F.struct("type", "gross", "unmet")
    sums = demands.groupBy(block).agg(F.sum("gross").alias("gross"), F.sum("unmet").alias("unmet"), F.array_sort(F.collect_list(item)).alias("items"))
    return sums.select(block, "gross", "unmet", F.when(F.col("gross") > 0, 1 - F.col("unmet") / F.col("gross")).alias("coverage"), "items")


def access_summary(routes: DataFrame, facility: str, distance: str) -> DataFrame:
    """``(facility, reached, nearest, farthest)`` over the demands that a facility reaches."""
    return routes.groupBy(facility).agg(F.count(distance).alias("reached"), F.min(distance).alias("nearest"), F.max(distance).alias("farthest"))
