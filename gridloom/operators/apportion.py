"""Exact integer apportionment, running totals and weighted percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.ranges import running


def largest_remainder(rows: DataFrame, group: str, item: str, capacity: str, total: int) -> DataFrame:
    """``(group, item, capacity, allocated)``: ``total`` units a group, in proportion to integer capacities.

    Everyone gets the whole part of its quota; the units left go one each by falling
    remainder, then by item. Null and negative capacities count as 0; a group without
    capacity gets nothing.
    """
    r = rows.select(group, item, F.greatest(F.coalesce(F.col(capacity).cast("long"), F.lit(0)), F.lit(0)).alias(capacity))
    sums = r.groupBy(F.col(group).alias("__group")).agg(F.sum(capacity).alias("whole"))
    r = r.join(sums, F.col(group).eqNullSafe(F.col("__group"))).withColumn("quota", F.col(capacity) * F.lit(total).cast("long"))
    base, rest = F.expr("if(whole > 0, quota div whole, 0L)"), F.expr("if(whole > 0, quota % whole, 0L)")
    r = running(r.select(group, item, capacity, "whole", base.alias("base"), rest.alias("rest")), [group], [F.col("rest").desc(), F.col(item).asc()], {"dealt": "base"})
    spare = F.when(F.col("whole") > 0, F.lit(total) - F.col("dealt_all")).otherwise(0)
    return r.select(group, item, capacity, (F.col("base") + F.when(F.col("place") <= spare, 1).otherwise(0)).alias("allocated"))


def serve_in_order(demand: Column, capacity: Column, *partition: str, order: list[Column]) -> Column:
    """What each demand gets of a shared capacity, first come first served."""
    before = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.least(demand, F.greatest(F.lit(0.0), capacity - F.coalesce(F.sum(demand).over(before), F.lit(0.0))))


def weighted_percentile(rows: DataFrame, group: str, value: str, weight: str, q: float) -> DataFrame:
    """``(group, percentile)``: the first value at which the running weight reaches ``q`` of all.

    Weights are summed by value first, so hot values are combined before the shuffle.
    """
    sums = rows.dropna(subset=[value, weight]).groupBy(group, value).agg(F.sum(weight).alias("w"))
    sums = running(sums, [group], [F.col(value).asc()], {"sum": "w"})
    return sums.filter((F.col("sum") >= F.col("sum_all") * q) & (F.col("sum_all") > 0)).groupBy(group).agg(F.min(value).alias("percentile"))
