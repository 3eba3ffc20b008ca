"""Candidate unions, key checks, masks, scenario matrices, weighted picks and service measures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.ranges import running


def union_candidates(sources: dict[str, DataFrame]) -> DataFrame:
    """All rows of ``sources`` by column name, with their ``origin``; columns that one lacks are null."""
    parts = [df.withColumn("origin", F.lit(name)) for name, df in sources.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def key_differences(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """``(key, missing_in)``: keys that only one side has; no rows if the key sets are equal.

    Null keys are equal to each other. Both sides are made distinct before they meet.
    """
    a = left.select(F.col(key)).distinct().withColumn("in_left", F.lit(True))
    b = right.select(F.col(key).alias("__key")).distinct().withColumn("in_right", F.lit(True))
    both = a.join(b, F.col(key).eqNullSafe(F.col("__key")), "full_outer").filter(F.col("in_left").isNull() | F.col("in_right").isNull())
    return both.select(F.coalesce(F.col(key), F.col("__key")).alias(key), F.when(F.col("in_left").isNull(), "left").otherwise("right").alias("missing_in"))


def combine_masks(masks: list[DataFrame], cell: list[str], flag: str) -> DataFrame:
    """``(cell columns, flag)``: whether any mask excludes the cell; a null flag excludes nothing."""
    every = reduce(DataFrame.unionByName, [m.select(*cell, F.coalesce(F.col(flag), F.lit(False)).alias(flag)) for m in masks])
    return every.groupBy(*cell).agg(F.bool_or(flag).alias(flag))


def scenario_matrix(variants: DataFrame, index: str, seeds: list[int]) -> DataFrame:
    """Every variant with every seed; ``position`` follows the variants' index, then the order of the seeds."""
    rows = variants.select("*", F.posexplode(F.array(*[F.lit(s).cast("long") for s in seeds])).alias("__at", "seed"))
    return rows.withColumn("position", F.col(index) * len(seeds) + F.col("__at")).drop("__at")


def weighted_pick(u: Column, weights: dict[str, float]) -> Column:
    """The first name, in the order given, whose running weight exceeds ``u`` (0 to 1) times all weights."""
    total, running, picked = sum(weights.values()), 0.0, []
    for name, weight in weights.items():
        running += weight
        picked.append(F.when(F.lit(running) > u * total, F.lit(name)))
    return F.coalesce(*picked)


def calibrate(rows: DataFrame, zone: str, item: str, population: str, evidence: str, percent: int) -> DataFrame:
    """``(zone, item, population, calibrated)``: a zone's people dealt anew, in part by other evidence.

    An item's share is ``percent`` of its share of the evidence and the rest of its own
    share of the people; without evidence in a zone, its own alone. Units left by the whole
    parts go by falling remainder, then by item. Counts are whole numbers, null and negative
    ones 0, and remainders are compared exactly.
    """
    count = lambda c: F.greatest(F.coalesce(F.col(c).cast("long"), F.lit(0)), F.lit(0))
    r = rows.select(zone, item, count(population).alias(population), count(evidence).alias("__e"))
    sums = r.groupBy(F.col(zone).alias("__zone")).agg(F.sum(population).alias("__people"), F.sum("__e").alias("__all"))
    r = r.join(sums, F.col(zone).eqNullSafe(F.col("__zone"))).drop("__zone")
    wide = lambda c: F.col(c).cast("decimal(18,0)")
    share = wide(population) * wide("__all") * (100 - percent) + wide("__e") * wide("__people") * percent
    whole = wide("__all") * 100
    some = F.col("__all") > 0
    r = r.withColumn("__base", F.when(some, F.floor(share / whole).cast("long")).otherwise(F.col(population)))
    r = r.withColumn("__rest", F.when(some, share - wide("__base") * whole).otherwise(0))
    # A quotient rounded up to the next whole number would leave a negative remainder.
    r = r.withColumn("__base", F.when(F.col("__rest") < 0, F.col("__base") - 1).otherwise(F.col("__base")))
    r = r.withColumn("__rest", F.when(F.col("__rest") < 0, F.col("__rest") + whole).otherwise(F.col("__rest")))
    r = running(r, [zone], [F.col("__rest").desc(), F.col(item).asc()], {"__dealt": "__base"}, "__place")
    spare = F.col("__people") - F.col("__dealt_all")
    return r.select(zone, item, population, (F.col("__base") + F.when(F.col("__place") <= spare, 1).otherwise(0)).alias("calibrated"))


def coverage(rows: DataFrame, group: str, signal: str, served: str, gross: str) -> DataFrame:
    """``(group, coverage)``: the part of all signal whose demand is served, at most all of each; null without signal."""
    part = F.when(F.col(gross) > 0, F.least(F.col(served) / F.col(gross), F.lit(1.0))).otherwise(0.0)
    total = F.sum(signal)
    return rows.groupBy(group).agg(F.when(total != 0, F.sum(F.col(signal) * part) / total).alias("coverage"))


def circuity(edges: DataFrame, group: str, length: str, chord: str) -> DataFrame:
    """``(group, circuity)``: length by chord of the edges that have a chord; null if none has."""
    found = F.col(chord) > 0
    return edges.groupBy(group).agg((F.sum(F.when(found, F.col(length))) / F.sum(F.when(found, F.col(chord)))).alias("circuity"))
