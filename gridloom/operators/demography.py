"""Population targets, cohorts by fixed shares, and sums by block and zone."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def target_total(baseline: Column, rate: str) -> Column:
    """``baseline`` grown by ``rate`` (a decimal as text, over -1), halves rounded up, at least 0."""
    if Decimal(rate) <= -1:
        raise ValueError("a growth rate must be over -1")
    grown = F.round(baseline.cast("decimal(18,0)") * F.lit(Decimal(1) + Decimal(rate)), 0).cast("long")
    return F.greatest(grown, F.lit(0).cast("long"))


def by_shares(total: Column, shares: dict[str, str]) -> Column:
    """``total`` units dealt to the names of ``shares`` (decimals as text): an array of whole numbers in their order.

    Each gets the whole part of its quota; units left go by falling remainder, then by
    order. The shares are a fixed list, so a row is dealt by itself; remainders are exact.
    """
    weights = [Decimal(s) for s in shares.values()]
    if min(weights) < 0 or sum(weights) <= 0:
        raise ValueError("shares must not be negative and must have a positive sum")
    digits = max(0, -min(w.as_tuple().exponent for w in weights))
    units = [int(w * 10**digits) for w in weights]
    whole = sum(units)
    n = F.greatest(F.coalesce(total.cast("long"), F.lit(0)), F.lit(0).cast("long"))
    quotas = F.array(*[F.struct(F.call_function("div", n * u, F.lit(whole)).alias("base"), F.pmod(n * u, F.lit(whole)).alias("rest"), F.lit(i).alias("place")) for i, u in enumerate(units)])
    base = F.transform(quotas, lambda q: q["base"])
    left = n - F.aggregate(base, F.lit(0).cast("long"), lambda a, b: a + b)
    order = F.transform(F.array_sort(F.transform(quotas, lambda q: F.struct((-q["rest"]).alias("rest"), q["place"].alias("place")))), lambda q: q["place"])
    more = F.slice(order, F.lit(1), left.cast("int"))
    return F.transform(base, lambda b, i: b + F.array_contains(more, i).cast("long"))


def members(buildings: DataFrame, group: list[str], cohorts: list[str], population: str = "population", jobs: str = "jobs") -> DataFrame:
    """``group`` columns, ``buildings``, ``population``, the sum of every cohort, and ``jobs``; null counts as 0."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in [population, *cohorts, jobs]]
    return buildings.groupBy(*group).agg(F.count("*").alias("buildings"), *sums)


def densities(groups: DataFrame, keep: list[str], cohorts: list[str], area_m2: str, population: str = "population") -> DataFrame:
    """``keep``, people a square kilometre, and each cohort's share as ``<cohort>_share``; null without an area or people."""
    people = F.col(population)
    shares = [F.when(people > 0, F.col(c) / people).alias(f"{c}_share") for c in cohorts]
    return groups.select(*keep, F.when(F.col(area_m2) > 0, people * 1_000_000 / F.col(area_m2)).alias("density_per_km2"), *shares)


def allocation(target: Column, baseline: Column, capacity: Column) -> Column:
    """``struct<status, generated, allocated, unmet, excess>``: people to place beside the ``baseline``, and how many find room.

    The target less the baseline is to be generated; as many as ``capacity`` are allocated, the others unmet. A baseline beyond the target is the
    excess. The states are fixed names.
    """
    zero = F.lit(0).cast("long")
    generated, excess = F.greatest(target - baseline, zero), F.greatest(baseline - target, zero)
    allocated = F.least(generated, F.greatest(capacity, zero))
    status = F.when(excess > 0, "BASELINE_EXCEEDS_TARGET").when(allocated == generated, "TARGET_MET").otherwise("CAPACITY_EXHAUSTED")
    return F.struct(status.alias("status"), generated.alias("generated"), allocated.alias("allocated"), (generated - allocated).alias("unmet"), excess.alias("excess"))
