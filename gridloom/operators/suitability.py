"""Weighted suitability of raster cells: factors, scores and their statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.ranges import running


@dataclass(frozen=True)
class Factor:
    """A column of raw values, its weight, and how it becomes a number from 0 to 1.

    ``kind``: ``identity`` (values are from 0 to 1 already), ``min_max`` or ``inverted``
    (clipped to ``lower`` and ``upper``).
    """

    column: str
    weight: float
    kind: str = "identity"
    lower: float | None = None
    upper: float | None = None


def factor_value(factor: Factor) -> Column:
    """The value from 0 to 1; null where the cell has none. Fails on identity values outside 0 to 1."""
    v = F.col(factor.column).cast("double")
    v = F.when(~F.isnan(v), v)
    if factor.kind == "identity":
        return F.when((v >= 0) & (v <= 1), v).when(v.isNotNull(), F.raise_error(F.lit(f"{factor.column}: a value outside 0 to 1")).cast("double"))
    scaled = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v - factor.lower) / (factor.upper - factor.lower)))
    scaled = F.when(v.isNotNull(), scaled)
    if factor.kind == "min_max":
        return scaled
    if factor.kind == "inverted":
        return 1 - scaled
    raise ValueError(f"unknown kind: {factor.kind}")


def class_score(value: Column, scores: dict[str, float], default: float | None = None) -> Column:
    """The score of a class; unknown classes get ``default`` (null: no value), null stays null."""
    out = F.when(value.isNotNull(), F.lit(default).cast("double"))
    for name, score in scores.items():
        out = F.when(value == name, float(score)).otherwise(out)
    return out


def weighted(cells: DataFrame, factors: list[Factor], excluded: str = "excluded") -> DataFrame:
    """``(row, col, score, valid, excluded)``: the weighted mean of the factors of positive weight.

    A cell is valid if it is not excluded and has every such factor; others score 0. Missing
    factors never shift weight to the others. A null flag excludes nothing.
    """
    used = [f for f in factors if f.weight > 0]
    if not used or min(f.weight for f in factors) < 0:
        raise ValueError("weights must not be negative and one must be positive")
    total, score = sum(f.weight for f in factors), F.lit(0.0)
    for f in used:
        score = score + factor_value(f) * (f.weight / total)
    flag = F.coalesce(F.col(excluded), F.lit(False))
    scored = cells.select("row", "col", score.alias("score"), flag.alias("excluded"))
    valid = ~F.col("excluded") & F.col("score").isNotNull()
    return scored.select("row", "col", F.when(valid, F.greatest(F.lit(0.0), F.least(F.lit(1.0), "score"))).otherwise(0.0).alias("score"), valid.alias("valid"), "excluded")


def quantiles(rows: DataFrame, value: str, qs: dict[str, float]) -> DataFrame:
    """One row with the quantiles of ``value``, linear between neighbours; null values are left out.

    Equal values are counted before they are put in order, so they may be any share of the rows.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("__n"))
    placed = running(counts, [], [F.col(value).asc()], {"__upto": "__n"})
    at = lambda q: q * (F.col("__upto_all") - 1)
    holds = lambda place: (F.col("__upto") - F.col("__n") < place) & (place <= F.col("__upto"))
    sides = []
    for name, q in qs.items():
        low = F.floor(at(q)) + 1
        sides += [
            F.max(F.when(holds(low), F.col(value))).alias(f"__low_{name}"),
            F.max(F.when(holds(F.least(low + 1, F.col("__upto_all"))), F.col(value))).alias(f"__high_{name}"),
            F.max(at(q) - F.floor(at(q))).alias(f"__part_{name}"),
        ]
    one = placed.agg(*sides)
    return one.select(*[(F.col(f"__low_{n}") + F.col(f"__part_{n}") * (F.col(f"__high_{n}") - F.col(f"__low_{n}"))).alias(n) for n in qs])


def statistics(scores: DataFrame, threshold: float) -> DataFrame:
    """One row: cells, valid, excluded and invalid ones, those of ``threshold`` or more, and the spread of valid scores."""
    valid = F.when(F.col("valid"), F.col("score"))
    counts = scores.agg(
        F.count("*").alias("cells"), F.count_if("valid").alias("valid"), F.count_if("excluded").alias("excluded"), F.count_if(~F.col("valid") & ~F.col("excluded")).alias("invalid"),
        F.count_if(valid >= threshold).alias("suitable"), F.min(valid).alias("least"), F.max(valid).alias("most"), F.avg(valid).alias("mean"),
    )
    return counts.crossJoin(quantiles(scores.select(valid.alias("score")), "score", {"p05": 0.05, "p50": 0.5, "p95": 0.95}))  # one row each
