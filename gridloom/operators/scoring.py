"""Metric normalisation, composite scores, ranks and sensitivity of runs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.ranges import competition_rank, running


@dataclass(frozen=True)
class Policy:
    """How one metric becomes a number from 0 to 1.

    ``direction``: ``higher``, ``lower`` or ``target`` (1 between ``target_lower`` and
    ``target_upper``, falling to 0 at ``lower`` and ``upper``). ``clamp``: values outside
    the bounds are clamped, else they count as missing. ``missing_as_worst``: missing
    values become 0, else they stay null.
    """

    metric: str
    direction: str
    lower: float
    upper: float
    target_lower: float | None = None
    target_upper: float | None = None
    clamp: bool = True
    missing_as_worst: bool = False


def normalize(value: Column, policy: Policy) -> Column:
    """The normalised value; null where it is missing or out of bounds without clamping."""
    lo, hi = F.lit(policy.lower), F.lit(policy.upper)
    v = value.cast("double")
    inside = F.when(F.isnan(v), None).otherwise(F.greatest(lo, F.least(hi, v)) if policy.clamp else F.when(v.between(lo, hi), v))
    if policy.direction == "higher":
        out = (inside - lo) / (hi - lo)
    elif policy.direction == "lower":
        out = (hi - inside) / (hi - lo)
    elif policy.direction == "target":
        a, b = F.lit(policy.target_lower), F.lit(policy.target_upper)
        out = F.when(inside.between(a, b), 1.0).when(inside < a, (inside - lo) / (a - lo)).otherwise((hi - inside) / (hi - b))
        out = F.when(inside.isNotNull(), out)
    else:
        raise ValueError(f"unknown direction: {policy.direction}")
    return F.coalesce(out, F.lit(0.0)) if policy.missing_as_worst else out


def exact_sum(value: Column, digits: int = 9) -> Column:
    """The sum of values rounded to ``digits``, the same in whatever order the rows come, so that equal rows sum to equal numbers.

    Groups with a value that such decimals (of 38 digits in all) do not hold, as NaN, are summed as doubles.
    """
    exact = value.try_cast(f"decimal(38, {digits})")
    return F.when(F.count(value) == F.count(exact), F.try_sum(exact).cast("double")).otherwise(F.sum(value))


def was_clamped(value: Column, policy: Policy) -> Column:
    v = value.cast("double")
    return F.coalesce(F.lit(policy.clamp) & ((v < policy.lower) | (v > policy.upper)), F.lit(False))


def unpivot(runs: DataFrame, run: str, policies: list[Policy]) -> DataFrame:
    """``(run, metric_id, raw_value, normalized_value, was_clamped, was_missing)``."""
    rows = F.array(*[
        F.struct(
            F.lit(p.metric).alias("metric_id"), F.col(p.metric).cast("double").alias("raw_value"), normalize(F.col(p.metric), p).alias("normalized_value"),
            was_clamped(F.col(p.metric), p).alias("was_clamped"), F.col(p.metric).isNull().alias("was_missing"),
        )
        for p in policies
    ])
    return runs.select(run, F.inline(rows))


def composite(values: DataFrame, run: str, weights: dict[str, float], value: str = "normalized_value") -> DataFrame:
    """``(run, score)``: the weighted mean of the normalised metrics; null if one is missing.

    Missing metrics never shift weight to the others.
    """
    total = sum(weights.values())
    if total <= 0 or min(weights.values()) < 0:
        raise ValueError("weights must not be negative and must have a positive sum")
    weight = F.create_map(*[x for k, w in weights.items() for x in (F.lit(k), F.lit(w / total))])[F.col("metric_id")]
    known = values.filter(F.col("metric_id").isin(*weights))
    sums = known.groupBy(run).agg(F.sum(F.col(value) * weight).alias("score"), F.count(value).alias("n"))
    return sums.select(run, F.when(F.col("n") == len(weights), F.col("score")).alias("score"))


def metric_ranks(values: DataFrame, policies: list[Policy]) -> DataFrame:
    """``values`` with ``rank`` within each metric: 1, 2, 2, 4, ... from the best raw value on.

    Missing values, and metrics whose direction is a target, have no rank.
    """
    better = {p.metric: p.direction for p in policies}
    raw, of = F.col("raw_value"), lambda d: F.col("metric_id").isin(*[m for m, x in better.items() if x == d])
    keyed = values.withColumn("__key", F.when(of("higher"), -raw).when(of("lower"), raw))
    return competition_rank(keyed, "__key", ["metric_id"], rising=True).drop("__key")


def sensitivity(values: DataFrame, run: str, weights: dict[str, float], perturbations: dict[str, dict[str, float]], digits: int = 9) -> DataFrame:
    """``(perturbation, run, score, rank, score_delta, rank_delta)`` under changed weights.

    Each perturbation multiplies every weight by its factor; ``baseline`` leaves them.
    Runs rank 1, 2, 3, ... by falling score, then by run; ``rank_delta`` is the baseline's rank
    less the new one. A run without a value that has weight has a null score and no rank.
    """
    every = {"baseline": dict.fromkeys(weights, 1.0), **perturbations}
    if any(set(f) != set(weights) or min(f.values()) < 0 for f in every.values()):
        raise ValueError("a perturbation needs one factor of 0 or more for each weight")
    scores = []
    for name, factors in every.items():
        changed = {m: w * factors[m] for m, w in weights.items()}
        total = sum(changed.values())
        if total <= 0:
            raise ValueError(f"no weight is left: {name}")
        used = {m: w / total for m, w in changed.items() if w > 0}
        share = F.create_map(*[x for m, w in used.items() for x in (F.lit(m), F.lit(w))])[F.col("metric_id")]
        found = F.count(F.when(F.col("metric_id").isin(*used), F.col("normalized_value"))) == len(used)
        scores.append(F.struct(F.lit(name).alias("perturbation"), F.round(F.when(found, F.sum(F.col("normalized_value") * share)), digits).alias("score")))
    rows = values.groupBy(run).agg(*[s.alias(f"s{i}") for i, s in enumerate(scores)]).select(run, F.inline(F.array(*[f"s{i}" for i in range(len(scores))])))
    ranked = running(rows, ["perturbation"], [F.col("score").desc_nulls_last(), F.col(run).asc()], {}, "rank")
    ranked = ranked.select("perturbation", run, "score", F.when(F.col("score").isNotNull(), F.col("rank")).alias("rank"))
    base = ranked.filter("perturbation = 'baseline'").select(F.col(run).alias("__run"), F.col("score").alias("__score"), F.col("rank").alias("__rank"))
    both = ranked.join(base, F.col(run) == F.col("__run"))
    return both.select("perturbation", run, "score", "rank", F.round(F.col("score") - F.col("__score"), digits).alias("score_delta"), (F.col("__rank") - F.col("rank")).alias("rank_delta"))
