"""Scores and ranks of suppliers, who stand for runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators.ranges import competition_rank
from gridloom.operators.scoring import Policy, composite, exact_sum, metric_ranks, sensitivity, unpivot
from gridloom.plans.catalog import query, table

POLICIES = [
    Policy("revenue", "higher", 0.0, 3_000_000.0),
    Policy("quantity", "lower", 0.0, 20_000.0),
    Policy("discount", "target", 0.0, 0.1, 0.045, 0.055, missing_as_worst=True),
]
WEIGHTS = {"revenue": 3.0, "quantity": 1.0, "discount": 2.0}

RUNS_SQL = """
runs AS (SELECT l_suppkey, sum(l_extendedprice * (1 - l_discount)) AS revenue, sum(l_quantity) AS quantity, avg(l_discount) AS discount FROM lineitem GROUP BY l_suppkey),
norm AS (
  SELECT l_suppkey, least(greatest(revenue, 0), 3000000) / 3000000 AS revenue, (20000 - least(greatest(quantity, 0), 20000)) / 20000 AS quantity,
         CASE WHEN discount BETWEEN 0.045 AND 0.055 THEN 1.0 WHEN discount < 0.045 THEN greatest(discount, 0) / 0.045 ELSE (0.1 - least(discount, 0.1)) / 0.045 END AS discount
  FROM runs)
"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy("l_suppkey").agg(
        exact_sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"), exact_sum(F.col("l_quantity")).alias("quantity"), F.avg("l_discount").alias("discount")
    )


@query("score_rank", f"WITH {RUNS_SQL}, s AS (SELECT l_suppkey, round((3 * revenue + quantity + 2 * discount) / 6, 6) AS score FROM norm) SELECT l_suppkey, score, rank() OVER (ORDER BY score DESC)::INTEGER AS rank FROM s")
def score_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = composite(unpivot(runs(spark, sf_dir), "l_suppkey", POLICIES), "l_suppkey", WEIGHTS).withColumn("score", F.round("score", 6))
    return competition_rank(scored, "score")


@query("metric_values", f"WITH {RUNS_SQL} SELECT l_suppkey, metric_id, round(normalized_value, 6) AS normalized_value FROM (SELECT l_suppkey, 'revenue' AS metric_id, revenue AS normalized_value FROM norm UNION ALL SELECT l_suppkey, 'quantity', quantity FROM norm UNION ALL SELECT l_suppkey, 'discount', discount FROM norm)")
def metric_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unpivot(runs(spark, sf_dir), "l_suppkey", POLICIES).select("l_suppkey", "metric_id", F.round("normalized_value", 6).alias("normalized_value"))


PERTURBATIONS = {
    "no_revenue": {"revenue": 0.0, "quantity": 1.0, "discount": 1.0},
    "more_discount": {"revenue": 1.0, "quantity": 1.0, "discount": 1.5},
    "less_revenue": {"revenue": 0.8, "quantity": 1.0, "discount": 1.0},
}


@query("score_sensitivity", f"""
WITH {RUNS_SQL}, p(perturbation, a, b, c) AS (VALUES ('baseline', 1.0::DOUBLE, 1.0::DOUBLE, 1.0::DOUBLE), ('no_revenue', 0, 1, 1), ('more_discount', 1, 1, 1.5), ('less_revenue', 0.8, 1, 1)),
s AS (SELECT perturbation, l_suppkey, round((3 * a * revenue + b * quantity + 2 * c * discount) / (3 * a + b + 2 * c), 9) AS score FROM norm, p),
r AS (SELECT *, row_number() OVER (PARTITION BY perturbation ORDER BY score DESC, l_suppkey) AS rank FROM s)
SELECT r.perturbation, r.l_suppkey, r.score, r.rank::BIGINT AS rank, round(r.score - o.score, 9) AS score_delta, (o.rank - r.rank)::BIGINT AS rank_delta
FROM r JOIN r o ON o.l_suppkey = r.l_suppkey AND o.perturbation = 'baseline'""")
def score_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sensitivity(unpivot(runs(spark, sf_dir), "l_suppkey", POLICIES), "l_suppkey", WEIGHTS, PERTURBATIONS)


@query("metric_ranks", f"""
WITH {RUNS_SQL}, v AS (SELECT l_suppkey, 'revenue' AS metric_id, -revenue AS k FROM runs UNION ALL SELECT l_suppkey, 'quantity', quantity FROM runs UNION ALL SELECT l_suppkey, 'discount', NULL FROM runs)
SELECT l_suppkey, metric_id, CASE WHEN k IS NOT NULL THEN rank() OVER (PARTITION BY metric_id ORDER BY k) END::INTEGER AS rank FROM v""")
def ranks_by_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_ranks(unpivot(runs(spark, sf_dir), "l_suppkey", POLICIES), POLICIES).select("l_suppkey", "metric_id", "rank")
