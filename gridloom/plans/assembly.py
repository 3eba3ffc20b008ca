"""Unions, key checks, masks, scenarios, picks and service measures over the tables at hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import assembly
from gridloom.plans.catalog import query, table


@query("facility_candidates", "SELECT s_suppkey AS id, s_nationkey AS zone, s_acctbal::DOUBLE AS capacity, 'existing' AS origin FROM supplier UNION ALL SELECT c_custkey, c_nationkey, NULL, 'generated' FROM customer WHERE c_acctbal > 5000")
def facility_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    existing = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("zone"), F.col("s_acctbal").cast("double").alias("capacity"))
    generated = table(spark, sf_dir, "customer").filter("c_acctbal > 5000").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("zone"))
    return assembly.union_candidates({"existing": existing, "generated": generated})


@query("key_differences", """
SELECT coalesce(a.k, b.k) AS id, CASE WHEN a.k IS NULL THEN 'left' ELSE 'right' END AS missing_in
FROM (SELECT DISTINCT c_custkey AS k FROM customer WHERE c_acctbal > 0) a FULL JOIN (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_totalprice > 100000) b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL""")
def key_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("id"))
    return assembly.key_differences(left, table(spark, sf_dir, "orders").filter("o_totalprice > 100000").select(F.col("o_custkey").alias("id")), "id")


@query("exclusion_mask", """
SELECT "row", col, bool_or(excluded) AS excluded FROM (
  SELECT l_partkey % 100 AS "row", l_suppkey % 100 AS col, l_quantity > 49 AS excluded FROM lineitem
  UNION ALL SELECT o_orderkey % 100, o_custkey % 100, o_totalprice < 2000 FROM orders) GROUP BY "row", col""")
def exclusion_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 100).alias("row"), (F.col("l_suppkey") % 100).alias("col"), (F.col("l_quantity") > 49).alias("excluded"))
    b = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 100).alias("row"), (F.col("o_custkey") % 100).alias("col"), (F.col("o_totalprice") < 2000).alias("excluded"))
    return assembly.combine_masks([a, b], ["row", "col"], "excluded")


@query("scenario_matrix", "SELECT s_suppkey, seed::BIGINT AS seed, s_suppkey * 3 + slot AS position FROM supplier, (VALUES (0, 42), (1, 7), (2, 99)) AS v(slot, seed)")
def scenario_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembly.scenario_matrix(table(spark, sf_dir, "supplier").select("s_suppkey"), "s_suppkey", [42, 7, 99])


@query("building_archetypes", """
SELECT o_orderkey, CASE WHEN 3 > u * 6 THEN 'house' WHEN 5 > u * 6 THEN 'block' ELSE 'tower' END AS archetype
FROM (SELECT o_orderkey, ((o_orderkey::BIGINT * 40503) % 65536) / 65536.0::DOUBLE AS u FROM orders)""")
def building_archetypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = (F.col("o_orderkey").cast("long") * 40503) % 65536 / 65536.0
    return table(spark, sf_dir, "orders").select("o_orderkey", assembly.weighted_pick(u, {"house": 3.0, "block": 2.0, "tower": 1.0}).alias("archetype"))


@query("calibrated_population", """
WITH c AS (SELECT c_nationkey, c_custkey, greatest(floor(c_acctbal)::BIGINT, 0) AS people, (c_custkey % 7)::BIGINT AS e FROM customer),
q AS (SELECT *, (sum(people) OVER w)::HUGEINT AS total, (sum(e) OVER w)::HUGEINT AS evidence FROM c WINDOW w AS (PARTITION BY c_nationkey)),
s AS (SELECT *, people * evidence * 70 + e * total * 30 AS share FROM q),
b AS (SELECT *, CASE WHEN evidence > 0 THEN share // (evidence * 100) ELSE people END AS base, CASE WHEN evidence > 0 THEN share % (evidence * 100) ELSE 0 END AS rest FROM s),
p AS (SELECT *, total - sum(base) OVER (PARTITION BY c_nationkey) AS spare, row_number() OVER (PARTITION BY c_nationkey ORDER BY rest DESC, c_custkey) AS place FROM b)
SELECT c_nationkey, c_custkey, people, (base + CASE WHEN place <= spare THEN 1 ELSE 0 END)::BIGINT AS calibrated FROM p""")
def calibrated_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", F.floor("c_acctbal").alias("people"), (F.col("c_custkey") % 7).alias("evidence"))
    return assembly.calibrate(c, "c_nationkey", "c_custkey", "people", "evidence", 30)


@query("demand_coverage", """
WITH d AS (SELECT l_orderkey, sum(l_quantity)::DOUBLE AS gross, sum(CASE WHEN l_returnflag <> 'R' THEN l_quantity ELSE 0 END)::DOUBLE AS served FROM lineitem GROUP BY l_orderkey)
SELECT o_orderpriority, round(sum(o_totalprice::DOUBLE * CASE WHEN gross > 0 THEN least(served / gross, 1) ELSE 0 END) / sum(o_totalprice::DOUBLE), 6) AS coverage
FROM orders JOIN d ON o_orderkey = l_orderkey GROUP BY o_orderpriority""")
def demand_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.sum("l_quantity").cast("double").alias("gross"), F.sum(F.when(F.col("l_returnflag") != "R", F.col("l_quantity")).otherwise(0)).cast("double").alias("served")
    )
    rows = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).withColumn("signal", F.col("o_totalprice").cast("double"))
    return assembly.coverage(rows, "o_orderpriority", "signal", "served", "gross").withColumn("coverage", F.round("coverage", 6))


@query("supply_circuity", """
SELECT l_returnflag, round(sum(CASE WHEN chord > 0 THEN length END) / sum(CASE WHEN chord > 0 THEN chord END), 6) AS circuity
FROM (SELECT l_returnflag, abs(l_partkey - l_suppkey)::DOUBLE AS chord, abs(l_partkey - l_suppkey)::DOUBLE + l_quantity::DOUBLE AS length FROM lineitem) GROUP BY l_returnflag""")
def supply_circuity(spark: SparkSession, sf_dir: str) -> DataFrame:
    chord = F.abs(F.col("l_partkey") - F.col("l_suppkey")).cast("double")
    edges = table(spark, sf_dir, "lineitem").select("l_returnflag", chord.alias("chord"), (chord + F.col("l_quantity").cast("double")).alias("length"))
    return assembly.circuity(edges, "l_returnflag", "length", "chord").withColumn("circuity", F.round("circuity", 6))
