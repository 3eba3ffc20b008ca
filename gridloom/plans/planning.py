"""Apportionment, aggregation, rasters, spatial joins and graphs over the tables at hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import raster
from gridloom.operators.apportion import largest_remainder, serve_in_order, weighted_percentile
from gridloom.operators.graph import connected_components
from gridloom.operators.spatial import in_box, within_distance
from gridloom.plans.catalog import query, table


@query("allocate_population", """
WITH c AS (SELECT c_nationkey, c_custkey, greatest(floor(c_acctbal)::BIGINT, 0) AS capacity FROM customer),
q AS (SELECT *, sum(capacity) OVER (PARTITION BY c_nationkey)::BIGINT AS whole, capacity * 1000 AS quota FROM c),
b AS (SELECT *, quota // whole AS base, quota % whole AS rest FROM q WHERE whole > 0),
p AS (SELECT *, 1000 - sum(base) OVER (PARTITION BY c_nationkey) AS spare, row_number() OVER (PARTITION BY c_nationkey ORDER BY rest DESC, c_custkey) AS place FROM b)
SELECT c_nationkey, c_custkey, capacity, (base + CASE WHEN place <= spare THEN 1 ELSE 0 END)::BIGINT AS allocated FROM p""")
def allocate_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").withColumn("capacity", F.floor("c_acctbal"))
    return largest_remainder(c, "c_nationkey", "c_custkey", "capacity", 1000)


@query("demography_rollup", """
SELECT r_name, n_name, count(*)::BIGINT AS residents, round(sum(c_acctbal)::DOUBLE, 2) AS balance
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)""")
def demography_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Nations and regions are fixed tables of 25 and 5 rows.
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"), F.sum("c_acctbal").alias("b"))
    joined = c.join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.rollup("r_name", "n_name").agg(F.sum("n").alias("residents"), F.round(F.sum("b"), 2).alias("balance"))


@query("distance_percentiles", """
WITH s AS (SELECT event_type, value, count(*) AS w FROM events WHERE value IS NOT NULL GROUP BY ALL),
r AS (SELECT *, sum(w) OVER (PARTITION BY event_type ORDER BY value) AS run, sum(w) OVER (PARTITION BY event_type) AS whole FROM s)
SELECT event_type, min(value) AS percentile FROM r WHERE run >= whole * 0.9 GROUP BY event_type""")
def distance_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted_percentile(table(spark, sf_dir, "events").withColumn("weight", F.lit(1)), "event_type", "value", "weight", 0.9)


@query("served_demand", """
SELECT o_custkey, o_orderkey, round(least(o_totalprice, greatest(0, 500000 - coalesce(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))), 4) AS served FROM orders""")
def served_demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    served = serve_in_order(F.col("o_totalprice"), F.lit(500000.0), "o_custkey", order=[F.col("o_orderkey")])
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.round(served, 4).alias("served"))


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    key = F.col("p_partkey").cast("int")
    return part.groupBy((key / 40).cast("int").alias("row"), F.pmod(key, F.lit(40)).alias("col")).agg(F.avg("p_retailprice").alias("value"))


CELLS_SQL = "cells AS (SELECT (p_partkey // 40)::INTEGER AS row, (p_partkey % 40)::INTEGER AS col, avg(p_retailprice) AS value FROM part GROUP BY ALL)"


@query("terrain_slope", f"""
WITH {CELLS_SQL}
SELECT c.row, c.col, round(degrees(atan(sqrt(((e.value - w.value) / 50) ** 2 + ((s.value - n.value) / 50) ** 2))), 6) AS slope
FROM cells c LEFT JOIN cells e ON e.row = c.row AND e.col = c.col + 1 LEFT JOIN cells w ON w.row = c.row AND w.col = c.col - 1
LEFT JOIN cells s ON s.col = c.col AND s.row = c.row + 1 LEFT JOIN cells n ON n.col = c.col AND n.row = c.row - 1""")
def terrain_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.slope(_cells(spark, sf_dir), 25.0).select("row", "col", F.round("slope", 6).alias("slope"))


@query("raster_zones", f"""
WITH {CELLS_SQL} SELECT row // 8 AS zone_row, col // 8 AS zone_col, count(value)::BIGINT AS n, round(avg(value), 6) AS mean FROM cells GROUP BY ALL""")
def raster_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = raster.zonal(_cells(spark, sf_dir), 8, 8)
    return z.select(F.col("zone_row").cast("int").alias("zone_row"), F.col("zone_col").cast("int").alias("zone_col"), "n", F.round("mean", 6).alias("mean"))


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.get("embedding", F.lit(0)).cast("double").alias("x"), F.get("embedding", F.lit(1)).cast("double").alias("y"))


@query("points_within", """
WITH p AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings)
SELECT a.id AS left_id, b.id AS right_id FROM p a JOIN p b ON a.id < b.id WHERE sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 0.01""")
def points_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _points(spark, sf_dir)
    return within_distance(p, p, 0.01).filter("left_id < right_id").select("left_id", "right_id")


@query("points_in_box", "SELECT vec_id AS id FROM embeddings WHERE embedding[1]::DOUBLE BETWEEN -0.1 AND 0.1 AND embedding[2]::DOUBLE BETWEEN 0 AND 0.2")
def points_in_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return in_box(_points(spark, sf_dir), -0.1, 0.0, 0.1, 0.2).select("id")


@query("network_components", """
WITH RECURSIVE e AS (SELECT DISTINCT o_custkey AS a, o_custkey - o_custkey % 7 AS b FROM orders), n AS (SELECT a FROM e UNION SELECT b FROM e),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(a, b) AS (SELECT a, a FROM n UNION SELECT r.a, w.b FROM reach r JOIN both_ways w ON r.b = w.a)
SELECT a AS node, min(b) AS component FROM reach GROUP BY a""")
def network_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey").distinct()
    return connected_components(o.select(F.col("o_custkey").alias("src"), (F.col("o_custkey") - F.col("o_custkey") % 7).alias("dst")))


@query("unserved_customers", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000)")
def unserved_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    o = table(spark, sf_dir, "orders").filter((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 100000))
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left_anti").select("c_custkey")


@query("threshold_violations", """
SELECT c_nationkey, count(*) FILTER (WHERE c_acctbal < 0)::BIGINT AS hard_violations, round(sum(CASE WHEN c_acctbal BETWEEN 0 AND 1000 THEN (1000 - c_acctbal) / 1000 ELSE 0 END), 6) AS soft_penalty
FROM customer GROUP BY c_nationkey""")
def threshold_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    soft = F.when(F.col("c_acctbal").between(0, 1000), (1000 - F.col("c_acctbal")) / 1000).otherwise(0.0)
    return table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count_if(F.col("c_acctbal") < 0).alias("hard_violations"), F.round(F.sum(soft), 6).alias("soft_penalty"))
