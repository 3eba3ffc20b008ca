"""Voronoi cells and their members, and classes of zones by target shares, over the tables at hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import voronoi
from gridloom.plans.catalog import query, table

SHARES = {"residential": 0.5, "mixed": 0.2, "green": 0.3}


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda i: F.get("embedding", F.lit(i)).cast("double")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), at(0).alias("x"), at(1).alias("y"), "label")


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = _points(spark, sf_dir).filter("label = 0").select(F.col("id").alias("seed"), "x", "y")
    return voronoi.cells(seeds, -2.0, -2.0, 2.0, 2.0, 0.05)


@query("voronoi_members", """
WITH p AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, label FROM embeddings),
d AS (SELECT a.id, s.id AS seed, (a.x - s.x) ** 2 + (a.y - s.y) ** 2 AS d FROM p a JOIN p s ON s.label = 0)
SELECT id, arg_min(seed, d) AS seed FROM d GROUP BY id""")
def voronoi_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _points(spark, sf_dir)
    return voronoi.members(points, points.filter("label = 0").select(F.col("id").alias("seed"), "x", "y"))


@query("voronoi_coverage", """
SELECT count(DISTINCT (embedding[1], embedding[2]))::BIGINT AS cells, 16::DOUBLE AS area FROM embeddings WHERE label = 0""")
def voronoi_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir).agg(F.count("*").alias("cells"), F.round(F.sum("area"), 9).alias("area"))


ASSIGNED_SQL = """
parts AS (SELECT p_size AS run, p_partkey AS seed, floor(p_retailprice)::DOUBLE AS area, (p_partkey * 37 % 101)::DOUBLE AS score FROM part),
placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY run ORDER BY score DESC, seed) AS n, sum(area) OVER (PARTITION BY run) AS total FROM parts),
walk(run, n, seed, area, a, b, c, pick) AS (
  SELECT run, 0::BIGINT, NULL::BIGINT, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE, NULL::VARCHAR FROM placed GROUP BY run
  UNION ALL
  SELECT run, n, seed, area, a + CASE pick WHEN 'residential' THEN area ELSE 0 END, b + CASE pick WHEN 'mixed' THEN area ELSE 0 END, c + CASE pick WHEN 'green' THEN area ELSE 0 END, pick FROM (
    SELECT p.run, p.n, p.seed, p.area, w.a, w.b, w.c,
      CASE WHEN total * 0.5 - w.a >= total * 0.2 - w.b AND total * 0.5 - w.a >= total * 0.3 - w.c THEN 'residential' WHEN total * 0.3 - w.c >= total * 0.2 - w.b THEN 'green' ELSE 'mixed' END AS pick
    FROM walk w JOIN placed p ON p.run = w.run AND p.n = w.n + 1)),
assigned AS (SELECT run, seed, area, pick AS zone_class FROM walk WHERE n > 0)"""


def _assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    parts = table(spark, sf_dir, "part").select(F.col("p_size").alias("run"), key.alias("seed"), F.floor("p_retailprice").cast("double").alias("area"), F.pmod(key * 37, F.lit(101)).cast("double").alias("score"))
    return voronoi.assign_classes(parts, SHARES)


@query("zone_assignment", f"WITH RECURSIVE {ASSIGNED_SQL} SELECT run, seed, zone_class FROM assigned")
def zone_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assigned(spark, sf_dir).select("run", "seed", "zone_class")


@query("zone_shares", f"""
WITH RECURSIVE {ASSIGNED_SQL}, t AS (SELECT run, sum(area) AS total FROM parts GROUP BY run)
SELECT run, zone_class, count(seed)::BIGINT AS cells, coalesce(sum(area), 0)::DOUBLE AS area, round(total * share, 6) AS target, round(abs(coalesce(sum(area), 0) - total * share), 6) AS error
FROM (SELECT * FROM t, (VALUES ('residential', 0.5::DOUBLE), ('mixed', 0.2), ('green', 0.3)) AS s(zone_class, share)) LEFT JOIN assigned USING (run, zone_class) GROUP BY run, zone_class, total, share""")
def zone_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = voronoi.share_diagnostics(_assigned(spark, sf_dir), SHARES)
    return found.select("run", "zone_class", "cells", "area", F.round("target", 6).alias("target"), F.round("error", 6).alias("error"))
