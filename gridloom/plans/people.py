"""Demand, access, cohorts and densities over the tables at hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import demand, demography
from gridloom.plans.catalog import query, table

TYPES = [demand.DemandType("clinic", "health", "people", 0.02), demand.DemandType("school", "education", "people", 0.15), demand.DemandType("transit", "mobility", "jobs", 0.3)]
BLOCKS_SQL = "blocks AS (SELECT c_custkey AS block, greatest(floor(c_acctbal), 0)::DOUBLE AS people, (c_custkey % 50)::DOUBLE AS jobs FROM customer)"
DEMANDS_SQL = f"""{BLOCKS_SQL}, types(type, category, rate) AS (VALUES ('clinic', 'health', 0.02::DOUBLE), ('school', 'education', 0.15), ('transit', 'mobility', 0.3)),
gross AS (SELECT block, type, category, CASE WHEN type = 'transit' THEN jobs ELSE people END AS signal, CASE WHEN type = 'transit' THEN jobs ELSE people END * rate AS gross FROM blocks, types),
demands AS (SELECT *, CASE WHEN block % 3 = 0 AND type <> 'clinic' THEN gross / 2 ELSE 0 END AS served FROM gross)"""


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = F.greatest(F.floor("c_acctbal"), F.lit(0)).cast("double")
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("block"), people.alias("people"), (F.col("c_custkey") % 50).cast("double").alias("jobs"))


def _demands(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = _blocks(spark, sf_dir)
    half = F.inline(F.array(F.struct(F.lit("school").alias("type"), (F.col("people") * 0.15 / 2).alias("served")), F.struct(F.lit("transit").alias("type"), (F.col("jobs") * 0.3 / 2).alias("served"))))
    return demand.unmet(blocks, TYPES, blocks.filter("block % 3 = 0").select("block", half))


@query("unmet_demand", f"WITH {DEMANDS_SQL} SELECT block, type, category, signal, round(gross, 6) AS gross, round(served, 6) AS served, round(gross - served, 6) AS unmet FROM demands")
def unmet_demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _demands(spark, sf_dir).select("block", "type", "category", "signal", *[F.round(c, 6).alias(c) for c in ("gross", "served", "unmet")])


@query("demand_summary", f"""
WITH {DEMANDS_SQL}, c AS (SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'school' ELSE 'transit' END AS type, sum(greatest(s_acctbal, 0)) AS capacity FROM supplier GROUP BY 1)
SELECT type, category, round(sum(gross), 4) AS gross, round(sum(served), 4) AS served, round(sum(gross - served), 4) AS unmet, round(coalesce(any_value(capacity), 0), 4) AS capacity, round(sum(served) / any_value(capacity), 6) AS utilization
FROM demands LEFT JOIN c USING (type) GROUP BY type, category""")
def demand_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "supplier").select(F.when(F.col("s_suppkey") % 2 == 0, "school").otherwise("transit").alias("type"), F.greatest("s_acctbal", F.lit(0.0)).alias("capacity"))
    found = demand.summary(_demands(spark, sf_dir), held)
    return found.select("type", "category", *[F.round(c, 4).alias(c) for c in ("gross", "served", "unmet", "capacity")], F.round("utilization", 6).alias("utilization"))


@query("demand_by_block", f"""
WITH {DEMANDS_SQL} SELECT block, round(sum(gross), 4) AS gross, round(sum(gross - served), 4) AS unmet, round(CASE WHEN sum(gross) > 0 THEN 1 - sum(gross - served) / sum(gross) END, 6) AS coverage, string_agg(type, ',' ORDER BY type) AS types
FROM demands GROUP BY block""")
def demand_by_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = demand.block_payload(_demands(spark, sf_dir))
    return found.select("block", F.round("gross", 4).alias("gross"), F.round("unmet", 4).alias("unmet"), F.round("coverage", 6).alias("coverage"), F.array_join("items.type", ",").alias("types"))


@query("facility_access", "SELECT l_suppkey, count(*)::BIGINT AS reached, min(l_quantity) AS nearest, max(l_quantity) AS farthest FROM lineitem GROUP BY l_suppkey")
def facility_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demand.access_summary(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_quantity")


SHARES = {"child": "0.175", "adult": "0.6", "senior": "0.225"}


@query("age_totals", """
WITH t AS (SELECT c_nationkey, greatest(sum(floor(c_acctbal)::BIGINT), 0)::BIGINT AS people FROM customer GROUP BY c_nationkey),
s(place, cohort, unit) AS (VALUES (0, 'child', 175), (1, 'adult', 600), (2, 'senior', 225)),
q AS (SELECT c_nationkey, people, place, cohort, people * unit // 1000 AS base, people * unit % 1000 AS rest FROM t, s),
r AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY rest DESC, place) AS turn, people - sum(base) OVER (PARTITION BY c_nationkey) AS spare FROM q)
SELECT c_nationkey, cohort, (base + CASE WHEN turn <= spare THEN 1 ELSE 0 END)::BIGINT AS people FROM r""")
def age_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.sum(F.floor("c_acctbal")).alias("people"))
    dealt = total.select("c_nationkey", F.posexplode(demography.by_shares(F.col("people"), SHARES)).alias("place", "people"))
    return dealt.select("c_nationkey", F.element_at(F.array(*map(F.lit, SHARES)), F.col("place") + 1).alias("cohort"), "people")


BUILDINGS_SQL = "b AS (SELECT c_custkey, c_nationkey, c_mktsegment, c_custkey % 90 AS population, c_custkey % 7 AS child, c_custkey % 11 AS adult, (c_custkey % 3 * 0.5)::DOUBLE AS jobs FROM customer)"


def _buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment", (k % 90).alias("population"), (k % 7).alias("child"), (k % 11).alias("adult"), (k % 3 * 0.5).alias("jobs"))


@query("block_members", f"WITH {BUILDINGS_SQL} SELECT c_nationkey, c_mktsegment, count(*)::BIGINT AS buildings, sum(population)::BIGINT AS population, sum(child)::BIGINT AS child, sum(adult)::BIGINT AS adult, sum(jobs) AS jobs FROM b GROUP BY ALL")
def block_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demography.members(_buildings(spark, sf_dir), ["c_nationkey", "c_mktsegment"], ["child", "adult"])


@query("zone_densities", f"""
WITH {BUILDINGS_SQL}, z AS (SELECT c_nationkey, sum(population) AS population, sum(child) AS child, sum(adult) AS adult FROM b GROUP BY c_nationkey)
SELECT c_nationkey, round(population * 1e6 / (250000 + c_nationkey * 1000), 6) AS density_per_km2, round(child / population, 9) AS child_share, round(adult / population, 9) AS adult_share FROM z""")
def zone_densities(spark: SparkSession, sf_dir: str) -> DataFrame:
    zones = demography.members(_buildings(spark, sf_dir), ["c_nationkey"], ["child", "adult"]).withColumn("area", F.lit(250_000) + F.col("c_nationkey") * 1000)
    found = demography.densities(zones, ["c_nationkey"], ["child", "adult"], "area")
    return found.select("c_nationkey", F.round("density_per_km2", 6).alias("density_per_km2"), F.round("child_share", 9).alias("child_share"), F.round("adult_share", 9).alias("adult_share"))


@query("population_targets", """
WITH t AS (SELECT n_nationkey, n_nationkey * 144 AS baseline, CASE WHEN n_nationkey % 4 = 0 THEN 2500 ELSE floor(n_nationkey * 144 * 1.125::DECIMAL(9, 3) + 0.5) END::BIGINT AS target FROM nation),
g AS (SELECT *, greatest(target - baseline, 0) AS generated, greatest(baseline - target, 0) AS excess FROM t)
SELECT n_nationkey, target, generated, least(generated, 300) AS allocated, generated - least(generated, 300) AS unmet, excess,
  CASE WHEN excess > 0 THEN 'BASELINE_EXCEEDS_TARGET' WHEN generated <= 300 THEN 'TARGET_MET' ELSE 'CAPACITY_EXHAUSTED' END AS status FROM g""")
def population_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("n_nationkey").cast("long")
    target = F.when(key % 4 == 0, F.lit(2500).cast("long")).otherwise(demography.target_total(key * 144, "0.125"))
    rows = table(spark, sf_dir, "nation").select("n_nationkey", (key * 144).alias("baseline"), target.alias("target"))
    return rows.select("n_nationkey", "target", demography.allocation(F.col("target"), F.col("baseline"), F.lit(300).cast("long")).alias("a")).select("n_nationkey", "target", "a.*")
