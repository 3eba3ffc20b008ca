"""Counts, pages, fingerprints and exports over the tables at hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import reports
from gridloom.plans.catalog import query, table


@query("job_durations", """
SELECT l_returnflag, l_linestatus, count(*)::BIGINT AS jobs, round(sum(epoch_us(l_shipdate) - epoch_us(o_orderdate))::DOUBLE / 1e6, 3) AS seconds FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL""")
def job_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return reports.durations(jobs, ["l_returnflag", "l_linestatus"], "o_orderdate", "l_shipdate").withColumn("seconds", F.round("seconds", 3))


@query("job_admission", """
SELECT event_type, count(value)::BIGINT AS active, count(value) + 5 <= most AS allowed FROM (VALUES ('click', 100), ('view', 2000), ('audit', 3)) AS t(event_type, most)
LEFT JOIN (SELECT * FROM events WHERE value > 50) USING (event_type) GROUP BY event_type, most""")
def job_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.over_limit(table(spark, sf_dir, "events"), "event_type", F.col("value") > 50, {"click": 100, "view": 2000, "audit": 3}, 5)


@query("run_counts", """
SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey)::BIGINT AS blocks, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')::BIGINT AS parcels FROM customer""")
def run_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return reports.with_counts(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", {"blocks": (o, "o_custkey"), "parcels": (o.filter("o_orderstatus = 'F'"), "o_custkey")})


@query("violation_page", "SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders WHERE o_totalprice > 50000) > 60 AS truncated FROM orders WHERE o_totalprice > 50000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
def violation_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").filter("o_totalprice > 50000").select("o_orderkey", "o_totalprice")
    return reports.page(rows, [F.desc("o_totalprice"), F.asc("o_orderkey")], 20, 40)


@query("latest_runs", "SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1")
def latest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.latest(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", "o_orderstatus")


@query("stitched_orders", """
SELECT c_custkey, coalesce((SELECT string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) FROM orders WHERE o_custkey = c_custkey), '') AS orders FROM customer WHERE c_acctbal > 0""")
def stitched_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    parents = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select("c_custkey")
    found = reports.stitched(parents, table(spark, sf_dir, "orders"), "c_custkey", "o_custkey", "o_orderkey")
    return found.select("c_custkey", F.array_join(F.transform("children", lambda k: k.cast("string")), ",").alias("orders"))


@query("batch_status", """
SELECT o_custkey, CASE WHEN bool_or(o_orderpriority LIKE '1%') THEN 'running' WHEN bool_or(o_orderstatus = 'F') THEN 'failed' WHEN bool_or(o_orderstatus = 'P') THEN 'cancelled' ELSE 'succeeded' END AS status FROM orders GROUP BY o_custkey""")
def batch_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderpriority").startswith("1"), "queued").when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "P", "cancelled").otherwise("succeeded")
    return reports.fold_status(table(spark, sf_dir, "orders").select("o_custkey", status.alias("status")), "o_custkey", "status")


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("run"), (F.col("l_quantity") < 40).alias("passed"), (F.col("l_returnflag") == "R").alias("hard"), (F.col("l_linenumber") > 3).alias("has_geometry"), (F.col("l_quantity") - 39).alias("penalty"), (F.col("l_linenumber") * 0.5).alias("weight")
    )


RESULTS_SQL = "r AS (SELECT l_suppkey AS run, l_quantity < 40 AS passed, l_returnflag = 'R' AS hard, l_linenumber > 3 AS has_geometry, l_quantity - 39 AS penalty, l_linenumber * 0.5::DOUBLE AS weight FROM lineitem)"


@query("validation_summary", f"""
WITH {RESULTS_SQL} SELECT run, count(*) FILTER (WHERE NOT passed)::BIGINT AS violations, count(*) FILTER (WHERE NOT passed AND hard)::BIGINT AS hard, count(*) FILTER (WHERE NOT passed AND NOT hard)::BIGINT AS soft, count(*) FILTER (WHERE NOT passed AND has_geometry)::BIGINT AS spatial FROM r GROUP BY run""")
def validation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.validation_summary(_results(spark, sf_dir), "run")


@query("constraint_metrics", f"""
WITH {RESULTS_SQL} SELECT run, count(*) FILTER (WHERE NOT passed AND hard)::BIGINT AS hard_violation_count, sum(CASE WHEN NOT passed AND NOT hard THEN penalty * weight ELSE 0 END)::DOUBLE AS weighted_soft_penalty FROM r GROUP BY run""")
def constraint_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.constraint_metrics(_results(spark, sf_dir), "run")


@query("config_fingerprints", """
SELECT n_nationkey, sha256('{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}') AS fingerprint,
  ('0x' || substr(sha256('2:42' || octet_length(encode(n_name)) || ':' || n_name || length(n_nationkey::VARCHAR) || ':' || n_nationkey), 1, 15))::BIGINT AS seed FROM nation""")
def config_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select("n_nationkey", reports.fingerprint("n_regionkey", "n_nationkey", "n_name").alias("fingerprint"), reports.keyed_seed(F.lit(42), F.col("n_name"), key).alias("seed"))


@query("zone_uuids", """
WITH d AS (SELECT n_nationkey, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(n_name)) AS h FROM nation)
SELECT n_nationkey, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || (['8', '9', 'a', 'b'])[(strpos('0123456789abcdef', h[17:17]) - 1) % 4 + 1] || h[18:20] || '-' || h[21:32] AS zone FROM d""")
def zone_uuids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", reports.uuid5("6ba7b810-9dad-11d1-80b4-00c04fd430c8", F.col("n_name")).alias("zone"))


@query("feature_ids", "SELECT p_partkey, CASE WHEN trim(CASE WHEN p_size % 2 = 0 THEN ' ' WHEN p_size % 3 = 0 THEN NULL ELSE p_brand END) <> '' THEN trim(p_brand) ELSE 'part:' || p_partkey END AS feature_id FROM part")
def feature_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.when(F.col("p_size") % 2 == 0, " ").when(F.col("p_size") % 3 == 0, None).otherwise(F.col("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", reports.feature_id(F.lit("part"), own, F.col("p_partkey")).alias("feature_id"))


@query("metrics_csv", """
SELECT p_partkey, concat(p_partkey, ',', chr(34), p_name, ', ', chr(34), chr(34), p_brand, chr(34), chr(34), chr(34), ',', CASE WHEN p_size > 20 THEN p_type ELSE '' END) AS line FROM part""")
def metrics_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.lit(', "'), "p_brand", F.lit('"')).alias("name"), F.when(F.col("p_size") > 20, F.col("p_type")).alias("kind"))
    return rows.select("p_partkey", reports.csv_line("p_partkey", "name", "kind").alias("line"))


@query("viewport_features", """
WITH f AS (SELECT vec_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings) SELECT vec_id, label FROM f WHERE x + 0.05 >= -0.1 AND x <= 0.1 AND y + 0.05 >= -0.2 AND y <= 0.05""")
def viewport_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda i: F.get("embedding", F.lit(i)).cast("double")
    boxes = table(spark, sf_dir, "embeddings").select("vec_id", "label", at(0).alias("min_x"), at(1).alias("min_y"), (at(0) + 0.05).alias("max_x"), (at(1) + 0.05).alias("max_y"))
    return reports.viewport(boxes, -0.1, -0.2, 0.1, 0.05).select("vec_id", "label")


@query("even_samples", """
SELECT p_partkey, CASE WHEN p_size <= 5 THEN array_to_string(generate_series(0, p_size - 1), ',') ELSE array_to_string(list_transform(generate_series(0, 4), lambda i: floor(i * (p_size - 1) / 4.0 + 0.5)::INTEGER), ',') END AS places FROM part""")
def even_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = reports.even_places(F.col("p_size"), 5)
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.transform(places, lambda i: i.cast("string")), ",").alias("places"))


@query("projected_points", """
WITH p AS (SELECT vec_id, embedding[1]::DOUBLE * 100 AS lon, embedding[2]::DOUBLE * 200 AS lat, embedding[3]::DOUBLE AS dx, embedding[4]::DOUBLE AS dy FROM embeddings)
SELECT vec_id, round(radians(lon) * 6378137, 4) AS x, round(CASE WHEN lat BETWEEN -85.06 AND 85.06 THEN ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137 END, 4) AS y,
  round(CASE WHEN degrees(atan2(dy, dx)) < 0 THEN degrees(atan2(dy, dx)) + 180 ELSE degrees(atan2(dy, dx)) END, 6) AS axis FROM p""")
def projected_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda i: F.get("embedding", F.lit(i)).cast("double")
    x, y = reports.mercator(at(0) * 100, at(1) * 200)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(x, 4).alias("x"), F.round(y, 4).alias("y"), F.round(reports.axis_angle(at(2), at(3)), 6).alias("axis"))
