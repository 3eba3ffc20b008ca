"""Suitability of cells, slopes with edges, overlaps and setbacks over the tables at hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import geometry
from gridloom.operators import lines, raster, spatial, suitability
from gridloom.plans.catalog import query, table

FACTORS = [
    suitability.Factor("price", 3.0, "min_max", 900.0, 1500.0),
    suitability.Factor("size", 1.0, "inverted", 0.0, 60.0),
    suitability.Factor("share", 2.0),
    suitability.Factor("unused", 0.0),
]
CELLS_SQL = """cells AS (
  SELECT (p_partkey // 20)::INTEGER AS row, (p_partkey % 20)::INTEGER AS col, avg(p_retailprice) AS price, avg(p_size)::DOUBLE AS size, CASE WHEN max(p_size) < 45 THEN avg(p_size) / 50 END AS share, max(p_size) = 13 AS excluded
  FROM part GROUP BY ALL)"""
SCORES_SQL = f"""{CELLS_SQL},
raw AS (SELECT row, col, excluded, greatest(0, least(1, (price - 900) / 600)) * 3 / 6 + (1 - greatest(0, least(1, size / 60))) / 6 + share * 2 / 6 AS score FROM cells),
scores AS (SELECT row, col, CASE WHEN NOT excluded AND score IS NOT NULL THEN greatest(0, least(1, score)) ELSE 0 END AS score, NOT excluded AND score IS NOT NULL AS valid, excluded FROM raw)"""


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey").cast("int")
    cells = table(spark, sf_dir, "part").groupBy((key / 20).cast("int").alias("row"), F.pmod(key, F.lit(20)).alias("col"))
    share = F.when(F.max("p_size") < 45, F.avg("p_size") / 50)
    return cells.agg(F.avg("p_retailprice").alias("price"), F.avg("p_size").alias("size"), share.alias("share"), (F.max("p_size") == 13).alias("excluded"), F.lit(None).cast("double").alias("unused"))


@query("suitability_scores", f"WITH {SCORES_SQL} SELECT row, col, round(score, 9) AS score, valid, excluded FROM scores")
def suitability_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suitability.weighted(_cells(spark, sf_dir), FACTORS).withColumn("score", F.round("score", 9))


@query("suitability_statistics", f"""
WITH {SCORES_SQL}, v AS (SELECT *, CASE WHEN valid THEN score END AS s FROM scores)
SELECT count(*)::BIGINT AS cells, count(*) FILTER (WHERE valid)::BIGINT AS valid, count(*) FILTER (WHERE excluded)::BIGINT AS excluded, count(*) FILTER (WHERE NOT valid AND NOT excluded)::BIGINT AS invalid,
  count(*) FILTER (WHERE s >= 0.5)::BIGINT AS suitable, round(min(s), 9) AS least, round(max(s), 9) AS most, round(avg(s), 9) AS mean,
  round(quantile_cont(s, 0.05), 9) AS p05, round(quantile_cont(s, 0.5), 9) AS p50, round(quantile_cont(s, 0.95), 9) AS p95 FROM v""")
def suitability_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suitability.statistics(suitability.weighted(_cells(spark, sf_dir), FACTORS), 0.5)
    return found.select("cells", "valid", "excluded", "invalid", "suitable", *[F.round(c, 9).alias(c) for c in ("least", "most", "mean", "p05", "p50", "p95")])


@query("landuse_scores", """
SELECT p_partkey, CASE WHEN p_brand = 'Brand#1' THEN 0.9 WHEN p_brand = 'Brand#2' THEN 0.4 WHEN p_brand IS NOT NULL THEN 0.25 END::DOUBLE AS score FROM part""")
def landuse_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = suitability.class_score(F.col("p_brand"), {"Brand#1": 0.9, "Brand#2": 0.4}, 0.25)
    return table(spark, sf_dir, "part").select("p_partkey", score.alias("score"))


def _slope_sql(one_sided: bool) -> str:
    def step(low: str, high: str, at: str, last: str) -> str:
        forward, backward = f"c.{at} = 0", f"c.{at} = {last}"
        if one_sided:
            forward, backward = f"({forward} OR {low} IS NULL)", f"({backward} OR {high} IS NULL)"
        return f"coalesce(({high} - {low}) / 50, CASE WHEN {forward} THEN ({high} - c.value) / 25 END, CASE WHEN {backward} THEN (c.value - {low}) / 25 END)"

    return f"""
WITH {CELLS_SQL}, v AS (SELECT row, col, CASE WHEN NOT excluded THEN price * 0.5 END AS value FROM cells), size AS (SELECT max(row) AS last FROM v)
SELECT c.row, c.col, round(CASE WHEN c.value IS NOT NULL THEN degrees(atan(sqrt({step('w.value', 'e.value', 'col', '19')} ** 2 + {step('n.value', 's.value', 'row', '50')} ** 2))) END, 6) AS slope
FROM v c LEFT JOIN v e ON e.row = c.row AND e.col = c.col + 1 LEFT JOIN v w ON w.row = c.row AND w.col = c.col - 1
LEFT JOIN v s ON s.col = c.col AND s.row = c.row + 1 LEFT JOIN v n ON n.col = c.col AND n.row = c.row - 1"""


def _slope(spark: SparkSession, sf_dir: str, one_sided: bool) -> DataFrame:
    cells = _cells(spark, sf_dir).select("row", "col", F.when(~F.col("excluded"), F.col("price")).alias("value"))
    return raster.slope(cells, 25.0, 51, 20, one_sided, 0.5).select("row", "col", F.round("slope", 6).alias("slope"))


@query("slope_with_edges", _slope_sql(False))
def slope_with_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _slope(spark, sf_dir, False)


@query("slope_one_sided", _slope_sql(True))
def slope_one_sided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _slope(spark, sf_dir, True)


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda i: F.get("embedding", F.lit(i)).cast("double")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), *[at(i).alias(f"e{i}") for i in range(4)], "label")


def _boxes(spark: SparkSession, sf_dir: str, zones: bool) -> DataFrame:
    p = _points(spark, sf_dir).filter("label = 0" if zones else "label <> 0")
    size = 0.15 if zones else 0.04
    return p.select("id", geometry.box(F.col("e0"), F.col("e1"), F.col("e0") + size, F.col("e1") + size).alias("ring"))


OVERLAP_SQL = """p AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, label FROM embeddings),
o AS (SELECT a.id AS left_id, b.id AS right_id, (least(a.x + 0.04, b.x + 0.15) - greatest(a.x, b.x)) * (least(a.y + 0.04, b.y + 0.15) - greatest(a.y, b.y)) AS overlap,
  (a.x + 0.04 - a.x) * (a.y + 0.04 - a.y) AS whole FROM p a JOIN p b ON a.label <> 0 AND b.label = 0 AND a.x < b.x + 0.15 AND b.x < a.x + 0.04 AND a.y < b.y + 0.15 AND b.y < a.y + 0.04)"""


@query("block_zone_overlap", f"WITH {OVERLAP_SQL} SELECT left_id, right_id, round(overlap, 9) AS overlap FROM o WHERE overlap > 1e-9")
def block_zone_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spatial.overlaps(_boxes(spark, sf_dir, False), _boxes(spark, sf_dir, True), 0.15)
    return found.filter("overlap > 1e-9").select("left_id", "right_id", F.round("overlap", 9).alias("overlap"))


@query("block_zone_kind", f"""
WITH {OVERLAP_SQL}, s AS (SELECT *, overlap / whole AS share FROM o WHERE overlap / whole > 1e-6)
SELECT left_id, CASE WHEN count(*) = 1 AND max(share) >= 1 - 1e-6 THEN 'full' ELSE 'mixed' END AS kind FROM s GROUP BY left_id""")
def block_zone_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spatial.overlaps(_boxes(spark, sf_dir, False), _boxes(spark, sf_dir, True), 0.15)
    return spatial.association(found, 1e-6).select("left_id", "kind")


@query("nearest_site", """
WITH p AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, label FROM embeddings),
d AS (SELECT a.id AS left_id, b.id AS right_id, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS distance FROM p a JOIN p b ON b.id % 40 = 0 AND a.id % 40 <> 0)
SELECT left_id, round(distance, 9) AS distance FROM d QUALIFY row_number() OVER (PARTITION BY left_id ORDER BY distance, right_id) = 1""")
def nearest_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _points(spark, sf_dir).select("id", F.col("e0").alias("x"), F.col("e1").alias("y"))
    found = spatial.nearest(p.filter("id % 40 <> 0"), p.filter("id % 40 = 0"), 0.01)
    return found.select("left_id", F.round("distance", 9).alias("distance"))


SEGMENTS_SQL = "seg AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS x1, embedding[2]::DOUBLE AS y1, embedding[1]::DOUBLE + embedding[3]::DOUBLE / 4 AS x2, embedding[2]::DOUBLE + embedding[4]::DOUBLE / 4 AS y2 FROM embeddings WHERE label < 5)"


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = [F.col(f"e{i}") for i in range(4)]
    return _points(spark, sf_dir).filter("label < 5").select("id", c[0].alias("x1"), c[1].alias("y1"), (c[0] + c[2] / 4).alias("x2"), (c[1] + c[3] / 4).alias("y2"))


CROSS_SQL = f"""{SEGMENTS_SQL},
pairs AS (SELECT a.id AS a, b.id AS b, a.x1, a.y1, a.x2 - a.x1 AS rx, a.y2 - a.y1 AS ry, b.x2 - b.x1 AS sx, b.y2 - b.y1 AS sy, b.x1 - a.x1 AS qx, b.y1 - a.y1 AS qy FROM seg a JOIN seg b ON a.id < b.id),
met AS (SELECT *, (qx * sy - qy * sx) / (rx * sy - ry * sx) AS t, (qx * ry - qy * rx) / (rx * sy - ry * sx) AS u FROM pairs WHERE rx * sy - ry * sx <> 0),
hits AS (SELECT * FROM met WHERE t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1)"""


@query("road_crossings", f"WITH {CROSS_SQL} SELECT a, b, round(x1 + t * rx, 9) AS x, round(y1 + t * ry, 9) AS y FROM hits")
def road_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.crossings(_segments(spark, sf_dir), 0.05)
    return found.select("a", "b", F.round("x", 9).alias("x"), F.round("y", 9).alias("y"))


@query("roads_noded", f"""
WITH {CROSS_SQL}, cuts AS (SELECT id, 0::DOUBLE AS t FROM seg UNION SELECT id, 1 FROM seg UNION SELECT a, t FROM hits UNION SELECT b, u FROM hits),
runs AS (SELECT id, t AS f, lead(t) OVER (PARTITION BY id ORDER BY t) AS g, row_number() OVER (PARTITION BY id ORDER BY t) - 1 AS piece FROM cuts)
SELECT id, piece::INTEGER AS piece, round(x1 + f * (x2 - x1), 9) AS x1, round(y1 + f * (y2 - y1), 9) AS y1, round(x1 + g * (x2 - x1), 9) AS x2, round(y1 + g * (y2 - y1), 9) AS y2 FROM runs JOIN seg USING (id) WHERE g IS NOT NULL""")
def roads_noded(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.noded(_segments(spark, sf_dir), 0.05)
    return found.select("id", "piece", *[F.round(c, 9).alias(c) for c in ("x1", "y1", "x2", "y2")])


DISTANCE_SQL = f"""{SEGMENTS_SQL}, p AS (SELECT vec_id AS point, embedding[5]::DOUBLE AS x, embedding[6]::DOUBLE AS y FROM embeddings),
w AS (SELECT point, id AS line, x, y, x1, y1, x2 - x1 AS dx, y2 - y1 AS dy FROM p, seg),
t AS (SELECT *, greatest(0, least(1, coalesce(((x - x1) * dx + (y - y1) * dy) / nullif(dx * dx + dy * dy, 0), 0))) AS t FROM w),
d AS (SELECT point, line, sqrt((x - x1 - t * dx) ** 2 + (y - y1 - t * dy) ** 2) AS distance FROM t)"""


@query("road_setbacks", f"WITH {DISTANCE_SQL} SELECT point, line, round(distance, 9) AS distance FROM d WHERE distance <= 0.01")
def road_setbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda i: F.get("embedding", F.lit(i)).cast("double")
    points = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), at(4).alias("x"), at(5).alias("y"))
    return lines.within(points, _segments(spark, sf_dir), 0.01, 0.05).select("point", "line", F.round("distance", 9).alias("distance"))


@query("nearest_road", f"WITH {DISTANCE_SQL} SELECT point, round(min(distance), 9) AS distance FROM d WHERE distance <= 0.05 GROUP BY point")
def nearest_road(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda i: F.get("embedding", F.lit(i)).cast("double")
    points = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), at(4).alias("x"), at(5).alias("y"))
    return lines.nearest(points, _segments(spark, sf_dir), 0.05, 0.05).select("point", F.round("distance", 9).alias("distance"))
