"""Layers written and replaced owner by owner, and rasters by windows and on other grids, over the tables at hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import raster, resample
from gridloom.operators.tables import new_path
from gridloom.plans.catalog import query, table
from gridloom.sources import layers

WIDTH = 20


def _buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("run_id"), F.col("c_custkey").alias("building_key"), F.floor(F.col("c_custkey") / 15).alias("block_id"), F.col("c_mktsegment").alias("archetype"),
        (F.col("c_custkey") % 9 + 1).alias("floors"), (F.abs(F.col("c_acctbal")) + 1).alias("footprint_area_m2"), F.col("c_name").alias("label"),
    )
    return rows


@query("replaced_buildings", """
SELECT c_nationkey::VARCHAR AS run_id, c_custkey::VARCHAR AS building_key, CASE WHEN c_nationkey = 3 THEN 20 ELSE c_custkey % 9 + 1 END::INTEGER AS floors, round(abs(c_acctbal) + 1, 2) AS footprint_area_m2,
  '{"label":"' || c_name || '"}' AS attributes_json FROM customer WHERE c_nationkey NOT IN (3, 4) OR (c_nationkey = 3 AND c_acctbal > 0)""")
def replaced_buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All runs' buildings, then those of run 3 replaced twice by others and those of run 4 by none."""
    path, layer, rows = new_path(spark, "buildings"), layers.LAYERS["buildings"], _buildings(spark, sf_dir)
    layers.write(rows, layer, path, [str(i) for i in range(25)])
    again = rows.filter("run_id = 3 and footprint_area_m2 > 1").join(table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("building_key")), "building_key").withColumn("floors", F.lit(20))
    for _ in range(2):
        layers.write(again, layer, path, ["3", "4"])
    return layers.read(spark, layer, path).select("run_id", "building_key", "floors", F.round("footprint_area_m2", 2).alias("footprint_area_m2"), "attributes_json")


CELLS_SQL = f"""
cells AS (SELECT p_partkey // {WIDTH} AS row, p_partkey % {WIDTH} AS col, CASE WHEN p_size <> 13 THEN p_retailprice END AS value FROM part),
size AS (SELECT max(row) + 1 AS height FROM cells)"""


def _cells(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    key = F.col("p_partkey")
    cells = table(spark, sf_dir, "part").select(F.floor(key / WIDTH).alias("row"), F.pmod(key, F.lit(WIDTH)).alias("col"), F.when(F.col("p_size") != 13, F.col("p_retailprice")).alias("value"))
    return cells, cells.agg(F.max("row")).head()[0] + 1


@query("raster_resampled", f"""
WITH {CELLS_SQL},
t AS (SELECT r.row, c.col, (height - (height - 1.0 - (r.row + 0.5) * 0.75)) / 1.0 AS v, (2.0 + (c.col + 0.5) * 0.75 - 0.0) / 1.0 AS u
  FROM size, range(100000) r(row), range(100) c(col) WHERE r.row < greatest(1, ceil((height - 1) / 0.75)) AND c.col < greatest(1, ceil(({WIDTH} - 2) / 0.75))),
b AS (SELECT row, col, floor(v - 0.5) + i AS r, floor(u - 0.5) + j AS c, CASE i WHEN 1 THEN v - 0.5 - floor(v - 0.5) ELSE 1 - (v - 0.5 - floor(v - 0.5)) END * CASE j WHEN 1 THEN u - 0.5 - floor(u - 0.5) ELSE 1 - (u - 0.5 - floor(u - 0.5)) END AS w FROM t, range(2) a(i), range(2) d(j)),
s AS (SELECT b.row, b.col, sum(w * value) / nullif(sum(w) FILTER (WHERE value IS NOT NULL), 0) AS bilinear FROM b LEFT JOIN cells x ON x.row = r AND x.col = c GROUP BY ALL)
SELECT t.row, t.col, round(n.value, 6) AS nearest, round(bilinear, 6) AS bilinear FROM t LEFT JOIN cells n ON n.row = floor(v) AND n.col = floor(u) JOIN s ON s.row = t.row AND s.col = t.col""")
def raster_resampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, height = _cells(spark, sf_dir)
    source = resample.Grid(0.0, float(height), 1.0, 1.0, height, WIDTH)
    target = resample.target_grid(source.bounds(), 0.75, 0.75, (2.0, -5.0, 50.0, height - 1.0))
    of = lambda method: resample.resample(cells, source, target, method).withColumn("value", F.round("value", 6)).withColumnRenamed("value", method)
    return of("nearest").join(of("bilinear"), ["row", "col"])


@query("raster_window_slope", f"""
WITH {CELLS_SQL}, w AS (SELECT r.row, c.col FROM range(3, 9) r(row), range(4, 16) c(col))
SELECT w.row, w.col, round(CASE WHEN o.value IS NOT NULL THEN degrees(atan(sqrt(((e.value - a.value) / 50) ** 2 + ((s.value - n.value) / 50) ** 2))) END, 6) AS slope FROM w JOIN cells o ON o.row = w.row AND o.col = w.col
LEFT JOIN cells e ON e.row = w.row AND e.col = w.col + 1 LEFT JOIN cells a ON a.row = w.row AND a.col = w.col - 1
LEFT JOIN cells s ON s.row = w.row + 1 AND s.col = w.col LEFT JOIN cells n ON n.row = w.row - 1 AND n.col = w.col""")
def raster_window_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of the raster stored as windows; the slopes of one window, read with a halo of one cell."""
    path = new_path(spark, "windows")
    resample.write_windows(_cells(spark, sf_dir)[0], path, 8)
    window = resample.read_window(spark, path, 3, 4, 6, 12, 8, halo=1)
    return raster.slope(window, 25.0).filter("row between 3 and 8 and col between 4 and 15").select("row", "col", F.round("slope", 6).alias("slope"))


@query("raster_sums", f"""
WITH {CELLS_SQL}
SELECT row // 6 AS zone_row, col // 7 AS zone_col, round(coalesce(sum(value), 0), 4) AS total, count(value)::BIGINT AS cells,
  ((least(height, (row // 6 + 1) * 6) - row // 6 * 6) * (least({WIDTH}, (col // 7 + 1) * 7) - col // 7 * 7) - count(value))::BIGINT AS missing FROM cells, size GROUP BY row // 6, col // 7, height""")
def raster_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, height = _cells(spark, sf_dir)
    return resample.window_sums(cells, 6, 7, height, WIDTH).withColumn("total", F.round("total", 4))
