"""Road graphs, their components, measures and classes over the tables at hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import network, roads, spanning
from gridloom.operators.tables import new_path
from gridloom.plans.catalog import query, table
from gridloom.sources import geojson

PARTS_SQL = """parts AS (SELECT s_suppkey AS road, part, ((s_suppkey * 7 + part * 3) % 23)::DOUBLE AS sx, ((s_suppkey * 5 + part) % 17)::DOUBLE AS sy, ((s_suppkey * 11 + part) % 23)::DOUBLE AS tx, ((s_suppkey * 3 + part * 5) % 17)::DOUBLE AS ty,
  (s_suppkey % 40)::DOUBLE AS length, s_suppkey % 3 = 0 AS is_source, s_suppkey % 5 = 0 AS is_fixed FROM supplier, (VALUES (0), (1)) AS v(part))"""
GRAPH_SQL = f"""{PARTS_SQL}, good AS (SELECT * FROM parts WHERE length > 0),
ends AS (SELECT sx AS x, sy AS y, is_source, is_fixed FROM good UNION ALL SELECT tx, ty, is_source, is_fixed FROM good),
nodes AS (SELECT 'node:' || lpad((row_number() OVER (ORDER BY x, y) - 1)::VARCHAR, 8, '0') AS node, x, y, bool_or(is_source) AS is_source, bool_or(is_fixed) AS is_fixed FROM ends GROUP BY x, y),
edges AS (SELECT 'edge:' || lpad((row_number() OVER (ORDER BY road, part) - 1)::VARCHAR, 8, '0') AS edge, s.node AS src, t.node AS dst, road, part, length, g.is_source, g.is_fixed
  FROM good g JOIN nodes s ON s.x = sx AND s.y = sy JOIN nodes t ON t.x = tx AND t.y = ty)"""


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("road"), F.explode(F.array(F.lit(0), F.lit(1))).alias("part"))
    k, p = F.col("road"), F.col("part")
    to = lambda c, n: (c % n).cast("double")
    return roads.build(s.select(
        "road", "part", to(k * 7 + p * 3, 23).alias("sx"), to(k * 5 + p, 17).alias("sy"), to(k * 11 + p, 23).alias("tx"), to(k * 3 + p * 5, 17).alias("ty"),
        to(k, 40).alias("length"), (k % 3 == 0).alias("is_source"), (k % 5 == 0).alias("is_fixed"),
    ))


@query("road_nodes", f"WITH {GRAPH_SQL} SELECT node, x, y, is_source, is_fixed FROM nodes")
def road_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir)[0]


@query("road_edges", f"WITH {GRAPH_SQL} SELECT edge, src, dst, road, part, length, is_source, is_fixed FROM edges")
def road_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir)[1]


@query("road_components", f"""
WITH RECURSIVE {GRAPH_SQL}, ways AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges),
reach(a, b) AS (SELECT node, node FROM nodes UNION SELECT r.a, w.b FROM reach r JOIN ways w ON r.b = w.a),
c AS (SELECT a AS node, min(b) AS component FROM reach GROUP BY a),
e AS (SELECT component, count(*) AS edges, sum(length) AS length FROM edges JOIN c ON src = node GROUP BY component)
SELECT component, count(*)::BIGINT AS nodes, coalesce(any_value(edges), 0)::BIGINT AS edges, coalesce(any_value(length), 0) AS length FROM c LEFT JOIN e USING (component) GROUP BY component""")
def road_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roads.component_diagnostics(*_graph(spark, sf_dir))


@query("road_measures", f"""
WITH {GRAPH_SQL}, d AS (SELECT node, count(e) AS degree FROM nodes LEFT JOIN (SELECT src AS e FROM edges UNION ALL SELECT dst FROM edges) ON e = node GROUP BY node),
c AS (SELECT length, e.is_source, sqrt((s.x - t.x) ** 2 + (s.y - t.y) ** 2) AS chord FROM edges e JOIN nodes s ON s.node = src JOIN nodes t ON t.node = dst),
n AS (SELECT count(*) AS nodes, avg(degree) AS mean_degree, max(degree) AS max_degree, count(*) FILTER (WHERE degree >= 3) AS intersections, count(*) FILTER (WHERE degree = 1) AS dead_ends FROM d),
m AS (SELECT count(*) AS edges, sum(length) AS length_m, sum(CASE WHEN NOT is_source THEN length ELSE 0 END) AS generated_m, sum(CASE WHEN chord > 0 THEN length END) / sum(CASE WHEN chord > 0 THEN chord END) AS circuity FROM c)
SELECT nodes::BIGINT AS nodes, round(mean_degree, 9) AS mean_degree, max_degree::BIGINT AS max_degree, intersections::BIGINT AS intersections, dead_ends::BIGINT AS dead_ends, edges::BIGINT AS edges, length_m, generated_m, round(circuity, 9) AS circuity,
  round(length_m / 1000 / 2.5, 9) AS density_km_per_km2, round(intersections / 2.5, 9) AS intersections_per_km2 FROM n, m""")
def road_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = roads.metrics(*_graph(spark, sf_dir), 2_500_000.0)
    rounded = ("mean_degree", "circuity", "density_km_per_km2", "intersections_per_km2")
    return found.select(*[F.round(c, 9).alias(c) if c in rounded else F.col(c).cast("long").alias(c) if c == "max_degree" else c for c in found.columns])


@query("road_cleanup", f"""
WITH {GRAPH_SQL}, one AS (SELECT * FROM edges QUALIFY row_number() OVER (PARTITION BY least(src, dst), greatest(src, dst), length ORDER BY NOT is_fixed, edge) = 1)
SELECT edge, src, dst, length FROM one WHERE is_fixed OR length >= 4""")
def road_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roads.without_tiny(roads.without_copies(_graph(spark, sf_dir)[1]), 4.0).select("edge", "src", "dst", "length")


@query("road_classes", """
SELECT o_orderkey, CASE WHEN o_totalprice >= 200000 THEN 'arterial' WHEN o_totalprice >= 120000 OR o_orderkey % 3 = 1 THEN 'collector' ELSE 'local' END AS class,
  CASE WHEN o_totalprice >= 200000 THEN 'arterial_length' WHEN o_totalprice >= 120000 THEN 'collector_length' WHEN o_orderkey % 3 = 1 THEN 'collector_intent_floor' ELSE 'local_default' END AS reason FROM orders""")
def road_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    found = roads.classify(F.col("o_totalprice"), key % 3 == 0, key % 3 == 1, 200_000.0, 120_000.0)
    return table(spark, sf_dir, "orders").select("o_orderkey", found["class"].alias("class"), found["reason"].alias("reason"))


@query("road_spanning_tree", f"""
WITH RECURSIVE {GRAPH_SQL}, e AS (SELECT row_number() OVER (ORDER BY length, edge) AS place, edge, src, dst, length FROM edges WHERE src <> dst),
ways AS (SELECT place, src AS a, dst AS b FROM e UNION ALL SELECT place, dst, src FROM e),
reach(top, node) AS (SELECT place, src FROM e UNION SELECT r.top, w.b FROM reach r JOIN ways w ON w.a = r.node AND w.place < r.top)
SELECT edge, src, dst, length FROM e WHERE NOT EXISTS (SELECT 1 FROM reach WHERE top = place AND node = dst)""")
def road_spanning_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spanning.minimum_spanning_forest(_graph(spark, sf_dir)[1])


@query("snapped_ends", """
WITH RECURSIVE p AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings),
near AS (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON a.id <> b.id AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 0.004),
reach(a, b) AS (SELECT id, id FROM p UNION SELECT r.a, n.b FROM reach r JOIN near n ON r.b = n.a), c AS (SELECT a AS id, min(b) AS cluster FROM reach GROUP BY a)
SELECT c.id, cluster, x, y FROM c JOIN p ON p.id = cluster""")
def snapped_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda i: F.get("embedding", F.lit(i)).cast("double")
    return spanning.snapped(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), at(0).alias("x"), at(1).alias("y")), 0.004)


def _access_sql(rounds: int = 8) -> str:
    """Costs relaxed ``rounds`` times, which is more than the steps of any path within the bound."""
    steps = ["c AS (SELECT (p_partkey // 20)::INTEGER AS row, (p_partkey % 20)::INTEGER AS col, 1 + 2 * (1 - avg(p_size) / 60) AS cost FROM part WHERE p_size > 5 GROUP BY ALL)"]
    steps.append("w AS (SELECT a.row, a.col, b.row AS row2, b.col AS col2, sqrt((a.row - b.row) ** 2 + (a.col - b.col) ** 2) * 10 * (a.cost + b.cost) / 2 AS length FROM c a JOIN c b ON abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 AND (a.row <> b.row OR a.col <> b.col) AND (a.row = b.row OR a.col = b.col OR (EXISTS (SELECT 1 FROM c WHERE row = a.row AND col = b.col) AND EXISTS (SELECT 1 FROM c WHERE row = b.row AND col = a.col))))")
    steps.append("d0 AS (SELECT row, col, 0::DOUBLE AS cost FROM c WHERE row % 5 = 0 AND col % 5 = 0)")
    for i in range(rounds):
        steps.append(f"d{i + 1} AS MATERIALIZED (SELECT row, col, min(cost) AS cost FROM (SELECT row, col, cost FROM d{i} UNION ALL SELECT row2, col2, cost + length FROM d{i} JOIN w USING (row, col) WHERE cost + length <= 60) GROUP BY row, col)")
    return f"WITH {', '.join(steps)} SELECT row::BIGINT AS row, col::BIGINT AS col, round(cost, 6) AS cost FROM d{rounds}"


@query("raster_access", _access_sql())
def raster_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey").cast("int")
    cells = table(spark, sf_dir, "part").filter("p_size > 5").groupBy((key / 20).cast("int").alias("row"), F.pmod(key, F.lit(20)).alias("col")).agg((F.avg("p_size") / 60).alias("score"))
    node = F.shiftleft(F.col("row").cast("long"), 32).bitwiseOR(F.col("col"))
    sources = cells.filter("row % 5 = 0 and col % 5 = 0").select(node.alias("node"))
    found = network.nearest_sources(network.raster_edges(cells, 10.0, 2.0, diagonal=True), sources, 60.0)
    return found.select(F.shiftright("node", 32).alias("row"), F.col("node").bitwiseAND((1 << 32) - 1).alias("col"), F.round("distance", 6).alias("cost"))


@query("geojson_inspection", """
WITH p AS (SELECT s_suppkey AS k, (s_suppkey % 7)::DOUBLE AS x, (s_suppkey % 11)::DOUBLE AS y, (['Point', 'LineString', 'Polygon', 'MultiLineString'])[(s_suppkey % 4 + 1)::INTEGER] AS kind FROM supplier)
SELECT kind, count(*)::BIGINT AS features, 0::BIGINT AS problems, min(x) AS min_x, min(y) AS min_y, max(CASE WHEN kind = 'Point' THEN x ELSE x + 2 END) AS max_x, max(CASE WHEN kind = 'Point' THEN y ELSE y + 1 END) AS max_y FROM p GROUP BY kind""")
def geojson_inspection(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    x, y = (k % 7).cast("double"), (k % 11).cast("double")
    at = lambda dx, dy: F.struct((x + dx).alias("x"), (y + dy).alias("y"))
    parts = {"Point": F.array(F.array(at(0, 0))), "LineString": F.array(F.array(at(0, 0), at(2, 1))), "Polygon": F.array(F.array(at(0, 0), at(2, 0), at(2, 1))), "MultiLineString": F.array(F.array(at(0, 0), at(1, 1)), F.array(at(1, 0), at(2, 1)))}
    kind = F.element_at(F.array(*map(F.lit, parts)), (k % 4 + 1).cast("int"))
    value = F.when(k % 4 == 0, parts["Point"]).when(k % 4 == 1, parts["LineString"]).when(k % 4 == 2, parts["Polygon"]).otherwise(parts["MultiLineString"])
    rows = table(spark, sf_dir, "supplier").select(k.cast("string").alias("id"), F.create_map(F.lit("name"), F.col("s_name")).alias("properties"), kind.alias("kind"), value.alias("parts"))
    path = new_path(spark, "features")
    geojson.write_features(rows, path)
    return geojson.inspect(geojson.read_features(spark, path))


@query("building_areas", """
WITH b AS (SELECT p_brand, p_size * 10::DOUBLE AS footprint, (p_partkey % 5 + 1) AS floors, (['house', 'block', 'tower'])[(p_partkey % 3 + 1)::INTEGER] AS kind FROM part)
SELECT p_brand, count(*)::BIGINT AS buildings, sum(footprint) AS footprint_m2, sum(footprint * floors) AS gfa_m2, round(sum(footprint) / 50000, 9) AS coverage, round(sum(footprint * floors) / 50000, 9) AS far,
  round(count(*) FILTER (WHERE kind = 'house') / count(*), 9) AS house_share, round(count(*) FILTER (WHERE kind = 'block') / count(*), 9) AS block_share, round(count(*) FILTER (WHERE kind = 'tower') / count(*), 9) AS tower_share, 0::DOUBLE AS hall_share FROM b GROUP BY p_brand""")
def building_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    kind = F.element_at(F.array(*map(F.lit, ("house", "block", "tower"))), (k % 3 + 1).cast("int"))
    b = table(spark, sf_dir, "part").select("p_brand", (F.col("p_size") * 10.0).alias("footprint"), (k % 5 + 1).alias("floors"), kind.alias("kind"))
    found = roads.building_areas(b, "p_brand", 50_000.0, ["house", "block", "tower", "hall"])
    rounded = ("coverage", "far", *[c for c in found.columns if c.endswith("_share")])
    return found.select(*[F.round(c, 9).alias(c) if c in rounded else c for c in found.columns])
