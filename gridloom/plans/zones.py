"""Strips of land that share borders: slivers merged, zones refined, over the tables at hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions.geometry import box, polygon
from gridloom.operators import adjacency, splitting
from gridloom.plans.catalog import query, table

#: Rows of so many lots, each as wide as its part's size says.
LOTS = 40
SLIVER = 3.0
CLASSES = ("green", "industry", "living")
POLICY = {("living", "industry"): "forbidden", ("industry", "green"): "discouraged", ("green", "living"): "preferred"}
SMALLEST = {"green": 2.0, "industry": 9.0, "living": 6.0}
SHARES = {"green": 0.25, "industry": 0.25, "living": 0.5}

LOTS_SQL = f"""
lots AS MATERIALIZED (
  SELECT id, y, x1 - width AS x0, x1, width::DOUBLE AS area, (['green', 'industry', 'living'])[id * 7 % 11 % 3 + 1] AS cls FROM (
    SELECT p_partkey AS id, p_partkey // {LOTS} AS y, 1 + p_size % 4 AS width, sum(1 + p_size % 4) OVER (PARTITION BY p_partkey // {LOTS} ORDER BY p_partkey) AS x1 FROM part)),
pairs AS MATERIALIZED (
  SELECT least(p.id, q.id) AS a, greatest(p.id, q.id) AS b, CASE WHEN p.y = q.y THEN 1 ELSE least(p.x1, q.x1) - greatest(p.x0, q.x0) END::DOUBLE AS shared
  FROM lots p JOIN lots q ON (p.y = q.y AND p.x1 = q.x0) OR (q.y = p.y + 1 AND p.x0 < q.x1 AND q.x0 < p.x1)),
ways AS MATERIALIZED (SELECT a, b, shared FROM pairs UNION ALL SELECT b, a, shared FROM pairs)"""


def _lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(key.alias("id"), F.floor(key / LOTS).alias("y"), (F.col("p_size") % 4 + 1).alias("width"), F.element_at(F.array(*map(F.lit, CLASSES)), (key * 7 % 11 % 3 + 1).cast("int")).alias("zone_class"))
    rows = rows.withColumn("x", F.sum("width").over(Window.partitionBy("y").orderBy("id")).cast("double"))  # a row has LOTS lots at most
    y, x0 = F.col("y").cast("double"), F.col("x") - F.col("width")
    return rows.select("id", "zone_class", F.col("width").cast("double").alias("area"), F.array(polygon(box(x0, y, F.col("x"), y + 1))).alias("geom"))


@query("zone_borders", f"WITH {LOTS_SQL} SELECT a, b, shared FROM pairs")
def zone_borders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adjacency.borders(_lots(spark, sf_dir), 4.0)


def _slivers_sql(rounds: int = 32) -> str:
    """The rounds one after the other, each on the groups and borders that the one before left."""
    steps = [LOTS_SQL.strip(), "g0 AS (SELECT id AS grp, id AS least, area FROM lots)", "l0 AS (SELECT * FROM ways)", "m0 AS (SELECT id, id AS grp FROM lots)"]
    for i in range(rounds):
        steps += [
            f"k{i} AS MATERIALIZED (SELECT *, CASE WHEN area < {SLIVER} THEN printf('%06d', area::BIGINT) || md5(least::VARCHAR) END AS key FROM g{i})",
            f"o{i} AS MATERIALIZED (SELECT k.grp, least(k.key, min(n.key)) AS key FROM k{i} k JOIN l{i} ON a = k.grp JOIN k{i} n ON b = n.grp GROUP BY k.grp, k.key)",
            f"t{i} AS MATERIALIZED (SELECT k.grp FROM k{i} k JOIN l{i} ON a = k.grp JOIN o{i} n ON b = n.grp WHERE k.key IS NOT NULL GROUP BY k.grp, k.key HAVING k.key <= min(n.key))",
            f"v{i} AS MATERIALIZED (SELECT a AS source, b AS target FROM t{i} JOIN l{i} ON a = t{i}.grp JOIN g{i} n ON b = n.grp QUALIFY row_number() OVER (PARTITION BY a ORDER BY shared DESC, area DESC, least) = 1)",
            f"g{i + 1} AS MATERIALIZED (SELECT coalesce(target, grp) AS grp, min(least) AS least, sum(area) AS area FROM g{i} LEFT JOIN v{i} ON source = grp GROUP BY ALL)",
            f"l{i + 1} AS MATERIALIZED (SELECT coalesce(x.target, a) AS a, coalesce(y.target, b) AS b, sum(shared) AS shared FROM l{i} LEFT JOIN v{i} x ON x.source = a LEFT JOIN v{i} y ON y.source = b WHERE coalesce(x.target, a) <> coalesce(y.target, b) GROUP BY ALL)",
            f"m{i + 1} AS MATERIALIZED (SELECT id, coalesce(target, grp) AS grp FROM m{i} LEFT JOIN v{i} ON source = grp)",
        ]
    return f"WITH {', '.join(steps)}, merged AS (SELECT id, grp FROM m{rounds})"


@query("merged_slivers", f'{_slivers_sql()} SELECT id, grp AS "group", id <> grp AS merged FROM merged')
def merged_slivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    lots = _lots(spark, sf_dir)
    return adjacency.merge_slivers(lots, adjacency.borders(lots, 4.0), SLIVER)


@query("merged_lots", f'{_slivers_sql()} SELECT grp AS "group", sum(area) AS area FROM merged JOIN lots USING (id) GROUP BY grp')
def merged_lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    lots = _lots(spark, sf_dir)
    return adjacency.dissolved(lots, adjacency.merge_slivers(lots, adjacency.borders(lots, 4.0), SLIVER), 4.0).select("group", "area")


def _refined_sql(rounds: int = 24) -> str:
    weight = "CASE WHEN option = near THEN 0 WHEN least(option, near) = 'green' THEN CASE greatest(option, near) WHEN 'industry' THEN 1000 ELSE -1 END ELSE 1000000 END"
    steps = [LOTS_SQL.strip(), "c0 AS (SELECT id, cls FROM lots)"]
    for i in range(rounds):
        steps += [
            f"n{i} AS MATERIALIZED (SELECT a AS id, cls AS near, count(*) AS n FROM ways JOIN c{i} ON id = b GROUP BY ALL)",
            f"o{i} AS (SELECT id, near AS option FROM n{i} UNION SELECT id, cls FROM c{i} WHERE id IN (SELECT id FROM n{i}))",
            f"k{i} AS MATERIALIZED (SELECT id, option, sum(n * {weight}) AS cost FROM o{i} JOIN n{i} USING (id) GROUP BY ALL)",
            f"v{i} AS MATERIALIZED (SELECT k.id, k.option, k.cost - now.cost AS gain FROM k{i} k JOIN c{i} c ON c.id = k.id JOIN k{i} now ON now.id = c.id AND now.option = c.cls QUALIFY row_number() OVER (PARTITION BY k.id ORDER BY k.cost, k.option) = 1)",
            f"w{i} AS MATERIALIZED (SELECT * FROM v{i} WHERE gain < 0)",
            f"x{i} AS MATERIALIZED (SELECT m.id, m.option FROM w{i} m WHERE NOT EXISTS (SELECT 1 FROM ways JOIN w{i} r ON r.id = ways.b WHERE ways.a = m.id AND (r.gain < m.gain OR (r.gain = m.gain AND md5(r.id::VARCHAR) < md5(m.id::VARCHAR)))))",
            f"c{i + 1} AS MATERIALIZED (SELECT id, coalesce(option, cls) AS cls FROM c{i} LEFT JOIN x{i} USING (id))",
        ]
    return f"WITH RECURSIVE {', '.join(steps)}, refined AS (SELECT id, cls FROM c{rounds})"


def _refined(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    lots = _lots(spark, sf_dir).select("id", "area", "zone_class", "geom")
    pairs = adjacency.borders(lots, 4.0)
    return adjacency.refine(lots.drop("geom"), pairs, POLICY), pairs


@query("refined_zones", f"{_refined_sql()} SELECT id, cls AS zone_class FROM refined")
def refined_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _refined(spark, sf_dir)[0].select("id", "zone_class")


@query("zone_objective", f"""{_refined_sql()},
z AS MATERIALIZED (SELECT lots.id, area, refined.cls FROM lots JOIN refined USING (id)),
same AS MATERIALIZED (SELECT w.a, w.b FROM ways w JOIN z p ON p.id = w.a JOIN z q ON q.id = w.b WHERE p.cls = q.cls),
step(id, top) AS (SELECT id, id FROM z UNION SELECT same.b, step.top FROM step JOIN same ON same.a = step.id WHERE step.top < same.b),
part_ AS (SELECT id, min(top) AS region FROM step GROUP BY id),
sizes AS (SELECT region, cls, CASE cls WHEN 'green' THEN 2 WHEN 'industry' THEN 9 ELSE 6 END - sum(area) AS lack FROM z JOIN part_ USING (id) GROUP BY region, cls),
touch AS (SELECT p.cls AS p, q.cls AS q FROM pairs JOIN z p ON p.id = a JOIN z q ON q.id = b WHERE p.cls <> q.cls),
held AS (SELECT sum(area) AS total, sum(area) FILTER (WHERE cls = 'green') AS g, sum(area) FILTER (WHERE cls = 'industry') AS i, sum(area) FILTER (WHERE cls = 'living') AS l FROM z)
SELECT (SELECT count(*) FROM touch WHERE 'green' NOT IN (p, q))::BIGINT AS forbidden, (SELECT count(*) FROM sizes WHERE lack > 0)::BIGINT AS undersized, (SELECT coalesce(sum(lack), 0) FROM sizes WHERE lack > 0)::DOUBLE AS shortfall,
  (SELECT count(*) FROM touch WHERE 'living' NOT IN (p, q))::BIGINT AS discouraged, -(SELECT count(*) FROM touch WHERE 'industry' NOT IN (p, q))::BIGINT AS not_preferred, (SELECT abs(g - total * 0.25) + abs(i - total * 0.25) + abs(l - total * 0.5) FROM held)::DOUBLE AS target_error""")
def zone_objective(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adjacency.objective(*_refined(spark, sf_dir), POLICY, SMALLEST, SHARES)


SPLIT = 5.0


@query("split_blocks", f"""
WITH RECURSIVE cut(id, w, h) AS (
  SELECT s_suppkey, (2 + s_suppkey % 7)::DOUBLE, (1 + s_suppkey % 5)::DOUBLE FROM supplier
  UNION ALL SELECT id, CASE WHEN w > h THEN w / 2 ELSE w END, CASE WHEN w > h THEN h ELSE h / 2 END FROM cut, range(2) WHERE w * h > {SPLIT})
SELECT id, count(*)::BIGINT AS parts, round(min(w * h), 6) AS smallest, round(sum(w * h), 6) AS area FROM cut WHERE w * h <= {SPLIT} GROUP BY id""")
def split_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    x = (key * 10).cast("double")
    blocks = table(spark, sf_dir, "supplier").select(key.alias("id"), F.array(polygon(box(x, F.lit(0.0), x + 2 + key % 7, 1.0 + key % 5))).alias("geom"))
    found = splitting.split(blocks, SPLIT, 4.0).groupBy("id").agg(F.count("*").alias("parts"), F.round(F.min("area"), 6).alias("smallest"), F.round(F.sum("area"), 6).alias("area"))
    return found
