"""OpenStreetMap features, with tags made from the tables at hand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import osm
from gridloom.plans.catalog import query, table

#: Values that the rows of a table take by turns.
HIGHWAYS = ("motorway", " Primary ", "residential", "track", "steps", "proposed", "trunk_link", "service", None, "MOTORWAY_LINK", "living_street")
SPEEDS = ("50", "30 mph", " 80 km/h", "none", "kph", "70kph", None, "0", "12.5 MPH")
LANES = ("2", "0", " 3 ", "two", None, "-1", "12")
ONE_WAYS = ("yes", "no", "-1", None, "reversible", " TRUE", "0")
HEIGHTS = ("12", "30 ft", "9.5 m", "high", None, "40'", "3 metres", "0")
LAYERS = ("1", "-2", "x", None, "99999999999", "+3")
BRIDGES = ("yes", "no", None, "viaduct", "0")
AMENITIES = ("school", None, "cafe", "bank", None, "police", "Pharmacy ", "townhall")
LANDUSES = (None, "residential", "basin", "farmland", "quarry", None, "reservoir", "meadow", "construction")
WATERS = (None, None, "pond", "moat", None, "reservoir")
BUILDINGS = ("house", None, "hotel", None, "shed", "clinic", "garages")
SHOPS = (None, None, None, "bakery", "books")


def _turn(values: tuple[str | None, ...], key: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (key % len(values) + 1).cast("int"))


def _sql(values: tuple[str | None, ...], key: str) -> str:
    items = ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values)
    return f"([{items}])[({key} % {len(values)} + 1)::INTEGER]"


def _strip(c: str) -> str:
    return rf"nullif(regexp_replace({c}, '^\s+|\s+$', '', 'g'), '')"


def _classified(category: str, column: dict[str, str]) -> tuple[str, str]:
    """CASE expressions of the class and of the rule, by the SQL columns that hold the tags."""
    lines = {"class": [], "rule": []}
    for rule, key, values, mapped in osm.RULES[category]:
        if key in column:
            found = f"lower({column[key]})"
            test = f"{found} IN ({', '.join(repr(v) for v in values)})" if values else f"{found} IS NOT NULL"
            lines["class"].append(f"WHEN {test} THEN '{mapped}'")
            lines["rule"].append(f"WHEN {test} THEN '{rule}'")
    return tuple(f"CASE {' '.join(lines[k])} ELSE '{d}' END" for k, d in (("class", "other"), ("rule", "default")))


_ROAD = _classified("roads", {"highway": "highway"})


@query("osm_roads", rf"""
WITH w AS (SELECT o_orderkey, {_strip(_sql(HIGHWAYS, 'o_orderkey'))} AS highway, {_sql(SPEEDS, 'o_orderkey')} AS speed, {_strip(_sql(LANES, 'o_orderkey'))} AS lanes,
  lower({_strip(_sql(ONE_WAYS, 'o_orderkey'))}) AS oneway, lower({_strip(_sql(LAYERS, 'o_custkey'))}) AS layer, lower({_strip(_sql(BRIDGES, 'o_custkey'))}) AS bridge,
  CASE WHEN o_custkey % 13 = 0 THEN 'roundabout' END AS junction FROM orders),
s AS (SELECT *, try_cast(nullif(regexp_extract(speed, '(?i)^\s*(\d+(?:\.\d+)?)\s*(km/?h|kph|mph)?\s*$', 1), '') AS DOUBLE)
  * CASE WHEN lower(regexp_extract(speed, '(?i)^\s*(\d+(?:\.\d+)?)\s*(km/?h|kph|mph)?\s*$', 2)) = 'mph' THEN 1.609344 ELSE 1 END AS kph FROM w)
SELECT o_orderkey, {_ROAD[0]} AS road_class, {_ROAD[1]} AS rule, CASE WHEN regexp_full_match(lanes, '\d+') AND try_cast(lanes AS INTEGER) > 0 THEN try_cast(lanes AS INTEGER) END AS lanes,
  round(CASE WHEN kph > 0 THEN kph END, 6) AS max_speed_kph, coalesce(oneway IN ('yes', 'true', '1', '-1'), false) AS one_way,
  CASE WHEN oneway IN ('yes', 'true', '1') THEN 'forward' WHEN oneway IN ('-1', 'reverse') THEN 'reverse' WHEN oneway IS NOT NULL THEN 'both'
    WHEN junction = 'roundabout' OR lower(highway) IN ('motorway', 'motorway_link') THEN 'forward' ELSE 'both' END AS direction,
  coalesce(bridge NOT IN ('no', 'false', '0'), false) AS bridge, coalesce(CASE WHEN regexp_full_match(layer, '[+-]?\d+') THEN try_cast(layer AS INTEGER) END, 0) AS layer FROM s""")
def osm_roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, other = F.col("o_orderkey"), F.col("o_custkey")
    tags = osm.extract_tags({
        "highway": _turn(HIGHWAYS, key), "maxspeed": _turn(SPEEDS, key), "lanes": _turn(LANES, key), "oneway": _turn(ONE_WAYS, key), "layer": _turn(LAYERS, other),
        "bridge": _turn(BRIDGES, other), "junction": F.when(other % 13 == 0, "roundabout"),
    })
    ways = table(spark, sf_dir, "orders").select("o_orderkey", tags.alias("tags"))
    t = lambda k: F.col("tags")[k]
    found = osm.classify(F.col("tags"), "roads")
    return ways.select(
        "o_orderkey", found["class"].alias("road_class"), found["rule"].alias("rule"), osm.positive_int(t("lanes")).alias("lanes"), F.round(osm.max_speed_kph(t("maxspeed")), 6).alias("max_speed_kph"),
        osm.one_way(t("oneway")).alias("one_way"), osm.one_way_direction(F.col("tags")).alias("direction"), osm.structure_flag(t("bridge")).alias("bridge"), osm.layer(t("layer")).alias("layer"),
    )


_TAGS = {"amenity": "amenity", "landuse": "landuse", "water": "water", "building": "building", "shop": "shop"}
_PER_CATEGORY = " UNION ALL ".join(
    f"SELECT p_partkey, '{c}' AS category, {_classified(c, _TAGS)[0]} AS class, {_classified(c, _TAGS)[1]} AS rule FROM f WHERE {test}"
    for c, test in {"buildings": "building IS NOT NULL", "poi": "amenity IS NOT NULL OR shop IS NOT NULL", "landuse": "landuse IS NOT NULL", "water": "water IS NOT NULL OR landuse IN ('reservoir', 'basin')"}.items()
)


@query("osm_features", f"""
WITH f AS (SELECT p_partkey, {_strip(_sql(AMENITIES, 'p_partkey'))} AS amenity, {_strip(_sql(LANDUSES, 'p_partkey'))} AS landuse, {_strip(_sql(WATERS, 'p_partkey'))} AS water,
  {_strip(_sql(BUILDINGS, 'p_partkey'))} AS building, {_strip(_sql(SHOPS, 'p_partkey'))} AS shop FROM part)
SELECT category, class, rule, count(*)::BIGINT AS features FROM ({_PER_CATEGORY}) GROUP BY ALL""")
def osm_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    packed = F.to_json(F.struct(_turn(BUILDINGS, key).alias("building"), _turn(SHOPS, key).alias("shop"), F.lit("left out").alias("amenity")))
    packed = F.when(_turn(AMENITIES, key).isNotNull(), packed).otherwise(F.to_json(F.struct(_turn(BUILDINGS, key).alias("building"), _turn(SHOPS, key).alias("shop"))))
    tags = osm.extract_tags({"amenity": _turn(AMENITIES, key), "landuse": _turn(LANDUSES, key), "water": _turn(WATERS, key)}, packed)
    features = table(spark, sf_dir, "part").select("p_partkey", tags.alias("tags"))
    features = features.select("tags", F.explode(osm.categories(F.col("tags"))).alias("category"))
    found = F.struct(F.lit(None).cast("string").alias("class"), F.lit(None).cast("string").alias("rule"))
    for c in osm.RULES:
        found = F.when(F.col("category") == c, osm.classify(F.col("tags"), c)).otherwise(found)
    return features.select("category", found.alias("f")).groupBy("category", "f.class", "f.rule").agg(F.count("*").alias("features"))


@query("osm_identities", rf"""
WITH f AS (SELECT p_partkey, (['points', 'lines', 'multilinestrings', 'multipolygons'])[(p_partkey % 4 + 1)::INTEGER] AS layer, CASE WHEN p_partkey % 3 <> 0 THEN p_partkey * 10 END AS osm_id,
  CASE WHEN p_partkey % 5 < 2 THEN p_partkey * 10 + 1 END AS way_id, {_sql(HEIGHTS, 'p_partkey')} AS height FROM part),
h AS (SELECT *, try_cast(nullif(regexp_extract(height, '(?i)^\s*(\d+(?:\.\d+)?)\s*(m|meter|meters|metre|metres|ft|feet|'')?\s*$', 1), '') AS DOUBLE)
  * CASE WHEN lower(regexp_extract(height, '(?i)^\s*(\d+(?:\.\d+)?)\s*(m|meter|meters|metre|metres|ft|feet|'')?\s*$', 2)) IN ('ft', 'feet', '''') THEN 0.3048 ELSE 1 END AS m FROM f)
SELECT p_partkey, CASE WHEN layer = 'multipolygons' THEN CASE WHEN way_id IS NOT NULL AND osm_id IS NULL THEN 'osm:way:' || way_id WHEN way_id IS NULL AND osm_id IS NOT NULL THEN 'osm:relation:' || osm_id END
  WHEN osm_id IS NOT NULL THEN 'osm:' || CASE layer WHEN 'points' THEN 'node' WHEN 'lines' THEN 'way' ELSE 'relation' END || ':' || osm_id END AS feature_id, round(CASE WHEN m > 0 THEN m END, 6) AS height_m FROM h""")
def osm_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    layer = _turn(("points", "lines", "multilinestrings", "multipolygons"), key)
    found = osm.identity(layer, F.when(key % 3 != 0, key * 10), F.when(key % 5 < 2, key * 10 + 1))
    return table(spark, sf_dir, "part").select("p_partkey", found.alias("feature_id"), F.round(osm.distance_m(_turn(HEIGHTS, key)), 6).alias("height_m"))
