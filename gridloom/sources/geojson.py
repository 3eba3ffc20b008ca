"""GeoJSON features, one a line, as rows and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FEATURE = "type string, id string, properties map<string, string>, geometry struct<type: string, coordinates: string>"
POINTS = "array<struct<x: double, y: double>>"
#: How deep a point lies in the coordinates of each kind, and whether its parts are closed rings.
KINDS = {"Point": (0, False), "MultiPoint": (1, False), "LineString": (1, False), "MultiLineString": (2, False), "Polygon": (2, True), "MultiPolygon": (3, True)}


def _point(p: Column) -> Column:
    return F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))


def _open(ring: Column) -> Column:
    return F.slice(ring, F.lit(1), F.greatest(F.size(ring) - 1, F.lit(0)))


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """``(id, properties, kind, parts, polygons, problem)`` of every line.

    ``parts`` are lists of ``struct<x, y>``: a point or several, lines, or rings whose last point
    is not repeated (of all polygons of a feature, one after the other). ``polygons`` is the multipolygon
    ``array<struct<shell, holes>>`` of a polygon or several, and null for other kinds. A line that is no
    feature, has another kind of geometry, or coordinates that do not fit it, has a
    ``problem``, null parts and null polygons.
    """
    f = spark.read.text(path).select(F.from_json("value", FEATURE).alias("f")).select("f.*")
    text, kind = F.col("geometry.coordinates"), F.col("geometry.type")
    points = lambda ps: F.transform(ps, _point)
    parsed = lambda depth: F.from_json(text, "array<" * (depth + 1) + "double" + ">" * (depth + 1))
    lists = F.when(kind == "Point", F.array(F.array(_point(parsed(0))))).when(kind.isin("MultiPoint", "LineString"), F.array(points(parsed(1))))
    lists = lists.when(kind == "MultiLineString", F.transform(parsed(2), points)).when(kind == "Polygon", F.transform(parsed(2), lambda r: _open(points(r))))
    lists = lists.when(kind == "MultiPolygon", F.transform(F.flatten(parsed(3)), lambda r: _open(points(r))))
    nested = F.when(kind == "Polygon", F.array(parsed(2))).when(kind == "MultiPolygon", parsed(3))
    polygons = F.transform(nested, lambda p: F.struct(_open(points(F.get(p, F.lit(0)))).alias("shell"), F.transform(F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0))), lambda r: _open(points(r))).alias("holes")))
    rows = f.select("id", "properties", kind.alias("kind"), "type", lists.alias("parts"), polygons.alias("polygons"))
    rows = rows.withColumn("hollow", F.coalesce(F.exists("polygons", lambda p: p["shell"].isNull()), F.lit(False)))
    whole = F.size("parts") > 0
    filled = ~F.exists("parts", lambda p: (F.size(p) == 0) | F.exists(p, lambda q: q["x"].isNull() | q["y"].isNull()))
    good = F.coalesce((F.col("type") == "Feature") & whole & filled & ~F.col("hollow"), F.lit(False))
    problem = F.when(F.coalesce(F.col("type") != "Feature", F.lit(True)), "not a feature").when(~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False)), "no known kind").otherwise("coordinates do not fit the kind")
    return rows.select("id", "properties", "kind", F.when(good, F.col("parts")).alias("parts"), F.when(good, F.col("polygons")).alias("polygons"), F.when(~good, problem).alias("problem"))


def read_polygons(spark: SparkSession, path: str) -> DataFrame:
    """``(id, properties, rings, problem)``: rings of ``struct<x, y>``, the last point not repeated.

    A line that is not a polygon feature has a ``problem`` and null rings.
    """
    f = read_features(spark, path)
    good = F.coalesce(F.col("problem").isNull() & (F.col("kind") == "Polygon"), F.lit(False))
    return f.select("id", "properties", F.when(good, F.col("parts")).alias("rings"), F.when(~good, F.lit("not a polygon feature")).alias("problem"))


def write_features(features: DataFrame, path: str) -> None:
    """Write ``(id, properties, kind, parts)`` as one feature a line.

    Polygons and multipolygons are written from the column ``polygons`` where there is one; rings in ``parts`` are those of one polygon.
    A feature of no known kind, of several polygons without that column, or without coordinates fails the write, so none is lost.
    """
    pair = lambda p: F.array(p["x"], p["y"])
    line = lambda ps: F.transform(ps, pair)
    closed = lambda r: F.transform(F.concat(r, F.slice(r, 1, 1)), pair)
    first = F.get("parts", F.lit(0))
    kind = F.col("kind")
    text = F.when(kind == "Point", F.to_json(pair(F.get(first, F.lit(0))))).when(kind.isin("MultiPoint", "LineString"), F.to_json(line(first)))
    text = text.when(kind == "MultiLineString", F.to_json(F.transform("parts", line)))
    single = F.when(kind == "Polygon", F.to_json(F.transform("parts", closed)))
    if "polygons" in features.columns:
        whole = lambda p: F.concat(F.array(closed(p["shell"])), F.transform(p["holes"], closed))
        text = text.when((kind == "Polygon") & (F.size("polygons") == 1), F.to_json(whole(F.get("polygons", F.lit(0)))))
        text = text.when((kind == "MultiPolygon") & (F.size("polygons") > 0), F.to_json(F.transform("polygons", whole)))
    text = F.coalesce(text, single)
    head = F.to_json(F.struct(F.lit("Feature").alias("type"), "id", "properties"))
    body = F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"geometry":{"type":"'), kind, F.lit('","coordinates":'), text, F.lit("}}"))
    lost = F.raise_error(F.concat(F.lit("no coordinates to write for a feature of kind "), F.coalesce(kind, F.lit("null"))))
    features.select(F.coalesce(body, lost).alias("value")).write.text(path)


def write_polygons(features: DataFrame, path: str) -> None:
    """Write ``(id, properties, rings)`` as one feature a line."""
    write_features(features.select("id", "properties", F.lit("Polygon").alias("kind"), F.col("rings").alias("parts")), path)


def inspect(features: DataFrame) -> DataFrame:
    """``(kind, features, problems, min_x, min_y, max_x, max_y)`` of ``read_features``."""
    flat = F.flatten("parts")
    side = lambda pick, k: pick(F.transform(flat, lambda p: p[k]))
    boxes = features.select("kind", "problem", *[side(pick, k).alias(f"{n}_{k}") for n, pick in (("min", F.array_min), ("max", F.array_max)) for k in "xy"])
    sides = [F.min("min_x").alias("min_x"), F.min("min_y").alias("min_y"), F.max("max_x").alias("max_x"), F.max("max_y").alias("max_y")]
    return boxes.groupBy("kind").agg(F.count("*").alias("features"), F.count("problem").alias("problems"), *sides)
