"""Road graphs from road parts ``(road, part, sx, sy, tx, ty, length, is_source, is_fixed)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.graph import connected_components
from gridloom.operators.ranges import running

RANKS = {"local": 0, "collector": 1, "arterial": 2}


def _name(kind: str, place: str) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.lpad((F.col(place) - 1).cast("string"), 8, "0"))


def build(parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``nodes (node, x, y, is_source, is_fixed)`` and ``edges (edge, src, dst, road, part, length, is_source, is_fixed)``.

    Ends with the same coordinates are one node. Nodes are numbered by (x, y), edges by
    (road, part). Parts without a positive length or with a null coordinate are left out.
    """
    good = parts.dropna(subset=["sx", "sy", "tx", "ty"]).filter("length > 0")
    ends = good.select(F.inline(F.array(*[F.struct(F.col(f"{e}x").alias("x"), F.col(f"{e}y").alias("y"), "is_source", "is_fixed") for e in "st"])))
    nodes = ends.groupBy("x", "y").agg(F.bool_or("is_source").alias("is_source"), F.bool_or("is_fixed").alias("is_fixed"))
    nodes = running(nodes, [], [F.col("x").asc(), F.col("y").asc()], {}).select(_name("node", "place").alias("node"), "x", "y", "is_source", "is_fixed")
    edges = running(good, [], [F.col("road").asc(), F.col("part").asc()], {}).withColumn("edge", _name("edge", "place"))
    for end, name in (("s", "src"), ("t", "dst")):
        at = nodes.select(F.col("node").alias(name), F.col("x").alias("__x"), F.col("y").alias("__y"))
        edges = edges.join(at, (F.col(f"{end}x") == F.col("__x")) & (F.col(f"{end}y") == F.col("__y"))).drop("__x", "__y")
    return nodes, edges.select("edge", "src", "dst", "road", "part", "length", "is_source", "is_fixed")


def component_diagnostics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(component, nodes, edges, length)``: by the smallest node of each component; lone nodes are components too."""
    parts = connected_components(edges, "src", "dst")
    placed = nodes.select("node").join(parts, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    held = edges.join(parts, edges["src"] == parts["node"]).groupBy("component").agg(F.count("*").alias("edges"), F.sum("length").alias("length"))
    sizes = placed.groupBy("component").agg(F.count("*").alias("nodes"))
    return sizes.join(held, "component", "left").select("component", "nodes", F.coalesce("edges", F.lit(0)).alias("edges"), F.coalesce("length", F.lit(0.0)).alias("length"))


def metrics(nodes: DataFrame, edges: DataFrame, area_m2: float, intersection_degree: int = 3) -> DataFrame:
    """One row: counts, lengths, density, degrees, intersections, dead ends and circuity of a graph.

    ``circuity`` is the length by the chord of the edges that have a chord, null without any.
    """
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    degrees = nodes.select("node").join(ends, "node", "left").select(F.coalesce("degree", F.lit(0)).alias("degree"))
    by_node = degrees.agg(
        F.count("*").alias("nodes"), F.coalesce(F.avg("degree"), F.lit(0.0)).alias("mean_degree"), F.coalesce(F.max("degree"), F.lit(0)).alias("max_degree"),
        F.count_if(F.col("degree") >= intersection_degree).alias("intersections"), F.count_if(F.col("degree") == 1).alias("dead_ends"),
    )
    at = lambda n, x, y: nodes.select(F.col("node").alias(n), F.col("x").alias(x), F.col("y").alias(y))
    chords = edges.join(at("src", "ax", "ay"), "src").join(at("dst", "bx", "by"), "dst").withColumn("chord", F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")))
    straight = F.col("chord") > 0
    by_edge = chords.agg(
        F.count("*").alias("edges"), F.coalesce(F.sum("length"), F.lit(0.0)).alias("length_m"), F.coalesce(F.sum(F.when(~F.col("is_source"), F.col("length"))), F.lit(0.0)).alias("generated_m"),
        (F.sum(F.when(straight, F.col("length"))) / F.sum(F.when(straight, F.col("chord")))).alias("circuity"),
    )
    km2 = area_m2 / 1_000_000
    # Both sides are one row.
    return by_node.crossJoin(by_edge).withColumn("density_km_per_km2", F.col("length_m") / 1000 / km2).withColumn("intersections_per_km2", F.col("intersections") / km2)


def classify(length: Column, baseline: Column, collector_intent: Column, arterial_m: float, collector_m: float, baseline_floor: str = "local", intent_floor: str = "collector") -> Column:
    """``struct<class, reason>`` of a generated road by its length, raised to the floor of its origin."""
    found = lambda c, r: F.struct(F.lit(c).alias("class"), F.lit(r).alias("reason"))
    by_length = F.when(length >= collector_m, found("collector", "collector_length")).otherwise(found("local", "local_default"))

    def floored(floor: str, reason: str) -> Column:
        below = F.lit(RANKS[floor]) > F.when(length >= collector_m, RANKS["collector"]).otherwise(RANKS["local"])
        return F.when(below, found(floor, reason)).otherwise(by_length)

    raised = F.when(baseline, floored(baseline_floor, "baseline_floor")).when(collector_intent, floored(intent_floor, "collector_intent_floor")).otherwise(by_length)
    return F.when(length >= arterial_m, found("arterial", "arterial_length")).otherwise(raised)


def without_copies(edges: DataFrame) -> DataFrame:
    """``edges`` with one of those that join the same nodes at the same length, in either direction: a fixed one, then the smallest."""
    key = [F.least("src", "dst").alias("__a"), F.greatest("src", "dst").alias("__b"), F.col("length").alias("__length")]
    whole = F.struct((~F.col("is_fixed")).alias("free"), F.col("edge").alias("edge"), F.struct(*edges.columns).alias("row"))
    return edges.groupBy(*key).agg(F.min(whole).alias("best")).select("best.row.*")


def without_tiny(edges: DataFrame, shortest: float) -> DataFrame:
    """``edges`` without those under ``shortest`` that are not fixed."""
    return edges.filter(F.col("is_fixed") | (F.col("length") >= shortest))


def building_areas(buildings: DataFrame, group: str, site_m2: float, kinds: list[str]) -> DataFrame:
    """``(group, buildings, footprint_m2, gfa_m2, coverage, far, <kind>_share...)`` of buildings ``(footprint, floors, kind)`` on sites of ``site_m2``.

    Every kind of the list has a share, 0 where it does not occur.
    """
    floors = F.col("footprint") * F.col("floors")
    shares = [(F.count_if(F.col("kind") == k) / F.count("*")).alias(f"{k}_share") for k in kinds]
    areas = [F.sum("footprint").alias("footprint_m2"), F.sum(floors).alias("gfa_m2"), (F.sum("footprint") / site_m2).alias("coverage"), (F.sum(floors) / site_m2).alias("far")]
    return buildings.groupBy(group).agg(F.count("*").alias("buildings"), *areas, *shares)
