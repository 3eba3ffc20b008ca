"""Shortest paths of many searches at once over a network ``(src, dst, length)``, and what they reach.

A search is a set of source nodes that share a name; all searches run together, keyed by (search, node). Distances are settled in
bands of width ``band``: tentative nodes of the lowest band send along their edges until the band changes no more, and are then stored
and never grouped again. What is sent back to settled nodes is dropped against the last bands alone, since an edge leads no farther back than it is long.
Only the best entry of a (search, node) goes on. So a round costs what its band sends, not what was found before.

Of equal distances that from the smallest origin counts, then that with the fewest edges, then that over the smallest node before.
Edges go both ways; of parallel ones the shortest counts. Edges with a null end, or a null, negative or non-finite length, are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.tables import discard, materialize

#: Columns of what a search finds.
FOUND = ["search", "node", "distance", "origin", "hops", "parent"]


def both_ways(edges: DataFrame) -> DataFrame:
    """``(a, b, length)`` of each edge in both directions, the shortest of parallel ones."""
    e = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("length").cast("double").alias("length")).dropna()
    e = e.filter("length >= 0 and length < double('infinity') and a != b")
    return e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"), "length")).groupBy("a", "b").agg(F.min("length").alias("length"))


def heuristic_scale(edges: DataFrame, positions: DataFrame) -> float:
    """How much length a straight step costs at least: the smallest length by chord of an edge between ``positions (node, x, y)``, 0 to 1."""
    at = lambda n: positions.select(F.col("node").alias(n), F.col("x").alias(f"{n}x"), F.col("y").alias(f"{n}y"))
    chord = F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by"))
    found = both_ways(edges).join(at("a"), "a").join(at("b"), "b").agg(F.min(F.when(chord > 0, F.col("length") / chord)).alias("scale")).head()[0]
    return 1.0 if found is None else max(0.0, min(1.0, found))


def search(edges: DataFrame, sources: DataFrame, max_distance: float, band: float, goals: DataFrame | None = None, positions: DataFrame | None = None) -> DataFrame:
    """``(search, node, distance, origin, hops, parent)`` of all nodes within ``max_distance`` of a search's ``sources (search, node)``.

    ``parent`` is the node before, null at an origin. With ``goals (search, x, y)`` and ``positions (node, x, y)`` a node is
    left out that is too far for its search's goal even in a straight line at the best length by chord of the network.
    """
    if not (0 <= max_distance < math.inf) or band <= 0:
        raise ValueError("distances and bands must be finite, and bands positive")
    e = materialize(both_ways(edges), "path-edges")
    longest = e.agg(F.max("length")).head()[0] or 0.0
    near = None
    if goals is not None:
        scale = heuristic_scale(edges, positions)
        near = lambda df: df.join(positions, "node").join(goals.select("search", F.col("x").alias("gx"), F.col("y").alias("gy")), "search").filter(F.col("distance") + scale * F.hypot(F.col("x") - F.col("gx"), F.col("y") - F.col("gy")) <= max_distance + 1e-9).select(*FOUND)
    best = lambda df: df.groupBy("search", "node").agg(F.min(F.struct("distance", "origin", "hops", "parent")).alias("b")).select("search", "node", "b.*")
    node = e.schema["a"].dataType
    start = sources.select("search", F.col("node").cast(node).alias("node"), F.lit(0.0).alias("distance"), F.col("node").cast(node).alias("origin"), F.lit(0).cast("long").alias("hops"), F.lit(None).cast(node).alias("parent")).dropna(subset=["search", "node"]).distinct()
    open_ = materialize(near(start) if near else start, "path-open")
    done: list[tuple[int, DataFrame]] = []
    while (lowest := open_.agg(F.min("distance")).head()[0]) is not None:
        index = math.floor(lowest / band)
        here = F.col("distance") < (index + 1) * band
        recent = [table for k, table in done if k >= index - math.ceil(longest / band) - 1]
        wave = open_.filter(here)
        while True:
            sent = wave.select("search", F.col("node").alias("a"), "distance", "origin", "hops").join(e, "a")
            sent = sent.select("search", F.col("b").alias("node"), (F.col("distance") + F.col("length")).alias("distance"), "origin", (F.col("hops") + 1).alias("hops"), F.col("a").alias("parent")).filter(F.col("distance") <= max_distance)
            for table in recent:
                sent = sent.join(table.select("search", "node"), ["search", "node"], "left_anti")
            sent = best(near(sent) if near else sent)
            known = open_.select(*FOUND, F.lit(True).alias("old")).unionByName(sent.select(*FOUND, F.lit(False).alias("old")))
            grouped = known.groupBy("search", "node").agg(F.min(F.struct("distance", "origin", "hops", "parent")).alias("b"), F.min(F.when(F.col("old"), F.struct("distance", "origin", "hops", "parent"))).alias("was"))
            grouped = materialize(grouped.select("search", "node", "b.*", (F.col("was").isNull() | (F.col("b") < F.col("was"))).alias("moved")), "path-open")
            before, open_ = open_, grouped
            discard(before)
            wave = open_.filter(here & F.col("moved"))
            if wave.isEmpty():
                break
        done.append((index, materialize(open_.filter(here).select(*FOUND), "path-done")))
        before, open_ = open_, materialize(open_.filter(~here).select(*FOUND), "path-open")
        discard(before)
    discard(e)
    if not done:
        return open_
    out = done[0][1]
    for _, table in done[1:]:
        out = out.unionByName(table)
    return out


def path_nodes(found: DataFrame, targets: DataFrame) -> DataFrame:
    """``(search, target, place, node)``: the nodes, from 0 at the origin, of the path to each of ``targets (search, node)`` that ``search`` found.

    Each round looks up who comes twice as many steps before, so a path of a million nodes takes twenty rounds; a target's path is rows and no list.
    """
    up = materialize(found.select("search", "node", "hops", "parent"), "path-up")
    most = up.agg(F.max("hops")).head()[0] or 0
    levels = [up.filter("parent is not null").select("search", "node", "parent")]
    while 1 << len(levels) <= most:
        last = levels[-1]
        far = last.select("search", F.col("node").alias("parent"), F.col("parent").alias("far"))
        levels.append(materialize(last.join(far, ["search", "parent"]).select("search", "node", F.col("far").alias("parent")), "path-up"))
    rows = targets.select("search", "node").distinct().join(up, ["search", "node"]).select("search", F.col("node").alias("target"), F.col("hops").alias("place"), "node")
    for k in reversed(range(len(levels))):
        further = rows.join(levels[k], ["search", "node"]).select("search", "target", (F.col("place") - (1 << k)).alias("place"), F.col("parent").alias("node"))
        rows = materialize(rows.unionByName(further), "path-rows")
    return rows


def access(edges: DataFrame, sites: DataFrame, demands: DataFrame, max_distance: float, band: float) -> DataFrame:
    """``(site, demand, distance)`` of ``sites (site, node)`` and ``demands (demand, node)`` at most ``max_distance`` apart on the network.

    Sites at one node share a search. Demands meet only what was reached; there is no pairing of all sites with all demands.
    """
    found = search(edges, sites.select(F.col("node").alias("search"), "node").distinct(), max_distance, band)
    met = found.select(F.col("search"), "node", "distance").join(demands.dropna(subset=["node"]), "node")
    return met.join(sites.select("site", F.col("node").alias("search")), "search").select("site", "demand", "distance")
