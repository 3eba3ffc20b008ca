"""Networks, placement, geometry, files and claims against plain Python."""

import heapq

from pyspark.sql import functions as F

from gridloom.functions import geometry
from gridloom.operators import network, placement
from gridloom.sources import geojson
from gridloom.streaming.claims import claim


def dijkstra(edges, sources, most):
    ways = {}
    for a, b, d in edges:
        ways.setdefault(a, []).append((b, d))
        ways.setdefault(b, []).append((a, d))
    best, heap = {}, [(0.0, s, s) for s in sources]
    while heap:
        d, origin, node = heapq.heappop(heap)
        if node in best or d > most:
            continue
        best[node] = (d, origin)
        for b, step in ways.get(node, []):
            heapq.heappush(heap, (d + step, origin, b))
    return {(n, *v) for n, v in best.items()}


def test_nearest_sources(spark):
    edges = [(i, (i * 7 + k) % 60, float(1 + (i * k) % 5)) for i in range(60) for k in (1, 4)]
    frame = spark.createDataFrame([*edges, (None, 3, 1.0), (3, 9, -1.0)], "src long, dst long, length double")
    got = network.nearest_sources(frame, spark.createDataFrame([(0,), (31,)], "node long"), 9.0)
    assert {tuple(r) for r in got.collect()} == dijkstra(edges, [0, 31], 9.0)
    assert network.nearest_sources(frame.limit(0), spark.createDataFrame([(5,)], "node long"), 9.0).collect() == [(5, 0.0, 5)]


def test_least_cost_goes_around(spark):
    rows = [(r, c, None if (r, c) == (0, 1) else 1.0 if r else 0.5) for r in range(2) for c in range(3)]
    edges = network.raster_edges(spark.createDataFrame(rows, "row int, col int, score double"), 10.0, 2.0)
    found = {r["node"]: r["distance"] for r in network.nearest_sources(edges, spark.createDataFrame([(0,)], "node long"), 1e9).collect()}
    assert found == {0: 0.0, 1 << 32: 15.0, (1 << 32) + 1: 25.0, (1 << 32) + 2: 35.0, 2: 50.0}


def test_prune_dangling(spark):
    edges = [(1, 1, 2, 9.0, False), (2, 2, 3, 9.0, False), (3, 3, 1, 9.0, False), (4, 3, 4, 1.0, False), (5, 4, 5, 1.0, False), (6, 2, 6, 1.0, True), (7, 1, 7, 8.0, False)]
    frame = spark.createDataFrame(edges, "edge long, src long, dst long, length double, fixed boolean")
    kept = lambda passes: {r["edge"] for r in network.prune_dangling(frame, 5.0, passes).collect()}
    assert kept(16) == {1, 2, 3, 6, 7}
    assert kept(1) == {1, 2, 3, 4, 6, 7}


def test_greedy(spark):
    amounts = {d: float((d * 37) % 11) for d in range(30)}
    covers = {c: [d for d in range(30) if (d + c) % (c + 2) == 0] for c in range(8)}
    left, expected, chosen = dict(amounts), set(), []
    for i in range(1, 6):
        benefit = {c: min(sum(left[d] for d in ds), 20.0) for c, ds in covers.items() if c not in chosen}
        best = min(benefit, key=lambda c: (-benefit[c], c))
        if benefit[best] <= 0:
            break
        chosen.append(best)
        room = 20.0
        for d in covers[best]:
            served = min(left[d], room)
            if served > 0:
                expected.add((i, best, d, served))
                left[d], room = left[d] - served, room - served
    demands = spark.createDataFrame([*amounts.items(), (99, None), (98, -4.0)], "demand long, amount double")
    coverage = spark.createDataFrame([(c, d) for c, ds in covers.items() for d in ds], "candidate long, demand long")
    assert {tuple(r) for r in placement.greedy(demands, coverage, 20.0, 5).collect()} == expected
    assert placement.greedy(demands.limit(0), coverage, 20.0, 5).collect() == []


def test_rings(spark):
    # An L: the notch is outside, points on its sides are covered.
    points = [(0, 0), (4, 0), (4, 2), (2, 2), (2, 4), (0, 4)]
    shape = geometry.ring(*[(F.lit(x), F.lit(y)) for x, y in points])
    at = spark.createDataFrame([(1.0, 1.0), (3.0, 3.0), (2.0, 3.0), (4.0, 0.0), (1.0, 2.0), (5.0, 2.0)], "x double, y double")
    assert [r[0] for r in at.select(geometry.covers(shape, F.col("x"), F.col("y"))).collect()] == [True, False, True, True, True, False]
    row = at.limit(1).select(geometry.area(shape).alias("a"), geometry.perimeter(shape).alias("p"), geometry.compactness(F.slice(shape, 1, 1)).alias("c")).first()
    assert (row["a"], row["p"], row["c"]) == (12.0, 16.0, None)


def test_geojson_round_trip(spark, tmp_path):
    rings = [[(0.0, 0.0), (1.5, 0.0), (0.0, 2.25)]]
    rows = spark.createDataFrame([("a", {"kind": "park"}, rings)], "id string, properties map<string,string>, rings array<array<struct<x:double,y:double>>>")
    geojson.write_polygons(rows, str(tmp_path / "out"))
    back = geojson.read_polygons(spark, str(tmp_path / "out"))
    assert back.select("id", "properties", "rings").collect() == rows.collect()
    (tmp_path / "bad.json").write_text('{"type": "Feature", "geometry": {"type": "Point", "coordinates": [1, 2]}}\nnot json\n')
    bad = geojson.read_polygons(spark, str(tmp_path / "bad.json")).collect()
    assert [(r["rings"], r["problem"]) for r in bad] == [(None, "not a polygon feature")] * 2


def test_claims_deliver_once(spark, tmp_path):
    src, state = str(tmp_path / "in"), str(tmp_path / "state")
    put = lambda ids: spark.createDataFrame([(i,) for i in ids], "job long").coalesce(1).write.mode("append").parquet(src)
    put([1, 1, 2])
    assert sorted(r[0] for r in claim(spark, src, ["job"], state).collect()) == [1, 2]
    put([2, 3])
    assert sorted(r[0] for r in claim(spark, src, ["job"], state).collect()) == [1, 2, 3]
