"""Paths, Voronoi cells, borders, slivers, refinement, layers and windows against plain Python."""

import heapq
import math
import random

import pytest
from pyspark.sql import functions as F

from gridloom.operators import adjacency, paths, resample, voronoi
from gridloom.sources import layers

RING = "array<struct<x: double, y: double>>"
GEOM = f"array<struct<shell: {RING}, holes: array<{RING}>>>"


def rect(x0, y0, x1, y1):
    return [(float(x), float(y)) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))]


def graph(seed=1, n=25, m=45):
    r = random.Random(seed)
    return [(r.randrange(n), r.randrange(n), float(r.randint(0, 6))) for _ in range(m)]


def dijkstra(edges, sources, limit):
    """(distance, origin, hops, parent) of each node by one entry after the other."""
    near = {}
    for a, b, w in edges:
        if a != b:
            near.setdefault(a, []).append((b, w))
            near.setdefault(b, []).append((a, w))
    done, queue = {}, [(0.0, s, 0, -1, s) for s in sources]
    while queue:
        d, o, h, p, v = heapq.heappop(queue)
        if v in done:
            continue
        done[v] = (d, o, h, None if p < 0 else p)
        for u, w in near.get(v, []):
            if d + w <= limit:
                heapq.heappush(queue, (d + w, o, h + 1, v, u))
    return done


@pytest.mark.parametrize("band", [3.0, 100.0])
def test_searches_equal_dijkstra(spark, band):
    edges = graph()
    rows = [*edges, (1, None, 1.0), (2, 3, -1.0), (2, 4, float("inf"))]
    df = spark.createDataFrame(rows, "src long, dst long, length double")
    wanted = {"p": [0], "q": [3, 7], "r": [99]}
    found = paths.search(df, spark.createDataFrame([(s, v) for s, vs in wanted.items() for v in vs], "search string, node long"), 9.0, band)
    got = {(r.search, r.node): (r.distance, r.origin, r.hops, r.parent) for r in found.collect()}
    assert got == {(s, v): x for s, vs in wanted.items() for v, x in dijkstra(edges, vs, 9.0).items()}
    steps = {}
    for r in paths.path_nodes(found, found.filter("search = 'q'").select("search", "node")).collect():
        steps.setdefault(r.target, {})[r.place] = r.node
    for (s, v), (_, origin, hops, _) in got.items():
        if s == "q":
            assert sorted(steps[v]) == list(range(hops + 1)) and (steps[v][0], steps[v][hops]) == (origin, v)
            assert all(got[s, steps[v][k + 1]][3] == steps[v][k] for k in range(hops))


def test_goals_prune_without_changing_the_way_to_them(spark):
    rows = [(i, i + 1, 1.0) for i in range(10)] + [(0, -1, 1.0), (-1, -2, 1.0)]
    df = spark.createDataFrame(rows, "src long, dst long, length double")
    at = spark.createDataFrame([(i, float(i), 0.0) for i in range(-2, 11)], "node long, x double, y double")
    assert paths.heuristic_scale(df, at) == 1.0
    found = paths.search(df, spark.createDataFrame([(1, 0)], "search int, node long"), 4.0, 2.0, spark.createDataFrame([(1, 4.0, 0.0)], "search int, x double, y double"), at)
    assert sorted((r.node, r.distance) for r in found.collect()) == [(i, float(i)) for i in range(5)]


def test_access_pairs_only_what_is_reached(spark):
    df = spark.createDataFrame([(1, 2, 5.0), (2, 3, 5.0)], "src long, dst long, length double")
    sites = spark.createDataFrame([("a", 1), ("b", 1), ("c", 9)], "site string, node long")
    demands = spark.createDataFrame([(10, 2), (11, 3), (12, None), (13, 1)], "demand int, node long")
    got = sorted(tuple(r) for r in paths.access(df, sites, demands, 6.0, 3.0).collect())
    assert got == [(s, d, x) for s in "ab" for d, x in ((10, 5.0), (13, 0.0))]


def test_voronoi_cells_hold_what_is_nearest(spark):
    r = random.Random(3)
    seeds = [(i, r.gauss(0, 0.1), r.gauss(0, 0.1)) for i in range(40)] + [(50, 0.9, 0.9), (51, -0.95, 0.2), (52, 0.9, 0.9), (53, 5.0, 0.0), (54, None, 0.0)]
    found = voronoi.cells(spark.createDataFrame(seeds, "seed int, x double, y double"), -1.0, -1.0, 1.0, 1.0, 0.02).collect()
    assert sorted(c.seed for c in found) == [*range(40), 50, 51]
    assert sum(c.area for c in found) == pytest.approx(4.0)
    known = {s: (x, y) for s, x, y in seeds if s < 52}
    for c in found:
        cx, cy = (sum(p[k] for p in c.ring) / len(c.ring) for k in (0, 1))
        distance = {s: math.hypot(cx - x, cy - y) for s, (x, y) in known.items()}
        assert distance[c.seed] <= min(distance.values()) + 1e-9


def sequential(areas, pairs, smallest):
    import hashlib

    groups, links = {i: (a, i) for i, a in areas}, {i: {} for i, _ in areas}
    for a, b, w in pairs:
        links[a][b] = links[b][a] = w
    name = {i: i for i, _ in areas}
    while slivers := [(a, hashlib.md5(str(least).encode()).hexdigest(), g) for g, (a, least) in groups.items() if a < smallest and links[g]]:
        g = min(slivers)[2]
        t = min(links[g], key=lambda n: (-round(links[g][n], 6), -groups[n][0], groups[n][1]))
        groups[t] = (groups[t][0] + groups[g][0], min(groups[t][1], groups[g][1]))
        del groups[g]
        for n, w in links.pop(g).items():
            del links[n][g]
            if n != t:
                links[t][n] = links[n][t] = links[t].get(n, 0) + w
        name = {i: t if x == g else x for i, x in name.items()}
    return name


def test_slivers_merge_as_one_after_the_other(spark):
    r = random.Random(6)
    areas = [(i, float(r.randint(1, 9))) for i in range(40)]
    pairs = sorted({(min(a, b), max(a, b)) for a, b in ((r.randrange(38), r.randrange(38)) for _ in range(60)) if a != b})
    pairs = [(a, b, float(r.randint(1, 4))) for a, b in pairs]
    found = adjacency.merge_slivers(spark.createDataFrame(areas, "id int, area double"), spark.createDataFrame(pairs, "a int, b int, shared double"), 8.0)
    got = {x.id: x.group for x in found.collect()}
    assert got == sequential(areas, pairs, 8.0)


def test_borders_and_dissolved_lots(spark):
    lots = [(1, [(rect(0, 0, 2, 2), [])]), (2, [(rect(2, 0, 3, 1), [])]), (3, [(rect(2, 1, 5, 2), [])]), (4, [(rect(9, 9, 10, 10), [])])]
    df = spark.createDataFrame(lots, f"id int, geom {GEOM}")
    assert sorted(map(tuple, adjacency.borders(df, 2.0).collect())) == [(1, 2, 1.0), (1, 3, 1.0), (2, 3, 1.0)]
    whole = adjacency.dissolved(df, spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 4)], "id int, group int"), 2.0)
    assert {r.group: (r.area, len(r.geom)) for r in whole.collect()} == {1: (8.0, 1), 4: (1.0, 1)}


def test_refinement_never_raises_the_objective(spark):
    r = random.Random(2)
    cells = [(i, r.choice("abc"), 1.0) for i in range(49)]
    pairs = [(i, i + s) for i in range(49) for s in (1, 7) if (s == 7 and i + 7 < 49) or (s == 1 and i % 7 < 6)]
    policy = {("a", "b"): "forbidden", ("b", "c"): "discouraged", ("c", "a"): "preferred"}
    edges = spark.createDataFrame(pairs, "a int, b int")
    results = []
    for rounds in (0, 1, 100):
        for partitions in (1, 5):
            out = adjacency.refine(spark.createDataFrame(cells, "id int, zone_class string, area double").repartition(partitions), edges, policy, rounds)
            rows = sorted((x.id, x.zone_class) for x in out.collect())
            terms = adjacency.objective(out, edges, policy, {"a": 2.0}, {"a": 0.5, "b": 0.25, "c": 0.25}).first()
            results.append(((terms.forbidden, terms.discouraged, terms.not_preferred), rows))
    assert [x[1] for x in results[::2]] == [x[1] for x in results[1::2]]
    assert results[0][0] > results[2][0] > results[4][0]
    assert results[4][0][0] == 0


def test_layers_are_replaced_by_owner(spark, tmp_path):
    layer, path = layers.LAYERS["buildings"], f"{tmp_path}/b"
    schema = "run_id string, building_key string, block_id string, archetype string, floors int, footprint_area_m2 double, note string"
    rows = lambda *r: spark.createDataFrame([(run, k, "b", "bar", f, 9.0, None) for run, k, f in r], schema)
    layers.write(rows(("x", "1", 2), ("x/ y", "1", 3)), layer, path, ["x", "x/ y"])
    for _ in range(2):
        layers.write(rows(("x", "2", 5)), layer, path, ["x"])
    held = lambda owner=None: sorted((r.run_id, r.building_key, r.floors) for r in layers.read(spark, layer, path, owner).collect())
    assert held() == [("x", "2", 5), ("x/ y", "1", 3)]
    assert held("x") == [("x", "2", 5)]
    layers.freeze(spark, path, "x")
    bad = [(rows(("x", "3", 1)), ["x"], "closed"), (rows(("y", "3", 0)), ["y"], "not positive"), (rows(("y", "3", 1), ("y", "3", 1)), ["y"], "repeated"), (rows(("z", "3", 1)), ["y"], "another owner"), (rows(("y", None, 1)), ["y"], "null")]
    for df, owners, what in bad:
        with pytest.raises(layers.LayerError, match=what):
            layers.write(df, layer, path, owners)
    layers.write(rows(), layer, path, ["x/ y"])
    assert held() == [("x", "2", 5)]


def test_windows_and_grids(spark, tmp_path):
    cells = spark.createDataFrame([(i, j, float(10 * i + j)) for i in range(7) for j in range(5) if (i, j) != (3, 3)], "row long, col long, value double")
    resample.write_windows(cells, f"{tmp_path}/w", 3)
    got = {(r.row, r.col): r.value for r in resample.read_window(spark, f"{tmp_path}/w", 2, 2, 2, 3, 3, halo=1).collect()}
    assert got == {(i, j): None if (i, j) == (3, 3) or j > 4 else float(10 * i + j) for i in range(1, 5) for j in range(1, 6)}
    source = resample.Grid(100.0, 50.0, 2.0, 2.0, 7, 5)
    assert source.bounds() == (100.0, 36.0, 110.0, 50.0)
    same = {(r.row, r.col): r.value for r in resample.resample(cells, source, source, "bilinear").collect()}
    assert same == {(i, j): None if (i, j) == (3, 3) else float(10 * i + j) for i in range(7) for j in range(5)}
    finer = resample.target_grid(source.bounds(), 1.0, 1.0, (100.0, 44.0, 103.5, 60.0))
    assert (finer.height, finer.width, finer.left, finer.top) == (6, 4, 100.0, 50.0)
    moved = resample.resample(cells, source, finer, "nearest", lambda x, y: (x + F.lit(2.0), y))
    assert {(r.row, r.col): r.value for r in moved.collect()} == {(i, j): float(10 * (i // 2) + (j + 2) // 2) for i in range(6) for j in range(4)}
    with pytest.raises(ValueError):
        resample.target_grid(source.bounds(), 1.0, 1.0, (0.0, 0.0, 1.0, 1.0))
