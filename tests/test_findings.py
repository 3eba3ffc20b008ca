"""What larger tables showed: results that must not hang on the order of rows, and work that must not grow with copies."""

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from gridloom.functions.geometry import box, polygon
from gridloom.operators import adjacency, lines, overlay, placement, spatial, voronoi
from gridloom.operators.ranges import competition_rank

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


def test_ranks_of_values_that_differ_when_found_again(spark):
    noise = F.udf(lambda: random.SystemRandom().random(), "double").asNondeterministic()
    rows = spark.range(20).select("id", noise().alias("v"))
    assert sorted(r["rank"] for r in competition_rank(rows, "v").collect()) == list(range(1, 21))


def test_equal_runs_have_one_rank_in_any_order_of_rows(spark, tmp_path):
    prices = [0.1, 0.2, 0.3, 1e6, 0.7]
    rows = [(s, p, 0.0, p) for s, order in enumerate((prices, prices[::-1], sorted(prices))) for p in order] + [(3, 1.0, 0.0, float("nan")), (4, None, None, None)]
    spark.createDataFrame(rows, "l_suppkey long, l_extendedprice double, l_discount double, l_quantity double").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {(r.l_suppkey, r.metric_id): r["rank"] for r in QUERIES["metric_ranks"](spark, str(tmp_path)).collect()}
    assert [got[s, "revenue"] for s in range(5)] == [1, 1, 1, 4, None]
    assert [got[s, "quantity"] for s in range(5)] == [1, 1, 1, 4, None]


def shapes(spark, n, copies):
    x = (F.col("id") % n * 7).cast("double")
    return spark.range(n * copies).select("id", F.lit(1).alias("nation"), F.lit("a").alias("layer"), F.col("id").alias("polygon"), F.array(polygon(box(x, F.lit(0.0), x + 3, F.lit(3.0)), box(x + 1, F.lit(1.0), x + 2, F.lit(2.0)))).alias("geom"))


def test_copies_of_a_polygon_are_overlaid_once(spark, monkeypatch):
    seen, pieces = [], overlay.pieces
    monkeypatch.setattr(overlay, "pieces", lambda edges, *rest: seen.append(edges.count()) or pieces(edges, *rest))
    assert overlay.areas(overlay.boundary(overlay.labelled(shapes(spark, 3, 5), ["nation"], 8.0), ["nation"], overlay.UNION), ["nation"]).first()["area"] == 24.0
    assert seen == [3 * 8]


def test_queries_on_copies_overlay_no_more_pairs(spark, tmp_path, monkeypatch):
    seen, labelled = [], overlay.labelled
    monkeypatch.setattr(overlay, "labelled", lambda polygons, *rest: seen.append(polygons.count()) or labelled(polygons, *rest))
    keys = [(k, k * 1200) for k in range(2)]
    spark.createDataFrame([(k + i, 3) for k in range(40) for _, i in keys], "s_suppkey long, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(k + i, 3) for k in range(300) for _, i in keys], "c_custkey long, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    con = duckdb.connect()
    for t in ("supplier", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    for name in ("polygon_overlay", "developable_blocks"):
        got = QUERIES[name](spark, str(tmp_path))
        expected = con.execute(ORACLE[name]).fetchall()
        assert sorted(map(tuple, got.collect())) == sorted(expected) and len(expected) > 40
    once = con.execute("SELECT count(*) FROM (" + ORACLE["polygon_overlay"] + ") WHERE left_id < 1200 AND right_id < 1200").fetchall()[0][0]
    assert seen == [2 * once, 40 + once]


def test_boxes_are_not_clipped(spark, monkeypatch):
    corners = F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in ((F.col("id") - 3, F.lit(0)), (F.col("id") - 1, F.lit(0)), (F.col("id") - 3, F.lit(2)))])
    boxes = lambda n, size: spark.range(n).select("id", box(F.col("id") * 1.0, F.lit(0.0), F.col("id") + size, F.lit(size)).alias("ring"))
    bent = boxes(5, 3.0).unionByName(spark.range(5, 7).select("id", corners.alias("ring")))
    whole = {(r.left_id, r.right_id): (r.overlap, r.share) for r in spatial.overlaps(bent, boxes(4, 1.5), 4.0).collect()}
    assert whole[2, 3] == (2.25, 0.25) and whole[5, 3] == pytest.approx((0.5, 0.25))
    monkeypatch.setattr(spatial, "clipped", None)
    monkeypatch.setattr(spatial, "CROWDED", 2)
    found = spatial.overlaps(boxes(5, 3.0), boxes(4, 1.5), 4.0)
    assert {(r.left_id, r.right_id): (r.overlap, r.share) for r in found.collect()} == {k: v for k, v in whole.items() if k[0] < 5}
    plan = spatial.association(found, 1e-6).select("left_id", "kind")._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_placement_by_zones_equals_pairs(spark):
    rng = random.Random(5)
    demands = spark.createDataFrame([(d, float(rng.randrange(9))) for d in range(30)], "demand long, amount double")
    sites = spark.createDataFrame([(c, c % 3) for c in range(12)], "candidate long, zone int")
    reach = spark.createDataFrame([(d % 3, d) for d in range(30)] + [(0, 1), (1, 1)], "zone int, demand long")
    pairs = sites.join(reach, "zone").select("candidate", "demand")
    assert sorted(map(tuple, placement.greedy_in_zones(demands, sites, reach, 14.0, 7).collect())) == sorted(map(tuple, placement.greedy(demands, pairs, 14.0, 7).collect()))
    with pytest.raises(ValueError):
        placement.greedy_in_zones(demands, sites.unionByName(sites.limit(1).select("candidate", F.lit(9).alias("zone"))), reach, 14.0, 7)


def test_dense_segments_are_searched_nearby_first(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(i, x := rng.random(), y := rng.random(), x + rng.random() / 20, y + rng.random() / 20) for i in range(400)]
    spots = [(i, rng.random(), rng.random()) for i in range(60)] + [(60, 1.4, 1.4), (61, 9.0, 9.0), (62, None, 0.0), (None, 0.5, 0.5)]
    asked, within = [], lines.within
    monkeypatch.setattr(lines, "within", lambda p, s, r, c: asked.append((r, within(p, s, r, c).count())) or within(p, s, r, c))
    got = {r.point: (r.line, r.distance) for r in lines.nearest(spark.createDataFrame(spots, "id long, x double, y double"), spark.createDataFrame(rows, "id long, x1 double, y1 double, x2 double, y2 double"), 0.8, 0.8).collect()}

    def distance(x, y, x1, y1, x2, y2):
        t = max(0.0, min(1.0, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2)))
        return math.hypot(x - x1 - t * (x2 - x1), y - y1 - t * (y2 - y1))

    best = {i: min((distance(x, y, *r[1:]), r[0]) for r in rows) for i, x, y in spots if x is not None}
    assert got == {i: (line, pytest.approx(d)) for i, (d, line) in best.items() if d <= 0.8}
    assert asked[-1][0] == 0.8 and sum(n for _, n in asked) < 60 * 40


def test_members_meet_few_seeds(spark, monkeypatch):
    rng = random.Random(7)
    seeds = [(i, rng.random(), rng.random()) for i in range(300)]
    spots = [(i, rng.random() * 1.2, rng.random()) for i in range(200)]
    met, within = [], spatial.within_distance
    monkeypatch.setattr(spatial, "within_distance", lambda a, b, r: met.append(within(a, b, r).count()) or within(a, b, r))
    got = dict(map(tuple, voronoi.members(spark.createDataFrame(spots, "id long, x double, y double"), spark.createDataFrame(seeds, "seed long, x double, y double")).collect()))
    assert got == {i: min((math.hypot(x - u, y - v), s) for s, u, v in seeds)[1] for i, x, y in spots}
    assert 0 < sum(met) < 200 * 30


def chain(spark, n):
    rng = random.Random(8)
    rows = [(i, float(rng.randrange(1, 5)), "abc"[rng.randrange(3)]) for i in range(n)]
    pairs = [(i, i + 1, 1.0) for i in range(n - 1)] + [(i, i + 9, float(rng.randrange(1, 3))) for i in range(n - 9)]
    return spark.createDataFrame(rows, "id long, area double, zone_class string"), spark.createDataFrame(pairs, "a long, b long, shared double")


def test_rounds_of_slivers_hold_only_links_of_slivers(spark, monkeypatch):
    areas, pairs = chain(spark, 90)
    sizes, store = [], adjacency.materialize
    monkeypatch.setattr(adjacency, "materialize", lambda df, name: (t := store(df, name), sizes.append(t.count()) if name == "sliver-links" else None)[0])
    adjacency.merge_slivers(areas, pairs, 3.0)
    assert sizes[0] < 2 * pairs.count() and sizes[-1] == 0


def test_rounds_of_refinement_look_at_changed_neighbourhoods(spark, monkeypatch):
    areas, pairs = chain(spark, 90)
    asked, moves = [], adjacency._moves
    monkeypatch.setattr(adjacency, "_moves", lambda links, *rest: asked.append(links.count()) or moves(links, *rest))
    policy = {("a", "b"): "forbidden", ("b", "c"): "discouraged", ("a", "c"): "preferred"}
    got = {r.id: r.zone_class for r in adjacency.refine(areas, pairs, policy).collect()}
    assert asked[0] == 2 * pairs.count() and max(asked[1:]) < asked[0] and asked[-1] < asked[0] / 3
    # Nothing is left to gain.
    monkeypatch.undo()
    current = spark.createDataFrame(list(got.items()), "id long, zone_class string")
    assert adjacency._moves(adjacency.two_ways(pairs), current, policy).isEmpty()
