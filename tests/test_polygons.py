"""Faces, overlays and GeoJSON of polygons with holes against shapes counted by cells."""

import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from gridloom.operators import faces, overlay, reports, spatial, splitting
from gridloom.sources import geojson

RING = "array<struct<x: double, y: double>>"
GEOM = f"array<struct<shell: {RING}, holes: array<{RING}>>>"
SQUARE = [(0, 0), (6, 0), (6, 6), (0, 6)]


def points(ring):
    return [(float(x), float(y)) for x, y in ring]


def rect(x0, y0, x1, y1):
    return points([(x0, y0), (x1, y0), (x1, y1), (x0, y1)])


def segments(spark, *rings, extra=()):
    rows = [(*map(float, a), *map(float, b)) for r in rings for a, b in zip(r, [*r[1:], r[0]], strict=True)]
    return spark.createDataFrame([*rows, *extra], "x1 double, y1 double, x2 double, y2 double")


def test_faces_with_holes_dangles_and_bridges(spark):
    hole, island = [(1, 1), (3, 1), (3, 3), (1, 3)], [(4, 4), (5, 4), (5, 5), (4, 5)]
    extra = [(6.0, 6.0, 9.0, 9.0), (9.0, 9.0, 10.0, 9.0), (0.0, 0.0, 1.0, 1.0), (2.0, 2.0, 2.0, 2.0), (0.0, 0.0, 6.0, 0.0), (6.0, 0.0, 0.0, 0.0), (None, 0.0, 1.0, 1.0)]
    found, idle = faces.polygonize(segments(spark, SQUARE, hole, island, extra=extra), 2.0)
    rows = {r.area: r for r in found.collect()}
    assert sorted(rows) == [1.0, 4.0, 31.0]
    assert {tuple(p) for p in rows[31.0].ring} == set(points(SQUARE))
    assert sorted(sorted((p.x, p.y) for p in h) for h in rows[31.0].holes) == [sorted(points(hole)), sorted(points(island))]
    assert sorted(map(tuple, idle.collect())) == [(0.0, 0.0, 1.0, 1.0), (6.0, 6.0, 9.0, 9.0), (9.0, 9.0, 10.0, 9.0)]


def test_faces_of_a_grid_and_a_long_ring(spark):
    lines = [(float(i), float(j), float(i + dx), float(j + dy)) for i in range(5) for j in range(5) for dx, dy in ((1, 0), (0, 1)) if i + dx < 5 and j + dy < 5]
    found, idle = faces.polygonize(segments(spark, extra=lines), 1.0)
    assert [r.area for r in found.collect()] == [1.0] * 16
    assert idle.isEmpty()
    comb = [(0, 0), (200, 0), *[(200 - i, 1 + i % 2) for i in range(201)]]
    found, _ = faces.polygonize(segments(spark, comb), 50.0)
    assert [(len(r.ring), len(r.holes)) for r in found.collect()] == [(203, 0)]
    assert faces.polygonize(segments(spark), 1.0)[0].collect() == []


def cells(geom):
    """Lattice cells of polygons whose sides are rectangles' sides."""
    inside = lambda ring, x, y: sum((a[1] > y) != (b[1] > y) and a[0] > x for a, b in zip(ring, [*ring[1:], ring[0]], strict=True)) % 2 == 1
    return {(i, j) for i in range(-1, 20) for j in range(-1, 20) for p in geom if inside(p[0], i + 0.5, j + 0.5) and not any(inside(h, i + 0.5, j + 0.5) for h in p[1])}


def shape(r):
    x, y = r.randint(0, 8), r.randint(0, 8)
    kind = r.randint(0, 3)
    if kind == 0:
        return [(rect(x, y, x + r.randint(1, 5), y + r.randint(1, 5)), [])]
    if kind == 1:
        return [(rect(x, y, x + 4, y + 4)[:: r.choice([1, -1])], [rect(x + 1, y + 1, x + 3, y + 2)[:: r.choice([1, -1])]])]
    if kind == 2:
        return [(points([(x, y), (x + 5, y), (x + 5, y + 2), (x + 2, y + 2), (x + 2, y + 5), (x, y + 5)]), [])]
    return [(rect(x, y, x + 2, y + 4), []), (rect(x + 3, y, x + 5, y + 4), [])]


@pytest.mark.parametrize("seed", [1, 2])
def test_overlays_equal_cells(spark, seed):
    r = random.Random(seed)
    rows = [(g, layer, i, shape(r)) for g in range(40) for layer in "ab" for i in range(r.randint(1, 3))]
    rows += [(90, "a", 0, [(rect(0, 0, 4, 4), [])]), (90, "b", 0, [(rect(0, 0, 4, 4)[::-1], [])])]  # equal ones
    labels = overlay.labelled(spark.createDataFrame(rows, f"g int, layer string, polygon int, geom {GEOM}"), ["g"], 3.0)
    of = lambda g, layer: set().union(*[cells(x[3]) for x in rows if x[:2] == (g, layer)])
    for keep, both in ((overlay.INTERSECTION, set.__and__), (overlay.UNION, set.__or__), (overlay.DIFFERENCE, set.__sub__)):
        bound = overlay.boundary(labels, ["g"], keep)
        expected = {g: float(len(both(of(g, "a"), of(g, "b")))) for g in [*range(40), 90]}
        assert {x.g: x.area for x in overlay.areas(bound, ["g"]).collect()} == {g: n for g, n in expected.items() if n}
        whole = overlay.polygons_of(bound, ["g"], 3.0).collect()
        assert {x.g: x.area for x in whole} == {g: n for g, n in expected.items() if n}
        for x in whole:
            assert cells([([(p.x, p.y) for p in q.shell], [[(p.x, p.y) for p in h] for h in q.holes]) for q in x.geom]) == both(of(x.g, "a"), of(x.g, "b"))


def test_slanted_overlay(spark):
    rows = [(1, "a", 1, [(points([(0, 0), (4, 0), (2, 4)]), [])]), (1, "b", 1, [(points([(0, 2), (4, 2), (2, -2)]), [])])]
    labels = overlay.labelled(spark.createDataFrame(rows, f"g int, layer string, polygon int, geom {GEOM}"), ["g"], 1.0)
    area = lambda keep: overlay.areas(overlay.boundary(labels, ["g"], keep), ["g"]).first().area
    # The widths at height y are 4 - y and y + 2, which meet at 1; both areas are 8.
    assert area(overlay.INTERSECTION) == pytest.approx(5.0)
    assert area(overlay.UNION) == pytest.approx(11.0)
    assert area(overlay.DIFFERENCE) == pytest.approx(3.0)


def test_split_parts_are_small_and_keep_the_area(spark):
    ell = points([(0, 0), (8, 0), (8, 3), (3, 3), (3, 8), (0, 8)])
    rows = [(1, [(ell, [rect(1, 1, 2, 2)])]), (2, [(rect(0, 0, 2, 2), []), (rect(5, 0, 9, 1), [])])]
    seen = []
    for partitions in (1, 3):
        df = spark.createDataFrame(rows, f"id int, geom {GEOM}").repartition(partitions)
        found = splitting.split(df, 12.0, 4.0).collect()
        assert all(0 < r.area <= 12 for r in found)
        assert {i: round(sum(r.area for r in found if r.id == i), 6) for i in (1, 2)} == {1: 38.0, 2: 8.0}
        assert sorted(r.path for r in found if r.id == 2) == ["0", "1"]
        seen.append(sorted((r.id, r.path, round(r.area, 6)) for r in found))
    assert seen[0] == seen[1]


@pytest.mark.parametrize(("ring", "axis"), [(rect(0, 0, 4, 1), (1.0, 0.0)), (rect(0, 0, 1, 4), (0.0, 1.0)), (rect(0, 0, 2, 2), (0.0, 1.0)), (points([(0, 0), (3, 3), (2, 4), (-1, 1)]), (0.5**0.5, 0.5**0.5)), (points([(0, 0), (1, 1), (2, 2)]), None)])
def test_long_axis(ring, axis):
    found = splitting.long_axis(np.array(ring))
    assert found == (axis if axis is None else pytest.approx(axis))


def test_overlaps_compare_boxes_first(spark):
    schema = f"id int, ring {RING}"
    left = spark.createDataFrame([(1, rect(0, 0, 2, 2)), (2, rect(10, 0, 12, 2)), (3, [])], schema)
    right = spark.createDataFrame([(7, rect(1, 1, 3, 3)), (8, rect(2, 0, 4, 2))], schema)
    assert [tuple(r) for r in spatial.overlaps(left, right, 1.5).collect()] == [(1, 7, 1.0, 0.25)]


def test_geojson_keeps_polygons_apart(spark, tmp_path):
    double = [(rect(0, 0, 4, 4), [rect(1, 1, 2, 2)]), (rect(6, 0, 8, 2), [])]
    rows = [("a", {"k": "1"}, "Polygon", double[:1]), ("b", None, "MultiPolygon", double), ("c", None, "MultiPolygon", double[1:])]
    df = spark.createDataFrame(rows, f"id string, properties map<string, string>, kind string, polygons {GEOM}").withColumn("parts", F.lit(None).cast(f"array<{RING}>"))
    geojson.write_features(df, f"{tmp_path}/out")
    back = geojson.read_features(spark, f"{tmp_path}/out").orderBy("id").collect()
    plain = lambda g: [([(p.x, p.y) for p in q.shell], [[(p.x, p.y) for p in h] for h in q.holes]) for q in g]
    assert [(r.id, r.kind, plain(r.polygons), r.problem) for r in back] == [(i, k, g, None) for i, _, k, g in rows]
    for kind in ("MultiPolygon", "Curve", None):
        with pytest.raises(PySparkException, match="no coordinates to write"):
            geojson.write_features(spark.createDataFrame([("a", None, kind, [rect(0, 0, 1, 1)])], f"id string, properties map<string, string>, kind string, parts array<{RING}>"), f"{tmp_path}/{kind}")
    (tmp_path / "bad.json").write_text('{"type":"Feature","geometry":{"type":"MultiPolygon","coordinates":[[]]}}')
    assert geojson.read_features(spark, f"{tmp_path}/bad.json").first().problem == "coordinates do not fit the kind"


def test_seeds_of_different_keys_differ(spark):
    rows = spark.createDataFrame([("a:b", "c"), ("a", "b:c"), ("a", None), (None, "a"), ("n", "a")], "k string, m string")
    seeds = [r.s for r in rows.select(reports.keyed_seed(F.lit(1), F.col("k"), F.col("m")).alias("s")).collect()]
    assert len(set(seeds)) == 5
