"""Tags, files, demand, lines and identifiers on odd values."""

import uuid

import pytest
from pyspark.sql import functions as F

from gridloom.functions import geometry, osm
from gridloom.operators import demand, demography, lines, reports, spanning, spatial, suitability
from gridloom.sources import geojson


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("parse", "cases"), [
    (osm.positive_int, {" 3 ": 3, "0": None, "-1": None, "2.5": None, "99999999999": None, "": None, None: None}),
    (osm.non_negative_float, {"1.5": 1.5, "-1": None, "NaN": None, "Infinity": None, " 0 ": 0.0, "x": None}),
    (osm.distance_m, {"10": 10.0, "10 ft": 3.048, "5'": 1.524, "2 Metres": 2.0, "0": None, "tall": None}),
    (osm.max_speed_kph, {"50": 50.0, "10 MPH": 16.09344, "50 km/h": 50.0, "walk": None}),
    (osm.one_way, {"yes": True, "-1": True, "no": False, None: False, " TRUE ": True}),
    (osm.structure_flag, {"yes": True, "viaduct": True, "no": False, "": False, None: False}),
    (osm.layer, {"-1": -1, "+2": 2, "1.5": 0, None: 0, "99999999999": 0}),
])
def test_parsers(spark, parse, cases):
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", parse(F.col("t")).alias("v")).collect()
    assert {r.t: r.v for r in rows} == {k: pytest.approx(v) if isinstance(v, float) else v for k, v in cases.items()}


def test_categories_and_classes(spark):
    tags = lambda d: F.create_map(*[F.lit(x) for pair in d.items() for x in pair]) if d else F.create_map().cast("map<string,string>")
    assert list(value(spark, osm.categories(tags({"building:part": "yes", "craft": "x", "landuse": "basin", "highway": ""})))) == ["buildings", "poi", "landuse", "water"]
    assert list(value(spark, osm.categories(tags({})))) == []
    found = lambda d, c: tuple(value(spark, osm.classify(tags(d), c)))
    assert found({"amenity": "bench", "healthcare": "x", "shop": "y"}, "poi") == ("healthcare", "facility.healthcare-tag")
    assert found({"natural": " Bay "}, "water") == ("coastal", "water.coastal")
    assert found({"highway": "corridor"}, "roads") == ("other", "default")


def test_geojson_kinds_and_problems(spark, tmp_path):
    lines_ = [
        '{"type":"Feature","id":"1","properties":{},"geometry":{"type":"Point","coordinates":[1,2]}}',
        '{"type":"Feature","id":"2","properties":{"a":"b"},"geometry":{"type":"MultiPolygon","coordinates":[[[[0,0],[1,0],[1,1],[0,0]]],[[[5,5],[6,5],[6,6],[5,5]]]]}}',
        '{"type":"Feature","id":"3","properties":{},"geometry":{"type":"LineString","coordinates":[[0,0],["x"]]}}',
        '{"type":"Feature","id":"4","properties":{},"geometry":{"type":"Circle","coordinates":[0,0]}}',
        '{"type":"Thing"}', "not json", '{"type":"Feature","id":"5","properties":{},"geometry":null}',
    ]
    (tmp_path / "a.json").write_text("\n".join(lines_))
    rows = geojson.read_features(spark, str(tmp_path / "a.json"))
    got = [(r.id, r.kind, len(r.parts) if r.parts else None, r.problem) for r in rows.collect()]
    assert got == [
        ("1", "Point", 1, None), ("2", "MultiPolygon", 2, None), ("3", "LineString", None, "coordinates do not fit the kind"), ("4", "Circle", None, "no known kind"),
        (None, None, None, "not a feature"), (None, None, None, "not a feature"), ("5", None, None, "no known kind"),
    ]
    box = {r.kind: (r.features, r.problems, r.min_x, r.max_y) for r in geojson.inspect(rows).collect()}
    assert box["MultiPolygon"] == (1, 0, 0.0, 6.0) and box[None] == (3, 3, None, None)


def test_demand_and_suitability_refuse_wrong_values(spark):
    blocks = spark.createDataFrame([(1, 10.0)], "block long, people double")
    types = [demand.DemandType("a", "b", "people", 0.5)]
    served = lambda x: spark.createDataFrame([(1, "a", x)], "block long, type string, served double")
    assert demand.unmet(blocks, types, served(2.0)).first()["unmet"] == 3.0
    with pytest.raises(Exception, match="more is served"):
        demand.unmet(blocks, types, served(5.1)).collect()
    cells = spark.createDataFrame([(0, 0, 1.5, False)], "row int, col int, f double, excluded boolean")
    with pytest.raises(Exception, match="outside 0 to 1"):
        suitability.weighted(cells, [suitability.Factor("f", 1.0)]).collect()


def test_shares_are_exact(spark):
    deal = lambda n, shares: list(value(spark, demography.by_shares(F.lit(n), shares)))
    assert deal(10, {"a": "0.333", "b": "0.333", "c": "0.334"}) == [3, 3, 4]
    assert deal(1, {"a": "0.5", "b": "0.5"}) == [1, 0]
    assert deal(0, {"a": "1"}) == [0] and deal(10**15 + 1, {"a": "0.5", "b": "0.5"}) == [5 * 10**14 + 1, 5 * 10**14]


def test_lines_that_touch_or_run_along(spark):
    seg = spark.createDataFrame([(1, 0.0, 0.0, 2.0, 0.0), (2, 1.0, -1.0, 1.0, 1.0), (3, 2.0, 0.0, 3.0, 3.0), (4, 0.5, 0.0, 1.5, 0.0), (5, 9.0, 9.0, 9.0, 9.0), (6, None, 0.0, 1.0, 1.0)], "id long, x1 double, y1 double, x2 double, y2 double")
    got = {(r.a, r.b): (r.x, r.y) for r in lines.crossings(seg, 0.7).collect()}
    assert got == {(1, 2): (1.0, 0.0), (1, 3): (2.0, 0.0), (2, 4): (1.0, 0.0)}
    pieces = {}
    for r in lines.noded(seg, 0.7).collect():
        pieces.setdefault(r.id, []).append((r.piece, r.x1, r.x2))
    assert sorted(pieces[1]) == [(0, 0.0, 1.0), (1, 1.0, 2.0)] and len(pieces[2]) == 2 and len(pieces[3]) == 1 and 6 not in pieces
    assert value(spark, lines.point_distance(*[F.lit(float(x)) for x in (3, 4, 0, 0, 0, 0)])) == 5.0


def test_clipped_triangle(spark):
    triangle = geometry.ring((F.lit(-1), F.lit(0)), (F.lit(1), F.lit(0)), (F.lit(0), F.lit(2)))
    window = geometry.box(*[F.lit(x) for x in (0, 0, 5, 5)])
    assert value(spark, geometry.area(geometry.clipped(triangle, window))) == 1.0
    assert value(spark, geometry.area(geometry.clipped(triangle, geometry.box(*[F.lit(x) for x in (3, 3, 5, 5)])))) == 0.0


def test_nearest_point_at_any_distance(spark):
    left = spark.createDataFrame([(1, 0.0, 0.0), (2, 1000.0, 0.0), (3, None, 0.0)], "id long, x double, y double")
    right = spark.createDataFrame([(7, 3.0, 4.0), (8, 3.0, 4.0), (9, 0.0, float("nan"))], "id long, x double, y double")
    assert sorted((r.left_id, r.right_id, round(r.distance, 3)) for r in spatial.nearest(left, right, 0.5).collect()) == [(1, 7, 5.0), (2, 7, 997.008)]
    assert spatial.nearest(left, right.limit(0), 0.5).count() == 0


def test_spanning_forest_equals_kruskal(spark):
    edges = [(i, (i * 7) % 20, (i * 11 + 3) % 20, float((i * 5) % 6)) for i in range(60)] + [(100, 50, 51, 1.0), (101, 5, 5, 0.0)]
    got = {r.edge for r in spanning.minimum_spanning_forest(spark.createDataFrame(edges, "edge long, src long, dst long, length double")).collect()}
    of, kept = {}, set()

    def root(x):
        while of.get(x, x) != x:
            x = of[x]
        return x

    for e, a, b, _ in sorted(edges, key=lambda e: (e[3], e[0])):
        if root(a) != root(b):
            of[root(a)] = root(b)
            kept.add(e)
    assert got == kept


def test_uuids_pages_and_lines_of_csv(spark):
    assert value(spark, reports.uuid5(str(uuid.NAMESPACE_DNS), F.lit("zone é"))) == str(uuid.uuid5(uuid.NAMESPACE_DNS, "zone é"))
    rows = spark.range(5)
    assert [tuple(r) for r in reports.page(rows, [F.col("id")], 2, 2).collect()] == [(2, True), (3, True)]
    assert [tuple(r) for r in reports.page(rows, [F.col("id")], 9, 4).collect()] == [(4, False)]
    line = spark.createDataFrame([("a\nb", None, "x")], "a string, b string, c string").select(reports.csv_line("a", "b", "c").alias("v")).first()["v"]
    assert line == '"a\nb",,x'
