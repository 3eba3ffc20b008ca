"""Running sums, ranks and apportionment without windows over whole groups, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from gridloom.operators import apportion, assembly, suitability
from gridloom.operators.ranges import competition_rank, running


def rows_of(seed, n=400):
    rng = random.Random(seed)
    return [(None if rng.random() < 0.05 else "hot" if rng.random() < 0.9 else f"g{rng.randrange(4)}", rng.randrange(12), i, None if rng.random() < 0.1 else rng.randrange(100)) for i in range(n)]


@pytest.mark.parametrize("group", [[], ["g"]])
def test_running_sums(spark, group):
    rows = rows_of(1)
    frame = spark.createDataFrame(rows, "g string, v int, id long, w long").repartition(5)
    got = {r.id: (r.place, r["sum"], r.place_all, r.sum_all) for r in running(frame, group, [F.col("v").desc(), F.col("id").asc()], {"sum": "w"}).collect()}
    expected = {}
    for g in {r[0] for r in rows} if group else [0]:
        mine = sorted((r for r in rows if not group or r[0] == g), key=lambda r: (-r[1], r[2]))
        total, whole = 0, sum(r[3] or 0 for r in mine)
        for place, r in enumerate(mine, 1):
            total += r[3] or 0
            expected[r[2]] = (place, total, len(mine), whole)
    assert got == expected


def test_running_sums_of_an_empty_table(spark):
    frame = spark.createDataFrame([], "g string, v int")
    assert running(frame, [], [F.col("v")], {"sum": "v"}).count() == running(frame, ["g"], [F.col("v")], {}).count() == 0


@pytest.mark.parametrize("rising", [True, False])
@pytest.mark.parametrize("group", [[], ["g"]])
def test_competition_rank(spark, group, rising):
    rows = rows_of(2)
    frame = spark.createDataFrame(rows, "g string, v int, id long, w long").repartition(5)
    got = {r.id: r["rank"] for r in competition_rank(frame, "w", group, rising=rising).collect()}
    for g, _, i, w in rows:
        mine = [r[3] for r in rows if (not group or r[0] == g) and r[3] is not None]
        assert got[i] == (None if w is None else 1 + sum(x < w if rising else x > w for x in mine))


def test_one_zone_with_most_rows(spark):
    rows = rows_of(3)
    frame = spark.createDataFrame(rows, "g string, v int, id long, w long").repartition(5)
    got = {r.id: r.allocated for r in apportion.largest_remainder(frame, "g", "id", "w", 997).collect()}
    kept = {r.id: r.calibrated for r in assembly.calibrate(frame, "g", "id", "w", "v", 30).collect()}
    for g in {r[0] for r in rows}:
        mine = [(i, w or 0, v) for x, v, i, w in rows if x == g]
        whole, evidence = sum(w for _, w, _ in mine), sum(v for _, _, v in mine)
        base = {i: divmod(w * 997, whole) for i, w, _ in mine}
        order = sorted(base, key=lambda i: (-base[i][1], i))[: 997 - sum(b for b, _ in base.values())]
        assert {i: got[i] for i in base} == {i: b + (i in order) for i, (b, _) in base.items()}
        share = {i: divmod(w * evidence * 70 + v * whole * 30, evidence * 100) for i, w, v in mine}
        order = sorted(share, key=lambda i: (-share[i][1], i))[: whole - sum(b for b, _ in share.values())]
        assert {i: kept[i] for i in share} == {i: b + (i in order) for i, (b, _) in share.items()}


def test_quantiles(spark):
    values = [5.0, 1.0, 4.0, 2.0, None]
    r = suitability.quantiles(spark.createDataFrame([(v,) for v in values], "v double"), "v", {"low": 0.0, "mid": 0.5, "part": 0.9, "high": 1.0}).first()
    assert tuple(r) == pytest.approx((1.0, 3.0, 4.7, 5.0))
    assert tuple(suitability.quantiles(spark.createDataFrame([], "v double"), "v", {"mid": 0.5}).first()) == (None,)
