"""Nulls, ties and empty groups of the assembly operators."""

import random

from gridloom.operators import assembly


def test_keys_with_nulls_are_equal(spark):
    a = spark.createDataFrame([(1,), (None,), (1,)], "k int")
    b = spark.createDataFrame([(None,), (1,), (2,)], "k int")
    assert [tuple(r) for r in assembly.key_differences(a, b, "k").collect()] == [(2, "left")]
    assert assembly.key_differences(a, a.limit(0), "k").count() == 2


def test_masks_with_nulls(spark):
    a = spark.createDataFrame([(0, 0, None), (0, 1, True)], "row int, col int, x boolean")
    b = spark.createDataFrame([(0, 0, False), (0, 1, False)], "row int, col int, x boolean")
    got = assembly.combine_masks([a, b], ["row", "col"], "x").collect()
    assert sorted(map(tuple, got)) == [(0, 0, False), (0, 1, True)]


def test_calibration_is_exact(spark):
    rng = random.Random(4)
    rows = [(z, i, rng.choice([None, -2, 0, 3, 10, 10**7]), rng.choice([None, 0, 1, 5, 10**6]) if z else None) for z in range(4) for i in range(9)]
    df = spark.createDataFrame(rows, "zone int, item int, n long, e long")
    got = {(r.zone, r.item): r.calibrated for r in assembly.calibrate(df, "zone", "item", "n", "e", 30).collect()}
    for z in range(4):
        mine = [(i, max(n or 0, 0), e or 0) for zone, i, n, e in rows if zone == z]
        people, evidence = sum(n for _, n, _ in mine), sum(e for *_, e in mine)
        if not evidence:
            assert all(got[z, i] == n for i, n, _ in mine)
            continue
        parts = {i: divmod(70 * n * evidence + 30 * e * people, 100 * evidence) for i, n, e in mine}
        spare = people - sum(q for q, _ in parts.values())
        more = set(sorted(parts, key=lambda i: (-parts[i][1], i))[:spare])
        assert {i: got[z, i] for i in parts} == {i: q + (i in more) for i, (q, _) in parts.items()}
        assert sum(got[z, i] for i in parts) == people
