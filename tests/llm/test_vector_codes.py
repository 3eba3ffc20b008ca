"""Trees against comparing all, and codes and codebooks against Lloyd's iterations in plain Python."""

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.llm import vector_codes as op


def brute(rows, scale=1024, parts=4, entries=256, rounds=4):
    """``rows`` of (id, vector): the code and error of each usable one in their order, and the codebooks."""
    floor = lambda v: [math.floor(scale * x) for x in v]
    usable = [(i, v) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    usable.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    usable = [(i, floor(v)) for i, v in usable if len(v) == len(usable[0][1])]
    cut = lambda v, p: tuple((v + [0] * (-len(v) % parts))[p * (-(-len(v) // parts)) : (p + 1) * (-(-len(v) // parts))])
    books = [[cut(v, p) for _, v in usable[:entries]] for p in range(parts)]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda p, v: min(range(len(books[p])), key=lambda k: (apart(cut(v, p), books[p][k]), k))
    for _ in range(rounds):
        given = [[[] for _ in b] for b in books]
        for _, v in usable:
            for p in range(parts):
                given[p][nearest(p, v)].append(cut(v, p))
        books = [[tuple(sum(c) // len(own) for c in zip(*own, strict=True)) if own else e for e, own in zip(b, g, strict=True)] for b, g in zip(books, given, strict=True)]
    out = [(i, "".join("%02x" % nearest(p, v) for p in range(parts)), sum(apart(cut(v, p), books[p][nearest(p, v)]) for p in range(parts))) for i, v in usable]
    return out, books


@settings(max_examples=120, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([1, 10, 1000, 1 << 26]), st.integers(1, 150), st.integers(1, 40), st.sampled_from([1, 4, 16]))
def test_trees_equal_comparing_all(seed, most, n, k, leaf):
    r = np.random.default_rng(seed)
    points = r.integers(-most, most, (n, 3)) * r.integers(0, 2, (n, 1))
    entries = np.r_[points[r.integers(0, n, k // 2)], r.integers(-most, most, (k - k // 2, 3))]
    tree = op.Boxes.load(*op.Boxes.over(points, leaf).store(), 3)
    expected = ((points[:, None] - entries) ** 2).sum(axis=2).argmin(axis=1)
    found = np.empty(n, np.int64)
    found[tree.order] = op.nearest(points[tree.order], tree, entries)
    assert (found == expected).all()
    count, total = op.sums(points[tree.order], tree, entries)
    for e in range(k):
        assert count[e] == (expected == e).sum()
        assert (total[e] == points[expected == e].sum(axis=0)).all()


def test_far_groups_are_assigned_whole():
    r = np.random.default_rng(2)
    points = np.concatenate([r.integers(0, 50, (500, 4)) + c for c in (0, 10_000, 20_000)])
    tree = op.Boxes.over(points, 16)
    whole, single = op.assign(points[tree.order], tree, np.array([[0] * 4, [10_020] * 4, [20_020] * 4, [90_000] * 4]))
    assert len(single) <= 2  # leaves with points of two groups
    assert sum(len(nodes) for _, nodes, _ in whole) < 20


@pytest.mark.parametrize(("length", "entries", "block", "partitions"), [(8, 16, 7, 3), (8, 256, 4096, 1), (6, 5, 16, 4)])
def test_codes_equal_brute_force(spark, length, entries, block, partitions):
    r = random.Random(length * entries)
    rows = [(i, [r.gauss(0, 0.3) for _ in range(length)]) for i in r.sample(range(1000), 80)]
    rows += [(i, rows[3][1]) for i in range(2000, 2060)]  # copies
    rows += [(None, rows[5][1]), (rows[9][0], rows[9][1]), (rows[9][0], rows[8][1]), (-1, None), (-2, []), (-3, [None] * length), (-4, [float("nan")] + [0.0] * (length - 1)), (-5, [float("inf")] * length), (5000, [1.0])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, code string, __key int").repartition(partitions)
    codes, books = op.compress(df, ["vec_id", "code"], entries=entries, block=block)
    expected, expected_books = brute(rows, entries=entries)
    assert books.tolist() == [[list(e) for e in b] for b in expected_books]
    assert sorted(((r[0], r[2], r[3]) for r in codes.collect()), key=str) == sorted(expected, key=str)


def test_large_components_and_empty_tables(spark):
    rows = [(i, [x, 0.0, 1.0, -x]) for i, x in enumerate([1e30, -1e30, 1e5, 0.5, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    codes, books = op.compress(df, ["vec_id"], entries=2)
    assert np.abs(books).max() <= op.largest(4)
    assert codes.count() == 5
    none, books = op.compress(df.filter("vec_id < 0"), ["vec_id"])
    assert none.collect() == []
    assert books.size == 0
    with pytest.raises(ValueError):
        op.compress(df, [], entries=257)


def test_query_equals_sql_and_brute_force(spark, tmp_path):
    r = random.Random(4)
    rows = [(i, [round(r.gauss(0, 0.2), 3) for _ in range(8)], r.choice([None, 1, 2])) for i in range(400)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    names = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    expected = sorted(con.execute(f"SELECT {', '.join(names)} FROM ({op.OP11_SQL})").fetchall())
    assert sorted(map(tuple, op.op11_vector_codes(spark, str(tmp_path)).select(*names).collect())) == expected
    codes, books = brute([(i, [float(np.float32(x)) for x in v]) for i, v, _ in rows])
    assert [e[:3] for e in expected] == codes
    assert expected[0][4] == hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
