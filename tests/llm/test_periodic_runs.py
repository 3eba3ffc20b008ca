"""Runs against a version that tries every period, and the query against its contract."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.llm import periodic_runs as op


def brute_runs(words, min_length=6, min_exponent=4):
    """Every stretch that a period cannot be continued from, if no smaller period holds in it."""
    out = set()
    for q in range(1, len(words) // min_exponent + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            run = words[i : j + q]
            if j > i and len(run) >= max(min_length, min_exponent * q):
                if all(run[r:] != run[: len(run) - r] for r in range(1, q)):
                    out.add((i, len(run), q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return [w for i, w in enumerate(words) if i not in gone]


def words_of(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]


periodic = st.builds(lambda a, b, n, c: a + (b * n)[: len(b) * n - len(b) // 2] + c, *[st.lists(st.integers(1, 3), max_size=8)] * 2, st.integers(0, 9), st.lists(st.integers(1, 3), max_size=8))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=50) | periodic, st.sampled_from([(6, 4), (3, 2), (4, 3), (10, 5)]))
def test_runs_equal_brute_force(words, limits):
    expected = brute_runs(words, *limits)
    if words:
        assert [tuple(map(int, r)) for r in zip(*op.runs_of(np.array(words), *limits), strict=True)] == expected
    start, length, period = op.find(np.array([0, *words, 0], np.uint64), np.array([0, 1, 1 + len(words), 2 + len(words)]), *limits)
    assert sorted(zip((start - 1).tolist(), length.tolist(), period.tolist(), strict=True), key=lambda r: (r[0], r[2])) == expected


def test_extensions_equal_brute_force():
    text = np.array(random.Random(3).choices([1, 2], k=200))
    far = op.Extension(*op.leaves(*op.suffix_tree([*text.tolist(), 0]), 201))
    a, b = map(np.array, zip(*[(i, j) for i in range(201) for j in range(i + 1, 201)], strict=True))
    expected = []
    for i, j in zip(a, b, strict=True):
        n = 0
        while j + n < 200 and text[i + n] == text[j + n]:
            n += 1
        expected.append(n)
    assert far(a, b).tolist() == expected


def test_trees_of_several_stretches(monkeypatch):
    monkeypatch.setattr(op, "TREE_WORDS", 20)
    r = random.Random(5)
    texts = [[r.randint(1, 2) for _ in range(r.randint(0, 60))] for _ in range(40)]
    first = np.cumsum([0, *map(len, texts)])
    start, length, period = op.find(np.array(sum(texts, []), np.uint64), first, 6, 4)
    got = sorted(zip(start.tolist(), length.tolist(), period.tolist(), strict=True), key=lambda x: (x[0], x[2]))
    assert got == [(s + int(a), n, q) for a, t in zip(first, texts, strict=False) for s, n, q in brute_runs(t)]


def test_texts_of_all_kinds(spark):
    texts = [None, "", " \t\n", "a", "a " * 5, "a " * 6, "x a a a a a a\ta b", "Ab cd " * 4 + "Ab e é " + "é é é " * 9, "A a A a A a a", "y " * 30000, "a b " * 3 + "z" * 100000, "a b " * 4]
    rows = spark.createDataFrame([(i % 9, t, "k") for i, t in enumerate(texts)] + [(None, "q q q q q q q", None)], "n_words long, text string, runs string")
    found = op.periodic_runs(rows, ["n_words", "text"]).toDF("id", "text", "n", "found", "collapsed").collect()
    assert len(found) == 13
    for r in found:
        words = words_of(r.text)
        runs = [(x.start, x.length, x.period) for x in r.found]
        assert r.n == len(words)
        assert runs == (brute_runs(words) if len(words) < 1000 else [(0, len(words), 1)])
        assert r.collapsed == " ".join(brute_collapsed(words, runs))
    assert op.periodic_runs(rows.limit(0), ["n_words"]).collect() == []
    with pytest.raises(ValueError):
        op.periodic_runs(rows, [], min_length=2)


@pytest.mark.parametrize("partitions", [1, 5])
def test_query_equals_brute_force(spark, tmp_path, partitions):
    r = random.Random(7)
    texts = [" ".join(r.choices(["a", "b", "C", "dé"], k=r.randint(0, 90))) for _ in range(150)]
    rows = [*enumerate(texts), (3, None), (3, texts[3]), (None, texts[5])]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(partitions).write.parquet(f"{tmp_path}/documents.parquet")
    expected = []
    for i, t in rows:
        words, h = words_of(t), zlib.crc32(str(i).encode()) if i is not None else 1
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
        runs = brute_runs(words)
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=None)
        sha = [hashlib.sha256(s.encode()).hexdigest() for s in ("".join(f"{s},{n},{q}\n" for s, n, q in runs), " ".join(brute_collapsed(words, runs)))]
        expected.append((i, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, *sha))
    assert sorted(map(tuple, op.op13_periodic_runs(spark, str(tmp_path)).collect()), key=str) == sorted(expected, key=str)
    assert sum(e[1] > 0 for e in expected) > 10
