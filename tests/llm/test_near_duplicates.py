"""The similarity joins against brute force, with copies, ties, nulls and short texts."""

import random

import numpy as np
import pytest

from gridloom.llm import ngram_join, vector_dedup

SPACES = " \t\n\x0b\x0c\r"


def brute_sets(texts, width):
    out = {}
    for i, t in texts:
        low = "".join(c.lower() if c.isascii() else c for c in t or "")
        for c in SPACES:
            low = low.replace(c, " ")
        w = [x for x in low.split(" ") if x]
        out[i] = {tuple(w[j : j + width]) for j in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    return out


def components(ids, linked):
    of = {i: i for i in ids}

    def root(x):
        while of[x] != x:
            x = of[x]
        return x

    for i in ids:
        for j in ids:
            if i < j and linked(i, j):
                a, b = root(i), root(j)
                of[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def texts(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["the", "of", "Ä", "straße"]
    base = [[rng.choice(words) for _ in range(rng.choice([1, 2, 3, 8, 40, 90]))] for _ in range(25)]
    out = [None, "", "  \n ", "one", "ONE", "one two", "one two"]
    for b in base:
        for _ in range(rng.choice([1, 1, 2, 6])):
            c = list(b)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                c[rng.randrange(len(c))] = rng.choice(words)
            out.append(" ".join(c))
    return list(enumerate(out))


@pytest.mark.parametrize(("width", "percent", "seed"), [(3, 90, 1), (5, 80, 2), (1, 60, 3)])
def test_ngram_join_equals_brute_force(spark, width, percent, seed):
    rows = texts(seed)
    sets = brute_sets(rows, width)
    expected = components([i for i, _ in rows], lambda i, j: bool(sets[i] | sets[j]) and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]))
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n string")
    got = {r.doc_id: r for r in ngram_join.components(docs, width=width, percent=percent).collect()}
    assert {i: len(s) for i, s in sets.items()} == {i: r.n_shingles for i, r in got.items()}
    assert expected == {i: r.component_id for i, r in got.items()}


def test_ngram_join_of_an_empty_table(spark):
    assert ngram_join.components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 24))
    v = [c + rng.normal(scale=s, size=24) for c in centres for s in (0.05, 0.2, 0.3, 0.4)]
    v += [v[0], v[0], v[5] * 3.0, np.zeros(24)]
    rows = [(i, [float(x) for x in e], 0) for i, e in enumerate(v)] + [(900, None, 1), (901, [float("nan")] * 24, 1), (902, [None] * 24, 1), (903, [1.0, 2.0], 1), (904, [], 1)]
    got = {r.vec_id: r for r in vector_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), block=16).collect()}
    n = len(v) - 1
    x = np.array(v[:n])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    linked = x @ x.T >= 0.9
    true = (linked.sum() - n) / 2
    found = sum(r.n_links for r in got.values()) / 2
    assert 0.99 * true <= found <= true
    for i in range(n):
        assert got[i].n_links <= linked[i].sum() - 1
    for i in (n, 900, 901, 902, 903, 904):
        assert got[i].n_links == 0 and got[i].component_id == i and got[i].kept
    assert got[n - 3].component_id == got[0].component_id


def test_ngram_join_of_null_and_repeated_ids(spark):
    a, b = "the quick brown fox jumps over the lazy dog again and again", "some other text of quite different words that nobody shares"
    rows = [(None, a, 1), (7, a + " x", 1), (7, b, 1), (3, b, 1), (None, "alone here with words of its own", 1), (None, None, 1), (9, "", 1), (3, b, 1)]
    got = sorted(((r.doc_id, r.component_id) for r in ngram_join.components(spark.createDataFrame(rows, "doc_id long, text string, token int"), width=3, percent=80).collect()), key=str)
    assert got == sorted([(None, 7), (7, 7), (7, 3), (3, 3), (None, None), (None, None), (9, 9), (3, 3)], key=str)


def test_one_row_of_each_component_stays(spark):
    a, b = "the quick brown fox jumps over the lazy dog again and again", "some other text of quite different words that nobody shares"
    rows = [(5, "text without any copy at all in here"), (5, a), (1, a), (1, a), (None, b), (None, b), (None, None), (8, ""), (8, ""), (None, "a text that has no id and no copy")]
    docs = spark.createDataFrame([(i, t, "x", 4) for i, t in rows], "doc_id long, text string, gone string, rows int")
    out = ngram_join.without_copies(docs, width=3)
    assert out.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert got == sorted([rows[0], (1, a), (None, b), *rows[6:]], key=str)


def test_vectors_of_null_and_repeated_ids(spark):
    e1, e4, near = [1.0, 0.0, 0.0, 0.0], [0.0, 0.0, 0.0, 1.0], [1.0, 0.1, 0.0, 0.0]
    rows = [(1, e1), (1, e4), (2, near), (None, near), (None, [0.0, 1.0, 0.0, 0.0]), (4, e4), (None, None)]
    got = sorted((tuple(r) for r in vector_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()), key=str)
    assert got == sorted([(1, 2, 1, True), (1, 1, 1, True), (2, 2, 1, False), (None, 2, 1, False), (None, 0, None, True), (4, 1, 1, False), (None, 0, None, True)], key=str)


def test_vectors_of_an_empty_table(spark):
    assert vector_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


@pytest.mark.parametrize("d", [64, 128])
def test_recall_at_the_threshold(d):
    rng = np.random.default_rng(d)
    a = rng.normal(size=(1000, d))
    b = rng.normal(size=(1000, d))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b -= (a * b).sum(axis=1)[:, None] * a
    b = 0.9 * a + np.sqrt(1 - 0.81) * b / np.linalg.norm(b, axis=1)[:, None]
    found = np.zeros(1000, dtype=bool)
    for t in range(vector_dedup.TABLES):
        codes = [[vector_dedup.cross_polytope(v, vector_dedup.SEED * 1_000_003 + t * vector_dedup.HASHES + h) for h in range(vector_dedup.HASHES)] for v in (a, b)]
        own = [np.stack([c[0] for c in side]) for side in codes]
        looks = [[np.stack([c[i == h] for i, c in enumerate(side)]) for h in range(vector_dedup.HASHES)] for side in codes]
        same = lambda x, y: (x == y).all(axis=0)
        found |= same(*own) | np.logical_or.reduce([same(x, own[1]) for x in looks[0]] + [same(own[0], x) for x in looks[1]])
    assert found.mean() > 0.98
    bits = np.bitwise_count(vector_dedup.sketch(a, 3) ^ vector_dedup.sketch(b, 3)).sum(axis=1)
    assert bits.max() <= vector_dedup.reach(0.9)


def test_links_of_a_dense_group_come_as_counts(spark):
    rng = np.random.default_rng(8)
    v = rng.normal(size=32) + rng.normal(scale=0.05, size=(150, 32))
    nodes = spark.createDataFrame([(i, [float(x) for x in e], 1 + i % 3) for i, e in enumerate(v)], "node long, vector array<double>, copies long")
    rows = vector_dedup.links(nodes, block=32).collect()
    copies = np.array([1 + i % 3 for i in range(150)])
    sums = np.zeros(150, int)
    for r in rows:
        if r.b is None:
            sums[r.a] += r.links
    x = v / np.linalg.norm(v, axis=1, keepdims=True)
    linked = (x @ x.T >= 0.9) & ~np.eye(150, dtype=bool)
    assert (sums == linked @ copies).all()
    assert len(rows) < 150 * 10 * 10
