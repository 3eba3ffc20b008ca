"""Each stage of the pipeline against plain Python, on what the stage before it kept."""

import itertools
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_near_duplicates import brute_sets, components
from tokenizers import Tokenizer

import corpus_pipeline
from gridloom.llm import quality
from gridloom.operators.tables import materialize

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "")


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    tables = [docs]
    for name, stage in corpus_pipeline.STAGES:
        tables.append(materialize(stage(spark, tables[-1], SF), "test-" + name.replace(" ", "-")))
    return tables


def by_id(table):
    return {r.doc_id: r for r in table.collect()}


def test_stages_keep_the_columns_of_documents(tables):
    assert all(t.columns == tables[0].columns for t in tables[1:-1])
    assert all(t.count() > 0 for t in tables)


def test_rejected_documents_go(spark, tables):
    scores = {r.doc_id: r.score for r in quality.op7_quality(spark, SF).collect()}
    before, after = by_id(tables[0]), by_id(tables[1])
    assert set(after) == {i for i in before if scores[i] >= 0.5}
    assert all(after[i] == before[i] for i in after)


def test_one_document_of_each_group_stays(tables):
    before, after = by_id(tables[1]), by_id(tables[2])
    sets = brute_sets([(i, r.text) for i, r in before.items()], 5)
    of = components(sorted(before), lambda i, j: bool(sets[i] | sets[j]) and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]))
    assert set(after) == {i for i, root in of.items() if i == root}
    assert all(after[i] == before[i] for i in after)


def test_leaked_documents_go(spark, tables):
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = WORD.findall(lower(r.text))
        n = min(10, len(w))
        windows |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
    sizes = {len(w) for w in windows}
    before, after = by_id(tables[2]), by_id(tables[3])

    def leaks(text):
        w = WORD.findall(lower(text))
        return any(tuple(w[i : i + n]) in windows for n in sizes for i in range(len(w) - n + 1))

    assert set(after) == {i for i, r in before.items() if not leaks(r.text)}
    assert all(after[i] == before[i] for i in after)


def test_mix_meets_its_targets(tables):
    docs = tables[3].collect()
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in docs}
    source = {r.doc_id: r.source for r in docs}
    mixed = Counter(r.doc_id for r in tables[4].collect())
    assert set(mixed) <= set(size) and max(mixed.values()) <= 2
    totals = Counter()
    for i, n in size.items():
        totals[source[i]] += n
    names = sorted(totals, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, left, free = dict.fromkeys(names, 0.0), 1.5 * sum(totals.values()), set(names)
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        full = {s for s in free if share[s] > 2 * totals[s]}
        if not full:
            target.update(share)
            break
        for s in full:
            target[s] = 2.0 * totals[s]
            left -= target[s]
        free -= full
    taken = Counter()
    for i, n in mixed.items():
        taken[source[i]] += n * size[i]
    for s in names:
        assert abs(taken[s] - target[s]) <= max(n for i, n in size.items() if source[i] == s)


def test_token_files_hold_the_mix(tables):
    encoder = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = sorted((r.doc_id, r.text or "") for r in tables[4].collect())
    ids = [encoder.encode(t, add_special_tokens=False).ids + [1] for _, t in texts]
    starts = list(itertools.accumulate(map(len, ids), initial=0))[:-1]
    expected = sorted((i, s, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for (i, _), s, x in zip(texts, starts, ids, strict=True))
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in tables[5].collect())
    assert got == expected


def test_stages_of_null_and_repeated_ids_and_clashing_names(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(150)
    odd = docs.limit(40)
    docs = docs.unionByName(odd).unionByName(odd.withColumn("doc_id", F.lit(None).cast("long"))).unionByName(docs.limit(20).withColumn("text", F.lit(None).cast("string")))
    names = ["mix", "plan", "gone", "uid", "score", "row", "doc", "token", "copies", "t1", "words", "__text", "__score"]
    table = materialize(docs.select("*", *[F.lit(i).alias(c) for i, c in enumerate(names)]), "test-docs")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = table
        table = materialize(stage(spark, before, SF), "test-stage")
        assert table.columns == before.columns and table.count() > 0
        assert table.exceptAll(before.unionAll(before)).isEmpty()
        assert table.select("mix", "__score").distinct().count() == 1
    assert corpus_pipeline.STAGES[-1][1](spark, table, SF).count() == table.count()


def test_empty_documents(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
