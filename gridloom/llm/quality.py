"""A factorisation machine over hashed words, text structure and metadata.

``score = sigmoid(b + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j)``; the pairs are
summed in linear time as ``1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)``.
Features ``x`` of a text: its hashed words (log counts of length 1), shares of byte
classes, word and line lengths, repetition, and the ``n_chars`` column as metadata
(the text's own length where that is null). Labels, language, source and id are never
features.

``fit`` learns from at most ``sample`` labelled rows, chosen by a hash of the id; the
rows are turned into features on the executors, and the driver holds that sample only.
Scoring is a map over the texts. Null texts count as empty; repeated rows are scored
each; an empty training set scores everything 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.lm_scoring import held_out
from gridloom.llm.words import chunks, hashes, spans

WORD_FEATURES = 1 << 15
FACTORS = 8
SAMPLE = 12_000
CLASSES = 8
CLASS_OF = np.full(256, 7, dtype=np.int64)  # non-ASCII
CLASS_OF[:128] = 6  # marks and control characters
CLASS_OF[97:123], CLASS_OF[65:91], CLASS_OF[48:58] = 0, 1, 2
CLASS_OF[[ord(c) for c in ".,;:'\"-()"]] = 3
CLASS_OF[10], CLASS_OF[[32, 9, 11, 12, 13]] = 4, 5
STATS = CLASSES + 9


def features(texts: pa.Array, n_chars: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """``(first row, row after the last, offsets, indices, values, statistics)`` of runs of texts."""
    length = n_chars.to_numpy(zero_copy_only=False).astype(float)
    for lo, hi, data, offsets in chunks(texts):
        docs, size = hi - lo, np.diff(offsets)
        starts, ends, first = spans(data, offsets)
        n = np.diff(first)
        h = hashes(data, starts, ends)
        of = np.repeat(np.arange(docs), n)
        pairs, count = np.unique(of * WORD_FEATURES + (h % np.uint64(WORD_FEATURES)).astype(np.int64), return_counts=True)
        at = np.searchsorted(pairs, np.arange(docs + 1) * WORD_FEATURES)
        value = np.log1p(count)
        norm = np.sqrt(np.diff(np.r_[0.0, np.cumsum(value**2)][at]))
        value = value / np.repeat(norm, np.diff(at))
        classes = np.bincount(np.repeat(np.arange(docs) * CLASSES, size) + CLASS_OF[data], minlength=docs * CLASSES).reshape(docs, CLASSES)
        top = np.zeros(docs)
        np.maximum.at(top, pairs // WORD_FEATURES, count)
        some, lines = np.maximum(n, 1), classes[:, 4] + 1
        word_bytes = np.diff(np.r_[0, np.cumsum(ends - starts)][first])
        capital = np.diff(np.r_[0, np.cumsum(CLASS_OF[data[starts]] == 1)][first])
        marked = np.diff(np.r_[0, np.cumsum(np.isin(CLASS_OF[data[ends - 1]], (3, 6)))][first])
        meta = np.where(np.isfinite(length[lo:hi]), length[lo:hi], size)
        stats = np.column_stack([
            np.sqrt(classes / np.maximum(size, 1)[:, None]), np.log1p(n), np.log1p(word_bytes / some), np.diff(at) / some, top / some, np.log1p(n / lines),
            capital / some, marked / some, np.log1p(np.maximum(meta, 0)), np.log1p(size),
        ])
        yield lo, hi, at, pairs % WORD_FEATURES, value, stats


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, at, index, value, stats in features(batch.column(0), batch.column(1)):
            wide = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32) * STATS), pa.array(stats.ravel()))
            lists = [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(x)) for x in (index.astype(np.int32), value)]
            yield pa.RecordBatch.from_arrays([batch.column(2).slice(lo, hi - lo), batch.column(3).slice(lo, hi - lo), *lists, wide], ["label", "key", "index", "value", "stats"])


@dataclass
class Machine:
    """Weights; the statistics are features ``WORD_FEATURES`` on, standardised."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def rows(self, at: np.ndarray, index: np.ndarray, value: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All features of each text, one after the other: starts, indices and values."""
        docs = len(stats)
        z = np.clip((stats - self.mean) / self.scale, -4, 4) / np.sqrt(STATS)
        start = at[:-1] + np.arange(docs) * STATS
        own = (start[:, None] + np.arange(STATS)).ravel()
        words = np.ones(len(index) + docs * STATS, dtype=bool)
        words[own] = False
        i, x = np.empty(len(words), np.int32), np.empty(len(words))
        i[own], x[own] = np.tile(WORD_FEATURES + np.arange(STATS), docs), z.ravel()
        i[words], x[words] = index, value
        return start, i, x

    def margin(self, start: np.ndarray, i: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        vx = self.factors[i] * x[:, None]
        sums = np.add.reduceat(vx, start)
        pairs = 0.5 * (sums**2 - np.add.reduceat(vx**2, start)).sum(axis=1)
        return self.bias + np.add.reduceat(self.linear[i] * x, start) + pairs, sums


def train(at: np.ndarray, index: np.ndarray, value: np.ndarray, stats: np.ndarray, label: np.ndarray, epochs: int = 8, rate: float = 0.1, decay: float = 1e-5, batch: int = 256) -> Machine:
    """Logistic loss by AdaGrad over the sample, in an order fixed by a seed."""
    rng, size = np.random.default_rng(7), WORD_FEATURES + STATS
    deviation = stats.std(axis=0) if len(stats) else np.ones(STATS)
    m = Machine(0.0, np.zeros(size), rng.normal(0, 0.05, (size, FACTORS)), stats.mean(axis=0) if len(stats) else np.zeros(STATS), np.where(deviation > 1e-9, deviation, 1.0))
    if not len(label):
        m.factors[:] = 0
        return m
    start, i, x = m.rows(at, index, value, stats)
    del index, value, stats  # as large again as what is left
    end = np.r_[start[1:], len(i)]
    seen, seen_linear, seen_factors = 1e-6, np.full(size, 1e-6), np.full((size, FACTORS), 1e-6)
    for _ in range(epochs):
        order = rng.permutation(len(label))
        for lo in range(0, len(order), batch):
            mine = order[lo : lo + batch]
            n = end[mine] - start[mine]
            s = np.r_[0, np.cumsum(n)[:-1]]
            pick = np.arange(n.sum()) + np.repeat(start[mine] - s, n)
            bi, bx = i[pick], x[pick]
            z, sums = m.margin(s, bi, bx)
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label[mine]) / len(mine)
            gx = np.repeat(g, n) * bx
            used, place = np.unique(bi, return_inverse=True)
            d = np.bincount(place, gx) + decay * m.linear[used]
            dv = gx[:, None] * (np.repeat(sums, n, axis=0) - m.factors[bi] * bx[:, None])
            dv = np.column_stack([np.bincount(place, dv[:, f]) for f in range(FACTORS)]) + decay * m.factors[used]
            seen += g.sum() ** 2
            m.bias -= rate * g.sum() / np.sqrt(seen)
            seen_linear[used] += d**2
            m.linear[used] -= rate * d / np.sqrt(seen_linear[used])
            seen_factors[used] += dv**2
            m.factors[used] -= rate / 2 * dv / np.sqrt(seen_factors[used])
    return m


def _meta(docs: DataFrame):
    return (F.col("n_chars") if "n_chars" in docs.columns else F.lit(None)).cast("double").alias("__meta")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Machine:
    """Learn from at most ``sample`` rows of ``labels`` (its ids and ``label`` 0 or 1); null labels are left out."""
    known = labels.select(F.col(id_col).alias("__id"), F.col(label).cast("double").alias("label")).dropna()
    count = known.count()
    share = sample / max(count, 1)
    by_hash = F.xxhash64(F.lit("sample"), "__id")
    known = known.filter(F.pmod(by_hash, F.lit(1 << 40)) <= int(share * (1 << 40))).orderBy(by_hash, "__id", "label").limit(sample)
    rows = docs.select(F.col(text).cast("string").alias("__text"), _meta(docs), F.col(id_col).alias("__doc")).join(F.broadcast(known), F.col("__doc") == F.col("__id"))
    found = rows.select("__text", "__meta", "label", F.xxhash64("__doc", "__text").alias("key")).mapInArrow(_examples, "label double, key long, index array<int>, value array<double>, stats array<double>")
    # Repeated ids could bring more rows than the sample has: those with the smallest hashes stay.
    t = found.orderBy("key", "label").limit(2 * sample).toArrow().sort_by([("key", "ascending"), ("label", "ascending")]).combine_chunks()
    lists = [t.column(c).combine_chunks() if isinstance(t.column(c), pa.ChunkedArray) else t.column(c) for c in ("index", "value", "stats")]
    flat = [x.flatten().to_numpy() for x in lists]
    sizes = np.array([0, *np.cumsum(lists[0].value_lengths().to_numpy())]) if len(t) else np.zeros(1, int)
    marks = np.array(t.column("label").to_numpy())
    # The driver keeps the sample once while it trains, and nothing of it after that.
    del t, lists
    pa.default_memory_pool().release_unused()
    machine = train(sizes, flat.pop(0), flat.pop(0), flat.pop(0).reshape(-1, STATS), marks)
    pa.default_memory_pool().release_unused()
    return machine


def _score(shared, names: list[str], name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Machine = shared.value
        for batch in batches:
            score = np.zeros(len(batch))
            for lo, hi, at, index, value, stats in features(batch.column(len(names)), batch.column(len(names) + 1)):
                score[lo:hi] = 1 / (1 + np.exp(-np.clip(m.margin(*m.rows(at, index, value, stats))[0], -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(score)], [*names, name])

    return run


def score(machine: Machine, docs: DataFrame, keep: list[str], text: str = "text", name: str = "score") -> DataFrame:
    """``keep`` columns and the score (0 to 1), as ``name``, of every row of ``docs``."""
    rows = docs.select(*[F.col(c) for c in keep], F.col(text).cast("string").alias("__text"), _meta(docs))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:-2]) + f"`{name}` double"
    return rows.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(machine), list(keep), name), schema)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("held_out", held_out(F.col("doc_id"), 3))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out(F.col("doc_id"), 3))
    scored = score(fit(docs.filter(~F.col("held_out")), labels), docs, ["doc_id", "held_out"])
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
