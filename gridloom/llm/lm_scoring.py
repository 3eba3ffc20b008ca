"""Prediction by partial matching: code length of texts under a byte-context trie.

``fit`` learns from the training texts: counts of words, and a trie of byte
contexts up to ``order`` bytes, as counts of (context, next byte). ``score`` gives
each text its log10 probability. At each byte the longest known context
predicts it; a byte not seen there pays the escape probability ``d / (T + d)``
(``T`` symbols counted, ``d`` of them distinct) and passes on to the context that is
a byte shorter, where all symbols of the longer one are excluded. Below the empty
context the symbols left are equally likely. The end of a text is a symbol too.

Nothing of the model but its frequent entries goes to every task, and texts are read
a fixed number of times whatever the model's size:

* Counts are partial sums per task, then a ``groupBy``.
* Texts are packed into stored blocks of ``BLOCK_BYTES`` (and one text more), and each
  block names the distinct words and (context, byte) pairs it needs. A name occurs once a
  block at most, so frequent ones are no skew.
* These names are joined to the model by shuffles and come back to their block, so a
  task holds one block and its own entries. Pairs that training never saw take their
  escapes by one join a level; only the two shortest levels (257 contexts at most) are
  broadcast.
* Entries with a share of 1 / ``frequent`` or more, so ``frequent`` at most, are broadcast
  and need no join.

Null texts count as empty: one end token and the end symbol. With no training
text every byte has probability 1/256. A null id counts as the text ''. Rows with
the same id, and equal rows, are scored each on their own. Words are told apart by 63 bits
of a hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.words import Counts, HashTable, chunks, hashes, spans, unique
from gridloom.operators.tables import discard, materialize

ORDER = 5
END = 0xFF
#: Keys of words have the highest bit, keys of (context, byte) pairs have not.
WORD = np.uint64(1 << 63)
END_WORD = np.uint64(0x5BD1E995C2B2AE35) | WORD
SYMBOLS = 256
FREQUENT = 1_000_000
BLOCK_BYTES = 1 << 25
#: What a task looks at or sends together: bytes of text, keys before equal ones are merged, keys in a batch.
CHUNK_BYTES, HELD_KEYS, SENT_KEYS = 1 << 19, 1 << 20, 1 << 16


def stream(data: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts with ``order`` padding bytes before and an end symbol after each; their starts."""
    starts = offsets[:-1] + np.arange(len(offsets) - 1) * (order + 1)
    out = np.full(len(data) + (len(offsets) - 1) * (order + 1), END, dtype=np.uint8)
    for to, a, b in zip((starts + order).tolist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        out[to : to + b - a] = data[a:b]
    return out, starts


def grams(padded: np.ndarray, order: int) -> np.ndarray:
    """For each position from ``order`` on: the ``order`` bytes before it and its own, packed."""
    n = len(padded) - order
    keys = np.zeros(n, dtype=np.uint64)
    for j in range(order + 1):
        keys <<= np.uint64(8)
        keys |= padded[j : j + n]
    return keys


def real(starts: np.ndarray, total: int, order: int) -> np.ndarray:
    """Which of ``grams``' positions are bytes or ends of texts and not padding."""
    keep = np.ones(total - order, dtype=bool)
    for j in range(order):
        keep[starts[1:] - order + j] = False
    return keep


def keys_of(data: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word keys, each text's first word, (context, byte) keys, which of them are real, each text's first of them."""
    starts, ends, first = spans(data, offsets)
    padded, at = stream(data, offsets, order)
    return hashes(data, starts, ends) | WORD, first, grams(padded, order), real(at, len(padded), order), at


def _sent(**columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    for lo in range(0, len(next(iter(columns.values()))), SENT_KEYS):
        yield pa.record_batch({name: pa.array(values[lo : lo + SENT_KEYS]) for name, values in columns.items()})


def _count(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Counts(HELD_KEYS)

        def out() -> Iterator[pa.RecordBatch]:
            keys, n = found.drain()
            yield from _sent(key=keys.view(np.int64), n=n.astype(np.int64))

        for batch in batches:
            for _, _, data, offsets in chunks(batch.column(0), CHUNK_BYTES):
                words, _, pairs, keep, _ = keys_of(data, offsets, order)
                found.add(np.r_[words, np.full(len(offsets) - 1, END_WORD)])
                found.add(pairs[keep])
                if found.full():
                    yield from out()
        yield from out()

    return run


@dataclass
class Model:
    """Tables of a fitted model.

    ``words`` has (key, n). ``contexts`` has (k, context, total, kinds, below, symbols): for a
    context of ``k`` bytes its symbols with their counts (257 at most), the sums of both,
    and how often its symbols were counted after the context a byte shorter.
    """

    order: int
    words: DataFrame
    contexts: DataFrame
    total: int
    distinct: int
    pairs: int


def fit(texts: DataFrame, text: str = "text", order: int = ORDER) -> Model:
    """Count the words and the byte contexts of all ``texts``; ``order`` from 1 to 6."""
    if not 1 <= order <= 6:
        raise ValueError("order must be from 1 to 6")
    counts = texts.select(F.col(text).cast("string").alias("text")).mapInArrow(_count(order), "key long, n long")
    counts = materialize(counts.groupBy("key").agg(F.sum("n").alias("n")), "ppm-counts")
    words, pairs = counts.filter("key < 0"), counts.filter("key >= 0")
    sums = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    levels = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col("key").bitwiseAND((1 << 8 * (k + 1)) - 1).alias("pair")) for k in range(order + 1)]))
    trie = materialize(pairs.select("n", levels.alias("at")).groupBy("at.k", "at.pair").agg(F.sum("n").alias("c")), "ppm-trie")
    shorter = trie.select((F.col("k") + 1).alias("k"), F.col("pair").alias("tail"), F.col("c").alias("below"))
    tail = F.when(F.col("k") == 0, F.lit(-1).cast("long"))
    for k in range(1, order + 1):
        tail = tail.when(F.col("k") == k, F.col("pair").bitwiseAND((1 << 8 * k) - 1))
    contexts = (
        trie.withColumn("tail", tail)
        .join(shorter, ["k", "tail"], "left")
        .groupBy("k", F.shiftright("pair", 8).alias("context"))
        .agg(
            F.sum("c").alias("total"),
            F.count("*").alias("kinds"),
            F.coalesce(F.sum("below"), F.lit(0)).alias("below"),
            F.collect_list(F.struct(F.col("pair").bitwiseAND(0xFF).cast("int").alias("symbol"), F.col("c").alias("n"))).alias("symbols"),
        )
    )
    contexts = materialize(contexts, "ppm-contexts")
    seen = pairs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    discard(trie)
    return Model(order, words, contexts, sums["n"], sums["v"], seen)


def seen_pairs(model: Model) -> DataFrame:
    """``(key, n, value)`` of the pairs of the longest contexts: their count and log10 probability."""
    each = model.contexts.filter(F.col("k") == model.order).select("context", (F.col("total") + F.col("kinds")).alias("all"), F.explode("symbols").alias("s"))
    return each.select(F.shiftleft("context", 8).bitwiseOR(F.col("s.symbol").cast("long")).alias("key"), F.col("s.n").alias("n"), (F.log10("s.n") - F.log10("all")).alias("value"))


def new_pairs(model: Model, keys: DataFrame) -> DataFrame:
    """``(key, value)``: the log10 probability of pairs that the longest contexts don't have, by their escapes."""
    zero = F.lit(0).cast("long")
    q = keys.select("key", F.lit(0.0).alias("value"), zero.alias("gone_kinds"), zero.alias("gone"), F.lit(False).alias("found"))
    for k in range(model.order, -1, -1):
        level = model.contexts.filter(F.col("k") == k).select(F.col("context").alias("at"), "total", "kinds", "below", F.map_from_entries("symbols").alias("symbols"))
        # Levels 0 and 1 have 257 contexts at most.
        level = F.broadcast(level) if k < 2 else level
        q = q.join(level, F.shiftright("key", 8).bitwiseAND((1 << 8 * k) - 1) == F.col("at"), "left")
        known, n = F.col("at").isNotNull(), F.col("symbols")[F.col("key").bitwiseAND(0xFF).cast("int")]
        left = F.coalesce("kinds", zero) - F.col("gone_kinds")
        have = F.coalesce("total", zero) - F.col("gone") + left
        step = F.when(n.isNotNull(), F.log10(n / have)).when(known & (left > 0), F.log10(left / have)).otherwise(0.0)
        q = q.select(
            "key",
            F.when(F.col("found"), F.col("value")).otherwise(F.col("value") + step).alias("value"),
            F.coalesce("kinds", "gone_kinds").alias("gone_kinds"),
            F.coalesce("below", "gone").alias("gone"),
            (F.col("found") | n.isNotNull()).alias("found"),
        )
    return q.select("key", F.when(F.col("found"), F.col("value")).otherwise(F.col("value") - F.log10(F.lit(SYMBOLS) - F.col("gone_kinds"))).alias("value"))


def _packed(size: int):
    """Rows (kept, text) as rows (block, rows): compressed Arrow tables of ``CHUNK_BYTES`` of text, ``size`` of it a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, filled = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy().astype(np.int64) + 64)
            a = 0
            while a < len(batch):
                before = int(ends[a - 1]) if a else 0
                b = max(a + 1, int(np.searchsorted(ends, before + CHUNK_BYTES, side="right")))
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                    writer.write_batch(batch.slice(a, b - a))
                yield pa.record_batch({"block": pa.array([task + filled // size], pa.int64()), "rows": pa.array([sink.getvalue().to_pybytes()], pa.binary())})
                filled += int(ends[b - 1]) - before
                a = b

    return run


def _unpacked(rows: pa.BinaryScalar) -> tuple[pa.Array, pa.Array]:
    """The columns (kept, text) of a part of a block."""
    part = pa.ipc.open_stream(rows.as_buffer()).read_next_batch()
    return part.column(0), part.column(1)


def _merged(parts: list[np.ndarray]) -> list[np.ndarray]:
    return [unique(np.concatenate(parts))] if parts else []


_loaded: dict[str, tuple[HashTable, np.ndarray]] = {}


def _frequent(shared) -> tuple[HashTable, np.ndarray]:
    """The broadcast entries as a table and their values, and a 0 for what is not there; built once in each worker."""
    v = shared.value
    if v["id"] not in _loaded:
        _loaded.clear()
        _loaded[v["id"]] = HashTable(v["keys"]), np.append(v["values"], 0.0)
        v["keys"] = None  # the table has a copy
    return _loaded[v["id"]]


def _needs(shared, order: int):
    """``(block, key)``: the distinct keys of each block that are not frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, _ = _frequent(shared)
        block, parts, held = None, [], 0

        def out() -> Iterator[pa.RecordBatch]:
            for keys in _merged(parts):
                yield from _sent(block=np.full(len(keys), block, np.int64), key=keys.view(np.int64))

        for batch in batches:
            for of, rows in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if of != block:
                    yield from out()
                    block, parts, held = of, [], 0
                for _, _, data, offsets in chunks(_unpacked(rows)[1], CHUNK_BYTES):
                    words, _, pairs, keep, _ = keys_of(data, offsets, order)
                    for keys in (words, pairs[keep]):
                        parts.append(keys[table.find(keys) < 0])
                        held += len(parts[-1])
                if held > HELD_KEYS:
                    parts, held = _merged(parts), 0
        yield from out()

    return run


def _score(shared, order: int, total: int, distinct: int):
    """Scores of a block's rows from its own entries and the frequent ones."""

    def run(block: pa.Table, needed: pa.Table) -> pa.Table:
        frequent, frequent_values = _frequent(shared)
        own, own_values = HashTable(needed.column("key").to_numpy().view(np.uint64)), np.append(needed.column("value").to_numpy(), 0.0)

        def find(keys: np.ndarray) -> np.ndarray:
            row = frequent.find(keys)
            out, miss = frequent_values[row], np.flatnonzero(row < 0)
            out[miss] = own_values[own.find(keys[miss])]
            return out

        base = np.log10(total + 0.5 * (distinct + 1))
        tables = []
        for kept, texts in map(_unpacked, block.column("rows")):
            score, n_tokens, known, base_score = (np.zeros(len(texts), t) for t in (float, np.int64, np.int64, float))
            for lo, hi, data, offsets in chunks(texts, CHUNK_BYTES):
                words, first, pairs, keep, at = keys_of(data, offsets, order)
                logs = np.zeros(len(pairs))
                logs[keep] = find(pairs[keep])
                score[lo:hi] = np.add.reduceat(logs, at)
                n = find(np.r_[words, END_WORD])
                n_tokens[lo:hi] = np.diff(first) + 1
                known[lo:hi] = np.diff(np.r_[0, np.cumsum(n[:-1] > 0)][first]) + (n[-1] > 0)
                logs = np.log10(n + 0.5) - base
                base_score[lo:hi] = np.diff(np.r_[0.0, np.cumsum(logs[:-1])][first]) + logs[-1]
            made = {"n_tokens": n_tokens, "n_known": known, "train_tokens": np.full(len(texts), total, np.int64), "base_score": base_score, "score": score}
            tables.append(pa.table({"kept": kept, **{name: pa.array(values) for name, values in made.items()}}))
        return pa.concat_tables(tables).combine_chunks()

    return run


def score(model: Model, docs: DataFrame, keep: list[str], text: str = "text", frequent: int = FREQUENT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``keep`` columns (one at least), ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score`` of every row of ``docs``."""
    rows = docs.select(F.struct(*[F.col(c) for c in keep]).alias("kept"), F.col(text).cast("string").alias("text"))
    blocks = materialize(rows.mapInArrow(_packed(block_bytes), "block long, rows binary"), "ppm-blocks")
    seen = seen_pairs(model)
    top = (
        model.words.filter((F.col("n") * frequent >= model.total) | (F.col("key") == int(END_WORD.view(np.int64))))
        .select("key", "n", F.col("n").cast("double").alias("value"))
        .unionByName(seen.filter(F.col("n") * frequent >= model.pairs))
        .toArrow()
        .sort_by([("n", "descending")])
    )
    label = f"{id(model)}-{np.random.default_rng().integers(1 << 62)}"
    shared = docs.sparkSession.sparkContext.broadcast({"id": label, "keys": top.column("key").to_numpy().view(np.uint64), "values": top.column("value").to_numpy()})
    needs = materialize(blocks.mapInArrow(_needs(shared, model.order), "block long, key long"), "ppm-needs", compression="zstd")
    new = new_pairs(model, needs.filter("key >= 0").select("key").join(seen.select("key"), "key", "left_anti").distinct())
    values = model.words.select("key", F.col("n").cast("double").alias("value")).unionByName(seen.select("key", "value")).unionByName(new)
    found = needs.join(values, "key").select("block", "key", "value")
    kept = rows.schema["kept"].dataType.simpleString()
    scored = blocks.groupBy("block").cogroup(found.groupBy("block"))
    scored = scored.applyInArrow(_score(shared, model.order, model.total, model.distinct), f"kept {kept}, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return scored.select("kept.*", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def held_out(doc_id: Column, folds: int = 5, fold: int = 1) -> Column:
    """Whether crc32 of the id as text leaves the remainder ``fold``."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").withColumn("held_out", held_out(F.col("doc_id")))
    return score(fit(docs.filter(~F.col("held_out"))), docs, ["doc_id", "held_out"])
