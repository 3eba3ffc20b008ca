"""Stretches of a text that repeat with a period, and the text without the repetition.

A run is a stretch of consecutive words with smallest period ``q`` (words ``q`` apart are
equal) of at least ``min_length`` and ``min_exponent * q`` words that no word beside it continues.

Words that lie in no run leave first, by counts: in a run, every three words in a row occur
``min_exponent - 1`` times at least, so stretches are cut where three words are rarer, and
counted again by themselves until nothing changes. What is left of some texts is laid one after
the other with separators that occur once. Ukkonen's suffix trees of it and of its reversal
give the longest common extension of two places to the right and to the left: the tour of a
tree in order is kept as its leaves and the least depth between neighbours, and a sparse
table over these depths gives that of any two leaves' lowest common ancestor in constant time.
By the theorem on runs, a run has a Lyndon root that is the longest Lyndon word at its
place under one of two opposite orders of the words. So each place gives two
candidates, from the next smaller suffix of each order, and both extensions make the run.

Nothing is shuffled. Memory grows with the longest stretch that passes the counts, by some
500 bytes a word; words outside it stay in arrays. Words are told apart by 64-bit hashes.

Null and empty texts, and texts of white space, have no words and no runs, and collapse to the
empty text. Rows are independent: repeated rows and ids give repeated results, other columns
stay out of it whatever their names, and an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from gridloom.llm.words import chunks, hashes, mix, spans

MIN_LENGTH, MIN_EXPONENT = 6, 4
#: Words of one pair of trees, or one longer stretch.
TREE_WORDS = 1 << 15
ROUNDS = 8
RUNS = ArrayType(StructType().add("start", "long").add("length", "long").add("period", "long"))


def suffix_tree(text: list[int]) -> tuple[list[dict[int, int]], list[int]]:
    """Ukkonen's tree of ``text``, whose last symbol occurs once: the children and the depth in symbols of each inner node.

    A child is an inner node, or ``~k`` for the leaf of the suffix from ``k``; children go by first symbols.
    """
    children: list[dict[int, int]] = [{}]
    depth, place, link = [0], [0], [0]
    node = length = suffix = 0
    for i, symbol in enumerate(text):
        waiting = 0
        while suffix <= i:
            above, below = depth[node], children[node]
            if not length:
                if waiting:
                    link[waiting] = node
                    waiting = 0
                if symbol in below:
                    length = 1
                    break
                below[symbol] = ~suffix
            else:
                first = text[suffix + above]
                child = below[first]
                if child >= 0:
                    step = depth[child] - above
                    if length >= step:
                        node, length = child, length - step
                        continue
                    at = place[child]
                else:
                    at = ~child
                after = text[at + above + length]
                if after == symbol:
                    if waiting:
                        link[waiting] = node
                    length += 1
                    break
                split = len(depth)
                children.append({after: child, symbol: ~suffix})
                depth.append(above + length)
                place.append(at)
                link.append(0)
                below[first] = split
                if waiting:
                    link[waiting] = split
                waiting = split
            suffix += 1
            if node:
                node = link[node]
            elif length:
                length -= 1
    return children, depth


def leaves(children: list[dict[int, int]], depth: list[int], size: int, falling: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Each suffix's place in the tour's order of leaves, and the least depth met between each leaf and the one before.

    ``falling`` takes the symbols in the opposite order; the end, symbol 0, stays first.
    """
    order, lows, todo = [], [], [(0, 0)]
    while todo:
        node, low = todo.pop()
        if node < 0:
            order.append(~node)
            lows.append(low)
            continue
        below, own = children[node], depth[node]
        keys = sorted(below, reverse=not falling)
        if falling and keys[0] == 0:
            keys.append(keys.pop(0))
        smallest = keys.pop()
        todo.extend([(below[k], own) for k in keys])
        todo.append((below[smallest], low))
    rank = np.empty(size, np.int64)
    rank[order] = np.arange(size)
    return rank, np.array(lows, np.int32)


class Extension:
    """Longest common extensions of places of a text, many at once."""

    def __init__(self, rank: np.ndarray, lows: np.ndarray):
        self.rank, self.table = rank, [lows]
        while 2 << (len(self.table) - 1) <= len(lows):
            half, last = 1 << (len(self.table) - 1), self.table[-1]
            self.table.append(np.minimum(last[:-half], last[half:]))

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        a, b = self.rank[a], self.rank[b]
        lo, hi = np.minimum(a, b) + 1, np.maximum(a, b) + 1
        level = np.frexp((hi - lo).astype(float))[1] - 1
        out = np.empty(len(lo), np.int64)
        for k in np.unique(level):
            at = level == k
            out[at] = np.minimum(self.table[k][lo[at]], self.table[k][hi[at] - (1 << k)])
        return out


def next_smaller(rank: np.ndarray) -> np.ndarray:
    """For each suffix but the last, the next one that is smaller; from there its longest Lyndon word ends."""
    values, found, held = rank.tolist(), [0] * (len(rank) - 1), []
    for i, value in enumerate(values):
        while held and values[held[-1]] > value:
            found[held.pop()] = i
        held.append(i)
    return np.array(found, np.int64)


def runs_of(symbols: np.ndarray, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and periods of all runs in ``symbols``, positive whole numbers, by start and period."""
    n = len(symbols)
    forward = symbols.tolist()
    tree = suffix_tree([*forward, 0])
    rank, lows = leaves(*tree, n + 1)
    other, _ = leaves(*tree, n + 1, falling=True)
    del tree
    right = Extension(rank, lows)
    left = Extension(*leaves(*suffix_tree([*reversed(forward), 0]), n + 1))
    at = np.tile(np.arange(n), 2)
    period = np.r_[next_smaller(rank), next_smaller(other)] - at
    start = at - left(n - at, n - at - period)
    length = at + period + right(at, at + period) - start
    good = (length >= min_length) & (length >= min_exponent * period)
    found = np.unique(np.column_stack([start[good], period[good], length[good]]), axis=0)
    return found[:, 0], found[:, 2], found[:, 1]


def stretches(words: np.ndarray, first: np.ndarray, min_length: int, min_exponent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words that may lie in a run, and the number of each one's stretch. ``first``: each text's first word, and one more."""
    place = np.arange(len(words))
    group = np.repeat(np.arange(len(first) - 1), np.diff(first))
    least = min(min_length - 2, min_exponent - 1)
    for _ in range(ROUNDS):
        if len(place) < min_length:
            return place[:0], group[:0]
        inside = group[2:] == group[:-2]
        w = words[place]
        key = mix(mix(mix(w[:-2]) + w[1:-1]) + w[2:]) + group[:-2].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        _, back, n = np.unique(key, return_inverse=True, return_counts=True)
        often = np.r_[False, (n[back] >= least) & inside, False]
        edges = np.flatnonzero(often[1:] != often[:-1])
        # The last two places of a stretch are never ``inside``, so the next one begins anew.
        starts, ends = edges[::2], edges[1::2] + 2
        long = ends - starts >= min_length
        starts, ends = starts[long], ends[long]
        sizes = ends - starts
        before = len(place)
        place = place[np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]
        group = np.repeat(np.arange(len(sizes)), sizes)
        if len(place) == before:
            break
    return place, group


def find(words: np.ndarray, first: np.ndarray, min_length: int, min_exponent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts (places in ``words``), lengths and periods of the runs of all texts."""
    place, group = stretches(words, first, min_length, min_exponent)
    ends = np.flatnonzero(np.r_[group[1:] != group[:-1], True]) + 1 if len(group) else np.zeros(0, np.int64)
    out, lo = [], 0
    while lo < len(place):
        hi = int(ends[max(np.searchsorted(ends, lo + TREE_WORDS, side="right") - 1, np.searchsorted(ends, lo, side="right"))])
        _, symbols = np.unique(words[place[lo:hi]], return_inverse=True)
        breaks = np.flatnonzero(group[lo + 1 : hi] != group[lo : hi - 1]) + 1
        text = np.insert(symbols + 1, breaks, symbols.max() + 2 + np.arange(len(breaks)))
        where = np.insert(place[lo:hi], breaks, -1)
        start, length, period = runs_of(text, min_length, min_exponent)
        out.append((where[start], length, period))
        lo = hi
    if not out:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(parts) for parts in zip(*out, strict=True))


def _run(min_length: int, min_exponent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column(batch.num_columns - 1)):
                starts, ends, first = spans(data, offsets)
                start, length, period = find(hashes(data, starts, ends, lower=False), first, min_length, min_exponent)
                order = np.lexsort((period, start))
                start, length, period = start[order], length[order], period[order]
                text = np.searchsorted(first, start, side="right") - 1
                change = np.zeros(len(starts) + 1, np.int64)
                np.add.at(change, start + period, 1)
                np.add.at(change, start + length, -1)
                kept = np.cumsum(change[:-1]) == 0
                # The kept words and a space after each, then without the last one of each text.
                sizes = np.where(kept, ends - starts + 1, 0)
                before = np.r_[0, np.cumsum(sizes)]
                spaced = np.append(data, np.uint8(0x20))
                flat = spaced[np.repeat(starts - before[:-1], sizes) + np.arange(before[-1])]
                flat[before[1:][kept] - 1] = 0x20
                cuts = before[first]
                full = cuts[1:] > cuts[:-1]
                use = np.ones(len(flat), bool)
                use[cuts[1:][full] - 1] = False
                collapsed = pa.LargeStringArray.from_buffers(hi - lo, pa.py_buffer(np.r_[0, np.cumsum(np.diff(cuts) - full)].astype(np.int64)), pa.py_buffer(np.ascontiguousarray(flat[use])))
                found = pa.StructArray.from_arrays([pa.array(start - first[text]), pa.array(length), pa.array(period)], ["start", "length", "period"])
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(hi - lo + 1)).astype(np.int32)), found)
                columns = [c.slice(lo, hi - lo) for c in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.diff(first)), lists, collapsed.cast(pa.string())], [*batch.schema.names[:-1], "n_words", "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, keep: list[str], text: str | Column = "text", min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """``keep`` of every row with ``n_words``, its ``runs`` by start and period, and ``collapsed``: its words but those
    that a run repeats (all of a run after its first period), joined by a space."""
    if min_length < 3 or min_exponent < 2:
        raise ValueError("a run has three words and two periods at least")
    own = [f"__k{i}" for i in range(len(keep))]
    rows = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(keep, own, strict=True)], (F.col(text) if isinstance(text, str) else text).cast("string").alias("__text"))
    schema = StructType(rows.schema.fields[:-1]).add("n_words", "long").add("runs", RUNS).add("collapsed", "string")
    found = rows.mapInArrow(_run(min_length, min_exponent), schema)
    return found.select(*[F.col(k).alias(c) for c, k in zip(keep, own, strict=True)], "n_words", "runs", "collapsed")


def strongest(runs: Column) -> Column:
    """The run with the greatest length by period, exactly; of equal ones the first. Null where there is none."""
    more = lambda a, b: a["length"] * b["period"] > b["length"] * a["period"]
    return F.when(F.size(runs) > 0, F.reduce(runs, runs[0], lambda best, r: F.when(more(r, best), r).otherwise(best)))


def planted(doc_id: Column, text: Column) -> Column:
    """The text, in one of ten documents with a tail of its words that repeats with a period, as the contract of the query states."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", -1), lambda w: w != "")
    h, n = F.crc32(doc_id.cast("string")), F.size(words).cast("long")
    g = F.floor(h / 10)
    a = g % n
    p = F.lit(1) + F.floor((n - a) / (g % 8 + 3))
    tail = F.flatten(F.array_repeat(F.slice(words, a.cast("int") + 1, p.cast("int")), F.ceil((n - a) / p).cast("int")))
    whole = F.concat(F.slice(words, F.lit(1), a.cast("int")), F.slice(tail, F.lit(1), (n - a).cast("int")))
    return F.when((h % 10 == 0) & (n > 0), F.array_join(whole, " ")).otherwise(text)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = periodic_runs(docs, ["doc_id"], planted(F.col("doc_id"), F.col("text"))).withColumn("best", strongest(F.col("runs")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.floor(F.col("best.length") * 1000 / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.encode(listed, "UTF-8"), 256).alias("runs_sha256"),
        F.sha2(F.encode("collapsed", "UTF-8"), 256).alias("collapsed_sha256"),
    )
