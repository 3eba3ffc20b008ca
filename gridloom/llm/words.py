"""Words of Arrow text columns as NumPy arrays, without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACES = bytes([0x20, *range(0x09, 0x0E)])
IS_WORD = np.ones(256, dtype=bool)
IS_WORD[list(SPACES)] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
CHUNK_BYTES = 1 << 21
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base**2, ... modulo 2**64, kept for the next call."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 1)
        steps = np.full(size, base, dtype=np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if size <= 4 * CHUNK_BYTES:
            _powers[base] = have
    return have


def chunks(texts: pa.Array | pa.ChunkedArray, budget: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, row after the last, bytes, offsets)`` of runs of whole texts.

    A run holds ``budget`` bytes at most, or one longer text. Null counts as empty.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + budget, side="right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and each text's first word (one more at the end)."""
    inside = IS_WORD[data]
    first, last = inside.copy(), inside.copy()
    if len(data):
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        cuts = offsets[(offsets > 0) & (offsets < len(data))]
        first[cuts] = inside[cuts]
        last[cuts - 1] = inside[cuts - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hashes of ``data[start:end]``; equal bytes (after A-Z to a-z) hash alike."""
    values = (LOWER[data] if lower else data).astype(np.uint64)
    values += np.uint64(1)
    values *= powers(BASE, len(data) + 1)[: len(data)]
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(values, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers(BASE_INVERSE, len(data) + 1)[starts])


def unique(keys: np.ndarray) -> np.ndarray:
    """The keys in order, each once. (``np.unique`` alone fills a set of keys, which takes several times as long.)"""
    keys = np.sort(keys)
    return keys[_new(keys)]


def _new(keys: np.ndarray) -> np.ndarray:
    """Which of some sorted keys differ from the one before."""
    new = np.ones(len(keys), dtype=bool)
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    return new


class HashTable:
    """Open addressing over 64-bit keys, built and searched in whole arrays.

    The first keys have their slots first, so the most wanted ones belong there. Of equal keys one is found.
    """

    EMPTY = np.uint64((1 << 64) - 1)

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 1.4))))
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys = np.full(1 << bits, self.EMPTY, dtype=np.uint64)
        self.rows = np.zeros(1 << bits, dtype=np.int32)
        keys = keys.astype(np.uint64, copy=False)
        todo, slots = np.arange(len(keys)), self._slots(keys)
        while len(todo):
            free = np.flatnonzero(self.keys[slots] == self.EMPTY)
            # Keys that want the same slot all write their row; the last one written, which is the first key, has it.
            self.rows[slots[free[::-1]]] = todo[free[::-1]]
            put = free[self.rows[slots[free]] == todo[free]]
            self.keys[slots[put]] = keys[todo[put]]
            rest = np.ones(len(todo), dtype=bool)
            rest[put] = False
            todo, slots = todo[rest], (slots[rest] + 1) & self.mask

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        slots = keys * np.uint64(0xD6E8FEB86659FD93)
        slots >>= self.shift
        return slots.view(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, -1 where there is none."""
        slots = self._slots(keys)
        seen, rows = self.keys[slots], self.rows[slots]
        miss = np.flatnonzero(seen != keys)
        rows[miss] = -1
        todo = miss[seen[miss] != self.EMPTY]
        slots = slots[todo]
        while len(todo):
            slots = (slots + 1) & self.mask
            seen = self.keys[slots]
            hit = seen == keys[todo]
            rows[todo[hit]] = self.rows[slots[hit]]
            on = ~hit & (seen != self.EMPTY)
            todo, slots = todo[on], slots[on]
        return rows


class Counts:
    """Counts of 64-bit keys, gathered batch by batch; ``drain`` gives and forgets them.

    Keys are counted when ``RAW`` of them are there, so that few counts have to be merged.
    """

    RAW = 1 << 21

    def __init__(self, limit: int = 1 << 22):
        self.raw: list[np.ndarray] = []
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting, self.size, self.limit = 0, 0, limit

    def add(self, keys: np.ndarray) -> None:
        self.raw.append(keys)
        self.waiting += len(keys)
        if self.waiting >= self.RAW:
            self._count()
        if self.size > self.limit and len(self.parts) > 1:
            self.parts = [self._merged()]
            self.size = len(self.parts[0][0])

    def full(self) -> bool:
        return self.size > self.limit

    def _count(self) -> None:
        keys = np.concatenate(self.raw)
        self.raw, self.waiting = [], 0
        keys.sort()
        at = np.flatnonzero(_new(keys))
        self.parts.append((keys[at], np.diff(at, append=len(keys))))
        self.size += len(at)

    def _merged(self) -> tuple[np.ndarray, np.ndarray]:
        keys = np.concatenate([k for k, _ in self.parts])
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], np.concatenate([c for _, c in self.parts])[order]
        at = np.flatnonzero(_new(keys))
        return keys[at], np.add.reduceat(n, at)

    def drain(self) -> tuple[np.ndarray, np.ndarray]:
        if self.waiting:
            self._count()
        out = self._merged() if self.parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        self.parts, self.size = [], 0
        return out
