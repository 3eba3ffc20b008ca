"""Keys of words and contexts: each once, counted, and looked up in whole arrays."""

import random
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from gridloom.llm import lm_scoring, words


@pytest.fixture
def no_sets(monkeypatch):
    """``np.unique`` without counts fills a set of keys, which takes several times as long as to sort them."""

    def fail(*args, **kwargs):
        raise AssertionError("np.unique was called")

    monkeypatch.setattr(np, "unique", fail)


def test_needed_keys_are_sorted_and_not_put_in_a_set(monkeypatch, no_sets):
    monkeypatch.setattr(lm_scoring, "HELD_KEYS", 50)
    monkeypatch.setattr(lm_scoring, "CHUNK_BYTES", 200)
    monkeypatch.setattr(lm_scoring, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 3)))
    rng = random.Random(5)
    texts = [None, "", *(" ".join(rng.choices(["The", "cat", "sat", "été", "on"], k=rng.randint(1, 30))) for _ in range(60))]
    found: dict[int, set[int]] = {}
    batch = pa.record_batch({"kept": pa.array(range(len(texts))), "text": pa.array(texts)})
    parts = list(lm_scoring._packed(1000)(iter([batch])))
    for part in parts:
        for _, _, data, offsets in words.chunks(lm_scoring._unpacked(part.column(1)[0])[1]):
            keys, _, pairs, keep, _ = lm_scoring.keys_of(data, offsets, 3)
            found.setdefault(part.column(0)[0].as_py(), set()).update(keys.tolist(), pairs[keep].tolist())
    frequent = np.array(sorted(set.union(*found.values()))[::7], dtype=np.uint64)
    shared = SimpleNamespace(value={"id": "test", "keys": frequent, "values": np.zeros(len(frequent))})
    got: dict[int, list[int]] = {}
    for out in lm_scoring._needs(shared, 3)(iter(parts)):
        for block, key in zip(out.column(0).to_pylist(), out.column(1).to_numpy().view(np.uint64).tolist(), strict=True):
            got.setdefault(block, []).append(key)
    assert len(got) > 3
    assert got == {block: sorted(keys - set(frequent.tolist())) for block, keys in found.items()}


def test_batches_are_counted_together(monkeypatch, no_sets):
    rng = np.random.default_rng(2)
    batches = [rng.integers(0, 40, n).astype(np.uint64) for n in (5, 0, 7, 90, 3, 200, 1)]
    counts = words.Counts(30)
    for batch in batches[:3]:
        counts.add(batch)
    assert not counts.parts  # too few keys to be worth a merge
    monkeypatch.setattr(words.Counts, "RAW", 20)
    total: Counter[int] = Counter()
    for batch in batches[3:]:
        counts.add(batch)
        if counts.full():
            keys, n = counts.drain()
            assert (np.diff(keys.astype(np.int64)) > 0).all()
            total.update(dict(zip(keys.tolist(), n.tolist(), strict=True)))
    keys, n = counts.drain()
    total.update(dict(zip(keys.tolist(), n.tolist(), strict=True)))
    assert total == Counter(np.concatenate(batches).tolist())
    assert [len(x) for x in counts.drain()] == [0, 0]


@pytest.mark.parametrize("n", [0, 1, 3000])
def test_tables_find_every_key_and_no_other(no_sets, n):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 1 << 48, n).astype(np.uint64)
    table = words.HashTable(np.concatenate([keys, keys[: n // 3]]))
    rows = table.find(keys)
    assert (np.concatenate([keys, keys[: n // 3]])[rows] == keys).all() and (rows >= 0).all()
    assert (table.find(rng.integers(1 << 48, 1 << 49, 5000).astype(np.uint64)) == -1).all()
    # The first of the keys that want a slot has it.
    slots = table._slots(keys).tolist()
    first = {slot: row for row, slot in reversed(list(enumerate(slots)))}
    assert all(table.keys[slot] == keys[row] for slot, row in first.items())
    assert words.unique(keys).tolist() == sorted(set(keys.tolist()))
