"""Chat formatting with minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant turns by
turns, the user first; it may end after any of them. Turns that break this are repaired
at least cost by dynamic programming over the states start, system, user, assistant:
a turn may be merged into a message of the same role (1), get another role (2), or have
the missing message put in before it, empty (3). Equal costs go to the first state.

The cost of a run of turns is a 4 x 4 matrix of costs from state to state, and matrices
of successive runs combine by (min, +). So the rows are put in order by range partitions, and
each partition is read as a stream and cut by place: a conversation that begins and ends
inside it, with ``CHUNK`` turns at most, is repaired at once; others are cut into chunks of
``CHUNK`` rows at most, whatever their turn numbers. Each turn of a chunk keeps its state for
every pair of states around the chunk, the matrices of a conversation give the right pair,
and a turn is then written from its own row. A conversation may hold any share of the rows,
and any number of them may have the same turn number or none. Only a conversation's matrices
(one for a chunk) meet in one task. The rendered sequence is the concatenation of its turns'
``rendered`` pieces in order, so no row holds a whole conversation.

Turns are ordered by number (null first), role and text. Equal rows are dealt to many
partitions; only turns of one number and role that differ after ``PREFIX`` characters of text
stay in one. Where chunks are cut does not change the result: ways of equal cost are told apart
by their states from the last turn back. Unknown and null roles take any role for the cost of
a change; null texts are empty. A null conversation id is one conversation.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators.tables import broadcast_if_small, materialize

STATES = ("start", "system", "user", "assistant")
MERGE, RELABEL, INSERT = 1.0, 2.0, 3.0
CHUNK = 1024
PREFIX = 512
BROADCAST_ROWS = 1_000_000
LEGAL = {(0, 1), (0, 2), (1, 2), (2, 3), (3, 2)}
OPEN, CLOSE = "<|{}|>\n", "<|end|>\n"


def _moves() -> tuple[np.ndarray, dict[tuple[int, int], tuple[str, int]]]:
    """The cheapest move between two states, and what it is: (action, inserted state)."""
    cost, how = np.full((4, 4), np.inf), {}
    for s in range(4):
        for o in range(1, 4):
            options = [(0.0, "keep", 0)] if (s, o) in LEGAL else []
            options += [(MERGE, "merge", 0)] if s == o else []
            options += [(INSERT, "insert", x) for x in range(1, 4) if (s, x) in LEGAL and (x, o) in LEGAL]
            if options:
                best = min(options)
                cost[s, o], how[s, o] = best[0], best[1:]
    return cost, how


MOVE_COST, MOVES = _moves()
#: By the turn's role (0: unknown): costs from state to state.
STEPS = [MOVE_COST + np.array([np.inf, *[0.0 if o == r else RELABEL for o in (1, 2, 3)]]) for r in range(4)]


IDENTITY = np.where(np.eye(4, dtype=bool), 0.0, np.inf)
#: A pair of states (before a chunk, at its end) has two bits of a turn's 32.
SHIFTS = 2 * np.arange(16, dtype=np.int64)
EVERY_PAIR = int((1 << SHIFTS).sum())


def repair(roles: list[int], entry: int = 0, leave: int | None = None) -> list[int]:
    """The output state of each turn on the cheapest way from ``entry`` (to ``leave``)."""
    cost, back = np.where(np.arange(4) == entry, 0.0, np.inf), []
    for r in roles:
        ways = cost[:, None] + STEPS[r]
        back.append(ways.argmin(axis=0))
        cost = ways.min(axis=0)
    state = int(cost.argmin()) if leave is None else leave
    out = []
    for b in reversed(back):
        out.append(state)
        state = int(b[state])
    return out[::-1]


def repair_open(codes: list[int]) -> tuple[np.ndarray, list[float]]:
    """For every pair of states around the turns: the states before and after each turn, packed, and (costs, ranks).

    A rank orders the first states of one last state by their ways from the last turn back.
    """
    m, back = IDENTITY, []
    for r in codes:
        ways = m[:, :, None] + STEPS[r]
        back.append(ways.argmin(axis=1))
        m = ways.min(axis=1)
    first = np.arange(4)[:, None]
    out = np.empty((len(codes) + 1, 4, 4), dtype=np.uint8)
    out[-1] = np.arange(4)
    for i in range(len(codes) - 1, -1, -1):
        out[i] = back[i][first, out[i + 1]]
    ranks = np.empty((4, 4))
    for o in range(4):
        ranks[sorted(range(4), key=lambda s: (out[:0:-1, s, o].tobytes(), s)), o] = range(4)
    return (out.reshape(-1, 16).astype(np.int64) << SHIFTS).sum(axis=1), [*m.ravel().tolist(), *ranks.ravel().tolist()]


def _changes(conv: pa.ChunkedArray) -> np.ndarray:
    """The rows whose conversation is another than the row's before."""
    v = conv.combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
    return np.flatnonzero(v[1:] != v[:-1]) + 1


def _placed(chunk: int):
    """Rows in order, each with its chunk (null: a whole conversation), its states, and a chunk's matrix at its end."""

    def emit(rows: pa.Table, part: int, pieces: list[tuple[int, int, int | None]]) -> Iterator[pa.RecordBatch]:
        n, codes = len(rows), rows.column("code").to_pylist()
        numbers, before, states = [None] * n, np.zeros(n, np.int64), np.zeros(n, np.int64)
        end, costs = np.zeros(n, dtype=bool), [None] * n
        for a, b, number in pieces:
            if number is None:
                packed = np.array([0, *repair(codes[a:b])], dtype=np.int64) * EVERY_PAIR
            else:
                numbers[a:b] = [number] * (b - a)
                packed, costs[b - 1] = repair_open(codes[a:b])
            before[a:b], states[a:b], end[b - 1] = packed[:-1], packed[1:], True
        new = {"part": pa.array([part] * n, pa.int64()), "chunk": pa.array(numbers, pa.int64()), "before": pa.array(before), "state": pa.array(states), "end": pa.array(end), "costs": pa.array(costs, pa.list_(pa.float64()))}
        for name, values in new.items():
            rows = rows.append_column(name, values)
        yield from rows.to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, begins = TaskContext.get().partitionId(), 0, None, False
        for batch in batches:
            if not len(batch):
                continue
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            bounds, pieces = [0, *_changes(held.column("conv")).tolist(), len(held)], []
            for a, b in pairwise(bounds):
                ended = b < len(held)
                if ended and begins and b - a <= chunk:
                    pieces.append((a, b, None))
                else:
                    while b - a > (0 if ended else chunk):
                        pieces.append((a, min(a + chunk, b), number))
                        a, number, begins = pieces[-1][1], number + 1, False
                begins = begins or ended
            if pieces:
                yield from emit(held.slice(0, pieces[-1][1]), part, pieces)
                held = held.slice(pieces[-1][1])
        if held is not None:
            yield from emit(held, part, [(0, len(held), number)])

    return run


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """States before and after each chunk of a conversation; the chunks are sorted by conversation and place."""

    def each(run: pa.Table) -> pa.RecordBatch:
        costs = run.column("costs").combine_chunks().flatten().to_numpy().reshape(-1, 2, 4, 4)
        cost, back = np.array([0.0, np.inf, np.inf, np.inf]), []
        for m, ranks in costs:
            ways = cost[:, None] + m
            cost = ways.min(axis=0)
            back.append(np.where(ways == cost, ranks, 4.0).argmin(axis=0))
        states = [int(cost.argmin())]
        for b in reversed(back):
            states.append(int(b[states[-1]]))
        states.reverse()
        pairs, n = np.array(states), len(run)
        return pa.record_batch({"part": run.column("part").combine_chunks(), "chunk": run.column("chunk").combine_chunks(), "pair": pa.array(4 * pairs[:-1] + pairs[1:], pa.int32()), "last": pa.array(np.arange(n) == n - 1)})

    held: list[pa.Table] = []
    for batch in batches:
        if not len(batch):
            continue
        rows, before = pa.Table.from_batches([batch]), [held[-1].slice(len(held[-1]) - 1)] if held else []
        cuts = [c - len(before) for c in _changes(pa.concat_tables([*before, rows]).column("conv"))]
        for a, b in pairwise([0, *cuts, len(rows)]):
            if a in cuts[:1] or a > 0:
                yield each(pa.concat_tables(held))
                held = []
            if b > a:
                held.append(rows.slice(a, b - a))
    if held:
        yield each(pa.concat_tables(held))


def _by_move(values: list, at: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), at)


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """One row per turn: ``conv``, ``turn``, ``role``, ``action``, ``new_role``, ``cost`` and its ``rendered`` piece."""
    known = F.trim(F.lower(F.col(role)))
    code = F.coalesce(F.when(known == "system", 1).when(known == "user", 2).when(known == "assistant", 3), F.lit(0))
    rows = turns.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"), code.alias("code"), F.col(text).cast("string").alias("text"))
    # A short text is its own prefix, so rows told apart by the random number alone are equal; longer texts follow.
    rows = rows.withColumn("salt", F.when(F.char_length("text") > PREFIX, 2.0).otherwise(F.rand(5)))
    place = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.substring("text", 1, PREFIX).asc_nulls_first(), F.col("salt").asc()]
    kind = rows.schema["conv"].dataType.simpleString()
    placed = rows.repartitionByRange(*place).sortWithinPartitions(*place, F.col("text").asc_nulls_first()).drop("salt")
    placed = placed.mapInArrow(
        _placed(chunk), f"conv {kind}, turn long, role string, code int, text string, part long, chunk long, before long, state long, end boolean, costs array<double>"
    )
    placed = materialize(placed, "chat-rows", compression="zstd")
    matrices = placed.filter(F.col("costs").isNotNull()).select("conv", "part", "chunk", "costs")
    ends = matrices.repartition("conv").sortWithinPartitions(F.col("conv").asc_nulls_first(), "part", "chunk").mapInArrow(_ends, "part long, chunk long, pair int, last boolean")
    ends = materialize(ends, "chat-ends")
    full = placed.drop("costs").join(broadcast_if_small(ends, BROADCAST_ROWS), ["part", "chunk"], "left").withColumn("pair", F.coalesce("pair", F.lit(0)) * 2)

    def state(c: str) -> Column:
        return F.call_function("shiftright", F.col(c), F.col("pair")).bitwiseAND(F.lit(3)).cast("int")

    full = full.select("*", state("before").alias("s"), state("state").alias("o")).withColumn("move", F.col("s") * 4 + F.col("o"))
    moves = [MOVES.get((s, o), ("", 0)) for s in range(4) for o in range(4)]
    heads = [
        "\n" if action == "merge" else CLOSE * (i > 3) + (OPEN.format(STATES[x]) + CLOSE) * (action == "insert") + OPEN.format(STATES[i % 4]) for i, (action, x) in enumerate(moves)
    ]
    action, kept = _by_move([action for action, _ in moves], F.col("move")), F.col("code") == F.col("o")
    closed = F.col("end") & F.coalesce("last", F.lit(True))
    return full.select(
        F.col("conv").alias(conv), F.col("turn").alias(turn), F.col("role").alias(role),
        F.when(kept, action).when(action == "keep", "relabel").otherwise(F.concat(F.lit("relabel+"), action)).alias("action"),
        _by_move(list(STATES), F.col("o")).alias("new_role"),
        (_by_move(MOVE_COST.ravel().tolist(), F.col("move")) + F.when(kept, 0.0).otherwise(RELABEL)).alias("cost"),
        F.concat(_by_move(heads, F.col("move")), F.coalesce("text", F.lit("")), F.when(closed, CLOSE).otherwise("")).alias("rendered"),
    )


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
