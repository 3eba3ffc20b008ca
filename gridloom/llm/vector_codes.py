"""Compression of vectors to codes of one byte a part: a dual-tree form of Lloyd's iterations, in whole numbers.

Components become ``floor(scale * x)``, and a vector is cut into ``parts`` equal
consecutive parts. Each part position has a codebook that starts as that part of the vectors with the
smallest ids and is moved to the floors of means for some rounds.

Vectors are dealt once by ranges of a key that is alike for vectors that lie together, and stored in
blocks. A block keeps a balanced tree of boxes over its vectors for each part position, with the sum of each node's parts; blocks are read
in each round and never shuffled. A round builds a tree over the entries of each position and descends both: an entry node goes if
it is farther from a node of parts than another one can be at most, and an entry if another one is nearer everywhere
in the box. A node with one entry left is assigned whole, by its stored sum. Parts in leaves with several entries left are
compared with those in whole numbers. Each task gives a sum for each entry and component, so what is shuffled and
what the driver collects are ``parts * entries`` sums of a part, whatever the table's size.

Vectors that are null, empty or hold null or non-finite components are dropped, and so are those of
another length than the vector of the smallest id. Lengths that are no multiple of ``parts`` are filled with zeros.
Ids order with nulls last; vectors with the same id order by their components. With fewer vectors than
``entries`` there are fewer entries. Components beyond ``largest(length)`` (over 134 million for 64 of them) stay there,
so that squared distances fit 64 bits. Repeated rows are coded alike, an empty table gives no rows,
and ``keep`` may hold columns of any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from gridloom.operators.tables import broadcast_if_small, discard, materialize

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
BLOCK, LEAF = 4096, 64
#: Entries of each position that the key of a vector tells between.
KEY_ENTRIES = 16
BROADCAST_GROUPS = 200_000


def largest(length: int) -> int:
    """The largest component whose squared distances in vectors of this length fit 64 bits with room for a sum of two."""
    return isqrt((1 << 62) // max(1, length)) // 2


class Boxes:
    """A balanced tree: node ``i`` of level ``l`` has the points ``order[n * i >> l : n * (i + 1) >> l]``."""

    def __init__(self, order: np.ndarray, low: list[np.ndarray], high: list[np.ndarray], total: list[np.ndarray]):
        self.order, self.low, self.high, self.total = order, low, high, total
        self.levels = len(low) - 1

    @staticmethod
    def over(points: np.ndarray, leaf: int) -> Boxes:
        """Splits each node at the median of its widest side, down to nodes of ``leaf`` to ``2 * leaf`` points."""
        n = len(points)
        levels = max(0, (n // leaf).bit_length() - 1)
        order = np.arange(n)
        for level in range(levels):
            for i in range(1 << level):
                a, middle, b = n * i >> level, n * (2 * i + 1) >> (level + 1), n * (i + 1) >> level
                own = order[a:b]
                x = points[own]
                axis = np.argmax(x.max(axis=0) - x.min(axis=0))
                order[a:b] = own[np.argpartition(x[:, axis], middle - a)]
        sorted_points, starts = points[order], Boxes.starts(n, levels)[:-1]
        low, high, total = ([f.reduceat(sorted_points, starts)] for f in (np.minimum, np.maximum, np.add))
        for _ in range(levels):
            low.insert(0, np.minimum(low[0][::2], low[0][1::2]))
            high.insert(0, np.maximum(high[0][::2], high[0][1::2]))
            total.insert(0, total[0][::2] + total[0][1::2])
        return Boxes(order, low, high, total)

    @staticmethod
    def starts(n: int, level: int) -> np.ndarray:
        """Where the nodes of a level begin, and the end."""
        return n * np.arange((1 << level) + 1) >> level

    def store(self) -> list[bytes]:
        return [self.order.astype("<i4").tobytes(), np.concatenate(self.low + self.high).astype("<i4").tobytes(), np.concatenate(self.total).astype("<i8").tobytes()]

    @staticmethod
    def load(order: bytes, boxes: bytes, total: bytes, width: int) -> Boxes:
        both, sums = np.frombuffer(boxes, "<i4").astype(np.int64).reshape(2, -1, width), np.frombuffer(total, "<i8").reshape(-1, width)
        cuts = [(1 << level) - 1 for level in range(1, len(sums).bit_length())]
        return Boxes(np.frombuffer(order, "<i4").astype(np.int64), np.split(both[0], cuts), np.split(both[1], cuts), np.split(sums, cuts))


def _pruned(q: np.ndarray, near: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Which pairs stay: those with a least distance no more than the smallest greatest distance of the same ``q``, which is sorted."""
    first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
    best = np.minimum.reduceat(most, first)
    return near <= np.repeat(best, np.diff(np.r_[first, len(q)]))


def _apart(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances less each point's square, in whole numbers; doubles hold them exactly where no sum reaches 2**53."""
    top = int(max(np.abs(points).max(), np.abs(entries).max()))
    if 3 * top * top * entries.shape[1] < 1 << 53:
        points, entries = points.astype(float), entries.astype(float)
        return (entries * entries).sum(axis=1) - 2 * (points @ entries.T)
    apart = points[:, None] - entries
    return (apart * apart).sum(axis=2)


def assign(points: np.ndarray, tree: Boxes, entries: np.ndarray) -> tuple[list[tuple[int, np.ndarray, np.ndarray]], list[tuple[int, np.ndarray]]]:
    """Nodes assigned whole as ``(level, nodes, entries)`` and ``(first place, entries)`` of the points compared one by one. ``points`` are in the tree's order."""
    found = Boxes.over(entries, 1)
    whole, single = [], []
    q, r, level, depth = np.zeros(1, np.int64), np.zeros(1, np.int64), 0, 0
    low, high, names = found.low[0], found.high[0], None
    while len(q):
        lq, hq, lr, hr = tree.low[level][q], tree.high[level][q], low[r], high[r]
        gap = np.maximum(np.maximum(lr - hq, lq - hr), 0)
        far = np.maximum(hr - lq, hq - lr)
        most = (far * far).sum(axis=1)
        keep = _pruned(q, (gap * gap).sum(axis=1), most)
        q, r, most = q[keep], r[keep], most[keep]
        if names is None:
            # Two levels of entries for one of parts, so that large nodes may be assigned.
            for _ in range(2):
                if depth < found.levels:
                    q, r, depth = np.repeat(q, 2), np.column_stack([2 * r, 2 * r + 1]).ravel(), depth + 1
            low, high = found.low[depth], found.high[depth]
            if depth == found.levels:
                starts = Boxes.starts(len(entries), depth)
                n = np.diff(starts)[r]
                names = found.order
                r = names[np.repeat(starts[r] - np.cumsum(n) + n, n) + np.arange(n.sum())]
                q = np.repeat(q, n)
                order = np.lexsort((r, q))
                q, r, low, high = q[order], r[order], entries, entries
                continue
        else:
            # Against the entry with the smallest greatest distance: how much farther that one is, at most, in the box.
            first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
            sizes = np.diff(np.r_[first, len(q)])
            order = np.lexsort((r, most, q))
            ref = np.repeat(r[order[first]], sizes)
            a, b = entries[ref], entries[r]
            worst = (a * a - b * b + 2 * (b - a) * np.where(b > a, tree.high[level][q], tree.low[level][q])).sum(axis=1)
            keep = (r == ref) | (worst > 0) | ((worst == 0) & (r < ref))
            q, r = q[keep], r[keep]
            first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
            sizes = np.diff(np.r_[first, len(q)])
            alone = first[sizes == 1]
            if len(alone):
                whole.append((level, q[alone], r[alone]))
                keep = np.repeat(sizes > 1, sizes)
                q, r = q[keep], r[keep]
        if level < tree.levels:
            q, r, level = np.r_[2 * q, 2 * q + 1], np.r_[r, r], level + 1
            order = np.argsort(q, kind="stable")
            q, r = q[order], r[order]
        elif names is not None:
            break
    if len(q):
        starts = Boxes.starts(len(points), tree.levels)
        first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        for node, some in zip(q[first].tolist(), np.split(r, first[1:]), strict=True):
            single.append((int(starts[node]), some[_apart(points[starts[node] : starts[node + 1]], entries[some]).argmin(axis=1)]))
    return whole, single


def sums(points: np.ndarray, tree: Boxes, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers and sums of the points nearest to each entry."""
    n, total = np.zeros(len(entries), np.int64), np.zeros(entries.shape, np.int64)
    whole, single = assign(points, tree, entries)
    for level, nodes, names in whole:
        np.add.at(n, names, np.diff(Boxes.starts(len(points), level))[nodes])
        np.add.at(total, names, tree.total[level][nodes])
    for start, names in single:
        np.add.at(n, names, 1)
        np.add.at(total, names, points[start : start + len(names)])
    return n, total


def nearest(points: np.ndarray, tree: Boxes, entries: np.ndarray) -> np.ndarray:
    """Each point's entry, in the tree's order."""
    out = np.empty(len(points), np.int64)
    whole, single = assign(points, tree, entries)
    for level, nodes, names in whole:
        starts = Boxes.starts(len(points), level)
        sizes = np.diff(starts)[nodes]
        out[np.repeat(starts[nodes] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())] = np.repeat(names, sizes)
    for start, names in single:
        out[start : start + len(names)] = names
    return out


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.int64)


def _keyed(books: np.ndarray):
    """Rows with a key of the last column, vectors: for each position the nearest of its first entries."""
    parts, _, width = books.shape
    some = books[:, :KEY_ENTRIES].astype(float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _matrix(batch.column(batch.num_columns - 1), parts * width).astype(float)
            key = np.zeros(len(rows), np.int64)
            for p in range(parts):
                x = rows[:, p * width : (p + 1) * width]
                key = key * KEY_ENTRIES % (1 << 56) + ((some[p] ** 2).sum(axis=1) - 2 * x @ some[p].T).argmin(axis=1) if len(x) else key
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(key)], [*batch.schema.names, "__key"])

    return run


def _blocked(parts: int, width: int, block: int):
    """Columns to keep and vectors, in order, as rows of ``block`` vectors with a tree for each position."""

    def made(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        columns = [c.chunk(0) for c in table.columns]
        ends = pa.array([0, len(table)], pa.int32())
        points = _matrix(columns[-1], parts * width)
        trees = [Boxes.over(points[:, p * width : (p + 1) * width], LEAF).store() for p in range(parts)]
        lists = [pa.ListArray.from_arrays(ends, c) for c in columns[:-1]]
        stored = [pa.array([b"".join(t[k] for t in trees)], pa.binary()) for k in range(3)]
        return pa.RecordBatch.from_arrays([*lists, pa.array([len(table)]), pa.array([points.astype("<i4").tobytes()], pa.binary()), *stored], [*table.schema.names[:-1], "__size", "__points", "__order", "__boxes", "__total"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            while len(batch):
                take = batch.slice(0, block - sum(map(len, held)))
                held.append(take)
                batch = batch.slice(len(take))
                if sum(map(len, held)) == block:
                    yield made(pa.Table.from_batches(held))
                    held = []
        if held:
            yield made(pa.Table.from_batches(held))

    return run


def _trees(batch: pa.RecordBatch, row: int, parts: int, width: int) -> Iterator[tuple[np.ndarray, Boxes]]:
    """The points of each position in the order of their tree, and the tree."""
    size = batch.column("__size")[row].as_py()
    points = np.frombuffer(batch.column("__points")[row].as_buffer(), "<i4").astype(np.int64).reshape(size, parts, width)
    stored = [memoryview(batch.column(c)[row].as_buffer()) for c in ("__order", "__boxes", "__total")]
    for p in range(parts):
        tree = Boxes.load(*[s[len(s) // parts * p : len(s) // parts * (p + 1)] for s in stored], width)
        yield points[tree.order, p], tree


def _sums(books: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, entries, width = books.shape
        n, total = np.zeros((parts, entries), np.int64), np.zeros(books.shape, np.int64)
        for batch in batches:
            for row in range(len(batch)):
                for p, (points, tree) in enumerate(_trees(batch, row, parts, width)):
                    some, added = sums(points, tree, books[p])
                    n[p] += some
                    total[p] += added
        p, e = np.nonzero(n)
        axes = np.arange(width)
        yield pa.record_batch({
            "part": np.repeat(p, width).astype(np.int32), "entry": np.repeat(e, width).astype(np.int32), "axis": np.tile(axes, len(p)).astype(np.int32),
            "total": total[p, e].ravel(), "n": np.repeat(n[p, e], width),
        })

    return run


def _coded(books: np.ndarray, kept: int):
    parts, _, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                size = batch.column("__size")[row].as_py()
                codes, error = np.empty((size, parts), np.uint8), np.zeros(size, np.int64)
                for p, (points, tree) in enumerate(_trees(batch, row, parts, width)):
                    found = nearest(points, tree, books[p])
                    codes[tree.order, p] = found
                    apart = points - books[p][found]
                    error[tree.order] += (apart * apart).sum(axis=1)
                text = codes.tobytes().hex()
                columns = [batch.column(k).slice(row, 1).flatten() for k in range(kept)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([text[i : i + 2 * parts] for i in range(0, len(text), 2 * parts)], pa.string()), pa.array(error)], [*batch.schema.names[:kept], "code", "error"])

    return run


def whole_numbers(vector: Column, scale: int, limit: int) -> Column:
    return F.transform(vector, lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(float(limit))), F.lit(-float(limit)))))


def compress(vectors: DataFrame, keep: list[str], id_col: str = "vec_id", vector: str = "embedding", scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, block: int = BLOCK) -> tuple[DataFrame, np.ndarray]:
    """``keep`` of every usable row with its ``code`` (two hex digits a part) and ``error`` (squared distances summed over
    parts), as a stored table, and the final codebooks: an array of part, entry and component."""
    if entries > 256:
        raise ValueError("a code has one byte a part: 256 entries at most")
    v = F.col(f"`{vector}`")
    own = [f"__k{i}" for i in range(len(keep))]
    usable = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.filter(usable).select(*[F.col(f"`{c}`").alias(k) for c, k in zip(keep, own, strict=True)], F.col(f"`{id_col}`").alias("__id"), v.alias("__v"))
    first = F.col("__id").asc_nulls_last()
    head = rows.orderBy(first, "__v").select(F.size("__v").alias("n")).head()
    length = head.n if head else parts
    filled = -(-length // parts) * parts
    numbers = whole_numbers(F.col("__v"), scale, largest(filled))
    if filled > length:
        numbers = F.concat(numbers, F.array_repeat(F.lit(0).cast("long"), filled - length))
    rows = rows.filter(F.size("__v") == length).withColumn("__v", numbers)
    start = [r.v for r in rows.orderBy(first, "__v").limit(entries).select(F.col("__v").alias("v")).collect()]
    width = filled // parts
    books = np.array(start, np.int64).reshape(len(start), parts, width).swapaxes(0, 1)
    schema = StructType([f for f in rows.schema.fields if f.name in own])
    if not start:
        empty = rows.limit(0).select(*[F.col(k).alias(c) for c, k in zip(keep, own, strict=True)], F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
        return empty, books
    rows = rows.withColumn("__row", F.monotonically_increasing_id()).select(*own, "__row", "__v")
    keyed = rows.mapInArrow(_keyed(books), StructType([*rows.schema.fields]).add("__key", "long"))
    dealt = keyed.repartitionByRange("__key", "__row").sortWithinPartitions("__key", "__row").select(*own, "__v")
    stored = StructType()
    for f in schema.fields:
        stored = stored.add(f.name, ArrayType(f.dataType))
    for name, kind in (("__size", "long"), ("__points", "binary"), ("__order", "binary"), ("__boxes", "binary"), ("__total", "binary")):
        stored = stored.add(name, kind)
    blocks = materialize(dealt.mapInArrow(_blocked(parts, width, block), stored), "vector-blocks", **{"parquet.block.size": str(16 << 20)})
    for _ in range(rounds):
        given = blocks.mapInArrow(_sums(books), "part int, entry int, axis int, total long, n long")
        given = given.groupBy("part", "entry", "axis").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum(F.col("n").cast("decimal(38,0)")).alias("n"))
        books = books.copy()
        for r in given.collect():
            books[r.part, r.entry, r.axis] = int(r.total) // int(r.n)
    out = materialize(blocks.mapInArrow(_coded(books, len(keep)), schema.add("code", "string").add("error", "long")), "vector-coded")
    discard(blocks)
    return out.select(*[F.col(k).alias(c) for c, k in zip(keep, own, strict=True)], "code", "error"), books


def with_group_error(codes: DataFrame, group: str, name: str) -> DataFrame:
    """``codes`` with the sum of ``error`` over rows of an equal ``group``, nulls together; null beyond 64 bits."""
    totals = codes.groupBy(F.col(group).alias("__g")).agg(F.try_sum("error").alias(name))
    return codes.join(broadcast_if_small(totals, BROADCAST_GROUPS), F.col(group).eqNullSafe(F.col("__g"))).drop("__g")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), ["vec_id", "label"])
    listed = F.sha2(F.lit(",".join(map(str, books.ravel().tolist()))), 256)
    return with_group_error(codes, "label", "label_error").select("vec_id", "code", "error", "label_error", listed.alias("codebooks_sha256"))


def _round_sql(i: int) -> str:
    """Parts assigned to entries ``e{i}``, and the entries after it."""
    return f"""
a{i} AS MATERIALIZED (
  SELECT pos, uid, min(struct_pack(d := pp + ee - 2 * list_dot_product(part, entry), k := k)) AS best FROM p JOIN e{i} USING (pos) GROUP BY pos, uid),
m{i} AS (
  SELECT pos, k, list(mean ORDER BY j) AS mean FROM (
    SELECT pos, best.k AS k, j, floor(sum(part[j]) / count(*)) AS mean FROM a{i} JOIN p USING (pos, uid), range(1, 4097) t(j) WHERE j <= len(part) GROUP BY ALL)
  GROUP BY pos, k),
e{i + 1} AS MATERIALIZED (
  SELECT pos, k, coalesce(mean, entry) AS entry, list_dot_product(coalesce(mean, entry), coalesce(mean, entry)) AS ee FROM e{i} LEFT JOIN m{i} USING (pos, k)),"""


OP11_SQL = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) - 1 AS uid, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS x
  FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (
  SELECT uid, pos, part, list_dot_product(part, part) AS pp FROM (
    SELECT uid, pos, x[pos * len(x) // 4 + 1 : (pos + 1) * len(x) // 4] AS part FROM v, range(4) t(pos))),
e0 AS MATERIALIZED (SELECT pos, uid AS k, part AS entry, pp AS ee FROM p WHERE uid < 256),
{"".join(_round_sql(i) for i in range(ROUNDS))}
a AS MATERIALIZED (
  SELECT pos, uid, min(struct_pack(d := pp + ee - 2 * list_dot_product(part, entry), k := k)) AS best FROM p JOIN e{ROUNDS} USING (pos) GROUP BY pos, uid),
c AS (
  SELECT uid, string_agg(printf('%02x', best.k), '' ORDER BY pos) AS code, sum(best.d)::BIGINT AS error FROM a GROUP BY uid),
h AS (
  SELECT sha256(string_agg(n::BIGINT::VARCHAR, ',' ORDER BY pos, k, j)) AS codebooks_sha256 FROM (
    SELECT pos, k, unnest(entry) AS n, generate_subscripts(entry, 1) AS j FROM e{ROUNDS}))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM c JOIN v USING (uid), h
"""
