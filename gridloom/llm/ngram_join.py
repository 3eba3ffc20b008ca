"""Exact set-similarity join of documents on word shingles, and its components.

Two documents link when ``|A & B| * 100 >= percent * |A | B|``. Two such sets share a
token among the first ``n - ceil(n * percent / 100) + 1`` of each, under any order of all
tokens, so several orders filter one after the other and a pair must pass all of them
before its sets are compared:

* Every order hashes the tokens anew and puts the rarest in front: tokens of one document
  alone link nothing and use up the prefix. The first order ranks only the lowest part of
  the hashes by rarity (all others follow by hash), so only tokens of that region are moved.
  The next orders rank all tokens, by how many of the documents left have them.
* A document without a shared prefix token leaves. Under the first order that holds for
  most, so the other orders and the full sets are made for the remaining ones only. A pair
  shares at most what both have besides tokens of their own, which bounds it again.
* Equal sets are one node. In each token's list all nodes are compared with its smallest
  node (its centre) and not with each other, which is linear. Where a list then still
  holds several components, its nodes are compared with the centres of the others; and
  since ``1 - Jaccard`` is a metric, a node links into another star only if it is within
  twice the distance of that star's centre, so just those pairs are left to compare.

Null and empty texts have no tokens and link with nothing. Nodes have numbers of their own, so
rows with the same id, or none, are each compared by their text. A component is named by
its smallest id that is not null, or null where it has none. Columns other than the id and the
text are ignored by ``components`` and stay in ``without_copies``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.decontamination import text_digest
from gridloom.llm.words import chunks, hashes, mix, spans
from gridloom.operators.graph import connected_components
from gridloom.operators.tables import broadcast_if_small, discard, materialize, numbered

WIDTH, PERCENT = 5, 80
ORDERS = 3
BROADCAST_IDS = 500_000


def region(percent: int) -> float:
    """The part of all hashes that the first order puts first: half as much again as a prefix needs."""
    return min(1.0, 1.5 * (1 - percent / 100))


def shingles(words: np.ndarray, first: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; of fewer words, the whole as one."""
    step = np.uint64(0xC2B2AE3D27D4EB4F)
    joined = words.copy()
    for j in range(1, width):
        joined = mix(joined[: len(words) - j] * step + words[j:])
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            yield np.unique(joined[a : b - width + 1])
        elif b > a:
            short = words[a : a + 1] ^ np.uint64(b - a)
            for w in words[a + 1 : b]:
                short = mix(short * step + w)
            yield short
        else:
            yield words[:0]


def _sets(width: int, percent: int, full: bool, names: list[str]):
    """Rows of columns ``names`` and a text, with sizes, digests and tokens of their sets instead of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = np.uint64(min((1 << 64) - 1, int(region(percent) * (1 << 64))))
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column(len(names))):
                starts, ends, first = spans(data, offsets)
                n, d1, d2, u, tokens = [], [], [], [], []
                for s in shingles(hashes(data, starts, ends), first, width):
                    n.append(len(s))
                    d1.append(int(s.sum(dtype=np.uint64)))
                    d2.append(int(mix(s.copy()).sum(dtype=np.uint64)))
                    u.append(int(np.searchsorted(s, low)))
                    prefix = len(s) - -(-percent * len(s) // 100) + 1 if len(s) else 0
                    tokens.append(s if full else s[: max(u[-1], prefix)])
                at = np.r_[0, np.cumsum([len(t) for t in tokens])].astype(np.int32)
                yield pa.record_batch({
                    **{c: batch.column(i).slice(lo, hi - lo) for i, c in enumerate(names)}, "n": pa.array(n, pa.int64()), "d1": pa.array(np.array(d1, np.uint64).view(np.int64)), "d2": pa.array(np.array(d2, np.uint64).view(np.int64)),
                    "u": pa.array(u, pa.int32()), "tokens": pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(tokens).view(np.int64))),
                })

    return run


def _prefixes(rows: DataFrame, percent: int) -> DataFrame:
    """``(doc, n, free, token)`` of prefix tokens that two documents or more have in theirs.

    ``rows``: (doc, n, u, tokens) with the tokens of the prefix region in hash order, the
    first ``u`` of them in the part that goes by rarity. ``free`` is ``n`` less the tokens
    that no other document has, as far as they were counted.
    """
    posts = rows.select("doc", F.posexplode("tokens").alias("pos", "token"), "u").select("doc", "token", (F.col("pos") < F.col("u")).alias("low"))
    shared = posts.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
    posts = posts.join(shared, "token").join(rows.select("doc", "n", "u"), "doc")
    mine = Window.partitionBy("doc")
    posts = posts.withColumn("unique", F.col("u") - F.sum(F.col("low").cast("int")).over(mine))
    posts = posts.withColumn("rank", F.row_number().over(mine.orderBy(~F.col("low"), F.when(F.col("low"), F.col("df")), "token")))
    prefix = F.expr(f"n - ({percent} * n + 99) div 100 + 1")
    posts = posts.filter(~F.col("low") | (F.col("rank") <= prefix - F.col("unique"))).select("doc", "n", (F.col("n") - F.col("unique")).alias("free"), "token")
    posts = materialize(posts, "join-prefix")
    lists = materialize(posts.join(posts.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1").select("token"), "token"), "join-lists")
    discard(posts)
    return lists


def _compare(pairs: DataFrame, sets: DataFrame, filtered: bool, first: bool = False) -> DataFrame:
    """``(a, b, common, together)`` of ``pairs (a, b)``; ``filtered``: only of those that pass every order, ``first``: before their sets are fetched."""

    def joined(pairs: DataFrame, columns: list[str]) -> DataFrame:
        side = lambda x: sets.select(F.col("doc").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in columns])
        return pairs.join(side("a"), "a").join(side("b"), "b")

    prefixes = [c for c in sets.columns if c.startswith("prefix")] if filtered else []
    if first:
        light = joined(pairs, prefixes)
        for c in prefixes:
            light = light.filter(F.arrays_overlap(f"a_{c}", f"b_{c}"))
        pairs, prefixes = light.select("a", "b"), []
    both = joined(pairs, ["n", "tokens", *prefixes])
    for c in prefixes:
        both = both.filter(F.arrays_overlap(f"a_{c}", f"b_{c}"))
    both = both.select("a", "b", (F.col("a_n") + F.col("b_n")).alias("sizes"), F.size(F.array_intersect("a_tokens", "b_tokens")).cast("long").alias("common"))
    return both.select("a", "b", "common", (F.col("sizes") - F.col("common")).alias("together"))


def _at_least(percent: int):
    return F.col("common") * 100 >= F.col("together") * percent


def _fits(percent: int):
    """Whether sizes, and what each shares with anyone, allow documents (n, free) and (m, open) to link."""
    enough = F.least("free", "open") * (100 + percent) >= (F.col("n") + F.col("m")) * percent
    return (F.least("n", "m") * 100 >= F.greatest("n", "m") * percent) & enough


def _links(lists: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Edges ``(a, b)`` that connect all linked nodes; ``lists``: (token, doc, n, free)."""
    fits = _fits(percent)
    best = F.min(F.struct((F.col("n") - F.col("free")).alias("own"), "doc", "n", "free"))
    centres = lists.groupBy("token").agg(best.alias("c")).select("token", F.col("c.doc").alias("a"), F.col("c.n").alias("m"), F.col("c.free").alias("open"))
    pairs = lists.join(centres, (lists["token"] == centres["token"]) & (F.col("a") != F.col("doc")) & fits).select("a", F.col("doc").alias("b")).distinct()
    links = materialize(_compare(pairs, sets, True).filter(_at_least(percent)).select("a", "b"), "join-links")
    stars = links.groupBy(F.col("b").alias("doc")).agg(F.min("a").alias("pivot"))

    def placed(found: DataFrame) -> DataFrame:
        parts = connected_components(found, "a", "b")
        mixed = lists.join(parts, lists["doc"] == parts["node"], "left").withColumn("single", F.col("component").isNull())
        mixed = mixed.withColumn("part", F.coalesce("component", "doc")).drop("node", "component")
        mixed = mixed.join(mixed.groupBy("token").agg(F.min("part").alias("p"), F.max("part").alias("q")).filter("p < q").select("token"), "token")
        return materialize(mixed.join(stars, "doc", "left").withColumn("pivot", F.coalesce("pivot", "doc")), "join-mixed")

    mixed = placed(links)
    if mixed.isEmpty():
        return links
    # Documents without a link meet each other once, in their first common list. Stars meet
    # all documents of other components, by their centres.
    mine = mixed.join(lists.groupBy("doc").agg(F.collect_set("token").alias("tokens")), "doc")
    others = mine.select(
        F.col("token").alias("t"), F.col("pivot").alias("q"), F.col("part").alias("other"), F.col("n").alias("m"), F.col("free").alias("open"), F.col("single").alias("alone"),
        F.when(F.col("single"), F.col("tokens")).alias("theirs"),
    ).distinct()
    apart = (F.col("token") == F.col("t")) & (F.col("part") != F.col("other"))
    once = F.col("single") & (F.col("doc") < F.col("q")) & (F.col("token") == F.array_min(F.array_intersect("tokens", "theirs")))
    pairs = mine.join(others, apart & (F.col("doc") != F.col("q")) & fits & (~F.col("alone") | once)).select(F.col("doc").alias("a"), F.col("q").alias("b"), "alone").distinct()
    pairs = materialize(pairs, "join-pairs")
    # Of documents without a link only pairs that link count; a star's members may lie beyond its centre.
    near = _compare(pairs.filter("alone").select("a", "b"), sets, True, first=True).filter(_at_least(percent))
    near = near.unionByName(_compare(pairs.filter("not alone").select("a", "b"), sets, False).filter(_at_least(max(0, 2 * percent - 100))))
    near = materialize(near, "join-near")
    links = materialize(links.unionByName(near.filter(_at_least(percent)).select("a", "b")), "join-links")
    shell = near.filter(~_at_least(percent)).select(F.col("a").alias("doc"), F.col("b").alias("q"))
    if shell.isEmpty():
        return links
    mixed = placed(links).join(lists.groupBy("doc").agg(F.collect_set("token").alias("tokens")), "doc")
    mine = mixed.select("token", "doc", "n", "free", "part", "tokens").join(shell, "doc").withColumnRenamed("q", "near")
    theirs = mixed.filter(~F.col("single")).select(
        F.col("token").alias("t"), F.col("doc").alias("b"), F.col("n").alias("m"), F.col("free").alias("open"), F.col("pivot").alias("q"), F.col("part").alias("other"), F.col("tokens").alias("theirs")
    )
    once = F.col("token") == F.array_min(F.array_intersect("tokens", "theirs"))
    pairs = mine.join(theirs, apart & (F.col("near") == F.col("q")) & fits & once)
    pairs = pairs.select(F.least("doc", "b").alias("a"), F.greatest("doc", "b").alias("b")).distinct()
    return materialize(links.unionByName(_compare(pairs, sets, True).filter(_at_least(percent)).select("a", "b")), "join-links")


DIGEST = ["n", "d1", "d2"]


def _placed(docs: DataFrame, id_col: str, text: str, width: int, percent: int) -> DataFrame:
    """``(doc, t1, t2, n, component, first)`` of every row: digests of its text, its set's size, its component's number and smallest id."""
    texts = docs.select(F.col(id_col).alias("doc"), *text_digest(F.col(text)), F.col(text).cast("string").alias("text"))
    kind = texts.schema["doc"].dataType.simpleString()
    made = "n long, d1 long, d2 long, u int, tokens array<bigint>"
    prefixed = materialize(texts.mapInArrow(_sets(width, percent, False, ["doc", "t1", "t2"]), f"doc {kind}, t1 long, t2 long, {made}"), "join-sets")
    # Equal sets have equal prefixes; of the rows that have them one is read again for the whole set.
    nodes = prefixed.filter("n > 0").groupBy(*DIGEST).agg(F.min("doc").alias("first"), F.min(F.struct("doc", "t1", "t2")).alias("row"), F.first("u").alias("u"), F.first("tokens").alias("tokens"))
    whole = numbered(nodes, "join-nodes", "node")
    nodes, rows = materialize(whole.drop("u", "tokens"), "join-nodes"), materialize(prefixed.drop("u", "tokens"), "join-rows")
    discard(prefixed)
    lists = _prefixes(whole.select(F.col("node").alias("doc"), "n", "u", "tokens"), percent)
    left = materialize(lists.select(F.col("doc").alias("node")).distinct(), "join-left")
    discard(whole, lists)
    if left.isEmpty():
        links = left.select(F.col("node").alias("a"), F.col("node").alias("b"))
    else:
        wanted = broadcast_if_small(left.join(nodes, "node").select("node", F.col("row.doc").alias("of"), F.col("row.t1").alias("r1"), F.col("row.t2").alias("r2")), BROADCAST_IDS)
        found = texts.join(wanted, F.col("doc").eqNullSafe(F.col("of")) & (F.col("t1") == F.col("r1")) & (F.col("t2") == F.col("r2")))
        found = found.select(F.col("node").alias("doc"), "text").mapInArrow(_sets(width, percent, True, ["doc"]), f"doc long, {made}")
        kept = materialize(found.dropDuplicates(["doc"]).select("doc", "n", "tokens"), "join-full")
        lists = None
        for order in range(1, ORDERS):
            again = F.lit(order)
            hashed = F.array_sort(F.transform("tokens", lambda t: F.xxhash64(t, again)))  # noqa: B023
            before = [kept] if lists is None else [kept, lists]
            lists = _prefixes(kept.select("doc", "n", F.col("n").cast("int").alias("u"), hashed.alias("tokens")), percent)
            prefix = lists.groupBy("doc").agg(F.collect_set("token").alias(f"prefix{order}"))
            kept = materialize(kept.join(prefix, "doc"), "join-kept")
            discard(*before)
        links = _links(lists, kept, percent)
        discard(lists, kept)
    parts = connected_components(links, "a", "b")
    nodes = materialize(nodes.select("node", *DIGEST, "first").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node")), "join-nodes")
    nodes = nodes.join(nodes.groupBy("component").agg(F.min("first").alias("smallest")), "component").select(*DIGEST, "component", F.col("smallest").alias("first"))
    return rows.join(nodes, DIGEST, "left").select("doc", "t1", "t2", "n", "component", "first")


def components(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``(id, n_shingles, component_id)`` of every row: the smallest id reachable by links, its own included."""
    placed = _placed(docs, id_col, text, width, percent)
    return placed.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("first")).otherwise(F.col("doc")).alias("component_id"))


def without_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row of each component of ``docs``, with all its columns: that with the smallest id; null ids come last.

    Of rows equal in id and text, that with the smallest hash of all its columns stays. Rows
    without tokens stay all.
    """
    placed = materialize(_placed(docs, id_col, text, width, percent).filter("n > 0"), "join-placed")
    row = [F.col("doc").isNull().alias("unnamed"), F.col("doc"), F.col("t1"), F.col("t2")]
    counts = placed.groupBy("component", *row).agg(F.count("*").alias("rows"))
    counts = materialize(counts.select("component", F.struct("unnamed", "doc", "t1", "t2").alias("row"), "rows"), "join-counts")
    kept = counts.groupBy("component").agg(F.min("row").alias("kept"))
    marked = materialize(counts.join(kept, "component").select("row.doc", "row.t1", "row.t2", "rows", (F.col("row") == F.col("kept")).alias("stays")).filter("not stays or rows > 1"), "join-marked")
    whole = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col(id_col).alias("doc"), *text_digest(F.col(text)))

    def same(marks: DataFrame) -> tuple[DataFrame, Column]:
        marks = broadcast_if_small(marks.select(F.col("doc").alias("of"), F.col("t1").alias("r1"), F.col("t2").alias("r2")), BROADCAST_IDS)
        return marks, F.col("doc").eqNullSafe(F.col("of")) & (F.col("t1") == F.col("r1")) & (F.col("t2") == F.col("r2"))

    single = whole.join(*same(marked), "left_anti").select("row.*")
    repeated = marked.filter("stays")
    if repeated.isEmpty():
        return single
    once = whole.join(*same(repeated), "left_semi").groupBy("doc", "t1", "t2").agg(F.min_by("row", F.struct(F.xxhash64(F.to_json("row")), F.xxhash64(F.lit("second"), F.to_json("row")))).alias("row"))
    return single.unionByName(once.select("row.*"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=3, percent=90)
