"""Line deduplication that returns keep bitmaps instead of texts; DataFrame functions only.

A line's key is the line without ASCII white space at both ends, A-Z lower-cased.
``line_rows`` hashes every key to 128 bits. Rows are dealt to partitions by ranges of
the (uniform) hash and sorted there by hash, document and position, so one pass over each
partition sees a key's lines together and its first occurrence first. A key with more
than one in ``hot_share`` of all lines never enters the sort: there are at most
``hot_share`` such keys, so their decisions are broadcast, and one key may hold any
share of the rows. What comes back per document is a sparse bitmap of dropped lines:
``array<struct<word, bits>>`` with 63 lines a word and no entry where all are kept.

Null and empty texts are one empty line. Keys shorter than ``min_chars`` code points are
kept always. ``uid`` is a number that each stored row has of its own, so rows with the same
id or none, and equal rows, are documents of their own. Other columns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.operators.tables import materialize, numbered

SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HOT_SHARE = 4096
BITS = 63


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z and nothing else; the quick path is for texts of ASCII alone."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_rows(docs: DataFrame, text: str = "text", min_chars: int = 1) -> DataFrame:
    """``(uid, pos, h1, h2)`` of every line whose key has ``min_chars`` or more."""
    key = F.btrim(F.col("line"), F.lit(SPACE))
    rows = docs.select("uid", F.posexplode(F.split(lower_ascii(F.coalesce(F.col(text), F.lit(""))), "\n", -1)).alias("pos", "line"))
    rows = rows.select("uid", "pos", key.alias("key")).filter(F.char_length("key") >= min_chars)
    return rows.select("uid", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"))


def drops(lines: DataFrame, min_docs: int = 2, keep_first: bool = True, hot_share: int = HOT_SHARE) -> DataFrame:
    """``(uid, pos)`` of the lines to drop among ``line_rows``.

    Keys in ``min_docs`` documents or more lose their lines: all of them, or all but the
    first by (uid, pos) with ``keep_first``.
    """
    key = ["h1", "h2"]
    total = lines.count()
    hot = lines.groupBy(*key).agg(F.count("*").alias("n")).filter(F.col("n") * hot_share >= total).select(*key)
    hot = materialize(hot, "line-hot")
    decided = (
        lines.join(F.broadcast(hot), key)
        .groupBy(*key, "uid")
        .agg(F.min("pos").alias("pos"))
        .groupBy(*key)
        .agg(F.count("*").alias("docs"), F.min(F.struct("uid", "pos")).alias("first"))
        .filter(F.col("docs") >= min_docs)
    )
    hot_lines = lines.join(F.broadcast(decided), key)
    if keep_first:
        hot_lines = hot_lines.filter(F.struct("uid", "pos") != F.col("first"))
    in_order = Window.partitionBy(*key).orderBy("uid", "pos")
    cold = lines.join(F.broadcast(hot), key, "left_anti").repartitionByRange(*key).sortWithinPartitions(*key, "uid", "pos")
    cold = cold.withColumn("nth", F.row_number().over(in_order)).withColumn("doc", F.dense_rank().over(Window.partitionBy(*key).orderBy("uid")))
    cold = cold.withColumn("docs", F.max("doc").over(Window.partitionBy(*key))).filter((F.col("docs") >= min_docs) & (F.lit(not keep_first) | (F.col("nth") > 1)))
    return hot_lines.select("uid", "pos").unionByName(cold.select("uid", "pos"))


def bitmaps(dropped: DataFrame) -> DataFrame:
    """``(uid, dropped, dense)``: a bitmap of each document that loses lines, sparse and with all its words."""
    word = F.floor(F.col("pos") / BITS).cast("int")
    bit = F.expr(f"shiftleft(1L, pos % {BITS})")
    sparse = dropped.groupBy("uid", word.alias("word")).agg(F.bit_or(bit).alias("bits")).groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("dropped"))
    gap = lambda e, i: e["word"] - F.coalesce(F.get("dropped", i - 1)["word"], F.lit(-1)) - 1
    zero = F.lit(0).cast("long")
    return sparse.withColumn("dense", F.flatten(F.transform("dropped", lambda e, i: F.concat(F.array_repeat(zero, gap(e, i)), F.array(e["bits"])))))


def keep_lines(lines: Column, dense: Column) -> Column:
    """The array ``lines`` without those that the bitmap ``dense`` names, in one pass; ``dense`` should be a column as it is, since it is looked up for each line."""
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), (i % BITS).cast("int"))
    out = lambda i: F.coalesce(F.get(dense, F.floor(i / BITS).cast("int")), F.lit(0).cast("long")).bitwiseAND(bit(i)) != 0
    return F.when(dense.isNull(), lines).otherwise(F.filter(lines, lambda _, i: ~out(i)))


def keep_bitmaps(docs: DataFrame, text: str = "text", min_docs: int = 2, min_chars: int = 1, keep_first: bool = True, hot_share: int = HOT_SHARE) -> DataFrame:
    """``(uid, dropped, dense)`` for the documents of ``docs`` (with a unique ``uid``) that lose lines."""
    lines = materialize(line_rows(docs, text, min_chars), "line-rows")
    return bitmaps(drops(lines, min_docs, keep_first, hot_share))


def kept(docs: DataFrame, keep: list[str], text: str = "text", **options) -> DataFrame:
    """``keep`` columns, ``lines``, ``dropped`` (the sparse bitmap) and ``dense`` (the same with all words), both null where no line goes, of every row of ``docs``."""
    rows = numbered(docs.select(F.struct(*[F.col(c) for c in keep]).alias("kept"), F.col(text).cast("string").alias("text")), "line-docs", "uid", compression="zstd")
    found = keep_bitmaps(rows.select("uid", "text"), **options)
    joined = rows.join(found.hint("shuffle_hash"), "uid", "left")
    return joined.select("kept.*", lines_of(F.col("text")).alias("lines"), "dropped", "dense")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = kept(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"], min_docs=10, keep_first=False)
    n_dropped = F.coalesce(F.aggregate("dropped", F.lit(0), lambda n, w: n + F.bit_count(w.bits)), F.lit(0))
    return rows.select(
        "doc_id",
        F.size("lines").cast("long").alias("n_lines"),
        n_dropped.cast("long").alias("n_dropped"),
        F.sha2(F.encode(F.array_join(keep_lines(F.col("lines"), F.col("dense")), "\n"), "UTF-8"), 256).alias("kept_sha256"),
    )


OP2_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
bad AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10),
flagged AS (SELECT keyed.*, bad.k IS NOT NULL AS dropped FROM keyed LEFT JOIN bad USING (k))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE dropped)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM flagged GROUP BY doc_id
"""
