"""Benchmark decontamination by a positional inverted index; DataFrame functions only.

An item's windows are its runs of ``width`` words (all of it, if it has fewer). The words of
the items are counted in the training texts; a window with a word that never occurs
is out. Of each other window the two rarest words are looked up: ``postings`` stores
(term, document, position) of these words. Each posting, less the word's place in
the item, is a diagonal (document, item, shift); intersecting the lists of a window's
rarest words means finding both on one diagonal. Only there the whole window is compared
with the text, so common words are never looked up.

Texts are cut into words once: ``tokens`` stores each row's words under a number of its own,
and counts, postings and comparisons read that table.

What is broadcast grows with the benchmark and is counted first, in rows or in words where rows hold lists; over
``BROADCAST_ROWS`` it is joined by shuffles. A frequent word is looked up only where an item
has no rarer one, as in an item of one word; its postings are as many as its occurrences.

Null and empty texts and items have no words and match nothing. Items with the same id
count as one id; rows with the same id, or none, and equal rows have each their own hits.
A window that several items have counts for each of them. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.line_dedup import lower_ascii
from gridloom.operators.tables import broadcast_if_small, materialize, numbered

WIDTH = 10
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BROADCAST_ROWS = 1_000_000
SLACK = 10
#: Words of a text that a window is compared in.
BLOCK = 256


def words(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(F.coalesce(text.cast("string"), F.lit(""))), F.lit(WORD), F.lit(0))


def text_digest(text: Column) -> list[Column]:
    """Two hashes of a text, which tell it from all others."""
    return [F.xxhash64(text.cast("string")).alias("t1"), F.xxhash64(F.lit("second"), text.cast("string")).alias("t2")]


def item_words(benchmark: DataFrame, item_col: str, text: str) -> DataFrame:
    """``(item, item_id, words)`` of the distinct items that have words."""
    items = benchmark.select(F.col(item_col).alias("item_id"), words(F.col(text)).alias("words")).filter(F.size("words") > 0).distinct()
    return items.select(F.xxhash64("item_id", "words").alias("item"), "item_id", "words")


def rarest(items: DataFrame, counts: DataFrame, width: int) -> DataFrame:
    """``(item, start, size, first, second)``: the windows that can occur, with the places of their two rarest words.

    ``second`` equals ``first`` in windows of one word.
    """
    size = F.least(F.lit(width), F.size("words"))
    windows = items.select("item", "words", size.alias("size"), F.explode(F.sequence(F.lit(0), F.size("words") - size)).alias("start"))
    places = windows.select("item", "size", "start", F.posexplode("words").alias("place", "term")).filter((F.col("place") >= F.col("start")) & (F.col("place") < F.col("start") + F.col("size")))
    ranked = places.join(counts, "term", "left").groupBy("item", "size", "start").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term", "place"))).alias("by"))
    return ranked.filter(F.col("by")[0]["n"] > 0).select("item", "start", "size", F.col("by")[0]["place"].alias("first"), F.col("by")[F.when(F.size("by") > 1, 1).otherwise(0)]["place"].alias("second"))


class Index:
    """Positions in ``docs`` of the words that decide about the items' windows."""

    def __init__(self, docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id", width: int = WIDTH):
        self.width = width
        rows = docs.select(F.col(id_col).alias("id"), *text_digest(F.col(text)), words(F.col(text)).alias("words"))
        self.tokens = numbered(rows.select("id", "t1", "t2", F.size("words").cast("long").alias("n_words"), "words"), "index-tokens", "doc", compression="zstd")
        self.items = materialize(item_words(benchmark, item_col, "text"), "index-items")
        vocabulary = broadcast_if_small(materialize(self.items.select(F.explode("words").alias("term")).distinct(), "index-vocabulary"), BROADCAST_ROWS)
        counts = self.tokens.select(F.explode("words").alias("term")).join(vocabulary, "term").groupBy("term").agg(F.count("*").alias("n"))
        self.windows = materialize(rarest(self.items, materialize(counts, "index-counts"), width), "index-windows")
        places = self.windows.select("item", F.explode(F.array_distinct(F.array("first", "second"))).alias("place")).distinct()
        self.places = materialize(places.join(self.items, "item").select("item", "place", F.get("words", F.col("place")).alias("term")), "index-places")
        terms = broadcast_if_small(materialize(self.places.select("term").distinct(), "index-terms"), BROADCAST_ROWS)
        occurrences = self.tokens.select("doc", F.posexplode("words").alias("at", "term"))
        self.postings = materialize(occurrences.join(terms, "term").select("term", "doc", "at"), "index-postings")

    def diagonals(self) -> DataFrame:
        """``(doc, item, shift, starts)``: where both rarest words of the windows at ``starts`` are in place."""
        hits = self.postings.join(broadcast_if_small(self.places, BROADCAST_ROWS), "term").select("doc", "item", (F.col("at") - F.col("place")).alias("shift"), "place")
        hits = hits.groupBy("doc", "item", "shift").agg(F.collect_set("place").alias("places"))
        windows = self.windows.groupBy("item").agg(F.collect_list(F.struct("start", "size", "first", "second")).alias("windows"))
        hits = hits.join(broadcast_if_small(materialize(windows, "index-lists"), BROADCAST_ROWS, F.size("windows")), "item")
        both = F.filter("windows", lambda w: F.array_contains("places", w["first"]) & F.array_contains("places", w["second"]))
        return hits.select("doc", "item", "shift", both.alias("windows")).filter(F.size("windows") > 0)

    def phrases(self) -> DataFrame:
        """``(doc, item_id, shift, windows)``: windows (start, size) that occur word by word at ``shift + start``.

        A window meets the block of ``BLOCK`` words where it would begin, never a whole text.
        """
        found = materialize(self.diagonals(), "index-diagonals")
        phrases = self.windows.join(self.items, "item").select("item", "item_id", "start", "size", F.slice("words", F.col("start") + 1, F.col("size")).alias("phrase"))
        phrases = broadcast_if_small(materialize(phrases, "index-phrases"), BROADCAST_ROWS, F.col("size"))
        spots = found.select("doc", "item", "shift", F.explode("windows").alias("w")).select("doc", "item", "shift", F.col("w.start").alias("start"), (F.col("shift") + F.col("w.start")).alias("at")).filter("at >= 0")
        texts = self.tokens.join(broadcast_if_small(found.select("doc").distinct(), BROADCAST_ROWS), "doc", "left_semi")
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size("words") - 1) / BLOCK).cast("int")), lambda b: F.slice("words", b * BLOCK + 1, BLOCK + self.width - 1))
        blocks = texts.filter(F.size("words") > 0).select("doc", F.posexplode(blocks).alias("block", "text_words"))
        met = spots.join(phrases, ["item", "start"]).withColumn("block", F.floor(F.col("at") / BLOCK).cast("int")).join(blocks, ["doc", "block"])
        matched = met.filter(F.slice("text_words", (F.col("at") % BLOCK).cast("int") + 1, F.col("size")) == F.col("phrase"))
        return matched.groupBy("doc", "item_id", "shift").agg(F.collect_list(F.struct("start", "size")).alias("windows"))

    def near(self, slack: int = SLACK) -> DataFrame:
        """``(doc, item_id, n_terms)``: proximity matches of an item, in any order.

        All the item's rarest words lie within its length and ``slack`` words of each other.
        """
        sizes = self.items.join(self.places.groupBy("item").agg(F.countDistinct("term").alias("wanted")), "item")
        sizes = sizes.select("item", "item_id", "wanted", (F.size("words") + slack).alias("span"))
        hits = self.postings.join(broadcast_if_small(self.places.select("item", "term").distinct(), BROADCAST_ROWS), "term").join(broadcast_if_small(sizes, BROADCAST_ROWS), "item")
        # Blocks of one span, each position also in the block before: whatever lies within a span shares one.
        block = F.floor(F.col("at") / F.col("span"))
        hits = hits.select("doc", "item", "item_id", "wanted", "span", "term", "at", F.explode(F.array(block, block - 1)).alias("block"))
        spots = hits.groupBy("doc", "item", "item_id", "wanted", "span", "block").agg(F.countDistinct("term").alias("n_terms"), F.sort_array(F.collect_set(F.struct("at", "term"))).alias("spots"))
        within = lambda s: F.size(F.array_distinct(F.transform(F.filter("spots", lambda x: (x["at"] >= s["at"]) & (x["at"] < s["at"] + F.col("span"))), lambda x: x["term"])))
        return spots.filter((F.col("n_terms") == F.col("wanted")) & F.exists("spots", lambda s: within(s) == F.col("wanted"))).groupBy("doc", "item_id").agg(F.max("n_terms").alias("n_terms"))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id", width: int = WIDTH, slack: int = SLACK) -> DataFrame:
    """``(id, t1, t2, n_words, n_hit, items, near)`` of every row of ``docs``.

    ``items`` have windows in the text and ``near`` all their rarest words close together; both
    are sorted ids as strings. ``t1`` and ``t2`` are the text's digests.
    """
    index = Index(docs, benchmark, id_col, text, item_col, width)
    matched = materialize(index.phrases(), "index-phrases")
    at = F.explode(F.flatten(F.transform("windows", lambda w: F.sequence(F.col("shift") + w["start"], F.col("shift") + w["start"] + w["size"] - 1))))
    hit = matched.select("doc", at.alias("at")).distinct().groupBy("doc").agg(F.count("*").alias("n_hit"))
    ids = F.array_sort(F.collect_set(F.col("item_id").cast("string")))
    found = hit.join(matched.groupBy("doc").agg(ids.alias("items")), "doc").join(index.near(slack).groupBy("doc").agg(ids.alias("near")), "doc", "full_outer")
    rows = index.tokens.select("doc", "id", "t1", "t2", "n_words").join(broadcast_if_small(materialize(found, "index-found"), BROADCAST_ROWS, F.coalesce(F.size("items"), F.lit(0)) + F.coalesce(F.size("near"), F.lit(0))), "doc", "left")
    none = F.array().cast("array<string>")
    return rows.select("id", "t1", "t2", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", none).alias("items"), F.coalesce("near", none).alias("near"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return rows.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.encode(F.array_join("items", ","), "UTF-8"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        F.size("near").cast("long").alias("n_near"),
    )


OP9_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(list_slice(w, s, s + least(10, len(w)) - 1), ' ') AS phrase
  FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS s FROM bw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM win),
runs AS (
  SELECT doc_id, size, p, array_to_string(list_slice(w, p, p + size - 1), ' ') AS phrase
  FROM (SELECT doc_id, w, size, unnest(generate_series(1, len(w) - size + 1)) AS p FROM dw, sizes WHERE len(w) >= size)),
hits AS (SELECT doc_id, item_id, p, size FROM runs JOIN win USING (size, phrase)),
n_hit AS (SELECT doc_id, count(DISTINCT spot) AS n FROM (SELECT doc_id, unnest(generate_series(p, p + size - 1)) AS spot FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS list FROM hits GROUP BY doc_id),
counts AS (SELECT term, count(*) AS n FROM (SELECT unnest(w) AS term FROM dw) GROUP BY term),
places AS (SELECT item_id, w, s, unnest(generate_series(s, s + least(10, len(w)) - 1)) AS place
  FROM (SELECT DISTINCT item_id, w, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS s FROM bw WHERE len(w) > 0)),
ranked AS (SELECT item_id, w, w[place] AS term, row_number() OVER win AS r, min(coalesce(n, 0)) OVER (PARTITION BY item_id, w, s) AS fewest
  FROM places LEFT JOIN counts ON term = w[place] WINDOW win AS (PARTITION BY item_id, w, s ORDER BY coalesce(n, 0), w[place], place)),
terms AS (SELECT DISTINCT item_id, w, term FROM ranked WHERE r <= 2 AND fewest > 0),
wanted AS (SELECT item_id, w, count(*) AS wanted, len(w) + 10 AS span FROM terms GROUP BY item_id, w),
spots AS (SELECT doc_id, item_id, terms.w, term, spot FROM (SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) AS spot FROM dw) JOIN terms USING (term)),
close AS (SELECT a.doc_id, a.item_id FROM spots a JOIN wanted t ON a.item_id = t.item_id AND a.w = t.w
  JOIN spots b ON a.doc_id = b.doc_id AND a.item_id = b.item_id AND a.w = b.w AND b.spot >= a.spot AND b.spot < a.spot + span
  GROUP BY a.doc_id, a.item_id, a.w, a.spot, wanted HAVING count(DISTINCT b.term) = wanted),
near AS (SELECT doc_id, count(DISTINCT item_id) AS n FROM close GROUP BY doc_id)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items,
       sha256(coalesce(items.list, '')) AS items_sha256, coalesce(n_hit.n, 0) > 0 AS contaminated,
       coalesce(near.n, 0)::BIGINT AS n_near
FROM dw LEFT JOIN n_hit USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN near USING (doc_id)
"""
