"""Token ids as Parquet list columns, written in document order and read back selectively.

Texts are encoded in place, dealt to range partitions of the id and sorted, so files are
ascending and so are the rows in them. ``ids`` (and other repeated values) are dictionary
encoded, ``doc_id`` and ``n_tokens`` delta encoded; row groups and pages have sizes of
their own, and the page indexes let a reader skip to the pages of some ids or read the
token counts alone. ``manifest`` has for each file its documents, tokens and the number of
tokens in all files before it.

Encoding is that of the tokenizers library for the whole text, without truncation or padding.
Where the tokenizers file has the normalizer and splitting of ``word_bpe_49k.json``, a text
that has only Latin letters and ASCII marks is cut at white space, and between ASCII letters
and marks, where that splitting always cuts too; each distinct piece is encoded once per
worker and looked up after that, in whole arrays. Other texts, and all texts of other
tokenizers files, go through whole.

Null texts count as empty and hold the end id alone. Rows with the same id stay rows of
their own, next to each other, in the order of a hash of what they hold, so that reruns agree and an id
with many rows is dealt to several files. Null ids come first.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.words import IS_WORD, chunks, hashes, spans
from gridloom.operators.tables import new_path

END_ID = 1
RESERVED = ("n_tokens", "ids", "file", "row")
CACHE_UNITS = 800_000
CHUNK_BYTES = 1 << 19
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
#: What ``_unit`` and the cuts of ``encode`` do by themselves.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: Texts with this go through whole, so added tokens that begin with it are found.
SPECIAL = "<|"
#: Kinds of bytes: letters, digits and marks are cut from each other; 0 (apostrophes, and bytes of other letters) from nothing.
KIND = np.full(256, 3, dtype=np.uint8)
KIND[128:] = 0
KIND[ord("'")] = 0
KIND[97:123] = KIND[65:91] = 1
KIND[48:58] = 2


def byte_letters() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


def cuts_alike(config: dict) -> bool:
    """Whether pieces of texts may be encoded alone under the tokenizers file with this content."""
    added = all(t["content"].startswith(SPECIAL) for t in config.get("added_tokens") or [])
    return added and config.get("normalizer") == NORMALIZER and config.get("pre_tokenizer") == PRE_TOKENIZER and not config["model"].get("dropout")


class Encoder:
    """Token ids of texts; holds the tokenizer and the pieces it has encoded."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            self.fast = cuts_alike(json.load(f))
        self.letters = byte_letters()
        self.clear()

    def clear(self) -> None:
        """Forget all pieces: sorted ``keys`` with their ``rows`` of ``starts`` and ``sizes`` in ``ids``."""
        self.keys, self.rows = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.ids, self.n_ids, self.starts, self.sizes = np.zeros(1 << 16, np.int32), 0, np.zeros(0, np.int64), np.zeros(0, np.int32)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32)

    def _unit(self, text: str) -> list[int]:
        tokenize, letters = self.tokenizer.model.tokenize, self.letters
        text = text.lower()
        if text.isascii() and text.isalpha():
            return [t.id for t in tokenize(text)]
        return [t.id for p in PIECES.findall(text) for t in tokenize("".join([letters[b] for b in p.encode()]))]

    def _known(self, keys: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, keys)
        inside = at < len(self.keys)
        inside[inside] = self.keys[at[inside]] == keys[inside]
        return inside

    def _learn(self, keys: np.ndarray, texts: Iterator[str]) -> None:
        """Encode pieces with new ``keys``, which ascend."""
        flat, sizes = array("i"), array("i")
        for text in texts:
            unit = self._unit(text)
            flat.extend(unit)
            sizes.append(len(unit))
        while self.n_ids + len(flat) > len(self.ids):
            self.ids = np.r_[self.ids, np.zeros(len(self.ids), np.int32)]
        self.ids[self.n_ids : self.n_ids + len(flat)] = flat
        n, at = np.array(sizes, np.int32), np.searchsorted(self.keys, keys)
        self.rows = np.insert(self.rows, at, np.arange(len(self.sizes), len(self.sizes) + len(keys), dtype=np.int32))
        self.keys = np.insert(self.keys, at, keys)
        self.starts = np.r_[self.starts, self.n_ids + np.cumsum(n, dtype=np.int64) - n]
        self.sizes = np.r_[self.sizes, n]
        self.n_ids += len(flat)

    def encode(self, data: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts one after the other, each with ``end`` after it, and their numbers."""
        docs = len(offsets) - 1
        if not self.fast:
            parts = [np.r_[self.whole(data[a:b].tobytes().decode("utf-8", "replace")), np.int32(end)] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            return np.concatenate(parts).astype(np.int32), np.array([len(p) for p in parts])
        # Texts of other scripts, with separators that regular expressions do not take as white space, special tokens, or the letter that becomes two.
        odd = (data >= 0xC9) | ((data >= 0x1C) & (data <= 0x1F))
        odd[:-1] |= ((data[:-1] == ord("<")) & (data[1:] == ord("|"))) | ((data[:-1] == 0xC4) & (data[1:] == 0xB0))
        unusual = np.unique(np.searchsorted(offsets, np.flatnonzero(odd), side="right") - 1)
        starts, ends, first = spans(data, offsets)
        if len(starts):
            kind = KIND[data]
            kind[~IS_WORD[data]] = 0
            edge = (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)
            edge[offsets[(offsets > 0) & (offsets < len(data))] - 1] = False
            cut = np.flatnonzero(edge) + 1
            starts, ends = np.sort(np.r_[starts, cut]), np.sort(np.r_[ends, cut])
            first = np.searchsorted(starts, offsets)
        if len(self.rows) > CACHE_UNITS:
            self.clear()
        keys, at, place = np.unique(hashes(data, starts, ends), return_index=True, return_inverse=True)
        new = np.flatnonzero(~self._known(keys))
        if len(new):
            raw, places = data.tobytes(), zip(starts[at[new]].tolist(), ends[at[new]].tolist(), strict=True)
            self._learn(keys[new], (raw[a:b].decode("utf-8", "replace") for a, b in places))
        rows = self.rows[np.searchsorted(self.keys, keys)][place]
        sizes = self.sizes[rows]
        before = np.r_[0, np.cumsum(sizes)]
        totals = np.diff(before[first])
        of = np.repeat(np.arange(docs), np.diff(first))
        out = np.full(before[-1] + docs, end, np.int32)
        n = np.arange(before[-1])
        out[n + np.repeat(of, sizes)] = self.ids[n + np.repeat(self.starts[rows] - before[:-1], sizes)]
        if len(unusual):
            parts = np.split(out, np.cumsum(totals + 1)[:-1])
            for i in unusual.tolist():
                parts[i] = np.r_[self.whole(data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace")), np.int32(end)]
            out, totals = np.concatenate(parts).astype(np.int32), np.array([len(p) - 1 for p in parts])
        return out, totals + 1


_encoders: dict[str, Encoder] = {}


def _encode(path: str | None, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = path
        if where is None:
            import public_tokenizers

            where = public_tokenizers.path("word_bpe_49k.json")
        if where not in _encoders:
            _encoders[where] = Encoder(where)
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column(batch.num_columns - 1), CHUNK_BYTES):
                flat, sizes = _encoders[where].encode(data, offsets, end_id)
                ids = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*[c.slice(lo, hi - lo) for c in batch.columns[:-1]], pa.array(sizes.astype(np.int32)), ids], [*batch.schema.names[:-1], "n_tokens", "ids"])

    return run


@dataclass
class TokenFiles:
    """Files that ``write`` made."""

    spark: SparkSession
    path: str
    id_col: str

    def read(self, *columns: str) -> DataFrame:
        """Rows with ``file`` and ``row`` (the place in it); only these columns are read."""
        rows = self.spark.read.parquet(self.path)
        return rows.select(*(columns or rows.columns), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))

    def manifest(self) -> DataFrame:
        """``(file, docs, tokens, start)`` in the order of the files; one row a file."""
        files = self.read(self.id_col, "n_tokens").groupBy("file").agg(F.min(self.id_col).alias("least"), F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens"))
        before = Window.orderBy(F.col("least").asc_nulls_first(), "file").rowsBetween(Window.unboundedPreceding, -1)
        return files.select("file", "docs", "tokens", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("start"))

    def starts(self, rows: DataFrame) -> DataFrame:
        """``rows`` (with file, row and n_tokens) with ``start``: the ids of all documents before."""
        before = Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("inside", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
        return rows.join(self.manifest().select("file", "start"), "file").withColumn("start", F.col("start") + F.col("inside")).drop("inside")


def write(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", meta: tuple[str, ...] = (), tokenizer: str | None = None, end_id: int = END_ID, row_group_bytes: int = 32 << 20, page_bytes: int = 256 << 10) -> TokenFiles:
    """Encode all rows of ``docs`` and write ``id_col``, ``meta``, ``n_tokens`` and ``ids`` under ``path``.

    ``tokenizer`` is a tokenizers file that every executor can read (by default the
    installed public vocabulary, found on the executor). Columns of ``meta`` with a name in ``RESERVED`` are stored
    with ``meta_`` before it.
    """
    content = [*map(F.col, meta), F.col(text).cast("string")]
    order = [id_col, "__h1", "__h2"]
    named = [F.col(c).alias(f"meta_{c}" if c in RESERVED else c) for c in meta]
    hashed = docs.select(id_col, *named, F.col(text).cast("string").alias("__text"), F.xxhash64(*content).alias("__h1"), F.xxhash64(F.lit("second"), *content).alias("__h2"))
    rows = hashed.repartitionByRange(*order).sortWithinPartitions(*order).drop("__h1", "__h2")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]) + ", n_tokens int, ids array<int>"
    options = {
        "compression": "zstd",
        "parquet.writer.version": "PARQUET_2_0",
        "parquet.enable.dictionary": "true",
        f"parquet.enable.dictionary#{id_col}": "false",
        "parquet.enable.dictionary#n_tokens": "false",
        "parquet.block.size": str(row_group_bytes),
        "parquet.page.size": str(page_bytes),
    }
    rows.mapInArrow(_encode(tokenizer, end_id), schema).write.options(**options).parquet(path)
    return TokenFiles(docs.sparkSession, path, id_col)


def _crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column, lists of ids, as the crc32 of their little-endian 32-bit form."""
    for batch in batches:
        ids = batch.column(batch.num_columns - 1)
        data = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False).astype("<i4"))).cast("B")
        ends = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1].tolist()
        crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(crc, pa.int64())], [*batch.schema.names[:-1], "ids_crc32"])


def digests(files: TokenFiles) -> DataFrame:
    """``(id, start, n_tokens, ids_crc32)`` of every row of the files."""
    rows = files.read(files.id_col, "n_tokens", "ids").select(files.id_col, "n_tokens", "file", "row", "ids")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]) + ", ids_crc32 long"
    rows = files.starts(rows.mapInArrow(_crc, schema))
    return rows.select(files.id_col, F.col("start").cast("long").alias("start"), F.col("n_tokens").cast("long").alias("n_tokens"), "ids_crc32")


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digests(write(docs, new_path(spark, "tokens"), meta=("lang", "source")))
