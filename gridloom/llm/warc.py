"""WARC archives from a table of pages, and back.

``write`` first finds equal payloads by SHA-1 and length, without moving payloads: of
at least ``min_bytes`` long ones with the same digest, the row with the largest id (and then
address) is the response and others become revisit records without the payload. Digests that many rows have, up to a
fixed number, are broadcast; others meet their rows by a shuffle once they are too many to broadcast.
Rows are dealt by ranges of id, address and digest, sorted, and made into records, each a gzip member of its own
with all headers and digests made anew, which are stored with their sizes. Running sums of these sizes in the
order of all records say where a new file begins, so names and contents of files depend on the rows
alone and not on partitions. Records then move once more, to the task that writes their file.

The data source ``warc`` writes a file under a temporary name; only when all tasks have ended, files of
the attempts that counted get their final names, and the manifest is renamed into place last. Without a manifest there is no archive,
so a lost task or a failed job leaves nothing that is read. The manifest names each file with its records, bytes, SHA-256 and the
offsets at which it can be split, and ``warc`` reads these splits in parallel, with SHA-1 digests checked.

Null payloads count as empty. Null ids and addresses have no header and are read as null; control characters in them
are written as percent escapes. Ids are read as strings. Ids order as their column does, nulls first, and rows with
the same id are records of their own. Rows equal in id, address and payload are written by one task as a stream; if one
of them is the response, the others revisit it. An empty table gives a manifest without files. Columns
of other names are not written.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from gridloom.operators.tables import broadcast_if_small, discard, materialize, new_path

MIN_BYTES = 1000
FILE_BYTES, SPLIT_BYTES = 64 << 20, 4 << 20
BROADCAST_DIGESTS = 500_000
#: A digest with more than one in so many rows is hot.
HOT_SHARE = 4096
DATE = "1970-01-01T00:00:00Z"
MANIFEST = "_manifest.json"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_DNS, "warc.records")
CONTROLS = re.compile("[\x00-\x1f\x7f]")


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _plain(value: str | None) -> str | None:
    return value if value is None else CONTROLS.sub(lambda m: "%%%02X" % ord(m[0]), value)


def _record_id(*what: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, json.dumps(what))}>"


def _member(headers: list[tuple[str, str | None]], block: bytes, level: int = 6) -> bytes:
    """A record as a gzip member; headers without a value are left out."""
    lines = ["WARC/1.1", *[f"{k}: {v}" for k, v in headers if v is not None], f"WARC-Block-Digest: {_digest(block)}", f"Content-Length: {len(block)}", "", ""]
    press = zlib.compressobj(level, zlib.DEFLATED, 31)
    return press.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n") + press.flush()


def info(name: str, date: str) -> bytes:
    """The record at the head of a file."""
    block = b"software: gridloom\r\nformat: WARC File Format 1.1\r\n"
    return _member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", _record_id("info", name)), ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], block)


def _http(size: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()


def record(row: dict, copy: int, date: str) -> bytes:
    """The gzip member of a row ``(id, url, sha, bytes, payload, to_id, to_url, revisit)``, the ``copy``-th of equal ones."""
    row_id, url = _plain(row["id"]), _plain(row["url"])
    own = [("WARC-Record-ID", _record_id(row_id, url, row["sha"], copy)), ("WARC-Date", date), ("WARC-Target-URI", url), ("X-Row-ID", row_id)]
    digest = [("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(row["sha"])).decode())]
    kind = [("Content-Type", "application/http; msgtype=response")]
    if row["revisit"]:
        to_id, to_url = _plain(row["to_id"]), _plain(row["to_url"])
        to = [("WARC-Profile", PROFILE), ("WARC-Refers-To", _record_id(to_id, to_url, row["sha"], 0)), ("WARC-Refers-To-Target-URI", to_url), ("WARC-Refers-To-Date", date), ("X-Refers-To-Row-ID", to_id)]
        return _member([("WARC-Type", "revisit"), *own, *to, *digest, *kind], _http(row["bytes"]))
    return _member([("WARC-Type", "response"), *own, *digest, *kind], _http(row["bytes"]) + (row["payload"] or "").encode())


def _members(date: str):
    """Sorted rows as ``(member, size)``; of equal rows of a response, all but the first revisit it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, copy = None, 0
        for batch in batches:
            made = []
            for i in range(len(batch)):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                key = (row["id"], row["url"], row["sha"])
                copy, last = (copy + 1 if key == last else 0), key
                if copy and row["shared"]:
                    row["revisit"] = True
                made.append(record(row, copy, date))
            yield pa.record_batch({"member": pa.array(made, pa.large_binary()).cast(pa.binary()), "size": pa.array([len(m) for m in made], pa.int64())})

    return run


def planned(pages: DataFrame, id_col: str, url: str, html: str, min_bytes: int, broadcast_digests: int = BROADCAST_DIGESTS) -> tuple[DataFrame, DataFrame]:
    """Rows ``(key, id, url, sha, bytes, payload, to_id, to_url, shared, revisit)``, where revisits have no payload, and the stored table of digests that they need."""
    text = F.coalesce(F.col(f"`{html}`").cast("string"), F.lit(""))
    rows = pages.select(F.col(f"`{id_col}`").alias("key"), F.col(f"`{url}`").cast("string").alias("url"), text.alias("payload"))
    rows = rows.withColumn("bytes", F.octet_length("payload").cast("long")).withColumn("sha", F.sha1(F.encode("payload", "UTF-8")))
    best = F.max(F.struct("key", "url"))
    shared = rows.filter(F.col("bytes") >= min_bytes).groupBy("sha", "bytes").agg(best.alias("to"), F.count("*").alias("n")).filter("n > 1")
    shared = materialize(shared, "warc-shared")
    few = broadcast_if_small(shared, broadcast_digests)
    if few is not shared:
        rows = rows.join(few, ["sha", "bytes"], "left")
    else:
        total = shared.agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]
        hot = F.col("n") * HOT_SHARE > total
        rows = rows.join(F.broadcast(shared.filter(hot).select("sha", "bytes", F.col("to").alias("hot"))), ["sha", "bytes"], "left")
        rows = rows.withColumn("join", F.when(F.col("hot").isNull(), F.col("sha")).otherwise(F.concat(F.lit("-"), F.xxhash64("key", "url").cast("string"))))
        rare = shared.filter(~hot).select(F.col("sha").alias("join"), F.col("bytes").alias("long"), "to")
        rows = rows.join(rare, (rows["join"] == rare["join"]) & (rows["bytes"] == rare["long"]), "left").withColumn("to", F.coalesce("hot", "to"))
    revisit = F.col("to").isNotNull() & ~(F.col("key").eqNullSafe(F.col("to.key")) & F.col("url").eqNullSafe(F.col("to.url")))
    rows = rows.withColumn("revisit", revisit)
    rows = rows.select(
        "key", F.col("key").cast("string").alias("id"), "url", "sha", "bytes", F.when(~F.col("revisit"), F.col("payload")).alias("payload"),
        F.col("to.key").cast("string").alias("to_id"), F.col("to.url").alias("to_url"), F.col("to").isNotNull().alias("shared"), "revisit",
    )
    return rows, shared


def cuts(members: DataFrame, file_bytes: int) -> DataFrame:
    """``(part, lo, hi, file)``: which file the stored records ``lo`` to ``hi`` of a part go to; no more rows than files and parts."""
    sizes = members.select(F.shiftright("uid", 33).cast("int").alias("part"), "uid", "size")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    offsets = sizes.groupBy("part").agg(F.sum("size").alias("all")).select("part", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("part").orderBy("uid").rowsBetween(Window.unboundedPreceding, -1)
    placed = sizes.withColumn("sum", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(F.broadcast(offsets), "part")
    return placed.groupBy("part", F.floor((F.col("sum") + F.col("offset")) / file_bytes).alias("file")).agg(F.min("uid").alias("lo"), F.max("uid").alias("hi"))


@dataclass
class Written(WriterCommitMessage):
    """Files of one task, each as (temporary name, entry of the manifest)."""

    files: list[tuple[str, dict]]


class Writer(DataSourceArrowWriter):
    """Rows ``(file, member)``, sorted by file, as files named by their numbers."""

    def __init__(self, path: str, date: str, split_bytes: int):
        self.path, self.date, self.split_bytes = path, date, split_bytes

    def _place(self) -> tuple[fs.FileSystem, str]:
        where, base = fs.FileSystem.from_uri(self.path)
        return where, base.rstrip("/")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        where, base = self._place()
        attempt, out, done, number = uuid.uuid4().hex, None, [], None
        where.create_dir(f"{base}/_temporary", recursive=True)

        def close() -> None:
            if out is not None:
                out.close()
                entry["sha256"] = whole.hexdigest()
                done.append((temporary, entry))

        for batch in iterator:
            for file, member in zip(batch.column("file").to_pylist(), batch.column("member"), strict=True):
                data = member.as_buffer()
                if file != number:
                    close()
                    number, name = file, f"part-{file:08d}.warc.gz"
                    temporary = f"{base}/_temporary/{attempt}-{name}"
                    out, whole, head = where.open_output_stream(temporary, compression=None), hashlib.sha256(), info(name, self.date)
                    out.write(head)
                    whole.update(head)
                    entry = {"file": name, "records": 0, "bytes": len(head), "splits": [len(head)]}
                if entry["bytes"] - entry["splits"][-1] >= self.split_bytes:
                    entry["splits"].append(entry["bytes"])
                out.write(data)
                whole.update(data)
                entry["records"] += 1
                entry["bytes"] += len(data)
        close()
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        where, base = self._place()
        where.create_dir(base, recursive=True)
        files = sorted((f for m in messages if m for f in m.files), key=lambda f: f[1]["file"])
        for temporary, entry in files:
            where.move(temporary, f"{base}/{entry['file']}")
        lines = "".join(json.dumps(entry) + "\n" for _, entry in files)
        with where.open_output_stream(f"{base}/{MANIFEST}.new", compression=None) as out:
            out.write(lines.encode())
        where.move(f"{base}/{MANIFEST}.new", f"{base}/{MANIFEST}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        """Removes what has a temporary name, also of attempts that did not count."""
        where, base = self._place()
        if where.get_file_info(f"{base}/_temporary").type == fs.FileType.Directory:
            where.delete_dir(f"{base}/_temporary")


@dataclass
class Split(InputPartition):
    file: str
    start: int
    end: int


def members_of(stream: pa.NativeFile, size: int) -> Iterator[bytes]:
    """The content of each gzip member in the next ``size`` bytes."""
    left, rest = size, b""
    while left or rest:
        press, parts = zlib.decompressobj(31), []
        while not press.eof:
            if not rest:
                if not left:
                    raise ValueError("a record ends early")
                rest = stream.read(min(left, 1 << 16))
                left -= len(rest)
                if not rest:
                    raise ValueError("a file ends early")
            parts.append(press.decompress(rest))
            rest = press.unused_data
        yield b"".join(parts)


def parsed(content: bytes) -> tuple:
    """``(id, url, html, payload_bytes, payload_digest, record_type, refers_to, record_id, intact)`` of a record's content."""
    head, _, rest = content.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(headers["Content-Length"])]
    intact = _digest(block) == headers["WARC-Block-Digest"] and rest[len(block) :] == b"\r\n\r\n"
    digest, kind = headers["WARC-Payload-Digest"], headers["WARC-Type"]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    html = None
    if kind == "response":
        intact, html = intact and _digest(payload) == digest and len(payload) == size, payload.decode()
        digest = _digest(payload)
    found = base64.b32decode(digest.removeprefix("sha1:")).hex()
    return headers.get("X-Row-ID"), headers.get("WARC-Target-URI"), html, size, found, kind, headers.get("X-Refers-To-Row-ID"), headers["WARC-Record-ID"], intact


SCHEMA = "id string, url string, html string, payload_bytes long, payload_digest string, record_type string, refers_to string, record_id string, intact boolean"
BATCH_BYTES = 8 << 20


class Reader(DataSourceReader):
    """Response and revisit records of the files in the manifest."""

    def __init__(self, path: str, bodies: bool):
        self.path, self.bodies = path, bodies

    def partitions(self) -> list[Split]:
        where, base = fs.FileSystem.from_uri(self.path)
        with where.open_input_stream(f"{base.rstrip('/')}/{MANIFEST}", compression=None) as f:
            entries = [json.loads(line) for line in f.read().decode().splitlines()]
        return [Split(e["file"], a, b) for e in entries for a, b in zip(e["splits"], [*e["splits"][1:], e["bytes"]], strict=True)]

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}[t]) for n, t in (c.split(" ") for c in SCHEMA.split(", "))])
        if partition is None or not hasattr(partition, "file"):
            return
        where, base = fs.FileSystem.from_uri(self.path)
        rows, size = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        with where.open_input_file(f"{base.rstrip('/')}/{partition.file}") as f:
            f.seek(partition.start)
            for content in members_of(f, partition.end - partition.start):
                row = parsed(content)
                rows.append(row if self.bodies else (*row[:2], None, *row[3:]))
                size += len(content) if self.bodies else 400
                if size >= BATCH_BYTES:
                    yield batch()
                    rows, size = [], 0
        if rows:
            yield batch()


class WarcSource(DataSource):
    """Options: ``path``; ``date`` and ``split_bytes`` to write; ``bodies`` (true by default) to read payloads of responses."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], self.options.get("bodies", "true").lower() == "true")

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"], self.options.get("date", DATE), int(self.options.get("split_bytes", SPLIT_BYTES)))


def write(pages: DataFrame, path: str, id_col: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = MIN_BYTES, file_bytes: int = FILE_BYTES, split_bytes: int = SPLIT_BYTES, date: str = DATE, **options: int) -> None:
    """All rows of ``pages`` as archives in the folder ``path``, which must have no manifest yet."""
    spark = pages.sparkSession
    spark.dataSource.register(WarcSource)
    where, base = fs.FileSystem.from_uri(path)
    if where.get_file_info(f"{base.rstrip('/')}/{MANIFEST}").type != fs.FileType.NotFound:
        raise FileExistsError(path)
    order = [F.col(c).asc_nulls_first() for c in ("key", "url", "sha")]
    rows, shared = planned(pages, id_col, url, html, min_bytes, **options)
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("key")
    made = rows.mapInArrow(_members(date), "member binary, size long").withColumn("uid", F.monotonically_increasing_id())
    members = materialize(made, "warc-members", compression="none")
    discard(shared)
    bounds = materialize(cuts(members, file_bytes), "warc-cuts")
    filed = members.withColumn("part", F.shiftright("uid", 33).cast("int")).join(F.broadcast(bounds), "part").filter("uid between lo and hi")
    filed = filed.select("file", "uid", "member").repartition("file").sortWithinPartitions("file", "uid")
    filed.select("file", "member").write.format("warc").option("date", date).option("split_bytes", str(split_bytes)).mode("append").save(path)
    discard(members, bounds)


def read(spark: SparkSession, path: str, bodies: bool = True) -> DataFrame:
    """The records of archives that ``write`` made: see ``SCHEMA``. ``intact`` tells whether all digests hold."""
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("bodies", str(bodies)).load(path)


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read(spark, path, bodies=False).select(F.col("id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


OP12_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload, octet_length(encode(coalesce(html, ''))) AS n, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages)
SELECT page_id, n::BIGINT AS payload_bytes, sha1(payload) AS payload_digest,
       CASE WHEN n < 1000 OR page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN n >= 1000 AND page_id < last THEN last END AS refers_to
FROM p
"""
