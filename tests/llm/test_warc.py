"""Archives against the gzip module and plain Python, whatever the partitions, and the commit of files."""

import base64
import gzip
import hashlib
import json
import random
from pathlib import Path

import duckdb
import pyarrow as pa
import pytest

from gridloom.llm import warc as op

LONG = "<p>é 你好</p>\r\n\r\n" * 80
SCHEMA = "page_id long, url string, html string, member string, size int"


def rows_of(seed=1, n=120):
    r = random.Random(seed)
    pool = [None, "", "short", LONG, LONG + "x", "y" * 1000, "y" * 999, "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 50]
    rows = [(i, f"https://e.org/{i % 7} é", r.choice([*pool, "".join(r.choices("ab \n", k=3000))]), "m", 1) for i in r.sample(range(1000), n)]
    return [*rows, (5000, None, LONG, None, None), (5000, "http://z\r\nX: y", LONG, None, None), (5000, "http://z\r\nX: y", LONG, None, None), (None, "u", LONG, None, None), (None, None, "z" * 2000, None, None), (7777, "big", "q" * 300_000, None, None)]


def expected(rows, min_bytes=1000):
    """(id, bytes, digest, type, to) of each row."""
    groups, out = {}, []
    for i, r in enumerate(rows):
        groups.setdefault((r[2] or "").encode(), []).append((r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "", i))
    best = {k: max(v)[-1] for k, v in groups.items() if len(v) > 1 and len(k) >= min_bytes}
    for i, r in enumerate(rows):
        data = (r[2] or "").encode()
        to = best.get(data, i)
        out.append((r[0], len(data), hashlib.sha1(data).hexdigest(), "response" if to == i else "revisit", None if to == i else rows[to][0]))
    return sorted(out, key=str)


def files(path):
    return {p.name: p.read_bytes() for p in Path(path).iterdir() if not p.name.startswith(".")}


@pytest.mark.parametrize("options", [{}, {"broadcast_digests": 0}])
def test_round_trip(spark, tmp_path, options):
    rows = rows_of()
    pages = spark.createDataFrame(rows, SCHEMA)
    seen = []
    for partitions in (1, 5):
        path = f"{tmp_path}/{partitions}"
        op.write(pages.repartition(partitions), path, file_bytes=6000, split_bytes=1500, **options)
        found = op.read(spark, path).collect()
        assert all(r.intact for r in found)
        number = lambda x: None if x is None else int(x)
        assert sorted(((number(r.id), r.payload_bytes, r.payload_digest, r.record_type, number(r.refers_to)) for r in found), key=str) == expected(rows)
        kept = {hashlib.sha1((r[2] or "").encode()).hexdigest(): r[2] or "" for r in rows}
        assert all(r.html == (kept[r.payload_digest] if r.record_type == "response" else None) for r in found)
        assert len({r.record_id for r in found}) == len(rows)
        assert {r.url for r in found if r.id == "5000"} == {None, "http://z%0D%0AX: y"}
        seen.append(files(path))
    assert seen[0] == seen[1]
    assert len(seen[0]) > 4


def test_files_are_archives(spark, tmp_path):
    rows = rows_of(2, 60)
    op.write(spark.createDataFrame(rows, SCHEMA).repartition(3), f"{tmp_path}/a", file_bytes=9000)
    found = files(f"{tmp_path}/a")
    entries = [json.loads(line) for line in found.pop("_manifest.json").decode().splitlines()]
    assert [e["file"] for e in entries] == sorted(found)
    order, ids, refers = [], set(), []
    for e in entries:
        data = found[e["file"]]
        assert (e["bytes"], e["sha256"]) == (len(data), hashlib.sha256(data).hexdigest())
        rest, kinds = gzip.decompress(data), []
        while rest:
            head, _, rest = rest.partition(b"\r\n\r\n")
            version, *lines = head.decode().split("\r\n")
            assert version == "WARC/1.1"
            headers = dict(line.split(": ", 1) for line in lines)
            block, rest = rest[: int(headers["Content-Length"])], rest[int(headers["Content-Length"]) :]
            assert rest[:4] == b"\r\n\r\n"
            rest = rest[4:]
            assert headers["WARC-Block-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()
            kinds.append(headers["WARC-Type"])
            ids.add(headers["WARC-Record-ID"])
            refers += [headers["WARC-Refers-To"]] if "WARC-Refers-To" in headers else []
            order += [int(headers.get("X-Row-ID", -1))] if kinds[-1] != "warcinfo" else []
        assert kinds[0] == "warcinfo"
        assert len(kinds) == e["records"] + 1
        sizes = [len(d) for d in data.split(b"\x1f\x8b\x08")[1:]]
        assert len(data) - sizes[-1] < 9000 + sizes[0] + 100 or e is entries[-1]
    assert order == sorted(order)
    assert len(order) == len(rows)
    assert refers
    assert set(refers) <= ids


def test_damage_is_told(spark, tmp_path):
    op.write(spark.createDataFrame(rows_of(), SCHEMA), f"{tmp_path}/a")
    data = (tmp_path / "a" / "part-00000000.warc.gz").read_bytes()
    content = next(m for m in op.members_of(pa.BufferReader(data), len(data)) if b"WARC-Type: response" in m and len(m) > 2000)
    assert op.parsed(content)[-1]
    assert not op.parsed(content[:-10] + b"?" + content[-9:])[-1]
    with pytest.raises(ValueError):
        list(op.members_of(pa.BufferReader(data[:-5]), len(data) - 5))
    with pytest.raises(FileExistsError):
        op.write(spark.createDataFrame(rows_of(), SCHEMA), f"{tmp_path}/a")


def batch(*rows):
    return pa.record_batch({"file": [r[0] for r in rows], "member": pa.array([r[1] for r in rows], pa.binary())})


def test_only_attempts_that_count_are_kept(tmp_path):
    path = f"{tmp_path}/a"
    writer = op.Writer(path, op.DATE, 10)
    first = writer.write(iter([batch((0, b"aaaa"), (0, b"b" * 20)), batch((0, b"c"), (2, b"d"))]))
    writer.write(iter([batch((0, b"lost"))]))  # an attempt that was repeated
    second = writer.write(iter([batch((1, b"e"))]))
    assert [p.name for p in Path(path).iterdir()] == ["_temporary"]
    writer.commit([first, None, second])
    found = files(path)
    assert sorted(found) == ["_manifest.json", *[f"part-0000000{i}.warc.gz" for i in range(3)]]
    assert found["part-00000000.warc.gz"].endswith(b"aaaa" + b"b" * 20 + b"c")
    entry = json.loads(found["_manifest.json"].splitlines()[0])
    head = len(op.info("part-00000000.warc.gz", op.DATE))
    assert (entry["records"], entry["splits"]) == (3, [head, head + 24])
    other = op.Writer(f"{tmp_path}/b", op.DATE, 10)
    other.abort([other.write(iter([batch((0, b"x"))]))])
    assert files(f"{tmp_path}/b") == {}


def test_empty_table(spark, tmp_path):
    op.write(spark.createDataFrame([], SCHEMA), f"{tmp_path}/a")
    assert op.read(spark, f"{tmp_path}/a").collect() == []


def test_query_equals_sql(spark, tmp_path):
    rows = [r for r in rows_of(3, 200) if r[0] not in (None, 5000)]
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    found = sorted(map(tuple, op.op12_warc(spark, str(tmp_path)).select(*names).collect()))
    assert found == sorted(con.execute(f"SELECT {', '.join(names)} FROM ({op.OP12_SQL})").fetchall())
    assert sorted(found, key=str) == expected(rows)
