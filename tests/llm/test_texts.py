"""Scores, lines, tokens, phrases, licences, mixing and chats against brute force."""

import hashlib
import itertools
import json
import math
import random
import re
import textwrap
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridloom.llm import chat_format, decontamination, license_scan, line_dedup, lm_scoring, quality, source_mixing, token_output

TEXTS = [None, "", "a", "The the THE cat", "café naïve Été", "x" * 5000, "a b\n\n A B \nc", "a b\r\n", "你好 世界", "the cat sat on the mat\nthe cat sat"]


def docs(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, uid_extra int")


def brute_ppm(train, text, order):
    """log10 of the probability by the longest context, escapes of kind C and exclusion."""
    pad, counts = [255] * order, {}
    for t in train:
        s = pad + list((t or "").encode()) + [255]
        for p in range(order, len(s)):
            for k in range(order + 1):
                c = counts.setdefault(tuple(s[p - k : p]), {})
                c[s[p]] = c.get(s[p], 0) + 1
    s, total = pad + list((text or "").encode()) + [255], 0.0
    for p in range(order, len(s)):
        gone = set()
        for k in range(order, -1, -1):
            seen = {x: n for x, n in counts.get(tuple(s[p - k : p]), {}).items() if x not in gone}
            if not seen:
                continue
            whole = sum(seen.values()) + len(seen)
            if s[p] in seen:
                total += math.log10(seen[s[p]] / whole)
                break
            total += math.log10(len(seen) / whole)
            gone |= set(seen)
        else:
            total -= math.log10(256 - len(gone))
    return total


@pytest.mark.parametrize(("block_bytes", "frequent"), [(1 << 25, 3), (40, 3), (1, 1000)])
def test_scores_equal_brute_force(spark, block_bytes, frequent):
    rows = docs(spark)
    train = [t for i, t in enumerate(TEXTS) if i % 2 == 0]
    model = lm_scoring.fit(rows.filter("doc_id % 2 = 0"), order=3)
    got = {r.doc_id: r for r in lm_scoring.score(model, rows, ["doc_id"], block_bytes=block_bytes, frequent=frequent).collect()}
    words = [[w for w in re.split("[\x20\x09-\x0d]+", "".join(c.lower() if c.isascii() else c for c in t or "")) if w] + [None] for t in TEXTS]
    seen = [w for i, ws in enumerate(words) if i % 2 == 0 for w in ws]
    n, v = len(seen), len(set(seen))
    for i, t in enumerate(TEXTS):
        assert got[i].score == pytest.approx(brute_ppm(train, t, 3), rel=1e-9)
        assert got[i].base_score == pytest.approx(sum(math.log10((seen.count(w) + 0.5) / (n + 0.5 * (v + 1))) for w in words[i]), rel=1e-9)
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(words[i]), sum(w in seen for w in words[i]), n)


def test_scores_without_training_texts(spark):
    rows = docs(spark, ["ab", None])
    got = [r.score for r in lm_scoring.score(lm_scoring.fit(rows.limit(0)), rows, ["doc_id"]).orderBy("doc_id").collect()]
    assert got == pytest.approx([-3 * math.log10(256), -math.log10(256)])


def test_scores_of_repeated_and_null_ids_and_long_texts(spark):
    long = "lorem ipsum dolor " * 20_000
    rows = spark.createDataFrame([(1, "the cat", "k"), (1, "the cat", "k"), (1, "a dog", "k"), (None, "the cat", "k"), (2, long, "k")], "doc_id long, text string, score string")
    model = lm_scoring.fit(rows, order=2)
    got = sorted(tuple(r) for r in lm_scoring.score(model, rows.withColumnRenamed("score", "block"), ["doc_id", "block"], block_bytes=64).select("doc_id", "n_tokens", F.round("score", 6)).na.fill(-1).collect())
    train = [r.text for r in rows.collect()]
    cat, dog = (brute_ppm(train, t, 2) for t in ("the cat", "a dog"))
    assert [g[:2] for g in got] == [(-1, 3), (1, 3), (1, 3), (1, 3), (2, 60_001)]
    assert [g[2] for g in got[:4]] == pytest.approx([cat, *sorted([cat, cat, dog])], abs=1e-5)


def test_scores_of_an_empty_table(spark):
    rows = docs(spark).limit(0)
    assert lm_scoring.score(lm_scoring.fit(rows), rows, ["doc_id"]).count() == 0


@pytest.mark.parametrize("hot_share", [4096, 1])
@pytest.mark.parametrize("keep_first", [True, False])
def test_lines(spark, keep_first, hot_share):
    texts = ["A b\nx\n\n a B\t", "a b", None, "y\n\nx", "z\nz"]
    rows = docs(spark, texts).withColumn("uid", F.col("doc_id"))
    found = line_dedup.keep_bitmaps(rows, min_docs=2, keep_first=keep_first, hot_share=hot_share).collect()
    found = {r.uid: {w.word * line_dedup.BITS + b for w in r.dropped for b in range(63) if w.bits >> b & 1} for r in found}
    assert found == ({0: {3}, 1: {0}, 3: {2}} if keep_first else {0: {0, 1, 3}, 1: {0}, 3: {2}})


def test_lines_of_long_texts(spark):
    rows = docs(spark, ["\n".join(f"l{i}" for i in range(200)), "\n".join(f"l{i}" for i in range(100, 300))]).withColumn("uid", F.col("doc_id"))
    kept = rows.join(line_dedup.keep_bitmaps(rows, min_docs=2), "uid").select("doc_id", line_dedup.keep_lines(line_dedup.lines_of(F.col("text")), F.col("dense")).alias("k")).collect()
    assert {r.doc_id: list(r.k) for r in kept} == {1: [f"l{i}" for i in range(200, 300)]}


@pytest.mark.parametrize("hot_share", [4096, 3, 1])
def test_lines_equal_brute_force_on_both_paths(spark, hot_share):
    rng = random.Random(2)
    common = [f"line {i}" for i in range(30)]
    texts = ["\n".join([rng.choice(common) if rng.random() < 0.3 else f"own {i} {j}" for j in range(rng.randrange(120))]) for i in range(60)]
    found = line_dedup.kept(docs(spark, texts), ["doc_id"], min_docs=4, keep_first=False, hot_share=hot_share)
    got = {r.doc_id: list(r.k) for r in found.select("doc_id", line_dedup.keep_lines(F.col("lines"), F.col("dense")).alias("k")).collect()}
    seen = {}
    for i, t in enumerate(texts):
        for line in t.split("\n"):
            seen.setdefault(line, set()).add(i)
    assert got == {i: [x for x in t.split("\n") if len(seen[x]) < 4 or not x] for i, t in enumerate(texts)}


def test_lines_of_rows_with_one_id_or_none(spark, tmp_path):
    rows = [(i, "common") for i in range(10)] + [(100, "common\nA"), (100, "B\nkeepme"), (None, "common\nown"), (None, None), (101, ""), (7, "twice"), (7, "twice")]
    spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, uid int, dropped int").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in line_dedup.op2_line_dedup(spark, str(tmp_path)).collect()), key=str)
    kept = ["" if i < 10 else t for i, (_, t) in enumerate(rows)]
    kept[10], kept[12], kept[13] = "A", "own", ""
    expected = [(i, (t or "").count("\n") + 1, int("common" in (t or "")), hashlib.sha256(k.encode()).hexdigest()) for (i, t), k in zip(rows, kept, strict=True)]
    assert got == sorted(expected, key=str)


def test_an_empty_table(spark, tmp_path):
    for name, schema in {"documents": "doc_id long, text string, source string, lang string, n_chars long", "benchmark": "item_id long, text string", "labels": "doc_id long, quality int", "conversations": "conv_id long, turn long, role string, text string"}.items():
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    for query in (line_dedup.op2_line_dedup, lm_scoring.op1_lm_scoring, source_mixing.op6_source_mixing, quality.op7_quality, license_scan.op8_license_scan, decontamination.op9_decontamination, token_output.op10_token_output, chat_format.op5_chat_format):
        assert query(spark, str(tmp_path)).count() == 0


def encoder():
    import public_tokenizers

    return token_output.Encoder(public_tokenizers.path("word_bpe_49k.json"))


ENCODER = encoder()


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(st.characters(exclude_categories=['Cs']), max_size=40), st.text(alphabet="aZé'st!<|end oftx>İΣ\x1c\t\n 09%ß́", max_size=40)))
def test_words_encode_like_the_whole(text):
    data = "x".join([text, text]).encode()
    n = len(text.encode())
    ids, sizes = ENCODER.encode(np.frombuffer(data, np.uint8), np.array([0, n, n + 1, len(data)]), 1)
    own = [*ENCODER.whole(text).tolist(), 1]
    assert ids.tolist() == [*own, *ENCODER.whole("x").tolist(), 1, *own]
    assert sizes.tolist() == [len(own), 2, len(own)]


def test_token_files(spark, tmp_path):
    rows = docs(spark).unionByName(docs(spark).limit(2))
    files = token_output.write(rows, str(tmp_path / "t"), meta=("uid_extra",))
    got = token_output.digests(files).orderBy("start").collect()
    texts, start = sorted([*enumerate(TEXTS), *list(enumerate(TEXTS))[:2]], key=lambda x: x[0]), 0
    for r, (i, t) in zip(got, texts, strict=True):
        ids = ENCODER.tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    import pyarrow.parquet as pq

    encodings = {}
    for p in (tmp_path / "t").glob("*.parquet"):
        m = pq.ParquetFile(p).metadata
        encodings |= {m.row_group(0).column(c).path_in_schema: m.row_group(0).column(c) for c in range(m.num_columns)} if m.num_row_groups else {}
    assert any("DELTA_BINARY_PACKED" in c.encodings for k, c in encodings.items() if k == "doc_id")
    assert all(c.has_offset_index and c.has_column_index for c in encodings.values())


def test_token_files_of_repeated_ids_and_clashing_names(spark, tmp_path):
    r = random.Random(8)
    rows = [(r.choice([None, 3, 4]), r.choice(["a b", "c", None, "d e f", "g h"]), i % 2, "x") for i in range(60)]
    table = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, row string")
    seen = []
    for partitions in (1, 7):
        files = token_output.write(table.repartition(partitions), str(tmp_path / f"{partitions}"), meta=("n_tokens", "row"))
        seen.append([tuple(x) for x in token_output.digests(files).orderBy("start").collect()])
        assert sorted(x.meta_n_tokens for x in files.read("meta_n_tokens").collect()) == sorted(x[2] for x in rows)
    assert seen[0] == seen[1]
    assert [x[0] for x in seen[0]] == sorted((x[0] for x in rows), key=lambda i: (i is not None, i))


def test_token_files_are_read_selectively(spark, tmp_path):
    import pyarrow.parquet as pq

    rows = spark.range(4000).selectExpr("id as doc_id", "repeat(concat('w', cast(id as string), ' '), 40) as text")
    files = token_output.write(rows.coalesce(1), str(tmp_path / "t"), row_group_bytes=1 << 16, page_bytes=1 << 13)
    groups = 0
    for path in (tmp_path / "t").glob("*.parquet"):
        meta = pq.ParquetFile(path).metadata
        groups += meta.num_row_groups
        for g in range(meta.num_row_groups):
            columns = {meta.row_group(g).column(c).path_in_schema.split(".")[0]: meta.row_group(g).column(c) for c in range(meta.num_columns)}
            assert meta.row_group(g).total_byte_size < 3 << 17
            assert columns["doc_id"].has_column_index and columns["ids"].has_offset_index
            assert any("DICTIONARY" in e for e in columns["ids"].encodings)
            assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings and "DELTA_BINARY_PACKED" in columns["n_tokens"].encodings
    assert groups > 1
    some = files.read("doc_id", "n_tokens").filter("doc_id between 1000 and 1009")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(doc_id,1000)" in plan
    assert "ids" not in plan.split("ReadSchema")[1].split("\n")[0]
    assert some.count() == 10


@pytest.mark.parametrize("change", ["cased", "white space", "special token", "truncation"])
def test_token_files_of_other_tokenizers(spark, tmp_path, change):
    import public_tokenizers
    from tokenizers import Tokenizer

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        config = json.load(f)
    if change == "cased":
        config["normalizer"]["normalizers"].pop()
    elif change == "white space":
        config["pre_tokenizer"] = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    elif change == "special token":
        config["added_tokens"].append({**config["added_tokens"][0], "id": 49408, "content": "[cat sat]"})
    else:
        config["truncation"] = {"direction": "Right", "max_length": 3, "strategy": "LongestFirst", "stride": 0}
    path = tmp_path / "other.json"
    path.write_text(json.dumps(config), encoding="utf-8")
    whole = Tokenizer.from_file(str(path))
    whole.no_truncation()
    texts = [*TEXTS, "The [cat sat] ON  the\n\nmat", "你好 The cat sat on the mat"]
    got = {r.doc_id: list(r.ids) for r in token_output.write(docs(spark, texts), str(tmp_path / "t"), tokenizer=str(path)).read("doc_id", "ids").collect()}
    assert got == {i: [*whole.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    assert ENCODER.fast and token_output.Encoder(str(path)).fast == (change == "truncation")


def test_phrases_equal_brute_force(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    texts = [None, "", f"x {item.upper()} y", "a, " + " - ".join(item.split()[:10]), " ".join(item.split()[:9]), "short item", f"{item} {item}", "the " * 50 + "Short, ITEM!"]
    items = spark.createDataFrame([(1, item), (10, item), (2, "short item"), (3, None), (4, "the the the")], "item_id long, text string")
    found = {r.id: (r.n_hit, list(r["items"])) for r in decontamination.contamination(docs(spark, texts), items).collect() if r.n_hit}
    assert found == {2: (12, ["1", "10"]), 3: (10, ["1", "10"]), 5: (2, ["2"]), 6: (24, ["1", "10"]), 7: (52, ["2", "4"])}


def test_phrases_of_rows_with_one_id_or_none(spark, tmp_path):
    item = "one two three four five six seven eight nine ten"
    rows = [(None, f"x {item}"), (1, item), (1, "one two"), (1, item), (2, "word " * 50_000 + item), (3, None)]
    spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, words string, doc int").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(9, item, 4), (9, item, 5)], "item_id long, text string, item int").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.n_near) for r in decontamination.op9_decontamination(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted([(None, 11, 10, 1, 1), (1, 10, 10, 1, 1), (1, 2, 0, 0, 0), (1, 10, 10, 1, 1), (2, 50_010, 10, 1, 1), (3, 0, 0, 0, 0)], key=str)


def test_near_terms(spark):
    found = decontamination.contamination(docs(spark, ["beta far alpha", "alpha " + "x " * 40 + "beta", None]), spark.createDataFrame([(1, "alpha beta")], "item_id long, text string"), slack=5)
    assert {r.id: list(r.near) for r in found.collect()} == {0: ["1"], 1: [], 2: []}


def test_licences(spark):
    texts = ["Intro\nReleased under the MIT License.\nEnd", "released UNDER the MIT license", "Licence talk", None, license_scan.TEMPLATES["gpl-3.0-notice"].replace(" ", "\n")]
    got = {r.doc_id: (r.best_template, r.best_dice) for r in license_scan.licences(docs(spark, texts)).collect()}
    assert got == {0: ("mit", 1.0), 1: ("mit", 1.0), 4: ("gpl-3.0-notice", 1.0)}


def test_licences_inside_longer_texts(spark):
    notice = license_scan.TEMPLATES
    prose = "\n\n".join(f"Paragraph {i} of the text speaks of rain, of rivers and of roads in the hills." for i in range(30))
    wrapped = {k: "\n".join(textwrap.wrap(notice[k], 60, initial_indent=" * ", subsequent_indent=" * ")) for k in ("mit-permission", "bsd-conditions", "isc", "apache-2.0-header", "gpl-3.0-notice")}
    texts = [f"{prose}\n\n{w}\n\n{prose}" for w in wrapped.values()]
    texts += [f"{prose} {notice['isc']} {prose}".replace("\n", " "), f"{prose}\n{wrapped['isc']}\n{prose}\n{wrapped['isc']}\n{wrapped['bsd-conditions']}", f"{prose}\n{notice['isc'][:100]}\n{prose}"]
    texts += [f"{prose}\nReleased under\nthe MIT License.\n{prose}\nThis is released under the MIT license.", f"{prose} license {prose}"]
    got = {r.doc_id: (r.n_units, r.best_template, r.best_dice) for r in license_scan.licences(docs(spark, texts)).collect()}
    # The header's first line matches the short Apache notice by itself.
    expected = {i: (1 + (k == "apache-2.0-header"), k, 1.0) for i, k in enumerate(wrapped)}
    assert got == expected | {5: (1, "isc", 1.0), 6: (3, "bsd-conditions", 1.0), 8: (2, "mit", 1.0)}


def test_item_of_one_word_repeated_in_a_very_long_text(spark):
    n = 100_000
    texts = spark.createDataFrame([(1, "w " * n + "x"), (2, "a w"), (3, "b")], "doc_id long, text string")
    items = spark.createDataFrame([("i", "W"), ("j", "w w w"), ("k", "x y")], "item_id string, text string")
    got = {r.id: (r.n_words, r.n_hit, r.items) for r in decontamination.contamination(texts, items).collect()}
    assert got == {1: (n + 1, n, ["i", "j"]), 2: (2, 1, ["i"]), 3: (1, 0, [])}


def test_lines_of_a_very_long_text(spark):
    n = 400_000
    texts = ["\n".join(str(i) if i % 3 else f"same {i}" for i in range(n)), "\n".join(f"same {i}" for i in range(0, n, 3))]
    rows = line_dedup.kept(docs(spark, texts), ["doc_id"], min_docs=2, keep_first=False)
    got = {r.doc_id: r.k for r in rows.select("doc_id", F.sha2(F.array_join(line_dedup.keep_lines(F.col("lines"), F.col("dense")), "\n"), 256).alias("k")).collect()}
    left = "\n".join(str(i) for i in range(n) if i % 3)
    assert got == {0: hashlib.sha256(left.encode()).hexdigest(), 1: hashlib.sha256(b"").hexdigest()}


def test_mixing_agrees_whatever_the_partitions(spark):
    r = random.Random(9)
    rows = [(r.choice([None, 1, 2]), " ".join("w" * r.randint(1, 9)), r.choice("ab")) for _ in range(300)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    one, other = (sorted(map(tuple, source_mixing.mix(table.repartition(n)).collect()), key=str) for n in (1, 6))
    assert one == other


def test_mixing(spark):
    rows = [(i, "w " * (i % 7 + 1), None if i % 5 == 4 else f"s{i % 5}" if i % 3 else "s0") for i in range(600)] + [(1000, None, "s9"), (1001, "", "s9")]
    got = source_mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    source = {i: s for i, _, s in rows}
    size = {}
    for i, t, s in rows:
        size[s] = size.get(s, 0) + len((t or "").split())
    names = sorted((s for s in size if s is not None)) + [None]
    weight, target, left, open_ = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}, {}, 1.5 * sum(size.values()), set(names)
    while True:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * size[s]}
        if not over:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: 2.0 * size[s] for s in over}
        left -= sum(2 * size[s] for s in over)
        open_ -= over
    for s in names:
        mine = [r for r in got if source[r.doc_id] == s]
        assert all(r.target == pytest.approx(target[s]) and r.source_size == size[s] for r in mine)
        assert abs(sum(r.taken for r in mine) - target[s]) <= 4
        assert all(r.taken in (0, r.size, 2 * r.size) for r in mine)


def test_mixing_of_equal_rows_null_ids_and_clashing_names(spark):
    rows = [(None, "a b c", "s", 1)] * 500 + [(5, "a b", "s", 1)] * 500 + [(i, "x y z", "t", 1) for i in range(100)] + [(900 + i, None, "u", 1) for i in range(50)] + [(1, "w", None, 1)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string, plan int").withColumn("mix", F.lit("m")).withColumn("copies", F.lit(3)).withColumn("row", F.lit(3))
    got = source_mixing.mix(table).collect()
    assert len(got) == len(rows)
    taken, want = {}, {}
    for r in got:
        key = r.source_size
        taken[key], want[key] = taken.get(key, 0) + r.taken, r.target
    assert all(abs(taken[k] - want[k]) <= 3 for k in taken)
    out = source_mixing.taken(table)
    assert out.columns == table.columns
    of = {r["source"]: r["n"] for r in out.groupBy("source").agg(F.sum(source_mixing.n_words(F.col("text"))).alias("n")).collect()}
    assert sum(of.values()) == sum(taken.values())
    assert out.filter("source = 'u'").groupBy("doc_id").count().filter("count > 2").isEmpty()
    again = source_mixing.mix(table)
    assert sorted(map(str, again.collect())) == sorted(map(str, got))


def cost_of(roles, out_roles):
    legal = {(None, 1), (None, 2), (1, 2), (2, 3), (3, 2)}
    total, before = 0, None
    for r, o in zip(roles, out_roles, strict=True):
        total += 2 * (r != o)
        if (before, o) in legal:
            pass
        elif before == o:
            total += 1
        elif any((before, x) in legal and (x, o) in legal for x in (1, 2, 3)):
            total += 3
        else:
            return math.inf
        before = o
    return total


@pytest.mark.parametrize("chunk", [2, 1024])
def test_chats(spark, chunk):
    names, rows, best = ["?", "system", "user", "assistant"], [], {}
    for c, roles in enumerate(itertools.product(range(4), repeat=4)):
        rows += [(c, t, names[r], f"t{t}", 0) for t, r in enumerate(roles)]
        best[c] = min(cost_of(roles, o) for o in itertools.product((1, 2, 3), repeat=4))
    got = chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, code int"), chunk=chunk).collect()
    cost, text = {}, {}
    for r in sorted(got, key=lambda r: (r.conv_id, r.turn)):
        cost[r.conv_id] = cost.get(r.conv_id, 0) + r.cost
        text[r.conv_id] = text.get(r.conv_id, "") + r.rendered
    assert cost == best
    for t in text.values():
        assert re.fullmatch(r"(<\|system\|>\n[^<]*<\|end\|>\n)?(<\|user\|>\n[^<]*<\|end\|>\n(<\|assistant\|>\n[^<]*<\|end\|>\n|$))*", t)
        assert [t.index(f"t{i}") for i in range(4)] == sorted(t.index(f"t{i}") for i in range(4))


def test_chats_of_tied_and_null_turns(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(None, rng.choice([None, 0, 1]), rng.choice(["user", "assistant", "system", None]), rng.choice(["a", "b" * 600 + rng.choice("xyz"), None])) for _ in range(6000)]
    rows += [(7, 0, "user", "same")] * 3000 + [(c, t, "user", "x") for c in range(10, 300) for t in (0, 0, 1)]
    seen, over = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    repaired, repaired_open, longest = chat_format.repair, chat_format.repair_open, 256

    def count(codes, *more):
        seen.add(len(codes))
        over.add(len(codes) > longest)
        return repaired(codes, *more)

    def count_open(codes):
        seen.add(len(codes))
        over.add(len(codes) > longest)
        return repaired_open(codes)

    monkeypatch.setattr(chat_format, "repair", count)
    monkeypatch.setattr(chat_format, "repair_open", count_open)
    got = [tuple(r) for r in chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7), chunk=longest).collect()]
    assert (seen.value, over.value) == (len(rows), 0)
    low = lambda v: (v is not None, v or 0) if not isinstance(v, str) else (True, v)
    text_of = lambda v: (v is not None, v or "")
    expected, ordered = [], sorted(rows, key=lambda r: (low(r[0]), low(r[1]), text_of(r[2]), text_of(r[3])))
    for _, turns in itertools.groupby(ordered, key=lambda r: r[0]):
        turns, s = list(turns), 0
        codes = [chat_format.STATES.index(r[2]) if r[2] else 0 for r in turns]
        for i, (r, code, o) in enumerate(zip(turns, codes, repaired(codes), strict=True)):
            action, x = chat_format.MOVES[s, o]
            head = "\n" if action == "merge" else "<|end|>\n" * (s > 0) + f"<|{chat_format.STATES[x]}|>\n<|end|>\n" * (action == "insert") + f"<|{chat_format.STATES[o]}|>\n"
            name = action if code == o else "relabel" if action == "keep" else f"relabel+{action}"
            expected.append((*r[:3], name, chat_format.STATES[o], float(chat_format.STEPS[code][s, o]), head + (r[3] or "") + "<|end|>\n" * (i == len(turns) - 1)))
            s = o
    assert sorted(got, key=str) == sorted(expected, key=str)


def test_quality(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(200)]
    good = [" ".join(rng.choice(words, 30)) for _ in range(150)]
    bad = [" ".join(w.upper() + "!!" for w in rng.choice(words, 30)) for _ in range(150)]
    rows = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(good + bad)] + [(998, None, None), (999, "", None)], "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([(i, int(i < 150)) for i in range(0, 300, 2)] + [(1, None)], "doc_id long, quality int")
    got = {r.doc_id: r.score for r in quality.score(quality.fit(rows, labels), rows, ["doc_id"]).collect()}
    assert np.mean([(got[i] >= 0.5) == (i < 150) for i in range(1, 300, 2)]) > 0.97
    assert all(0 <= s <= 1 for s in got.values()) and len(got) == 302


def test_factor_pairs_equal_the_double_sum():
    rng = np.random.default_rng(1)
    size = quality.WORD_FEATURES + quality.STATS
    m = quality.Machine(0.3, rng.normal(size=size), rng.normal(size=(size, quality.FACTORS)), np.zeros(quality.STATS), np.ones(quality.STATS))
    at, index, value, stats = np.array([0, 3, 3]), np.array([5, 9, 70]), np.array([0.5, 0.2, 0.8]), rng.normal(size=(2, quality.STATS))
    start, i, x = m.rows(at, index, value, stats)
    z, _ = m.margin(start, i, x)
    for row, (a, b) in enumerate(zip(start, [*start[1:], len(i)], strict=True)):
        pairs = sum(m.factors[i[p]] @ m.factors[i[q]] * x[p] * x[q] for p in range(a, b) for q in range(p + 1, b))
        assert z[row] == pytest.approx(0.3 + (m.linear[i[a:b]] * x[a:b]).sum() + pairs)


def test_digest_of_kept_lines(spark, tmp_path):
    texts = [f"common\nown {i}" for i in range(10)] + [None]
    docs(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in line_dedup.op2_line_dedup(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        kept = "" if t is None else f"own {i}"
        assert (got[i].n_lines, got[i].n_dropped, got[i].kept_sha256) == ((2, 1) if t else (1, 0)) + (hashlib.sha256(kept.encode()).hexdigest(),)


@pytest.mark.parametrize("percent", [60, 80, 100])
def test_no_match_without_a_mark(percent):
    found = set(license_scan.marks(license_scan.TEMPLATES, percent))
    for text in license_scan.TEMPLATES.values():
        ws = re.findall(r"[a-z0-9]+", text.lower())
        pairs = set(itertools.pairwise(ws))
        common = len({p for p in pairs if not found & set(p)})
        assert 200 * common < percent * (common + len(pairs))
