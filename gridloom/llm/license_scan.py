"""Licence templates found by the Dice coefficient of word bigrams; DataFrame functions only.

The units compared are each text as a whole, each of its lines, and passages: runs of
consecutive words of a text, over line breaks and inside longer lines. Both sides are
normalised: A-Z lower-cased, words of letters and digits, the set of their bigrams. A unit
matches a template where ``Dice = 2 common / (size + template's size)`` is at least ``t``.

A passage begins and ends with a bigram of its template and has at most ``(2 - t) / t`` times
the template's bigrams, repeats counted. Each start takes the end with the highest Dice (the
first of equal ones); of passages of one template that overlap, the one with the highest Dice
stays. Where the text, or a line that the passage touches, matches the template itself, that
unit stands for it and the passage is none. ``OP8_SQL`` knows texts and lines only, so it
equals this for texts without such passages.

A match has at least ``t / (2 - t)`` of the template's bigrams. ``marks`` therefore finds a
few words of the templates without which too few bigrams are left to match any, and texts
and units that contain none of them are not cut into words at all.

Templates are a fixed list, so their bigrams are part of the plan, and a text's units and
passages are compared within its row. Null and empty texts, and units of one word, match
nothing. Rows with the same id share a result. Ties go to the template first by name.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from functools import reduce
from itertools import pairwise
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.decontamination import WORD, words
from gridloom.llm.line_dedup import LOWER, UPPER, lines_of, lower_ascii

#: Public licence notices.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "bsd-3-clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "bsd-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mit": "Released under the MIT License.",
    "mit-permission": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
PERCENT = 80
#: Shorter words are marks only where longer ones do not do.
MARK_CHARS = 6


def pairs_of(ws: Column) -> Column:
    """Bigrams in order, repeats kept."""
    n = F.greatest(F.size(ws) - 1, F.lit(0))
    return F.zip_with(F.slice(ws, F.lit(1), n), F.slice(ws, F.lit(2), n), lambda a, b: F.concat_ws(" ", a, b))


def words_of(text: str) -> list[str]:
    return re.findall(WORD, text.translate(str.maketrans(UPPER, LOWER)))


def parts_of(templates: dict[str, str], percent: int) -> list[dict]:
    """By template: its distinct bigrams, how many of them a match has, and the bigrams of its longest passage."""
    out = []
    for name, text in sorted(templates.items()):
        ws = words_of(text)
        grams = list(dict.fromkeys(f"{a} {b}" for a, b in pairwise(ws)))
        if grams:
            out.append({"template": name, "grams": grams, "need": max(1, -(-percent * len(grams) // (200 - percent))), "longest": (len(ws) - 1) * (200 - percent) // percent})
    return out


def marks(templates: dict[str, str], percent: int) -> list[str]:
    """Words of which every match has one; chosen greedily, long ones first."""
    missing = []
    for text in templates.values():
        ws = words_of(text)
        pairs = set(zip(ws, ws[1:], strict=False))
        missing.append((pairs, len(pairs) + 1 - max(1, -(-percent * len(pairs) // (200 - percent)))))
    found = []
    while any(pairs and need > 0 for pairs, need in missing):
        gain = Counter()
        for pairs, need in missing:
            covers = Counter(w for pair in pairs for w in set(pair))
            gain.update({w: min(n, need) for w, n in covers.items() if need > 0})
        found.append(max(gain, key=lambda w: (len(w) >= MARK_CHARS, gain[w], w)))
        missing = [(rest := {p for p in pairs if found[-1] not in p}, need - len(pairs) + len(rest)) for pairs, need in missing]
    return sorted(found)


def marked(text: Column, found: list[str]) -> Column:
    """Whether a lower-cased text has one of these words; the search for whole words runs only where the letters occur."""
    letter = WORD.rstrip("+")
    return reduce(or_, [F.contains(text, F.lit(w)) & text.rlike(f"(?<!{letter}){re.escape(w)}(?!{letter})") for w in found], F.lit(False))


def once(rows: DataFrame, **columns: Column) -> DataFrame:
    """Columns made once: exploded arrays of one element, which later expressions and filters do not repeat."""
    for name, value in columns.items():
        rows = rows.select("*", F.explode(F.array(value)).alias(name))
    return rows


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def enough(common: Column, size: Column, part: Column, percent: int) -> Column:
    return common * 200 >= (size + F.size(part["grams"])) * percent


def passages(pairs: Column, hits: Column, part: Column, percent: int) -> Column:
    """``(d, start, last)`` of each start's best passage, if it matches: minus its Dice, its first and its last word."""
    grams = part["grams"]

    def best(at: Column) -> Column:
        run = F.transform(F.sequence(at, F.least(at + part["longest"], F.size(pairs)) - 1), lambda j: F.get(pairs, j))

        def to(s: Column, k: Column) -> Column:
            begin = F.slice(s, F.lit(1), k)
            common, size = F.size(F.array_intersect(begin, grams)), F.size(F.array_distinct(begin))
            d = -(common * 2 / (size + F.size(grams)))
            return F.when(enough(common, size, part, percent), F.struct(d.alias("d"), at.alias("start"), (at + k).alias("last")))

        def ends(s: Column) -> Column:
            at_hit = F.filter(F.sequence(part["need"], F.size(s)), lambda k: F.array_contains(grams, F.get(s, k - 1)))
            return F.array_min(F.transform(at_hit, lambda k: to(s, k)))

        return let(run, lambda s: F.when(F.size(F.array_intersect(s, grams)) >= part["need"], ends(s)))

    starts = F.filter(hits, lambda x: F.array_contains(grams, x["pair"]))
    return F.filter(F.transform(starts, lambda x: best(x["at"])), lambda x: x.isNotNull())


def scan(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """``(doc, unit, template, dice)`` of all matches; unit 0 is the whole text, others are lines from 1 and passages as -1 - their first word's place."""
    parts = parts_of(templates or TEMPLATES, percent)
    found = marks(templates or TEMPLATES, percent)
    known = F.array(*[F.struct(F.lit(p["template"]).alias("template"), F.array(*map(F.lit, p["grams"])).alias("grams"), F.lit(p["need"]).alias("need"), F.lit(p["longest"]).alias("longest")) for p in parts])
    grams = sorted({g for p in parts for g in p["grams"]})
    body = lower_ascii(F.coalesce(F.col(text).cast("string"), F.lit("")))
    texts = docs.select(F.col(id_col).alias("doc"), F.explode(F.array(body)).alias("body")).filter(marked(F.col("body"), found))
    lines = lines_of(F.col("body"))
    units = texts.select("doc", F.posexplode(F.when(F.size(lines) > 1, F.concat(F.array("body"), lines)).otherwise(F.array("body"))).alias("unit", "part"))
    units = once(units.filter(marked(F.col("part"), found)), words=words(F.col("part")))
    units = once(units.filter(F.size("words") > min(p["need"] for p in parts)), pairs=pairs_of(F.col("words"))).drop("words")
    units = once(units, hits=F.filter(F.transform("pairs", lambda p, i: F.struct(i.alias("at"), p.alias("pair"))), lambda x: x["pair"].isin(grams)))
    units = once(units, has=F.array_distinct(F.col("hits.pair"))).filter(F.size("has") > 0)
    fits = F.filter(known, lambda p: F.size(F.array_intersect(F.col("has"), p["grams"])) >= p["need"])
    units = once(units.select("*", F.explode(fits).alias("fit")), size=F.size(F.array_distinct("pairs")), common=F.size(F.array_intersect(F.col("has"), F.col("fit.grams"))))
    fit, whole = F.col("fit"), enough(F.col("common"), F.col("size"), F.col("fit"), percent)
    none = F.array().cast("array<struct<d: double, start: int, last: int>>")
    units = once(units, runs=F.when((F.col("unit") == 0) & ~whole, passages(F.col("pairs"), F.col("hits"), fit, percent)).otherwise(none))
    units = units.filter(whole | (F.size("runs") > 0))
    units = once(units, line_words=F.when(F.size("runs") > 0, F.transform(lines_of(F.col("part")), words)))
    line = once(
        units,
        line_of=F.flatten(F.transform("line_words", lambda ws, i: F.array_repeat(i, F.size(ws)))),
        line_fits=F.transform("line_words", lambda ws: let(F.array_distinct(pairs_of(ws)), lambda b: enough(F.size(F.array_intersect(b, fit["grams"])), F.size(b), fit, percent))),
    )
    alone = F.filter("runs", lambda x: ~F.exists(F.sequence(F.get("line_of", x["start"]), F.get("line_of", x["last"])), lambda i: F.get("line_fits", i)))
    apart = F.aggregate(
        F.array_sort(alone), none, lambda kept, x: F.when(F.exists(kept, lambda k: (k["start"] <= x["last"]) & (x["start"] <= k["last"])), kept).otherwise(F.concat(kept, F.array(x)))
    )
    own = F.struct(F.col("unit").alias("unit"), (F.col("common") * 2 / (F.col("size") + F.size(fit["grams"]))).alias("dice"))
    match = F.when(whole, F.array(own)).otherwise(F.transform(apart, lambda x: F.struct((-1 - x["start"]).alias("unit"), (-x["d"]).alias("dice"))))
    return line.select("doc", fit["template"].alias("template"), F.explode(match).alias("match")).select("doc", "match.unit", "template", "match.dice")


def licences(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``(id, n_units, best_template, best_dice)`` of the documents with a match."""
    best = F.min(F.struct((-F.col("dice")).alias("d"), "template"))
    found = scan(docs, id_col=id_col, **options).groupBy("doc").agg(F.countDistinct("unit").alias("n_units"), best.alias("best"))
    return found.select(F.col("doc").alias(id_col), "n_units", F.col("best.template").alias("best_template"), F.round(-F.col("best.d"), 6).alias("best_dice"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_VALUES = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in TEMPLATES.items())
_WORDS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP8_SQL = f"""
WITH t AS (SELECT template, {_WORDS.format("body")} AS w FROM (VALUES {_VALUES}) AS v(template, body)),
tb AS (SELECT DISTINCT template, w[i] || ' ' || w[i + 1] AS bigram FROM (SELECT template, w, unnest(generate_series(1, len(w) - 1)) AS i FROM t)),
ts AS (SELECT template, count(*) AS m FROM tb GROUP BY template),
lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS part, generate_subscripts(string_split(text, chr(10)), 1) AS unit
  FROM documents WHERE text LIKE '%' || chr(10) || '%'
  UNION ALL SELECT doc_id, text AS part, 0 AS unit FROM documents WHERE text IS NOT NULL),
u AS (SELECT doc_id, unit, {_WORDS.format("part")} AS w FROM lines),
ub AS (SELECT DISTINCT doc_id, unit, w[i] || ' ' || w[i + 1] AS bigram FROM (SELECT doc_id, unit, w, unnest(generate_series(1, len(w) - 1)) AS i FROM u WHERE len(w) > 1)),
us AS (SELECT doc_id, unit, count(*) AS n FROM ub GROUP BY doc_id, unit),
c AS (SELECT doc_id, unit, template, count(*) AS common FROM ub JOIN tb USING (bigram) GROUP BY doc_id, unit, template),
d AS (SELECT doc_id, unit, template, 2.0 * common / (n + m) AS dice FROM c JOIN us USING (doc_id, unit) JOIN ts USING (template) WHERE common * 200 >= (n + m) * {PERCENT})
SELECT doc_id, count(DISTINCT unit)::BIGINT AS n_units, first(template ORDER BY dice DESC, template) AS best_template, round(max(dice)::DOUBLE, 6) AS best_dice
FROM d GROUP BY doc_id
"""
