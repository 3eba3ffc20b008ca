"""Counts, pages, fingerprints and export rows for runs and their features."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def durations(jobs: DataFrame, group: list[str], started: str, finished: str) -> DataFrame:
    """``group``, ``jobs`` and the sum of ``seconds`` from start to finish; jobs that did not finish add nothing."""
    took = F.col(finished) - F.col(started)
    part = lambda unit: F.extract(F.lit(unit), took).cast("double")
    seconds = part("DAY") * 86_400 + part("HOUR") * 3600 + part("MINUTE") * 60 + part("SECOND")
    return jobs.groupBy(*group).agg(F.count("*").alias("jobs"), F.coalesce(F.sum(seconds), F.lit(0.0)).alias("seconds"))


def over_limit(jobs: DataFrame, group: str, active: Column, limits: dict[str, int], more: int = 0) -> DataFrame:
    """``(group, active, allowed)``: active jobs of every limited group, 0 where it has none, and whether ``more`` of them still fit."""
    counts = jobs.filter(F.col(group).isin(*limits)).groupBy(group).agg(F.count_if(active).alias("active"))
    limited = jobs.sparkSession.createDataFrame([(k, n) for k, n in limits.items()], f"`{group}` string, __limit int")
    rows = limited.join(counts, group, "left").withColumn("active", F.coalesce("active", F.lit(0).cast("long")))
    return rows.select(group, "active", (F.col("active") + more <= F.col("__limit")).alias("allowed"))


def with_counts(runs: DataFrame, key: str, parts: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """``runs`` with the number of rows that each of ``parts`` (name: rows, key column) has for them, 0 where none.

    Parts are counted before they meet the runs.
    """
    for name, (rows, column) in parts.items():
        counts = rows.groupBy(F.col(column).alias("__key")).agg(F.count("*").alias(name))
        runs = runs.join(counts, F.col(key) == F.col("__key"), "left").drop("__key").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))
    return runs


def page(rows: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """At most ``limit`` rows after ``offset`` in ``order``, and whether there are more (``truncated``).

    One row more than the page is read, so nothing is counted.
    """
    taken = rows.orderBy(*order).offset(offset).limit(limit + 1)
    struct = F.struct(*rows.columns)
    listed = taken.agg(F.collect_list(struct).alias("rows"))
    listed = listed.select(F.inline(F.transform(F.slice("rows", 1, limit), lambda r: F.struct(r.alias("row"), (F.size("rows") > limit).alias("truncated")))))
    return listed.select("row.*", "truncated")


def latest(rows: DataFrame, group: str, order: str, key: str) -> DataFrame:
    """The latest row of each group by ``order``, then the smallest ``key``."""
    best = F.max(F.struct(order, (-F.col(key)).alias("__turn"), F.struct(*rows.columns).alias("row")))
    return rows.groupBy(group).agg(best.alias("best")).select("best.row.*")


def stitched(parents: DataFrame, children: DataFrame, key: str, foreign: str, child: str) -> DataFrame:
    """``(key, children)``: the sorted ``child`` values of each parent, empty where it has none."""
    lists = children.join(parents.select(F.col(key).alias("__key")), F.col(foreign) == F.col("__key"), "left_semi").groupBy(foreign).agg(F.array_sort(F.collect_list(child)).alias("children"))
    kind = lists.schema["children"].dataType.simpleString()
    return parents.select(key).join(lists, F.col(key) == F.col(foreign), "left").select(key, F.coalesce("children", F.array().cast(kind)).alias("children"))


def fold_status(jobs: DataFrame, batch: str, status: str) -> DataFrame:
    """``(batch, status)``: running until all its jobs have ended, then failed before cancelled before succeeded."""
    ended = F.count_if(F.col(status).isin("failed", "cancelled", "succeeded")) == F.count("*")
    has = lambda s: F.count_if(F.col(status) == s) > 0
    return jobs.groupBy(batch).agg(F.when(~ended, "running").when(has("failed"), "failed").when(has("cancelled"), "cancelled").otherwise("succeeded").alias("status"))


def validation_summary(results: DataFrame, run: str) -> DataFrame:
    """``(run, violations, hard, soft, spatial)`` of results ``(run, passed, hard, has_geometry)``."""
    failed = ~F.col("passed")
    return results.groupBy(run).agg(
        F.count_if(failed).alias("violations"), F.count_if(failed & F.col("hard")).alias("hard"), F.count_if(failed & ~F.col("hard")).alias("soft"), F.count_if(failed & F.col("has_geometry")).alias("spatial")
    )


def constraint_metrics(results: DataFrame, run: str) -> DataFrame:
    """``(run, hard_violation_count, weighted_soft_penalty)`` of results ``(run, passed, hard, penalty, weight)``."""
    soft = F.when(~F.col("passed") & ~F.col("hard"), F.col("penalty") * F.col("weight")).otherwise(0.0)
    return results.groupBy(run).agg(F.count_if(~F.col("passed") & F.col("hard")).alias("hard_violation_count"), F.sum(soft).alias("weighted_soft_penalty"))


def fingerprint(*columns: str) -> Column:
    """SHA-256, in hex, of a row's columns as JSON with sorted keys; nulls are written, so they count."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def keyed_seed(seed: Column, *keys: Column) -> Column:
    """A random seed of 60 bits of its own for each list of keys, from the leading bits of a SHA-256.

    Each key goes with its length in bytes before it and null as ``n``, so no two lists of keys are written alike.
    """
    text = lambda k: F.coalesce(F.concat(F.octet_length(k.cast("string")), F.lit(":"), k.cast("string")), F.lit("n"))
    return F.conv(F.substring(F.sha2(F.concat(*map(text, [seed, *keys])), 256), 1, 15), 16, 10).cast("long")


def uuid5(namespace: str, name: Column) -> Column:
    """The version 5 UUID of a name, by SHA-1, in the namespace (a UUID as text)."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    part = lambda a, n: F.substring(digest, a, n)
    variant = F.substring(F.lower(F.hex(F.conv(part(17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8))), -1, 1)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def feature_id(dataset: Column, own: Column, place: Column) -> Column:
    """The feature's own id, or one made from its dataset and place where it has none."""
    text = F.trim(own.cast("string"))
    return F.when(F.coalesce(text, F.lit("")) != "", text).otherwise(F.concat(dataset.cast("string"), F.lit(":"), place.cast("string")))


def csv_line(*columns: str) -> Column:
    """Columns as one line of CSV: nulls are empty, and fields with quotes, commas or line breaks are quoted."""
    def field(c: str) -> Column:
        text = F.coalesce(F.col(c).cast("string"), F.lit(""))
        quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
        return F.when(text.rlike('[",\\r\\n]'), quoted).otherwise(text)

    return F.concat_ws(",", *[field(c) for c in columns])


def viewport(features: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """Features whose box ``(min_x, min_y, max_x, max_y)`` touches the window; plain comparisons, so they reach the scan."""
    return features.filter((F.col("max_x") >= x0) & (F.col("min_x") <= x1) & (F.col("max_y") >= y0) & (F.col("min_y") <= y1))


def even_places(n: Column, count: int) -> Column:
    """At most ``count`` places from 0 to ``n - 1``, first and last among them, spread evenly."""
    spread = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.floor(i * (n - 1) / F.lit(max(count - 1, 1)) + 0.5).cast("int"))
    return F.when(n <= 0, F.array().cast("array<int>")).when(n <= count, F.sequence(F.lit(0), n.cast("int") - 1)).otherwise(F.array_distinct(spread))


def axis_angle(dx: Column, dy: Column) -> Column:
    """The direction of an axis in degrees, from 0 up to 180."""
    angle = F.pmod(F.degrees(F.atan2(dy, dx)), F.lit(180.0))
    return F.when((dx != 0) | (dy != 0), F.when(angle >= 180 - 1e-12, 0.0).otherwise(angle))


EARTH_M = 6_378_137.0


def mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Degrees as metres of the spherical Mercator projection; null beyond 85.06 degrees of latitude."""
    inside = lat.between(-85.06, 85.06)
    return F.radians(lon) * EARTH_M, F.when(inside, F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * EARTH_M)
