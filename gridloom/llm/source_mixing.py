"""Mixing sources to target weights by hash thresholds.

Every document has a fixed hash. A source that is to give ``t`` words of its ``n``
gives all documents ``floor(t / n)`` times and, once more, those whose hash lies under
the source's threshold. Thresholds come from histograms: words by source and leading
hash bits; the running sum of a source's buckets finds the bucket where the rest of
the budget ends, and only documents of that bucket are counted again by their next
bits, until each source's bucket holds one document or the bits are used up. So no document
is sorted or moved to find a threshold, thresholds are nested (a larger budget takes a
superset), and reruns agree. The hash is of the id; where that leaves several rows in a bucket
(repeated or null ids), bits of a hash of what the row holds follow, and only for equal rows bits of the stored
row's own number.

Targets are ``share * total`` by weight; a target stops at ``cap`` times its source's
words and the excess goes to the others by weight. Sources rank by code point, null
last, and null is a source. Null texts have no words. Sources without words get 0, and so
does each of their documents. No document is taken more than ``cap`` times, one without words
neither. Columns of any name stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.operators.ranges import running
from gridloom.operators.tables import broadcast_if_small, materialize, numbered

WEIGHTS = (5.0, 2.0, 1.0)
LEVEL_BITS = 12
#: Levels of one hash; those of the row follow, of what it holds and then of its number.
LEVELS = 5
ROW_BITS = 28
BROADCAST_SOURCES = 100_000
WORDS = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def _bucket(level: int) -> Column:
    """Bits ``level * LEVEL_BITS`` on of the 60 leading bits of the id's hash and then of the row's."""
    return F.shiftrightunsigned("h1" if level < LEVELS else "h2", 64 - (level % LEVELS + 1) * LEVEL_BITS).bitwiseAND((1 << LEVEL_BITS) - 1)


def _leading(h: str) -> Column:
    return F.shiftrightunsigned(h, 64 - LEVELS * LEVEL_BITS)


def row_hash(content: list[Column], uid: Column) -> Column:
    """The leading bits of a hash of ``content``, then ``ROW_BITS`` of one of the row's number."""
    return F.shiftleft(F.shiftrightunsigned(F.xxhash64(F.lit("row"), *content), ROW_BITS), ROW_BITS).bitwiseOR(F.shiftrightunsigned(F.xxhash64(uid), 64 - ROW_BITS))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """``(source, source_size, weight, target)`` from ``(source, source_size)``.

    Sources reach their cap in the order of cap by weight. The sources before the first
    that fits its share of what is left are capped; the others split that rest.
    """
    t = running(sizes.withColumn("unnamed", F.col("source").isNull()), [], [F.col("unnamed").asc(), F.col("source").asc()], {}, "rank")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    t = t.select("source", "source_size", "unnamed", weight.alias("weight"), (F.col("source_size") * F.lit(cap)).alias("limit"))
    t = t.withColumn("reached", F.col("limit") / F.col("weight"))
    t = running(t, [], [F.col("reached").asc(), F.col("unnamed").asc(), F.col("source").asc()], {"limits": "limit", "heavier": "weight"})
    budget = F.col("limits_all") / cap * share
    level = (budget - (F.col("limits") - F.col("limit"))) / (F.col("heavier_all") - F.col("heavier") + F.col("weight"))
    t = materialize(t.withColumn("level", level), "mix-levels")
    first = t.filter(F.col("level") * F.col("weight") <= F.col("limit")).agg(F.min(F.struct("reached", "level")).alias("fits")).select(F.col("fits.level").alias("fit"))
    target = F.least(F.col("limit"), F.coalesce(F.col("fit") * F.col("weight"), F.col("limit")))
    return t.join(F.broadcast(first)).select("source", "source_size", "weight", target.alias("target"))  # one row


def thresholds(sized: DataFrame, plan: DataFrame, cap: float = 2.0) -> DataFrame:
    """``plan`` with ``copies`` and the thresholds ``under1`` and ``under2``.

    A document counts once more if the 60 leading bits of its two hashes, one after the
    other, are below the thresholds. ``sized`` has (source, size, h1, h2). One histogram per
    level; below the first, only of each source's boundary bucket.
    """
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    zero = F.lit(0).cast("long")
    plan = plan.withColumn("copies", whole).withColumn("left", F.col("target") - F.col("copies") * F.col("source_size")).withColumn("under1", zero).withColumn("under2", zero)
    # Without words left to take nobody is below the threshold.
    plan = materialize(plan.withColumn("open", (F.col("left") > 0) & (F.col("copies") < F.lit(cap))), "mix-plan")
    for level in range(2 * LEVELS):
        before = level % LEVELS
        inside = F.shiftrightunsigned("h1" if level < LEVELS else "h2", 64 - before * LEVEL_BITS) == F.col("under1" if level < LEVELS else "under2") if before else F.lit(True)
        if level >= LEVELS:
            inside = inside & (_leading("h1") == F.col("under1"))
        open_ = broadcast_if_small(plan.filter("open").select(F.col("source").alias("s"), "under1", "under2"), BROADCAST_SOURCES)
        counted = (
            sized.join(open_, F.col("source").eqNullSafe(F.col("s")))
            .filter(inside)
            .groupBy("source", _bucket(level).alias("bucket"))
            .agg(F.sum("size").alias("words"), F.count("*").alias("rows"))
            .withColumn("sum", F.sum("words").over(Window.partitionBy("source").orderBy("bucket")))
            .select(F.col("source").alias("s"), "bucket", "sum", "words", "rows")
        )
        counted = counted.join(broadcast_if_small(plan.select("source", "left"), BROADCAST_SOURCES), F.col("s").eqNullSafe(F.col("source")))
        # The boundary is the first bucket that goes beyond what is left.
        cut = counted.filter(F.col("sum") > F.col("left")).groupBy("s").agg(F.min(F.struct("bucket", (F.col("sum") - F.col("words")).alias("before"), "words", "rows")).alias("cut"))
        last = F.lit((1 << LEVEL_BITS) - 1)
        alone = F.coalesce(F.col("cut.rows") == 1, F.lit(False)) | F.lit(level == 2 * LEVELS - 1)
        # At the end the boundary bucket itself is taken where that comes nearer.
        nearer = alone & F.coalesce((F.col("left") - F.col("cut.before")) * 2 > F.col("cut.words"), F.lit(False))
        here = F.coalesce("cut.bucket", last) + F.when(nearer, 1).otherwise(0)
        # A source that is done fills its bits down to the last of this hash.
        rest = (LEVELS - 1 - before) * LEVEL_BITS
        bits = lambda c: F.when(F.col("open"), F.when(alone, F.shiftleft(F.shiftleft(c, LEVEL_BITS) + here, rest)).otherwise(F.shiftleft(c, LEVEL_BITS) + here)).otherwise(F.col(c))  # noqa: B023, E731
        kept = [c for c in plan.columns if c not in ("left", "under1", "under2", "open")]
        after = plan.join(broadcast_if_small(cut, BROADCAST_SOURCES), F.col("source").eqNullSafe(F.col("s")), "left").select(
            *kept,
            (F.col("left") - F.when(F.col("open"), F.coalesce("cut.before", F.lit(0))).otherwise(0)).alias("left"),
            (bits("under1") if level < LEVELS else F.col("under1")).alias("under1"),
            (bits("under2") if level >= LEVELS else F.col("under2")).alias("under2"),
            (F.col("open") & ~alone).alias("open"),
        )
        plan = materialize(after, "mix-plan")
        if plan.filter("open").isEmpty():
            break
    return plan.drop("open")


def measured(docs: DataFrame, id_col: str = "doc_id", source: str = "source", text: str = "text", uid: str = "__uid") -> dict[str, Column]:
    """``source``, ``size`` and both hashes of stored rows numbered by ``uid``."""
    h2 = row_hash([F.col(text), F.col(source)], F.col(uid))
    return {"source": F.col(source), "size": n_words(F.col(text)), "h1": F.xxhash64(F.lit("mix"), F.col(id_col)), "h2": h2}


def plan_for(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """``(source, source_size, weight, target, copies, left, under1, under2)`` of every source of a stored ``sized``."""
    sizes = materialize(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    return thresholds(sized, materialize(targets(sizes, weights, share, cap), "mix-targets"), cap)


def copies() -> Column:
    """How often a row with its source's ``plan`` and its hashes ``h1`` and ``h2`` is taken."""
    below = (_leading("h1") < F.col("plan.under1")) | ((_leading("h1") == F.col("plan.under1")) & (_leading("h2") < F.col("plan.under2")))
    return F.col("plan.copies") + F.when(below, 1).otherwise(0)


def planned(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` (with source, h1, h2 among their columns) with the struct ``plan`` and ``copies``."""
    plan = broadcast_if_small(plan.select(F.struct(*plan.columns).alias("plan")), BROADCAST_SOURCES)
    return rows.join(plan, F.col("source").eqNullSafe(F.col("plan.source")), "left").withColumn("copies", copies())


def taken(docs: DataFrame, id_col: str = "doc_id", source: str = "source", text: str = "text", **options) -> DataFrame:
    """``docs`` with each row as often as the mix takes it."""
    rows = numbered(docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row")), "mix-docs", "__uid", compression="zstd")
    made = measured(rows, f"row.{id_col}", f"row.{source}", f"row.{text}")
    sized = materialize(rows.select(*[c.alias(name) for name, c in made.items()]), "mix-sizes")
    hashed = rows.select("row", *[made[name].alias(name) for name in ("source", "h1", "h2")])
    placed = planned(hashed, plan_for(sized, **options)).filter("copies > 0")
    return placed.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")


def mix(docs: DataFrame, id_col: str = "doc_id", source: str = "source", text: str = "text", **options) -> DataFrame:
    """``(id, size, source_size, target, taken)`` of every row; ``taken`` is ``size`` times its copies."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"), F.xxhash64(F.col(text)).alias("content"))
    rows = numbered(rows, "mix-sizes", "__uid")
    sized = rows.select("id", "source", "size", F.xxhash64(F.lit("mix"), "id").alias("h1"), row_hash([F.col("content"), F.col("source")], F.col("__uid")).alias("h2"))
    placed = planned(sized, plan_for(sized, **options))
    return placed.select(F.col("id").alias(id_col), "size", "plan.source_size", "plan.target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
