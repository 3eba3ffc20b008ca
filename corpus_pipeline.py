"""A corpus from documents to token files, in stages that are written and read again.

Quality classifier (documents scored under 0.5 go), near duplicates by word 5-grams at
Jaccard 0.8 (the smallest id of each group stays), benchmark decontamination (documents
with a passage of 10 words of an item go), mixing of sources to their target weights
(documents repeat as often as they are taken), and token files. Each function works on
all that the one before kept. Columns that documents have besides their usual ones stay.

Rows are told apart by what they hold: a near duplicate by its id and text, a leak by its text.
So rows with the same id, or none, are judged each by itself, and of equal rows one stays.
Columns of any name stay as they are. Documents with null or empty texts pass as far as
their score lets them; without words they have no duplicates and no leaks and are never
taken more than twice. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import decontamination, ngram_join, quality, source_mixing, token_output
from gridloom.llm.lm_scoring import held_out
from gridloom.operators.tables import broadcast_if_small, materialize, new_path

BROADCAST_TEXTS = 500_000


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out(F.col("doc_id"), 3))
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), "text", "n_chars")
    return quality.score(quality.fit(docs, labels), rows, ["row"]).filter("score >= 0.5").select("row.*")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.without_copies(docs, width=5, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    leaks = materialize(found.filter("n_hit > 0").select(F.col("t1").alias("l1"), F.col("t2").alias("l2")).distinct(), "pipeline-leaks")
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), *decontamination.text_digest(F.col("text")))
    return rows.join(broadcast_if_small(leaks, BROADCAST_TEXTS), (F.col("t1") == F.col("l1")) & (F.col("t2") == F.col("l2")), "left_anti").select("row.*")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return source_mixing.taken(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_output.digests(token_output.write(docs, new_path(spark, "tokens"), meta=("lang", "source")))


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources", mixing_stage),
    ("token output", token_stage),
]

#: The classifier's weights and the token ids have no SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
