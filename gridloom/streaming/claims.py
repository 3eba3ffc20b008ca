"""Idempotent claims on a stream of files: each key is delivered once, over restarts too."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridloom.operators.tables import new_path


def claim(spark: SparkSession, source: str, keys: list[str], state: str | None = None) -> DataFrame:
    """The distinct ``keys`` of the Parquet files that match ``source``, delivered by a stream.

    ``state`` is a folder that every executor sees; a run with the same one goes on where
    the last ended and delivers new keys only. Rows with a null key are a key of their own.
    """
    state = state or new_path(spark, "claims")
    schema = spark.read.parquet(source).schema
    stream = spark.readStream.schema(schema).parquet(source).select(*keys).dropDuplicates(keys)
    writer = stream.writeStream.format("parquet").option("checkpointLocation", f"{state}/log").option("path", f"{state}/claimed")
    writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{state}/claimed")
