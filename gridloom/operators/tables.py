"""Tables that a job writes once and reads again.

They lie in the folder that ``spark.checkpoint.dir`` names, which the driver
and all executors share, so a lost executor loses none of them.
"""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder. A temporary one where the session names none, which only a local session may do."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Shuffle files of a finished write are of no more use.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return the table read back."""
    spark = df.sparkSession
    path, before = new_path(spark, name), spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    _paths[table] = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` returned and that no later result reads."""
    for table in tables:
        path, spark = _paths.pop(table), table.sparkSession
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def numbered(df: DataFrame, name: str, column: str, **options: str) -> DataFrame:
    """``df`` stored with a number of its own for each row, so that equal rows and rows without an id differ."""
    return materialize(df.withColumn(column, F.monotonically_increasing_id()), name, **options)


def broadcast_if_small(df: DataFrame, rows: int, weight: Column | None = None) -> DataFrame:
    """``df`` with a broadcast hint if it has ``rows`` rows at most; else as it is, for a shuffle.

    ``weight`` counts a row as several (at least one), for rows that hold arrays. ``df`` runs twice, so store it first if it is dear.
    """
    if weight is None:
        small = df.limit(rows + 1).count() <= rows
    else:
        small = (df.select(F.greatest(weight, F.lit(1)).cast("long").alias("n")).limit(rows + 1).agg(F.sum("n")).head()[0] or 0) <= rows
    return F.broadcast(df) if small else df
