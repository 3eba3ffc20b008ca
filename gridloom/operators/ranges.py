"""Places, ranks and running sums in an order over all rows, without a window over a whole group.

Rows are dealt to partitions by ranges of (group, order) and stored with their partition's
number. A window runs inside each (partition, group); what the partitions before it
hold of the group is added from one row per (partition, group), of which there are no more than
partitions and groups together. So a group, and the table as one group, may be of any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.tables import materialize


def running(rows: DataFrame, group: list[str], order: list[Column], sums: dict[str, str], place: str = "place") -> DataFrame:
    """``rows`` with ``place`` (from 1) and, for each ``name: column`` of ``sums``, the running sum ``name``.

    Both count within the group, in ``order``, the row's own included. Rows that are equal in group and order go to one partition,
    so ``order`` should tell rows apart: count equal ones first, as ``competition_rank`` does.
    ``name_all`` is the sum of the whole group and ``place_all`` its number of rows. Nulls are a group;
    null summands count as 0.
    """
    keys = [F.col(g).asc_nulls_first() for g in group]
    placed = rows.withColumn(place, F.lit(1).cast("long"))
    for name, column in sums.items():
        placed = placed.withColumn(name, F.coalesce(F.col(column), F.lit(0).cast(rows.schema[column].dataType)))
    names = [place, *sums]
    placed = materialize(placed.repartitionByRange(*keys, *order).withColumn("__part", F.spark_partition_id()), "range-rows")
    totals = placed.groupBy("__part", *group).agg(*[F.sum(n).alias(f"__{n}") for n in names])
    mine = Window.partitionBy(*(group or [F.lit(0)]))
    before = mine.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        F.col("__part").alias("__of"), *[F.col(g).alias(f"__group{i}") for i, g in enumerate(group)],
        *[F.coalesce(F.sum(f"__{n}").over(before), F.lit(0)).alias(f"__before_{n}") for n in names], *[F.sum(f"__{n}").over(mine).alias(f"{n}_all") for n in names],
    )
    same = F.col("__part") == F.col("__of")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"__group{i}"))
    inside = Window.partitionBy("__part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    counted = placed.select(*[c for c in placed.columns if c not in names], *[F.sum(n).over(inside).alias(n) for n in names])
    joined = counted.join(offsets, same)
    return joined.select(*rows.columns, *[(F.col(n) + F.col(f"__before_{n}")).alias(n) for n in names], *[f"{n}_all" for n in names])


def competition_rank(rows: DataFrame, value: str, group: list[str] | None = None, rank: str = "rank", rising: bool = False) -> DataFrame:
    """``rows`` with ``rank``: 1, 2, 2, 4, ... by falling (or rising) ``value`` within ``group``; null values have none.

    Equal values are counted before they are put in order, so only distinct ones are ranked. ``rows`` are stored first: a value that is
    a sum may differ in its last digit when it is found again, and would then not meet its own rank.
    """
    group = group or []
    rows = materialize(rows, "ranked-rows")
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("__n"))
    order = F.col(value).asc() if rising else F.col(value).desc()
    ranked = running(counts, group, [order], {"__upto": "__n"}, "__place")
    ranked = ranked.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)], F.col(value).alias("__value"), (F.col("__upto") - F.col("__n") + 1).cast("int").alias(rank))
    same = F.col(value) == F.col("__value")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    return rows.join(ranked, same, "left").select(*rows.columns, rank)
