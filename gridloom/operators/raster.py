"""Rasters as rows ``(row, col, value)``; null is a cell without value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 256


def slope(cells: DataFrame, cell_size: float, height: int | None = None, width: int | None = None, one_sided: bool = False, scale: float = 1.0) -> DataFrame:
    """``(row, col, slope)`` in degrees; null where a cell or a side that it needs has no value.

    Differences are central. At the edges of a raster of ``height`` x ``width`` cells (where
    given) they go to the one neighbour, and with ``one_sided`` also beside cells without value.
    Values are multiplied by ``scale`` first. Each cell is sent to its four neighbours and
    summed there, so no row or column of the raster has to fit in a task.
    """
    to = lambda dr, dc, name: F.struct((F.col("row") + dr).alias("row"), (F.col("col") + dc).alias("col"), F.lit(name).alias("side"), (F.col("value") * scale).alias("value"))
    sent = cells.select(F.explode(F.array(to(0, 0, "own"), to(0, 1, "west"), to(0, -1, "east"), to(1, 0, "north"), to(-1, 0, "south"))).alias("s")).select("s.*")
    sides = [F.max(F.when(F.col("side") == s, F.col("value"))).alias(s) for s in ("own", "west", "east", "north", "south")]
    near = sent.groupBy("row", "col").agg(*sides, F.max(F.when(F.col("side") == "own", 1)).alias("inside")).filter("inside = 1")

    def step(low: str, high: str, at: str, size: int | None) -> Column:
        before, own, after = F.col(low), F.col("own"), F.col(high)
        first, last = (F.lit(False), F.lit(False)) if size is None else (F.col(at) == 0, F.col(at) == size - 1)
        forward, backward = first | (F.lit(one_sided) & before.isNull()), last | (F.lit(one_sided) & after.isNull())
        central = (after - before) / (2 * cell_size)
        return F.when(central.isNotNull(), central).when(forward & after.isNotNull(), (after - own) / cell_size).when(backward & before.isNotNull(), (own - before) / cell_size)

    gradient = F.hypot(step("west", "east", "col", width), step("north", "south", "row", height))
    return near.select("row", "col", F.when(F.col("own").isNotNull(), F.degrees(F.atan(gradient))).alias("slope"))


def zonal(cells: DataFrame, height: int, width: int) -> DataFrame:
    """``(zone_row, zone_col, n, mean)`` over tiles of ``height`` x ``width`` cells."""
    tile = [F.floor(F.col("row") / height).alias("zone_row"), F.floor(F.col("col") / width).alias("zone_col")]
    return cells.groupBy(*tile).agg(F.count("value").alias("n"), F.avg("value").alias("mean"))
