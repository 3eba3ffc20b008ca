"""Rasters on grids: stored windows, target grids and resampling by an inverse map."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Grid:
    """A raster's upper left corner, its size of a cell and its number of rows and columns."""

    left: float
    top: float
    cell_x: float
    cell_y: float
    height: int
    width: int

    def bounds(self) -> tuple[float, float, float, float]:
        """West, south, east, north."""
        return self.left, self.top - self.height * self.cell_y, self.left + self.width * self.cell_x, self.top

    def centre(self, row: Column, col: Column) -> tuple[Column, Column]:
        return F.lit(self.left) + (col + 0.5) * self.cell_x, F.lit(self.top) - (row + 0.5) * self.cell_y

    def place(self, x: Column, y: Column) -> tuple[Column, Column]:
        """Rows and columns, with fractions, of coordinates."""
        return (F.lit(self.top) - y) / self.cell_y, (x - self.left) / self.cell_x


def target_grid(bounds: tuple[float, float, float, float], cell_x: float, cell_y: float, clip: tuple[float, float, float, float] | None = None) -> Grid:
    """The grid over ``bounds`` (west, south, east, north), or over what ``clip`` leaves of them; it ends in whole cells."""
    west, south, east, north = bounds
    if clip:
        west, south, east, north = max(west, clip[0]), max(south, clip[1]), min(east, clip[2]), min(north, clip[3])
    if not (west < east and south < north):
        raise ValueError("nothing of the raster is left")
    if not (0 < cell_x < math.inf and 0 < cell_y < math.inf):
        raise ValueError("cells must have a positive size")
    return Grid(west, north, cell_x, cell_y, max(1, math.ceil((north - south) / cell_y)), max(1, math.ceil((east - west) / cell_x)))


def grid_cells(spark: SparkSession, grid: Grid) -> DataFrame:
    """``(row, col)`` of every cell."""
    return spark.range(grid.height * grid.width).select(F.floor(F.col("id") / grid.width).alias("row"), F.pmod("id", F.lit(grid.width)).alias("col"))


def resample(cells: DataFrame, source: Grid, target: Grid, method: str = "nearest", to_source: Callable[[Column, Column], tuple[Column, Column]] | None = None) -> DataFrame:
    """``(row, col, value)`` of every cell of ``target`` from ``cells (row, col, value)`` of ``source``.

    ``to_source`` takes coordinates of the target to those of the source. ``nearest`` takes the cell that holds the centre; ``bilinear`` weighs the
    four whose centres surround it, those without a value left out. Null is a cell without value, and so is all beyond
    the source. Each target cell asks for the source cells it needs by a join, so no window is read whole.
    """
    rows = grid_cells(cells.sparkSession, target)
    x, y = target.centre(F.col("row"), F.col("col"))
    v, u = source.place(*(to_source(x, y) if to_source else (x, y)))
    rows = rows.select("row", "col", v.alias("v"), u.alias("u"))
    if method == "nearest":
        asked = rows.select("row", "col", F.floor("v").alias("r"), F.floor("u").alias("c"), F.lit(1.0).alias("w"))
    elif method == "bilinear":
        low_v, low_u = F.floor(F.col("v") - 0.5), F.floor(F.col("u") - 0.5)
        rows = rows.select("row", "col", low_v.alias("r"), low_u.alias("c"), (F.col("v") - 0.5 - low_v).alias("fv"), (F.col("u") - 0.5 - low_u).alias("fu"))
        corner = lambda i, j: F.struct((F.col("r") + i).alias("r"), (F.col("c") + j).alias("c"), ((F.col("fv") if i else 1 - F.col("fv")) * (F.col("fu") if j else 1 - F.col("fu"))).alias("w"))
        asked = rows.select("row", "col", F.inline(F.array(*[corner(i, j) for i in (0, 1) for j in (0, 1)])))
    else:
        raise ValueError(f"no method {method}")
    known = cells.filter("value is not null").filter(F.col("row").between(0, source.height - 1) & F.col("col").between(0, source.width - 1)).select(F.col("row").alias("r"), F.col("col").alias("c"), "value")
    met = asked.join(known, ["r", "c"], "left").withColumn("w", F.when(F.col("value").isNotNull(), F.col("w")))
    return met.groupBy("row", "col").agg(F.try_divide(F.sum(F.col("w") * F.col("value")), F.sum("w")).alias("value"))


def write_windows(cells: DataFrame, path: str, size: int = 256) -> None:
    """Store a raster as windows of ``size`` x ``size`` cells: one row each, its values by rows and null where there is none."""
    if size * size > 1 << 22:
        raise ValueError("windows must be smaller")
    placed = cells.filter("value is not null").select(F.floor(F.col("row") / size).alias("wr"), F.floor(F.col("col") / size).alias("wc"), (F.pmod("row", F.lit(size)) * size + F.pmod("col", F.lit(size))).cast("int").alias("at"), F.col("value").cast("double").alias("value"))
    held = placed.groupBy("wr", "wc").agg(F.sort_array(F.collect_list(F.struct("at", "value"))).alias("cells"))
    held.repartitionByRange("wr", "wc").sortWithinPartitions("wr", "wc").write.parquet(path)


def read_window(spark: SparkSession, path: str, row: int, col: int, height: int, width: int, size: int = 256, halo: int = 0) -> DataFrame:
    """``(row, col, value)`` of every cell of a window, widened by ``halo`` cells on all sides; null where there is no value.

    Only stored windows that the asked one touches are read, by a filter that reaches the scan.
    """
    if min(height, width) <= 0 or halo < 0:
        raise ValueError("a window has cells")
    r0, c0, r1, c1 = row - halo, col - halo, row + height + halo, col + width + halo
    held = spark.read.parquet(path).filter(F.col("wr").between(r0 // size, (r1 - 1) // size) & F.col("wc").between(c0 // size, (c1 - 1) // size))
    found = held.select("wr", "wc", F.inline("cells")).select((F.col("wr") * size + F.floor(F.col("at") / size)).alias("row"), (F.col("wc") * size + F.pmod("at", F.lit(size))).alias("col"), "value")
    wanted = grid_cells(spark, Grid(0.0, 0.0, 1.0, 1.0, r1 - r0, c1 - c0)).select((F.col("row") + r0).alias("row"), (F.col("col") + c0).alias("col"))
    return wanted.join(found, ["row", "col"], "left")


def window_sums(cells: DataFrame, height: int, width: int, rows: int, columns: int) -> DataFrame:
    """``(zone_row, zone_col, total, cells, missing)`` over tiles of a raster of ``rows`` x ``columns`` cells; cells that have no row are missing, too."""
    tile = [F.floor(F.col("row") / height).alias("zone_row"), F.floor(F.col("col") / width).alias("zone_col")]
    inside = cells.filter(F.col("row").between(0, rows - 1) & F.col("col").between(0, columns - 1))
    held = inside.groupBy(*tile).agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("total"), F.count("value").alias("cells"))
    size = (F.least(F.lit(rows), (F.col("zone_row") + 1) * height) - F.col("zone_row") * height) * (F.least(F.lit(columns), (F.col("zone_col") + 1) * width) - F.col("zone_col") * width)
    return held.withColumn("missing", size - F.col("cells"))
