"""Oversized polygons cut across their long axis, again and again, until their parts are small enough."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StructType

from gridloom.functions.geometry import _sides, _sum, polygon, ring
from gridloom.operators import overlay
from gridloom.operators.tables import discard, materialize


def canonical(dx: float, dy: float, tolerance: float = 1e-12) -> tuple[float, float]:
    """The unit vector along (dx, dy) that points to the right, or up if it is upright."""
    size = float(np.hypot(dx, dy))
    ux, uy = (0.0 if abs(v / size) <= tolerance else float(v / size) for v in (dx, dy))
    return (-ux + 0.0, -uy + 0.0) if ux < 0 or (ux == 0 and uy < 0) else (ux, uy)


def _hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, counter-clockwise."""
    points = np.unique(points, axis=0)

    def chain(some: np.ndarray) -> list:
        out: list = []
        for p in some:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(chain(points) + chain(points[::-1])) if len(points) > 2 else points


def long_axis(corners: np.ndarray) -> tuple[float, float] | None:
    """The direction of the long sides of the smallest rectangle around the corners; of equal sides the canonical direction that is less. Null without an area."""
    hull = _hull(corners)
    if len(hull) < 3:
        return None
    best: list[tuple[float, tuple[float, float]]] = []
    for a, b in zip(hull, np.roll(hull, -1, axis=0), strict=True):
        u = (b - a) / np.hypot(*(b - a))
        along, across = hull @ u, hull @ np.array([-u[1], u[0]])
        length, width = np.ptp(along), np.ptp(across)
        even = abs(length - width) <= 1e-12 * max(length, width)
        ways = [canonical(*u)] if length > width and not even else [canonical(-u[1], u[0])] if not even else [canonical(*u), canonical(-u[1], u[0])]
        best.append((float(length * width), min(ways)))
    least = min(area for area, _ in best)
    return min(way for area, way in best if area <= least * (1 + 1e-9))


@pandas_udf(StructType().add("dx", "double").add("dy", "double"))
def axis_of(shells: pd.Series) -> pd.DataFrame:
    """``long_axis`` of each ring."""
    found = [long_axis(np.array([(p["x"], p["y"]) for p in r], float)) if r is not None and len(r) else None for r in shells]
    return pd.DataFrame([w or (None, None) for w in found], columns=["dx", "dy"], dtype=float)


def moments(r: Column) -> Column:
    """``struct<area, mx, my>`` of a ring: its signed area, and that times its centroid."""
    cross = lambda f: _sum(_sides(r, lambda px, py, qx, qy: (px * qy - qx * py) * f(px, py, qx, qy)))
    return F.struct((cross(lambda *_: F.lit(1.0)) / 2).alias("area"), (cross(lambda px, py, qx, qy: px + qx) / 6).alias("mx"), (cross(lambda px, py, qx, qy: py + qy) / 6).alias("my"))


def centroid(part: Column) -> Column:
    """``struct<x, y, area>`` of a polygon with holes; null without an area."""
    total = lambda c: F.abs(moments(part["shell"])["area"]) if c == "area" else moments(part["shell"])[c] * F.signum(moments(part["shell"])["area"])
    gone = lambda c: _sum(F.transform(part["holes"], lambda h: F.abs(moments(h)["area"]) if c == "area" else moments(h)[c] * F.signum(moments(h)["area"])))
    area = total("area") - gone("area")
    return F.when(area > 0, F.struct(((total("mx") - gone("mx")) / area).alias("x"), ((total("my") - gone("my")) / area).alias("y"), area.alias("area")))


def split(blocks: DataFrame, max_area: float, cell: float, depth: int = 16) -> DataFrame:
    """``(id, path, part, area)``: the polygons of ``blocks (id, geom)``, those over ``max_area`` cut through their centroid across their long axis.

    All oversized parts are cut in the same round, as overlays with the two sides of their cut, so concave parts and holes may give
    more than two. ``path`` has a number for each cut that led to a part: its place among the parts of that cut by their smallest corners. After
    ``depth`` cuts a part stays as large as it is.
    """
    done, open_ = None, blocks.select("id", F.posexplode("geom").alias("n", "part")).select("id", F.col("n").cast("string").alias("path"), "part")
    for step in range(depth + 1):
        placed = materialize(open_.withColumn("c", centroid(F.col("part"))).withColumn("axis", axis_of("part.shell")), "split-parts")
        large = (F.coalesce(F.col("c.area"), F.lit(0.0)) > max_area) & F.lit(step < depth)
        ready = placed.filter(~large).select("id", "path", "part", F.coalesce("c.area", F.lit(0.0)).alias("area"))
        done = ready if done is None else done.unionByName(ready)
        large_ones = placed.filter(large)
        if large_ones.isEmpty():
            break
        group = ["id", "path", "hand"]
        sides = large_ones.withColumn("hand", F.explode(F.array(F.lit(1.0), F.lit(-1.0))))
        far = F.aggregate(F.col("part.shell"), F.lit(1.0), lambda m, p: F.greatest(m, 2 * F.hypot(p["x"] - F.col("c.x"), p["y"] - F.col("c.y"))))
        dx, dy = F.col("axis.dx") * F.col("far"), F.col("axis.dy") * F.col("far")
        # From one end of the cut to the other, and as far along the axis on this side.
        corner = lambda a, b: (F.col("c.x") - a * dy + b * F.col("hand") * dx, F.col("c.y") + a * dx + b * F.col("hand") * dy)
        sides = sides.withColumn("far", far).withColumn("half", ring(corner(1, 0), corner(-1, 0), corner(-1, 1), corner(1, 1)))
        layer = lambda name, geom: sides.select(*group, F.lit(name).alias("layer"), F.lit(0).alias("polygon"), F.array(geom).alias("geom"))
        labels = overlay.labelled(layer("a", F.col("part")).unionByName(layer("b", polygon(F.col("half")))), group, cell)
        cut = overlay.polygons_of(overlay.boundary(labels, group, overlay.INTERSECTION), group, cell)
        pieces = cut.groupBy("id", "path").agg(F.array_sort(F.flatten(F.collect_list("geom"))).alias("parts"))  # of one part
        open_ = materialize(pieces.select("id", "path", F.posexplode("parts").alias("n", "part")).select("id", F.concat("path", F.lit("."), F.col("n")).alias("path"), "part"), "split-open")
        discard(labels)
    return done
