"""Union, intersection and difference of multipolygons, concave and with holes, by labels of the sides' two sides.

Polygons of a group lie in layers. All their sides are cut where they meet, in cells of a grid, so that the pieces meet at ends only. Each
piece then has a label to the left and to the right for each layer: whether a polygon of it lies there. A polygon that has the piece as its own
boundary lies on one side; for others a count of the sides that a ray from its middle crosses tells whether it lies on both.
The ray only meets sides of its strip of the grid. A piece bounds the result where the result holds on one of its sides alone. So
layers may have polygons that overlap, touch or share sides, and nothing is quadratic but what a cell or strip holds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.faces import ENDS, nested, rings, trace
from gridloom.operators.tables import discard, materialize

INTERSECTION: Callable[[Column, Column], Column] = lambda a, b: a & b
UNION: Callable[[Column, Column], Column] = lambda a, b: a | b
DIFFERENCE: Callable[[Column, Column], Column] = lambda a, b: a & ~b


def sides(polygons: DataFrame, digits: int = 9) -> DataFrame:
    """``polygons`` (with the multipolygon ``geom``) as rows (..., x1, y1, x2, y2) of its sides, which have the inside on their left.

    Shells turn counter-clockwise and holes clockwise whatever way they came. Coordinates are rounded; sides without length go.
    """
    others = [c for c in polygons.columns if c != "geom"]
    loops = F.flatten(F.transform("geom", lambda p: F.concat(F.array(F.struct(p["shell"].alias("ring"), F.lit(True).alias("shell"))), F.transform(p["holes"], lambda h: F.struct(h.alias("ring"), F.lit(False).alias("shell"))))))
    rows = polygons.select(*others, F.inline(loops)).withColumn("ring", F.transform("ring", lambda p: F.struct(F.round(p["x"], digits).alias("x"), F.round(p["y"], digits).alias("y"))))
    after = F.concat(F.slice("ring", F.lit(2), F.greatest(F.size("ring") - 1, F.lit(0))), F.slice("ring", 1, 1))
    rows = rows.filter(F.size("ring") > 2).withColumn("pairs", F.arrays_zip(F.col("ring").alias("p"), after.alias("q")))
    signed = F.aggregate("pairs", F.lit(0.0), lambda s, e: s + e["p"]["x"] * e["q"]["y"] - e["q"]["x"] * e["p"]["y"])
    rows = rows.withColumn("turn", (signed > 0) == F.col("shell")).select(*others, "turn", F.explode("pairs").alias("e"))
    ends = [F.when(F.col("turn"), F.col(f"e.{a}")).otherwise(F.col(f"e.{b}")).alias(n) for n, a, b in (("x1", "p.x", "q.x"), ("y1", "p.y", "q.y"), ("x2", "q.x", "p.x"), ("y2", "q.y", "p.y"))]
    return rows.select(*others, *ends).filter("x1 <> x2 or y1 <> y2")


def pieces(edges: DataFrame, group: list[str], cell: float, digits: int = 9) -> DataFrame:
    """Stored ``edges`` (group, edge, x1, y1, x2, y2), with a number of their own, cut where they meet others of their group."""
    span = lambda a, b: F.explode(F.sequence(F.floor(F.least(a, b) / cell), F.floor(F.greatest(a, b) / cell)))
    dealt = edges.select(*group, "edge", *ENDS, span("x1", "x2").alias("cx")).select("*", span("y1", "y2").alias("cy"))
    other = dealt.select(*group, "cx", "cy", F.col("edge").alias("o"), *[F.col(c).alias(f"o{c}") for c in ENDS])
    met = dealt.join(other, [*group, "cx", "cy"]).filter("edge <> o")
    low, high = lambda a, b: F.least(a, b), lambda a, b: F.greatest(a, b)
    touch = [(low(f"o{k}1", f"o{k}2") <= high(f"{k}1", f"{k}2")) & (low(f"{k}1", f"{k}2") <= high(f"o{k}1", f"o{k}2")) for k in "xy"]
    met = met.filter(touch[0] & touch[1])
    c = F.col
    # A pair's meeting point is found from the smaller edge, so both edges are cut at the same coordinates.
    swap = c("o") < c("edge")
    pick = lambda n: F.when(swap, c(f"o{n}")).otherwise(c(n))
    rest = lambda n: F.when(swap, c(n)).otherwise(c(f"o{n}"))
    rx, ry, sx, sy = pick("x2") - pick("x1"), pick("y2") - pick("y1"), rest("x2") - rest("x1"), rest("y2") - rest("y1")
    qx, qy = rest("x1") - pick("x1"), rest("y1") - pick("y1")
    cross = rx * sy - ry * sx
    t, u = F.try_divide(qx * sy - qy * sx, cross), F.try_divide(qx * ry - qy * rx, cross)
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    meet = F.when(t.between(0, 1) & u.between(0, 1), F.array(point(pick("x1") + t * rx, pick("y1") + t * ry)))
    along = F.when((cross == 0) & (qx * ry == qy * rx), F.array(point(c("ox1"), c("oy1")), point(c("ox2"), c("oy2"))))
    cuts = met.select(*group, "edge", *ENDS, F.explode(F.coalesce(meet, along)).alias("p"))
    # Most meet at an end, which cuts nothing; only the others are rounded, which is dear.
    cuts = cuts.filter(" and ".join(f"not (p.x = x{i} and p.y = y{i})" for i in (1, 2)))
    cuts = cuts.withColumn("p", point(F.round("p.x", digits), F.round("p.y", digits)))
    dx, dy = c("x2") - c("x1"), c("y2") - c("y1")
    at = ((c("p.x") - c("x1")) * dx + (c("p.y") - c("y1")) * dy) / (dx * dx + dy * dy)
    cuts = cuts.withColumn("t", at).filter("t > 0 and t < 1").groupBy("edge").agg(F.array_sort(F.collect_set(F.struct("t", "p.x", "p.y"))).alias("cuts"))
    end = lambda t, x, y: F.struct(F.lit(t).alias("t"), F.col(x).alias("x"), F.col(y).alias("y"))
    rows = edges.join(cuts, "edge", "left").withColumn("line", F.concat(F.array(end(0.0, "x1", "y1")), F.coalesce("cuts", F.array().cast("array<struct<t: double, x: double, y: double>>")), F.array(end(1.0, "x2", "y2"))))
    rows = rows.withColumn("steps", F.arrays_zip(F.slice("line", F.lit(1), F.size("line") - 1).alias("p"), F.slice("line", F.lit(2), F.size("line") - 1).alias("q")))
    others = [k for k in edges.columns if k not in ENDS]
    return rows.select(*others, F.explode("steps").alias("s")).select(*others, c("s.p.x").alias("x1"), c("s.p.y").alias("y1"), c("s.q.x").alias("x2"), c("s.q.y").alias("y2")).filter("x1 <> x2 or y1 <> y2")


def labelled(polygons: DataFrame, group: list[str], cell: float, digits: int = 9) -> DataFrame:
    """``(group, x1, y1, x2, y2, a_left, a_right, b_left, b_right)``, stored: pieces of all sides and whether layers ``a`` and ``b`` hold on each side.

    ``polygons``: (group, layer, polygon, geom), told apart by (layer, polygon). A layer holds wherever one of its polygons is.
    Equal geometries of a layer count once. Cells of side ``cell`` should be about as large as a side is long.
    """
    once = polygons.groupBy(*group, "layer", "geom").agg(F.min("polygon").alias("polygon"))
    edges = materialize(sides(once, digits).withColumn("edge", F.monotonically_increasing_id()), "overlay-edges")
    cut = materialize(pieces(edges, group, cell, digits), "overlay-pieces")
    flip = F.struct("x2", "y2") < F.struct("x1", "y1")
    ends = [F.when(flip, F.col(b)).otherwise(F.col(a)).alias(a) for a, b in zip(ENDS, [*ENDS[2:], *ENDS[:2]], strict=True)]
    of = [*group, "layer", "polygon"]
    own = cut.select(*of, *ends, flip.alias("flip")).groupBy(*of, *ENDS).agg(F.bool_or(~F.col("flip")).alias("left"), F.bool_or("flip").alias("right"))
    own = materialize(own, "overlay-own")
    middle = own.select(*group, *ENDS).distinct().select("*", ((F.col("x1") + F.col("x2")) / 2).alias("mx"), ((F.col("y1") + F.col("y2")) / 2).alias("my"))
    middle = middle.withColumn("strip", F.floor(F.col("my") / cell))
    strips = F.explode(F.sequence(F.floor(F.least("y1", "y2") / cell), F.floor(F.greatest("y1", "y2") / cell)))
    walls = edges.filter("y1 <> y2").select(*of, *[F.col(c).alias(f"w{c}") for c in ENDS], strips.alias("strip"))
    reach = F.col("wx1") + (F.col("my") - F.col("wy1")) / (F.col("wy2") - F.col("wy1")) * (F.col("wx2") - F.col("wx1"))
    rays = middle.join(walls, [*group, "strip"]).filter(((F.col("wy1") > F.col("my")) != (F.col("wy2") > F.col("my"))) & (reach > F.col("mx")))
    inside = rays.groupBy(*of, *ENDS).agg(F.count("*").alias("n")).filter("n % 2 = 1")
    inside = inside.join(own.select(*of, *ENDS), [*of, *ENDS], "left_anti").select(*of, *ENDS, F.lit(True).alias("left"), F.lit(True).alias("right"))
    holds = lambda layer, side: F.bool_or((F.col("layer") == layer) & F.col(side))
    labels = own.unionByName(inside).groupBy(*group, *ENDS).agg(*[holds(n, s).alias(f"{n}_{s}") for n in "ab" for s in ("left", "right")])
    labels = materialize(labels, "overlay-labels")
    discard(edges, cut, own)
    return labels


def boundary(labels: DataFrame, group: list[str], keep: Callable[[Column, Column], Column]) -> DataFrame:
    """``(group, x1, y1, x2, y2)``: the sides around ``keep(a, b)`` of ``labelled``, with it on their left."""
    left, right = keep(F.col("a_left"), F.col("b_left")), keep(F.col("a_right"), F.col("b_right"))
    return labels.filter(left != right).select(*group, *[F.when(right, F.col(b)).otherwise(F.col(a)).alias(a) for a, b in zip(ENDS, [*ENDS[2:], *ENDS[:2]], strict=True)])


def areas(found: DataFrame, group: list[str]) -> DataFrame:
    """``(group, area)`` of a ``boundary``; groups without one have no row."""
    return found.groupBy(*group).agg((F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")) / 2).alias("area"))


def polygons_of(found: DataFrame, group: list[str], cell: float) -> DataFrame:
    """``(group, geom, area)``: a ``boundary`` as one multipolygon a group, its parts by their smallest points."""
    if taken := {"side", "face", "back", "x", "y", *ENDS} & set(group):
        raise ValueError(f"a group cannot have these names: {sorted(taken)}")
    numbered = materialize(found.withColumn("side", F.monotonically_increasing_id()), "overlay-sides")
    faces = materialize(rings(trace(numbered, group), group), "overlay-rings")
    parts = nested(faces, cell, group).select(*group, "area", F.struct(F.col("ring").alias("shell"), "holes").alias("part"))
    return parts.groupBy(*group).agg(F.array_sort(F.collect_list("part")).alias("geom"), F.sum("area").alias("area"))


def box_pairs(left: DataFrame, right: DataFrame, cell: float) -> DataFrame:
    """``(left_id, right_id)`` of multipolygons ``(id, geom)`` whose boxes share an area. Boxes meet in the cells they touch and are compared there; geometries stay behind."""
    corner = lambda pick, k: pick(F.flatten(F.transform("geom", lambda p: F.transform(p["shell"], lambda q: q[k]))))

    def dealt(df: DataFrame, n: str) -> DataFrame:
        boxes = df.select(F.col("id").alias(f"{n}_id"), *[corner(pick, k).alias(f"{n}_{k}{i}") for i, pick in ((0, F.array_min), (1, F.array_max)) for k in "xy"]).dropna()
        span = lambda k: F.explode(F.sequence(F.floor(F.col(f"{n}_{k}0") / cell), F.floor(F.col(f"{n}_{k}1") / cell)))
        return boxes.select("*", span("x").alias("cx")).select("*", span("y").alias("cy"))

    both = dealt(left, "left").join(dealt(right, "right"), ["cx", "cy"])
    for k in "xy":
        both = both.filter((F.col(f"left_{k}0") < F.col(f"right_{k}1")) & (F.col(f"right_{k}0") < F.col(f"left_{k}1")) & (F.col(f"c{k}") == F.floor(F.greatest(f"left_{k}0", f"right_{k}0") / cell)))
    return both.select("left_id", "right_id")


def shaped(polygons: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(id, geom)`` of the different geometries of ``polygons (id, geom)``, by the smallest id of each, and ``(shape, id)``: which rows have them.

    What is found of a geometry holds for all its rows, so overlays of copies are done once and joined to the rows.
    """
    shapes = materialize(polygons.groupBy("geom").agg(F.min("id").alias("id")).select("id", "geom"), "overlay-shapes")
    rows = polygons.select("id", "geom").join(shapes.select(F.col("id").alias("shape"), "geom"), "geom").select("shape", "id")
    return shapes, materialize(rows, "overlay-rows")


def paired(left: DataFrame, right: DataFrame, pairs: DataFrame) -> DataFrame:
    """Both multipolygons of each of ``pairs`` as the layers of one group, for ``labelled``."""
    side = lambda df, n, layer: pairs.join(df.select(F.col("id").alias(f"{n}_id"), F.col("id").alias("polygon"), "geom"), f"{n}_id").select("left_id", "right_id", F.lit(layer).alias("layer"), "polygon", "geom")
    return side(left, "left", "a").unionByName(side(right, "right", "b"))


def clipped(land: DataFrame, taken: DataFrame, pairs: DataFrame, cell: float) -> DataFrame:
    """The ``boundary`` (id, x1, y1, x2, y2) of each multipolygon of ``land (id, geom)`` less all that ``pairs (left_id, right_id)`` name of ``taken``."""
    right = pairs.join(taken.select(F.col("id").alias("right_id"), "geom"), "right_id").select(F.col("left_id").alias("id"), F.lit("b").alias("layer"), F.col("right_id").alias("polygon"), "geom")
    left = land.select("id", F.lit("a").alias("layer"), F.col("id").alias("polygon"), "geom")
    return boundary(labelled(left.unionByName(right), ["id"], cell), ["id"], DIFFERENCE)
