"""Tables of layers that belong to owners, such as the zones of a run: checked, mapped and replaced owner by owner.

A layer is a Parquet table with a folder for each owner. ``write`` replaces all rows of the owners at hand and leaves
the others as they are, so a repeated write changes nothing. Columns that the layer does not name go into
``attributes_json``. A batch with a fault is refused before anything is written.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators.reports import uuid5

NAMESPACE = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"


@dataclass(frozen=True)
class Layer:
    """``columns`` (name: type) of a layer; ``key`` tells an owner's rows apart and ``required`` ones are never null.

    Columns in ``positive`` are numbers over 0, and ``choices`` name what a column may hold.
    """

    name: str
    key: str
    columns: dict[str, str]
    required: tuple[str, ...] = ()
    positive: tuple[str, ...] = ()
    choices: dict[str, tuple[str, ...]] = field(default_factory=dict)
    owner: str = "run_id"


RING = "array<struct<x: double, y: double>>"
AREAS = f"array<struct<shell: {RING}, holes: array<{RING}>>>"
#: The layers of a run; their columns are fixed names.
LAYERS = {
    layer.name: layer
    for layer in (
        Layer("zones", "zone_key", {"zone_class": "string", "area_m2": "double", "geometry": AREAS}, ("zone_class", "geometry"), ("area_m2",)),
        Layer("roads", "road_id", {"source_node_id": "string", "target_node_id": "string", "length_m": "double", "road_class": "string", "origin": "string"}, ("source_node_id", "target_node_id"), ("length_m",), {"origin": ("source", "generated")}),
        Layer("blocks", "block_key", {"zone_id": "string", "area_m2": "double", "association_status": "string", "geometry": AREAS}, ("geometry",), ("area_m2",)),
        Layer("parcels", "parcel_key", {"block_id": "string", "zone_id": "string", "area_m2": "double", "buildable_area_m2": "double", "frontage_m": "double", "geometry": AREAS}, ("block_id", "geometry"), ("area_m2",)),
        Layer("buildings", "building_key", {"block_id": "string", "parcel_id": "string", "archetype": "string", "floors": "int", "footprint_area_m2": "double", "gfa_m2": "double"}, ("block_id", "archetype"), ("floors", "footprint_area_m2")),
        Layer("demography", "block_id", {"population": "bigint", "jobs": "bigint"}, ("population", "jobs")),
        Layer("infrastructure", "candidate_id", {"infrastructure_type_code": "string", "capacity": "double", "acceptance_index": "int", "network_node_id": "string"}, ("infrastructure_type_code", "acceptance_index"), ("capacity",)),
        Layer("block_demand", "demand_key", {"block_id": "string", "infrastructure_type_code": "string", "gross_demand": "double", "served_demand": "double", "unmet_demand": "double"}, ("block_id", "infrastructure_type_code", "gross_demand")),
        Layer("metrics", "metric_id", {"raw_value": "double", "normalized_value": "double"}),
        Layer("validation", "result_key", {"code": "string", "severity": "string", "passed": "boolean", "message": "string"}, ("code", "severity", "passed"), (), {"severity": ("error", "warning", "info")}),
        Layer("source_features", "source_feature_id", {"feature_class": "string", "name": "string", "geometry": AREAS}, ("feature_class",), owner="dataset_version_id"),
    )
}


class LayerError(ValueError):
    """Rows that a layer does not take."""


def mapped(rows: DataFrame, layer: Layer) -> DataFrame:
    """``rows`` as the layer's rows: ``id`` (a UUID of owner and key), owner, key, the layer's columns and ``attributes_json``.

    Missing columns are null. Attributes are JSON with their names sorted, without nulls; none is ``{}``.
    """
    named = {layer.owner, layer.key, *layer.columns}
    rest = sorted(c for c in rows.columns if c not in named)
    owner, key = F.col(layer.owner).cast("string"), F.col(layer.key).cast("string")
    name = F.concat(F.lit(layer.name), F.lit(":"), F.octet_length(owner), F.lit(":"), owner, F.lit(":"), key)
    attributes = F.to_json(F.struct(*rest)) if rest else F.lit("{}")
    columns = [(F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in layer.columns.items()]
    return rows.select(uuid5(NAMESPACE, name).alias("id"), owner.alias(layer.owner), key.alias(layer.key), *columns, attributes.alias("attributes_json"))


def faults(rows: DataFrame, layer: Layer) -> dict[str, int]:
    """How many of the mapped ``rows`` have each fault; one pass, and one for repeated keys."""
    checks = {f"{c} is null": F.col(c).isNull() for c in (layer.owner, layer.key, *layer.required)}
    checks |= {f"{c} is not positive": ~(F.col(c) > 0) for c in layer.positive}
    checks |= {f"{c} is not known": ~F.col(c).isin(*known) for c, known in layer.choices.items()}
    checks |= {f"{c} is not finite": F.isnan(c) | (F.abs(c) == float("inf")) for c, t in layer.columns.items() if t == "double"}
    found = rows.agg(*[F.count_if(c).alias(n) for n, c in checks.items()]).head().asDict()
    found["repeated keys"] = rows.groupBy(layer.owner, layer.key).count().filter("count > 1").count()
    return {n: k for n, k in found.items() if k}


def _frozen(spark: SparkSession, path: str, owners: list[str]) -> list[str]:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = there.getFileSystem(spark._jsc.hadoopConfiguration())
    return [o for o in owners if files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_frozen-{_hex(o)}"))]


def _hex(text: str) -> str:
    return text.encode().hex()


def write(rows: DataFrame, layer: Layer, path: str, owners: list[str]) -> None:
    """Replace the rows that ``owners`` (a list that the caller has, such as one run) have in the layer at ``path``; an owner without rows is emptied.

    Rows of other owners, faults and owners that ``freeze`` closed raise ``LayerError``, and nothing is written.
    Each owner's rows are one folder, named by the owner in hex, which Spark replaces when the write has ended.
    """
    spark = rows.sparkSession
    made = mapped(rows, layer)
    if found := faults(made, layer):
        raise LayerError(f"{layer.name}: {found}")
    if strange := made.filter(~F.col(layer.owner).isin(*owners)).select(layer.owner).first():
        raise LayerError(f"{layer.name}: rows of another owner, {strange[0]}")
    if closed := _frozen(spark, path, owners):
        raise LayerError(f"{layer.name}: closed owners, {closed}")
    held = {r[0] for r in made.select(layer.owner).distinct().collect()}  # some of ``owners``
    made.withColumn("owner_hex", F.lower(F.hex(layer.owner))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("owner_hex").parquet(path)
    for owner in set(owners) - held:
        gone = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/owner_hex={_hex(owner)}")
        gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)


def freeze(spark: SparkSession, path: str, owner: str) -> None:
    """Close an owner's rows, as those of a run that succeeded: ``write`` refuses to replace them."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_frozen-{_hex(owner)}")
    mark.getFileSystem(spark._jsc.hadoopConfiguration()).create(mark, True).close()


def read(spark: SparkSession, layer: Layer, path: str, owner: str | None = None) -> DataFrame:
    """The layer's rows; of one ``owner`` only its folder is read."""
    kinds = ", ".join(f"{c} {t}" for c, t in {"id": "string", layer.owner: "string", layer.key: "string", **layer.columns, "attributes_json": "string", "owner_hex": "string"}.items())
    rows = spark.read.schema(kinds).parquet(path)
    return (rows if owner is None else rows.filter(F.col("owner_hex") == _hex(owner))).drop("owner_hex")
