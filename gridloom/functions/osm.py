"""OpenStreetMap tags as column functions: parsed values, categories and classes by rules.

``tags`` is a ``map<string, string>``. White space around values is ignored and letters compare in
lower case. Absent, blank and malformed values give null unless said otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: For each category the rules in order, as (rule, key, values or None for any, class).
RULES: dict[str, list[tuple[str, str, tuple[str, ...] | None, str]]] = {
    "roads": [
        ("road.motorway", "highway", ("motorway", "motorway_link"), "motorway"),
        ("road.trunk", "highway", ("trunk", "trunk_link"), "trunk"),
        ("road.primary", "highway", ("primary", "primary_link"), "primary"),
        ("road.secondary", "highway", ("secondary", "secondary_link"), "secondary"),
        ("road.tertiary", "highway", ("tertiary", "tertiary_link"), "tertiary"),
        ("road.local", "highway", ("residential", "living_street", "unclassified"), "local"),
        ("road.service", "highway", ("service",), "service"),
        ("road.track", "highway", ("track",), "track"),
        ("road.path", "highway", ("path", "footway", "pedestrian", "cycleway", "bridleway", "steps"), "path"),
    ],
    "buildings": [
        ("building.residential", "building", ("residential", "apartments", "house", "detached", "semidetached_house", "terrace", "dormitory"), "residential"),
        ("building.commercial", "building", ("commercial", "office", "hotel"), "commercial"),
        ("building.industrial", "building", ("industrial", "warehouse", "manufacture"), "industrial"),
        ("building.retail", "building", ("retail", "supermarket", "kiosk"), "retail"),
        ("building.education", "building", ("school", "college", "university", "kindergarten"), "education"),
        ("building.healthcare", "building", ("hospital", "clinic"), "healthcare"),
        ("building.civic", "building", ("civic", "government", "public"), "civic"),
        ("building.garage", "building", ("garage", "garages", "carport", "parking"), "garage"),
        ("building-part.residential", "building:part", ("residential", "apartments", "house"), "residential"),
        ("building-part.commercial", "building:part", ("commercial", "office"), "commercial"),
        ("building-part.industrial", "building:part", ("industrial", "warehouse"), "industrial"),
        ("building-part.retail", "building:part", ("retail",), "retail"),
    ],
    "poi": [
        ("facility.education", "amenity", ("school", "college", "university", "kindergarten", "library"), "education"),
        ("facility.healthcare", "amenity", ("hospital", "clinic", "doctors", "dentist", "pharmacy"), "healthcare"),
        ("facility.healthcare-tag", "healthcare", None, "healthcare"),
        ("facility.emergency", "amenity", ("fire_station", "police"), "emergency"),
        ("facility.emergency-tag", "emergency", None, "emergency"),
        ("facility.transit", "public_transport", None, "transit"),
        ("facility.food", "amenity", ("restaurant", "cafe", "fast_food", "bar", "pub", "food_court"), "food"),
        ("facility.government", "amenity", ("townhall", "courthouse", "post_office"), "government"),
        ("facility.government-office", "office", ("government",), "government"),
        ("facility.retail", "shop", None, "retail"),
        ("facility.recreation", "leisure", None, "recreation"),
        ("facility.culture", "tourism", ("museum", "gallery", "attraction", "artwork"), "culture"),
    ],
    "landuse": [
        ("landuse.residential", "landuse", ("residential",), "residential"),
        ("landuse.commercial", "landuse", ("commercial",), "commercial"),
        ("landuse.retail", "landuse", ("retail",), "retail"),
        ("landuse.industrial", "landuse", ("industrial", "construction"), "industrial"),
        ("landuse.recreation", "landuse", ("recreation_ground", "village_green"), "recreation"),
        ("landuse.forest", "landuse", ("forest",), "forest"),
        ("landuse.agriculture", "landuse", ("farmland", "farmyard", "orchard", "vineyard", "greenhouse_horticulture"), "agriculture"),
        ("landuse.grass", "landuse", ("grass", "meadow"), "grass"),
        ("landuse.cemetery", "landuse", ("cemetery",), "cemetery"),
        ("landuse.military", "landuse", ("military",), "military"),
        ("landuse.water", "landuse", ("reservoir", "basin"), "water"),
    ],
    "water": [
        ("water.river", "waterway", ("river",), "river"),
        ("water.stream", "waterway", ("stream",), "stream"),
        ("water.canal", "waterway", ("canal",), "canal"),
        ("water.drain", "waterway", ("drain", "ditch"), "drain"),
        ("water.lake", "water", ("lake", "pond"), "lake"),
        ("water.reservoir", "water", ("reservoir",), "reservoir"),
        ("water.reservoir-landuse", "landuse", ("reservoir",), "reservoir"),
        ("water.basin", "water", ("basin",), "basin"),
        ("water.basin-landuse", "landuse", ("basin",), "basin"),
        ("water.wetland", "wetland", None, "wetland"),
        ("water.wetland-natural", "natural", ("wetland",), "wetland"),
        ("water.coastal", "natural", ("coastline", "bay", "strait"), "coastal"),
    ],
}
#: Keys and values that put a feature into a category.
POI_KEYS = ("amenity", "shop", "tourism", "leisure", "office", "healthcare", "craft", "public_transport", "emergency")
WATER_NATURAL = ("water", "wetland", "bay", "strait", "coastline")
WATER_LANDUSE = ("reservoir", "basin")
#: What flags and directions mean.
FALSE = ("no", "false", "0")
FORWARD, REVERSE = ("yes", "true", "1"), ("-1", "reverse")
ONE_WAY = ("yes", "true", "1", "-1")
ONE_WAY_HIGHWAYS, ONE_WAY_JUNCTIONS = ("motorway", "motorway_link"), ("roundabout", "circular")
FOOT_M, MILE_KM = 0.3048, 1.609344


def stripped(value: Column) -> Column:
    """The text without white space around it; null where nothing is left."""
    out = F.regexp_replace(value, r"^\s+|\s+$", "")
    return F.when(out != "", out)


def normalized(value: Column) -> Column:
    return F.lower(stripped(value))


def positive_int(value: Column) -> Column:
    text = stripped(value)
    n = F.when(text.rlike(r"^\d+$"), text.try_cast("int"))
    return F.when(n > 0, n)


def non_negative_float(value: Column) -> Column:
    n = stripped(value).try_cast("double")
    return F.when((n >= 0) & ~F.isnan(n) & (n < float("inf")), n)


def _with_unit(value: Column, units: str, factors: dict[str, float]) -> Column:
    """A positive number and a unit; a unit without a factor of its own counts as 1."""
    pattern = rf"(?i)^\s*(\d+(?:\.\d+)?)\s*({units})?\s*$"
    n = F.when(value.rlike(pattern), F.regexp_extract(value, pattern, 1).try_cast("double"))
    unit = F.lower(F.regexp_extract(value, pattern, 2))
    factor = F.lit(1.0)
    for name, by in factors.items():
        factor = F.when(unit == name, by).otherwise(factor)
    return F.when(n * factor > 0, n * factor)


def distance_m(value: Column) -> Column:
    """Metres; without a unit, or in metres or feet."""
    return _with_unit(value, "m|meter|meters|metre|metres|ft|feet|'", {"ft": FOOT_M, "feet": FOOT_M, "'": FOOT_M})


def max_speed_kph(value: Column) -> Column:
    """Kilometres an hour; without a unit, or in km/h, kph or mph."""
    return _with_unit(value, "km/?h|kph|mph", {"mph": MILE_KM})


def one_way(value: Column) -> Column:
    """Whether traffic goes one way; false where the tag says nothing."""
    return F.coalesce(normalized(value).isin(*ONE_WAY), F.lit(False))


def one_way_direction(tags: Column) -> Column:
    """``forward``, ``reverse`` or ``both``: by the tag, else by junctions and roads that are one-way anyway."""
    tag = lambda k: normalized(tags[k])
    implied = F.coalesce(tag("junction").isin(*ONE_WAY_JUNCTIONS), F.lit(False)) | F.coalesce(tag("highway").isin(*ONE_WAY_HIGHWAYS), F.lit(False))
    return F.when(tag("oneway").isin(*FORWARD), "forward").when(tag("oneway").isin(*REVERSE), "reverse").when(tag("oneway").isNotNull(), "both").when(implied, "forward").otherwise("both")


def structure_flag(value: Column) -> Column:
    """Whether a bridge or tunnel tag says so: any value but no, false and 0."""
    return F.coalesce(~normalized(value).isin(*FALSE), F.lit(False))


def layer(value: Column) -> Column:
    """The level, 0 where it is not a whole number of 32 bits."""
    text = normalized(value)
    return F.coalesce(F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("int")), F.lit(0))


def extract_tags(columns: dict[str, Column], packed: Column | None = None) -> Column:
    """Tags from columns of their own, then from a JSON object of more; blank values are left out and the first one counts."""
    own = F.map_filter(F.create_map(*[x for k, c in columns.items() for x in (F.lit(k), c.cast("string"))]), lambda _, v: stripped(v).isNotNull())
    if packed is None:
        return own
    more = F.coalesce(F.from_json(packed, "map<string, string>"), F.create_map().cast("map<string, string>"))
    more = F.map_filter(more, lambda k, v: stripped(v).isNotNull() & ~F.map_contains_key(own, k))
    return F.map_concat(own, more)


def categories(tags: Column) -> Column:
    """The categories of a feature, in the order of ``RULES``; empty where no tag counts."""
    has = lambda k: F.coalesce(tags[k] != "", F.lit(False))
    among = lambda k, values: F.coalesce(tags[k].isin(*values), F.lit(False))
    poi = F.lit(False)
    for k in POI_KEYS:
        poi = poi | has(k)
    water = has("waterway") | has("water") | has("wetland") | among("natural", WATER_NATURAL) | among("landuse", WATER_LANDUSE)
    found = {"roads": has("highway"), "buildings": has("building") | has("building:part"), "poi": poi, "landuse": has("landuse"), "water": water}
    return F.array_compact(F.array(*[F.when(found[c], F.lit(c)) for c in RULES]))


def classify(tags: Column, category: str) -> Column:
    """``struct<class, rule>`` of the first rule that matches; ``other`` by ``default`` where none does."""
    named = lambda i, mapped, rule: F.struct(F.lit(i).alias("at"), F.lit(mapped).alias("class"), F.lit(rule).alias("rule"))
    by_value: dict[str, list[Column]] = {}
    found = [named(len(RULES[category]), "other", "default")]
    for i, (rule, key, values, mapped) in enumerate(RULES[category]):
        if values is None:
            found.append(F.when(stripped(tags[key]).isNotNull(), named(i, mapped, rule)))
        for value in values or ():
            by_value.setdefault(key, []).extend((F.lit(value), named(i, mapped, rule)))
    found += [F.create_map(*pairs)[F.coalesce(normalized(tags[key]), F.lit(""))] for key, pairs in by_value.items()]
    best = F.array_min(F.array_compact(F.array(*found)))
    return F.struct(best["class"].alias("class"), best["rule"].alias("rule"))


def identity(layer_name: Column, osm_id: Column, way_id: Column) -> Column:
    """``osm:<element>:<id>`` of a feature of one of the four layers; null where the ids don't name exactly one element."""
    element = F.when(layer_name == "points", "node").when(layer_name == "lines", "way").when(layer_name == "multilinestrings", "relation")
    one = F.when(osm_id.isNotNull(), F.concat(F.lit("osm:"), element, F.lit(":"), osm_id.cast("string")))
    area = F.when(way_id.isNotNull() & osm_id.isNull(), F.concat(F.lit("osm:way:"), way_id.cast("string"))).when(
        way_id.isNull() & osm_id.isNotNull(), F.concat(F.lit("osm:relation:"), osm_id.cast("string"))
    )
    return F.when(layer_name == "multipolygons", area).otherwise(one)
