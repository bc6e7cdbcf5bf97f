"""Vector features: GeoJSON in Mercator metres, features of a sector to show without data, classes and markers."""

from __future__ import annotations

from math import cos, pi, radians, sin

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolith.functions.ellipsoid import WGS84
from aerolith.functions.projections import metres_to_latlon

FEATURE = "type string, coordinates array<struct<lat:double,lon:double>>, properties map<string,string>"
OPEN_FEATURE = FEATURE.replace("map<string,string>", "variant")
_COLLECTION = "struct<features:array<struct<geometry:struct<type:string,coordinates:string>,properties:{properties}>>>"

#: The sector's centre, airways about it (offsets in radians) and its control boundary.
SECTOR_DEG, SECTOR_RADIUS_M, SECTOR_SIDES = (-23.62, -46.65), 80_000.0, 8
AIRWAYS = (("UM415", ((0.5, -0.8), (-0.5, 0.8))), ("UZ22", ((-0.6, -0.6), (0.6, 0.6))))
BOUNDARY = "TMA SP CTA1"
MARKER_METRES = 1500.0


def _points(coordinates: Column, kind: Column) -> Column:
    point = F.array(F.from_json(coordinates, "array<double>"))
    line = F.from_json(coordinates, "array<array<double>>")
    ring = F.get(F.from_json(coordinates, "array<array<array<double>>>"), F.lit(0))
    raw = F.when(kind == "Point", point).when(kind == "LineString", line).when(kind == "Polygon", ring)
    pairs = F.filter(raw, lambda p: F.size(p) >= 2)
    latlon = F.transform(pairs, lambda p: metres_to_latlon(F.get(p, F.lit(0)), F.get(p, F.lit(1))))
    return F.coalesce(latlon, F.array().cast("array<struct<lat:double,lon:double>>"))


def features(texts: DataFrame, key: str = "key", open_properties: bool = False) -> DataFrame:
    """Features (key, type, coordinates, properties) of GeoJSON texts (key, json).

    Lines and outer rings become radians; other geometries have no coordinates;
    a missing type is LineString. A text that is no collection yields the
    features of the sector instead. Properties are a map of texts; open_properties
    keeps them as a variant, with nesting and types (read with value_of).
    """
    kind = "variant" if open_properties else "map<string,string>"
    parsed = texts.withColumn("__c", F.from_json("json", _COLLECTION.format(properties=kind)))
    good = parsed.where(F.col("__c.features").isNotNull()).select(key, F.explode("__c.features").alias("f"))
    kind = F.coalesce("f.geometry.type", F.lit("LineString"))
    empty = F.parse_json(F.lit("{}")) if open_properties else F.create_map().cast("map<string,string>")
    own = good.select(key, kind.alias("type"), _points(F.col("f.geometry.coordinates"), kind).alias("coordinates"), F.coalesce("f.properties", empty).alias("properties"))
    bad = parsed.where(F.col("__c.features").isNull()).select(key)
    sector = sector_features(texts.sparkSession)
    sector = sector.withColumn("properties", F.to_variant_object("properties")) if open_properties else sector
    return own.unionByName(bad.crossJoin(F.broadcast(sector)))  # three rows


def value_of(path: str, kind: str = "string", properties: str = "properties") -> Column:
    """A value of open properties by its path, such as $.level.max or $.tags[0], as a type; null if it is not there or of another kind."""
    return F.try_variant_get(F.col(properties), path, kind)


def sector_features(spark: SparkSession) -> DataFrame:
    """Two airways and an octagon about the sector's centre."""
    lat, lon = map(radians, SECTOR_DEG)
    r = SECTOR_RADIUS_M / WGS84.a
    turn = [2 * pi * k / SECTOR_SIDES for k in range(SECTOR_SIDES + 1)]
    rows = [("LineString", [(lat + a, lon + b) for a, b in ends], {"name": name, "type": "airway"}) for name, ends in AIRWAYS]
    rows.append(("Polygon", [(lat + r * cos(a), lon + r * sin(a)) for a in turn], {"name": BOUNDARY, "type": "boundary"}))
    return spark.createDataFrame(rows, FEATURE)


def feature_class(properties: str = "properties", open_properties: bool = False) -> Column:
    """airway, boundary or other, by the property type."""
    kind = value_of("$.type", properties=properties) if open_properties else F.try_element_at(F.col(properties), F.lit("type"))
    return F.when(kind.isin("airway", "boundary"), kind).otherwise("other")


def drawable(rows: DataFrame) -> DataFrame:
    """Features of at least two vertices."""
    return rows.where(F.size("coordinates") >= 2)


def point_markers(rows: DataFrame) -> DataFrame:
    """Closed boxes of projected points (x, y): column box, five corners."""
    m = MARKER_METRES
    corner = lambda dx, dy: F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"))
    return rows.withColumn("box", F.array(corner(-m, -m), corner(m, -m), corner(m, m), corner(-m, m), corner(-m, -m)))


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Features of whole GeoJSON files."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("key"), F.col("value").alias("json"))
    return features(files)
