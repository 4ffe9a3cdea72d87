"""Reading of GeoJSON files: features, rings and coordinate systems."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_FEATURE = "struct<geometry: struct<type: string, coordinates: string>, properties: map<string, string>>"


def features(spark: SparkSession, path: str) -> DataFrame:
    """(name, kind, coordinates, properties) of the features of .geojson or .geojson.gz files: collections or single ones; anything else has none.

    Coordinates stay text, since their depth depends on the kind; ring() reads them. A file is one row while it is parsed.
    """
    whole = spark.read.text(path, wholetext=True)
    parsed = whole.select(F.from_json("value", f"struct<type: string, features: array<{_FEATURE}>, geometry: struct<type: string, coordinates: string>, properties: map<string, string>>").alias("f"))
    one = F.array(F.struct(F.col("f.geometry").alias("geometry"), F.col("f.properties").alias("properties")))
    rows = parsed.select(F.explode(F.when(F.col("f.type") == "FeatureCollection", F.col("f.features")).when(F.col("f.type") == "Feature", one)).alias("x"))
    return rows.select(feature_name(F.col("x.properties")).alias("name"), F.col("x.geometry.type").alias("kind"), F.col("x.geometry.coordinates").alias("coordinates"), F.col("x.properties").alias("properties"))


def feature_name(properties: Column) -> Column:
    return F.coalesce(properties["name"], properties["NAME"], properties["label"], properties["community"], F.lit("Community"))


def ring(kind: Column, coordinates: Column) -> Column:
    """The first outer ring of a polygon or multipolygon as (lat, lng), without the closing point; null of other kinds or of fewer than 3 points."""
    flat = F.from_json(coordinates, "array<array<array<double>>>")[0]
    multi = F.from_json(coordinates, "array<array<array<array<double>>>>")[0][0]
    points = F.transform(F.when(kind == "Polygon", flat).when(kind == "MultiPolygon", multi), lambda p: F.struct(p[1].alias("lat"), p[0].alias("lng")))
    opened = F.when((F.size(points) > 1) & (points[0] == F.element_at(points, -1)), F.slice(points, 1, F.size(points) - 1)).otherwise(points)
    return F.when(F.size(opened) >= 3, opened)


def foreign_crs(text: Column) -> Column:
    """The named coordinate system of a GeoJSON text if it isn't WGS84, else null."""
    name = F.get_json_object(text, "$.crs.properties.name")
    return F.when(name.isNotNull() & ~F.regexp_like(F.upper(name), F.lit("CRS84|EPSG:+4326|WGS ?84")), name)
