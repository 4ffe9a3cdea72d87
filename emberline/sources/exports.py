"""GeoJSON and KML texts, and their files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions import geometry as G


def xml_escaped(text: Column) -> Column:
    for plain, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def placemark(name: Column, style: Column) -> Column:
    return F.concat(F.lit("<Placemark><name>"), xml_escaped(name), F.lit("</name><styleUrl>#"), style, F.lit("</styleUrl></Placemark>"))


def point(lat: Column, lng: Column, properties: Column) -> Column:
    number = lambda c: F.round(c, 6).cast("decimal(12,6)").cast("string")
    return F.concat(F.lit('{"type":"Feature","geometry":{"type":"Point","coordinates":['), number(lng), F.lit(","), number(lat), F.lit(']},"properties":'), properties, F.lit("}"))


def cell(row: Column, col: Column, extent: tuple[float, float, float, float], rows: int, cols: int, p: Column) -> Column:
    """The square of a grid cell with its probability; row 0 is in the north."""
    lat0, lat1, lng0, lng1 = extent
    north, west, dy, dx = lat1 - row * ((lat1 - lat0) / rows), lng0 + col * ((lng1 - lng0) / cols), (lat1 - lat0) / rows, (lng1 - lng0) / cols
    ring = F.array(*[F.struct((north - dy * a).alias("lat"), (west + dx * b).alias("lng")) for a, b in ((0, 0), (0, 1), (1, 1), (1, 0))])
    return G.geojson(ring, F.to_json(F.struct(p.alias("p"))))


def page(title: Column, rows: list[tuple[str, Column]]) -> Column:
    """A heading and a table of names and values."""
    lines = [F.concat(F.lit(f"<tr><td>{name}</td><td>"), xml_escaped(value), F.lit("</td></tr>")) for name, value in rows]
    return F.concat(F.lit("<h1>"), xml_escaped(title), F.lit("</h1><table>"), *lines, F.lit("</table>"))


def features(frames: DataFrame, spots: DataFrame) -> DataFrame:
    """(layer, sim, feature): the last perimeter and the ignition of each fire, and landings, each place once (the earliest)."""
    none = F.lit("{}")
    last = frames.groupBy("sim").agg(F.max_by("perimeter", "idx").alias("ring"), F.min_by(F.struct("lat", "lng"), "idx").alias("start"))
    rings = last.select(F.lit("perimeter").alias("layer"), "sim", G.geojson(F.col("ring"), none).alias("feature"))
    starts = last.select(F.lit("ignition").alias("layer"), "sim", point(F.col("start.lat"), F.col("start.lng"), none).alias("feature"))
    once = spots.groupBy(F.round("lat", 5).alias("la"), F.round("lng", 5).alias("lo")).agg(F.min_by("sim", F.struct("t", "sim")).alias("sim"))
    landed = once.select(F.lit("spot").alias("layer"), "sim", point(F.col("la"), F.col("lo"), none).alias("feature"))
    return rings.unionByName(starts).unionByName(landed)


def write_collections(found: DataFrame, path: str) -> None:
    """Writes one text file set of features, a line each, by layer."""
    found.select("layer", F.col("feature").alias("value")).write.partitionBy("layer").text(path)
