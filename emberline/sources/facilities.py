"""Facilities with free tags, as a map service gives them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.plans import sql as S
from emberline.sources import views as V

# Rules in their order: tags that must be, symbol, layer, radius in km.
RULES = (
    ({"amenity": "hospital"}, "hospital", "ics206", 80.0),
    ({"emergency": "ambulance_station"}, "ambulance_staging", "ics206", 60.0),
    ({"aeroway": "helipad"}, "medevac_lz", "ics206", 80.0),
    ({"amenity": "clinic", "emergency": "yes"}, "medical_aid_station", "ics206", 30.0),
    ({"amenity": "pharmacy"}, "pharmacy", "ics206", 20.0),
    ({"amenity": "fire_station"}, "fire_station", "ics204", 60.0),
    ({"emergency": "assembly_point"}, "assembly_point", "evac", 30.0),
    ({"amenity": "community_centre"}, "reception_centre", "evac", 20.0),
    ({"social_facility": "shelter"}, "shelter", "evac", 20.0),
    ({"amenity": "fuel"}, "fuel_station", "evac", 30.0),
    ({"amenity": "police"}, "police_station", "situation", 50.0),
)
EXTRA = ("operator", "healthcare:speciality", "beds", "capacity", "opening_hours", "emergency")
_AMENITIES = ("hospital", "clinic", "pharmacy", "fire_station", "community_centre", "fuel", "police", "cafe")


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tagged facility per asset: osm_id, lat, lng, tags."""
    k = F.col("asset")
    pairs = [
        ("amenity", F.element_at(F.array(*[F.lit(a) for a in _AMENITIES]), (k % 8 + 1).cast("int"))), ("emergency", F.when(k % 5 == 0, "yes").when(k % 11 == 0, "assembly_point")),
        ("name", F.when(k % 7 != 0, F.col("name"))), ("phone", F.when(k % 4 == 0, F.concat(F.lit("780-"), k.cast("string")))), ("contact:phone", F.when(k % 4 == 1, F.concat(F.lit("825-"), k.cast("string")))),
        ("addr:street", F.when(k % 2 == 0, F.concat(F.lit("Street "), (k % 90).cast("string")))), ("addr:city", F.when(k % 3 != 0, "Town")), ("beds", F.when(k % 8 == 0, (k % 200).cast("string"))),
    ]
    tags = F.map_filter(F.map_from_arrays(F.array(*[F.lit(n) for n, _ in pairs]), F.array(*[v for _, v in pairs])), lambda n, v: v.isNotNull())
    return V.assets(spark, sf_dir).select(F.concat(F.lit("node/"), k.cast("string")).alias("osm_id"), "lat", "lng", tags.alias("tags"))


def normalised(places: DataFrame) -> DataFrame:
    """osm_id, name, phone, address, lat, lng, symbol, layer, extra (map) of places with tags."""
    tag = lambda k: F.col("tags")[k]
    symbol = layer = F.lit(None).cast("string")
    for wants, s, at, _ in reversed(RULES):
        fits = F.lit(True)
        for k, v in wants.items():
            fits = fits & (F.coalesce(tag(k), F.lit("")) == v)
        symbol, layer = F.when(fits, s).otherwise(symbol), F.when(fits, at).otherwise(layer)
    name = F.coalesce(tag("name"), tag("name:en"))
    x = places.select(
        "osm_id", name.alias("name"), F.coalesce(tag("phone"), tag("contact:phone"), tag("emergency:phone"), F.lit("")).alias("phone"), F.concat_ws(" ", tag("addr:housenumber"), tag("addr:street"), tag("addr:city")).alias("address"),
        "lat", "lng", symbol.alias("symbol"), layer.alias("layer"), F.map_filter("tags", lambda k, v: k.isin(*EXTRA)).alias("extra"),
    )
    return x.where("symbol is not null and coalesce(name, '') <> ''")


def radii(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s, km) for _, s, _, km in RULES], "symbol string, radius_km double")


_TAGGED = f"""WITH t AS (SELECT 'node/' || asset AS osm_id, lat, lng, {S._list(_AMENITIES, True)}[CAST(asset % 8 + 1 AS INTEGER)] AS amenity, CASE WHEN asset % 5 = 0 THEN 'yes' WHEN asset % 11 = 0 THEN 'assembly_point' END AS emergency,
  CASE WHEN asset % 7 <> 0 THEN name END AS name, CASE WHEN asset % 4 = 0 THEN '780-' || asset WHEN asset % 4 = 1 THEN '825-' || asset ELSE '' END AS phone,
  concat_ws(' ', CASE WHEN asset % 2 = 0 THEN 'Street ' || (asset % 90) END, CASE WHEN asset % 3 <> 0 THEN 'Town' END) AS address, CASE WHEN asset % 8 = 0 THEN CAST(asset % 200 AS VARCHAR) END AS beds FROM v_asset),
s AS (SELECT *, CASE WHEN amenity = 'hospital' THEN 'hospital' WHEN amenity = 'clinic' AND emergency = 'yes' THEN 'medical_aid_station' WHEN amenity = 'pharmacy' THEN 'pharmacy' WHEN amenity = 'fire_station' THEN 'fire_station'
  WHEN emergency = 'assembly_point' THEN 'assembly_point' WHEN amenity = 'community_centre' THEN 'reception_centre' WHEN amenity = 'fuel' THEN 'fuel_station' WHEN amenity = 'police' THEN 'police_station' END AS symbol FROM t),
n AS (SELECT *, CASE symbol WHEN 'hospital' THEN 'ics206' WHEN 'medical_aid_station' THEN 'ics206' WHEN 'pharmacy' THEN 'ics206' WHEN 'fire_station' THEN 'ics204' WHEN 'police_station' THEN 'situation' ELSE 'evac' END AS layer,
  CASE symbol WHEN 'hospital' THEN 80 WHEN 'medical_aid_station' THEN 30 WHEN 'pharmacy' THEN 20 WHEN 'fire_station' THEN 60 WHEN 'police_station' THEN 50 WHEN 'reception_centre' THEN 20 ELSE 30 END AS km_most FROM s WHERE symbol IS NOT NULL AND name IS NOT NULL)"""
NORMALISED_SQL = S.query("v_asset", f"{_TAGGED} SELECT osm_id, name, phone, address, symbol, layer, concat_ws(',', 'beds=' || beds, 'emergency=' || emergency) AS extra FROM n")
PLACED_SQL = S.query("v_asset", f"{_TAGGED} SELECT symbol, count(*) AS n FROM n WHERE osm_id NOT IN (SELECT 'node/' || asset FROM v_asset WHERE layer = 'BUILDING') GROUP BY symbol")
NEARBY_SQL = S.query("v_asset", f"{_TAGGED}, d AS (SELECT *, {S.haversine('53.55::DOUBLE', '-113.5::DOUBLE', 'lat', 'lng')} AS km FROM n), k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY round(km, 6), osm_id) AS k FROM d WHERE km <= km_most) SELECT symbol, CAST(k AS INTEGER) AS k, osm_id, round(km, 5) AS km FROM k WHERE k <= 3")
