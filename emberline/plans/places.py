"""Queries by place: stations, zones, facilities."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from emberline.functions import fwi as W
from emberline.functions import geometry as G
from emberline.operators import spatial
from emberline.plans import sql as S
from emberline.plans.registry import query, r
from emberline.sources import facilities as FA
from emberline.sources import views as V

_KM = S.haversine("a.lat", "a.lng", "s.slat", "s.slng")


@query(S.query("v_asset v_station", f"""WITH d AS (SELECT a.asset, s.station, {_KM} AS km FROM v_asset a CROSS JOIN v_station s)
SELECT asset, station, round(km, 5) AS km FROM d QUALIFY row_number() OVER (PARTITION BY asset ORDER BY km, station) = 1"""))
def nearest_station(spark, sf_dir):
    a = V.assets(spark, sf_dir).select("asset", "lat", "lng")
    s = V.stations(spark, sf_dir).select("station", "slat", "slng")
    return spatial.nearest(a, s, "asset", "station").select("asset", "station", r("km", 5))


@query(S.query("v_station", "SELECT station, round(slat, 4) AS lat, round(slng, 4) AS lng FROM v_station WHERE slat BETWEEN 53.45 AND 53.65 AND slng BETWEEN -113.7 AND -113.4 ORDER BY station LIMIT 50"))
def station_bbox(spark, sf_dir):
    """At most 50 stations about a place, as the feed answers."""
    s = V.stations(spark, sf_dir).where("slat BETWEEN 53.45 AND 53.65 AND slng BETWEEN -113.7 AND -113.4")
    return s.orderBy("station").limit(50).select("station", r(F.col("slat"), 4).alias("lat"), r(F.col("slng"), 4).alias("lng"))


_COLD = ("abs(reading) % 35.0::DOUBLE", "20.0::DOUBLE + abs(reading) % 60.0::DOUBLE", "abs(reading) % 40.0::DOUBLE", "0.0::DOUBLE")


@query(S.query("v_asset v_station", f"""WITH d AS (SELECT a.asset, s.station, s.reading, {_KM} AS km FROM v_asset a CROSS JOIN v_station s),
b AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY asset ORDER BY km, station) = 1),
w AS (SELECT asset, station, km, reading >= 0 AS available, {_COLD[0]} AS t, {_COLD[1]} AS h, {_COLD[2]} AS w FROM b),
m AS (SELECT *, {S.ffmc('t', 'h', 'w', _COLD[3], '85.0::DOUBLE')} AS mo FROM w),
f AS (SELECT *, {S.ffmc_of_moisture('t', 'h', 'w', 'mo')} AS ffmc FROM m)
SELECT asset, station, available, round(ffmc, 5) AS ffmc, CASE WHEN available THEN 'station ' || station ELSE 'estimate near station ' || station END AS source FROM f"""))
def weather_resolve(spark, sf_dir):
    """Weather of the nearest station; where it doesn't report, an estimate from start-up codes."""
    a = V.assets(spark, sf_dir).select("asset", "lat", "lng")
    s = V.stations(spark, sf_dir)
    x = spatial.nearest(a, s.select("station", "slat", "slng"), "asset", "station").join(s.select("station", "reading"), "station")
    x = x.select("asset", "station", (F.col("reading") >= 0).alias("available"), (F.abs("reading") % 35.0).alias("t"), (20.0 + F.abs("reading") % 60.0).alias("h"), (F.abs("reading") % 40.0).alias("w"))
    code = W.ffmc(F.col("t"), F.col("h"), F.col("w"), F.lit(0.0), F.lit(85.0))
    source = F.concat(F.when(F.col("available"), "station ").otherwise("estimate near station "), F.col("station").cast("string"))
    return x.select("asset", "station", "available", r(code, 5).alias("ffmc"), source.alias("source"))


@query(S.query("v_asset v_zone", """WITH d AS (SELECT asset, zone, pow(lat - lat0 - 0.05::DOUBLE, 2) + pow(lng - lng0 - 0.06::DOUBLE, 2) AS d2 FROM v_asset CROSS JOIN v_zone),
k AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY round(d2, 12), zone) AS k FROM d) SELECT asset, CAST(k AS INTEGER) AS k, zone FROM k WHERE k <= 4"""))
def knn_zones(spark, sf_dir):
    """The four zones with the nearest middles, in plain degrees."""
    a = V.assets(spark, sf_dir).select("asset", "lat", "lng")
    return _nearest_zones(a, V.zones(spark, sf_dir), 4).select("asset", F.col("nth").alias("k"), "zone")


def _nearest_zones(points, zones, k):
    """(asset, nth, zone): the zones with the nearest middles; squares of degrees count, rounded as the case asks."""
    middles = zones.select("zone", "lat0", "lng0", (F.col("lat0") + 0.05).alias("slat"), (F.col("lng0") + 0.06).alias("slng"))
    d2 = F.round(F.pow(F.col("lat") - F.col("lat0") - 0.05, F.lit(2)) + F.pow(F.col("lng") - F.col("lng0") - 0.06, F.lit(2)), 12)
    return spatial.nearest_k(points, middles, "asset", "zone", k, d2, lambda width: F.lit((0.99 * width) ** 2))


_IN = "lat > lat0 AND lat <= lat0 + 0.1::DOUBLE AND lng >= lng0 AND lng < lng0 + 0.12::DOUBLE"


def _zones(spark, sf_dir):
    return V.zones(spark, sf_dir).withColumn("ring", V.zone_ring())


# the ray-cast test counts the lower edge's points to the zone above it, as it takes p.lat > lat
_RAY = "(lat0 > lat) <> (lat0 + 0.1::DOUBLE > lat) AND lng < lng0 + 0.12::DOUBLE AND NOT lng < lng0"


@query(S.query("v_asset v_zone", f"SELECT zone, layer, count(*) AS n FROM v_asset JOIN v_zone ON {_RAY} GROUP BY zone, layer"))
def assets_in_zone(spark, sf_dir):
    x = spatial.points_in_areas(V.assets(spark, sf_dir), _zones(spark, sf_dir).select("zone", "ring"), few=True)
    return x.groupBy("zone", "layer").agg(F.count("*").alias("n"))


@query(S.query("v_asset v_zone", f"""WITH p AS (SELECT *, lat * 1.002::DOUBLE AS la FROM v_asset), q AS (SELECT asset, la AS lat, lng FROM p),
i AS (SELECT asset, min(zone) AS zone FROM q JOIN v_zone ON {_RAY} GROUP BY asset),
f AS (SELECT q.asset, zone FROM q CROSS JOIN v_zone WHERE q.asset NOT IN (SELECT asset FROM i) QUALIFY row_number() OVER (PARTITION BY q.asset ORDER BY round(pow(lat - lat0 - 0.05::DOUBLE, 2) + pow(lng - lng0 - 0.06::DOUBLE, 2), 12), zone) = 1)
SELECT asset, zone, true AS inside FROM i UNION ALL SELECT asset, zone, false FROM f"""))
def zone_assign_fallback(spark, sf_dir):
    """The zone that holds an asset, else the one with the nearest middle."""
    a = V.assets(spark, sf_dir).select("asset", (F.col("lat") * 1.002).alias("lat"), "lng")
    z = _zones(spark, sf_dir)
    inside = spatial.points_in_areas(a, z.select("zone", "ring"), few=True).groupBy("asset").agg(F.min("zone").alias("zone"))
    near = _nearest_zones(a.join(inside, "asset", "left_anti"), z, 1)
    return inside.select("asset", "zone", F.lit(True).alias("inside")).unionByName(near.select("asset", "zone", F.lit(False).alias("inside")))


@query(S.query("v_asset v_zone", f"WITH x AS (SELECT a.asset, min(zone) AS zone FROM v_asset a LEFT JOIN v_zone ON {_RAY.replace('lng <', 'a.lng <').replace('NOT lng', 'NOT a.lng')} GROUP BY a.asset) SELECT coalesce(CAST(zone AS VARCHAR), 'unassigned') AS zone, count(*) AS n FROM x GROUP BY 1"))
def zone_totals(spark, sf_dir):
    a = V.assets(spark, sf_dir).select("asset", "lat", "lng")
    x = spatial.points_in_areas(a, _zones(spark, sf_dir).select("zone", "ring"), few=True).groupBy("asset").agg(F.min("zone").alias("zone"))
    return a.join(x, "asset", "left").groupBy(F.coalesce(F.col("zone").cast("string"), F.lit("unassigned")).alias("zone")).agg(F.count("*").alias("n"))


@query(FA.NORMALISED_SQL)
def facility_normalise(spark, sf_dir):
    """Facilities with the symbol and layer of the first rule that fits; unnamed ones and those without a rule are left out."""
    x = FA.normalised(FA.tagged(spark, sf_dir))
    return x.select("osm_id", "name", "phone", "address", "symbol", "layer", F.array_join(F.transform(F.array_sort(F.map_entries("extra")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("extra"))


@query(FA.PLACED_SQL)
def facility_antijoin(spark, sf_dir):
    """Facilities that aren't placed yet."""
    x = FA.normalised(FA.tagged(spark, sf_dir)).select("osm_id", "symbol")
    placed = V.assets(spark, sf_dir).where("layer = 'BUILDING'").select(F.concat(F.lit("node/"), F.col("asset").cast("string")).alias("osm_id"))
    return x.join(placed, "osm_id", "left_anti").groupBy("symbol").agg(F.count("*").alias("n"))


@query(FA.NEARBY_SQL)
def facilities_nearby(spark, sf_dir):
    """Facilities within their kind's radius of a place, with distance."""
    x = FA.normalised(FA.tagged(spark, sf_dir)).join(F.broadcast(FA.radii(spark)), "symbol")
    x = x.withColumn("km", G.haversine_km(F.lit(53.55), F.lit(-113.5), F.col("lat"), F.col("lng"))).where("km <= radius_km")
    w = Window.partitionBy("symbol").orderBy(F.round("km", 6), "osm_id")
    return x.withColumn("k", F.row_number().over(w)).where("k <= 3").select("symbol", "k", "osm_id", r("km", 5))
