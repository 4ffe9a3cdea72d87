"""Joins by place against plain comparisons."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from emberline.functions import geometry as G
from emberline.operators import consequences as C
from emberline.operators import spatial
from emberline.sources import exports, geojson


def km(a, b, c, d):
    x = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6371 * math.asin(math.sqrt(x))


def test_nearest_near_and_far(spark):
    p = [(i, 53.0 + i * 0.013, -113.0 - i * 0.031) for i in range(40)] + [(99, 10.0, 20.0)]
    s = [(i, 53.0 + (i * 7 % 11) * 0.05, -113.5 + (i * 5 % 13) * 0.06) for i in range(12)]
    got = spatial.nearest(spark.createDataFrame(p, "k long, lat double, lng double"), spark.createDataFrame(s, "s long, slat double, slng double"), "k", "s").collect()
    assert len(got) == len(p)
    for r in got:
        d, best = min((km(r.lat, r.lng, a, b), i) for i, a, b in s)
        assert r.s == best and abs(r.km - d) < 1e-6


def test_nearest_without_places(spark):
    p = spark.createDataFrame([(1, 53.0, -113.0)], "k long, lat double, lng double")
    s = spark.createDataFrame([], "s long, slat double, slng double")
    assert spatial.nearest(p, s, "k", "s").count() == 0


def test_points_in_areas_of_many_buckets(spark):
    area = spark.createDataFrame([(1,)], "zone long").withColumn("ring", G.circle(F.lit(53.5), F.lit(-113.5), F.lit(20000.0), 60))
    p = spark.createDataFrame([(1, 53.5, -113.5), (2, 53.65, -113.5), (3, 53.7, -113.5)], "k long, lat double, lng double")
    assert {r.k for r in spatial.points_in_areas(p, area).collect()} == {1, 2}


def test_many_areas_are_not_sent_through_the_driver(spark):
    """Their table is small, what they come to when they are spread over buckets isn't; only areas said to be few may be broadcast."""
    p = spark.range(40).selectExpr("id k", "53.5 + id / 1000.0D lat", "-113.5D lng")
    areas = spark.range(300).select("id", G.circle(F.col("id") * 0.0 + 53.5, F.lit(-113.5), F.col("id") * 10.0 + 30.0).alias("ring"))
    x = spatial.points_in_areas(p, areas)
    assert "SortMergeJoin" in x._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, x.select("k", "id").collect())) == sorted(map(tuple, spatial.points_in_areas(p, areas, few=True).select("k", "id").collect()))


def test_more_places_are_looked_for_in_smaller_buckets(spark):
    """With as many points and places at one spot again, each point still gets the smallest of the nearest."""
    s = spark.range(4000).selectExpr("id s", "53 + (id * 7 % 50) / 100.0D slat", "-113 - (id * 11 % 60) / 100.0D slng")
    p = spark.range(300).selectExpr("id k", "53 + (id * 13 % 100) / 200.0D + 0.0013D lat", "-113 - (id * 17 % 100) / 170.0D lng")
    assert spatial._first_width(s, 1) < spatial._first_width(s.where("s < 100"), 1) / 4
    got = {r.k: r.s for r in spatial.nearest(p, s, "k", "s").collect()}
    rows = s.collect()
    assert all(got[r.k] == min((round(km(r.lat, r.lng, x.slat, x.slng), 9), x.s) for x in rows)[1] for r in p.limit(30).collect()) and len(got) == 300


def test_communities_of_one_place_count_together(spark):
    from emberline.plans import consequences as P

    every, p = P.communities(spark, "/root/testdata/sf0.01"), P.places(spark, "/root/testdata/sf0.01")
    assert p.count() == every.select("lat", "lng").distinct().count() < every.count() == p.agg(F.sum("n")).first()[0]


def test_points_of_an_ellipse_are_those_of_its_ring(spark):
    x = spark.range(5).selectExpr("id", "id * 3.5D head", "1.0D + id lbr", "id * 77.0D bearing")
    ring = G.ellipse_ring(F.lit(53.5), F.lit(-113.5), F.col("head"), F.col("lbr"), F.col("bearing"), F.lit(60.0))
    whole = x.select("id", F.posexplode(ring).alias("i", "p")).select("id", "i", "p.lat", "p.lng")
    points = G.ellipse_points(x, 53.5, -113.5, F.col("head"), F.col("lbr"), F.col("bearing"), 60.0).select("id", "i", "lat", "lng")
    assert sorted(map(tuple, points.collect())) == sorted(map(tuple, whole.collect()))


def test_isochrones_skip_and_merge(spark):
    f = spark.createDataFrame([(1, i, i * 0.5) for i in range(5)], "sim long, idx int, t double").withColumn("perimeter", G.circle(F.lit(53.5), F.lit(-113.5), F.lit(100.0)))
    got = [(r.label, r.idx) for r in C.isochrones(spark, f, (0.5, 1.0, 2.0, 2.2, 4.0)).orderBy("target").collect()]
    assert got == [("T+30min", 1), ("T+1h", 2), ("T+2h", 4)]


def test_history_keeps_orders_and_drops_watches(spark):
    schema = "sim long, community long, tier string, rank int"
    now = spark.createDataFrame([(1, 1, "Watch", 1), (1, 2, "Order", 3)], schema)
    past = spark.createDataFrame([(1, 1, "Order", 3), (1, 2, "Alert", 2), (1, 3, "Alert", 2), (1, 4, "Watch", 1)], schema)
    got = {r.community: (r.tier, r.source) for r in C.with_history(now, past).collect()}
    assert got == {1: ("Order", "history"), 2: ("Order", "current"), 3: ("Alert", "history")}


def test_geojson_reads_back(spark, tmp_path):
    square = '{"type":"Polygon","coordinates":[[[-113,53],[-112,53],[-112,54],[-113,53]]]}'
    (tmp_path / "a.geojson").write_text('{"type":"FeatureCollection","features":[{"type":"Feature","geometry":%s,"properties":{"NAME":"A"}},{"type":"Feature","geometry":{"type":"Point","coordinates":[1,2]},"properties":{}}]}' % square)
    (tmp_path / "b.geojson").write_text('{"type":"Topology"}')
    f = geojson.features(spark, str(tmp_path / "*.geojson")).withColumn("ring", geojson.ring(F.col("kind"), F.col("coordinates"))).collect()
    assert {r.name for r in f} == {"A", "Community"}
    ring = next(r.ring for r in f if r.name == "A")
    assert [(p.lat, p.lng) for p in ring] == [(53.0, -113.0), (53.0, -112.0), (54.0, -112.0)]
    crs = spark.createDataFrame([('{"crs":{"properties":{"name":"urn:ogc:def:crs:EPSG::3400"}}}',), ('{"crs":{"properties":{"name":"urn:ogc:def:crs:OGC:1.3:CRS84"}}}',), ("{}",)], "t string")
    assert [r.c for r in crs.select(geojson.foreign_crs(F.col("t")).alias("c")).collect()] == ["urn:ogc:def:crs:EPSG::3400", None, None]


def test_markup_is_escaped(spark):
    r = spark.range(1).select(exports.placemark(F.lit('a<b & "c"'), F.lit("x")).alias("p"), G.geojson(F.expr("cast(array() as array<struct<lat: double, lng: double>>)"), F.lit("{}")).alias("g")).first()
    assert "a&lt;b &amp; &quot;c&quot;" in r.p and '"coordinates":[]' in r.g
