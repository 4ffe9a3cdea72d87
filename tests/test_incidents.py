"""Scenario files, SQL functions, and texts of exports."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from emberline.functions import fwi as W
from emberline.functions import geometry as G
from emberline.functions import sql_functions
from emberline.sources import exports, scenarios

WEATHER = {"temperature": 25.0, "relative_humidity": 30.0, "wind_speed": 20.0, "wind_direction": 270.0, "precipitation_24h": 0.0}


def test_scenarios_with_a_name_and_weather_are_usable(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"id": "1", "name": "One", "weather": WEATHER, "ffmc": 90, "createdAt": "2024-01-02"}))
    (tmp_path / "b.json").write_text(json.dumps([{"id": "2", "weather": WEATHER}, {"id": "3", "name": "Three"}, {"id": "4", "name": "Four", "weather": WEATHER, "createdAt": "2024-01-03"}]))
    (tmp_path / "c.json").write_text("{ no json")
    usable, rejected = scenarios.read_scenarios(spark, str(tmp_path))
    assert {(r.id, r.ffmc, r.dmc, r.weather.wind_speed) for r in usable.collect()} == {("1", 90.0, 40.0, 20.0), ("4", 85.0, 40.0, 20.0)}
    assert sorted((str(r.id), r.reason) for r in rejected.collect()) == [("2", "no name"), ("3", "no weather"), ("None", "could not be parsed")]
    scenarios.write_newest(usable, f"{tmp_path}/kept", 1)
    assert [r.id for r in spark.read.json(f"{tmp_path}/kept").collect()] == ["4"]


def test_sql_functions_are_the_column_expressions(spark):
    assert set(sql_functions.register(spark)) >= {"fire_isi", "fire_haversine_km"}
    x = spark.sql("SELECT id, 60D + id AS ffmc, id * 2D AS wind, id * 3D AS dmc, id * 11D AS dc, 50D + id / 10 AS lat FROM range(40)")
    pairs = [
        ("fire_isi(ffmc, wind)", W.isi(F.col("ffmc"), F.col("wind"))), ("fire_bui(dmc, dc)", W.bui(F.col("dmc"), F.col("dc"))), ("fire_length_to_breadth(wind)", G.length_to_breadth(F.col("wind"))),
        ("fire_haversine_km(lat, -114D, 51D, -113D)", G.haversine_km(F.col("lat"), F.lit(-114.0), F.lit(51.0), F.lit(-113.0))),
    ]
    for text, column in pairs:
        for r in x.select(F.expr(text).alias("a"), column.alias("b")).collect():
            assert r.a == pytest.approx(r.b, rel=1e-12, abs=1e-12)
    assert [r.d for r in spark.sql("SELECT fire_danger(x) AS d FROM VALUES (31D), (19D), (10D), (1D), (NULL) AS t(x)").collect()] == ["Very High / Extreme", "High", "Moderate", "Low", "Unknown"]
    assert "PythonUDF" not in x.selectExpr("fire_isi(ffmc, wind)")._jdf.queryExecution().toString()


def test_pages_escape_texts(spark):
    x = spark.range(1).select(exports.page(F.lit("A & <B>"), [("Name", F.lit('"q"'))]).alias("p"))
    assert x.first().p == "<h1>A &amp; &lt;B&gt;</h1><table><tr><td>Name</td><td>&quot;q&quot;</td></tr></table>"


def test_cells_are_closed_squares(spark):
    x = spark.range(1).select(exports.cell(F.lit(0), F.lit(1), (53.0, 54.0, -114.0, -113.0), 10, 10, F.lit(0.5)).alias("f"))
    f = json.loads(x.first().f)
    ring = f["geometry"]["coordinates"][0]
    assert f["properties"] == {"p": 0.5} and ring[0] == ring[-1] == [-113.9, 54.0] and ring[2] == [-113.8, 53.9] and len(ring) == 5


def test_the_service_s_functions(spark):
    from emberline import api
    from emberline.operators import raster

    obs = spark.createDataFrame([(1, 17.0, 42.0, 25.0, 0.0, 7), (2, 17.0, 142.0, 25.0, 0.0, 7)], "id int, temp double, rh double, wind double, rain double, month int")
    shown = api.fire_weather(obs).collect()
    assert len(shown) == 1 and (shown[0].ffmc, shown[0].dmc, shown[0].dc, shown[0].isi, shown[0].bui, shown[0].fwi) == (87.7, 8.5, 21.8, 10.85, 8.6, 10.1) and shown[0].danger == "Moderate"
    days = spark.createDataFrame([(1, 1, 17.0, 42.0, 25.0, 0.0, 7), (1, 2, 22.0, 35.0, 30.0, 0.0, 7), (1, 3, 28.0, 28.0, 35.0, 0.0, 7)], "station long, day int, temp double, rh double, wind double, rain double, month int")
    chain, peak = api.fire_weather_days(days)
    assert chain.count() == 3 and (peak.first().peak_day, peak.first().peak_fwi) == (3, 33.2)
    near = api.current_weather(spark.createDataFrame([(1, 53.5, -113.5)], "point int, lat double, lng double"), spark.createDataFrame([(7, 53.6, -113.5, 20.0), (8, 53.51, -113.5, 5.0)], "station int, slat double, slng double, temp double"))
    assert [(r.station, r.temp, r.km) for r in near.collect()] == [(8, 5.0, 1.11)]
    p = api.burn_probability(raster.mosaic(spark, 50, 50, 7, (25, 25)), 25, 25, {"wind": 25.0, "dir": 270.0, "ffmc": 92.0, "dmc": 45.0, "dc": 300.0, "pc": 50.0, "cure": 60.0}, hours=0.5, iterations=4)
    assert 0 < p.count() <= 2500 and p.where("p > 1 or p <= 0").count() == 0
