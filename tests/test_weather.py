"""Golden values of the fire weather system, in batch and as a stream."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from emberline.functions import fwi as W
from emberline.operators import validation
from emberline.streaming import stations

SEASONS = {
    1: [(17.0, 42.0, 25.0, 0.0, 7), (22.0, 35.0, 30.0, 0.0, 7), (28.0, 28.0, 35.0, 0.0, 7)],
    2: [(35.0, 20.0, 50.0, 0.0, 7), (10.0, 90.0, 5.0, 20.0, 7), (20.0, 60.0, 15.0, 0.0, 7)],
    3: [(30.0, 30.0, 30.0, 0.0, 7), (20.0, 70.0, 10.0, 25.0, 7)],
}
EXPECTED = {
    (1, 1): (87.692980, 8.465518, 21.764, 10.853661, 8.583881, 10.144179), (1, 2): (90.158337, 11.991881, 29.428, 19.886096, 11.983022, 18.726771), (1, 3): (92.760414, 16.912584, 38.172, 37.014850, 16.862480, 33.228045),
    (2, 1): (95.661387, 12.782641, 25.004, 117.698936, 12.665727, 62.198419), (2, 2): (25.049235, 5.673302, 5.504, 0.001007, 5.263521, 0.000443), (2, 3): (64.189260, 7.655487, 12.808, 1.085884, 7.470038, 0.563017),
    (3, 1): (92.423812, 11.112815, 24.104, 27.440814, 11.045485, 22.850345), (3, 2): (49.022826, 6.048155, 7.304, 0.240361, 5.723778, 0.109789),
}


def season(spark):
    rows = [(s, d, *o) for s, days in SEASONS.items() for d, o in enumerate(days, 1)]
    return spark.createDataFrame(rows, "station long, day int, temp double, rh double, wind double, rain double, month int")


def test_chain_has_the_golden_values(spark):
    got = {(r.station, r.day): (r.ffmc, r.dmc, r.dc, r.isi, r.bui, r.fwi) for r in W.daily_chain(season(spark)).collect()}
    assert got.keys() == EXPECTED.keys()
    for k, v in EXPECTED.items():
        assert got[k] == pytest.approx(v, abs=2e-6), k


def test_stream_equals_batch(spark):
    got = {(r.station, r.day): (r.ffmc, r.dmc, r.dc) for r in stations.replay(spark, season(spark)).collect()}
    assert got.keys() == EXPECTED.keys()
    for k, v in EXPECTED.items():
        assert got[k] == pytest.approx(v[:3], abs=2e-6), k


def test_dead_codes_and_labels(spark):
    one = spark.range(1)
    r = one.select(W.bui(F.lit(0.0), F.lit(0.0)).alias("b"), W.danger(F.lit(None).cast("double")).alias("u"), W.danger(F.lit(19.0)).alias("h"), W.danger_screen(F.lit(4.9)).alias("l")).first()
    assert (r.b, r.u, r.h, r.l) == (0.0, "Unknown", "High", "Low")


def test_low_and_high_days(spark):
    rows = [("low", 5.0, 95.0, 0.0, 20.0, 5, 60.0, 2.0, 10.0), ("high", 35.0, 15.0, 40.0, 0.0, 7, 90.0, 60.0, 350.0)]
    d = spark.createDataFrame(rows, "k string, temp double, rh double, wind double, rain double, month int, f double, p double, c double")
    x = d.select("k", W.next_codes({k: F.col(k) for k in ("temp", "rh", "wind", "rain", "month")}, {"ffmc": F.col("f"), "dmc": F.col("p"), "dc": F.col("c")}).alias("n")).select("k", "n.*")
    got = {r.k: (r.ffmc, r.dmc, r.dc) for r in x.collect()}
    assert got["low"] == pytest.approx((10.256261, 0.382272, 3.304), abs=2e-6)
    assert got["high"] == pytest.approx((96.815869, 67.206556, 360.004), abs=2e-6)


def test_validation(spark):
    d = spark.createDataFrame([(20.0, 50.0), (99.0, 150.0), (None, 50.0)], "temp double, rh double")
    good, bad = validation.split_valid(d)
    assert good.count() == 2 and bad.first().broken == ["temp", "rh"]
    t = spark.createDataFrame([("3.5",), ("-2",), ("n/a",), (None,)], "t string").select(validation.reading(F.col("t")).alias("v")).collect()
    assert [r.v for r in t] == [3.5, None, None, None]
