"""Golden values of fire behaviour, and how it moves with its inputs."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from emberline.functions import fbp as B
from emberline.functions import geometry as G
from emberline.functions import rng as R
from emberline.functions.fuels import CODES

# ros_surface, ros_final, hfi, type at wind 20, codes 90/45/300
STANDARD = {
    "C1": (5.2817, 6.4442, 1981.8204, "passive_crown"), "C2": (16.5706, 28.0066, 10289.8739, "passive_crown"), "C3": (7.4723, 7.4723, 2577.9402, "surface"), "C6": (6.8482, 7.5182, 4390.8151, "surface_with_torching"),
    "D1": (3.0280, 3.0280, 317.9400, "surface"), "D2": (0.6056, 0.6056, 63.5880, "surface"), "M1": (9.7993, 9.7993, 1763.8752, "surface"), "M2": (8.5881, 8.5881, 1545.8592, "surface"), "M3": (46.4917, 58.7881, 21572.5120, "passive_crown"),
    "O1a": (7.2054, 7.2054, 756.5713, "surface"), "O1b": (7.8630, 7.8630, 825.6162, "surface"), "S1": (17.9393, 17.9393, 24218.0235, "surface"), "S3": (15.3906, 15.3906, 20777.3655, "surface"),
}


def cases(spark, wind=20.0, ffmc=90.0, dmc=45.0, dc=300.0, slope=0.0, pc=50.0):
    return spark.createDataFrame([(f, wind, ffmc, dmc, dc, slope, pc, 60.0) for f in CODES], "fuel string, wind double, ffmc double, dmc double, dc double, slope double, pc double, cure double")


def test_standard_case(spark):
    got = {r.fuel: (r.ros_surface, r.ros_final, r.hfi, r.fire_type) for r in B.with_fbp(cases(spark)).collect()}
    assert len(got) == 18
    for k, v in STANDARD.items():
        assert got[k][:3] == pytest.approx(v[:3], abs=2e-4), k
        assert got[k][3] == v[3], k


def test_more_wind_and_slope_spread_faster(spark):
    base = {r.fuel: r.ros_surface for r in B.with_fbp(cases(spark)).collect()}
    for other in (cases(spark, wind=35.0), cases(spark, ffmc=94.0), cases(spark, slope=40.0)):
        assert all(r.ros_surface > base[r.fuel] for r in B.with_fbp(other).collect())


def test_mixedwood_ends_at_its_parts(spark):
    full = {r.fuel: r.ros_surface for r in B.with_fbp(cases(spark, pc=100.0)).collect()}
    none = {r.fuel: r.ros_surface for r in B.with_fbp(cases(spark, pc=0.0)).collect()}
    assert full["M1"] == pytest.approx(full["C2"]) and none["M1"] == pytest.approx(none["D1"])


def test_unknown_fuel_counts_as_c2(spark):
    d = cases(spark).limit(1).withColumn("fuel", F.lit("X9"))
    assert B.with_fbp(d).first().ros_surface == pytest.approx(16.5706, abs=1e-4)


@pytest.mark.parametrize("wind, lbr", [(2, 1.019052), (10, 1.475644), (20, 2.570745), (40, 5.032299), (60, 6.913761)])
def test_length_to_breadth(spark, wind, lbr):
    assert spark.range(1).select(G.length_to_breadth(F.lit(float(wind))).alias("l")).first().l == pytest.approx(lbr, abs=1e-6)


def test_slope_towards_a_bearing(spark):
    f = lambda s, a, b: spark.range(1).select(G.directional_slope(F.lit(s), F.lit(a), F.lit(b)).alias("f")).first().f
    assert f(0.0, 180.0, 180.0) == 1 and f(50.0, 180.0, 180.0) > 1 and 0.7 <= f(50.0, 180.0, 0.0) < 1
    assert f(50.0, 180.0, 90.0) == pytest.approx(1) and f(100.0, 0.0, 0.0) <= 2 and 1 < f(50.0, 180.0, 135.0) < f(50.0, 180.0, 180.0)


def test_rings(spark):
    ring = G.circle(F.lit(51.0), F.lit(-114.0), F.lit(200.0), 36)
    r = spark.range(1).select(G.area_ha(ring).alias("a"), G.length_km(ring).alias("k"), G.contains(ring, F.lit(51.0), F.lit(-114.0)).alias("i"), G.contains(ring, F.lit(51.01), F.lit(-114.0)).alias("o"), G.area_ha(F.slice(ring, 1, 2)).alias("n")).first()
    assert r.a == pytest.approx(12.57, rel=0.1) and r.k == pytest.approx(2 * math.pi * 0.2, rel=0.01) and r.i and not r.o and r.n == 0


def test_random_numbers_agree(spark):
    import duckdb
    import numpy as np

    got = [r.u for r in spark.range(50).select(R.uniform(F.lit(9), F.col("id"), F.lit(4)).alias("u")).collect()]
    assert np.array_equal(got, R.uniform_np(9, np.arange(50), 4))
    assert got == [x[0] for x in duckdb.sql(f"SELECT {R.uniform_sql('9', 'range', '4')} FROM range(50)").fetchall()]
    assert 0.3 < np.mean(got) < 0.7


def test_hull():
    square = [(0, 0), (0, 2), (2, 2), (2, 0)]
    assert set(G.convex_hull([*square, (1, 1), (0, 1)])) == set(square)
    assert G.convex_hull([(1, 1), (1, 1)]) == [(1, 1)]


def test_every_scenario_has_its_ellipse(spark):
    """Rings of all scenarios, against the formula in plain numbers."""
    from emberline.plans import behaviour
    from emberline.sources import views

    sf = "/root/testdata/sf0.001"
    scenarios = {r.scen: r for r in views.scenarios(spark, sf).select("scen", "dmc", "wind", "dir", G.length_to_breadth(F.col("wind")).alias("lbr")).collect()}
    rows = behaviour.ellipse_rings(spark, sf).collect()
    assert len(rows) == 73 * len(scenarios) and any(k % 50 for k in scenarios)
    for r in rows:
        s = scenarios[r.scen]
        head, back = s.dmc / 10.0, s.dmc / 10.0 / s.lbr**2
        a, ahead, t, turn = (head + back) * 30.0, (head - back) * 30.0, (r.i % 72) * 2 * math.pi / 72, math.radians(s.dir)
        u, v = ahead + a * math.cos(t), a / s.lbr * math.sin(t)
        assert r.lat == pytest.approx(53.5 + (u * math.cos(turn) - v * math.sin(turn)) / 111320.0, abs=2e-6)
        assert r.lng == pytest.approx(-113.5 + (u * math.sin(turn) + v * math.cos(turn)) / (111320.0 * math.cos(math.radians(53.5))), abs=2e-6)
