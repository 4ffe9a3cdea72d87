"""Spread on grids and by wavelets: rules, equal forms, and repeatability."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberline.functions import geometry as G
from emberline.functions.fuels import CODES
from emberline.operators import cellular, huygens, montecarlo, raster
from emberline.operators.spotting import ember_range

WEATHER = {"wind": 25.0, "dir": 270.0, "ffmc": 90.0, "dmc": 45.0, "dc": 300.0, "pc": 50.0, "cure": 60.0}


def grid(spark, rows=30, cols=30, barrier=None):
    c = spark.range(rows * cols).select(F.floor(F.col("id") / cols).cast("int").alias("row"), (F.col("id") % cols).cast("int").alias("col"))
    return c.withColumn("fuel", F.lit("C2") if barrier is None else F.when(F.col("col") != barrier, "C2"))


def runs(spark, n=2, row=15, col=15, hours=0.5):
    r = spark.range(n).select(F.col("id").alias("sim"), F.lit(row).alias("row"), F.lit(col).alias("col"), *[F.lit(v).alias(k) for k, v in WEATHER.items()], F.lit(hours).alias("hours"), (F.col("id") + 5).alias("seed"))
    return montecarlo.with_rates(r)


def test_fire_runs_downwind_and_stops_at_a_barrier(spark):
    got = cellular.arrivals(runs(spark, hours=0.2), grid(spark), 100.0, 1.0).toPandas()
    assert got.col.mean() > 15  # wind from the west
    held = cellular.arrivals(runs(spark, hours=1.0), grid(spark, barrier=20), 100.0, 1.0).toPandas()
    assert held.col.max() < 20 and len(held) > 50
    again = cellular.arrivals(runs(spark, hours=1.0).repartition(3), grid(spark, barrier=20), 100.0, 1.0).toPandas()
    key = ["sim", "row", "col"]
    assert held.sort_values(key).reset_index(drop=True).equals(again.sort_values(key).reset_index(drop=True))


def test_relational_step_equals_the_kernel(spark):
    """The first step of a run, by joins and in numpy."""
    c = grid(spark, 12, 12)
    r = runs(spark, 1, 6, 6, 0.1).first()
    fi, ros = r.fi[CODES.index("C2")], r.ros[CODES.index("C2")]
    lbr = float(spark.range(1).select(G.length_to_breadth(F.lit(25.0)).alias("l")).first().l)
    kernel = cellular.run(np.full((12, 12), CODES.index("C2")), np.array(r.ros), np.array(r.fi), lbr, 90.0, (6, 6), 100.0, 1.0, 3.0, 5)
    burning = spark.createDataFrame([(6, 6, ros, fi, lbr, 90.0, 0.0, 0.0)], "row int, col int, ros double, fi double, lbr double, toward double, slope double, aspect double")
    lit = cellular.one_step(burning, c.select("row", "col", F.lit(0.0).alias("carry")), burning.select("row", "col"), 5, 0, 100.0, 1.0)
    assert {(x.row, x.col) for x in lit.collect()} == {(int(a), int(b)) for a, b, k, _ in kernel if k == 0}


def test_relational_step_takes_rows_beyond_int_keys(spark):
    """A cell's key, row * 100000 + col, is beyond 2^31 from row 21,475 on."""
    cells = spark.createDataFrame([(r, c) for r in range(29_998, 30_001) for c in range(3)], "row int, col int").withColumn("carry", F.lit(0.0))
    one = cells.where("row = 29999 AND col = 1").select("row", "col")
    burning = one.selectExpr("*", "200.0D ros", "100000.0D fi", "1.0D lbr", "90.0D toward", "0.0D slope", "0.0D aspect")
    assert cellular.one_step(burning, cells, one, 11, 4, 50.0, 1.0).count() == 8


def test_ignition_snaps_to_fuel(spark):
    c = spark.createDataFrame([(0, 0, None), (0, 1, None), (3, 3, "C2"), (0, 3, "D1")], "row int, col int, fuel string")
    r = cellular.snapped(c, 0, 0).first()
    assert (r.row, r.col, r.rings) == (0, 3, 3)
    assert cellular.snapped(c.where("fuel is null"), 0, 0).count() == 0


def test_burn_probability_is_a_share(spark):
    r = montecarlo.iterations(spark, 6, 42, 15, 15, 100.0, WEATHER, 0.3)
    p = montecarlo.burn_probability(r, grid(spark), 100.0).toPandas()
    assert len(p) == 900 and p.p.between(0, 1).all() and p.p.max() == 1.0
    still = montecarlo.draws(spark.range(5).select(F.col("id").alias("sim"), F.lit(20.0).alias("wind"), F.lit(85.0).alias("ffmc")), "sim", 1, 0.0, 0.0, 0.0).distinct()
    assert still.where("wind = 20 and ffmc = 85 and north_m = 0").count() == 5


def scenario(spark, **change):
    s = {"sim": 1, "fuel": "C2", "wind": 20.0, "dir": 270.0, "ffmc": 90.0, "dmc": 45.0, "dc": 300.0, "pc": 50.0, "cure": 60.0, "lat": 51.0, "lng": -114.0, "hours": 2.0, "snapshot": 0.5} | change
    return spark.createDataFrame([tuple(s.values())], ", ".join(f"{k} {'long' if k == 'sim' else 'string' if k == 'fuel' else 'double'}" for k in s))


def test_wavelet_fire(spark):
    f = huygens.frames(scenario(spark)).orderBy("idx").toPandas()
    assert list(f.t) == [0.0, 0.5, 1.0, 1.5, 2.0] and f.area_ha[0] < 1 < f.area_ha.iloc[-1] < 10_000 and f.area_ha.is_monotonic_increasing
    last = f.perimeter.iloc[-1]
    assert np.mean([p["lng"] for p in last]) > -114.0
    calm = huygens.frames(scenario(spark, wind=0.0, hours=1.0)).orderBy("idx").toPandas().perimeter.iloc[-1]
    d = [np.hypot((p["lat"] - 51.0) * 111320, (p["lng"] + 114.0) * 111320 * np.cos(np.radians(51.0))) for p in calm]
    assert max(d) / min(d) < 1.5


def test_wavelet_fire_is_held_by_missing_fuel(spark):
    c = grid(spark, 40, 40).withColumn("fuel", F.when(F.col("col") < 25, "C2"))
    f = huygens.frames(scenario(spark, lat=51.02, lng=-113.98, hours=1.0), c, (51.0, 51.04, -114.0, -113.96), spotting=False).orderBy("idx").toPandas()
    edge = -114.0 + 25 * 0.001 + 1e-9
    assert max(p["lng"] for p in f.perimeter.iloc[-1]) < edge


@pytest.mark.parametrize("wind, hfi, low, high", [(14, 7558, 20, 220), (29, 38774, 90, 440), (50, 10000, 165, 650), (60, 30000, 275, 1100)])
def test_ember_distances(spark, wind, hfi, low, high):
    _, least, most = ember_range(F.lit(float(wind)), F.lit(float(hfi)))
    r = spark.range(1).select(least.alias("a"), most.alias("b")).first()
    assert low * 0.5 <= r.a and r.b <= high


def test_raster_schemes(spark):
    for codes, name in (({1, 32, 41, 42}, "fbp"), ({2, 12, 22, 31}, "uplvi"), ({1, 2, 3}, "broad"), ({22, 42}, "broad"), ({14, 2}, "canopy")):
        d = spark.createDataFrame([(c,) for c in codes], "code int")
        assert raster.scheme(d).first().scheme == name
    assert raster.scheme(spark.createDataFrame([], "code int")).first().scheme == "broad"


def test_terrain(spark):
    c = grid(spark, 10, 10)
    north = raster.terrain(c.withColumn("elev", 100.0 - 10.0 * F.col("row")), 100.0)
    r = north.where("row = 5 and col = 5").first()
    assert r.slope == pytest.approx(10.0) and r.aspect == pytest.approx(0.0, abs=1e-6)
    east = raster.terrain(c.withColumn("elev", 10.0 * F.col("col")), 100.0).where("row = 0 and col = 0").first()
    assert east.aspect == pytest.approx(90.0)


def test_barriers_touch_cells(spark):
    d = spark.createDataFrame([(53.0, 53.1, -113.1, -113.0)], "lat_lo double, lat_hi double, lng_lo double, lng_hi double")
    assert raster.touched(d, (53.0, 53.1, -113.1, -113.0), 10, 10).count() == 100
    assert raster.touched(d, (54.0, 54.1, -113.1, -113.0), 10, 10).count() == 0


def test_large_rasters_are_refused():
    assert raster.factor_for(10.0, 50.0, 1000, 1000) == 5
    with pytest.raises(ValueError):
        raster.factor_for(50.0, 50.0, 20_000, 20_000)


SF = "/root/testdata/sf0.001"


def test_grid_queries_take_their_fires_from_the_tables(spark):
    from emberline.plans import grids
    from emberline.sources import views

    cells = grids.ground(spark, SF)
    assert cells.count() == views.cells(spark, SF).count() and cells.where("slope > 1").count() > 0
    starts = grids.ignitions(spark, SF, cells).collect()
    rows = cells.agg(F.max("row")).first()[0] + 1
    assert len(starts) == views.stations(spark, SF).count() and all(0 <= s.row < rows and 0 <= s.col < 40 for s in starts)
    assert grids.ITERATIONS == 100


def test_wavelet_queries_pass_the_fuel_grid_and_whole_days(spark, monkeypatch):
    from emberline.plans import grids

    calls, none = [], spark.createDataFrame([], huygens.FRAMES)

    def kept(s, *grid):
        calls.append((s, grid))
        return none

    monkeypatch.setattr(grids.huygens, "frames", kept)
    grids.huygens_frames(spark, SF)
    grids.override(spark, SF)
    grids.multiday(spark, SF)
    assert len(calls) == 9 and all(len(g) == 2 and "fuel" in g[0].columns for _, g in calls)
    assert calls[2][0].first().hours == 24.0


def test_runs_together_are_as_alone_and_embers_jump_barriers():
    rng = np.random.default_rng(4)
    fuel = rng.integers(0, 3, (40, 60)).astype(np.int8)
    fuel[:, 30:33] = -1  # no fuel: only embers cross
    n = 6
    ros, fi = rng.uniform(5, 30, (n, 3)), rng.uniform(6000, 30000, (n, 3))
    start = np.stack([rng.integers(5, 35, n), rng.integers(20, 29, n)], 1)
    one = (np.full(n, 2.0), np.full(n, 90.0), start, 20.0, 1.0, np.full(n, 90.0), np.arange(n) * 1000003 + 7)
    for wind in (None, np.full(n, 40.0)):
        together = cellular.run_many(fuel, ros, fi, *one, wind=wind)
        for k in range(n):
            alone = cellular.run_many(fuel, ros[k : k + 1], fi[k : k + 1], *(x[k : k + 1] if isinstance(x, np.ndarray) else x for x in one), wind=None if wind is None else wind[k : k + 1])
            assert np.array_equal(alone[:, 1:], together[together[:, 0] == k][:, 1:])
        assert (together[:, 2] > 32).any() == (wind is not None)
        places = together[:, 1:3].astype(int)
        assert (fuel[places[:, 0], places[:, 1]] >= 0).all() and len(np.unique(together[:, :3], axis=0)) == len(together)


def test_rates_by_terms_are_those_of_the_columns(spark):
    """The surface rate of every fuel, as a Column and in numpy."""
    from emberline.functions import fbp as B
    from emberline.functions.fuels import fuel_table

    rows = fuel_table(spark).crossJoin(spark.createDataFrame([(i, b, p, c) for i in (0.0, 0.4, 7.0, 40.0) for b, p, c in ((0.0, 50.0, 60.0), (80.0, 0.0, 40.0), (150.0, 100.0, 95.0))], "isi double, bui double, pc double, cure double"))
    got = rows.select("isi", B.surface_ros(F.col("isi"), F.col("bui"), F.col("pc"), F.col("cure")).alias("ros"), B.rate_terms(F.col("bui"), F.col("pc"), F.col("cure")).alias("t")).collect()
    terms = np.array([[[x.weight, x.b, x.c] for x in r.t] for r in got])
    assert len(got) == 18 * 12
    np.testing.assert_allclose(B.rate_of_terms(terms, np.array([r.isi for r in got])), [r.ros for r in got], rtol=1e-12, atol=1e-12)


def _slope_cells(spark, slope, mult=1.0):
    c = spark.range(80 * 80).select(F.floor(F.col("id") / 80).cast("int").alias("row"), (F.col("id") % 80).cast("int").alias("col"))
    return c.withColumns({"fuel": F.lit("C3"), "slope": F.lit(slope), "aspect": F.lit(90.0), "ros_mult": F.lit(mult), "ember_mult": F.lit(1.0)})


def test_wavelets_follow_the_ground_and_the_zones(spark):
    s = scenario(spark, lat=51.02, lng=-113.98, hours=0.5, wind=0.0).withColumn("fuel", F.lit("C3"))
    extent = (51.0, 51.04, -114.0, -113.96)
    last = lambda cells: huygens.frames(s, cells, extent, spotting=False).orderBy(F.desc("idx")).first()
    east = lambda f: max(p.lng for p in f.perimeter) + 113.98
    west = lambda f: -113.98 - min(p.lng for p in f.perimeter)
    flat, plain = last(_slope_cells(spark, 0.0)), last(_slope_cells(spark, 0.0).select("row", "col", "fuel"))
    assert flat.asDict() == plain.asDict()
    steep = last(_slope_cells(spark, 40.0))
    assert east(steep) > 1.2 * east(flat) and west(steep) < west(flat)  # uphill is east
    fast = last(_slope_cells(spark, 0.0, 1.5))
    start = 30.0 / (G.M_PER_DEG * np.cos(np.radians(51.02)))
    assert east(fast) - start == pytest.approx(1.5 * (east(flat) - start), rel=0.02)


def test_rays_of_the_kernel_are_those_of_the_projection(spark):
    """One step from one vertex on a slope: by columns and in numpy."""
    s = scenario(spark, wind=20.0).withColumn("slope", F.lit(35.0))
    for fuel in ("C2", "M1", "O1a", "S2"):
        one = s.withColumn("fuel", F.lit(fuel))
        by_column = huygens.rays(one, F.lit(200.0), 1.0).orderBy("ray").select("north_m", "east_m").collect()
        base = huygens.rays(one.withColumn("slope", F.lit(0.0)), F.lit(0.0), 1.0).orderBy("ray").collect()
        x = base[0]
        wave = huygens._Wave(np.array([[(r.north_m, r.east_m) for r in base]]), np.array([[r.reach for r in base]]), np.array([[[t.weight, t.b, t.c] for t in x.terms]]), np.array([x.ros_surface]), x.isi)
        ground = huygens._Grid(np.zeros((1, 1), np.int8), {"slope": np.array([[35.0]]), "aspect": np.array([[200.0]])}, (50.0, 52.0, -115.0, -113.0))
        np.testing.assert_allclose(wave.of(np.array([0]), np.array([[51.0, -114.0]]), ground)[0], [tuple(r) for r in by_column], rtol=1e-9, atol=1e-9)


def test_hulls_of_many_sets_are_those_of_each():
    """Against the plain hull: sets of chance, on a lattice (ties, repeated points), on a line, on an ellipse, and of one point."""
    rng = np.random.default_rng(3)
    for _ in range(40):
        sets = []
        for kind in rng.integers(0, 5, 4):
            m = int(rng.choice([4, 12, 200, 1500]))
            turn = rng.uniform(0, 2 * np.pi, m)
            sets.append((rng.normal(size=(m, 2)), np.round(rng.normal(size=(m, 2)) * 4), np.outer(rng.integers(0, 9, m), [1.0, 2.0]), np.stack([np.cos(turn), 2 * np.sin(turn)], 1), np.ones((m, 2)))[kind])
        part = np.repeat(np.arange(4), [len(x) for x in sets])
        order, turn = huygens._hulls(np.concatenate(sets), part, 4)
        for k, x in enumerate(sets):
            mine = part[order] == k
            assert sorted(map(tuple, np.concatenate(sets)[order[mine]])) == sorted(G.convex_hull(list(map(tuple, x))))
            assert (np.diff(turn[mine]) >= 0).all()


def test_fires_grown_together_are_as_alone(spark, monkeypatch):
    """Fires of unlike weather, duration and start in one task, on a grid with a barrier, slopes and embers; each is followed step by step alone."""
    c = _slope_cells(spark, 20.0, 1.2).withColumn("fuel", F.when(F.col("col") == 44, None).otherwise(F.col("fuel")))
    extent = (51.0, 51.04, -114.0, -113.96)
    rows = [(k, w, 51.01 + 0.002 * k, h) for k, (w, h) in enumerate([(10.0, 0.4), (45.0, 1.0), (60.0, 0.25), (0.0, 0.5)])]
    keys = spark.createDataFrame(rows, "sim long, wind double, lat double, hours double")
    base = scenario(spark, lng=-113.982).withColumn("fuel", F.lit("C2")).drop("sim", "wind", "lat", "hours").crossJoin(keys)
    show = lambda s: [tuple(r) for r in huygens.frames(s, c, extent).orderBy("sim", "idx").collect()]
    with monkeypatch.context() as m:  # two tasks for four fires
        m.setattr(type(spark.sparkContext), "defaultParallelism", property(lambda _: 1))
        together = show(base)
    assert together == [r for k in range(4) for r in show(base.where(F.col("sim") == k))]
    assert max(r[3] for r in together) > 1 and {r[0]: r[2] for r in together} == {0: 0.4, 1: 1.0, 2: 0.25, 3: 0.5}


def test_moves_of_a_cell_are_computed_once(spark, monkeypatch):
    """Vertices of a fire in one cell share its moves, and a later step in that cell asks for none; before, every vertex asked in every step."""
    asked, of = [], huygens._Wave.of
    monkeypatch.setattr(huygens._Wave, "of", lambda self, fuel, at, grid: asked.append(len(at)) or of(self, fuel, at, grid))
    fuels = [{"wave": [{"north_m": np.cos(t), "east_m": np.sin(t), "reach": 1.0} for t in np.radians(np.arange(36) * 10.0)], "terms": [{"weight": 1.0, "b": 0.1, "c": 1.0}], "ros_surface": 1.0, "ros_final": 1.0, "hfi": 100.0, "fire_type": "surface", "flame": 1.0}] * 18
    fires = [{"sim": k, "own": "C2", "lat": 51.02, "lng": -113.98, "hours": 2.0, "snapshot": 1.0, "front": None, "wind": 10.0, "dir": 270.0, "isi": 5.0, "fuels": fuels} for k in range(3)]
    grid = huygens._Grid(np.zeros((2, 2), np.int8), {"slope": np.full((2, 2), 30.0), "aspect": np.zeros((2, 2)), "ros_mult": np.ones((2, 2))}, (51.0, 51.04, -114.0, -113.96))
    got = huygens._grown(fires, grid, 5.0, False)
    assert sum(asked) <= 3 * 4 and max(r[4] for r in got) > 12


def test_rays_inside_a_front_are_passed_over():
    """Before hulls are made, most rays that point inwards go, and the hulls are those of all points: rings of unlike size and shape, with vertices that stay, wide steps, a line, and rings the other way round."""
    rng = np.random.default_rng(8)
    rings = []
    for k in range(12):
        turn = np.sort(rng.uniform(0, 2 * np.pi, int(rng.integers(3, 60))))[:: -1 if k == 9 else 1]
        rings.append(np.stack([50 + 10.0 ** -(k % 4) * np.cos(turn), -110 + 0.3 * 10.0 ** -(k % 4) * np.sin(turn)], 1))
    rings[11] = np.stack([50 + np.arange(9) / 100, -110 + np.arange(9) / 50], 1)
    at, part = np.concatenate(rings), np.repeat(np.arange(12), [len(x) for x in rings])
    lit = rng.random(len(at)) < 0.8
    deg = np.arange(huygens.RAYS) * 2 * np.pi / huygens.RAYS
    reach = rng.uniform(0, 0.02, (lit.sum(), 1)) * rng.uniform(0.5, 1, (lit.sum(), huygens.RAYS))
    ends = at[lit][:, None] + np.stack([reach * np.cos(deg) + 0.002, reach * np.sin(deg)], 2) * (rng.random((lit.sum(), huygens.RAYS, 1)) < 0.9)
    points = np.ascontiguousarray(np.concatenate([at[~lit], ends.reshape(-1, 2)]).T).T
    sets, rays = np.concatenate([part[~lit], np.repeat(part[lit], huygens.RAYS)]), huygens._Rays(at, part, lit)
    for mine, plain in zip(huygens._hulls(points, sets, 12, rays), huygens._hulls(points, sets, 12)):
        assert np.array_equal(mine, plain)
    mean = [np.bincount(sets, x) / np.bincount(sets) for x in points.T]
    left = sets[huygens._outer([x - m[sets] for x, m in zip(points.T, mean)], sets, 12, [np.zeros(12)] * 2, rays)]
    wide = np.isin(sets, (0, 4, 8))  # rings many steps across
    assert np.isin(left, (0, 4, 8)).sum() < 0.5 * wide.sum()


def test_fires_that_come_from_a_join_stay_dealt(spark):
    """Where a session has as many shuffle partitions as fires are dealt to, the partitioning after a join by sim counted for theirs, and adaptive execution put all fires into one task: all days of ``multiday`` but the first."""
    n = 2 * spark.sparkContext.defaultParallelism
    ring = spark.range(3 * n).select(F.col("id").alias("sim"), G.circle(F.lit(51.0), F.lit(-114.0), F.lit(50.0), 12).alias("front"))
    s = scenario(spark, hours=0.1).drop("sim").crossJoin(spark.range(3 * n).withColumnRenamed("id", "sim")).repartition(3, "fuel").join(ring.hint("shuffle_hash"), "sim")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", n)
    try:
        tasks = huygens.frames(s).groupBy(F.spark_partition_id()).agg(F.countDistinct("sim"))
        assert tasks.count() > 1
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
