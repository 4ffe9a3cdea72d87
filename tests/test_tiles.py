"""Runs over tiles are those over the whole grid."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from emberline.functions.fuels import CODES
from emberline.operators import cellular, montecarlo, tiles


def rough(spark, rows, cols, ground=True):
    """A quarter of the cells without fuel."""
    rng = np.random.default_rng(1)
    r, c = np.mgrid[:rows, :cols]
    x = pd.DataFrame({"row": r.ravel(), "col": c.ravel(), "fuel": [CODES[k] if k >= 0 else None for k in rng.integers(-6, 18, rows * cols)]})
    return spark.createDataFrame(x.assign(slope=rng.random(len(x)) * 30, aspect=rng.random(len(x)) * 360) if ground else x, "row int, col int, fuel string" + (", slope double, aspect double" if ground else ""))


def several(spark, n, hours, rows, cols):
    k = F.col("id")
    weather = {"ffmc": 92.0, "dmc": 60.0, "dc": 400.0, "pc": 50.0, "cure": 80.0}
    starts = spark.range(n).select(k.alias("sim"), (k * 13 % (rows + 4)).cast("int").alias("row"), (k * 29 % cols).cast("int").alias("col"), (k * 7 % 40 + 5).cast("double").alias("wind"), (k * 77 % 360).cast("double").alias("dir"), *[F.lit(v).alias(c) for c, v in weather.items()], (hours - k * 0.02).alias("hours"), (k + 1).alias("seed"))
    return montecarlo.with_rates(starts)


@pytest.mark.parametrize(("ground", "embers", "steps", "hours"), [(True, False, 8, 0.5), (False, False, 15, 0.75), (True, True, 1, 0.05)])
def test_runs_over_sixteen_tiles_equal_the_kernel(spark, ground, embers, steps, hours):
    cells, runs = rough(spark, 60, 55, ground), several(spark, 5, hours, 60, 55)
    whole = sorted(map(tuple, cellular.arrivals(runs, cells, 50.0, 1.0, embers=embers).collect()))
    assert len({(x[1] // 15, x[2] // 15) for x in whole}) > (1 if embers else 6)
    assert sorted(map(tuple, tiles.arrivals(runs, cells, 50.0, 1.0, embers, 15, steps).collect())) == whole


def test_embers_land_in_tiles_that_no_fire_has_come_to(spark):
    """A wide gap: only embers reach the far side, in other tiles."""
    cells = spark.range(40 * 60).select(F.floor(F.col("id") / 60).cast("int").alias("row"), (F.col("id") % 60).cast("int").alias("col")).withColumn("fuel", F.when((F.col("col") < 12) | (F.col("col") > 24), "C2"))
    runs = several(spark, 3, 0.1, 40, 60).withColumns({"row": F.lit(20), "col": F.lit(10), "wind": F.lit(60.0), "dir": F.lit(270.0), "fi": F.transform("fi", lambda x: F.lit(30000.0)), "hours": F.lit(0.1)})
    whole = sorted(map(tuple, cellular.arrivals(runs, cells, 20.0, 1.0, embers=True).collect()))
    assert any(x[2] > 24 for x in whole)
    assert sorted(map(tuple, tiles.arrivals(runs, cells, 20.0, 1.0, True, 10, 1).collect())) == whole


def test_grids_over_the_limit_go_by_tiles_and_empty_ones_give_no_rows(spark, monkeypatch):
    cells, runs = rough(spark, 20, 20, False), several(spark, 2, 0.2, 20, 20)
    whole = sorted(map(tuple, cellular.arrivals(runs, cells, 50.0, 1.0).collect()))
    monkeypatch.setattr(tiles, "SIDE", 16)
    asked = []
    real = tiles.arrivals
    monkeypatch.setattr(tiles, "arrivals", lambda *a: asked.append(1) or real(*a))
    assert sorted(map(tuple, cellular.arrivals(runs, cells, 50.0, 1.0, limit=399).collect())) == whole and asked
    assert cellular.arrivals(runs, cells.where("row < 0"), 50.0, 1.0, limit=0).count() == 0
    assert tiles.arrivals(runs, cells.withColumn("fuel", F.lit(None).cast("string")), 50.0, 1.0).count() == 0
    with pytest.raises(ValueError, match="rim"):
        tiles.arrivals(runs, cells, 50.0, 1.0, False, 4, 8)
