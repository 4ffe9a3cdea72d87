"""Polygons to cells, and rates of active cells, against plain versions."""

from __future__ import annotations

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from test_tiles import rough, several

from emberline.operators import cellular, rasterise

EXTENT, ROWS, COLS = (50.0, 51.0, -114.0, -112.0), 24, 30


def star(rng, lat, lng, size, n, whole=True):
    """A ring about a place, at random distances, and thus of any shape; open or closed."""
    turns = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
    ring = [(lat + size * rng.uniform(0.3, 1.0) * math.cos(t), lng + 2 * size * rng.uniform(0.3, 1.0) * math.sin(t)) for t in turns]
    return ring + ring[:1] if whole else ring


def plain(rings):
    """All cells against all edges: a cell is touched if an edge, clipped to it, is not empty, or if its middle is in a part by even-odd counting."""
    lat0, lat1, lng0, lng1 = EXTENT
    edges = defaultdict(list)
    for area, part, ring in rings:
        p = [((x - lng0) / (lng1 - lng0) * COLS, (lat1 - y) / (lat1 - lat0) * ROWS) for y, x in ring or []]
        edges[area, part] += [(a, b) for a, b in zip(p, p[1:] + p[:1])]

    def through(a, b, row, col):
        t0, t1 = 0.0, 1.0
        for k, low in ((0, col), (1, row)):
            d = b[k] - a[k]
            if d == 0:
                if not low <= a[k] < low + 1:
                    return False
                continue
            u, v = sorted(((low - a[k]) / d, (low + 1 - a[k]) / d))
            t0, t1 = max(t0, u), min(t1, v)
        return t0 <= t1

    out = set()
    for (area, _), es in edges.items():
        for row in range(ROWS):
            for col in range(COLS):
                y, x = row + 0.5, col + 0.5
                odd = sum((a[1] > y) != (b[1] > y) and x < a[0] + (y - a[1]) * (b[0] - a[0]) / (b[1] - a[1]) for a, b in es) % 2
                if odd or any(through(a, b, row, col) for a, b in es):
                    out.add((area, row, col))
    return out


def test_cells_of_polygons_are_those_of_all_pairs(spark):
    rng, rings = random.Random(8), []
    for area in range(12):
        lat, lng = rng.uniform(49.9, 51.1), rng.uniform(-114.1, -111.9)  # some reach beyond the grid
        rings += [(area, 0, star(rng, lat, lng, 0.3, 9, area % 2 == 0)), (area, 0, star(rng, lat, lng, 0.08, 6)), (area, 1, star(rng, lat + 0.2, lng, 0.2, 3, False))]
    rings += [(50, 0, None), (51, 0, []), (52, 0, [(50.51, -113.37)]), (53, 0, [(50.11, -113.9), (50.83, -112.2)]), (54, 0, [(40.0, -130.0), (60.0, -130.0), (60.0, -100.0), (40.0, -100.0)]), (55, 0, [(10.0, 0.0), (11.0, 0.0), (11.0, 1.0)])]
    x = spark.createDataFrame([(a, p, None if r is None else [{"lat": y, "lng": x} for y, x in r]) for a, p, r in rings], "area int, part int, ring array<struct<lat: double, lng: double>>")
    got = [tuple(r) for r in rasterise.cells_touched(x, EXTENT, ROWS, COLS).collect()]
    assert len(got) == len(set(got)) and set(got) == plain(rings)
    assert sum(r[0] == 54 for r in got) == ROWS * COLS and sum(r[0] == 52 for r in got) == 1 and not any(r[0] in (50, 51, 55) for r in got)
    assert rasterise.cells_touched(x.where("area < 0"), EXTENT, ROWS, COLS).count() == 0


def test_an_edge_through_a_corner_touches_the_cell_before_it(spark):
    """An edge from (28.793, 12966) to (32.74, 11478) of a grid of 30,000 rows goes through the corner at (32, 11757); a point on a corner is in one cell."""
    lat0, lng0 = 53.3 + 2 * 0.1, -113.8 + 3 * 0.12
    ring = [(lat0 + a, lng0 + b) for a, b in ((0.0839, 0.0719), (0.1087, 0.1311), (0.0723, 0.1007))]
    x = spark.createDataFrame([(13, 0, ring), (14, 0, [(53.55, -113.5)])], "area int, part int, ring array<struct<lat: double, lng: double>>")
    got = {tuple(r) for r in rasterise.cells_touched(x, (53.3, 53.8, -113.8, -113.2), 30_000, 40).collect()}
    assert {(13, 11756, 31), (13, 11757, 31), (13, 11756, 32)} <= got and sum(r[0] == 14 for r in got) == 1


@pytest.mark.parametrize("dt", [1.0, 3.0])
def test_active_rates_are_those_of_a_walk_over_steps(spark, dt):
    """Over real runs: each step's burning cells one by one."""
    cells, runs = rough(spark, 30, 30, False), several(spark, 3, 0.6, 30, 30)
    lit = cellular.arrivals(runs, cells, 50.0, dt).join(cells, ["row", "col"]).join(runs.select("sim", "ros"), "sim")
    from emberline.functions.fuels import CODES

    lit = lit.select("sim", "step", F.element_at("ros", F.array_position(F.array(*[F.lit(c) for c in CODES]), F.col("fuel")).cast("int")).alias("ros"))
    rows, last = lit.collect(), 20
    expected = {}
    for sim in {r.sim for r in rows}:
        for step in range(last + 1):
            own = [r.ros for r in rows if r.sim == sim and r.step < step and (step - 1 == r.step or (step - 1 - r.step) * dt < (max(2.0, 50.0 / max(r.ros, 0.1)) if r.ros > 0.001 else 10.0))]
            expected[sim, step] = (len(own), sum(own) / len(own) if own else 0.0)
    got = {(r.sim, r.step): (r.n_active, r.mean_ros) for r in cellular.active_rates(lit, dt, 50.0, last).collect()}
    assert got.keys() == expected.keys()
    for k, (n, mean) in expected.items():
        assert got[k][0] == n and got[k][1] == pytest.approx(mean, abs=1e-9)


@pytest.mark.parametrize(("rows", "cols", "target"), [(9, 7, 75.0), (30, 20, 130.0), (5, 40, 400.0), (3, 3, 50.0), (2, 2, 1000.0)])
def test_resampled_elevations_are_bilinear(spark, rows, cols, target):
    """Against interpolation at each new cell's place; corners stay."""
    from emberline.operators import raster

    rng = random.Random(rows)
    z = [[rng.uniform(500, 900) for _ in range(cols)] for _ in range(rows)]
    cells = spark.createDataFrame([(i, j, z[i][j]) for i in range(rows) for j in range(cols)], "row int, col int, elev double")
    got, cell_m = raster.resampled(cells, rows, cols, 50.0, target)
    n, m = max(1, round(rows * min(1, 50 / target))), max(1, round(cols * min(1, 50 / target)))
    expected = {}
    for i in range(n):
        for j in range(m):
            y, x = i * (rows - 1) / max(1, n - 1), j * (cols - 1) / max(1, m - 1)
            a, b = min(int(y + 1e-9), rows - 1), min(int(x + 1e-9), cols - 1)
            c, d = min(a + 1, rows - 1), min(b + 1, cols - 1)
            expected[i, j] = z[a][b] * (1 - y + a) * (1 - x + b) + z[c][b] * (y - a) * (1 - x + b) + z[a][d] * (1 - y + a) * (x - b) + z[c][d] * (y - a) * (x - b)
    found = {(r.row, r.col): r.elev for r in got.collect()}
    assert found.keys() == expected.keys() and cell_m == pytest.approx(max(50.0, target))
    assert all(found[k] == pytest.approx(v, rel=1e-9) for k, v in expected.items())
    with pytest.raises(ValueError, match="too many"):
        raster.resampled(cells, rows, cols, 50.0, target, 0)


def test_grid_queries_take_the_rows_of_the_table(spark):
    """Places and barriers fall into cells of the grid that the table has, and reach its last row."""
    from emberline.plans import grids
    from emberline.sources import views

    sf = "/root/testdata/sf0.001"

    n = views.n_rows(spark, sf)
    assert n == views.cells(spark, sf).agg(F.max("row")).first()[0] + 1 != 50
    found = grids.cell_lookup(spark, sf).agg(F.min("row"), F.max("row")).first()
    assert 0 <= found[0] and found[1] == n - 1
    mask = {(r.row, r.col) for r in grids.env_mask(spark, sf).collect()}
    assert mask and all(0 <= r < n and 0 <= c < views.COLS for r, c in mask)
    cells = {(r.row, r.col) for r in views.cells(spark, sf).collect()}
    assert grids.mask_apply(spark, sf).agg(F.sum("masked")).first()[0] == len(mask & cells)
