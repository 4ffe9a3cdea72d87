"""Queries over grids of cells, and fires that spread on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberline.functions import geometry as G
from emberline.functions import rng as R
from emberline.functions.fuels import CODES
from emberline.operators import cellular, huygens, montecarlo, raster, rasterise, spatial
from emberline.plans import sql as S
from emberline.plans import weather
from emberline.plans.registry import query, r
from emberline.plans.tables import cut
from emberline.sources import views as V

EXTENT = (V.LAT_MIN, V.LAT_MAX, V.LNG_MIN, V.LNG_MAX)
CELL_M = 50.0
_HAS = "max(CASE WHEN code = {0} THEN 1 ELSE 0 END) = 1"
_SCHEME = f"sc AS (SELECT CASE WHEN {_HAS.format(42)} AND NOT {_HAS.format(22)} THEN 'fbp' WHEN {_HAS.format(22)} AND NOT {_HAS.format(42)} THEN 'uplvi' WHEN {_HAS.format(14)} AND NOT {_HAS.format(22)} AND NOT {_HAS.format(42)} THEN 'canopy' ELSE 'broad' END AS scheme FROM v_cell)"
_FUEL = f"WITH {_SCHEME}, k AS (SELECT codes.code, codes.fuel FROM codes JOIN sc ON codes.scheme = sc.scheme), g AS (SELECT v_cell.*, k.fuel FROM v_cell LEFT JOIN k ON v_cell.code = k.code)"


def fuel_cells(spark, sf_dir):
    return raster.with_fuel(V.cells(spark, sf_dir))


@query(S.query("v_cell codes", f"WITH {_SCHEME} SELECT scheme, (SELECT count(DISTINCT code) FROM v_cell) AS n_codes FROM sc"))
def fuel_scheme(spark, sf_dir):
    c = V.cells(spark, sf_dir)
    return raster.scheme(c).crossJoin(c.agg(F.countDistinct("code").alias("n_codes")))


@query(S.query("v_cell codes", f"{_FUEL} SELECT row, col, fuel FROM g"))
def fuel_map(spark, sf_dir):
    return fuel_cells(spark, sf_dir).select("row", "col", "fuel")


@query(S.query("v_cell codes", f"{_FUEL} SELECT CASE WHEN grouping(fuel) = 1 THEN 'all' ELSE coalesce(fuel, 'non-fuel') END AS fuel, count(*) AS n, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM g), 6) AS percent FROM g GROUP BY ROLLUP (fuel)"))
def fuel_summary_rollup(spark, sf_dir):
    g = fuel_cells(spark, sf_dir)
    n = g.agg(F.count("*").alias("cells"))
    x = g.rollup("fuel").agg(F.count("*").alias("n"), F.grouping("fuel").alias("g"))
    return x.crossJoin(F.broadcast(n)).select(F.when(F.col("g") == 1, "all").otherwise(F.coalesce("fuel", F.lit("non-fuel"))).alias("fuel"), "n", r(100.0 * F.col("n") / F.col("cells")).alias("percent"))


@query(S.query("v_asset v_cell codes", f"{_FUEL}, a AS (SELECT asset, {S.cell('lat', 'lng')} FROM v_asset) SELECT a.asset, a.row, a.col, coalesce(g.fuel, 'none') AS fuel FROM a LEFT JOIN g ON a.row = g.row AND a.col = g.col"))
def cell_lookup(spark, sf_dir):
    """The fuel under each asset."""
    row, col, inside = spatial.cell_of(F.col("lat"), F.col("lng"), EXTENT, V.n_rows(spark, sf_dir), V.COLS)
    a = V.assets(spark, sf_dir).select("asset", F.when(inside, row).alias("row"), F.when(inside, col).alias("col"))
    return a.join(fuel_cells(spark, sf_dir).select("row", "col", "fuel"), ["row", "col"], "left").select("asset", "row", "col", F.coalesce("fuel", F.lit("none")).alias("fuel"))


_MID = "53.8::DOUBLE - (row + 0.5::DOUBLE) * (0.5::DOUBLE / ((SELECT max(row) FROM v_cell) + 1)) AS lat, -113.8::DOUBLE + (col + 0.5::DOUBLE) * 0.015::DOUBLE AS lng"
_RAY = "(lat0 > lat) <> (lat0 + 0.1::DOUBLE > lat) AND lng < lng0 + 0.12::DOUBLE AND NOT lng < lng0"


def _middles(c):
    """Cells with the middles of theirs, in a grid that reaches over the whole extent."""
    x = c.crossJoin(F.broadcast(c.agg((F.max("row") + 1).alias("n_rows"))))  # one row
    return x.withColumns({"lat": V.LAT_MAX - (F.col("row") + 0.5) * (0.5 / F.col("n_rows")), "lng": V.LNG_MIN + (F.col("col") + 0.5) * 0.015}).drop("n_rows")


@query(S.query("v_cell v_zone", f"""WITH m AS (SELECT row, col, {_MID} FROM v_cell), i AS (SELECT row, col, min(zone) AS zone FROM m JOIN v_zone ON {_RAY} GROUP BY row, col)
SELECT m.row, m.col, coalesce(i.zone, -1) AS zone, round(coalesce(ros_mult, 1.0::DOUBLE), 6) AS ros_mult, round(coalesce(ember_mult, 1.0::DOUBLE), 6) AS ember_mult FROM m LEFT JOIN i ON m.row = i.row AND m.col = i.col LEFT JOIN v_zone z ON i.zone = z.zone"""))
def wui_modifiers(spark, sf_dir):
    """Multipliers of the first zone that holds a cell's middle; 1 elsewhere."""
    m = _middles(V.cells(spark, sf_dir).select("row", "col"))
    z = V.zones(spark, sf_dir)
    met = spatial.points_in_areas(m, z.withColumn("ring", V.zone_ring()).select("zone", "ring"), few=True).groupBy("row", "col").agg(F.min("zone").alias("zone"))
    x = m.join(met, ["row", "col"], "left").join(z, "zone", "left")
    return x.select("row", "col", F.coalesce("zone", F.lit(-1)).alias("zone"), r(F.coalesce("ros_mult", F.lit(1.0))).alias("ros_mult"), r(F.coalesce("ember_mult", F.lit(1.0))).alias("ember_mult"))


_RECTS = "rects AS (SELECT lat0 + 0.013::DOUBLE AS lat_lo, lat0 + 0.037::DOUBLE AS lat_hi, lng0 + 0.011::DOUBLE AS lng_lo, lng0 + 0.052::DOUBLE AS lng_hi FROM v_zone)"
_MASK = f"""{_RECTS}, size AS (SELECT (53.8::DOUBLE - 53.3::DOUBLE) / {S.N_ROWS} AS dy), grid AS (SELECT CAST(a.row AS INTEGER) AS row, CAST(b.range AS INTEGER) AS col, dy FROM (SELECT unnest(range({S.N_ROWS})) AS row) a CROSS JOIN range(40) b CROSS JOIN size),
mask AS (SELECT DISTINCT row, col FROM grid JOIN rects ON round((53.8::DOUBLE - lat_hi) / dy, 9) < row + 1 AND round((53.8::DOUBLE - lat_lo) / dy, 9) > row AND round((lng_lo + 113.8::DOUBLE) / 0.015::DOUBLE, 9) < col + 1 AND round((lng_hi + 113.8::DOUBLE) / 0.015::DOUBLE, 9) > col)"""


def barriers(spark, sf_dir):
    z = V.zones(spark, sf_dir)
    rects = z.select((F.col("lat0") + 0.013).alias("lat_lo"), (F.col("lat0") + 0.037).alias("lat_hi"), (F.col("lng0") + 0.011).alias("lng_lo"), (F.col("lng0") + 0.052).alias("lng_hi"))
    return raster.touched(rects, EXTENT, V.n_rows(spark, sf_dir), V.COLS)


@query(S.query("v_cell v_zone", f"WITH {_MASK} SELECT row, col FROM mask"))
def env_mask(spark, sf_dir):
    """Cells that a barrier touches."""
    return barriers(spark, sf_dir)


@query(S.query("v_cell v_zone codes", f"{_FUEL}, {_MASK} SELECT coalesce(fuel, 'non-fuel') AS fuel, count(*) AS n, count(mask.row) AS masked FROM g LEFT JOIN mask ON g.row = mask.row AND g.col = mask.col GROUP BY 1"))
def mask_apply(spark, sf_dir):
    m = barriers(spark, sf_dir).withColumn("masked", F.lit(1))
    x = fuel_cells(spark, sf_dir).join(m, ["row", "col"], "left")
    return x.groupBy(F.coalesce("fuel", F.lit("non-fuel")).alias("fuel")).agg(F.count("*").alias("n"), F.count("masked").alias("masked"))


# Rings of an area beside a zone's corner: (part, north and east of the corner, in degrees). The first part has a hole, and the second overlaps its edge.
_AREA_RINGS = (
    (0, ((0.0113, 0.0127), (0.0089, 0.0711), (0.0317, 0.1093), (0.0457, 0.0609), (0.0931, 0.0857), (0.0803, 0.0211))),
    (0, ((0.0271, 0.0303), (0.0259, 0.0507), (0.0411, 0.0399), (0.0613, 0.0477), (0.0577, 0.0293))),
    (1, ((0.0839, 0.0719), (0.1087, 0.1311), (0.0723, 0.1007))),
)


def areas(spark, sf_dir):
    """Areas with a hole and two parts, one a zone: area, part, ring."""
    z = V.zones(spark, sf_dir)
    rings = [F.struct(F.lit(part).alias("part"), F.array(*[F.struct((F.col("lat0") + a).alias("lat"), (F.col("lng0") + b).alias("lng")) for a, b in ring]).alias("ring")) for part, ring in _AREA_RINGS]
    return z.select(F.col("zone").alias("area"), F.explode(F.array(*rings)).alias("r")).select("area", "r.part", "r.ring")


def _areas_sql() -> str:
    rings = ", ".join("{'part': %d, 'ring': %d, 'p': [%s]}" % (part, k, ", ".join(f"[lat0 + {a}::DOUBLE, lng0 + {b}::DOUBLE]" for a, b in ring)) for k, (part, ring) in enumerate(_AREA_RINGS))
    return f"""dims AS (SELECT max(row) + 1 AS n_rows FROM v_cell),
    r AS (SELECT zone AS area, unnest([{rings}]) AS r FROM v_zone),
    v AS (SELECT area, r.part AS part, r.ring AS ring, list_transform(r.p, lambda q: [(q[2] + 113.8::DOUBLE) / 0.6::DOUBLE * 40, (53.8::DOUBLE - q[1]) / 0.5::DOUBLE * n_rows]) AS p FROM r CROSS JOIN dims),
    e AS (SELECT area, part, p[i] AS a, p[i % len(p) + 1] AS b FROM (SELECT *, unnest(generate_series(1, len(p))) AS i FROM v)),
    box AS (SELECT area, min(least(a[1], b[1])) AS x0, max(greatest(a[1], b[1])) AS x1, min(least(a[2], b[2])) AS y0, max(greatest(a[2], b[2])) AS y1 FROM e GROUP BY area),
    near AS (SELECT area, row, CAST(col AS INTEGER) AS col FROM (SELECT DISTINCT row FROM v_cell) CROSS JOIN range(40) c(col) JOIN box ON row + 1 > y0 AND row < y1 AND col + 1 > x0 AND col < x1),
    side AS (SELECT near.*, part, a, b, list_transform([[0, 0], [0, 1], [1, 0], [1, 1]], lambda k: (b[1] - a[1]) * (row + k[1] - a[2]) - (b[2] - a[2]) * (col + k[2] - a[1])) AS s FROM near JOIN e USING (area)),
    crossed AS (SELECT DISTINCT area, row, col FROM side WHERE list_min(s) <= 0 AND list_max(s) >= 0 AND greatest(a[1], b[1]) >= col AND least(a[1], b[1]) < col + 1 AND greatest(a[2], b[2]) >= row AND least(a[2], b[2]) < row + 1),
    held AS (SELECT area, row, col, part FROM side WHERE (a[2] > row + 0.5) <> (b[2] > row + 0.5) AND col + 0.5 < a[1] + (row + 0.5 - a[2]) * (b[1] - a[1]) / (b[2] - a[2]) GROUP BY area, row, col, part HAVING count(*) % 2 = 1),
    touched AS (SELECT area, row, col FROM crossed UNION SELECT area, row, col FROM held)"""


@query(S.query("v_cell v_zone", f"WITH {_areas_sql()} SELECT area, CAST(row AS INTEGER) AS row, col FROM touched"))
def area_cells(spark, sf_dir):
    """Cells of the whole grid that areas with holes and parts touch."""
    n_rows = V.n_rows(spark, sf_dir)
    return rasterise.cells_touched(areas(spark, sf_dir), EXTENT, n_rows, V.COLS)


@query(S.query("v_cell v_zone codes", f"{_FUEL}, {_areas_sql()}, mask AS (SELECT DISTINCT row, col FROM touched) SELECT g.row, g.col, CASE WHEN mask.row IS NULL THEN fuel END AS fuel FROM g LEFT JOIN mask ON g.row = mask.row AND g.col = mask.col"))
def area_mask(spark, sf_dir):
    """The fuel map with no fuel under the areas."""
    mask = area_cells(spark, sf_dir).select("row", "col").distinct().withColumn("masked", F.lit(True))
    return fuel_cells(spark, sf_dir).join(mask, ["row", "col"], "left").select("row", "col", F.when(F.col("masked").isNull(), F.col("fuel")).alias("fuel"))


def _grad(line: str, along: str) -> str:
    w = f"OVER (PARTITION BY {line} ORDER BY {along})"
    return f"CASE WHEN lag(elev) {w} IS NULL AND lead(elev) {w} IS NULL THEN 0.0::DOUBLE WHEN lag(elev) {w} IS NULL THEN (lead(elev) {w} - elev) / 50.0::DOUBLE WHEN lead(elev) {w} IS NULL THEN (elev - lag(elev) {w}) / 50.0::DOUBLE ELSE (lead(elev) {w} - lag(elev) {w}) / 100.0::DOUBLE END"


_TERRAIN = f"WITH t AS (SELECT row, col, elev, {_grad('col', 'row')} AS south, {_grad('row', 'col')} AS east FROM v_cell), s AS (SELECT row, col, elev, sqrt(south * south + east * east) * 100.0::DOUBLE AS slope, ((degrees(atan2(east, -south)) % 360.0::DOUBLE) + 360.0::DOUBLE) % 360.0::DOUBLE AS bearing FROM t), z AS (SELECT row, col, slope, CASE WHEN slope < 0.1 THEN 0.0::DOUBLE ELSE bearing END AS aspect FROM s)"


@query(S.query("v_cell", f"{_TERRAIN} SELECT row, col, round(slope, 5) AS slope, round(aspect, 4) AS aspect FROM z"))
def terrain_slope_aspect(spark, sf_dir):
    return raster.terrain(V.cells(spark, sf_dir).select("row", "col", "elev"), CELL_M).select("row", "col", r("slope", 5), r("aspect", 4))


@query(S.query("v_cell", f"{_TERRAIN} SELECT round(avg(slope) FILTER (slope > 0.1), 5) AS mean_slope, round(max(slope), 5) AS top_slope, round(100.0::DOUBLE * count(*) FILTER (slope > 20) / count(*), 5) AS percent_steep FROM z"))
def terrain_summary(spark, sf_dir):
    x = raster.terrain(V.cells(spark, sf_dir).select("row", "col", "elev"), CELL_M)
    return x.agg(r(F.avg(F.when(F.col("slope") > 0.1, F.col("slope"))), 5).alias("mean_slope"), r(F.max("slope"), 5).alias("top_slope"), r(100.0 * F.count_if(F.col("slope") > 20) / F.count("*"), 5).alias("percent_steep"))


@query(S.query("v_cell", "SELECT row, col, round(CASE WHEN code = 98 THEN (SELECT avg(elev) FROM v_cell WHERE code <> 98) ELSE elev END, 5) AS elev FROM v_cell"))
def nodata_fill(spark, sf_dir):
    c = V.cells(spark, sf_dir)
    return raster.filled(c, F.col("code") == 98).select("row", "col", r("elev", 5))


@query(S.query("v_cell", """WITH d AS (SELECT max(row) + 1 AS rows, CAST(round_even((max(row) + 1) * (50.0::DOUBLE / 120.0::DOUBLE), 0) AS INTEGER) AS n_rows, 17 AS n_cols FROM v_cell),
g AS (SELECT row, col, CASE WHEN code = 98 THEN (SELECT avg(elev) FROM v_cell WHERE code <> 98) ELSE elev END AS elev FROM v_cell),
n AS (SELECT rows, r, c, r * ((rows - 1)::DOUBLE / (n_rows - 1)) AS y, c * (39.0::DOUBLE / 16.0::DOUBLE) AS x FROM (SELECT *, unnest(range(n_rows)) AS r FROM d) CROSS JOIN range(17) t(c)),
k AS (SELECT r, c, g.elev, greatest(0.0::DOUBLE, 1 - abs(y - g.row)) * greatest(0.0::DOUBLE, 1 - abs(x - g.col)) AS w FROM n JOIN g ON g.row BETWEEN floor(y + 1e-9) AND floor(y + 1e-9) + 1 AND g.col BETWEEN floor(x + 1e-9) AND floor(x + 1e-9) + 1)
SELECT CAST(r AS INTEGER) AS row, CAST(c AS INTEGER) AS col, round(sum(w * elev) / sum(w), 5) AS elev FROM k GROUP BY r, c"""))
def elevation_resampled(spark, sf_dir):
    """Elevations at 120 m from those at 50 m, missing ones filled first."""
    c = raster.filled(V.cells(spark, sf_dir), F.col("code") == 98)
    n_rows = c.agg(F.max("row") + 1).first()[0]
    return raster.resampled(c, n_rows, V.COLS, CELL_M, 120.0)[0].select("row", "col", r("elev", 5))


def _mosaic_sql() -> str:
    block = "((row // 10) * 100000 + col // 10)"
    own = "(CAST(row AS BIGINT) * 100000 + col)"
    u = f"CASE WHEN {R.uniform_sql('7', '2', own)} < 0.1::DOUBLE THEN {R.uniform_sql('7', '3', own)} ELSE {R.uniform_sql('7', '1', block)} END"
    pick = " ".join(f"WHEN u < {w}::DOUBLE THEN '{f}'" for f, w in raster.PALETTE)
    return f"WITH d AS (SELECT max(row) + 1 AS n_rows FROM v_cell), g AS (SELECT n_rows, CAST(i // 40 AS INTEGER) AS row, CAST(i % 40 AS INTEGER) AS col FROM (SELECT n_rows, unnest(range(n_rows * 40)) AS i FROM d)), u AS (SELECT *, {u} AS u FROM g) SELECT row, col, coalesce(CASE {pick} END, CASE WHEN row = n_rows // 2 AND col = 20 THEN 'C2' END) AS fuel FROM u"


@query(S.query("v_cell", _mosaic_sql()))
def synthetic_mosaic(spark, sf_dir):
    """A synthetic fuel map as large as the grid of the table, lit in its middle."""
    n_rows = V.n_rows(spark, sf_dir)
    return raster.mosaic(spark, n_rows, V.COLS, 7, (n_rows // 2, V.COLS // 2))


@query(S.query("v_cell codes", f"{_FUEL} SELECT row, col, CAST(greatest(abs(row - 2), abs(col - 0)) AS INTEGER) AS rings FROM g WHERE fuel IS NOT NULL AND greatest(abs(row - 2), abs(col - 0)) <= 100 ORDER BY rings, row, col LIMIT 1"))
def ignition_snap(spark, sf_dir):
    """The fuel cell nearest to a place without fuel."""
    return cellular.snapped(fuel_cells(spark, sf_dir), 2, 0)


@query(S.query("v_cell codes", f"{_FUEL} SELECT CAST(row // 3 AS INTEGER) AS row, CAST(col // 3 AS INTEGER) AS col, fuel FROM g WHERE row % 3 = 0 AND col % 3 = 0"))
def raster_coarser(spark, sf_dir):
    """The grid at a third of its resolution."""
    return raster.coarser(fuel_cells(spark, sf_dir).select("row", "col", "fuel"), 3)


_KEY = "(row * 100000 + col)"


@query(S.query("v_cell v_scen fuels codes", f"""{_FUEL}, {S.fbp('0.0::DOUBLE', source="(SELECT f.fuel, 25.0::DOUBLE AS wind, 90.0::DOUBLE AS ffmc, 45.0::DOUBLE AS dmc, 300.0::DOUBLE AS dc, 50.0::DOUBLE AS pc, 60.0::DOUBLE AS cure FROM fuels f)")[5:]},
b AS (SELECT g.row, g.col, ros_final AS ros, hfi AS fi FROM g JOIN fbp ON g.fuel = fbp.fuel WHERE (g.row * 7 + g.col * 3) % 10 < 3),
n AS (SELECT b.*, row + d[1] AS to_row, col + d[2] AS to_col, CAST(d[3] AS DOUBLE) AS angle FROM (SELECT *, unnest([[-1, 0, 0], [-1, 1, 45], [0, 1, 90], [1, 1, 135], [1, 0, 180], [1, -1, 225], [0, -1, 270], [-1, -1, 315]]) AS d FROM b WHERE ros > 0.001) b),
t AS (SELECT n.* FROM n JOIN g ON g.row = to_row AND g.col = to_col AND g.fuel IS NOT NULL WHERE (to_row * 7 + to_col * 3) % 10 >= 3),
p AS (SELECT *, {S.spread_prob('angle', '90.0::DOUBLE', 'ros', S.lbr('25.0::DOUBLE'), '50.0::DOUBLE', '1.0::DOUBLE')} AS p, {R.uniform_sql('11', '4', _KEY, '(to_row * 100000 + to_col)')} AS u FROM t),
h AS (SELECT *, 0.0::DOUBLE + sum(p * fi / 1000.0::DOUBLE) OVER (PARTITION BY to_row, to_col ORDER BY row, col ROWS UNBOUNDED PRECEDING) AS heat FROM p)
SELECT CAST(to_row AS INTEGER) AS row, CAST(to_col AS INTEGER) AS col, round(arg_min(fi, (row, col)), 3) AS intensity FROM h WHERE u < p OR heat > 5 GROUP BY 1, 2"""))
def ca_one_step(spark, sf_dir):
    """One step of the cellular model, as joins, from every third cell burning."""
    from emberline.functions import fbp as B
    from emberline.functions.fuels import fuel_table

    g = fuel_cells(spark, sf_dir).where("fuel is not null").select("row", "col", "fuel")
    weather_ = {"wind": 25.0, "ffmc": 90.0, "dmc": 45.0, "dc": 300.0, "pc": 50.0, "cure": 60.0}
    rates = B.with_fbp(fuel_table(spark).select("fuel", *[F.lit(v).alias(k) for k, v in weather_.items()]), slope=False).select("fuel", F.col("ros_final").alias("ros"), F.col("hfi").alias("fi"))
    alight = (F.col("row") * 7 + F.col("col") * 3) % 10 < 3
    burning = g.where(alight).join(F.broadcast(rates), "fuel").select("row", "col", "ros", "fi", G.length_to_breadth(F.lit(25.0)).alias("lbr"), F.lit(90.0).alias("toward"), F.lit(0.0).alias("slope"), F.lit(0.0).alias("aspect"))
    lit = cellular.one_step(burning, g.select("row", "col", F.lit(0.0).alias("carry")), g.where(alight).select("row", "col"), 11, 4, 50.0, 1.0)
    return lit.select("row", "col", r("intensity", 3))


_RINGS_LIT = "CAST(greatest(abs(g.row - n_rows // 2), abs(g.col - 20)) AS INTEGER)"


@query(S.query("v_cell v_scen fuels codes", f"""{_FUEL}, {S.fbp('0.0::DOUBLE', source="(SELECT f.fuel, 25.0::DOUBLE AS wind, 90.0::DOUBLE AS ffmc, 45.0::DOUBLE AS dmc, 300.0::DOUBLE AS dc, 50.0::DOUBLE AS pc, 60.0::DOUBLE AS cure FROM fuels f)")[5:]},
lit AS (SELECT g.row // 100 AS sim, {_RINGS_LIT} AS step, ros_final AS ros FROM g JOIN fbp ON g.fuel = fbp.fuel CROSS JOIN (SELECT max(row) + 1 AS n_rows FROM v_cell)),
active AS (SELECT sim, ros, unnest(generate_series(step + 1, least(240, step + greatest(CAST(ceil(CASE WHEN ros > 0.001 THEN greatest(2.0, 50.0 / greatest(ros, 0.1)) ELSE 10 END) AS BIGINT), 1)))) AS step FROM lit WHERE step < 240),
sums AS (SELECT sim, step, count(*) AS n, avg(ros) AS mean FROM active GROUP BY sim, step),
every AS (SELECT sim, CAST(range AS INTEGER) AS step FROM (SELECT DISTINCT sim FROM lit) CROSS JOIN range(241))
SELECT every.sim, every.step, coalesce(n, 0) AS n_active, round(coalesce(mean, 0.0), 6) AS mean_ros FROM every LEFT JOIN sums ON every.sim = sums.sim AND every.step = sums.step"""))
def active_rates(spark, sf_dir):
    """Mean rate of the cells that burn in each step, for fires that grow by a ring of cells a step, one for each 100 rows of the grid."""
    c = fuel_cells(spark, sf_dir).where("fuel is not null")
    n_rows = V.n_rows(spark, sf_dir)
    step = F.greatest(F.abs(F.col("row") - n_rows // 2), F.abs(F.col("col") - V.COLS // 2)).cast("int")
    lit = c.join(F.broadcast(rates_of_fuels(spark)), "fuel").select(F.floor(F.col("row") / 100).alias("sim"), step.alias("step"), "ros")  # one row a fuel
    return cellular.active_rates(lit, 1.0, CELL_M, 240).select("sim", "step", "n_active", r("mean_ros"))


def rates_of_fuels(spark):
    """fuel, ros, fi under the weather of the case below, on flat ground."""
    from emberline.functions import fbp as B
    from emberline.functions.fuels import fuel_table

    rows = fuel_table(spark).select("fuel", *[F.lit(v).alias(k) for k, v in _WEATHER.items() if k != "dir"])
    return B.with_fbp(rows, slope=False).select("fuel", F.col("ros_final").alias("ros"), F.col("hfi").alias("fi"))


_WEATHER = {"wind": 25.0, "dir": 270.0, "ffmc": 90.0, "dmc": 45.0, "dc": 300.0, "pc": 50.0, "cure": 60.0}


HOURS, ITERATIONS = 4.0, 100


def ground(spark, sf_dir):
    """The fuel cells with their slope and aspect."""
    return cut(raster.terrain(fuel_cells(spark, sf_dir), CELL_M).select("row", "col", "fuel", "slope", "aspect"))


def ignitions(spark, sf_dir, cells):
    """One ignition per station, in the cell that it stands in, under the weather of the case above."""
    rows = F.broadcast(cells.agg((F.max("row") + 1).alias("rows")))
    s = V.stations(spark, sf_dir).crossJoin(rows)
    row = F.floor((V.LAT_MAX - F.col("slat")) / (V.LAT_MAX - V.LAT_MIN) * F.col("rows"))
    col = F.floor((F.col("slng") - V.LNG_MIN) / (V.LNG_MAX - V.LNG_MIN) * V.COLS)
    inside = [F.least(F.greatest(row, F.lit(0)), F.col("rows") - 1).cast("int").alias("row"), F.least(F.greatest(col, F.lit(0)), F.lit(V.COLS - 1)).cast("int").alias("col")]
    return s.select("station", *inside, *[F.lit(v).alias(k) for k, v in _WEATHER.items()], F.lit(HOURS).alias("hours"))


@query()
def ca_frames(spark, sf_dir):
    """Snapshots of cellular runs on the fuel cells with terrain and embers, one run per station."""
    cells = ground(spark, sf_dir)
    runs = ignitions(spark, sf_dir, cells).withColumnRenamed("station", "sim").withColumn("seed", F.col("sim") + 1)
    lit = cut(cellular.arrivals(montecarlo.with_rates(runs), cells, CELL_M, 1.0, embers=True))
    return cellular.frame_stats(lit, cells, 1.0, 30.0, CELL_M, HOURS)


def probability(spark, sf_dir):
    """(station, row, col, p) of the cells that an iteration burns."""
    cells = ground(spark, sf_dir)
    every = ignitions(spark, sf_dir, cells).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(ITERATIONS - 1)))).withColumn("sim", F.col("station") * ITERATIONS + F.col("k"))
    runs = montecarlo.moved(montecarlo.draws(every, "sim", 42), 42, CELL_M)
    lit = montecarlo.lit_counts(montecarlo.with_rates(runs), cells, CELL_M, 2.0, ITERATIONS)
    p = lit.groupBy(F.col("of").alias("station"), "row", "col").agg((F.sum("n") / float(ITERATIONS)).alias("p"))
    return p, cells


@query()
def burn_probability(spark, sf_dir):
    """Share of each station's iterations that burn a cell, where any does."""
    return probability(spark, sf_dir)[0]


@query()
def mc_summary(spark, sf_dir):
    p, cells = probability(spark, sf_dir)
    n = F.broadcast(cells.agg(F.count("*").alias("n")))
    x = p.groupBy("station").agg(F.count("*").alias("cells"), F.max("p").alias("top")).crossJoin(n)
    return x.select("station", "cells", r(100.0 * F.col("cells") / F.col("n"), 4).alias("percent"), "top")


def fuel_grid(spark, sf_dir):
    """The fuel cells with their slope and aspect and the multipliers of their zones, and the extent that they cover."""
    zones = wui_modifiers(spark, sf_dir).select("row", "col", "ros_mult", "ember_mult")
    return cut(ground(spark, sf_dir).join(zones, ["row", "col"])), EXTENT  # its size is asked first, then its cells


def fires(spark, sf_dir, hours: float = 2.0):
    """A fire beside each station, in a fuel and weather that follow from the station's number and reading."""
    k, fuel = F.col("station"), F.array(*[F.lit(c) for c in CODES])
    s = V.stations(spark, sf_dir).select(
        k.alias("sim"), F.element_at(fuel, (k % 18 + 1).cast("int")).alias("fuel"), (F.abs("reading") % 60.0).alias("wind"), (k * 11 % 360).cast("double").alias("dir"), (80.0 + (k * 13 % 160).cast("double") / 10.0).alias("ffmc"),
        (F.abs("reading") % 150.0).alias("dmc"), (k * 31 % 800).cast("double").alias("dc"), (k % 101).cast("double").alias("pc"), (50.0 + (k % 51).cast("double")).alias("cure"), F.col("slat").alias("lat"), F.col("slng").alias("lng"),
    )
    return s.withColumns({"hours": F.lit(hours), "snapshot": F.lit(0.5)})


@query()
def huygens_frames(spark, sf_dir):
    """Frames of wavelet fires over the fuel cells, with their terrain, the multipliers of zones, barriers and embers."""
    x = huygens.frames(fires(spark, sf_dir), *fuel_grid(spark, sf_dir))
    return x.select("sim", "idx", "t", "n_fronts", "n_points", r("area_ha", 4), r("head_ros", 5), r("hfi", 3), "fire_type")


@query()
def override(spark, sf_dir):
    """Fires that go on from an observed perimeter."""
    ring = G.circle(F.col("lat"), F.col("lng"), F.lit(200.0), 36)
    x = huygens.frames(fires(spark, sf_dir, 1.0).withColumn("front", ring), *fuel_grid(spark, sf_dir))
    return x.select("sim", "idx", "t", "n_points", r("area_ha", 4), r("hfi", 3), "fire_type")


#: Days of a scenario at most, as in the reference.
DAYS = 7


@query()
def multiday(spark, sf_dir):
    """Up to DAYS days of one fire per station, each of 24 hours: each day's codes from the chain, its front from the day before."""
    cells, extent = fuel_grid(spark, sf_dir)
    grid = (cut(cells), extent)  # read by every day
    days = weather.chain(spark, sf_dir).where(F.col("day") <= DAYS).select(F.col("station").alias("sim"), "day", "ffmc", "dmc", "dc", "wind")
    days = cut(days)
    front, out = None, None
    for d in range(1, DAYS + 1):
        s = days.where(F.col("day") == d).select("sim", F.lit("D1").alias("fuel"), "wind", F.lit(270.0).alias("dir"), "ffmc", "dmc", "dc", F.lit(50.0).alias("pc"), F.lit(60.0).alias("cure"), F.lit(53.55).alias("lat"), F.lit(-113.5).alias("lng"), F.lit(24.0).alias("hours"), F.lit(2.0).alias("snapshot"))
        if front is not None:
            s = s.join(front, "sim")
        f = cut(huygens.frames(s, *grid))
        front = f.groupBy("sim").agg(F.max_by("perimeter", "idx").alias("front"))
        shown = f.where("t > 0") if d > 1 else f
        part = shown.select("sim", F.lit(d).alias("day"), F.round(F.col("t") + 24.0 * (d - 1), 3).alias("t"), r("area_ha", 4), "fire_type")
        out = part if out is None else out.unionByName(part)
    return out
