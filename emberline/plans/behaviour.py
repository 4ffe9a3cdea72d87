"""Fire behaviour queries over scenarios."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from emberline.functions import advice as A
from emberline.functions import fbp as B
from emberline.functions import fwi as W
from emberline.functions import geometry as G
from emberline.functions import rng as R
from emberline.functions.fuels import fuel_table
from emberline.plans import sql as S
from emberline.plans.registry import query, r
from emberline.sources import views as V


@query(S.query("v_scen fuels", f"{S.fbp()} SELECT fuel, fire_type, count(*) AS n, round(avg(ros_final), 5) AS mean_ros, round(max(hfi), 3) AS top_hfi FROM fbp GROUP BY fuel, fire_type"))
def fbp_by_fuel(spark, sf_dir):
    """Which fuels crown under these conditions, how fast and how hot: the flagship query."""
    x = B.with_fbp(V.scenarios(spark, sf_dir))
    return x.groupBy("fuel", "fire_type").agg(F.count("*").alias("n"), r(F.avg("ros_final"), 5).alias("mean_ros"), r(F.max("hfi"), 3).alias("top_hfi"))


_ROW = "scen, fuel, fire_type, round(ros_surface, 6) AS ros_surface, round(ros_final, 6) AS ros_final, round(sfi, 3) AS sfi, round(csi, 3) AS csi, round(cfb, 6) AS cfb, round(tfc, 6) AS tfc, round(hfi, 3) AS hfi, round(flame, 5) AS flame"


def _rows(x):
    return x.select("scen", "fuel", "fire_type", r("ros_surface"), r("ros_final"), r("sfi", 3), r("csi", 3), r("cfb"), r("tfc"), r("hfi", 3), r("flame", 5))


@query(S.query("v_scen fuels", f"{S.fbp('0.0::DOUBLE')} SELECT {_ROW} FROM fbp"))
def fbp_rows(spark, sf_dir):
    return _rows(B.with_fbp(V.scenarios(spark, sf_dir), slope=False))


@query(S.query("v_scen fuels", f"{S.fbp()} SELECT {_ROW} FROM fbp"))
def fbp_slope(spark, sf_dir):
    return _rows(B.with_fbp(V.scenarios(spark, sf_dir)))


@query(S.query("v_scen fuels", f"{S.fbp(fmc='(85.0::DOUBLE + CAST(scen % 40 AS DOUBLE))')} SELECT {_ROW} FROM fbp"))
def fbp_fmc(spark, sf_dir):
    """With a foliar moisture of its own in each row."""
    return _rows(B.with_fbp(V.scenarios(spark, sf_dir), fmc=85.0 + (F.col("scen") % 40).cast("double")))


@query(S.query("v_scen fuels", f"SELECT scen, round({S.bui_effect(S.bui('dmc', 'dc'), 'q', 'bui0')}, 6) AS effect FROM v_scen JOIN fuels USING (fuel)"))
def bui_effect(spark, sf_dir):
    x = V.scenarios(spark, sf_dir).join(F.broadcast(fuel_table(spark)), "fuel")
    return x.select("scen", r(B.bui_effect(W.bui(F.col("dmc"), F.col("dc")), F.col("q"), F.col("bui0"))).alias("effect"))


@query(S.query("v_scen", f"SELECT scen, round({S.curing('cure')}, 6) AS factor FROM v_scen"))
def grass_curing(spark, sf_dir):
    return V.scenarios(spark, sf_dir).select("scen", r(B.grass_curing(F.col("cure"))).alias("factor"))


@query(S.query("v_scen fuels", f"WITH x AS (SELECT *, {S.isi('ffmc', 'wind')} * {S.directional_slope('slope', '180.0::DOUBLE', 'dir')} AS isi, {S.bui('dmc', 'dc')} AS bui FROM v_scen JOIN fuels USING (fuel)) SELECT scen, round(isi, 5) AS isf, round({S.surface_ros()}, 5) AS rsf FROM x"))
def surface_ros_isf(spark, sf_dir):
    """Spread on a slope through the slope-adjusted spread index."""
    x = V.scenarios(spark, sf_dir).join(F.broadcast(fuel_table(spark)), "fuel")
    x = x.withColumns({"isf": W.isi(F.col("ffmc"), F.col("wind")) * G.directional_slope(F.col("slope"), F.lit(180.0), F.col("dir")), "bui": W.bui(F.col("dmc"), F.col("dc"))})
    return x.select("scen", r("isf", 5), r(B.surface_ros(F.col("isf"), F.col("bui"), F.col("pc"), F.col("cure")), 5).alias("rsf"))


@query(S.query("v_scen", "SELECT scen, round(CASE WHEN dmc - 20.0::DOUBLE <= 0 THEN 0.0::DOUBLE ELSE 0.0775::DOUBLE * pow((dmc - 20.0::DOUBLE) * 100.0::DOUBLE, 0.46::DOUBLE) END, 6) AS flame FROM v_scen"))
def flame_length(spark, sf_dir):
    return V.scenarios(spark, sf_dir).select("scen", r(B.flame_length((F.col("dmc") - 20.0) * 100.0)).alias("flame"))


@query(S.query("v_scen", f"WITH x AS (SELECT scen, dmc, {S.lbr('wind')} AS l FROM v_scen) SELECT scen, round(l, 6) AS lbr, round(dmc / (l * l), 6) AS back, round(dmc / l, 6) AS flank, round(CASE WHEN l <= 1 THEN 0.0::DOUBLE ELSE sqrt(greatest(1.0::DOUBLE - 1.0::DOUBLE / (l * l), 0.0::DOUBLE)) END, 6) AS ecc FROM x"))
def lbr_back_flank(spark, sf_dir):
    x = V.scenarios(spark, sf_dir).select("scen", "dmc", G.length_to_breadth(F.col("wind")).alias("lbr"))
    return x.select("scen", r("lbr"), r(G.back_ros(F.col("dmc"), F.col("lbr"))).alias("back"), r(G.flank_ros(F.col("dmc"), F.col("lbr"))).alias("flank"), r(G.eccentricity(F.col("lbr"))).alias("ecc"))


@query(S.query("v_scen", f"WITH x AS (SELECT scen, (dmc / 10.0::DOUBLE + dmc / 10.0::DOUBLE / ({S.lbr('wind')} * {S.lbr('wind')})) * 2.0::DOUBLE * 60.0::DOUBLE / 2.0::DOUBLE AS a, {S.lbr('wind')} AS l FROM v_scen) SELECT scen, round({math.pi!r}::DOUBLE * a * (a / l) / 10000.0::DOUBLE, 4) AS area_ha FROM x"))
def ellipse_area(spark, sf_dir):
    return V.scenarios(spark, sf_dir).select("scen", r(G.ellipse_area_ha(F.col("dmc") / 10.0, G.length_to_breadth(F.col("wind")), F.lit(2.0)), 4).alias("area_ha"))


@query(S.query("v_scen", f"""WITH x AS (SELECT scen, dmc / 10.0::DOUBLE AS head, {S.lbr('wind')} AS l, dir * {S.RAD} AS turn FROM v_scen),
y AS (SELECT scen, l, turn, (head + head / (l * l)) * 60.0::DOUBLE / 2.0::DOUBLE AS a, (head - head / (l * l)) * 60.0::DOUBLE / 2.0::DOUBLE AS ahead, unnest(range(0, 73)) AS i FROM x),
z AS (SELECT scen, i, turn, ahead + a * cos((i % 72) * {2 * math.pi / 72!r}::DOUBLE) AS u, a / l * sin((i % 72) * {2 * math.pi / 72!r}::DOUBLE) AS v FROM y)
SELECT scen, CAST(i AS INTEGER) AS i, round(53.5::DOUBLE + (u * cos(turn) - v * sin(turn)) / 111320.0::DOUBLE, 6) AS lat, round(-113.5::DOUBLE + (u * sin(turn) + v * cos(turn)) / (111320.0::DOUBLE * cos(53.5::DOUBLE * {S.RAD})), 6) AS lng FROM z"""))
def ellipse_points(spark, sf_dir):
    """The ellipse after an hour, point by point, of every scenario."""
    return _ellipses(V.scenarios(spark, sf_dir))


@query()
def ellipse_rings(spark, sf_dir):
    """The same under its other name."""
    return _ellipses(V.scenarios(spark, sf_dir))


def _ellipses(x):
    x = x.select("scen", "dmc", "wind", "dir")
    points = G.ellipse_points(x, 53.5, -113.5, F.col("dmc") / 10.0, G.length_to_breadth(F.col("wind")), F.col("dir"), 60.0)
    return points.select("scen", "i", r(F.col("lat")).alias("lat"), r(F.col("lng")).alias("lng"))


@query(S.query("v_scen", f"SELECT slope, count(*) AS n, round(any_value({S.slope_factor('slope')}), 6) AS factor FROM v_scen GROUP BY slope"))
def slope_factor(spark, sf_dir):
    return V.scenarios(spark, sf_dir).groupBy("slope").agg(F.count("*").alias("n"), r(F.any_value(B.slope_factor(F.col("slope")))).alias("factor"))


@query(S.query("v_scen", f"SELECT scen, round({S.directional_slope('slope', '(cure * 3.0::DOUBLE)', 'dir')}, 6) AS factor FROM v_scen"))
def slope_directional(spark, sf_dir):
    return V.scenarios(spark, sf_dir).select("scen", r(G.directional_slope(F.col("slope"), F.col("cure") * 3.0, F.col("dir"))).alias("factor"))


@query(S.query("v_scen", f"WITH x AS (SELECT *, unnest(range(0, 8)) * 45.0::DOUBLE AS angle FROM v_scen) SELECT scen, angle, round({S.spread_prob('angle', '((dir + 180.0::DOUBLE) % 360.0::DOUBLE)', 'dmc', S.lbr('wind'), '50.0::DOUBLE', '1.0::DOUBLE')}, 6) AS p FROM x"))
def spread_prob_8dir(spark, sf_dir):
    x = V.scenarios(spark, sf_dir).withColumn("angle", F.explode(F.array(*[F.lit(45.0 * k) for k in range(8)])))
    return x.select("scen", "angle", r(G.spread_probability(F.col("angle"), (F.col("dir") + 180.0) % 360.0, F.col("dmc"), G.length_to_breadth(F.col("wind")), F.lit(50.0), F.lit(1.0))).alias("p"))


def _wavelet_sql() -> str:
    return f"""{S.fbp('0.0::DOUBLE')},
y AS (SELECT *, {S.lbr('wind')} AS l, (dir + 180.0::DOUBLE) % 360.0::DOUBLE AS toward, unnest(range(0, 36)) AS ray FROM fbp),
z AS (SELECT y.* EXCLUDE (isi), isi AS isi0, ros_surface AS flat, ray * 10.0::DOUBLE AS deg, isi * {S.directional_slope('slope', '90.0::DOUBLE', '(ray * 10.0::DOUBLE)')} AS isi FROM y),
u AS (SELECT *, {S.surface_ros()} AS rsf, (ros_final + ros_final / (l * l)) / 2.0::DOUBLE AS ax, ros_final / l AS bx, (ros_final - ros_final / (l * l)) / 2.0::DOUBLE AS off, (deg - toward) * {S.RAD} AS t FROM z),
v AS (SELECT *, CASE WHEN ros_final <= 0.001 THEN 0.0::DOUBLE ELSE ax * bx / sqrt(bx * cos(t) * bx * cos(t) + ax * sin(t) * ax * sin(t)) * CASE WHEN flat > 0.001 THEN rsf / flat ELSE isi / nullif(isi0, 0) END * 5.0::DOUBLE END AS reach, CASE WHEN ros_final <= 0.001 THEN 0.0::DOUBLE ELSE off * 5.0::DOUBLE END AS shift FROM u)
SELECT scen, CAST(ray AS INTEGER) AS ray, round(shift * cos(toward * {S.RAD}) + reach * cos(deg * {S.RAD}), 3) + 0.0::DOUBLE AS north_m, round(shift * sin(toward * {S.RAD}) + reach * sin(deg * {S.RAD}), 3) + 0.0::DOUBLE AS east_m FROM v"""


@query(S.query("v_scen fuels", _wavelet_sql()))
def wavelet_step(spark, sf_dir):
    """The 36 rays by which one front vertex of each scenario spreads in five minutes, in metres."""
    from emberline.operators.huygens import rays

    return rays(V.scenarios(spark, sf_dir), F.lit(90.0), 5.0).select("scen", "ray", (F.round("north_m", 3) + 0.0).alias("north_m"), (F.round("east_m", 3) + 0.0).alias("east_m"))


@query(S.query("v_scen", f"""WITH x AS (SELECT scen, wind, ffmc, {R.uniform_sql('42', 'scen', '1')} AS u1, {R.uniform_sql('42', 'scen', '2')} AS u2, {R.uniform_sql('42', 'scen', '3')} AS u3, {R.uniform_sql('42', 'scen', '4')} AS u4 FROM v_scen)
SELECT scen, round((u1 * 2.0::DOUBLE - 1.0::DOUBLE) * 100.0::DOUBLE, 6) AS north_m, round((u2 * 2.0::DOUBLE - 1.0::DOUBLE) * 100.0::DOUBLE, 6) AS east_m, round(greatest(0.0::DOUBLE, wind * (1.0::DOUBLE + (u3 * 2.0::DOUBLE - 1.0::DOUBLE) * 0.1::DOUBLE)), 6) AS wind,
  round(greatest(0.0::DOUBLE, least(101.0::DOUBLE, ffmc - (u4 * 2.0::DOUBLE - 1.0::DOUBLE) * 5.0::DOUBLE * 0.35::DOUBLE)), 6) AS ffmc FROM x"""))
def mc_draws(spark, sf_dir):
    """Monte-Carlo draws: where the ignition moves, and how wind and fine fuel moisture vary."""
    from emberline.operators.montecarlo import draws

    return draws(V.scenarios(spark, sf_dir), "scen", seed=42).select("scen", r("north_m"), r("east_m"), r("wind"), r("ffmc"))


@query(S.query("v_scen fuels", f"""{S.fbp('0.0::DOUBLE')} SELECT scen, round(hfi, 3) AS hfi, round(least(0.15::DOUBLE, hfi / 30000.0::DOUBLE), 6) AS p, round(pow(wind, 1.5::DOUBLE) * least(2.0::DOUBLE, sqrt(hfi / 4000.0::DOUBLE)) * 0.3::DOUBLE, 4) AS least_m, round(pow(wind, 1.5::DOUBLE) * least(2.0::DOUBLE, sqrt(hfi / 4000.0::DOUBLE)), 4) AS most_m,
  {R.uniform_sql('7', 'scen', '1')} <= least(0.15::DOUBLE, hfi / 30000.0::DOUBLE) AS throws FROM fbp WHERE hfi >= 4000"""))
def spot_candidates(spark, sf_dir):
    """Scenarios that throw embers: chance in five minutes, and range of distances."""
    from emberline.operators.spotting import ember_range

    x = B.with_fbp(V.scenarios(spark, sf_dir), slope=False)
    # as a generator: a filter would be moved below the join with the whole formula of the intensity in it
    x = x.select("scen", "wind", F.explode(F.filter(F.array("hfi"), lambda h: h >= 4000)).alias("hfi"))
    p, low, high = ember_range(F.col("wind"), F.col("hfi"))
    return x.select("scen", r("hfi", 3), r(p).alias("p"), r(low, 4).alias("least_m"), r(high, 4).alias("most_m"), (R.uniform(F.lit(7), F.col("scen"), F.lit(1)) <= p).alias("throws"))


@query(S.query("v_scen fuels", f"""{S.fbp()} SELECT CASE WHEN hfi < 200 THEN 'I' WHEN hfi < 500 THEN 'II' WHEN hfi < 2000 THEN 'III' WHEN hfi < 4000 THEN 'IV' ELSE 'V' END AS class,
  CASE WHEN hfi < 10 THEN 0 WHEN hfi < 500 THEN 1 WHEN hfi < 2000 THEN 2 WHEN hfi < 4000 THEN 3 WHEN hfi < 10000 THEN 4 ELSE 5 END AS band, count(*) AS n FROM fbp GROUP BY 1, 2"""))
def intensity_bands(spark, sf_dir):
    """Scenarios by the suppression classes and by the metric bands."""
    x = B.with_fbp(V.scenarios(spark, sf_dir))
    return x.groupBy(A.intensity_class(F.col("hfi")).alias("class"), A.intensity_band(F.col("hfi")).alias("band")).agg(F.count("*").alias("n"))


_POINTS = S._list(A.POINTS, True)


@query(S.query("v_scen", f"SELECT {_POINTS}[CAST(floor(dir / 22.5::DOUBLE + 0.5::DOUBLE) AS BIGINT) % 16 + 1] AS wind_label, count(*) AS n, round(avg(wind), 6) AS mean_wind FROM v_scen GROUP BY 1"))
def wind_labels(spark, sf_dir):
    return V.scenarios(spark, sf_dir).groupBy(A.wind_label(F.col("dir")).alias("wind_label")).agg(F.count("*").alias("n"), r(F.avg("wind")).alias("mean_wind"))
