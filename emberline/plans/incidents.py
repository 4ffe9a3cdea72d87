"""Queries for running an incident: records and summaries of frames, tiers over time, carried values, lists, and report pages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from emberline.functions import advice as A
from emberline.functions import fbp as B
from emberline.functions import geometry as G
from emberline.operators import consequences as C
from emberline.operators import spatial
from emberline.plans import consequences as P
from emberline.plans import sql as S
from emberline.plans.grids import _FUEL, EXTENT, fuel_cells
from emberline.plans.registry import query, r
from emberline.sources import exports
from emberline.sources import facilities as FA
from emberline.sources import views as V


def _shown(c, digits: int):
    """Rounded half up in plain doubles, as a screen does; round() would go by the decimal digits."""
    return F.floor(c * 10.0**digits + 0.5) / 10.0**digits


def _shown_sql(c: str, digits: int) -> str:
    return f"(floor({c} * {10.0**digits!r}::DOUBLE + 0.5::DOUBLE) / {10.0**digits!r}::DOUBLE)"


@query(S.query("v_frame", f"WITH {P._AREA}, x AS (SELECT f.*, round(area_ha, 6) AS area_ha, CASE WHEN hfi <= 0 THEN 0.0::DOUBLE ELSE round(0.0775::DOUBLE * pow(hfi, 0.46::DOUBLE), 6) END AS flame FROM v_frame f JOIN area a ON f.sim = a.sim AND f.idx = a.idx) SELECT sim, idx, t, {_shown_sql('area_ha', 2)} AS area_ha, {_shown_sql('ros', 2)} AS ros, {_shown_sql('hfi', 1)} AS hfi, {_shown_sql('flame', 2)} AS flame_m, fire_type FROM x"))
def frame_records(spark, sf_dir):
    """Frames as a service shows them, rounded."""
    f = V.frames(spark, sf_dir)
    area, flame = r(G.area_ha(F.col("perimeter"))), r(B.flame_length(F.col("hfi")))
    return f.select("sim", "idx", "t", _shown(area, 2).alias("area_ha"), _shown(F.col("ros"), 2).alias("ros"), _shown(F.col("hfi"), 1).alias("hfi"), _shown(flame, 2).alias("flame_m"), "fire_type")


@query(S.query("v_frame", "SELECT sim, count(*) AS n_frames, max(t) AS hours, arg_max(radius, idx) AS last_radius, arg_max(fire_type, idx) AS last_type FROM v_frame WHERE idx <= 10 GROUP BY sim"))
def frames_to_cursor(spark, sf_dir):
    """What a player that stands at the eleventh frame of each fire shows."""
    f = V.frames(spark, sf_dir).where("idx <= 10")
    return f.groupBy("sim").agg(F.count("*").alias("n_frames"), F.max("t").alias("hours"), F.max_by("radius", "idx").alias("last_radius"), F.max_by("fire_type", "idx").alias("last_type"))


@query(S.query("v_frame", "WITH d AS (SELECT *, idx // 48 + 1 AS day, t - 24.0::DOUBLE * (idx // 48) AS own FROM v_frame) SELECT sim, CAST(day AS INTEGER) AS day, idx, round(own + 24.0::DOUBLE * (day - 1), 3) AS t FROM d WHERE day = 1 OR own > 0"))
def day_offsets(spark, sf_dir):
    """Hours within each day's run as hours of the whole; a later day's first frame repeats the day before and goes."""
    day = F.floor(F.col("idx") / 48) + 1
    d = V.frames(spark, sf_dir).select("sim", "idx", day.cast("int").alias("day"), (F.col("t") - 24.0 * F.floor(F.col("idx") / 48)).alias("own"))
    return d.where("day = 1 or own > 0").select("sim", "day", "idx", F.round(F.col("own") + 24.0 * (F.col("day") - 1), 3).alias("t"))


@query(S.query("v_frame v_asset", f"WITH {P._INSIDE}, x AS (SELECT community, sim, rank, max(CASE WHEN rank >= 2 THEN rank ELSE 0 END) OVER (PARTITION BY community ORDER BY sim ROWS UNBOUNDED PRECEDING) AS reached FROM tiers) SELECT sim, rank, reached, count(*) AS n FROM x GROUP BY ALL"))
def tiers_reached(spark, sf_dir):
    """The highest tier (Order or Alert) that communities have reached so far, fire after fire."""
    _, found = P.evacuation(spark, sf_dir, P.places(spark, sf_dir))
    so_far = Window.partitionBy("community").orderBy("sim").rowsBetween(Window.unboundedPreceding, 0)
    x = found.withColumn("reached", F.max(F.when(F.col("rank") >= 2, F.col("rank")).otherwise(0)).over(so_far))
    return x.groupBy("sim", "rank", "reached").agg(F.sum("n").alias("n"))


@query(S.query("v_obs", "SELECT station, day, last_value(CASE WHEN kind = 'view' THEN round(wind, 6) END IGNORE NULLS) OVER (PARTITION BY station ORDER BY day ROWS UNBOUNDED PRECEDING) AS wind, coalesce(rain, 0) AS rain FROM v_obs"))
def period_carry(spark, sf_dir):
    """Weather of an operational period: its own if it was entered, else what the latest period before had."""
    w = Window.partitionBy("station").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    o = V.observations(spark, sf_dir)
    entered = F.when(F.col("kind") == "view", F.round("wind", 6))
    return o.select("station", F.col("day").cast("long").alias("day"), F.last(entered, ignorenulls=True).over(w).alias("wind"), F.coalesce("rain", F.lit(0.0)).alias("rain"))


@query("SELECT o_orderkey AS scen, o_orderdate AS saved FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 10")
def newest_scenarios(spark, sf_dir):
    """The ten scenarios saved last."""
    o = V.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("scen"), F.col("o_orderdate").alias("saved"))
    return o.orderBy(F.desc("saved"), "scen").limit(10)


@query(S.query("v_asset", f"{FA._TAGGED} SELECT osm_id, name, round({S.haversine('53.55::DOUBLE', '-113.5::DOUBLE', 'lat', 'lng')}, 5) AS km FROM n WHERE symbol = 'hospital'"))
def hospital_distances(spark, sf_dir):
    """How far each hospital is from the point of ignition."""
    x = FA.normalised(FA.tagged(spark, sf_dir)).where("symbol = 'hospital'")
    return x.select("osm_id", "name", r(G.haversine_km(F.lit(53.55), F.lit(-113.5), F.col("lat"), F.col("lng")), 5).alias("km"))


_LAYER3 = "WITH n AS (SELECT layer, name, row_number() OVER (PARTITION BY layer ORDER BY name, asset) AS k, count(*) OVER (PARTITION BY layer) AS n FROM v_asset)"


@query(S.query("v_asset", f"{_LAYER3} SELECT layer, string_agg(name, ', ' ORDER BY k) || CASE WHEN any_value(n) > 3 THEN ' + ' || (any_value(n) - 3) || ' more' ELSE '' END AS label FROM n WHERE k <= 3 GROUP BY layer"))
def first_names(spark, sf_dir):
    """The first three names of each layer, and how many more there are. Only three rows a layer leave the scan's tasks."""
    a = V.assets(spark, sf_dir).select("layer", "name", "asset")
    n = a.groupBy("layer").agg(F.count("*").alias("n"))
    w = Window.partitionBy("layer").orderBy("name", "asset")
    top = a.withColumn("k", F.row_number().over(w)).where("k <= 3").groupBy("layer").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "name"))), lambda x: x["name"]).alias("names"))
    more = F.when(F.col("n") > 3, F.concat(F.lit(" + "), (F.col("n") - 3).cast("string"), F.lit(" more"))).otherwise("")
    return top.join(n, "layer").select("layer", F.concat(F.array_join("names", ", "), more).alias("label"))


@query(S.query("v_prob", "SELECT CAST(s AS INTEGER) AS percent, row, col FROM v_prob JOIN (SELECT unnest([25, 50, 75]) AS s) ON p >= s / 100.0::DOUBLE"))
def probability_cells(spark, sf_dir):
    """The cells of each probability contour, a row each, as an export takes them."""
    p = V.probabilities(spark, sf_dir)
    reached = F.filter(F.array(*[F.lit(t) for t in (25, 50, 75)]), lambda t: F.col("p") >= t / 100.0)
    return p.select(F.explode(reached).alias("percent"), "row", "col")


@query(S.query("v_frame v_cell codes", f"""{_FUEL}, {P._RING.replace('WITH ', '')}, c AS (SELECT sim, {S.cell('plat', 'plng')} FROM ring)
SELECT sim, coalesce(fuel, 'none') AS fuel, round(count(*) / sum(count(*)) OVER (PARTITION BY sim), 6) AS share FROM c LEFT JOIN g ON c.row = g.row AND c.col = g.col GROUP BY sim, coalesce(fuel, 'none')"""))
def front_fuel(spark, sf_dir):
    """Shares of the fuels under the vertices of each fire's fronts."""
    n_rows = V.n_rows(spark, sf_dir)
    v = V.frames(spark, sf_dir).select("sim", F.explode("perimeter").alias("p"))
    row, col, _ = spatial.cell_of(F.col("p.lat"), F.col("p.lng"), EXTENT, n_rows, V.COLS)
    x = v.select("sim", row.alias("row"), col.alias("col")).groupBy("sim", "row", "col").agg(F.count("*").alias("n"))
    x = x.join(fuel_cells(spark, sf_dir).select("row", "col", "fuel"), ["row", "col"], "left").groupBy("sim", F.coalesce("fuel", F.lit("none")).alias("fuel")).agg(F.sum("n").alias("n"))
    return x.select("sim", "fuel", r(F.col("n") / F.sum("n").over(Window.partitionBy("sim"))).alias("share"))


@query(S.query("v_scen fuels", f"{S.fbp()} SELECT CASE WHEN grouping(fuel_group) = 1 THEN 'all' ELSE fuel_group END AS fuel_group, CASE WHEN grouping(fire_type) = 1 THEN 'all' ELSE fire_type END AS fire_type, count(*) AS n, round(max(hfi), 3) AS top_hfi, round(avg(ros_final), 5) AS mean_ros FROM fbp GROUP BY CUBE (fuel_group, fire_type)"))
def behaviour_cube(spark, sf_dir):
    """Behaviour by fuel group and fire type, with all subtotals."""
    from emberline.functions.fuels import fuel_table

    x = B.with_fbp(V.scenarios(spark, sf_dir)).select("fuel", "fire_type", "hfi", "ros_final").join(F.broadcast(fuel_table(spark).select("fuel", "fuel_group")), "fuel")
    c = x.cube("fuel_group", "fire_type").agg(F.count("*").alias("n"), r(F.max("hfi"), 3).alias("top_hfi"), r(F.avg("ros_final"), 5).alias("mean_ros"), F.grouping("fuel_group").alias("g"), F.grouping("fire_type").alias("t"))
    named = lambda flag, c: F.when(F.col(flag) == 1, "all").otherwise(F.col(c)).alias(c)
    return c.select(named("g", "fuel_group"), named("t", "fire_type"), "n", "top_hfi", "mean_ros")


_LEVEL = "CASE " + " ".join(f"WHEN peak_hfi < {limit!r}::DOUBLE THEN '{name}'" for limit, name in A.COMPLEXITY[:-1]) + f" ELSE '{A.COMPLEXITY[-1][1]}' END"


@query(S.query("v_spot", f"WITH {P._STATS} SELECT {_LEVEL} AS level, count(*) AS n, round(max(peak_hfi), 3) AS top_hfi FROM st GROUP BY 1"))
def complexity(spark, sf_dir):
    """Fires by the kind of team that they call for."""
    x = C.spread_stats(V.frames(spark, sf_dir), V.spots(spark, sf_dir))
    return x.groupBy(A.complexity(F.col("peak_hfi")).alias("level")).agg(F.count("*").alias("n"), r(F.max("peak_hfi"), 3).alias("top_hfi"))


@query(S.query("v_spot", f"WITH {P._STATS} SELECT sim, '<h1>Fire ' || sim || '</h1><table><tr><td>Type</td><td>' || replace(final_type, '_', ' ') || '</td></tr><tr><td>Class</td><td>' || {P._CLASS.format(*[c[0] for c in A.CLASSES])} || '</td></tr><tr><td>Team</td><td>' || {_LEVEL} || '</td></tr><tr><td>Spots</td><td>' || spot_count || '</td></tr></table>' AS page FROM st"))
def incident_pages(spark, sf_dir):
    """A status page of each fire; texts are escaped."""
    x = C.spread_stats(V.frames(spark, sf_dir), V.spots(spark, sf_dir))
    rows = [("Type", F.replace(F.col("final_type"), F.lit("_"), F.lit(" "))), ("Class", A.intensity_class(F.col("peak_hfi"))), ("Team", A.complexity(F.col("peak_hfi"))), ("Spots", F.col("spot_count").cast("string"))]
    return x.select("sim", exports.page(F.concat(F.lit("Fire "), F.col("sim").cast("string")), rows).alias("page"))


@query(S.query("v_frame v_asset v_prob v_spot", f"""WITH {P._INSIDE}, a AS (SELECT asset, {P._CELL} FROM v_asset)
SELECT 'perimeter' AS layer, count(DISTINCT sim) AS n FROM v_frame UNION ALL SELECT 'ignition', count(DISTINCT sim) FROM v_frame UNION ALL SELECT 'spot', count(*) FROM (SELECT DISTINCT round(lat, 5), round(lng, 5) FROM v_spot)
UNION ALL SELECT 'probability', count(*) FROM v_prob WHERE p >= 0.05 UNION ALL SELECT 'at risk', count(*) FROM a JOIN v_prob p ON a.row = p.row AND a.col = p.col WHERE p >= 0.5 UNION ALL SELECT 'evacuation', count(*) FROM c JOIN hours USING (target)"""))
def export_bundle(spark, sf_dir):
    """Features of the whole export by its six layers."""
    found = exports.features(V.frames(spark, sf_dir), V.spots(spark, sf_dir)).select("layer", "feature")
    p, n_rows = V.probabilities(spark, sf_dir), V.n_rows(spark, sf_dir)
    cells = p.where("p >= 0.05").select(F.lit("probability").alias("layer"), exports.cell(F.col("row"), F.col("col"), EXTENT, n_rows, V.COLS, F.col("p")).alias("feature"))
    row, col, _ = spatial.cell_of(F.col("lat"), F.col("lng"), EXTENT, n_rows, V.COLS)
    named = F.to_json(F.struct("name"))
    assets = V.assets(spark, sf_dir).withColumns({"row": row, "col": col}).join(p.where("p >= 0.5"), ["row", "col"]).select(F.lit("at risk").alias("layer"), exports.point(F.col("lat"), F.col("lng"), named).alias("feature"))
    targets = spark.createDataFrame([(h, t) for t, _, h, _ in C.TIERS], "target double, tier string")
    zones = C.closest_frames(V.frames(spark, sf_dir), targets, 1.0).select(F.lit("evacuation").alias("layer"), G.geojson(F.col("perimeter"), F.to_json(F.struct("tier"))).alias("feature"))
    every = found.unionByName(cells).unionByName(assets).unionByName(zones)
    return every.groupBy("layer").agg(F.count("feature").alias("n"))


@query(S.query("v_frame", "SELECT sim, idx, t FROM v_frame UNION ALL SELECT DISTINCT sim, -1, 0.0::DOUBLE FROM v_frame"))
def frames_with_start(spark, sf_dir):
    """Frames with a first one of each fire put before them, as a player shows before anything has burned."""
    f = V.frames(spark, sf_dir).select("sim", "idx", "t")
    return f.unionByName(f.select("sim", F.lit(-1).alias("idx"), F.lit(0.0).alias("t")).distinct())


@query("SELECT event_type AS kind, count(*) AS n, CAST(max(CAST(json_extract_string(props, '$.k') AS INTEGER)) AS INTEGER) AS top_k FROM events GROUP BY 1")
def props_by_kind(spark, sf_dir):
    """A field of the JSON texts that observations carry."""
    e = V.table(spark, sf_dir, "events")
    return e.groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("n"), F.max(F.get_json_object("props", "$.k").cast("int")).alias("top_k"))
