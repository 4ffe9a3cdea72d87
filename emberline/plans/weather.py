"""Fire weather queries: codes and indices, the daily chain, and checks of what comes in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberline.functions import fwi as W
from emberline.functions.fuels import CODES
from emberline.operators import validation
from emberline.plans import sql as S
from emberline.plans.registry import query, r
from emberline.sources import views as V
from emberline.streaming import stations as T


def _indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = V.scenarios(spark, sf_dir).select("scen", W.isi(F.col("ffmc"), F.col("wind")).alias("isi"), W.bui(F.col("dmc"), F.col("dc")).alias("bui"))
    return s.withColumn("fwi", W.fwi(F.col("isi"), F.col("bui")))


_INDICES = f"WITH x AS (SELECT scen, {S.isi('ffmc', 'wind')} AS isi, {S.bui('dmc', 'dc')} AS bui FROM v_scen), y AS (SELECT *, {S.fwi('isi', 'bui')} AS fwi FROM x)"


@query(S.query("v_scen", f"{_INDICES} SELECT scen, round(isi, 6) AS isi, round(bui, 6) AS bui, round(fwi, 6) AS fwi FROM y"))
def isi_bui_fwi(spark, sf_dir):
    return _indices(spark, sf_dir).select("scen", r("isi"), r("bui"), r("fwi"))


@query(S.query("v_scen", f"{_INDICES} SELECT CASE WHEN fwi >= 30 THEN 'Very High / Extreme' WHEN fwi >= 19 THEN 'High' WHEN fwi >= 10 THEN 'Moderate' ELSE 'Low' END AS danger, count(*) AS n, round(max(fwi), 6) AS peak FROM y GROUP BY 1"))
def danger_rating(spark, sf_dir):
    return _indices(spark, sf_dir).groupBy(W.danger(F.col("fwi")).alias("danger")).agg(F.count("*").alias("n"), r(F.max("fwi")).alias("peak"))


@query(S.query("v_scen", f"{_INDICES} SELECT CASE WHEN fwi < 5 THEN 'Low' WHEN fwi < 10 THEN 'Moderate' WHEN fwi < 20 THEN 'High' WHEN fwi < 30 THEN 'Very High' ELSE 'Extreme' END AS danger, count(*) AS n FROM y GROUP BY 1"))
def danger_rating_ui(spark, sf_dir):
    return _indices(spark, sf_dir).groupBy(W.danger_screen(F.col("fwi")).alias("danger")).agg(F.count("*").alias("n"))


def _single(spark, sf_dir):
    o = V.observations(spark, sf_dir)
    before = {k: F.lit(v) for k, v in zip(("ffmc", "dmc", "dc"), W.START)}
    x = o.select("event_id", "wind", W.next_codes({k: F.col(k) for k in ("temp", "rh", "wind", "rain", "month")}, before).alias("c")).select("event_id", "wind", "c.*")
    x = x.withColumns({"isi": W.isi(F.col("ffmc"), F.col("wind")), "bui": W.bui(F.col("dmc"), F.col("dc"))})
    return x.withColumn("fwi", W.fwi(F.col("isi"), F.col("bui")))


_SINGLE = f"""WITH m AS (SELECT *, {S.ffmc('temp', 'rh', 'wind', 'rain', '85.0::DOUBLE')} AS mo FROM v_obs),
c AS (SELECT event_id, wind, {S.ffmc_of_moisture('temp', 'rh', 'wind', 'mo')} AS ffmc, {S.dmc('temp', 'rh', 'rain', 'month', '6.0::DOUBLE')} AS dmc, {S.dc('temp', 'rain', 'month', '15.0::DOUBLE')} AS dc FROM m),
i AS (SELECT *, {S.isi('ffmc', 'wind')} AS isi, {S.bui('dmc', 'dc')} AS bui FROM c), z AS (SELECT *, {S.fwi('isi', 'bui')} AS fwi FROM i)"""


@query(S.query("v_obs", f"{_SINGLE} SELECT event_id, round(ffmc, 6) AS ffmc, round(dmc, 6) AS dmc, round(dc, 6) AS dc, round(isi, 6) AS isi, round(bui, 6) AS bui, round(fwi, 6) AS fwi FROM z"))
def fwi_single_day(spark, sf_dir):
    return _single(spark, sf_dir).select("event_id", *[r(c) for c in ("ffmc", "dmc", "dc", "isi", "bui", "fwi")])


_CHAIN = f"""WITH m AS (
  SELECT station, day, temp, rh, wind, rain, month, {S.ffmc('temp', 'rh', 'wind', 'rain', '85.0::DOUBLE')} AS mo, 85.0::DOUBLE AS f0, 6.0::DOUBLE AS p0, 15.0::DOUBLE AS c0 FROM v_obs WHERE day = 1),
chain AS (
  SELECT station, day, wind, {S.ffmc_of_moisture('temp', 'rh', 'wind', 'mo')} AS ffmc, {S.dmc('temp', 'rh', 'rain', 'month', 'p0')} AS dmc, {S.dc('temp', 'rain', 'month', 'c0')} AS dc FROM m
  UNION ALL
  SELECT station, day, wind, {S.ffmc_of_moisture('temp', 'rh', 'wind', 'mo')} AS ffmc, {S.dmc('temp', 'rh', 'rain', 'month', 'p0')} AS dmc, {S.dc('temp', 'rain', 'month', 'c0')} AS dc FROM (
    SELECT o.*, {S.ffmc('o.temp', 'o.rh', 'o.wind', 'o.rain', 'p.ffmc')} AS mo, p.dmc AS p0, p.dc AS c0 FROM chain p JOIN v_obs o ON o.station = p.station AND o.day = p.day + 1)),
i AS (SELECT *, {S.isi('ffmc', 'wind')} AS isi, {S.bui('dmc', 'dc')} AS bui FROM chain), z AS (SELECT *, {S.fwi('isi', 'bui')} AS fwi FROM i)"""


def chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.daily_chain(V.observations(spark, sf_dir))


@query(S.query("v_obs", f"{_CHAIN} SELECT station, day, round(ffmc, 5) AS ffmc, round(dmc, 5) AS dmc, round(dc, 5) AS dc, round(isi, 5) AS isi, round(bui, 5) AS bui, round(fwi, 5) AS fwi FROM z"))
def fwi_chain(spark, sf_dir):
    return chain(spark, sf_dir).select("station", F.col("day").cast("long").alias("day"), *[r(c, 5) for c in ("ffmc", "dmc", "dc", "isi", "bui", "fwi")])


@query(S.query("v_obs", f"{_CHAIN}, y AS (SELECT station, day, round(fwi, 1) AS fwi FROM z) SELECT station, arg_max(day, (fwi, -day)) AS day, max(fwi) AS fwi FROM y GROUP BY station"))
def fwi_peak_day(spark, sf_dir):
    """The first day with the largest index, rounded as it is shown."""
    x = chain(spark, sf_dir).select("station", F.col("day").cast("long").alias("day"), F.round("fwi", 1).alias("fwi"))
    return x.groupBy("station").agg(F.max_by("day", F.struct("fwi", -F.col("day"))).alias("day"), F.max("fwi").alias("fwi"))


@query(S.query("v_obs", f"{_CHAIN} SELECT station, round(arg_max(ffmc, day), 5) AS ffmc, round(arg_max(dmc, day), 5) AS dmc, round(arg_max(dc, day), 5) AS dc FROM z GROUP BY station"))
def fwi_last_state(spark, sf_dir):
    x = chain(spark, sf_dir).groupBy("station").agg(F.max_by(F.struct("ffmc", "dmc", "dc"), "day").alias("s")).select("station", "s.*")
    return x.select("station", r("ffmc", 5), r("dmc", 5), r("dc", 5))


_SERVER = [("temp", -50, 60), ("rh", 0, 100), ("wind", 0, 200), ("rain", 0, 500)]
_SCREEN = [("temp", -40, 50), ("rh", 1, 100), ("wind", 0, 100), ("rain", 0, 300)]


def _broken(rules, columns="{}"):
    return "list_filter([" + ", ".join(f"CASE WHEN {c} < {a} OR {c} > {b} THEN '{c}' END" for c, a, b in rules) + "], lambda x: x IS NOT NULL)"


@query(S.query("v_obs", f"""WITH x AS (SELECT event_id, temp * 2.0::DOUBLE - 20.0::DOUBLE AS temp, rh * 1.1::DOUBLE AS rh, wind * 2.0::DOUBLE AS wind, rain * 10.0::DOUBLE AS rain FROM v_obs)
SELECT event_id, array_to_string({_broken(_SERVER)}, ',') AS server, array_to_string({_broken(_SCREEN)}, ',') AS screen FROM x"""))
def obs_validation(spark, sf_dir):
    """Which limits each observation breaks, by the service's rules and by the planning screen's."""
    x = V.observations(spark, sf_dir).select("event_id", (F.col("temp") * 2.0 - 20.0).alias("temp"), (F.col("rh") * 1.1).alias("rh"), (F.col("wind") * 2.0).alias("wind"), (F.col("rain") * 10.0).alias("rain"))
    return x.select("event_id", F.array_join(validation.broken(_SERVER), ",").alias("server"), F.array_join(validation.broken(_SCREEN), ",").alias("screen"))


@query(S.query("v_obs", """WITH x AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'n/a' ELSE CAST(event_id % 50 - 10 AS VARCHAR) END AS raw FROM v_obs)
SELECT event_id, CASE WHEN try_cast(raw AS DOUBLE) >= 0 THEN try_cast(raw AS DOUBLE) END AS reading, try_cast(raw AS DOUBLE) AS signed FROM x"""))
def sensor_clean(spark, sf_dir):
    """Sensor texts as numbers: negative and unreadable ones are null; a second column keeps negative ones."""
    raw = F.when(F.col("event_id") % 7 == 0, "n/a").otherwise((F.col("event_id") % 50 - 10).cast("string"))
    x = V.observations(spark, sf_dir).select("event_id", raw.alias("raw"))
    return x.select("event_id", validation.reading(F.col("raw")).alias("reading"), validation.reading(F.col("raw"), keep_negative=True).alias("signed"))


@query(S.query("v_scen fuels", "WITH x AS (SELECT scen, CASE WHEN scen % 5 = 0 THEN 'X9' ELSE fuel END AS asked FROM v_scen) SELECT coalesce(f.fuel, 'C2') AS fuel, count(*) AS n FROM x LEFT JOIN fuels f ON x.asked = f.fuel GROUP BY 1"))
def fuel_default(spark, sf_dir):
    """Codes that aren't known count as C2."""
    asked = F.when(F.col("scen") % 5 == 0, "X9").otherwise(F.col("fuel"))
    x = V.scenarios(spark, sf_dir).select(asked.alias("asked"))
    return x.groupBy(F.when(F.col("asked").isin(*CODES), F.col("asked")).otherwise("C2").alias("fuel")).agg(F.count("*").alias("n"))


@query(S.query("v_obs", f"{_SINGLE}, d AS (SELECT event_id // 100 AS station, fwi FROM z) SELECT station, round(avg(fwi), 5) AS mean_fwi, round(max(fwi), 6) AS top_fwi, count(*) FILTER (fwi >= 19) AS high_days FROM d GROUP BY station"))
def fwi_summary(spark, sf_dir):
    d = _single(spark, sf_dir).select(F.floor(F.col("event_id") / 100).alias("station"), "fwi")
    return d.groupBy("station").agg(r(F.avg("fwi"), 5).alias("mean_fwi"), r(F.max("fwi")).alias("top_fwi"), F.count_if(F.col("fwi") >= 19).alias("high_days"))


@query(S.query("v_obs", f"{_CHAIN} SELECT station, day, round(ffmc, 5) AS ffmc, round(dmc, 5) AS dmc, round(dc, 5) AS dc FROM chain"))
def fwi_stream(spark, sf_dir):
    """The chain as a stream: observations come in by files, each station's codes are kept as state."""
    return T.replay(spark, V.observations(spark, sf_dir)).select("station", "day", *[r(c, 5) for c in ("ffmc", "dmc", "dc")])


@query("""WITH w AS (SELECT time_bucket(INTERVAL '1 day', ts) AS day, user_id AS station, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY 1, 2)
SELECT * FROM w WHERE day + INTERVAL '1 day' <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL '2 days' FROM events)""")
def stream_daily_means(spark, sf_dir):
    """Means by station and day from a stream, as far as the watermark, two days behind the latest report, has closed the days."""
    e = V.table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("station"), F.col("value").alias("temp"), F.col("value").alias("wind"))
    x = T.through(spark, e, T.daily_means)
    return x.select(F.col("window.start").cast("timestamp_ntz").alias("day"), "station", "n", r("temp").alias("mean_value"))


@query(S.query("v_frame", "SELECT DISTINCT sim, idx, round(t, 3) AS t FROM v_frame"))
def stream_distinct_frames(spark, sf_dir):
    """Frames from a stream in which a reconnecting reader gets every frame again."""
    f = V.frames(spark, sf_dir).select("sim", "idx", F.round("t", 3).alias("t"), F.timestamp_seconds(1.7e9 + F.col("t") * 3600.0).alias("ts"))
    return T.through(spark, f.unionAll(f), T.distinct_frames).select("sim", "idx", "t")


@query("""SELECT time_bucket(INTERVAL '1 day', ts) AS day, user_id AS station, count(*) AS n, round(avg(value), 6) AS mean_value, round(max(value), 6) AS max_value FROM events GROUP BY 1, 2""")
def daily_windows(spark, sf_dir):
    """Observations per station in tumbling windows of a day."""
    e = V.table(spark, sf_dir, "events")
    g = e.groupBy(F.window("ts", "1 day").alias("w"), F.col("user_id").alias("station"))
    return g.agg(F.count("*").alias("n"), r(F.avg("value")).alias("mean_value"), r(F.max("value")).alias("max_value")).select(F.col("w.start").alias("day"), "station", "n", "mean_value", "max_value")


@query("""WITH e AS (SELECT user_id AS station, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL '6 hours' AS gap, event_id FROM events),
s AS (SELECT station, ts, sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY station ORDER BY ts, event_id) AS session FROM e)
SELECT station, CAST(session AS BIGINT) AS session, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM s GROUP BY ALL""")
def report_sessions(spark, sf_dir):
    """Runs of reports of a station without a gap of more than six hours."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = V.table(spark, sf_dir, "events").select("user_id", "ts", "event_id", (F.col("ts") > F.lag("ts").over(w) + F.expr("interval 6 hours")).alias("gap"))
    s = e.withColumn("session", F.sum(F.when(F.col("gap"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return s.groupBy(F.col("user_id").alias("station"), "session").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"))
