"""Station observations as streams: daily codes as keyed state, and windows with late rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from emberline.functions import fwi as W

CODES = "station long, day long, ffmc double, dmc double, dc double"
_STATE = "last_day long, ffmc double, dmc double, dc double"


def _step(r, before: tuple[float, float, float]) -> tuple[float, float, float]:
    """One day's codes for plain numbers; the Column expressions of the batch chain are the definition."""
    import math

    f, p, d = before
    mo = 147.2 * (101.0 - f) / (59.5 + f)
    if r.rain > 0.5:
        rf = r.rain - 0.5
        wet = 42.5 * rf * math.exp(-100.0 / (251.0 - mo)) * (1.0 - math.exp(-6.93 / rf))
        mo = min(250.0, mo + wet + (0.0015 * (mo - 150.0) ** 2 * math.sqrt(rf) if mo > 150.0 else 0.0))
    heat = 0.18 * (21.1 - r.temp) * (1.0 - 1.0 / math.exp(0.115 * r.rh))
    even = [k * r.rh**e + c * math.exp((r.rh - 100.0) / 10.0) + heat for k, e, c in ((0.942, 0.679, 11.0), (0.618, 0.753, 10.0))]
    share = r.rh / 100.0 if mo > even[0] else (100.0 - r.rh) / 100.0
    speed = (0.424 * (1.0 - share**1.7) + 0.0694 * math.sqrt(r.wind) * (1.0 - share**8)) * 0.581 * math.exp(0.0365 * r.temp)
    goal = even[0] if mo > even[0] else even[1] if mo < even[1] else mo
    m = goal + (mo - goal) * 10.0**-speed
    if r.rain > 1.5:
        re = 0.92 * r.rain - 1.27
        b = 100.0 / (0.5 + 0.3 * p) if p <= 33 else 14.0 - 1.3 * math.log(p) if p <= 65 else 6.2 * math.log(p) - 17.2
        p = max(0.0, 244.72 - 43.43 * math.log(math.exp(5.6348 - p / 43.43) + 1000.0 * re / (48.77 + b * re)))
    if r.temp > -1.1:
        p += 1.894 * (r.temp + 1.1) * (100.0 - r.rh) * W.DMC_LENGTH[int(r.month) - 1] * 1e-4
    if r.rain > 2.8:
        d = max(0.0, 400.0 * math.log(800.0 / (800.0 * math.exp(-d / 400.0) + 3.937 * (0.83 * r.rain - 1.27))))
    if r.temp > -2.8:
        d += 0.5 * max(0.0, 0.36 * (r.temp + 2.8) + W.DC_LENGTH[int(r.month) - 1])
    return max(0.0, min(101.0, 59.5 * (250.0 - m) / (147.2 + m))), max(0.0, p), max(0.0, d)


def _carry(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last, *codes = state.get if state.exists else (0, *W.START)
    out = []
    rows = pd.concat(list(batches)).sort_values("day")
    for r in rows.itertuples(index=False):
        if r.day > last:  # a day that was counted already comes too late
            codes = _step(r, tuple(codes))
            last = r.day
            out.append((key[0], r.day, *codes))
    state.update((int(last), *map(float, codes)))
    yield pd.DataFrame(out, columns=["station", "day", "ffmc", "dmc", "dc"])


def daily_codes(observations: DataFrame) -> DataFrame:
    """A stream of (station, day, ffmc, dmc, dc) from a stream of observations; each station's last codes are its state."""
    return observations.groupBy("station").applyInPandasWithState(_carry, CODES, _STATE, "append", GroupStateTimeout.NoTimeout)


def daily_means(observations: DataFrame, late: str = "2 days") -> DataFrame:
    """Means per station and day of a stream with a column ts; rows later than ``late`` are left out."""
    return observations.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "station").agg(F.count("*").alias("n"), F.avg("temp").alias("temp"), F.avg("wind").alias("wind"))


def distinct_frames(frames: DataFrame, late: str = "1 hour") -> DataFrame:
    """A stream of frames without those that a reconnecting reader gets again."""
    return frames.withWatermark("ts", late).dropDuplicatesWithinWatermark(["sim", "idx"])


def through(spark: SparkSession, rows: DataFrame, change: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a stream of rows, changed, has written when it has come to its end. Rows and results lie in the shared folder."""
    from emberline.plans.tables import shared_folder

    place = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    rows.write.parquet(f"{place}/in")
    out = change(spark.readStream.schema(rows.schema).parquet(f"{place}/in"))
    out.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{place}/out")


def replay(spark: SparkSession, observations: DataFrame) -> DataFrame:
    """The codes of a batch of observations, driven through the stream to its end."""
    return through(spark, observations.select("station", F.col("day").cast("long").alias("day"), "temp", "rh", "wind", "rain", "month"), daily_codes)
