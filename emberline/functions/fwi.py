"""The fire weather index system as Column expressions, and its daily chain as an ordered fold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Moisture codes at spring start-up.
START = (85.0, 6.0, 15.0)
# Day-length factors by month, for the duff moisture and the drought code.
DMC_LENGTH = (6.5, 7.5, 9.0, 12.8, 13.9, 13.9, 12.4, 10.9, 9.4, 8.0, 7.0, 6.0)
DC_LENGTH = (-1.6, -1.6, -1.6, 0.9, 3.8, 5.8, 6.4, 5.0, 2.4, 0.4, -1.6, -1.6)


def _d(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def _by_month(month: Column, values: tuple) -> Column:
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), month)


def ffmc(temp: Column, rh: Column, wind: Column, rain: Column, before: Column) -> Column:
    """Fine fuel moisture code of the day after ``before``."""
    mo = 147.2 * (101.0 - before) / (59.5 + before)
    rf = F.greatest(rain - 0.5, F.lit(1e-9))
    wetter = mo + 42.5 * rf * F.exp(-100.0 / (251.0 - mo)) * (1.0 - F.exp(-6.93 / rf))
    wetter = wetter + F.when(mo > 150.0, 0.0015 * (mo - 150.0) * (mo - 150.0) * F.sqrt(rf)).otherwise(0.0)
    mo = F.when(rain > 0.5, F.least(wetter, F.lit(250.0))).otherwise(mo)
    heat = 0.18 * (21.1 - temp) * (1.0 - 1.0 / F.exp(0.115 * rh))
    ed = 0.942 * F.pow(rh, 0.679) + 11.0 * F.exp((rh - 100.0) / 10.0) + heat
    ew = 0.618 * F.pow(rh, 0.753) + 10.0 * F.exp((rh - 100.0) / 10.0) + heat
    share, wet = rh / 100.0, (100.0 - rh) / 100.0

    def rate(s: Column) -> Column:
        return (0.424 * (1.0 - F.pow(s, 1.7)) + 0.0694 * F.sqrt(wind) * (1.0 - F.pow(s, 8.0))) * 0.581 * F.exp(0.0365 * temp)

    m = F.when(mo > ed, ed + (mo - ed) * F.pow(F.lit(10.0), -rate(share))).when(mo < ew, ew - (ew - mo) * F.pow(F.lit(10.0), -rate(wet))).otherwise(mo)
    return F.greatest(F.lit(0.0), F.least(F.lit(101.0), 59.5 * (250.0 - m) / (147.2 + m)))


def dmc(temp: Column, rh: Column, rain: Column, month: Column, before: Column) -> Column:
    """Duff moisture code of the day after ``before``."""
    re = 0.92 * rain - 1.27
    mo = 20.0 + F.exp(5.6348 - before / 43.43)
    safe = F.greatest(before, F.lit(1e-9))
    b = F.when(before <= 33.0, 100.0 / (0.5 + 0.3 * before)).when(before <= 65.0, 14.0 - 1.3 * F.ln(safe)).otherwise(6.2 * F.ln(safe) - 17.2)
    mr = mo + 1000.0 * re / (48.77 + b * re)
    held = F.when(rain > 1.5, F.greatest(F.lit(0.0), 244.72 - 43.43 * F.ln(mr - 20.0))).otherwise(before)
    k = F.when(temp > -1.1, 1.894 * (temp + 1.1) * (100.0 - rh) * _by_month(month, DMC_LENGTH) * 1e-4).otherwise(0.0)
    return F.greatest(F.lit(0.0), held + k)


def dc(temp: Column, rain: Column, month: Column, before: Column) -> Column:
    """Drought code of the day after ``before``."""
    qr = 800.0 * F.exp(-before / 400.0) + 3.937 * (0.83 * rain - 1.27)
    held = F.when(rain > 2.8, F.greatest(F.lit(0.0), 400.0 * F.ln(800.0 / qr))).otherwise(before)
    v = F.when(temp > -2.8, F.greatest(F.lit(0.0), 0.36 * (temp + 2.8) + _by_month(month, DC_LENGTH))).otherwise(0.0)
    return F.greatest(F.lit(0.0), held + 0.5 * v)


def isi(ffmc_: Column, wind: Column) -> Column:
    """Initial spread index."""
    m = 147.2 * (101.0 - ffmc_) / (59.5 + ffmc_)
    return 0.208 * F.exp(0.05039 * wind) * 91.9 * F.exp(-0.1386 * m) * (1.0 + F.pow(m, 5.31) / 4.93e7)


def bui(dmc_: Column, dc_: Column) -> Column:
    """Build-up index; 0 where both codes are 0."""
    whole = F.nullif(dmc_ + 0.4 * dc_, F.lit(0.0))
    low = 0.8 * dmc_ * dc_ / whole
    high = dmc_ - (1.0 - 0.8 * dc_ / whole) * (0.92 + F.pow(0.0114 * dmc_, 1.7))
    return F.coalesce(F.greatest(F.lit(0.0), F.when(dmc_ <= 0.4 * dc_, low).otherwise(high)), F.lit(0.0))


def fwi(isi_: Column, bui_: Column) -> Column:
    """Fire weather index."""
    f = F.when(bui_ <= 80.0, 0.626 * F.pow(bui_, 0.809) + 2.0).otherwise(1000.0 / (25.0 + 108.64 * F.exp(-0.023 * bui_)))
    b = 0.1 * isi_ * f
    return F.when(b <= 1.0, b).otherwise(F.exp(2.72 * F.pow(0.434 * F.ln(F.greatest(b, F.lit(1.0))), 0.647)))


def danger(fwi_: Column) -> Column:
    """Danger class of the unrounded index."""
    return F.when(fwi_.isNull(), "Unknown").when(fwi_ >= 30, "Very High / Extreme").when(fwi_ >= 19, "High").when(fwi_ >= 10, "Moderate").otherwise("Low")


def danger_screen(fwi_: Column) -> Column:
    """The finer scale of the planning screen."""
    return F.when(fwi_ < 5, "Low").when(fwi_ < 10, "Moderate").when(fwi_ < 20, "High").when(fwi_ < 30, "Very High").otherwise("Extreme")


def next_codes(obs, before) -> Column:
    """The struct (ffmc, dmc, dc) after one observation struct (temp, rh, wind, rain, month)."""
    return F.struct(
        ffmc(obs["temp"], obs["rh"], obs["wind"], obs["rain"], before["ffmc"]).alias("ffmc"),
        dmc(obs["temp"], obs["rh"], obs["rain"], obs["month"], before["dmc"]).alias("dmc"),
        dc(obs["temp"], obs["rain"], obs["month"], before["dc"]).alias("dc"),
    )


def daily_chain(obs: DataFrame, station: str = "station", day: str = "day", start: tuple = START) -> DataFrame:
    """obs, one row per station and day, with ffmc, dmc, dc, isi, bui and fwi carried from day to day.

    One row per station holds its season (at most a year) while the fold runs; stations are independent.
    """
    season = obs.groupBy(station).agg(F.array_sort(F.collect_list(F.struct(day, "temp", "rh", "wind", "rain", "month"))).alias("days"))
    init = F.struct(*[F.lit(v).alias(n) for n, v in zip(("ffmc", "dmc", "dc"), start)])
    codes = "struct<ffmc: double, dmc: double, dc: double>"
    folded = F.aggregate(
        "days",
        F.struct(init.alias("last"), F.expr(f"cast(array() as array<{codes}>)").alias("all")),
        lambda a, o: F.struct(next_codes(o, a["last"]).alias("last"), F.concat(a["all"], F.array(next_codes(o, a["last"]))).alias("all")),
    )["all"]
    rows = season.select(station, F.explode(F.arrays_zip("days", folded.alias("codes"))).alias("x")).select(station, "x.days.*", "x.codes.*")
    rows = rows.withColumns({"isi": isi(F.col("ffmc"), F.col("wind")), "bui": bui(F.col("dmc"), F.col("dc"))})
    return rows.withColumn("fwi", fwi(F.col("isi"), F.col("bui")))
