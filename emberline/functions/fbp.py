"""Fire behaviour prediction and crown fire as Column expressions over rows that carry their fuel's parameters."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions import fwi as W
from emberline.functions.fuels import FUELS, fuel_table

_C2, _D1 = (next(f for f in FUELS if f[0] == k) for k in ("C2", "D1"))


def bui_effect(bui: Column, q: Column, bui0: Column) -> Column:
    safe = F.when((bui > 0) & (q < 1), bui)
    return F.coalesce(F.exp(50.0 * F.ln(q) * (1.0 / safe - 1.0 / bui0)), F.lit(1.0))


def grass_curing(percent: Column) -> Column:
    d = percent - 58.8
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(d < 0, 0.176 + 0.020 * d).otherwise(0.176 + 0.020 * d * (1.0 - 0.008 * d))))


def _rate(a, b, c, isi: Column) -> Column:
    return a * F.pow(1.0 - F.exp(-b * isi), c)


def surface_ros(isi: Column, bui: Column, pc: Column, cure: Column) -> Column:
    """Rate of spread on the surface (m/min) of a row with its fuel's columns."""
    fuel = F.col("fuel")
    conifer = _rate(F.lit(_C2[2]), F.lit(_C2[3]), F.lit(_C2[4]), isi) * bui_effect(bui, F.lit(_C2[5]), F.lit(_C2[6]))
    leafy = _rate(F.lit(_D1[2]), F.lit(_D1[3]), F.lit(_D1[4]), isi) * F.when(fuel == "M2", 0.2).otherwise(1.0)
    mixed = pc / 100.0 * conifer + (1.0 - pc / 100.0) * leafy
    plain = _rate(F.col("a"), F.col("b"), F.col("c"), isi)
    plain = plain * F.when(F.col("fuel_group").isin("conifer", "slash", "mixedwood"), bui_effect(bui, F.col("q"), F.col("bui0"))).otherwise(1.0)
    plain = plain * F.when(fuel.isin("O1a", "O1b"), grass_curing(cure)).otherwise(1.0)
    return F.when(fuel.isin("M1", "M2"), mixed).otherwise(plain)


def rate_terms(bui: Column, pc: Column, cure: Column) -> Column:
    """The surface rate of a row as a function of its isi alone: two terms (weight, b, c), for ``rate_of_terms``. Where a fuel has one, the second weighs nothing."""
    fuel = F.col("fuel")
    one = lambda w, b, c: F.struct(w.cast("double").alias("weight"), b.alias("b"), c.alias("c"))
    conifer = one(pc / 100.0 * _C2[2] * bui_effect(bui, F.lit(_C2[5]), F.lit(_C2[6])), F.lit(_C2[3]), F.lit(_C2[4]))
    leafy = one((1.0 - pc / 100.0) * _D1[2] * F.when(fuel == "M2", 0.2).otherwise(1.0), F.lit(_D1[3]), F.lit(_D1[4]))
    weight = F.col("a") * F.when(F.col("fuel_group").isin("conifer", "slash", "mixedwood"), bui_effect(bui, F.col("q"), F.col("bui0"))).otherwise(1.0)
    plain = one(weight * F.when(fuel.isin("O1a", "O1b"), grass_curing(cure)).otherwise(1.0), F.col("b"), F.col("c"))
    return F.when(fuel.isin("M1", "M2"), F.array(conifer, leafy)).otherwise(F.array(plain, one(F.lit(0.0), F.col("b"), F.col("c"))))


def rate_of_terms(terms: np.ndarray, isi: np.ndarray) -> np.ndarray:
    """surface_ros() in numpy: terms is (..., 2 terms, 3 numbers), isi of the shape before."""
    return (terms[..., 0] * (1.0 - np.exp(-terms[..., 1] * isi[..., None])) ** terms[..., 2]).sum(-1)


def critical_intensity(cbh: Column, fmc: Column) -> Column:
    return F.when(cbh <= 0, 0.0).otherwise(F.pow(0.01 * cbh * (460.0 + 25.9 * fmc), 1.5))


def crown_fraction(sfi: Column, csi: Column) -> Column:
    safe = F.when((csi > 0) & (sfi >= csi), sfi)
    return F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1.0 - F.sqrt(csi / safe))), F.lit(0.0))


def fire_type(cfb: Column) -> Column:
    return F.when(cfb >= 0.9, "active_crown").when(cfb > 0.1, "passive_crown").when(cfb > 0, "surface_with_torching").otherwise("surface")


def crown_ros(ros: Column, cbd: Column) -> Column:
    return F.when(cbd >= 0.05, ros * F.least(1.0 + (cbd - 0.05) / 0.1, F.lit(3.0))).otherwise(ros)


def flame_length(hfi: Column) -> Column:
    return F.when(hfi <= 0, 0.0).otherwise(0.0775 * F.pow(F.greatest(hfi, F.lit(1e-300)), 0.46))


def slope_factor(slope: Column) -> Column:
    return F.when(slope > 0, F.least(F.exp(3.533 * F.pow(slope / 100.0, 1.2)), F.lit(2.0))).otherwise(1.0)


def with_fbp(df: DataFrame, fmc: Column | float = 100.0, slope: bool = True) -> DataFrame:
    """df (fuel, wind, ffmc, dmc, dc, pc, cure and, if used, slope) with the fire behaviour of each row.

    Adds isi, bui, ros_surface, sfi, csi, cfb, fire_type, ros_final, tfc, hfi, flame. One stage of columns follows the other, so that
    expressions stay small. A fuel code that isn't known gets the parameters of C2.
    """
    fuels = F.broadcast(fuel_table(df.sparkSession))
    codes = [f[0] for f in FUELS]
    x = df.withColumn("fuel", F.when(F.col("fuel").isin(*codes), F.col("fuel")).otherwise("C2")).join(fuels, "fuel")
    x = x.withColumns({"isi": W.isi(F.col("ffmc"), F.col("wind")), "bui": W.bui(F.col("dmc"), F.col("dc"))})
    steep = slope_factor(F.col("slope")) if slope else F.lit(1.0)
    x = x.withColumn("ros_surface", surface_ros(F.col("isi"), F.col("bui"), F.col("pc"), F.col("cure")) * steep)
    x = x.withColumns({"sfi": 18000.0 * F.col("sfc") * F.col("ros_surface") / 60.0, "csi": critical_intensity(F.col("cbh"), fmc if isinstance(fmc, Column) else F.lit(float(fmc)))})
    x = x.withColumn("cfb", crown_fraction(F.col("sfi"), F.col("csi")))
    crowned = F.when(F.col("cfb") > 0, crown_ros(F.col("ros_surface"), F.col("cbd"))).otherwise(F.col("ros_surface"))
    x = x.withColumns({"fire_type": fire_type(F.col("cfb")), "ros_final": F.col("ros_surface") + F.col("cfb") * (crowned - F.col("ros_surface")), "tfc": F.col("sfc") + F.col("cfl") * F.col("cfb")})
    x = x.withColumn("hfi", 18000.0 * F.col("tfc") * F.col("ros_final") / 60.0)
    return x.withColumn("flame", flame_length(F.col("hfi"))).drop("fuel_group", "a", "b", "c", "q", "bui0", "cbh", "cfl", "sfc", "cbd")
