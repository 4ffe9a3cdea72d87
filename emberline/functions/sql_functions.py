"""The formulas as functions of SQL text. They are SQL functions, so the optimiser sees through them; none runs in Python."""

from __future__ import annotations

from pyspark.sql import SparkSession

_RAD = "0.017453292519943295D"
FUNCTIONS = {
    "isi": ("ffmc DOUBLE, wind DOUBLE", "DOUBLE", "0.208D * exp(0.05039D * wind) * 91.9D * exp(-0.1386D * (147.2D * (101D - ffmc) / (59.5D + ffmc))) * (1D + pow(147.2D * (101D - ffmc) / (59.5D + ffmc), 5.31D) / 4.93E7D)"),
    "bui": ("dmc DOUBLE, dc DOUBLE", "DOUBLE", "CASE WHEN dmc + 0.4D * dc = 0 THEN 0D WHEN dmc <= 0.4D * dc THEN greatest(0D, 0.8D * dmc * dc / nullif(dmc + 0.4D * dc, 0D)) ELSE greatest(0D, dmc - (1D - 0.8D * dc / nullif(dmc + 0.4D * dc, 0D)) * (0.92D + pow(0.0114D * dmc, 1.7D))) END"),
    "flame_length": ("hfi DOUBLE", "DOUBLE", "CASE WHEN hfi <= 0 THEN 0D ELSE 0.0775D * pow(hfi, 0.46D) END"),
    "length_to_breadth": ("wind DOUBLE", "DOUBLE", "CASE WHEN wind <= 0 THEN 1D ELSE 1D + 8.729D * pow(1D - exp(-0.030D * wind), 2.155D) END"),
    "haversine_km": ("lat1 DOUBLE, lng1 DOUBLE, lat2 DOUBLE, lng2 DOUBLE", "DOUBLE", f"12742D * asin(sqrt(least(1D, pow(sin((lat2 - lat1) * {_RAD} / 2D), 2D) + cos(lat1 * {_RAD}) * cos(lat2 * {_RAD}) * pow(sin((lng2 - lng1) * {_RAD} / 2D), 2D))))"),
    "danger": ("fwi DOUBLE", "STRING", "CASE WHEN fwi >= 30 THEN 'Very High / Extreme' WHEN fwi >= 19 THEN 'High' WHEN fwi >= 10 THEN 'Moderate' WHEN fwi IS NULL THEN 'Unknown' ELSE 'Low' END"),
}


def register(spark: SparkSession, prefix: str = "fire_") -> list[str]:
    """Makes the functions known to the session under the prefix, and returns their names."""
    for name, (parameters, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({parameters}) RETURNS {kind} RETURN {body}")
    return [prefix + name for name in FUNCTIONS]
