"""The fuel types of the fire behaviour prediction system, and raster code schemes, as small DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Code, group, a, b, c, q, bui0, crown base height, crown fuel load, surface fuel consumption, crown bulk density.
FUELS = (
    ("C1", "conifer", 90.0, 0.0649, 4.5, 0.9, 72.0, 2.0, 0.75, 0.75, 0.11),
    ("C2", "conifer", 110.0, 0.0282, 1.5, 0.7, 64.0, 3.0, 0.8, 0.8, 0.18),
    ("C3", "conifer", 110.0, 0.0444, 3.0, 0.75, 62.0, 8.0, 1.15, 1.15, 0.09),
    ("C4", "conifer", 110.0, 0.0293, 1.5, 0.75, 66.0, 4.0, 1.2, 1.2, 0.13),
    ("C5", "conifer", 30.0, 0.0697, 4.0, 0.8, 56.0, 18.0, 1.2, 1.2, 0.14),
    ("C6", "conifer", 30.0, 0.08, 3.0, 0.8, 62.0, 7.0, 1.8, 1.8, 0.17),
    ("C7", "conifer", 45.0, 0.0305, 2.0, 0.85, 106.0, 10.0, 0.5, 0.5, 0.07),
    ("D1", "deciduous", 30.0, 0.0232, 1.6, 0.9, 32.0, 0.0, 0.0, 0.35, 0.0),
    ("D2", "deciduous", 6.0, 0.0232, 1.6, 0.9, 32.0, 0.0, 0.0, 0.35, 0.0),
    ("M1", "mixedwood", 0.0, 0.0, 0.0, 0.8, 50.0, 6.0, 0.8, 0.6, 0.1),
    ("M2", "mixedwood", 0.0, 0.0, 0.0, 0.8, 50.0, 6.0, 0.8, 0.6, 0.1),
    ("M3", "mixedwood", 120.0, 0.0572, 1.4, 0.8, 50.0, 6.0, 0.8, 0.8, 0.1),
    ("M4", "mixedwood", 100.0, 0.0404, 3.0, 0.8, 50.0, 6.0, 0.8, 0.8, 0.1),
    ("O1a", "grass", 190.0, 0.031, 1.4, 1.0, 1.0, 0.0, 0.0, 0.35, 0.0),
    ("O1b", "grass", 250.0, 0.035, 1.7, 1.0, 1.0, 0.0, 0.0, 0.35, 0.0),
    ("S1", "slash", 75.0, 0.0297, 1.3, 0.75, 38.0, 0.0, 0.0, 4.5, 0.0),
    ("S2", "slash", 40.0, 0.0438, 1.7, 0.75, 63.0, 0.0, 0.0, 4.5, 0.0),
    ("S3", "slash", 55.0, 0.0829, 3.2, 0.75, 31.0, 0.0, 0.0, 4.5, 0.0),
)
CODES = tuple(f[0] for f in FUELS)
COLUMNS = ("fuel", "fuel_group", "a", "b", "c", "q", "bui0", "cbh", "cfl", "sfc", "cbd")
SCHEMA = "fuel string, fuel_group string, a double, b double, c double, q double, bui0 double, cbh double, cfl double, sfc double, cbd double"

# Raster codes of each scheme that name a fuel; any other code is not fuel.
SCHEMES = {
    "fbp": {1: "C1", 12: "D2", 32: "S2", 41: "O1a", 42: "O1b"},
    "uplvi": {2: "C2", 12: "D2", 22: "M2", 31: "O1a", 32: "O1b"},
    "canopy": {2: "C2", 3: "C3", 12: "D2", 14: "M2", 31: "O1a", 32: "O1b"},
    "broad": {1: "C1", 2: "C2", 3: "C3", 4: "C4", 5: "C5", 6: "C6", 7: "C7", 11: "D1", 12: "D2", 14: "M2", 22: "M2", 31: "O1a", 32: "O1b", 41: "O1a", 42: "O1b"},
}


def fuel_table(spark: SparkSession) -> DataFrame:
    """18 rows; small enough to be sent to every task whatever it is joined to."""
    return spark.createDataFrame(list(FUELS), SCHEMA)


def code_table(spark: SparkSession) -> DataFrame:
    """(scheme, code, fuel)."""
    return spark.createDataFrame([(s, k, v) for s, m in SCHEMES.items() for k, v in m.items()], "scheme string, code int, fuel string")
