"""Saved scenarios as JSON: reading with a fixed schema, and the rows that can't be used."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WEATHER = "temperature double, relative_humidity double, wind_speed double, wind_direction double, precipitation_24h double"
SCHEMA = f"id string, createdAt string, name string, ignition struct<lat: double, lng: double>, weather struct<{WEATHER.replace(' double', ': double')}>, duration_hours double, fuel_type string, ffmc double, dmc double, dc double, _bad string"
#: Codes of a scenario that names none.
DEFAULT_CODES = {"ffmc": 85.0, "dmc": 40.0, "dc": 200.0}


def read_scenarios(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(usable, rejected) scenarios of JSON files, one object or an array a file. Usable ones have a name and weather, and codes by default; rejected ones a reason."""
    rows = spark.read.schema(SCHEMA).option("multiLine", True).option("columnNameOfCorruptRecord", "_bad").json(path)
    reason = F.when(F.col("_bad").isNotNull(), "could not be parsed").when(F.coalesce("name", F.lit("")) == "", "no name").when(F.col("weather").isNull(), "no weather")
    rows = rows.withColumn("reason", reason)
    usable = rows.where("reason is null").drop("reason", "_bad").withColumns({k: F.coalesce(k, F.lit(v)) for k, v in DEFAULT_CODES.items()})
    return usable, rows.where("reason is not null").select("id", "name", "reason")


def write_newest(scenarios: DataFrame, path: str, most: int = 10) -> None:
    """Keeps the newest scenarios: a store of bounded length, as its readers expect."""
    scenarios.orderBy(F.desc("createdAt"), "id").limit(most).write.mode("overwrite").json(path)
