"""Domain views over the driver's tables: observations, scenarios, assets, stations, zones, cells and frames.

All are projections of one table (a window numbers a station's days), so that filters and columns reach the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberline.functions import geometry as G
from emberline.functions.fuels import CODES

#: Extent of the cells of v_cell.
LAT_MAX, LAT_MIN, LNG_MIN, LNG_MAX, COLS = 53.8, 53.3, -113.8, -113.2, 40
RASTER_CODES = (0, 1, 2, 3, 12, 14, 31, 32, 98)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _mod(c: Column, n: int, by: float = 1.0) -> Column:
    return (c % n).cast("double") / by


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    day = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    k = F.col("event_id")
    return e.select(
        F.col("user_id").alias("station"), day.alias("day"), (4 + F.col("user_id") % 7).cast("int").alias("month"), (5.0 + _mod(k * 37, 3000, 100.0)).alias("temp"),
        (10.0 + _mod(k * 53, 8500, 100.0)).alias("rh"), (F.col("value") - 60.0 * F.floor(F.col("value") / 60.0)).alias("wind"),
        F.when(F.col("event_type") == "error", _mod(k * 29, 400, 10.0)).otherwise(0.0).alias("rain"), "ts", "value", F.col("event_type").alias("kind"), k.alias("event_id"),
    )


def scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    fuel = F.element_at(F.array(*[F.lit(x) for x in CODES]), (k % 18 + 1).cast("int"))
    price = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select(
        k.alias("scen"), fuel.alias("fuel"), _mod(k * 7, 600, 10.0).alias("wind"), _mod(k * 11, 360).alias("dir"), (70.0 + _mod(c * 13, 300, 10.0)).alias("ffmc"),
        (price - 150.0 * F.floor(price / 150.0)).alias("dmc"), _mod(k * 31, 8000, 10.0).alias("dc"), ((k % 9).cast("double") * 10.0).alias("slope"), _mod(k, 101).alias("pc"), (50.0 + _mod(k, 51)).alias("cure"),
    )


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("asset"), (53.3 + _mod(k * 7919, 5000, 10000.0)).alias("lat"), (-113.8 + _mod(k * 104729, 6000, 10000.0)).alias("lng"), F.col("c_mktsegment").alias("layer"), F.col("c_name").alias("name"))


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k.alias("station"), (53.3 + _mod(k * 6101, 5000, 10000.0)).alias("slat"), (-113.8 + _mod(k * 9973, 6000, 10000.0)).alias("slng"), F.col("s_acctbal").alias("reading"))


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """25 squares, with the multipliers of their region."""
    k, g = F.col("n_nationkey"), F.col("n_regionkey").cast("double")
    return table(spark, sf_dir, "nation").select(
        k.alias("zone"), F.col("n_name").alias("zone_name"), (53.3 + F.floor(k / 5).cast("double") * 0.1).alias("lat0"), (-113.8 + (k % 5).cast("double") * 0.12).alias("lng0"),
        (0.8 + 0.1 * g).alias("ros_mult"), (0.9 + 0.1 * g).alias("int_mult"), (1.0 + 0.25 * g).alias("ember_mult"),
    )


def zone_ring() -> Column:
    corners = [(0.0, 0.0), (0.0, 0.12), (0.1, 0.12), (0.1, 0.0)]
    return F.array(*[F.struct((F.col("lat0") + a).alias("lat"), (F.col("lng0") + b).alias("lng")) for a, b in corners])


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    code = F.element_at(F.array(*[F.lit(x) for x in RASTER_CODES]), (F.col("p_size") % 9 + 1).cast("int"))
    return table(spark, sf_dir, "part").select(F.floor(k / COLS).cast("int").alias("row"), (k % COLS).cast("int").alias("col"), code.alias("code"), F.col("p_retailprice").alias("elev"))


def n_rows(spark: SparkSession, sf_dir: str) -> int:
    """How many rows of cells the grid has; they reach over the whole extent, from north to south."""
    return (cells(spark, sf_dir).agg(F.max("row")).first()[0] or 0) + 1


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One frame per observation: a circle that grows by the hour, with the intensity of the day."""
    o = observations(spark, sf_dir)
    idx = (F.col("day") - 1).cast("int")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("surface", "surface_with_torching", "passive_crown", "active_crown")]), (F.floor(F.col("value")) % 4 + 1).cast("int"))
    f = o.select(F.col("station").alias("sim"), idx.alias("idx"), (idx * 0.5).alias("t"), (F.col("wind") * 0.5).alias("ros"), (F.col("value") * 20.0).alias("hfi"), kind.alias("fire_type"), (53.55 + F.col("station").cast("double") * 0.0001).alias("lat"), F.lit(-113.5).alias("lng"), (30.0 + 40.0 * idx).alias("radius"), "event_id", "kind")
    return f.withColumn("perimeter", perimeter())


def perimeter() -> Column:
    """Of a frame, from its lat, lng and radius."""
    return G.circle(F.col("lat"), F.col("lng"), F.col("radius"))


def spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ember landings of the frames: one from each observation of the kind ``error``."""
    k = F.col("event_id")
    f = frames(spark, sf_dir).where("kind = 'error'")
    return f.select("sim", "idx", "t", (53.5 + _mod(k * 17, 50, 1000.0)).alias("lat"), (-113.5 + _mod(k * 23, 40, 1000.0)).alias("lng"), F.col("lat").alias("src_lat"), F.col("lng").alias("src_lng"), (10.0 + _mod(k * 41, 900)).alias("distance"), "hfi")


def probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Burn probabilities of the cells, from their elevation."""
    return cells(spark, sf_dir).select("row", "col", (F.floor(F.col("elev") * 10) % 101 / 100.0).alias("p"))
