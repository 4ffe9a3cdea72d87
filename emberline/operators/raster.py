"""Grids of cells as tall tables: code schemes, terrain, barriers, mosaics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberline.functions import rng as R
from emberline.functions.fuels import code_table

# The palette of the synthetic mosaic, as fuel and cumulated weight; what is left is not fuel.
PALETTE = (("C2", 0.35), ("C3", 0.50), ("D1", 0.60), ("M1", 0.68), ("O1a", 0.75), ("S1", 0.80))


def scheme(cells: DataFrame) -> DataFrame:
    """One row: the code scheme that the raster's codes give away."""
    has = {k: F.coalesce(F.max((F.col("code") == k).cast("int")), F.lit(0)) == 1 for k in (42, 22, 14)}
    name = F.when(has[42] & ~has[22], "fbp").when(has[22] & ~has[42], "uplvi").when(has[14] & ~has[22] & ~has[42], "canopy").otherwise("broad")
    return cells.agg(name.alias("scheme"))


def with_fuel(cells: DataFrame) -> DataFrame:
    """cells with fuel by the scheme of all of them; null where a code is no fuel."""
    names = code_table(cells.sparkSession).join(F.broadcast(scheme(cells)), "scheme").drop("scheme")
    return cells.join(F.broadcast(names), "code", "left")


def filled(cells: DataFrame, missing: Column) -> DataFrame:
    """cells with elevations that are missing set to the mean of the others."""
    known = F.when(~missing, F.col("elev"))
    mean = cells.agg(F.avg(known).alias("__mean"))
    return cells.crossJoin(F.broadcast(mean)).withColumn("elev", F.coalesce(known, F.col("__mean"))).drop("__mean")


def terrain(cells: DataFrame, cell_m: float) -> DataFrame:
    """cells (row, col, elev) with slope (percent) and aspect (bearing uphill), by central differences, one-sided at the edges."""

    def gradient(line: str, along: str) -> Column:
        w = Window.partitionBy(line).orderBy(along)
        before, after, e = F.lag("elev").over(w), F.lead("elev").over(w), F.col("elev")
        return F.when(before.isNull() & after.isNull(), 0.0).when(before.isNull(), (after - e) / cell_m).when(after.isNull(), (e - before) / cell_m).otherwise((after - before) / (2.0 * cell_m))

    x = cells.withColumn("south", gradient("col", "row")).withColumn("east", gradient("row", "col"))
    slope = F.sqrt(F.col("south") * F.col("south") + F.col("east") * F.col("east")) * 100.0
    bearing = F.pmod(F.degrees(F.atan2(F.col("east"), -F.col("south"))), F.lit(360.0))
    return x.withColumn("slope", slope).withColumn("aspect", F.when(F.col("slope") < 0.1, 0.0).otherwise(bearing)).drop("south", "east")


def touched(rects: DataFrame, extent: tuple[float, float, float, float], rows: int, cols: int) -> DataFrame:
    """(row, col) of the cells that a rectangle (lat_lo, lat_hi, lng_lo, lng_hi) touches with some of its area."""
    lat0, lat1, lng0, lng1 = extent
    inside = rects.where((F.col("lat_hi") > lat0) & (F.col("lat_lo") < lat1) & (F.col("lng_hi") > lng0) & (F.col("lng_lo") < lng1))

    def between(low: Column, high: Column, n: int) -> Column:
        return F.sequence(F.greatest(F.lit(0), F.floor(low)), F.least(F.lit(n - 1), F.ceil(high) - 1))

    dy, dx = (lat1 - lat0) / rows, (lng1 - lng0) / cols
    r = between(F.round((lat1 - F.col("lat_hi")) / dy, 9), F.round((lat1 - F.col("lat_lo")) / dy, 9), rows)
    c = between(F.round((F.col("lng_lo") - lng0) / dx, 9), F.round((F.col("lng_hi") - lng0) / dx, 9), cols)
    return inside.withColumn("row", F.explode(r)).withColumn("col", F.explode(c)).select(F.col("row").cast("int"), F.col("col").cast("int")).distinct()


def mosaic(spark: SparkSession, rows: int, cols: int, seed: int, ignition: tuple[int, int] | None = None) -> DataFrame:
    """A synthetic grid: blocks of ten by ten cells of one fuel, a tenth of the cells drawn on their own; the ignition cell has fuel."""
    k = F.col("id")
    cell = spark.range(rows * cols).select(F.floor(k / cols).cast("int").alias("row"), (k % cols).cast("int").alias("col"))
    block = F.floor(F.col("row") / 10) * 100000 + F.floor(F.col("col") / 10)
    own = F.col("row").cast("long") * 100000 + F.col("col")
    draws = cell.select("*", R.uniform(F.lit(seed), F.lit(2), own).alias("alone"), R.uniform(F.lit(seed), F.lit(3), own).alias("own"), R.uniform(F.lit(seed), F.lit(1), block).alias("block"))
    drawn = draws.select("row", "col", F.when(F.col("alone") < 0.1, F.col("own")).otherwise(F.col("block")).alias("u"))
    fuel = F.lit(None).cast("string")
    for name, upto in reversed(PALETTE):
        fuel = F.when(F.col("u") < upto, name).otherwise(fuel)
    if ignition is not None:
        here = (F.col("row") == ignition[0]) & (F.col("col") == ignition[1])
        fuel = F.coalesce(fuel, F.when(here, "C2"))
    return drawn.select("row", "col", fuel.alias("fuel"))


def coarser(cells: DataFrame, k: int) -> DataFrame:
    """Every k-th cell of every k-th row, renumbered: the nearest-neighbour thinning of a raster."""
    return cells.where((F.col("row") % k == 0) & (F.col("col") % k == 0)).withColumns({"row": F.floor(F.col("row") / k).cast("int"), "col": F.floor(F.col("col") / k).cast("int")})


def factor_for(resolution_m: float, target_m: float, rows: int, cols: int, most: int = 100_000_000) -> int:
    """By how much a raster is thinned to come to the target resolution; a raster that stays larger than ``most`` cells is refused."""
    k = max(1, round(target_m / resolution_m)) if resolution_m < target_m else 1
    if math.ceil(rows / k) * math.ceil(cols / k) > most:
        raise ValueError(f"{rows} x {cols} cells at {resolution_m} m are too many; take a coarser target")
    return k


def resampled(cells: DataFrame, rows: int, cols: int, resolution_m: float, target_m: float, most: int = 100_000_000) -> tuple[DataFrame, float]:
    """(row, col, elev) of a grid at about the target resolution, by the two by two cells about each new one, and its cell size; a grid that is coarse enough stays.

    The corners of both grids are the same. Each old cell adds its elevation to the new ones less than a cell away, weighted by the rest of that distance, so one aggregation
    does without a join. Elevations are all known (``filled`` sees to that). A grid that stays larger than ``most`` cells is refused.
    """
    scale = min(1.0, resolution_m / target_m)
    n_rows, n_cols = max(1, round(rows * scale)), max(1, round(cols * scale))
    if n_rows * n_cols > most:
        raise ValueError(f"{n_rows} x {n_cols} cells are too many; take a coarser target")
    if scale == 1.0:
        return cells.select("row", "col", "elev"), resolution_m

    def new(at: str, n_old: int, n_new: int) -> Column:
        """Numbers of the new lines that a cell counts for, and its weight in them."""
        step = (n_old - 1) / (n_new - 1) if n_new > 1 else float(n_old)
        first, last = F.greatest(F.ceil((F.col(at) - 1) / step), F.lit(0)).cast("int"), F.least(F.floor((F.col(at) + 1) / step), F.lit(n_new - 1)).cast("int")
        every = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
        return F.filter(F.transform(every, lambda k: F.struct(k.alias("k"), (1.0 - F.abs(k * step - F.col(at))).alias("w"))), lambda x: x["w"] > 1e-9)

    x = cells.select("elev", "col", F.explode(new("row", rows, n_rows)).alias("r")).select("elev", "r", F.explode(new("col", cols, n_cols)).alias("c"))
    w = F.col("r.w") * F.col("c.w")
    summed = x.groupBy(F.col("r.k").alias("row"), F.col("c.k").alias("col")).agg((F.sum(w * F.col("elev")) / F.sum(w)).alias("elev"))
    return summed, resolution_m / scale
