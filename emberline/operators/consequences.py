"""What a fire means: arrival contours, evacuation tiers, statistics of frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberline.functions import advice as A
from emberline.functions import geometry as G
from emberline.operators import spatial

# Evacuation tiers with rank, hours and action; colours of arrival hours.
TIERS = (("Order", 3, 2.0, "LEAVE NOW"), ("Alert", 2, 6.0, "BE READY (~30 min)"), ("Watch", 1, 12.0, "MONITOR SITUATION"))
ISO_HOURS = (1.0, 2.0, 4.0, 8.0)


def closest_frames(frames: DataFrame, targets: DataFrame, slack: float, by: str = "sim", shape: Column | None = None) -> DataFrame:
    """targets (target, ...) with, per fire, the frame nearest in time to each (the earlier on a tie), if the fire lasts to target - slack.

    Frames with fewer than 3 points don't count. Targets are few; each frame is compared with all in one pass without a self-join. shape: the perimeter, of 3 points or more, as an
    expression over other columns of the frames, which then has to be made for the frames found alone, and doesn't move with all others.
    """
    last = Window.partitionBy(by)
    f = frames if shape is None else frames.drop("perimeter")
    f = f.withColumn("__last", F.max("t").over(last))
    f = f.where(F.size("perimeter") >= 3) if shape is None else f
    met = f.crossJoin(F.broadcast(targets)).where(F.col("target") <= F.col("__last") + slack)
    others = [c for c in targets.columns if c != "target"]
    kept = ["idx", "t", "perimeter"] if shape is None else ["idx", "t", *[c for c in frames.columns if c not in (by, "idx", "t", "perimeter")]]
    best = met.groupBy(by, "target", *others).agg(F.min_by(F.struct(*kept), F.struct(F.abs(F.col("t") - F.col("target")), "idx")).alias("f")).select(by, "target", *others, "f.*")
    # by a generator, so that what uses the perimeter reads it as a column and doesn't compute it again
    return best if shape is None else best.select(by, "target", *others, "idx", "t", F.explode(F.array(shape)).alias("perimeter"))


def isochrones(spark: SparkSession, frames: DataFrame, hours=ISO_HOURS, shape: Column | None = None) -> DataFrame:
    """(sim, target, label, idx, t, perimeter): contours of the hours; hours that come to one frame keep the first."""
    targets = spark.createDataFrame([(float(h),) for h in hours], "target double")
    x = closest_frames(frames, targets, 0.5, shape=shape)
    first = Window.partitionBy("sim", "idx").orderBy("target")
    return x.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n").withColumn("label", A.hours_label(F.col("target")))


def northernmost(ring: Column) -> Column:
    """The first of the northernmost points of a ring."""
    return F.element_at(F.array_sort(F.transform(ring, lambda p, i: F.struct((-p["lat"]).alias("k"), i.alias("i"), p.alias("p")))), 1)["p"]


def evacuation(spark: SparkSession, frames: DataFrame, communities: DataFrame, scale: float = 1.0, shape: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Tiers of each fire (sim, tier, rank, area_ha), and communities (community, lat, lng and what else they have) in them, each in its most urgent tier."""
    targets = spark.createDataFrame([(h, t, k) for t, k, h, _ in TIERS], "target double, tier string, rank int")
    x = closest_frames(frames, targets, 1.0, shape=shape)
    x = x.select("*", F.explode(F.array(G.vertex_mean(F.col("perimeter")))).alias("__c"))  # once, not for each point
    x = x.select("sim", "tier", "rank", F.explode(F.array(G.scaled(F.col("perimeter"), F.lit(float(scale)), F.col("__c")))).alias("ring"))
    inside = spatial.points_in_areas(communities, x.select("sim", "tier", "rank", "ring"))
    others = [F.any_value(c).alias(c) for c in communities.columns if c not in ("community", "lat", "lng")]
    found = inside.groupBy("sim", "community").agg(F.max_by("tier", "rank").alias("tier"), F.max("rank").alias("rank"), *others)
    return x.select("sim", "tier", "rank", G.area_ha(F.col("ring")).alias("area_ha")), found


def with_history(current: DataFrame, history: DataFrame) -> DataFrame:
    """(sim, community, tier, rank, source): an Order or Alert once given isn't lowered; a Watch may lapse."""
    h = history.where("rank >= 2").select("sim", "community", F.col("tier").alias("h_tier"), F.col("rank").alias("h_rank"))
    x = current.join(h, ["sim", "community"], "full_outer")
    up = F.coalesce("h_rank", F.lit(0)) > F.coalesce("rank", F.lit(0))
    return x.select("sim", "community", F.when(up, F.col("h_tier")).otherwise(F.col("tier")).alias("tier"), F.greatest(F.coalesce("h_rank", F.lit(0)), F.coalesce("rank", F.lit(0))).alias("rank"), F.when(up, "history").otherwise("current").alias("source"))


def spread_stats(frames: DataFrame, spots: DataFrame) -> DataFrame:
    """One row per fire: peaks, spots, and the last frame's area, type and flame."""
    f = frames.groupBy("sim").agg(F.max("ros").alias("peak_ros"), F.max("hfi").alias("peak_hfi"), F.max_by(F.struct("radius", "fire_type", "hfi", "perimeter"), "idx").alias("last"), F.max("t").alias("hours"))
    s = spots.groupBy("sim").agg(F.count("*").alias("spot_count"), F.max("distance").alias("max_spot_m"))
    x = f.join(s, "sim", "left")
    return x.select("sim", "peak_ros", "peak_hfi", "hours", F.coalesce("spot_count", F.lit(0)).alias("spot_count"), F.coalesce("max_spot_m", F.lit(0.0)).alias("max_spot_m"), G.area_ha(F.col("last.perimeter")).alias("final_ha"), F.col("last.fire_type").alias("final_type"), F.col("last.hfi").alias("last_hfi"))
