"""Operators on detected vehicles: (clip, frame, track, cls, x, y, frame_w, frame_h); order by (frame, l_orderkey, l_linenumber, l_partkey)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import traffic as tf

ORDER = ("frame", "l_orderkey", "l_linenumber", "l_partkey")


def moving_fraction(points: DataFrame) -> DataFrame:
    """(clip, tracks, moving): share of tracks with three points or more that shifted by more than max(2, 1.2 % of the width)."""
    at = F.struct(*ORDER)
    ends = points.groupBy("clip", "track").agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct("x", "y"), at).alias("a"), F.max_by(F.struct("x", "y"), at).alias("b"), F.max("frame_w").alias("w"))
    shift = F.sqrt(F.pow(F.col("b.x") - F.col("a.x"), 2) + F.pow(F.col("b.y") - F.col("a.y"), 2))
    moved = F.when(F.col("n") >= 3, (shift > F.greatest(F.lit(2.0), 0.012 * F.col("w"))).cast("double"))
    return ends.groupBy("clip").agg(F.count(F.lit(1)).alias("tracks"), F.round(F.coalesce(F.avg(moved), F.lit(0.0)), 3).alias("moving"))


def clip_measurement(points: DataFrame) -> DataFrame:
    """(clip, frames, count_mean, count_max, classes, tracks, moving): counts of frames, then of clips; classes are means a frame, and what moves of the tracks."""
    frames = points.groupBy("clip", "frame", "cls").agg(F.count(F.lit(1)).alias("n"))
    whole = frames.groupBy("clip", "frame").agg(F.sum("n").alias("n")).groupBy("clip").agg(F.count(F.lit(1)).alias("frames"), F.avg("n").alias("count_mean"), F.max("n").alias("count_max"))
    classes = frames.groupBy("clip", "cls").agg(F.sum("n").alias("n")).join(whole.select("clip", "frames"), "clip")
    mapped = classes.groupBy("clip").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("cls", (F.col("n") / F.col("frames")).alias("mean"))))).alias("classes"))
    return whole.join(mapped, "clip").join(moving_fraction(points), "clip")


# Points of a track looked back on, its least seconds, and speeds (km/h) from which a jump is no drive and under which a vehicle stands
TRACK_POINTS, LEAST_S, JUMP_KPH, STANDING_KPH = 12, 1e-3, 180.0, 3.0
CAR_M = 4.2  # length of a vehicle of unknown class


def track_speed(points: DataFrame, fps: float = 25.0, window: int = TRACK_POINTS) -> DataFrame:
    """Points with the speed in km/h over the track's last ``window``: ground covered from point to point, over the seconds since the first; null until three points.

    Ground distance is that on the road seen by the camera, along it and across.
    """
    w = Window.partitionBy("clip", "track").orderBy(*ORDER)
    before = lambda c: F.lag(c).over(w)
    step = tf.ground_distance(before("y"), before("x"), F.col("y"), F.col("x"), F.col("frame_h"), F.col("frame_w"))
    seconds = (F.col("frame") - F.first("frame").over(w.rowsBetween(-(window - 1), 0))) / F.lit(fps)
    ground = F.sum("step").over(w.rowsBetween(-(window - 2), 0))
    speed = ground / F.greatest(seconds, F.lit(LEAST_S)) * 3.6
    return points.withColumn("step", step).withColumn("speed", F.when(F.row_number().over(w) >= 3, speed)).drop("step")


def frame_stats(points: DataFrame, lengths: DataFrame, view_m: float = 100.0, lanes: int = 2) -> DataFrame:
    """(clip, frame, total, median_speed, stopped, occupancy, counts) of points with speeds; ``lengths``: (cls, length).

    Speeds of JUMP_KPH or more come from mistaken tracks and don't count; without any speed the median is 0. ``counts`` has the vehicles of each class.
    """
    met = points.join(F.broadcast(lengths), "cls", "left").withColumn("real", F.when(F.col("speed") < JUMP_KPH, F.col("speed")))
    stats = met.groupBy("clip", "frame").agg(
        F.count(F.lit(1)).alias("total"), F.coalesce(F.median("real"), F.lit(0.0)).alias("median_speed"), F.count_if(F.col("real") < STANDING_KPH).alias("stopped"),
        F.least(F.lit(1.0), F.sum(F.coalesce("length", F.lit(CAR_M))) / F.greatest(F.lit(view_m * lanes), F.lit(1.0))).alias("occupancy"),
    )
    counts = class_counts(points).groupBy("clip", "frame").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("cls", "n")))).alias("counts"))
    return stats.join(counts, ["clip", "frame"])


def class_counts(points: DataFrame) -> DataFrame:
    """(clip, frame, cls, n)."""
    return points.groupBy("clip", "frame", "cls").agg(F.count(F.lit(1)).alias("n"))


def window_observation(frames: DataFrame, classes: DataFrame, most: int = 40, view_m: float = 100.0, lanes: int = 2, jam_vpkm: float = 135.0) -> DataFrame:
    """(clip, frames, mean_count, speed, queue_m, occupancy, density, confidence, classes) over the last ``most`` frames of each clip.

    ``classes``: (clip, frame, cls, n). The mix holds each class's rounded mean a frame, where that isn't 0. Trust falls with density and with few vehicles.
    """
    last = F.row_number().over(Window.partitionBy("clip").orderBy(F.desc("frame")))
    kept = frames.withColumn("back", last).where(F.col("back") <= most)
    seen = kept.groupBy("clip").agg(
        F.count(F.lit(1)).alias("frames"), F.avg("total").alias("mean_count"), F.coalesce(F.median(F.when(F.col("median_speed") > 0, F.col("median_speed"))), F.lit(5.0)).alias("speed"),
        F.least(F.lit(view_m), 6.0 * F.avg("stopped")).alias("queue_m"), F.avg("occupancy").alias("occupancy"),
    )
    density = F.col("mean_count") / (view_m / 1000.0) / lanes
    trust = (1 - 0.35 * F.least(F.greatest(density / jam_vpkm, F.lit(0.0)), F.lit(1.0))) * F.least(F.lit(1.0), 0.45 + 0.1 * F.greatest("mean_count", F.lit(1.0)))
    mean = F.bround(F.col("n") / F.col("frames")).cast("bigint")
    summed = classes.join(kept.select("clip", "frame"), ["clip", "frame"]).groupBy("clip", "cls").agg(F.sum("n").alias("n")).join(seen.select("clip", "frames"), "clip")
    mix = summed.select("clip", "cls", mean.alias("mean")).where("mean > 0").groupBy("clip").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("cls", "mean")))).alias("classes"))
    out = seen.withColumns({"density": density, "confidence": F.least(F.greatest(trust, F.lit(0.12)), F.lit(0.97))})
    return out.join(mix, "clip", "left").withColumn("classes", F.coalesce("classes", F.create_map().cast("map<string,bigint>")))
