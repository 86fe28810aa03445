"""Operators on sensor readings: (camera_id, event_id, t, count_mean, tracks, moving_frac, ...).

``event_id`` breaks ties of time. No operator windows over the whole table in one partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import traffic as tf
from ..storage import save
from .quantiles import exact_quantiles, with_medians

HOUR = 3600.0


def sensor_baselines(readings: DataFrame, least: int = 6) -> DataFrame:
    """Quiet (p20) and busy (p85) counts of sensors with enough readings."""
    q = F.percentile("count_mean", F.array(F.lit(0.2), F.lit(0.85)))
    return readings.groupBy("camera_id").agg(q.alias("q"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("camera_id", F.col("q")[0].alias("quiet"), F.col("q")[1].alias("busy"), "n")


def coverage_overview(readings: DataFrame) -> DataFrame:
    """One row: readings, sensors, least, upper-median and most readings a sensor, span in hours."""
    per = save(readings.groupBy("camera_id").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("lo"), F.max("t").alias("hi")), "per_sensor")
    middle = exact_quantiles(per, "n", (), (0.5,), upper=True).select(F.col("quantile").cast("long").alias("upper_median"))
    sums = per.agg(F.sum("n").alias("readings"), F.count(F.lit(1)).alias("sensors"), F.min("n").alias("least"), F.max("n").alias("most"), ((F.max("hi") - F.min("lo")) / HOUR).alias("span_h"))
    return sums.join(middle, F.lit(True), "left").select("readings", "sensors", "least", "upper_median", "most", "span_h")


def hour_of_day_profile(readings: DataFrame, zone: str = "UTC") -> DataFrame:
    return readings.groupBy(F.hour(tf.local_clock(F.col("t"), zone)).alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.avg("count_mean").alias("mean_count"))


def dense_hour_series(readings: DataFrame) -> DataFrame:
    """Readings in every clock hour from the first to the last, with zeros."""
    counted = readings.groupBy(F.floor(F.col("t") / HOUR).alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    ends = counted.agg(F.min("hour").alias("lo"), F.max("hour").alias("hi")).where("lo is not null")
    return ends.select(F.explode(F.sequence("lo", "hi")).alias("hour")).join(counted, "hour", "left").select("hour", F.coalesce("n", F.lit(0)).alias("n"))


def readings_per_day(readings: DataFrame, zone: str = "UTC") -> DataFrame:
    return readings.groupBy(F.date_format(tf.local_clock(F.col("t"), zone), "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"))


def weekday_share(readings: DataFrame, zone: str = "UTC") -> DataFrame:
    return readings.agg(F.avg(F.when(F.weekday(tf.local_clock(F.col("t"), zone)) < 5, 1.0).otherwise(0.0)).alias("share"))


def class_shares(readings: DataFrame) -> DataFrame:
    """Share of each vehicle class in all that was counted; ``classes`` is a map from class to mean count."""
    summed = readings.select(F.explode("classes").alias("cls", "n")).groupBy("cls").agg(F.sum("n").alias("total"))
    return summed.crossJoin(summed.agg(F.sum("total").alias("all"))).select("cls", "total", (F.col("total") / F.col("all")).alias("share"))


def moving_stats(readings: DataFrame) -> DataFrame:
    rows = readings.where("tracks >= 2")
    return with_medians(rows.agg(F.count(F.lit(1)).alias("n"), F.avg("moving_frac").alias("mean_moving")), rows, (), {"median_moving": "moving_frac"})


def busiest_sensors(readings: DataFrame, most: int = 6) -> DataFrame:
    grouped = readings.groupBy("camera_id").agg(F.avg("count_mean").alias("mean_count"), F.avg("moving_frac").alias("moving"), F.count(F.lit(1)).alias("n"))
    return grouped.orderBy(F.desc("mean_count"), "camera_id").limit(most)


def with_congestion(readings: DataFrame, baselines: DataFrame) -> DataFrame:
    """Readings with congestion 0 to 1, null where it is unknown."""
    c = tf.reading_to_congestion(F.col("count_mean"), F.col("tracks"), F.col("moving_frac"), F.col("quiet"), F.col("busy"))
    return readings.join(baselines.select("camera_id", "quiet", "busy"), "camera_id", "left").withColumn("congestion", c)


def tod_congestion(readings: DataFrame, baselines: DataFrame, minutes: int = 60, zone: str = "UTC", default: float = 0.35) -> DataFrame:
    """Mean congestion a time-of-day bucket, and overall as the mean of these (bucket null); the default without data."""
    known = with_congestion(readings, baselines).where("congestion is not null")
    buckets = known.groupBy(tf.tod_bucket(F.col("t"), minutes, zone).alias("bucket")).agg(F.avg("congestion").alias("congestion"))
    return buckets.unionByName(buckets.agg(F.lit(None).cast("int").alias("bucket"), F.coalesce(F.avg("congestion"), F.lit(default)).alias("congestion")))


def historical_profile(readings: DataFrame, minutes: int = 30, zone: str = "UTC") -> DataFrame:
    """Mean counts by (sensor, bucket), by sensor and over all, in one pass; ``level`` 0, 1, 3."""
    keyed = readings.select("camera_id", tf.tod_bucket(F.col("t"), minutes, zone).alias("bucket"), "count_mean")
    return keyed.groupingSets([["camera_id", "bucket"], ["camera_id"], []], "camera_id", "bucket").agg(F.avg("count_mean").alias("mean_count"), F.grouping_id().cast("int").alias("level"))


def latest_reading_asof(readings: DataFrame, until: float | None = None, sensors: DataFrame | None = None) -> DataFrame:
    """Last reading of each known sensor up to a moment; of equal times the first one (least event_id)."""
    known = readings if sensors is None else readings.join(sensors.select("camera_id"), "camera_id", "left_semi")
    cut = known if until is None else known.where(F.col("t") <= until)
    columns = [c for c in readings.columns if c != "camera_id"]
    best = F.max_by(F.struct(*columns), F.struct(F.col("t"), -F.col("event_id")))
    return cut.groupBy("camera_id").agg(best.alias("r")).select("camera_id", *[F.col(f"r.{c}").alias(c) for c in columns])


def fresh_only(readings: DataFrame, now: Column, stale_s: float) -> DataFrame:
    return readings.where(now - F.col("t") <= stale_s)


def reading_to_observation(rows: DataFrame, free: DataFrame, now: Column, stale_s: float) -> DataFrame:
    """Congestion of fresh readings as observations of watched edges: speed, confidence, queue, density.

    ``rows`` with congestion; ``free``: (camera_id, edge, kph).
    """
    age = now - F.col("t")
    met = rows.join(free, "camera_id").where(F.col("congestion").isNotNull() & (age <= stale_s))
    return met.select(
        "camera_id", "edge", "t", F.round("count_mean").cast("int").alias("vehicle_count"), (F.col("count_mean") * 10).alias("density_vpkm"),
        tf.congested_kph(F.col("kph"), F.col("congestion")).alias("speed_kph"), (80 * (1 - F.col("moving_frac"))).alias("queue_m"), F.col("congestion").alias("occupancy"),
        tf.reading_confidence(age, F.col("tracks"), stale_s).alias("confidence"), age.alias("age_s"),
    )


def measurement_to_observation(rows: DataFrame) -> DataFrame:
    """Uncalibrated readings (count_mean, moving_frac, frames, free_kph, base) as observations."""
    base = F.coalesce(F.when(F.col("base") != 0, F.col("base")), F.greatest("count_mean", F.lit(1.0)))
    load = F.least(F.lit(1.5), F.col("count_mean") / F.greatest(base, F.lit(0.5)))
    stalled = 1 - F.col("moving_frac")
    occupancy = F.least(F.lit(1.0), 0.55 * load + 0.65 * stalled)
    confidence = F.when(F.col("frames") >= 10, 0.72).otherwise(0.4)
    return rows.select("camera_id", "event_id", tf.congested_kph(F.col("free_kph"), occupancy).alias("speed_kph"), (F.col("count_mean") / 0.10).alias("density_vpkm"), (80 * stalled).alias("queue_m"), occupancy.alias("occupancy"), confidence.alias("confidence"))


def splice_override(observations: DataFrame, override: DataFrame, now: Column, most_age: float = 900.0) -> DataFrame:
    """Observations with those sensors replaced that have a fresh override (camera_id, written_at, occupancy, density)."""
    o = override.where(now - F.col("written_at") <= most_age).select("camera_id", F.col("occupancy").alias("o_occ"), F.col("density").alias("o_density"))
    congestion = F.least(F.lit(1.0), F.greatest(F.col("o_occ"), F.col("o_density") / 135.0))
    met = observations.join(o, "camera_id", "left")
    use = F.col("o_occ").isNotNull()
    return met.select(
        "camera_id", F.when(use, tf.congested_kph(F.col("free_kph"), congestion, 0.82)).otherwise(F.col("speed_kph")).alias("speed_kph"),
        F.coalesce("o_occ", "occupancy").alias("occupancy"), F.when(use, "cv").otherwise("live").alias("source"),
    )


def _hour_ends(readings: DataFrame, width: float) -> DataFrame:
    """Per time bucket: first and last time, and the last time of the bucket before. One row a bucket."""
    ends = readings.groupBy(F.floor(F.col("t") / width).alias("slot")).agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    return ends.withColumn("before", F.lag("hi").over(Window.orderBy("slot")))


def breaks(readings: DataFrame, limit: float, width: float = HOUR) -> DataFrame:
    """(start, gap): where a reading follows the one before by more than ``limit`` seconds, over all sensors.

    Two levels: lags inside time buckets, and the ends of buckets against each other (one row a bucket).
    """
    slot = F.floor(F.col("t") / width)
    inside = readings.select(F.col("t"), F.lag("t").over(Window.partitionBy(slot).orderBy("t")).alias("before")).where("before is not null")
    across = _hour_ends(readings, width).where("before is not null").select(F.col("lo").alias("t"), "before")
    return inside.unionByName(across).where(F.col("t") - F.col("before") > limit).select(F.col("t").alias("start"), "before", (F.col("t") - F.col("before")).alias("gap"))


def collection_runs(readings: DataFrame, limit: float, width: float = HOUR) -> DataFrame:
    """(start, finish, seconds) of each stretch without a break. Rows are as many as breaks, not as readings."""
    ends = readings.agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    cuts = breaks(readings, limit, width)
    starts = cuts.select("start").unionByName(ends.select(F.col("lo").alias("start")))
    until = cuts.select(F.col("before").alias("finish")).unionByName(ends.select(F.col("hi").alias("finish")))
    number = lambda c: F.row_number().over(Window.orderBy(c)).alias("run")
    return starts.where("start is not null").select(number("start"), "start").join(until.where("finish is not null").select(number("finish"), "finish"), "run").select("start", "finish", (F.col("finish") - F.col("start")).alias("seconds"))


def longest_run_crop(readings: DataFrame, limit: float, full_span: bool = False) -> DataFrame:
    """Readings within the longest run (the first on a tie)."""
    if full_span:
        return readings
    longest = collection_runs(readings, limit).orderBy(F.desc("seconds"), "start").limit(1)
    return readings.join(F.broadcast(longest), F.col("t").between(F.col("start"), F.col("finish"))).drop("start", "finish", "seconds")


def coverage_gaps(readings: DataFrame, limit: float = 900.0) -> DataFrame:
    """One row: span, hours covered, largest gap, number of gaps."""
    span = readings.agg(((F.max("t") - F.min("t")) / HOUR).alias("span_h"))
    gaps = breaks(readings, limit).agg(F.coalesce(F.sum("gap"), F.lit(0.0)).alias("lost"), F.coalesce(F.max("gap"), F.lit(0.0)).alias("most"), F.count(F.lit(1)).alias("gaps"))
    return span.crossJoin(gaps).select("span_h", (F.col("span_h") - F.col("lost") / HOUR).alias("covered_h"), (F.col("most") / HOUR).alias("largest_gap_h"), "gaps")


def recent_slope(readings: DataFrame, window: int = 6) -> DataFrame:
    """Readings with the least-squares trend of the count (a second) over the last ``window``; 0 with under 3 points or no spread."""
    w = Window.partitionBy("camera_id").orderBy("t", "event_id").rowsBetween(-(window - 1), 0)
    ok = (F.count(F.lit(1)).over(w) >= 3) & (F.var_pop("t").over(w) * F.count(F.lit(1)).over(w) > 1e-9)
    return readings.withColumn("slope", F.when(ok, F.regr_slope("count_mean", "t").over(w)).otherwise(F.lit(0.0)))


def quantile_cut(readings: DataFrame, q: float, width: float = HOUR) -> DataFrame:
    """One row: the time at index int(q (n - 1)) of all readings by time. Only its bucket is sorted."""
    slots = readings.groupBy(F.floor(F.col("t") / width).alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy("slot")
    placed = slots.withColumn("ahead", F.sum("n").over(w) - F.col("n")).crossJoin(slots.agg(F.floor(q * (F.sum("n") - 1)).alias("k")))
    chosen = placed.where((F.col("ahead") <= F.col("k")) & (F.col("k") < F.col("ahead") + F.col("n")))
    met = readings.withColumn("slot", F.floor(F.col("t") / width)).join(F.broadcast(chosen), "slot")
    rank = F.row_number().over(Window.partitionBy("slot").orderBy("t", "event_id"))
    return met.withColumn("rank", rank).where(F.col("rank") - 1 == F.col("k") - F.col("ahead")).select(F.col("t").alias("cut"))


def pin_sensors(readings: DataFrame, wanted: DataFrame) -> DataFrame:
    """One row: wanted sensors that report, wanted that don't, others that report."""
    have = readings.select("camera_id").distinct()
    met = have.withColumn("a", F.lit(1)).join(wanted.select("camera_id").distinct().withColumn("b", F.lit(1)), "camera_id", "full")
    return met.agg(F.count(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1)).alias("pinned"), F.count(F.when(F.col("a").isNull(), 1)).alias("missing"), F.count(F.when(F.col("b").isNull(), 1)).alias("others"))
