"""Operators on scored trips: (trip, method, actual_s, claimed_s, promised_p90_s, distance_m, disrupted)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import with_medians


def router_scores(trips: DataFrame, by: tuple[str, ...] = ("method",)) -> DataFrame:
    """Per method: trips, minutes, error of the claimed time, bias, share on time, km."""
    rows = trips.withColumns({"e": (F.col("claimed_s") - F.col("actual_s")) / 60, "actual_min": F.col("actual_s") / 60}).withColumn("off", F.abs("e"))
    means = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg("actual_min").alias("mean_min"), F.avg("off").alias("mae_min"), F.avg("e").alias("bias_min"),
        (100 * F.avg((F.col("actual_s") <= F.col("promised_p90_s")).cast("double"))).alias("on_time"), (F.avg("distance_m") / 1000).alias("mean_km"),
    )
    whole = with_medians(means, rows, by, {"median_min": "actual_min", "median_ae_min": "off"})
    return whole.select(*by, "n", "mean_min", "median_min", "mae_min", "median_ae_min", "bias_min", "on_time", "mean_km")


def paired_compare(trips: DataFrame, ours: str, theirs: str) -> DataFrame:
    """(trip, saving_s, our_error, their_error): the same trip by two methods, in one pass over the trips."""
    pick = lambda m, c: F.max(F.when(F.col("method") == m, F.col(c)))
    both = trips.where(F.col("method").isin(ours, theirs)).groupBy("trip").agg(*[pick(m, c).alias(f"{k}_{c}") for k, m in (("a", ours), ("b", theirs)) for c in ("actual_s", "claimed_s")])
    both = both.where("a_actual_s is not null and b_actual_s is not null")
    return both.select("trip", (F.col("b_actual_s") - F.col("a_actual_s")).alias("saving_s"), F.abs(F.col("a_claimed_s") - F.col("a_actual_s")).alias("our_error"), F.abs(F.col("b_claimed_s") - F.col("b_actual_s")).alias("their_error"), F.col("b_actual_s").alias("their_s"))


def win_tie_loss(pairs: DataFrame, tie_s: float = 20.0) -> DataFrame:
    share = lambda c: 100 * F.avg(c.cast("double"))
    s = F.col("saving_s")
    means = pairs.agg(
        F.count(F.lit(1)).alias("n"), (F.avg(s) / 60).alias("saving_min"), (100 * F.sum(s) / F.sum("their_s")).alias("saving_pct"),
        share(s > tie_s).alias("win"), share(F.abs(s) <= tie_s).alias("tie"), share(s < -tie_s).alias("loss"), (100 * (1 - F.avg("our_error") / F.avg("their_error"))).alias("error_reduction"),
    )
    return with_medians(means, pairs.withColumn("saving", s / 60), (), {"median_saving_min": "saving"})


def subgroup_scores(trips: DataFrame, least: int = 5) -> DataFrame:
    return router_scores(trips, ("disrupted", "method")).where(F.col("n") >= least)


def compare_destinations(costed: DataFrame, close_s: float = 120.0) -> DataFrame:
    """(origin, dest, median_s, place, too_close): destinations of an origin by travel time; near ties are flagged."""
    w = Window.partitionBy("origin").orderBy("median_s", "dest")
    return costed.select("origin", "dest", "median_s", F.row_number().over(w).alias("place"), F.coalesce(F.lead("median_s").over(w) - F.col("median_s") < close_s, F.lit(False)).alias("too_close"))


def go_now_or_wait(costed: DataFrame) -> DataFrame:
    """(trip, arrive_first, drive_least, now_s, now_p90_s, saving_min, later_min, verdict) of trips costed at several departures (trip, wait, median_s, p90_s), wait in minutes.

    ``arrive_first`` and ``drive_least`` are the waits of earliest arrival and shortest drive, the shorter wait on a tie. The verdict goes by arrival: "wait" where a later
    departure arrives earlier, "now" where waiting doesn't save two minutes of driving, else "now, though the drive would be shorter".
    """
    arrival = F.round(F.col("median_s") + F.col("wait") * 60, 6)
    drive = F.round("median_s", 6)
    best = costed.groupBy("trip").agg(
        F.min(F.struct(arrival.alias("v"), "wait")).alias("a"), F.min(F.struct(drive.alias("v"), "wait")).alias("d"), F.min_by(F.struct("median_s", "p90_s"), "wait").alias("now")
    )
    minutes = lambda s: F.bround(s / 60).cast("int")
    saving, later = minutes(F.col("now.median_s") - F.col("d.v")), minutes(F.col("d.v") + F.col("d.wait") * 60 - F.col("now.median_s"))
    verdict = F.when(F.col("a.wait") > 0, "wait").when(saving >= 2, "now, though the drive would be shorter").otherwise("now")
    return best.select("trip", F.col("a.wait").alias("arrive_first"), F.col("d.wait").alias("drive_least"), F.col("now.median_s").alias("now_s"), F.col("now.p90_s").alias("now_p90_s"), saving.alias("saving_min"), later.alias("later_min"), verdict.alias("verdict"))


def incident_envelope(t, start, duration, onset: float = 0.12, power: float = 1.4):
    """Share of an incident's severity at a moment of its life: a fast rise over its first part, then a slow clearance."""
    u = (t - start) / duration
    return F.least(F.lit(1.0), u / onset) * (1 - F.pow(F.greatest(F.lit(0.0), (u - onset) / (1 - onset)), F.lit(power)))


def active_incident_overlay(incidents: DataFrame, moments: DataFrame) -> DataFrame:
    """(t, edge, factor): speed factors of the incidents active at each moment, multiplied where they meet.

    Moments meet incidents by hour buckets that an incident spans, not by a range over all.
    """
    spans = incidents.withColumn("slot", F.explode(F.sequence(F.floor(F.col("start_s") / 3600), F.floor((F.col("start_s") + F.col("duration_s")) / 3600))))
    met = moments.withColumn("slot", F.floor(F.col("t") / 3600)).join(spans, "slot").where((F.col("t") >= F.col("start_s")) & (F.col("t") <= F.col("start_s") + F.col("duration_s")))
    level = F.col("severity") * incident_envelope(F.col("t"), F.col("start_s"), F.col("duration_s"))
    each = met.withColumn("level", level).select("t", "level", F.explode(F.arrays_zip("edges", "weights")).alias("z"))
    return each.groupBy("t", F.col("z.edges").alias("edge")).agg(F.product(1 - F.col("level") * F.col("z.weights")).alias("factor"))


def top_incidents(incidents: DataFrame, t: float, most: int = 6) -> DataFrame:
    now = F.lit(t)
    live = incidents.where((now >= F.col("start_s")) & (now <= F.col("start_s") + F.col("duration_s")))
    return live.select("incident", (F.col("severity") * incident_envelope(now, F.col("start_s"), F.col("duration_s"))).alias("intensity")).orderBy(F.desc("intensity"), "incident").limit(most)


def sanity_ratios(trips: DataFrame) -> DataFrame:
    """One row a measure (distance, time, speed) of trips (metres, seconds, ref_metres, ref_seconds): median, least, greatest, and whether the median is plausible.

    Ratios are to the reference, speed is in km/h; all are rounded to 3 places, so that the median counts few values.
    """
    ratio = lambda a, b: F.when(F.col(b) != 0, F.col(a) / F.col(b)).otherwise(0.0)
    each = F.array(*[F.struct(F.lit(n).alias("measure"), F.round(v, 3).alias("v")) for n, v in (("distance", ratio("metres", "ref_metres")), ("time", ratio("seconds", "ref_seconds")), ("speed", 3.6 * ratio("metres", "seconds")))])
    rows = trips.select(F.explode(each).alias("r")).select("r.*").groupBy("measure").agg(F.percentile("v", F.lit(0.5)).alias("median"), F.min("v").alias("least"), F.max("v").alias("greatest"))
    m = F.col("median")
    # fixed values: the bands of each measure
    return rows.withColumn("passed", F.when(F.col("measure") == "distance", m <= 1.25).when(F.col("measure") == "time", m.between(1.1, 2.6)).otherwise(m.between(8.0, 30.0)))
