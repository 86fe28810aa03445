"""Forecast pairs, forecasters and their back-test on readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import traffic as tf
from ..storage import save
from . import readings as op
from .quantiles import with_medians

# The grid of decay times and trend weights.
TAUS = (120.0, 240.0, 360.0, 600.0, 900.0, 1200.0, 1800.0, 2700.0, 3600.0, 7200.0, 1e9)
DAMPS = (0.0, 0.25, 0.5, 0.75, 1.0)


def nearest_after_join(rows: DataFrame, horizon: float, tolerance: float) -> DataFrame:
    """For each reading the same sensor's reading nearest to ``t + horizon`` within the tolerance; the earlier wins a tie.

    An equi-join on (sensor, time bucket): buckets are four tolerances wide, so a match lies in one bucket for half of the rows, else in one of two.
    """
    slot = lambda t: F.floor(t / (4 * tolerance))
    # a second of slack, as sums round; what is too far goes below
    ends = [slot(F.col("t") + horizon + sign * (tolerance + 1)) for sign in (-1, 1)]
    asked = rows.withColumn("slot", F.explode(F.sequence(*ends)))
    given = rows.select("camera_id", F.col("t").alias("t1"), F.col("count_mean").alias("c1"), F.col("event_id").alias("event1"), slot(F.col("t")).alias("slot"))
    away = F.abs(F.col("t1") - (F.col("t") + horizon))
    met = asked.join(given, ["camera_id", "slot"]).where(away <= tolerance)
    best = F.min_by(F.struct("t1", "c1"), F.struct(away, F.col("t1"), F.col("event1")))
    kept = [c for c in rows.columns if c not in ("camera_id", "event_id")]
    return met.groupBy("camera_id", "event_id").agg(*[F.first(c).alias(c) for c in kept], best.alias("best")).select("camera_id", "event_id", *kept, "best.t1", "best.c1")


def forecast_pairs(readings: DataFrame, horizon: float, tolerance: float) -> DataFrame:
    """(camera_id, event_id, t0, c0, slope, t1, c1)."""
    rows = op.recent_slope(readings.select("camera_id", "event_id", "t", "count_mean"))
    met = nearest_after_join(rows, horizon, tolerance)
    return met.select("camera_id", "event_id", F.col("t").alias("t0"), F.col("count_mean").alias("c0"), "slope", "t1", "c1")


def profile_fallback_join(rows: DataFrame, time: str, profile: DataFrame, out: str, minutes: int = 30, zone: str = "UTC") -> DataFrame:
    """``rows`` with the profile's mean for the sensor and time of day, else for the sensor, else over all."""
    fine = profile.where("level = 0").select("camera_id", "bucket", F.col("mean_count").alias("_fine"))
    coarse = profile.where("level = 1").select("camera_id", F.col("mean_count").alias("_coarse"))
    whole = profile.where("level = 3").select(F.col("mean_count").alias("_whole"))
    keyed = rows.withColumn("bucket", tf.tod_bucket(F.col(time), minutes, zone))
    met = keyed.join(fine, ["camera_id", "bucket"], "left").join(coarse, "camera_id", "left").join(F.broadcast(whole), how="left")
    return met.withColumn(out, F.coalesce("_fine", "_coarse", "_whole", F.lit(0.0))).drop("bucket", "_fine", "_coarse", "_whole")


def expected_pairs(pairs: DataFrame, profile: DataFrame, minutes: int = 30, zone: str = "UTC") -> DataFrame:
    """Pairs with the profile's ``h_now`` and ``h_then``, as ``profile_fallback_join`` finds them; a sensor's buckets are one row, so pairs shuffle once for both times."""
    buckets = F.map_from_entries(F.collect_list(F.struct("bucket", "mean_count")))
    fine = profile.where("level = 0 and bucket is not null").groupBy("camera_id").agg(buckets.alias("_fine"))
    packed = profile.where("level = 1").select("camera_id", F.col("mean_count").alias("_coarse")).join(fine, "camera_id", "left")
    whole = profile.where("level = 3").select(F.col("mean_count").alias("_whole"))
    met = pairs.join(packed, "camera_id", "left").join(F.broadcast(whole), how="left")
    told = lambda t: F.coalesce(F.try_element_at("_fine", tf.tod_bucket(F.col(t), minutes, zone)), "_coarse", "_whole", F.lit(0.0))
    return met.withColumns({"h_now": told("t0"), "h_then": told("t1")}).drop("_fine", "_coarse", "_whole")


def forecast_blend(horizon: float, tau: Column, damp: Column) -> Column:
    """History at the target, plus what the reading differs from history now, decayed, plus the damped trend."""
    return F.greatest(F.lit(0.0), F.col("h_then") + (F.col("c0") - F.col("h_now")) * F.exp(-horizon / tau) + damp * F.col("slope") * horizon)


def fit_blend(pairs: DataFrame, horizon: float) -> DataFrame:
    """One row: decay time and trend weight of least mean error; the first on the grid wins a tie."""
    grid = pairs.sparkSession.createDataFrame([(i * len(DAMPS) + j, t, d) for i, t in enumerate(TAUS) for j, d in enumerate(DAMPS)], "place int, tau double, damp double")
    tried = pairs.crossJoin(F.broadcast(grid))
    error = F.avg(F.abs(forecast_blend(horizon, F.col("tau"), F.col("damp")) - F.col("c1")))
    scored = tried.groupBy("place", "tau", "damp").agg(error.alias("mae"))
    return scored.orderBy(F.round("mae", 9), "place").limit(1).select("tau", "damp", "mae")


def forecast_scores(pairs: DataFrame) -> DataFrame:
    """Scores by forecaster of rows (forecaster, predicted, c1)."""
    rows = save(pairs.select("forecaster", (F.col("predicted") - F.col("c1")).alias("e"), "c1").withColumn("off", F.abs("e")), "errors")
    means = rows.groupBy("forecaster").agg(F.count(F.lit(1)).alias("n"), F.avg("off").alias("mae"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), (100 * F.avg(F.col("off") / F.greatest("c1", F.lit(1.0)))).alias("mape"))
    return with_medians(means, rows, ("forecaster",), {"median_ae": "off"})


def predictions(pairs: DataFrame, horizon: float, tau: Column, damp: Column) -> DataFrame:
    """Each pair three times, once a forecaster."""
    three = F.array(*[F.struct(F.lit(n).alias("forecaster"), c.alias("predicted")) for n, c in (("blend", forecast_blend(horizon, tau, damp)), ("persistence", F.col("c0")), ("historical", F.col("h_then")))])
    return pairs.withColumn("p", F.explode(three)).select("*", "p.forecaster", "p.predicted").drop("p")


def validate_forecast(readings: DataFrame, horizon: float, tolerance: float, split: float = 0.6, minutes: int = 30, zone: str = "UTC", least: tuple[int, int, int] = (60, 20, 10)) -> DataFrame:
    """Scores on the last slice, of a blend fitted on the middle one, with a profile learned on the first.

    No rows where there are fewer than ``least`` readings, test pairs and tuning pairs.
    """
    cut1, cut2 = op.quantile_cut(readings, split * 0.75), op.quantile_cut(readings, split)
    cuts = F.broadcast(cut1.select(F.col("cut").alias("cut1")).crossJoin(cut2.select(F.col("cut").alias("cut2"))))
    profile = op.historical_profile(readings.crossJoin(cuts).where("t <= cut1"), minutes, zone)
    pairs = expected_pairs(forecast_pairs(readings, horizon, tolerance), profile, minutes, zone).crossJoin(cuts)
    tune, test = pairs.where("t0 > cut1 and t1 <= cut2"), pairs.where("t0 > cut2")
    best = fit_blend(tune, horizon).select("tau", "damp")
    enough = readings.agg(F.count(F.lit(1)).alias("n0")).crossJoin(test.agg(F.count(F.lit(1)).alias("n1"))).crossJoin(tune.agg(F.count(F.lit(1)).alias("n2"))).where((F.col("n0") >= least[0]) & (F.col("n1") >= least[1]) & (F.col("n2") >= least[2]))
    scored = forecast_scores(predictions(test.crossJoin(F.broadcast(best)), horizon, F.col("tau"), F.col("damp")))
    return scored.crossJoin(F.broadcast(best)).crossJoin(F.broadcast(enough.select("n2").withColumnRenamed("n2", "tuning_pairs")))


def horizon_sweep(readings: DataFrame, horizons: tuple[float, ...], tolerance: float, profile: DataFrame) -> DataFrame:
    """Persistence and history over several horizons."""
    out = None
    for h in horizons:
        pairs = expected_pairs(forecast_pairs(readings, h, tolerance), profile)
        part = forecast_scores(predictions(pairs, h, F.lit(1e9), F.lit(0.0)).where("forecaster <> 'blend'")).withColumn("horizon", F.lit(h))
        out = part if out is None else out.unionByName(part)
    return out
