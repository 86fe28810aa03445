"""Queries on readings, bound to the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import bindings as b
from ..functions import traffic as tf
from ..operators import readings as op
from .core import query

R = "WITH " + b.READINGS
LIMIT = 1800.0  # seconds without a reading that end a run, at the tables' rate
STALE = 12 * 3600.0
ZONE = "Europe/London"

BASE = """base AS (SELECT camera_id, quantile_cont(count_mean, 0.2) AS quiet, quantile_cont(count_mean, 0.85) AS busy, count(*) AS n FROM readings GROUP BY 1 HAVING count(*) >= 60)"""
BY_COUNT = "CASE WHEN busy - quiet >= 0.5 THEN least(greatest((count_mean - quiet) / (busy - quiet), 0.0), 1.0) END"
CONG = f"""cong AS (SELECT r.*, quiet, busy, CASE WHEN tracks < 2 OR count_mean < 0.5 THEN {BY_COUNT} WHEN {BY_COUNT} IS NULL THEN least(greatest(1 - moving_frac, 0.0), 1.0)
 ELSE least(greatest(0.45 * {BY_COUNT} + 0.55 * (1 - moving_frac), 0.0), 1.0) END AS congestion FROM readings r LEFT JOIN base USING (camera_id))"""
LATEST = "latest AS (SELECT * FROM cong QUALIFY row_number() OVER (PARTITION BY camera_id ORDER BY t DESC, event_id) = 1)"
LOCAL = "make_timestamp(CAST(t * 1000000 AS BIGINT)) AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/London'"


def congested(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = b.readings(spark, sf_dir)
    return op.with_congestion(r, op.sensor_baselines(r, 60))


def now(spark: SparkSession, sf_dir: str) -> float:
    return b.readings(spark, sf_dir).agg(F.max("t")).first()[0] or 0.0


NOW = "(SELECT max(t) FROM readings)"


@query(f"{R}, {BASE} SELECT * FROM base", "quiet busy")
def sensor_baselines(spark, sf_dir):
    return op.sensor_baselines(b.readings(spark, sf_dir), 60)


@query(f"""{R}, p AS (SELECT camera_id, count(*) AS n, min(t) AS lo, max(t) AS hi FROM readings GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS readings, count(*) AS sensors, min(n) AS least, list_sort(list(n))[count(*) // 2 + 1] AS upper_median, max(n) AS most, (max(hi) - min(lo)) / 3600.0 AS span_h FROM p""", "span_h")
def coverage_overview(spark, sf_dir):
    return op.coverage_overview(b.readings(spark, sf_dir))


@query(f"{R} SELECT CAST(hour({LOCAL}) AS INTEGER) AS hour, count(*) AS n, avg(count_mean) AS mean_count FROM readings GROUP BY 1", "mean_count")
def hour_of_day_profile(spark, sf_dir):
    return op.hour_of_day_profile(b.readings(spark, sf_dir), ZONE)


@query(f"""{R}, c AS (SELECT CAST(floor(t / 3600) AS BIGINT) AS hour, count(*) AS n FROM readings GROUP BY 1),
h AS (SELECT unnest(range((SELECT min(hour) FROM c), (SELECT max(hour) FROM c) + 1)) AS hour) SELECT h.hour, coalesce(n, 0) AS n FROM h LEFT JOIN c USING (hour)""")
def dense_hour_series(spark, sf_dir):
    return op.dense_hour_series(b.readings(spark, sf_dir))


@query(f"{R} SELECT strftime({LOCAL}, '%Y-%m-%d') AS day, count(*) AS n FROM readings GROUP BY 1")
def readings_per_day(spark, sf_dir):
    return op.readings_per_day(b.readings(spark, sf_dir), ZONE)


@query(f"{R} SELECT avg(CASE WHEN isodow({LOCAL}) <= 5 THEN 1.0 ELSE 0.0 END) AS share FROM readings", "share")
def weekday_share(spark, sf_dir):
    return op.weekday_share(b.readings(spark, sf_dir), ZONE)


@query(f"{R} SELECT cls, sum(count_mean) AS total, sum(count_mean) / (SELECT sum(count_mean) FROM readings) AS share FROM readings GROUP BY 1", "total share")
def class_shares(spark, sf_dir):
    return op.class_shares(b.readings(spark, sf_dir).withColumn("classes", F.create_map("cls", "count_mean")))


@query(f"{R} SELECT count(*) AS n, avg(moving_frac) AS mean_moving, median(moving_frac) AS median_moving FROM readings WHERE tracks >= 2", "mean_moving median_moving")
def moving_stats(spark, sf_dir):
    return op.moving_stats(b.readings(spark, sf_dir))


@query(f"{R} SELECT camera_id, avg(count_mean) AS mean_count, avg(moving_frac) AS moving, count(*) AS n FROM readings GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 6", "mean_count moving")
def busiest_sensors(spark, sf_dir):
    return op.busiest_sensors(b.readings(spark, sf_dir))


@query(f"{R}, {BASE} SELECT camera_id, event_id, {BY_COUNT} AS congestion FROM readings LEFT JOIN base USING (camera_id)", "congestion")
def congestion_from_count(spark, sf_dir):
    c = tf.congestion_from_count(F.col("count_mean"), F.col("quiet"), F.col("busy"))
    return congested(spark, sf_dir).select("camera_id", "event_id", c.alias("congestion"))


@query(f"{R}, {BASE}, {CONG} SELECT camera_id, event_id, congestion FROM cong", "congestion")
def reading_to_congestion(spark, sf_dir):
    return congested(spark, sf_dir).select("camera_id", "event_id", "congestion")


_TOD = f"{R}, {BASE}, {CONG}, tod AS (SELECT CAST(hour({LOCAL}) AS INTEGER) AS bucket, avg(congestion) AS congestion FROM cong WHERE congestion IS NOT NULL GROUP BY 1)"


@query(f"{_TOD} SELECT * FROM tod UNION ALL SELECT NULL, coalesce(avg(congestion), 0.35) FROM tod", "congestion")
def tod_congestion(spark, sf_dir):
    r = b.readings(spark, sf_dir)
    return op.tod_congestion(r, op.sensor_baselines(r, 60), 60, ZONE)


_BUCKET = f"CAST((hour({LOCAL}) * 60 + minute({LOCAL})) // 30 AS INTEGER)"


@query(f"""{R}, k AS (SELECT camera_id, {_BUCKET} AS bucket, count_mean FROM readings)
SELECT camera_id, bucket, avg(count_mean) AS mean_count, CAST(grouping(camera_id, bucket) AS INTEGER) AS level FROM k GROUP BY GROUPING SETS ((camera_id, bucket), (camera_id), ())""", "mean_count")
def historical_profile(spark, sf_dir):
    return op.historical_profile(b.readings(spark, sf_dir), 30, ZONE)


@query(f"{R} SELECT camera_id, event_id, {_BUCKET} AS bucket FROM readings")
def tod_bucket(spark, sf_dir):
    return b.readings(spark, sf_dir).select("camera_id", "event_id", tf.tod_bucket(F.col("t"), 30, ZONE).alias("bucket"))


@query(f"{R}, {BASE}, {CONG}, {LATEST} SELECT camera_id, event_id, t, count_mean, tracks FROM latest", "count_mean t")
def latest_reading_asof(spark, sf_dir):
    return op.latest_reading_asof(b.readings(spark, sf_dir)).select("camera_id", "event_id", "t", "count_mean", "tracks")


@query(f"{R} SELECT camera_id, event_id, t FROM readings WHERE {NOW} - t <= {STALE}", "t")
def fresh_only(spark, sf_dir):
    return op.fresh_only(b.readings(spark, sf_dir), F.lit(now(spark, sf_dir)), STALE).select("camera_id", "event_id", "t")


@query(f"{R}, {BASE}, {CONG}, {LATEST} SELECT median({NOW} - t) AS age_s, count(*) AS n FROM latest WHERE {NOW} - t <= {STALE}", "age_s")
def data_age(spark, sf_dir):
    at = F.lit(now(spark, sf_dir))
    rows = op.fresh_only(op.latest_reading_asof(b.readings(spark, sf_dir)), at, STALE)
    return rows.agg(F.median(at - F.col("t")).alias("age_s"), F.count(F.lit(1)).alias("n"))


OBS = f"""obs AS (SELECT camera_id, e.edge, t, CAST(round(count_mean) AS INTEGER) AS vehicle_count, count_mean * 10 AS density_vpkm, greatest(3.5, e.kph * (1 - 0.8 * congestion)) AS speed_kph,
 80 * (1 - moving_frac) AS queue_m, congestion AS occupancy, least(greatest(0.35 + 0.45 * greatest(0.0, 1 - ({NOW} - t) / {STALE}) + 0.05 * least(tracks, 4), 0.15), 0.95) AS confidence, {NOW} - t AS age_s
 FROM latest JOIN watch USING (camera_id) JOIN edges e ON e.edge = watch.edge WHERE congestion IS NOT NULL AND {NOW} - t <= {STALE})"""
WITH_OBS = f"{R}, {BASE}, {CONG}, {LATEST}, {b.EDGES}, {b.SENSORS}, {b.WATCH}, {OBS}"


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    free = b.watched(spark, sf_dir).join(b.edges(spark, sf_dir).select("edge", "kph"), "edge")
    return op.reading_to_observation(op.latest_reading_asof(congested(spark, sf_dir)), free, F.lit(now(spark, sf_dir)), STALE)


@query(f"{WITH_OBS} SELECT * FROM obs", "t density_vpkm speed_kph queue_m occupancy confidence age_s")
def reading_to_observation(spark, sf_dir):
    return observations(spark, sf_dir)


@query(f"{WITH_OBS} SELECT camera_id, edge, occupancy, age_s FROM obs ORDER BY occupancy DESC, camera_id LIMIT 6", "occupancy age_s")
def hotspots(spark, sf_dir):
    return observations(spark, sf_dir).select("camera_id", "edge", "occupancy", "age_s").orderBy(F.desc("occupancy"), "camera_id").limit(6)


@query(f"""{R}, m AS (SELECT *, 0.55 * least(1.5, count_mean / greatest(coalesce(nullif(CAST(camera_id % 3 AS DOUBLE), 0), greatest(count_mean, 1.0)), 0.5)) + 0.65 * (1 - moving_frac) AS raw FROM readings)
SELECT camera_id, event_id, greatest(3.5, 40.0 * (1 - 0.8 * least(1.0, raw))) AS speed_kph, count_mean / 0.1 AS density_vpkm, 80 * (1 - moving_frac) AS queue_m, least(1.0, raw) AS occupancy,
 CASE WHEN frames >= 10 THEN 0.72 ELSE 0.4 END AS confidence FROM m""", "speed_kph density_vpkm queue_m occupancy confidence")
def measurement_to_observation(spark, sf_dir):
    rows = b.readings(spark, sf_dir).withColumns({"base": (F.col("camera_id") % 3).cast("double"), "free_kph": F.lit(40.0)})
    return op.measurement_to_observation(rows)


@query(f"""{WITH_OBS}, o AS (SELECT camera_id, 0.8 AS occupancy, 60.0 AS density FROM obs WHERE camera_id % 4 = 0)
SELECT obs.camera_id, CASE WHEN o.camera_id IS NULL THEN speed_kph ELSE greatest(3.5, e.kph * (1 - 0.82 * least(1.0, greatest(o.occupancy, o.density / 135.0)))) END AS speed_kph,
 coalesce(o.occupancy, obs.occupancy) AS occupancy, CASE WHEN o.camera_id IS NULL THEN 'live' ELSE 'cv' END AS source FROM obs JOIN edges e USING (edge) LEFT JOIN o ON o.camera_id = obs.camera_id""", "speed_kph occupancy")
def splice_override(spark, sf_dir):
    obs = observations(spark, sf_dir).join(b.edges(spark, sf_dir).select("edge", F.col("kph").alias("free_kph")), "edge")
    override = obs.where("camera_id % 4 = 0").select("camera_id", F.lit(1000.0).alias("written_at"), F.lit(0.8).alias("occupancy"), F.lit(60.0).alias("density"))
    return op.splice_override(obs, override, F.lit(1500.0))


_GAPS = f"{R}, g AS (SELECT t, lag(t) OVER (ORDER BY t, event_id) AS before FROM readings)"
_RUNS = f"""{_GAPS}, cut AS (SELECT * FROM g WHERE t - before > {LIMIT}), s AS (SELECT row_number() OVER (ORDER BY t) AS run, t AS start FROM (SELECT t FROM cut UNION ALL SELECT min(t) FROM readings)),
e AS (SELECT row_number() OVER (ORDER BY t) AS run, t AS finish FROM (SELECT before AS t FROM cut UNION ALL SELECT max(t) FROM readings)), runs AS (SELECT start, finish, finish - start AS seconds FROM s JOIN e USING (run))"""


@query(f"{_RUNS} SELECT * FROM runs", "finish start seconds")
def collection_runs(spark, sf_dir):
    return op.collection_runs(b.readings(spark, sf_dir), LIMIT)


@query(f"""{_RUNS}, best AS (SELECT * FROM runs ORDER BY seconds DESC, start LIMIT 1) SELECT camera_id, event_id FROM readings, best WHERE t BETWEEN best.start AND best.finish""")
def longest_run_crop(spark, sf_dir):
    return op.longest_run_crop(b.readings(spark, sf_dir), LIMIT).select("camera_id", "event_id")


@query(f"""{_GAPS}, l AS (SELECT t - before AS gap FROM g WHERE t - before > 900), span AS (SELECT (max(t) - min(t)) / 3600.0 AS span_h FROM readings)
SELECT span_h, span_h - coalesce((SELECT sum(gap) FROM l), 0) / 3600.0 AS covered_h, coalesce((SELECT max(gap) FROM l), 0) / 3600.0 AS largest_gap_h, (SELECT count(*) FROM l) AS gaps FROM span""", "span_h covered_h largest_gap_h")
def coverage_gaps(spark, sf_dir):
    return op.coverage_gaps(b.readings(spark, sf_dir))


SLOPES = """slopes AS (SELECT *, CASE WHEN count(*) OVER w >= 3 AND var_pop(t) OVER w * count(*) OVER w > 1e-9 THEN regr_slope(count_mean, t) OVER w ELSE 0.0 END AS slope
 FROM readings WINDOW w AS (PARTITION BY camera_id ORDER BY t, event_id ROWS BETWEEN 5 PRECEDING AND CURRENT ROW))"""


@query(f"{R}, {SLOPES} SELECT camera_id, event_id, round(slope * 1000, 5) AS slope FROM slopes")
def recent_slope(spark, sf_dir):
    return op.recent_slope(b.readings(spark, sf_dir)).select("camera_id", "event_id", (F.round(F.col("slope") * 1000, 5) + 0.0).alias("slope"))


@query(f"{R}, o AS (SELECT t, row_number() OVER (ORDER BY t, event_id) - 1 AS k FROM readings) SELECT t AS cut FROM o WHERE k = floor(0.6 * ((SELECT count(*) FROM readings) - 1))", "cut")
def quantile_cut(spark, sf_dir):
    return op.quantile_cut(b.readings(spark, sf_dir), 0.6)


@query(f"""{R}, have AS (SELECT DISTINCT camera_id FROM readings), want AS (SELECT s_suppkey * 3 AS camera_id FROM supplier)
SELECT count(*) FILTER (WHERE h.camera_id IS NOT NULL AND w.camera_id IS NOT NULL) AS pinned, count(*) FILTER (WHERE h.camera_id IS NULL) AS missing, count(*) FILTER (WHERE w.camera_id IS NULL) AS others
FROM have h FULL JOIN want w ON h.camera_id = w.camera_id""")
def pin_sensors(spark, sf_dir):
    return op.pin_sensors(b.readings(spark, sf_dir), b.table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 3).alias("camera_id")))


@query(f"{R}, want AS (SELECT s_suppkey * 3 AS camera_id FROM supplier) SELECT camera_id FROM want EXCEPT SELECT camera_id FROM readings")
def missing_ids(spark, sf_dir):
    return b.table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 3).alias("camera_id")).subtract(b.readings(spark, sf_dir).select("camera_id"))


@query(f"{R} SELECT count(*) AS good, (SELECT count(*) FROM readings WHERE try_cast(json_extract_string(CASE WHEN json_valid(props) THEN props END, '$.k') AS INTEGER) IS NULL) AS bad FROM readings WHERE try_cast(json_extract_string(CASE WHEN json_valid(props) THEN props END, '$.k') AS INTEGER) IS NOT NULL")
def read_readings(spark, sf_dir):
    k = F.from_json("props", "k int", {"mode": "PERMISSIVE"})["k"]
    return b.readings(spark, sf_dir).agg(F.count(F.when(k.isNotNull(), 1)).alias("good"), F.count(F.when(k.isNull(), 1)).alias("bad"))


@query(f"{R} SELECT event_id, substr(sha256(CAST(camera_id AS VARCHAR)), 1, 12) AS who, cls AS message FROM readings")
def pseudonymise_log(spark, sf_dir):
    who = F.substring(F.sha2(F.col("camera_id").cast("string"), 256), F.lit(1), F.lit(12))
    return b.readings(spark, sf_dir).select("event_id", who.alias("who"), F.col("cls").alias("message"))


@query("SELECT event_id, CAST(user_id AS VARCHAR) AS user_id, strftime(make_timestamp(CAST(floor(epoch_us(ts) / 1000000.0 / 300) AS BIGINT) * 300000000), '%Y-%m-%d %H:%M:%S') AS slot, lpad(CAST(hour(ts) AS VARCHAR), 2, '0') || ':' || lpad(CAST(minute(ts) AS VARCHAR), 2, '0') AS clock FROM events")
def format_clock(spark, sf_dir):
    t = b.micros("ts") / F.lit(1000000.0)
    slot = F.date_format(tf.local_clock(F.floor(t / 300) * 300.0, "UTC"), "yyyy-MM-dd HH:mm:ss")
    return b.table(spark, sf_dir, "events").select("event_id", F.col("user_id").cast("string").alias("user_id"), slot.alias("slot"), tf.format_clock(F.floor(t)).alias("clock"))


@query(f"""{R} SELECT event_id, CAST(t AS BIGINT) % 86400 AS clock, CASE WHEN CAST(t AS BIGINT) % 86400 < 43200 - 600 THEN CAST(t AS BIGINT) % 86400 + 86400.0 ELSE CAST(t AS BIGINT) % 86400 END AS departs
FROM (SELECT event_id, floor(t) AS t FROM readings)""", "departs")
def roll_departure(spark, sf_dir):
    clock = F.floor("t") % 86400
    return b.readings(spark, sf_dir).select("event_id", clock.alias("clock"), tf.roll_departure(clock.cast("double"), F.lit(43200.0)).alias("departs"))
