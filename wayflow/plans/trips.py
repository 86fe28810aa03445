"""Queries on trips, incidents and detections."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import bindings as b
from ..functions import traffic as tf
from ..operators import detections as de
from ..operators import routes as rt
from ..operators import trips as tr
from .core import query

T, D, I = "WITH " + b.TRIPS, "WITH " + b.DETECTIONS, "WITH " + b.INCIDENTS
_E = "(claimed_s - actual_s) / 60"
_SCORES = f"""count(*) AS n, avg(actual_s) / 60 AS mean_min, median(actual_s) / 60 AS median_min, avg(abs({_E})) AS mae_min, median(abs({_E})) AS median_ae_min, avg({_E}) AS bias_min,
 100 * avg(CASE WHEN actual_s <= promised_p90_s THEN 1.0 ELSE 0.0 END) AS on_time, avg(distance_m) / 1000 AS mean_km"""
_DOUBLES = "mean_min median_min mae_min median_ae_min bias_min on_time mean_km"
PAIR = """pair AS (SELECT a.trip, b.actual_s - a.actual_s AS saving_s, abs(a.claimed_s - a.actual_s) AS our_error, abs(b.claimed_s - b.actual_s) AS their_error, b.actual_s AS their_s
 FROM trips a JOIN trips b USING (trip) WHERE a.method = 'blend' AND b.method = 'snapshot')"""


@query(f"{T} SELECT method, {_SCORES} FROM trips GROUP BY 1", _DOUBLES)
def router_scores(spark, sf_dir):
    return tr.router_scores(b.trips(spark, sf_dir))


@query(f"{T} SELECT disrupted, method, {_SCORES} FROM trips GROUP BY 1, 2 HAVING count(*) >= 5", _DOUBLES)
def subgroup_scores(spark, sf_dir):
    return tr.subgroup_scores(b.trips(spark, sf_dir))


@query(f"{T}, {PAIR} SELECT * FROM pair", "saving_s our_error their_error their_s")
def paired_compare(spark, sf_dir):
    return tr.paired_compare(b.trips(spark, sf_dir), "blend", "snapshot")


@query(f"""{T}, {PAIR} SELECT count(*) AS n, avg(saving_s) / 60 AS saving_min, median(saving_s) / 60 AS median_saving_min, 100 * sum(saving_s) / sum(their_s) AS saving_pct, 100 * avg(CASE WHEN saving_s > 20 THEN 1.0 ELSE 0.0 END) AS win,
 100 * avg(CASE WHEN abs(saving_s) <= 20 THEN 1.0 ELSE 0.0 END) AS tie, 100 * avg(CASE WHEN saving_s < -20 THEN 1.0 ELSE 0.0 END) AS loss, 100 * (1 - avg(our_error) / avg(their_error)) AS error_reduction FROM pair""", "saving_min median_saving_min saving_pct win tie loss error_reduction")
def win_tie_loss(spark, sf_dir):
    return tr.win_tie_loss(tr.paired_compare(b.trips(spark, sf_dir), "blend", "snapshot"))


_CV = "(1 + pow((promised_p90_s - actual_s) / 1.2816 / actual_s, 2))"


@query(f"""{T} SELECT o_orderkey, round(actual_s / sqrt{_CV}, 4) AS median_s, round(actual_s / sqrt{_CV} * exp(1.2815515655446004 * sqrt(ln{_CV})), 4) AS p90_s,
 round(exp(-1.2815515655446004 * sqrt(ln{_CV})), 6) AS reliability FROM trips""")
def eta_percentiles(spark, sf_dir):
    from statistics import NormalDist

    z = NormalDist().inv_cdf(0.9)
    sd = F.abs(F.col("promised_p90_s") - F.col("actual_s")) / 1.2816
    median, p90 = (tf.eta_percentile(F.col("actual_s"), sd, q) for q in (0.0, z))
    return b.trips(spark, sf_dir).select("o_orderkey", F.round(median, 4).alias("median_s"), F.round(p90, 4).alias("p90_s"), F.round(median / p90, 6).alias("reliability"))


@query(f"""{T}, c AS (SELECT origin, dest + o_orderkey AS dest, actual_s AS median_s FROM trips WHERE method = 'blend')
SELECT *, row_number() OVER w AS place, coalesce(lead(median_s) OVER w - median_s < 120, false) AS too_close FROM c WINDOW w AS (PARTITION BY origin ORDER BY median_s, dest)""", "median_s")
def compare_destinations(spark, sf_dir):
    costed = b.trips(spark, sf_dir).where("method = 'blend'").select("origin", (F.col("dest") + F.col("o_orderkey")).alias("dest"), F.col("actual_s").alias("median_s"))
    return tr.compare_destinations(costed)


# of costed departures (trip, wait, median_s, p90_s)
VERDICTS = """a AS (SELECT trip, wait, median_s FROM costed QUALIFY row_number() OVER (PARTITION BY trip ORDER BY round(median_s + wait * 60, 6), wait) = 1),
d AS (SELECT trip, wait, round(median_s, 6) AS v FROM costed QUALIFY row_number() OVER (PARTITION BY trip ORDER BY round(median_s, 6), wait) = 1),
v AS (SELECT trip, a.wait AS arrive_first, d.wait AS drive_least, n.median_s AS now_s, n.p90_s AS now_p90_s, CAST(round_even((n.median_s - d.v) / 60, 0) AS INTEGER) AS saving_min,
 CAST(round_even((d.v + d.wait * 60 - n.median_s) / 60, 0) AS INTEGER) AS later_min FROM a JOIN d USING (trip) JOIN (SELECT * FROM costed WHERE wait = 0) n USING (trip))
SELECT *, CASE WHEN arrive_first > 0 THEN 'wait' WHEN saving_min >= 2 THEN 'now, though the drive would be shorter' ELSE 'now' END AS verdict FROM v"""


@query(f"""{T}, costed AS (SELECT o_orderkey AS trip, wait, actual_s + ((o_orderkey % 200) - 150.0) * wait AS median_s, (actual_s + ((o_orderkey % 200) - 150.0) * wait) * 1.25 AS p90_s FROM trips, (SELECT unnest([0, 15, 30, 45, 60]) AS wait)), {VERDICTS}""", "now_s now_p90_s")
def departure_verdicts(spark, sf_dir):
    """Orders whose drive gets longer or shorter by a constant rate."""
    wait = F.explode(F.array(*map(F.lit, rt.WAITS_MIN)))
    rows = b.trips(spark, sf_dir).select(F.col("o_orderkey").alias("trip"), "actual_s", ((F.col("o_orderkey") % 200) - 150.0).alias("slope"), wait.alias("wait"))
    drive = F.col("actual_s") + F.col("slope") * F.col("wait")
    return tr.go_now_or_wait(rows.select("trip", "wait", drive.alias("median_s"), (drive * 1.25).alias("p90_s")))


@query(f"{T} SELECT o_orderkey AS trip, wait, actual_s + wait * 60 AS arrives FROM trips, (SELECT unnest([0, 15, 30, 45, 60]) AS wait)", "arrives")
def trip_offset_cross(spark, sf_dir):
    waits = F.explode(F.array(*map(F.lit, (0, 15, 30, 45, 60))))
    return b.trips(spark, sf_dir).select(F.col("o_orderkey").alias("trip"), "actual_s", waits.alias("wait")).select("trip", "wait", (F.col("actual_s") + F.col("wait") * 60).alias("arrives"))


_U = "((t - start_s) / duration_s)"
_ENV = f"(least(1.0, {_U} / 0.12) * (1 - pow(greatest(0.0, ({_U} - 0.12) / 0.88), 1.4)))"
# every ten minutes from the first start to the last end; no incident is shorter
_MOMENTS = "span AS (SELECT min(start_s) AS a, max(start_s + duration_s) AS z FROM incidents), moments AS (SELECT a + k * 600.0 AS t FROM (SELECT a, unnest(range(CAST(floor((z - a) / 600.0) AS BIGINT) + 1)) AS k FROM span))"


@query(f"""{I}, {_MOMENTS}, hit AS (SELECT t, severity * {_ENV} AS level, unnest(edges) AS edge, unnest(weights) AS weight FROM moments JOIN incidents ON t BETWEEN start_s AND start_s + duration_s)
SELECT t, edge, product(1 - level * weight) AS factor FROM hit GROUP BY 1, 2""", "t factor")
def active_incident_overlay(spark, sf_dir):
    incidents = b.incidents(spark, sf_dir)
    span = incidents.agg(F.min("start_s").alias("a"), F.max(F.col("start_s") + F.col("duration_s")).alias("z")).where("a is not null")
    moments = span.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("z") - F.col("a")) / 600.0))).alias("k")).select((F.col("a") + F.col("k") * 600.0).alias("t"))
    return tr.active_incident_overlay(incidents, moments)


@query(f"{I}, now AS (SELECT max(start_s) AS t FROM incidents) SELECT incident, severity * {_ENV} AS intensity FROM incidents, now WHERE t BETWEEN start_s AND start_s + duration_s ORDER BY 2 DESC, 1 LIMIT 6", "intensity")
def top_incidents(spark, sf_dir):
    incidents = b.incidents(spark, sf_dir)
    return tr.top_incidents(incidents, incidents.agg(F.max("start_s")).first()[0] or 0.0)


_ORD = "frame, l_orderkey, l_linenumber, l_partkey"


MOVED = f"""e AS (SELECT clip, track, count(*) AS n, first(x ORDER BY {_ORD}) AS ax, first(y ORDER BY {_ORD}) AS ay, last(x ORDER BY {_ORD}) AS bx, last(y ORDER BY {_ORD}) AS b_y, max(frame_w) AS w FROM detections GROUP BY 1, 2),
moved AS (SELECT clip, count(*) AS tracks, round(coalesce(avg(CASE WHEN n >= 3 THEN CASE WHEN sqrt(pow(bx - ax, 2) + pow(b_y - ay, 2)) > greatest(2.0, 0.012 * w) THEN 1.0 ELSE 0.0 END END), 0), 3) AS moving FROM e GROUP BY 1)"""


@query(f"{D}, {MOVED} SELECT * FROM moved", "moving")
def moving_fraction(spark, sf_dir):
    return de.moving_fraction(b.detections(spark, sf_dir))


@query(f"""{D}, {MOVED}, f AS (SELECT clip, frame, count(*) AS n FROM detections GROUP BY 1, 2), w AS (SELECT clip, count(*) AS frames, avg(n) AS count_mean, max(n) AS count_max FROM f GROUP BY 1)
SELECT w.*, (SELECT round(count(*) / w.frames + 1e-9, 6) FROM detections d WHERE d.clip = w.clip AND cls = 'NO') AS no_mean,
 (SELECT round(count(*) / w.frames + 1e-9, 6) FROM detections d WHERE d.clip = w.clip AND cls = 'RF') AS rf_mean, tracks, moving FROM w JOIN moved USING (clip)""", "count_mean no_mean rf_mean moving")
def clip_measurement(spark, sf_dir):
    found = de.clip_measurement(b.detections(spark, sf_dir))
    mean = lambda cls: F.coalesce(F.try_element_at("classes", F.lit(cls)), F.lit(0.0))
    return found.withColumns({"no_mean": mean("NO"), "rf_mean": mean("RF")}).drop("classes")


_ROW = "(0.82 * frame_h / greatest({} - 0.18 * frame_h, 0.04 * frame_h))"
SPEEDS = f"""prev AS (SELECT *, lag(x) OVER w AS xa, lag(y) OVER w AS ya FROM detections WINDOW w AS (PARTITION BY clip, track ORDER BY {_ORD})),
st AS (SELECT *, sqrt(pow(50.0 * ({_ROW.format('y')} - {_ROW.format('ya')}), 2) + pow((x - xa) * 35.0 / frame_w * {_ROW.format('((y + ya) / 2)')}, 2)) AS step FROM prev),
sp AS (SELECT *, row_number() OVER w AS k, sum(step) OVER (PARTITION BY clip, track ORDER BY {_ORD} ROWS BETWEEN 10 PRECEDING AND CURRENT ROW) AS ground,
 (frame - first(frame) OVER (PARTITION BY clip, track ORDER BY {_ORD} ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)) / 25.0 AS elapsed FROM st WINDOW w AS (PARTITION BY clip, track ORDER BY {_ORD})),
speeds AS (SELECT *, CASE WHEN k >= 3 THEN ground / greatest(elapsed, 0.001) * 3.6 END AS speed FROM sp)"""


@query(f"{D}, {SPEEDS} SELECT clip, track, l_orderkey, l_linenumber, l_partkey, speed FROM speeds", "speed")
def track_speed(spark, sf_dir):
    return de.track_speed(b.detections(spark, sf_dir)).select("clip", "track", "l_orderkey", "l_linenumber", "l_partkey", "speed")


_LENGTHS = (("AF", 4.2), ("NF", 8.0), ("NO", 6.0), ("RF", 12.0))
FRAMES = f"""len(cls, length) AS (VALUES {', '.join(map(str, _LENGTHS))}), fs AS (SELECT clip, frame, count(*) AS total, coalesce(median(CASE WHEN speed < 180 THEN speed END), 0.0) AS median_speed,
 count(*) FILTER (WHERE speed < 3) AS stopped, least(1.0, sum(coalesce(length, 4.2)) / 200.0) AS occupancy, count(*) FILTER (WHERE cls = 'NO') AS no FROM speeds LEFT JOIN len USING (cls) GROUP BY 1, 2)"""


def frames(spark, sf_dir):
    lengths = spark.createDataFrame(_LENGTHS, "cls string, length double")
    return de.frame_stats(de.track_speed(b.detections(spark, sf_dir)), lengths)


@query(f"{D}, {SPEEDS}, {FRAMES} SELECT * FROM fs", "median_speed occupancy")
def frame_stats(spark, sf_dir):
    return frames(spark, sf_dir).withColumn("no", F.coalesce(F.try_element_at("counts", F.lit("NO")), F.lit(0))).drop("counts")


@query(f"""{D}, {SPEEDS}, {FRAMES}, k AS (SELECT * FROM fs QUALIFY row_number() OVER (PARTITION BY clip ORDER BY frame DESC) <= 40),
o AS (SELECT clip, count(*) AS frames, avg(total) AS mean_count, coalesce(median(CASE WHEN median_speed > 0 THEN median_speed END), 5.0) AS speed, least(100.0, 6.0 * avg(stopped)) AS queue_m, avg(occupancy) AS occupancy FROM k GROUP BY 1),
mix AS (SELECT d.clip, count(*) AS af FROM detections d JOIN k USING (clip, frame) WHERE cls = 'AF' GROUP BY 1)
SELECT o.*, mean_count / 0.1 / 2 AS density, least(greatest((1 - 0.35 * least(greatest(mean_count / 0.1 / 2 / 135.0, 0.0), 1.0)) * least(1.0, 0.45 + 0.1 * greatest(mean_count, 1.0)), 0.12), 0.97) AS confidence,
 CAST(CASE WHEN round_even(coalesce(af, 0) / frames, 0) > 0 THEN round_even(coalesce(af, 0) / frames, 0) END AS BIGINT) AS af FROM o LEFT JOIN mix USING (clip)""", "mean_count speed queue_m occupancy density confidence")
def window_observation(spark, sf_dir):
    points = b.detections(spark, sf_dir)
    found = de.window_observation(frames(spark, sf_dir), de.class_counts(points))
    return found.withColumn("af", F.try_element_at("classes", F.lit("AF"))).drop("classes")


@query("""WITH r AS (SELECT o_totalprice / 20 AS metres, 300 + o_totalprice / 300 AS seconds, o_totalprice / (20 + o_custkey % 5) AS ref_metres, 200 + o_totalprice / 400 AS ref_seconds FROM orders),
m AS (SELECT unnest(['distance', 'time', 'speed']) AS measure, unnest([round(metres / ref_metres, 3), round(seconds / ref_seconds, 3), round(3.6 * metres / seconds, 3)]) AS v FROM r),
g AS (SELECT measure, median(v) AS median, min(v) AS least, max(v) AS greatest FROM m GROUP BY 1)
SELECT *, CASE measure WHEN 'distance' THEN median <= 1.25 WHEN 'time' THEN median BETWEEN 1.1 AND 2.6 ELSE median BETWEEN 8 AND 30 END AS passed FROM g""", "median least greatest")
def sanity_ratios(spark, sf_dir):
    price = F.col("o_totalprice")
    rows = b.table(spark, sf_dir, "orders").select((price / 20).alias("metres"), (300 + price / 300).alias("seconds"), (price / (20 + F.col("o_custkey") % 5)).alias("ref_metres"), (200 + price / 400).alias("ref_seconds"))
    return tr.sanity_ratios(rows)


_DEPTH = "(0.82 * 288 / greatest({} - 0.18 * 288, 0.04 * 288))"


@query(f"""WITH {b.DETECTIONS}, p AS (SELECT l_orderkey, l_linenumber, l_partkey, x, y, (x * 3) % 352 AS x2, (y * 5) % 288 AS y2 FROM detections)
SELECT l_orderkey, l_linenumber, l_partkey, round(sqrt(pow(50.0 * ({_DEPTH.format('y2')} - {_DEPTH.format('y')}), 2) + pow((x2 - x) * 35.0 / 352 * {_DEPTH.format('((y + y2) / 2)')}, 2)), 4) AS metres FROM p""")
def ground_distance(spark, sf_dir):
    p = b.detections(spark, sf_dir).withColumns({"x2": (F.col("x") * 3) % 352, "y2": (F.col("y") * 5) % 288})
    metres = tf.ground_distance(F.col("y"), F.col("x"), F.col("y2"), F.col("x2"), F.lit(288), F.col("frame_w"))
    return p.select("l_orderkey", "l_linenumber", "l_partkey", F.round(metres, 4).alias("metres"))
