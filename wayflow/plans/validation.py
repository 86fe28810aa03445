"""Queries of the forecast validation chain."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import bindings as b
from ..operators import readings as op
from ..operators import validation as va
from .core import query
from .readings import R, SLOPES

H, TOL = 86400.0, 21600.0

PAIRS = f"""pairs AS (SELECT a.camera_id, a.event_id, a.t AS t0, a.count_mean AS c0, a.slope, b.t AS t1, b.count_mean AS c1 FROM slopes a JOIN readings b
 ON a.camera_id = b.camera_id AND b.t BETWEEN a.t + {H} - {TOL} AND a.t + {H} + {TOL} QUALIFY row_number() OVER (PARTITION BY a.camera_id, a.event_id ORDER BY abs(b.t - (a.t + {H})), b.t, b.event_id) = 1)"""
TOD = "CAST((CAST(floor({} / 60) AS BIGINT) % 1440) // 30 AS INTEGER)"


def profile_sql(name: str, where: str) -> str:
    return f"""{name} AS (SELECT camera_id, {TOD.format('t')} AS bucket, avg(count_mean) AS m FROM readings WHERE {where} GROUP BY 1, 2),
{name}_cam AS (SELECT camera_id, avg(count_mean) AS m FROM readings WHERE {where} GROUP BY 1), {name}_all AS (SELECT avg(count_mean) AS m FROM readings WHERE {where})"""


def expected_sql(profile: str) -> str:
    return f"""expected AS (SELECT p.*, coalesce(f0.m, k.m, (SELECT m FROM {profile}_all), 0) AS h_now, coalesce(f1.m, k.m, (SELECT m FROM {profile}_all), 0) AS h_then FROM pairs p
 LEFT JOIN {profile} f0 ON f0.camera_id = p.camera_id AND f0.bucket = {TOD.format('p.t0')} LEFT JOIN {profile} f1 ON f1.camera_id = p.camera_id AND f1.bucket = {TOD.format('p.t1')}
 LEFT JOIN {profile}_cam k ON k.camera_id = p.camera_id)"""


def blend_sql(tau: str, damp: str) -> str:
    return f"greatest(0.0, h_then + (c0 - h_now) * exp(-{H} / {tau}) + {damp} * slope * {H})"


EXPECTED = f"{R}, {SLOPES}, {PAIRS}, {profile_sql('prof', 'true')}, {expected_sql('prof')}"
SCORE = "count(*) AS n, avg(abs(predicted - c1)) AS mae, sqrt(avg((predicted - c1) * (predicted - c1))) AS rmse, 100 * avg(abs(predicted - c1) / greatest(c1, 1.0)) AS mape, median(abs(predicted - c1)) AS median_ae"
SCORES = "mae rmse mape median_ae"


def pairs(spark, sf_dir):
    return va.forecast_pairs(b.readings(spark, sf_dir), H, TOL)


def expected(spark, sf_dir):
    return va.expected_pairs(pairs(spark, sf_dir), op.historical_profile(b.readings(spark, sf_dir)))


@query(f"{R}, {SLOPES}, {PAIRS} SELECT camera_id, event_id, t1, c1 FROM pairs", "t1 c1")
def nearest_after_join(spark, sf_dir):
    rows = b.readings(spark, sf_dir).select("camera_id", "event_id", "t", "count_mean")
    return va.nearest_after_join(rows, H, TOL).select("camera_id", "event_id", "t1", "c1")


@query(f"{R}, {SLOPES}, {PAIRS} SELECT * REPLACE (round(slope * 1000, 5) + 0.0 AS slope) FROM pairs", "t0 c0 t1 c1")
def forecast_pairs(spark, sf_dir):
    return pairs(spark, sf_dir).withColumn("slope", F.round(F.col("slope") * 1000, 5) + 0.0)


@query(f"{EXPECTED} SELECT camera_id, event_id, h_now, h_then FROM expected", "h_now h_then")
def profile_fallback_join(spark, sf_dir):
    return expected(spark, sf_dir).select("camera_id", "event_id", "h_now", "h_then")


@query(f"{EXPECTED} SELECT camera_id, event_id, round({blend_sql('86400.0', '0.5')}, 4) AS predicted FROM expected")
def forecast_blend(spark, sf_dir):
    return expected(spark, sf_dir).select("camera_id", "event_id", F.round(va.forecast_blend(H, F.lit(86400.0), F.lit(0.5)), 4).alias("predicted"))


@query(f"{R}, {SLOPES}, {PAIRS} SELECT camera_id, event_id, c0 AS predicted FROM pairs", "predicted")
def forecast_persistence(spark, sf_dir):
    return pairs(spark, sf_dir).select("camera_id", "event_id", F.col("c0").alias("predicted"))


@query(f"{EXPECTED} SELECT camera_id, event_id, h_then AS predicted FROM expected", "predicted")
def forecast_historical(spark, sf_dir):
    return expected(spark, sf_dir).select("camera_id", "event_id", F.col("h_then").alias("predicted"))


THREE = f"three AS (SELECT 'blend' AS forecaster, {blend_sql('86400.0', '0.0')} AS predicted, c1 FROM expected UNION ALL SELECT 'persistence', c0, c1 FROM expected UNION ALL SELECT 'historical', h_then, c1 FROM expected)"


@query(f"{EXPECTED}, {THREE} SELECT forecaster, {SCORE} FROM three GROUP BY 1", SCORES)
def forecast_scores(spark, sf_dir):
    return va.forecast_scores(va.predictions(expected(spark, sf_dir), H, F.lit(86400.0), F.lit(0.0)))


_GRID = f"grid AS (SELECT row_number() OVER () AS place, tau, damp FROM (VALUES {', '.join(f'({t}, {d})' for t in va.TAUS for d in va.DAMPS)}) g(tau, damp))"


def fit_sql(source: str) -> str:
    return f"fit AS (SELECT tau, damp, mae FROM (SELECT place, tau, damp, avg(abs({blend_sql('tau', 'damp')} - c1)) AS mae FROM {source}, grid GROUP BY 1, 2, 3) ORDER BY round(mae, 9), place LIMIT 1)"


@query(f"{EXPECTED}, {_GRID}, {fit_sql('expected')} SELECT CAST(tau AS DOUBLE) AS tau, CAST(damp AS DOUBLE) AS damp, mae FROM fit", "tau damp mae")
def fit_blend(spark, sf_dir):
    return va.fit_blend(expected(spark, sf_dir), H)


_CUTS = "o AS (SELECT t, row_number() OVER (ORDER BY t, event_id) - 1 AS k FROM readings), cut AS (SELECT (SELECT t FROM o WHERE k = floor(0.6 * 0.75 * ((SELECT count(*) FROM readings) - 1))) AS cut1, (SELECT t FROM o WHERE k = floor(0.6 * ((SELECT count(*) FROM readings) - 1))) AS cut2)"


VALIDATED = f"""{R}, {_CUTS}, {SLOPES}, {PAIRS}, {profile_sql('prof', 't <= (SELECT cut1 FROM cut)')}, {expected_sql('prof')},
 tune AS (SELECT e.* FROM expected e, cut WHERE t0 > cut1 AND t1 <= cut2), test AS (SELECT e.* FROM expected e, cut WHERE t0 > cut2), {_GRID}, {fit_sql('tune')},
 three AS (SELECT 'blend' AS forecaster, {blend_sql('tau', 'damp')} AS predicted, c1 FROM test, fit UNION ALL SELECT 'persistence', c0, c1 FROM test UNION ALL SELECT 'historical', h_then, c1 FROM test)
 SELECT forecaster, {SCORE}, (SELECT CAST(tau AS DOUBLE) FROM fit) AS tau, (SELECT CAST(damp AS DOUBLE) FROM fit) AS damp, (SELECT count(*) FROM tune) AS tuning_pairs FROM three GROUP BY 1"""


@query(VALIDATED, SCORES + " tau damp")
def validate_forecast(spark, sf_dir):
    return va.validate_forecast(b.readings(spark, sf_dir), H, TOL)


def _sweep_sql() -> str:
    parts = []
    for k, h in enumerate((43200.0, 86400.0)):
        ctes = f"{R}, {SLOPES}, {PAIRS}, {profile_sql('prof', 'true')}, {expected_sql('prof')}".replace(f"a.t + {H}", f"a.t + {h}")
        parts.append(f"(SELECT forecaster, {SCORE}, {h} AS horizon FROM ({ctes} SELECT 'persistence' AS forecaster, c0 AS predicted, c1 FROM expected UNION ALL SELECT 'historical', h_then, c1 FROM expected) s{k} GROUP BY 1)")
    return "SELECT forecaster, n, mae, rmse, mape, median_ae, CAST(horizon AS DOUBLE) AS horizon FROM (" + " UNION ALL ".join(parts) + ")"


@query(_sweep_sql(), SCORES + " horizon")
def horizon_sweep(spark, sf_dir):
    r = b.readings(spark, sf_dir)
    return va.horizon_sweep(r, (43200.0, 86400.0), TOL, op.historical_profile(r))
