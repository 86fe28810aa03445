"""Queries of small lookups and wordings, and of files' shapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import bindings as b
from ..functions import text as tx
from . import roads as rr
from .core import query
from .readings import R


@query("""WITH p AS (SELECT *, p_size % 5 AS k, CASE WHEN p_size % 5 IN (0, 3) THEN -1 WHEN p_size % 5 = 1 OR (p_size % 5 = 2 AND p_brand = 'Brand#11') THEN 1 ELSE 0 END AS flag FROM part)
SELECT p_partkey, CAST(flag AS INTEGER) AS flag, CAST(CASE WHEN p_size % 3 > 0 THEN CASE WHEN flag <> 0 THEN p_size ELSE greatest(1, p_size // 2) END WHEN p_size % 9 <= 1 THEN 3 WHEN p_size % 9 <= 3 THEN 2 ELSE 1 END AS INTEGER) AS lanes FROM p""")
def oneway_lanes(spark, sf_dir):
    p = b.table(spark, sf_dir, "part")
    k, size = F.col("p_size") % 5, F.col("p_size").cast("string")
    tag = F.when(k == 0, "-1").when(k == 1, "Yes").when(k == 3, "reverse").when(k == 4, "no")
    junction = F.when(F.col("p_brand") == "Brand#11", "roundabout")
    lanes = F.when(F.col("p_size") % 3 == 1, F.concat(size, F.lit(";9"))).when(F.col("p_size") % 3 == 2, F.concat(size, F.lit(".5")))
    flag = tx.oneway_flag(tag, junction, F.lit("primary"))
    return p.select("p_partkey", flag.alias("flag"), tx.lane_count(lanes, F.col("p_size") % 9, flag != 0).alias("lanes"))


@query(f"""{R}, n AS (SELECT event_id, 1 + event_id % 11 AS h, CAST(floor(t) AS BIGINT) % 86400 AS now FROM readings)
SELECT event_id, CAST(least((h * 3600 - now + 86400) % 86400, ((h + 12) * 3600 - now + 86400) % 86400) AS BIGINT) AS wait FROM n""")
def next_occurrence_hour(spark, sf_dir):
    now = F.floor("t") % 86400
    return b.readings(spark, sf_dir).select("event_id", tx.next_occurrence(1 + F.col("event_id") % 11, now).cast("bigint").alias("wait"))


@query("""SELECT o_orderkey, array_to_string(list_filter([CASE WHEN o_orderkey % 400 > 60 THEN 'saves ' || CAST(floor((o_orderkey % 400) / 60.0 + 0.5) AS INTEGER) || ' min' END, CASE WHEN o_custkey % 200 > 90 THEN 'others promise too early' END,
 CASE WHEN o_orderstatus = 'F' THEN 'avoids an incident' END, CASE WHEN (o_custkey % 100) / 100.0 > 0.9 THEN 'very predictable' WHEN (o_custkey % 100) / 100.0 < 0.75 THEN 'could vary a lot' END], lambda x: x IS NOT NULL), '; ') AS advice FROM orders""")
def advisory_text(spark, sf_dir):
    o = b.table(spark, sf_dir, "orders")
    return o.select("o_orderkey", tx.advisory(F.col("o_orderkey") % 400, F.col("o_custkey") % 200, F.col("o_orderstatus") == "F", (F.col("o_custkey") % 100) / F.lit(100.0)).alias("advice"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 20 / 10.0 > 1.2 THEN 'plays it safe' WHEN c_custkey % 20 / 10.0 > 0.5 THEN 'balanced' ELSE 'fastest' END AS style FROM customer")
def profile_style(spark, sf_dir):
    return b.table(spark, sf_dir, "customer").select("c_custkey", tx.profile_style(F.col("c_custkey") % 20 / F.lit(10.0)).alias("style"))


@query("""SELECT user_id, event_id AS version, value, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1""", "value")
def profiles_upsert(spark, sf_dir):
    """Latest version of each keyed document; one row a user meets after partial aggregation."""
    best = F.max(F.struct(F.col("event_id").alias("version"), "value", "event_type")).alias("b")
    return b.table(spark, sf_dir, "events").groupBy("user_id").agg(best).select("user_id", "b.*")


@query(f"{rr.E} SELECT edge, round({rr._HAV} + {rr._HAV}, 2) AS metres FROM edges")
def polyline_length(spark, sf_dir):
    """Lines there and back: summed over consecutive points of an array."""
    from ..functions.traffic import haversine_m

    pt = lambda k: F.struct(F.col(f"lat{k}").alias("lat"), F.col(f"lon{k}").alias("lon"))
    e = b.edges(spark, sf_dir).withColumn("geom", F.array(pt(1), pt(2), pt(1)))
    legs = F.zip_with(F.slice("geom", 1, F.size("geom") - 1), F.slice("geom", 2, F.size("geom")), lambda p, q: haversine_m(p["lat"], p["lon"], q["lat"], q["lon"]))
    return e.select("edge", F.round(F.greatest(F.aggregate(legs, F.lit(0.0), lambda a, x: a + x), F.lit(1.0)), 2).alias("metres"))


@query("SELECT DISTINCT trim(p_type) AS id FROM part WHERE trim(p_type) <> '' AND trim(p_type) NOT LIKE '#%'")
def read_id_list(spark, sf_dir):
    line = F.trim("p_type")
    return b.table(spark, sf_dir, "part").select(line.alias("id")).where("id <> '' and id not like '#%'").distinct()
