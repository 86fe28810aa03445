"""The driver's tables as domain relations, in Spark and as text that DuckDB reads the same way.

Integer arithmetic on keys only, so that both give the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schema import ROAD_CLASSES

GRID_W = 9  # junctions in a row of the grid


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(column: str) -> F.Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.expr(f"unix_micros(cast(convert_timezone('UTC', current_timezone(), {column}) as timestamp))")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("camera_id"),
        "event_id",
        (micros("ts") / F.lit(1000000.0)).alias("t"),
        (F.col("value") / 10).alias("count_mean"),
        (F.col("event_id") % 7).cast("int").alias("tracks"),
        ((F.col("event_id") * 37 % 101) / F.lit(100.0)).alias("moving_frac"),
        F.lit(40).alias("frames"),
        F.col("event_type").alias("cls"),
        "props",
    )


READINGS = """readings AS (SELECT user_id AS camera_id, event_id, epoch_us(ts) / 1000000.0 AS t, value / 10 AS count_mean,
 CAST(event_id % 7 AS INTEGER) AS tracks, (event_id * 37 % 101) / 100.0 AS moving_frac, 40 AS frames, event_type AS cls, props FROM events)"""


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier keys as a grid of junctions."""
    k = F.col("s_suppkey")
    row, col = F.expr(f"s_suppkey div {GRID_W}"), k % GRID_W
    return table(spark, sf_dir, "supplier").select(k.alias("node"), row.alias("row"), col.alias("col"), (51.485 + row * 0.001).alias("lat"), (-0.165 + col * 0.0015).alias("lon"))


NODES = f"""nodes AS (SELECT s_suppkey AS node, s_suppkey // {GRID_W} AS row, s_suppkey % {GRID_W} AS col,
 51.485 + (s_suppkey // {GRID_W}) * 0.001 AS lat, -0.165 + (s_suppkey % {GRID_W}) * 0.0015 AS lon FROM supplier)"""

_CLASS_ROWS = ", ".join(f"({i}, '{hw}', {kph}, {cap}, {rank})" for i, (hw, kph, cap, rank) in enumerate(ROAD_CLASSES))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed road edges between grid neighbours; some are one-way, some streets are missing a direction."""
    n = nodes(spark, sf_dir)
    a, b = n.alias("a"), n.alias("b")
    right = a.join(b, (F.col("b.node") == F.col("a.node") + 1) & (F.col("a.row") == F.col("b.row"))).withColumn("dir", F.lit(0))
    down = a.join(b, F.col("b.node") == F.col("a.node") + GRID_W).withColumn("dir", F.lit(2))
    ends = ("a.*", F.col("b.node").alias("other"), F.col("b.lat").alias("lat2"), F.col("b.lon").alias("lon2"), "dir")
    pair = right.select(*ends).union(down.select(*ends))
    m = (F.col("node") * 7 + F.col("dir") * 3) % 10
    kind = F.when(F.col("dir") == 0, F.col("row")).otherwise(F.col("col")) % len(ROAD_CLASSES)
    name = F.when(F.col("dir") == 0, F.concat(F.lit("Row "), F.col("row").cast("string"))).otherwise(F.concat(F.lit("Col "), F.col("col").cast("string")))
    base = pair.withColumns({"m": m, "kind": kind.cast("int"), "name": name})
    ahead = base.where("m <> 0").selectExpr("node * 4 + dir as edge", "node as u", "other as v", "name", "kind", "lat as lat1", "lon as lon1", "lat2", "lon2", "m between 1 and 3 as oneway", "case when m in (1, 2, 3) then null else node * 4 + dir + 1 end as twin")
    back = base.where("m not in (1, 2, 3)").selectExpr("node * 4 + dir + 1 as edge", "other as u", "node as v", "name", "kind", "lat2 as lat1", "lon2 as lon1", "lat as lat2", "lon as lon2", "m = 0 as oneway", "case when m = 0 then null else node * 4 + dir end as twin")
    classes = spark.createDataFrame([(i, *c) for i, c in enumerate(ROAD_CLASSES)], "kind int, hw string, kph double, cap double, rank int")
    lanes = F.when(F.col("rank") <= 2, 3).when(F.col("rank") <= 4, 2).otherwise(1)
    length = F.round(F.sqrt(F.pow((F.col("lat2") - F.col("lat1")) * 110540.0, 2) + F.pow((F.col("lon2") - F.col("lon1")) * 69300.0, 2)), 2)
    return ahead.union(back).join(F.broadcast(classes), "kind").withColumns({"len": length, "lanes": lanes}).drop("kind")


EDGES = f"""{NODES}, pair AS (
 SELECT a.*, b.node AS other, b.lat AS lat2, b.lon AS lon2, 0 AS dir FROM nodes a JOIN nodes b ON b.node = a.node + 1 AND a.row = b.row
 UNION ALL SELECT a.*, b.node, b.lat, b.lon, 2 FROM nodes a JOIN nodes b ON b.node = a.node + {GRID_W}),
laid AS (SELECT *, (node * 7 + dir * 3) % 10 AS m, (CASE WHEN dir = 0 THEN row ELSE col END) % {len(ROAD_CLASSES)} AS kind,
 CASE WHEN dir = 0 THEN 'Row ' || row ELSE 'Col ' || col END AS name FROM pair),
both_ways AS (
 SELECT node * 4 + dir AS edge, node AS u, other AS v, name, kind, lat AS lat1, lon AS lon1, lat2, lon2, m BETWEEN 1 AND 3 AS oneway,
  CASE WHEN m IN (1, 2, 3) THEN NULL ELSE node * 4 + dir + 1 END AS twin FROM laid WHERE m <> 0
 UNION ALL SELECT node * 4 + dir + 1, other, node, name, kind, lat2, lon2, lat, lon, m = 0, CASE WHEN m = 0 THEN NULL ELSE node * 4 + dir END FROM laid WHERE m NOT IN (1, 2, 3)),
classes(kind, hw, kph, cap, rank) AS (VALUES {_CLASS_ROWS}),
edges AS (SELECT e.* EXCLUDE (kind), c.hw, CAST(c.kph AS DOUBLE) AS kph, CAST(c.cap AS DOUBLE) AS cap, c.rank,
 round(sqrt(pow((lat2 - lat1) * 110540.0, 2) + pow((lon2 - lon1) * 69300.0, 2)), 2) AS len,
 CASE WHEN rank <= 2 THEN 3 WHEN rank <= 4 THEN 2 ELSE 1 END AS lanes FROM both_ways e JOIN classes c USING (kind))"""


def sensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sensor a reading source, on a node of the grid with a small offset."""
    n = nodes(spark, sf_dir)
    ids = readings(spark, sf_dir).select("camera_id").distinct()
    count = n.agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("least"))
    placed = ids.join(F.broadcast(count)).withColumn("node", F.col("least") + F.col("camera_id") * 7919 % F.col("n"))
    shift = (F.col("camera_id") % 5) * 0.0001
    return placed.join(n, "node").select("camera_id", "node", (F.col("lat") + shift).alias("lat"), (F.col("lon") - shift).alias("lon"))


SENSORS = """sensors AS (SELECT camera_id, n.node, n.lat + (camera_id % 5) * 0.0001 AS lat, n.lon - (camera_id % 5) * 0.0001 AS lon
 FROM (SELECT DISTINCT camera_id FROM readings) r JOIN nodes n ON n.node = (SELECT min(node) FROM nodes) + r.camera_id * 7919 % (SELECT count(*) FROM nodes))"""

#: A sensor watches the out-edge of least id of its node (else the in-edge).
WATCH = """watch AS (SELECT camera_id, min(edge) AS edge FROM sensors s JOIN edges e ON e.u = s.node GROUP BY camera_id)"""


def watched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sensors(spark, sf_dir).join(edges(spark, sf_dir), F.col("u") == F.col("node")).groupBy("camera_id").agg(F.min("edge").alias("edge"))


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("clip"), (F.col("l_orderkey") % 100).alias("frame"), (F.col("l_partkey") % 20).alias("track"),
        F.concat("l_returnflag", "l_linestatus").alias("cls"), (F.col("l_quantity") * 7).alias("x"), (F.col("l_extendedprice") % 288).alias("y"),
        F.lit(352).alias("frame_w"), F.lit(288).alias("frame_h"), "l_orderkey", "l_linenumber", "l_partkey",
    )


DETECTIONS = """detections AS (SELECT l_suppkey AS clip, l_orderkey % 100 AS frame, l_partkey % 20 AS track, l_returnflag || l_linestatus AS cls,
 l_quantity * 7 AS x, l_extendedprice % 288 AS y, 352 AS frame_w, 288 AS frame_h, l_orderkey, l_linenumber, l_partkey FROM lineitem)"""


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error events as incidents on two edges of the grid."""
    e = table(spark, sf_dir, "events").where("event_type = 'error'")
    return e.select(
        F.col("event_id").alias("incident"), (micros("ts") / F.lit(1000000.0)).alias("start_s"), (600 + F.col("event_id") % 1800).cast("double").alias("duration_s"),
        F.least(F.col("value") / 50, F.lit(0.95)).alias("severity"), F.array((F.col("user_id") % 100) * 4, (F.col("user_id") % 100) * 4 + 1).alias("edges"), F.array(F.lit(1.0), F.lit(0.5)).alias("weights"),
    )


INCIDENTS = """incidents AS (SELECT event_id AS incident, epoch_us(ts) / 1000000.0 AS start_s, CAST(600 + event_id % 1800 AS DOUBLE) AS duration_s,
 least(value / 50, 0.95) AS severity, [(user_id % 100) * 4, (user_id % 100) * 4 + 1] AS edges, [1.0, 0.5] AS weights FROM events WHERE event_type = 'error')"""


def asked_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, edge): the edges out of the node that a customer's orders start from, for all customers with orders."""
    e = edges(spark, sf_dir).select("edge", "u")
    start = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id")).distinct().crossJoin(e.agg((F.max("u") + 1).alias("n")))
    return start.select("user_id", (F.col("user_id") % F.col("n")).alias("u")).join(e, "u").select("user_id", "edge")


ASKED = "asked AS (SELECT DISTINCT o_custkey AS user_id, e.edge FROM orders, (SELECT max(u) + 1 AS n FROM edges) AS m, edges e WHERE e.u = o_custkey % m.n)"


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as scored trips of three routing methods."""
    o = table(spark, sf_dir, "orders")
    method = F.element_at(F.array(F.lit("blend"), F.lit("snapshot"), F.lit("historical")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    actual = 300 + F.col("o_totalprice") / 300
    return o.select(
        F.expr("o_orderkey div 3").alias("trip"), method.alias("method"), F.col("o_custkey").alias("origin"), (F.col("o_custkey") * 31 % 1000).alias("dest"),
        actual.alias("actual_s"), (actual * (0.8 + (F.col("o_custkey") % 40) / 100.0)).alias("claimed_s"), (actual * (0.9 + (F.col("o_orderkey") % 30) / 100.0)).alias("promised_p90_s"),
        (F.col("o_totalprice") / 20).alias("distance_m"), (F.col("o_custkey") % 5 == 0).alias("disrupted"), "o_orderkey",
    )


TRIPS = """trips AS (SELECT o_orderkey // 3 AS trip, (['blend', 'snapshot', 'historical'])[o_orderkey % 3 + 1] AS method, o_custkey AS origin, o_custkey * 31 % 1000 AS dest,
 300 + o_totalprice / 300 AS actual_s, (300 + o_totalprice / 300) * (0.8 + (o_custkey % 40) / 100.0) AS claimed_s,
 (300 + o_totalprice / 300) * (0.9 + (o_orderkey % 30) / 100.0) AS promised_p90_s, o_totalprice / 20 AS distance_m, o_custkey % 5 = 0 AS disrupted, o_orderkey FROM orders)"""
