"""Queries on the road graph, bound to supplier keys as a grid."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from .. import bindings as b
from ..functions import traffic as tf
from ..operators import nowcast as nc
from ..operators import roads as ro
from . import readings as rd
from .core import query

R, E = rd.R, "WITH " + b.EDGES
LAT0 = 51.49
XY = "CAST({lon} * 111320.0 * cos(radians(51.49)) AS DOUBLE) AS {x}, {lat} * 110540.0 AS {y}"
COS = math.cos(math.radians(LAT0))


def xy_edges(spark, sf_dir):
    e = b.edges(spark, sf_dir)
    return e.withColumns({f"x{k}": F.col(f"lon{k}") * 111320.0 * COS for k in (1, 2)} | {f"y{k}": F.col(f"lat{k}") * 110540.0 for k in (1, 2)})


def xy(points):
    return ro.local_metres(points, F.lit(LAT0))


@query(f"{E} SELECT a.edge, b.edge AS next FROM edges a JOIN edges b ON b.u = a.v WHERE a.twin IS NULL OR b.edge <> a.twin")
def adjacency_join(spark, sf_dir):
    return ro.adjacency_join(b.edges(spark, sf_dir))


NEAR = "near AS (SELECT a.edge, b.edge AS near, 0.0 AS extra FROM edges a JOIN edges b ON b.v = a.u UNION ALL SELECT a.edge, b.edge, 260.0 FROM edges a JOIN edges b ON b.u = a.v)"


@query(f"{E}, {NEAR} SELECT edge, near, CAST(extra AS DOUBLE) AS extra FROM near", "extra")
def upstream_downstream(spark, sf_dir):
    return ro.upstream_downstream(b.edges(spark, sf_dir))


_HAV = "2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2))))"
_BEAR = "((degrees(atan2(sin(radians(lon2 - lon1)) * cos(radians(lat2)), cos(radians(lat1)) * sin(radians(lat2)) - sin(radians(lat1)) * cos(radians(lat2)) * cos(radians(lon2 - lon1)))) + 360) % 360)"
ENDS = ("lat1", "lon1", "lat2", "lon2")


@query(f"{E} SELECT edge, round({_HAV}, 4) AS metres FROM edges")
def haversine_m(spark, sf_dir):
    return b.edges(spark, sf_dir).select("edge", F.round(tf.haversine_m(*map(F.col, ENDS)), 4).alias("metres"))


@query(f"{E} SELECT edge, round({_BEAR}, 4) AS bearing FROM edges")
def bearing_deg(spark, sf_dir):
    return b.edges(spark, sf_dir).select("edge", F.round(tf.bearing_deg(*map(F.col, ENDS)), 4).alias("bearing"))


@query(f"WITH {b.NODES} SELECT node, {XY.format(lon='lon', lat='lat', x='x', y='y')} FROM nodes", "x y")
def local_metres(spark, sf_dir):
    return xy(b.nodes(spark, sf_dir)).select("node", "x", "y")


PLACED = f"{R}, {b.EDGES}, {b.SENSORS}, sp AS (SELECT *, {XY.format(lon='lon', lat='lat', x='x', y='y')} FROM sensors), np AS (SELECT *, {XY.format(lon='lon', lat='lat', x='x', y='y')} FROM nodes)"
NEAREST = "nearest AS (SELECT camera_id, n.node, round(sqrt(pow(s.x - n.x, 2) + pow(s.y - n.y, 2)), 6) AS metres FROM sp s, np n WHERE sqrt(pow(s.x - n.x, 2) + pow(s.y - n.y, 2)) <= 300 QUALIFY row_number() OVER (PARTITION BY camera_id ORDER BY round(sqrt(pow(s.x - n.x, 2) + pow(s.y - n.y, 2)), 6), n.node) = 1)"


@query(f"{PLACED}, {NEAREST} SELECT camera_id, node, round(metres, 4) AS metres FROM nearest")
def nearest_node(spark, sf_dir):
    return ro.nearest_node(xy(b.sensors(spark, sf_dir)), xy(b.nodes(spark, sf_dir)), "camera_id").withColumn("metres", F.round("metres", 4))


EXY = f"exy AS (SELECT *, {XY.format(lon='lon1', lat='lat1', x='x1', y='y1')}, {XY.format(lon='lon2', lat='lat2', x='x2', y='y2')} FROM edges)"


@query(f"""{PLACED}, {NEAREST}, {EXY}, cand AS (SELECT s.camera_id, e.edge, e.rank, sqrt(pow(s.x - (x1 + x2) / 2, 2) + pow(s.y - (y1 + y2) / 2, 2)) AS d FROM nearest n JOIN sp s USING (camera_id) JOIN exy e ON e.u = n.node OR e.v = n.node),
best AS (SELECT camera_id, edge, round(d, 6) AS metres FROM cand QUALIFY row_number() OVER (PARTITION BY camera_id ORDER BY round(d * (1 + 0.3 * rank), 6), edge) = 1)
SELECT camera_id, edge, round(metres, 4) AS metres FROM best WHERE metres <= 120 QUALIFY row_number() OVER (PARTITION BY edge ORDER BY metres, camera_id) = 1""")
def map_match_sensors(spark, sf_dir):
    return ro.map_match_sensors(xy(b.sensors(spark, sf_dir)), xy(b.nodes(spark, sf_dir)), xy_edges(spark, sf_dir)).withColumn("metres", F.round("metres", 4))


_K = "least(greatest(((s.x - x1) * (x2 - x1) + (s.y - y1) * (y2 - y1)) / greatest(pow(x2 - x1, 2) + pow(y2 - y1, 2), 1e-9), 0.0), 1.0)"


@query(f"""{PLACED}, {EXY}, d AS (SELECT camera_id, sqrt(pow(s.x - x1 - {_K} * (x2 - x1), 2) + pow(s.y - y1 - {_K} * (y2 - y1), 2)) AS m FROM sp s, exy) SELECT camera_id, round(min(m), 4) AS metres FROM d GROUP BY 1""")
def point_segment_distance(spark, sf_dir):
    return ro.point_segment_distance(xy(b.sensors(spark, sf_dir)), xy_edges(spark, sf_dir)).withColumn("metres", F.round("metres", 4))


@query(f"""{PLACED}, {EXY}, d AS (SELECT camera_id, round(min(sqrt(pow(s.x - x1 - {_K} * (x2 - x1), 2) + pow(s.y - y1 - {_K} * (y2 - y1), 2))), 4) AS metres FROM sp s, (SELECT * FROM exy WHERE name = 'Row 3') GROUP BY 1)
SELECT camera_id, metres FROM d WHERE metres <= 300 ORDER BY metres, camera_id LIMIT 10""")
def sensors_near_routes(spark, sf_dir):
    near = ro.point_segment_distance(xy(b.sensors(spark, sf_dir)), xy_edges(spark, sf_dir).where("name = 'Row 3'")).withColumn("metres", F.round("metres", 4))
    return near.where("metres <= 300").orderBy("metres", "camera_id").limit(10)


DEGREE = """degree AS (SELECT e.edge, o AS out_degree, coalesce(i, 0) AS in_degree, o >= 3 AS junction, CASE WHEN o >= 3 THEN
 CASE WHEN rank <= 2 THEN 1.0 WHEN rank <= 4 THEN 0.78 ELSE 0.3 END * least(greatest(greatest(o, coalesce(i, 0)) / 3.0, 0.7), 1.8) ELSE 0.0 END AS weight
 FROM edges e JOIN (SELECT u, count(*) AS o FROM edges GROUP BY 1) a ON a.u = e.u LEFT JOIN (SELECT v, count(*) AS i FROM edges GROUP BY 1) c ON c.v = e.u)"""


@query(f"{E}, {DEGREE} SELECT * FROM degree", "weight")
def junction_degree(spark, sf_dir):
    return ro.junction_degree(b.edges(spark, sf_dir))


@query(f"{E} SELECT lower(name) AS key, edge, u AS node FROM edges QUALIFY row_number() OVER (PARTITION BY lower(name) ORDER BY len DESC, edge) = 1")
def place_anchor(spark, sf_dir):
    return ro.place_anchor(b.edges(spark, sf_dir))


@query(f"""{E}, s AS (SELECT lower(name) AS key, min(u) AS node FROM edges GROUP BY 1), l AS (SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'row ' || n_nationkey ELSE lower(n_name) END AS key, n_nationkey AS node FROM nation)
SELECT coalesce(l.key, s.key) AS key, coalesce(CAST(l.node AS BIGINT), s.node) AS node, CASE WHEN l.key IS NULL THEN 'street' ELSE 'landmark' END AS kind FROM s FULL JOIN l ON s.key = l.key""")
def landmark_union(spark, sf_dir):
    streets = b.edges(spark, sf_dir).groupBy(F.lower("name").alias("key")).agg(F.min("u").alias("node"))
    key = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("row "), F.col("n_nationkey").cast("string"))).otherwise(F.lower("n_name"))
    return ro.landmark_union(streets, b.table(spark, sf_dir, "nation").select(key.alias("key"), F.col("n_nationkey").cast("bigint").alias("node")))


_WAYS = "ways AS (SELECT edge, u, v, oneway, [lat1, lat2] AS geom FROM edges WHERE twin IS NULL OR edge < twin)"


@query(f"""{E}, {_WAYS} SELECT edge * 2 AS id, u, v, round(geom[1], 6) AS head, CASE WHEN oneway THEN NULL ELSE edge * 2 + 1 END AS twin FROM ways
 UNION ALL SELECT edge * 2 + 1, v, u, round(geom[2], 6), edge * 2 FROM ways WHERE NOT oneway""")
def bidirectional_edges(spark, sf_dir):
    ways = b.edges(spark, sf_dir).where("twin is null or edge < twin").select("edge", "u", "v", "oneway", F.array("lat1", "lat2").alias("geom"))
    return ro.bidirectional_edges(ways).select("id", "u", "v", F.round(F.col("geom")[0], 6).alias("head"), "twin")


_D = "round((((b2 - b1) + 180) % 360 + 360) % 360 - 180, 6)"
TURNS = f"""bear AS (SELECT *, {_BEAR} AS bearing FROM edges), pairs AS (SELECT a.edge, b.edge AS next, a.name AS n1, b.name AS n2, a.bearing AS b1, b.bearing AS b2 FROM bear a JOIN bear b ON b.u = a.v WHERE a.twin IS NULL OR b.edge <> a.twin),
turns AS (SELECT edge, next, CASE WHEN n1 = n2 OR abs({_D}) < 22 THEN 0.0 ELSE (CASE WHEN abs({_D}) > 70 THEN 9.0 ELSE 4.0 END) * (CASE WHEN {_D} > 45 THEN 1.8 ELSE 1.0 END) + (CASE WHEN abs({_D}) > 150 THEN 25.0 ELSE 0.0 END) END AS turn_s FROM pairs)"""


@query(f"{E}, {TURNS} SELECT * FROM turns", "turn_s")
def turn_cost(spark, sf_dir):
    return ro.turn_cost(b.edges(spark, sf_dir))


@query(f"{R}, {b.NODES}, {b.SENSORS} SELECT camera_id, node FROM sensors WHERE lat BETWEEN 51.487 AND 51.493 AND lon BETWEEN -0.162 AND -0.155")
def bbox_filter(spark, sf_dir):
    return b.sensors(spark, sf_dir).where("lat between 51.487 and 51.493 and lon between -0.162 and -0.155").select("camera_id", "node")


@query(f"""{E.replace('WITH ', 'WITH RECURSIVE ')}, r(a, b) AS (SELECT u, v FROM edges UNION SELECT r.a, e.v FROM r JOIN edges e ON e.u = r.b),
comp AS (SELECT n.node, coalesce(least(n.node, min(x.b)), n.node) AS component FROM (SELECT u AS node FROM edges UNION SELECT v FROM edges) n
 LEFT JOIN (SELECT r1.a, r1.b FROM r r1 JOIN r r2 ON r1.a = r2.b AND r1.b = r2.a) x ON x.a = n.node GROUP BY 1),
best AS (SELECT component FROM comp GROUP BY 1 ORDER BY count(*) DESC, component LIMIT 1) SELECT node FROM comp WHERE component = (SELECT component FROM best)""")
def largest_scc(spark, sf_dir):
    return ro.largest_scc(b.edges(spark, sf_dir))


REACH = 900.0  # metres; edges of the grid are some 100 m long
KERNEL = f"""near AS (SELECT a.edge, b.edge AS near, b.len + x.extra + CASE WHEN a.name = b.name THEN 0 ELSE 550.0 END AS step FROM (SELECT a.edge, b.edge AS near, 0.0 AS extra FROM edges a JOIN edges b ON b.v = a.u
 UNION ALL SELECT a.edge, b.edge, 260.0 FROM edges a JOIN edges b ON b.u = a.v) x JOIN edges a ON a.edge = x.edge JOIN edges b ON b.edge = x.near),
walk(camera_id, edge, metres) AS (SELECT camera_id, edge, CAST(0 AS DOUBLE) FROM watch UNION SELECT w.camera_id, n.near, round(w.metres + n.step, 6) FROM walk w JOIN near n ON n.edge = w.edge WHERE w.metres + n.step <= {REACH}),
costs AS (SELECT camera_id, edge, min(metres) AS metres FROM walk GROUP BY 1, 2),
raw AS (SELECT c.camera_id, c.edge, exp(-metres / 1400.0) * pow(0.82, abs(e.rank - o.rank)) AS w, e.name = o.name AS own FROM costs c JOIN edges e ON e.edge = c.edge JOIN watch k ON k.camera_id = c.camera_id JOIN edges o ON o.edge = k.edge),
kernel AS (SELECT camera_id, edge, CASE WHEN own THEN least(1.0, w * 1.35) ELSE w END AS weight FROM raw WHERE CASE WHEN own THEN least(1.0, w * 1.35) ELSE w END >= 0.04)"""
BASE = rd.WITH_OBS.replace("WITH ", "WITH RECURSIVE ", 1)


def kernel(spark, sf_dir):
    return nc.corridor_kernel(b.watched(spark, sf_dir), b.edges(spark, sf_dir), REACH)


@query(f"{BASE}, {KERNEL} SELECT camera_id, edge, weight FROM kernel", "weight")
def corridor_kernel(spark, sf_dir):
    return kernel(spark, sf_dir)


@query(f"{BASE}, {KERNEL}, reach AS (SELECT edge, sum(weight) AS reach FROM kernel GROUP BY 1), m AS (SELECT e.rank, CASE WHEN coalesce(reach, 0) > 0.04 THEN 1.0 ELSE 0.0 END AS known FROM edges e LEFT JOIN reach USING (edge)) SELECT count(*) AS edges, CAST(sum(known) AS BIGINT) AS inferable, 100 * avg(known) AS pct, 100 * avg(known) FILTER (WHERE rank <= 3) AS pct_main FROM m", "pct pct_main")
def kernel_reach(spark, sf_dir):
    return nc.kernel_reach(kernel(spark, sf_dir), b.edges(spark, sf_dir))


@query(f"{rd.WITH_OBS}, m AS (SELECT e.rank, e.len, CASE WHEN w.edge IS NULL THEN 0.0 ELSE 1.0 END AS seen FROM edges e LEFT JOIN (SELECT DISTINCT edge FROM watch) w USING (edge)) SELECT CAST(sum(seen) AS BIGINT) AS watched, 100 * avg(seen) AS pct, 100 * avg(seen) FILTER (WHERE rank <= 3) AS pct_main, sum(len * seen) / 1000 AS km FROM m", "pct pct_main km")
def sensor_coverage(spark, sf_dir):
    return nc.sensor_coverage(b.watched(spark, sf_dir), b.edges(spark, sf_dir))


C0 = 0.4
HIST = f"hist AS (SELECT edge, greatest(3.5, kph * (1 - 0.8 * {C0} * CASE WHEN rank <= 3 THEN 1.0 ELSE 0.6 END)) AS hist FROM edges)"
# one observation an edge: that of the least sensor
ONE = "one AS (SELECT obs.*, least(greatest(speed_kph / hist, 0.12), 2.2) AS ratio FROM obs JOIN hist USING (edge) QUALIFY row_number() OVER (PARTITION BY edge ORDER BY camera_id) = 1)"
FUSED = """joined AS (SELECT k.camera_id, k.edge, weight * confidence AS w, ln(ratio) AS log_ratio FROM kernel k JOIN one USING (camera_id)),
sums AS (SELECT edge, sum(w * log_ratio) AS num, sum(w) AS den FROM joined GROUP BY 1), fused AS (SELECT edge, den / (den + 0.3) AS support, exp(num / greatest(den, 1e-9) * (den / (den + 0.3))) AS anomaly FROM sums)"""
STATE = """made AS (SELECT h.edge, h.hist, coalesce(support, 0.0) AS support, CASE WHEN coalesce(support, 0.0) > 0.02 THEN coalesce(anomaly, 1.0) ELSE 1.0 END AS memory, o.speed_kph, o.confidence, coalesce(o.queue_m, 0.0) AS queue_m, o.edge IS NOT NULL AS observed
 FROM hist h LEFT JOIN fused f USING (edge) LEFT JOIN one o ON o.edge = h.edge),
state AS (SELECT edge, hist, support, memory, queue_m, observed, CASE WHEN observed THEN greatest(speed_kph * confidence + greatest(hist * memory, 3.5) * (1 - confidence), 3.5) ELSE greatest(hist * memory, 3.5) END AS kph,
 CASE WHEN observed THEN 0.06 + 0.05 * (1 - confidence) ELSE 0.16 * (1 - 0.72 * support) + 0.06 END AS sigma FROM made)"""
WITH_STATE = f"{BASE}, {KERNEL}, {HIST}, {ONE}, {FUSED}, {STATE}"
STATE_COLUMNS = "edge, hist, support, memory, queue_m, observed, kph, sigma, least(greatest(kph / hist, 0.08), 2.4) AS anomaly"


def parts(spark, sf_dir):
    edges = b.edges(spark, sf_dir)
    expected = nc.expected_speed(edges, F.lit(C0))
    obs = nc.observed_ratio(rd.observations(spark, sf_dir), expected)
    return edges, expected, nc.one_per_edge(obs)


def state(spark, sf_dir):
    _, expected, one = parts(spark, sf_dir)
    return nc.nowcast_state(expected, nc.nowcast_fuse(nc.observation_kernel_join(one, kernel(spark, sf_dir))), one)


@query(f"{E}, {HIST} SELECT * FROM hist", "hist")
def expected_speed(spark, sf_dir):
    return nc.expected_speed(b.edges(spark, sf_dir), F.lit(C0))


@query(f"{WITH_STATE} SELECT camera_id, edge, w, log_ratio FROM joined", "w log_ratio")
def observation_kernel_join(spark, sf_dir):
    return nc.observation_kernel_join(parts(spark, sf_dir)[2], kernel(spark, sf_dir))


@query(f"{WITH_STATE} SELECT * FROM fused", "support anomaly")
def nowcast_fuse(spark, sf_dir):
    return nc.nowcast_fuse(nc.observation_kernel_join(parts(spark, sf_dir)[2], kernel(spark, sf_dir)))


@query(f"{WITH_STATE} SELECT {STATE_COLUMNS} FROM state", "hist support memory queue_m kph sigma anomaly")
def nowcast_state(spark, sf_dir):
    return state(spark, sf_dir)


@query(f"{WITH_STATE} SELECT avg(s.kph) AS mean_kph, avg(s.kph) FILTER (WHERE rank <= 3) AS main_kph, 100 * avg(CASE WHEN least(greatest(1 - s.kph / greatest(e.kph, 1.0), 0.0), 1.0) > 0.55 THEN 1.0 ELSE 0.0 END) AS pct_congested, CAST(sum(CAST(observed AS INTEGER)) AS BIGINT) AS reporting, 100 * avg(CASE WHEN support > 0.02 THEN 1.0 ELSE 0.0 END) AS pct_informed FROM state s JOIN edges e USING (edge)", "mean_kph main_kph pct_congested pct_informed")
def network_stats(spark, sf_dir):
    return nc.network_stats(state(spark, sf_dir), b.edges(spark, sf_dir))


_RATIO = "round(avg(s.kph) / avg(e.kph), 6)"


@query(f"{WITH_STATE} SELECT node, avg(s.kph) AS mean_kph, avg(e.kph) AS free_kph, CAST(sum(CAST(observed AS INTEGER)) AS BIGINT) AS watched, CASE WHEN {_RATIO} > 0.75 THEN 'clear' WHEN {_RATIO} > 0.55 THEN 'busy' WHEN {_RATIO} > 0.35 THEN 'slow' ELSE 'jammed' END AS mood FROM state s JOIN (SELECT edge, kph, unnest([u, v]) AS node FROM edges) e USING (edge) GROUP BY node", "mean_kph free_kph")
def road_report(spark, sf_dir):
    return nc.road_report(state(spark, sf_dir), b.edges(spark, sf_dir))


@query(f"{WITH_STATE} SELECT s.edge, least(greatest(1 - s.kph / greatest(e.kph, 1.0), 0.0), 1.0) AS congestion FROM state s JOIN edges e USING (edge)", "congestion")
def edge_congestion(spark, sf_dir):
    met = state(spark, sf_dir).join(b.edges(spark, sf_dir).select("edge", F.col("kph").alias("free")), "edge")
    return met.select("edge", tf.edge_congestion(F.col("kph"), F.col("free")).alias("congestion"))


_RE = "round(s.kph / e.kph, 6)"


@query(f"{WITH_STATE} SELECT s.edge, CAST(CAST((1 - {_RE}) / 0.8 >= 0.3 AS INTEGER) + CAST((1 - {_RE}) / 0.8 >= 0.52 AS INTEGER) + CAST((1 - {_RE}) / 0.8 >= 0.72 AS INTEGER) AS INTEGER) AS level, CASE WHEN {_RE} > 0.75 THEN 'clear' WHEN {_RE} > 0.55 THEN 'busy' WHEN {_RE} > 0.35 THEN 'slow' ELSE 'jammed' END AS mood FROM state s JOIN edges e USING (edge)")
def traffic_level(spark, sf_dir):
    met = state(spark, sf_dir).join(b.edges(spark, sf_dir).select("edge", F.col("kph").alias("free")), "edge")
    ratio = F.round(F.col("kph") / F.col("free"), 6)
    return met.select("edge", tf.traffic_level(ratio).alias("level"), tf.mood(ratio).alias("mood"))


_WEIGHT = "wt AS (SELECT e.edge, e.kph AS free, coalesce(d.weight, 0) AS weight FROM edges e LEFT JOIN degree d USING (edge))"


def weighted_edges(spark, sf_dir):
    edges = b.edges(spark, sf_dir)
    return edges.join(ro.junction_degree(edges).select("edge", "weight"), "edge")


def profile_sql(kind: str) -> str:
    a = "least(greatest(least(greatest(kph / hist, 0.08), 2.4), 0.12), 2.2)"
    v = {"forecast": f"greatest(hist * (1 + ({a} - 1) * exp(-step * 120.0 / 1200.0)), 3.5)", "snapshot": f"greatest(hist * {a}, 3.5)", "historical": "hist", "free": "free"}[kind]
    sigma = {"forecast": "least(greatest(sigma + 0.055 * step * 120.0 / 600, 0.06), 0.55)", "snapshot": "least(greatest(sigma, 0.06), 0.55)"}.get(kind, "CAST(0.22 AS DOUBLE)")
    s = "least(greatest(1 / least(greatest(v / greatest(free, 1.0), 0.05), 1.0) - 1, 0.0), 3.0)"
    delay = "CAST(0 AS DOUBLE)" if kind == "free" else f"(12 + 83 * {s} * {s} / (1 + {s} * {s})) * weight"
    return f"prof AS (SELECT edge, step, v AS kph, sg AS sigma, {delay} AS delay_s FROM (SELECT edge, step, free, weight, {v} AS v, {sigma} AS sg FROM state JOIN wt USING (edge), (SELECT CAST(unnest(range(46)) AS INTEGER) AS step)))"


def _profile(kind: str, name: str) -> None:
    @query(f"{WITH_STATE}, {DEGREE}, {_WEIGHT}, {profile_sql(kind)} SELECT * FROM prof", "kph sigma delay_s", name)
    def run(spark, sf_dir):
        return nc.forecast_profile(state(spark, sf_dir), weighted_edges(spark, sf_dir), kind=kind)


for _kind, _name in (("forecast", "forecast_profile"), ("snapshot", "snapshot_profile"), ("historical", "historical_only_profile"), ("free", "free_flow_profile")):
    _profile(_kind, _name)

_USERS = "users(user_id, bonus, skill) AS (SELECT c_custkey, (c_custkey % 3) * 0.3, 0.9 + (c_custkey % 5) * 0.05 FROM customer)"


@query(f"""{WITH_STATE}, {DEGREE}, {_WEIGHT}, {profile_sql('forecast')}, {_USERS}, {b.ASKED} SELECT user_id, p.edge, step, least(p.kph * (1 + bonus * pow(least(greatest(1 - p.kph / greatest(free, 1.0), 0.0), 1.0), 1.5)) * skill, free * 1.05) AS kph,
 delay_s * (1 - 0.45 * bonus) AS delay_s FROM prof p JOIN wt USING (edge) JOIN asked USING (edge) JOIN users USING (user_id)""", "kph delay_s")
def personalise_profile(spark, sf_dir):
    users = b.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), ((F.col("c_custkey") % 3) * 0.3).alias("bonus"), (0.9 + (F.col("c_custkey") % 5) * 0.05).alias("skill"))
    prof = nc.forecast_profile(state(spark, sf_dir), weighted_edges(spark, sf_dir))
    return nc.personalise_profile(prof, b.edges(spark, sf_dir), users, b.asked_edges(spark, sf_dir))


@query(f"""{R}, ticks AS (SELECT camera_id AS edge, CAST(row_number() OVER (PARTITION BY camera_id ORDER BY t, event_id) AS INTEGER) AS tick, moving_frac / 2 - 0.2 AS support, 0.5 + tracks / 6.0 AS anomaly FROM readings),
g AS (SELECT *, max(CASE WHEN support > 0.02 THEN tick END) OVER (PARTITION BY edge ORDER BY tick) AS at FROM ticks) SELECT g.edge, g.tick, coalesce(1 + (s.anomaly - 1) * pow(0.86, g.tick - g.at), 1.0) AS memory FROM g LEFT JOIN ticks s ON s.edge = g.edge AND s.tick = g.at""", "memory")
def temporal_memory(spark, sf_dir):
    from pyspark.sql import Window

    tick = F.row_number().over(Window.partitionBy("camera_id").orderBy("t", "event_id"))
    r = b.readings(spark, sf_dir).select(F.col("camera_id").alias("edge"), tick.alias("tick"), (F.col("moving_frac") / 2 - 0.2).alias("support"), (0.5 + F.col("tracks") / 6.0).alias("anomaly"))
    return nc.temporal_memory(r)


@query(f"{WITH_STATE} SELECT e.edge, e.rank, round(least(greatest(1 - s.kph / greatest(e.kph, 1.0), 0.0), 1.0), 6) AS congestion FROM edges e JOIN state s USING (edge) WHERE rank <= 5 ORDER BY 3 DESC, 1 LIMIT 50", "congestion")
def render_subset(spark, sf_dir):
    return ro.render_subset(b.edges(spark, sf_dir), state(spark, sf_dir), most=50)
