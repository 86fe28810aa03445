"""Queries on routes: each row of the grid, driven to the right."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import bindings as b
from ..operators import nowcast as nc
from ..operators import roads as ro
from ..operators import routes as rt
from ..operators import trips as tr
from ..operators.numbering import dealt_by
from ..storage import save
from . import roads as rd
from .core import query
from .trips import VERDICTS

ROUTES = f"routes AS (SELECT u // {b.GRID_W} AS route, row_number() OVER (PARTITION BY u // {b.GRID_W} ORDER BY u) AS pos, edge FROM edges WHERE name LIKE 'Row%' AND edge % 4 = 0)"
E = rd.E + ", " + ROUTES
S = rd.WITH_STATE + ", " + ROUTES


def routes(spark, sf_dir):
    e = b.edges(spark, sf_dir).where("name like 'Row%' and edge % 4 = 0").withColumn("route", F.expr(f"u div {b.GRID_W}"))
    return e.select("route", F.row_number().over(Window.partitionBy("route").orderBy("u")).alias("pos"), "edge")


@query(f"""{E}, s AS (SELECT route, list(edge % 24) AS l FROM routes GROUP BY 1) SELECT x.route AS a, y.route AS b, CAST(len(list_intersect(list_distinct(x.l), list_distinct(y.l))) AS DOUBLE) / len(list_distinct(list_concat(x.l, y.l))) AS overlap FROM s x JOIN s y ON y.route = x.route + 1""", "overlap")
def route_overlap(spark, sf_dir):
    s = routes(spark, sf_dir).groupBy("route").agg(F.collect_list(F.col("edge") % 24).alias("l"))
    pairs = s.select(F.col("route").alias("a"), F.col("l").alias("edges_a")).join(s.select(F.col("route").alias("b"), F.col("l").alias("edges_b")), F.col("b") == F.col("a") + 1)
    return rt.route_overlap(pairs)


@query(f"{E}, c AS (SELECT route, name, round(sum(len), 2) AS metres FROM routes JOIN edges USING (edge) GROUP BY 1, 2) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY route ORDER BY metres DESC, name) AS place FROM c) WHERE place <= 4", "metres")
def main_roads(spark, sf_dir):
    return rt.main_roads(routes(spark, sf_dir), b.edges(spark, sf_dir))


_LV = "CAST((1 - {0}) / 0.8 >= 0.3 AS INTEGER) + CAST((1 - {0}) / 0.8 >= 0.52 AS INTEGER) + CAST((1 - {0}) / 0.8 >= 0.72 AS INTEGER)".format(rd._RE)


@query(f"""{S}, m AS (SELECT route, pos, {_LV} AS level, len FROM routes JOIN state s USING (edge) JOIN edges e USING (edge)),
c AS (SELECT *, coalesce(CAST(level <> lag(level) OVER (PARTITION BY route ORDER BY pos) AS INTEGER), 0) AS ch FROM m), r AS (SELECT *, CAST(sum(ch) OVER (PARTITION BY route ORDER BY pos) AS BIGINT) AS run FROM c)
SELECT route, run, CAST(min(level) AS INTEGER) AS level, count(*) AS edges, sum(len) AS metres FROM r GROUP BY 1, 2""", "metres")
def traffic_runs(spark, sf_dir):
    return rt.traffic_runs(routes(spark, sf_dir), rd.state(spark, sf_dir), b.edges(spark, sf_dir))


@query(f"""{E}, bear AS (SELECT edge, CASE WHEN coalesce(name, '') <> '' THEN name ELSE replace(hw, '_', ' ') || ' road' END AS name, len, len / (kph / 3.6) AS s, {rd._BEAR} AS bearing FROM edges), m AS (SELECT r.route, pos, name, len, s, round((((bearing - lag(bearing) OVER (PARTITION BY route ORDER BY pos)) + 180) % 360 + 360) % 360 - 180, 4) AS d,
 coalesce(CAST(name <> lag(name) OVER (PARTITION BY route ORDER BY pos) AS INTEGER), 0) AS ch FROM routes r JOIN bear USING (edge)), g AS (SELECT *, CAST(sum(ch) OVER (PARTITION BY route ORDER BY pos) AS BIGINT) AS run FROM m),
h AS (SELECT route, run, min(name) AS name, arg_min(d, pos) AS d, sum(len) AS metres, sum(s) AS seconds FROM g GROUP BY 1, 2)
SELECT route, run, name, CASE WHEN run = 0 OR d IS NULL THEN 'Head out on' WHEN abs(d) < 20 THEN 'Continue onto' WHEN abs(d) > 150 THEN 'Make a U-turn onto'
 ELSE (CASE WHEN abs(d) > 70 THEN 'Turn ' ELSE 'Bear ' END) || (CASE WHEN d > 0 THEN 'right' ELSE 'left' END) || ' onto' END AS verb, metres, seconds FROM h""", "metres seconds")
def direction_steps(spark, sf_dir):
    return rt.direction_steps(routes(spark, sf_dir), b.edges(spark, sf_dir))


@query(f"{E} SELECT route, len(list(edge)) + 1 AS points, first(u ORDER BY pos) AS head, last(v ORDER BY pos) AS tail FROM routes JOIN edges USING (edge) GROUP BY 1")
def route_geometry(spark, sf_dir):
    found = rt.route_geometry(routes(spark, sf_dir), b.edges(spark, sf_dir))
    return found.select("route", F.size("points").cast("bigint").alias("points"), F.element_at("points", 1).alias("head"), F.element_at("points", -1).alias("tail"))


@query(f"{S} SELECT route, sum(CASE WHEN support > 0.02 THEN len ELSE 0 END) / sum(len) AS informed, sum(CASE WHEN support > 0.2 THEN len ELSE 0 END) / sum(len) AS sure, CAST(sum(CAST(observed AS INTEGER)) AS BIGINT) AS observed FROM routes JOIN state USING (edge) JOIN edges USING (edge) GROUP BY 1", "informed sure")
def live_share(spark, sf_dir):
    return rt.live_share(routes(spark, sf_dir), rd.state(spark, sf_dir), b.edges(spark, sf_dir))


@query(f"{rd.R}, {b.EDGES}, {b.SENSORS}, {b.WATCH}, {ROUTES} SELECT route, camera_id, row_number() OVER (PARTITION BY route ORDER BY pos, camera_id) AS place FROM routes JOIN watch USING (edge) QUALIFY place <= 3")
def sensors_on_route(spark, sf_dir):
    return rt.sensors_on_route(routes(spark, sf_dir), b.watched(spark, sf_dir))


_PREFS = "prefs AS (SELECT c_custkey AS user_id, (c_custkey % 4) / 4.0 AS avoid_narrow, (c_custkey % 3) / 2.0 AS prefer_arterial, (c_custkey % 7) / 10.0 AS size_penalty, 'Row ' || (c_custkey % 5) AS liked FROM customer)"


@query(f"""{rd.E}, {b.ASKED}, {_PREFS} SELECT user_id, edge, (CASE WHEN rank >= 6 THEN 1 + 0.85 * avoid_narrow ELSE 1.0 END) * (CASE WHEN rank <= 3 THEN 1 - 0.18 * prefer_arterial ELSE 1.0 END)
 * (CASE WHEN rank >= 7 THEN 1 + size_penalty ELSE 1.0 END) * CASE WHEN name = liked THEN 0.8 ELSE 1.0 END AS factor FROM asked JOIN edges USING (edge) JOIN prefs USING (user_id)""", "factor")
def edge_preference(spark, sf_dir):
    k = F.col("c_custkey")
    liked = F.create_map(F.concat(F.lit("Row "), (k % 5).cast("string")), F.lit(0.8))
    users = b.table(spark, sf_dir, "customer").select(k.alias("user_id"), ((k % 4) / 4.0).alias("avoid_narrow"), ((k % 3) / 2.0).alias("prefer_arterial"), ((k % 7) / 10.0).alias("size_penalty"), liked.alias("road_bias"))
    return rt.edge_preference(b.asked_edges(spark, sf_dir), b.edges(spark, sf_dir), users)


@query("""WITH RECURSIVE f AS (SELECT user_id, event_id, event_type = 'view' AS up, unnest(['Row ' || (event_id % 5), 'Col ' || (event_id % 3)]) AS name, unnest([(event_id % 10) / 10.0, (10 - event_id % 10) / 10.0]) AS share FROM events WHERE event_type IN ('click', 'view')),
v AS (SELECT *, row_number() OVER (PARTITION BY user_id, name ORDER BY event_id) AS k FROM f), e AS (SELECT user_id, up, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events, (SELECT event_id AS id, event_type = 'view' AS up FROM events) u WHERE u.id = event_id AND event_type IN ('click', 'view')),
r(user_id, name, k, bias) AS (SELECT DISTINCT user_id, name, 0::BIGINT, 1.0::DOUBLE FROM v UNION ALL
 SELECT user_id, name, k, CASE WHEN abs(nb - bias) > 0.001 THEN round(nb, 3) ELSE bias END FROM (SELECT r.user_id, r.name, v.k, r.bias, least(greatest(r.bias + CASE WHEN up THEN -0.32 ELSE 0.32 END * share, 0.6), 1.8) AS nb FROM r JOIN v ON v.user_id = r.user_id AND v.name = r.name AND v.k = r.k + 1)),
q(user_id, k, risk) AS (SELECT DISTINCT user_id, 0::BIGINT, 0.8::DOUBLE FROM e UNION ALL SELECT q.user_id, e.k, least(greatest(q.risk + CASE WHEN up THEN -0.04 ELSE 0.12 END, 0.0), 2.5) FROM q JOIN e ON e.user_id = q.user_id AND e.k = q.k + 1)
SELECT a.user_id, a.name, a.bias, z.risk, CAST(z.k AS INTEGER) AS trips FROM (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY user_id, name ORDER BY k DESC) = 1) a JOIN (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY k DESC) = 1) z USING (user_id)""", "bias risk")
def learn_feedback(spark, sf_dir):
    e = b.table(spark, sf_dir, "events").where("event_type in ('click', 'view')")
    part = F.col("event_id") % 10
    road = lambda name, k, share: F.struct(F.concat(F.lit(name), (F.col("event_id") % k).cast("string")).alias("name"), (share / F.lit(10.0)).alias("share"))
    roads = F.explode(F.array(road("Row ", 5, part), road("Col ", 3, 10 - part))).alias("road")
    return rt.learn_feedback(e.select("user_id", F.col("event_id").alias("seq"), (F.col("event_type") == "view").alias("up"), roads).select("user_id", "seq", "up", "road.*"))


def costs(spark, sf_dir):
    edges = rd.weighted_edges(spark, sf_dir)
    return nc.pack(nc.forecast_profile(rd.state(spark, sf_dir), edges)), b.edges(spark, sf_dir), ro.turn_cost(b.edges(spark, sf_dir))


@query(f"""{rd.WITH_STATE}, {rd.DEGREE}, {rd._WEIGHT}, {rd.profile_sql('forecast')}, {rd.TURNS}, {ROUTES},
path AS (SELECT r.route, r.pos, r.edge, e.len, coalesce(t.turn_s, 0) AS turn_s FROM routes r JOIN edges e USING (edge) LEFT JOIN routes p ON p.route = r.route AND p.pos = r.pos - 1 LEFT JOIN turns t ON t.edge = p.edge AND t.next = r.edge),
fold(route, pos, t, var, metres) AS (SELECT DISTINCT route, 0::BIGINT, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM routes UNION ALL
 SELECT f.route, p.pos, f.t + p.len / (q.kph / 3.6) + q.delay_s + p.turn_s, f.var + pow((p.len / (q.kph / 3.6) + q.delay_s) * q.sigma, 2) * 1.6384, f.metres + p.len
 FROM fold f JOIN path p ON p.route = f.route AND p.pos = f.pos + 1 JOIN prof q ON q.edge = p.edge AND q.step = CAST(least(floor(f.t / 120.0), 45) AS INTEGER))
SELECT route, round(t, 4) AS mean_s, round(sqrt(var), 4) AS sd_s, round(metres, 4) AS metres FROM fold QUALIFY row_number() OVER (PARTITION BY route ORDER BY pos DESC) = 1""")
def evaluate_route(spark, sf_dir):
    packed, edges, turns = costs(spark, sf_dir)
    found = rt.evaluate_route(routes(spark, sf_dir), packed, edges, turns)
    return found.select("route", *[F.round(c, 4).alias(c) for c in ("mean_s", "sd_s", "metres")])


_CV = "(1 + pow(sd_s / mean_s, 2))"


@query(f"""{rd.WITH_STATE}, {rd.DEGREE}, {rd._WEIGHT}, {rd.profile_sql('forecast')}, {rd.TURNS}, {ROUTES},
path AS (SELECT r.route, r.pos, r.edge, e.len, coalesce(t.turn_s, 0) AS turn_s FROM routes r JOIN edges e USING (edge) LEFT JOIN routes p ON p.route = r.route AND p.pos = r.pos - 1 LEFT JOIN turns t ON t.edge = p.edge AND t.next = r.edge),
fold(route, wait, pos, t, var) AS (SELECT DISTINCT route, wait, 0::BIGINT, wait * 60.0::DOUBLE, 0.0::DOUBLE FROM routes, (SELECT unnest([0, 15, 30, 45, 60]) AS wait) UNION ALL
 SELECT f.route, f.wait, p.pos, f.t + p.len / (q.kph / 3.6) + q.delay_s + p.turn_s, f.var + pow((p.len / (q.kph / 3.6) + q.delay_s) * q.sigma, 2) * 1.6384
 FROM fold f JOIN path p ON p.route = f.route AND p.pos = f.pos + 1 JOIN prof q ON q.edge = p.edge AND q.step = CAST(least(floor(f.t / 120.0), 45) AS INTEGER)),
ends AS (SELECT route AS trip, wait, t - wait * 60 AS mean_s, sqrt(var) AS sd_s FROM fold QUALIFY row_number() OVER (PARTITION BY route, wait ORDER BY pos DESC) = 1),
costed AS (SELECT trip, wait, mean_s / sqrt{_CV} AS median_s, mean_s / sqrt{_CV} * exp(1.2815515655446004 * sqrt(ln{_CV})) AS p90_s FROM ends), {VERDICTS}""", "now_s now_p90_s")
def go_now_or_wait(spark, sf_dir):
    packed, edges, turns = costs(spark, sf_dir)
    return tr.go_now_or_wait(rt.costed_departures(routes(spark, sf_dir), save(packed, "profile"), edges, turns))


def asked(spark, sf_dir):
    """Orders as trip requests between nodes of the grid, and the trips that differ.

    (o_orderkey, trip) of all orders whose ends differ, and (trip, origin, dest, straight_m, depart_s, risk, turn_weight, taste): requests that are equal in all are one trip, the least order's.
    """
    n = rd.xy(b.nodes(spark, sf_dir)).select("node", "x", "y")
    count = n.agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("lo"))
    k = b.table(spark, sf_dir, "orders").crossJoin(F.broadcast(count))
    taste = F.col("o_custkey") % 3
    wishes = (((F.col("o_custkey") % 2) * 1500.0).alias("depart_s"), (taste * 1.25).alias("risk"), F.when(taste == 1, 0.5).otherwise(1.0).alias("turn_weight"), taste.alias("taste"))
    wished = k.select("o_orderkey", (F.col("lo") + F.col("o_custkey") % F.col("n")).alias("origin"), (F.col("lo") + F.col("o_custkey") * 31 % F.col("n")).alias("dest"), *wishes).where("origin <> dest")
    what = ("origin", "dest", "depart_s", "risk", "turn_weight", "taste")
    trips = wished.groupBy(*what).agg(F.min("o_orderkey").alias("trip"))
    met = trips.join(n.select(F.col("node").alias("origin"), F.col("x").alias("x1"), F.col("y").alias("y1")), "origin").join(n.select(F.col("node").alias("dest"), F.col("x").alias("x2"), F.col("y").alias("y2")), "dest")
    straight = F.sqrt(F.pow(F.col("x1") - F.col("x2"), 2) + F.pow(F.col("y1") - F.col("y2"), 2))
    return save(wished.join(trips, list(what)).select("o_orderkey", "trip"), "orders"), save(met.select("trip", *what, straight.alias("straight_m")), "asked")


def liking(edges):
    """(taste, edge, factor): tastes of road classes by customer, where they are not neutral."""
    tastes = edges.sparkSession.createDataFrame([(1, 0.5, 0.0, 0.2), (2, 0.0, 1.0, 0.0)], "user_id long, avoid_narrow double, prefer_arterial double, size_penalty double")
    users = tastes.withColumn("road_bias", F.create_map(F.lit("Row 2"), F.lit(0.9)))
    factors = rt.edge_preference(users.select("user_id").crossJoin(edges.select("edge")), edges, users).where("factor <> 1")
    return save(factors.withColumnRenamed("user_id", "taste"), "liking")


def to_orders(orders, found):
    return orders.join(found, "trip").drop("trip")


def profiles(spark, sf_dir, *kinds):
    """Packed profiles of one state, each written once."""
    edges, state = rd.weighted_edges(spark, sf_dir), save(rd.state(spark, sf_dir), "state")
    return [save(nc.pack(nc.forecast_profile(state, edges, kind=k)), "profile") for k in kinds]


def network(spark, sf_dir):
    edges = save(b.edges(spark, sf_dir), "edges")
    return edges, save(ro.turn_cost(edges), "turns")


@query()
def batch_shortest_paths(spark, sf_dir):
    edges, turns = network(spark, sf_dir)
    orders, trips = asked(spark, sf_dir)
    return to_orders(orders, rt.batch_shortest_paths(trips, *profiles(spark, sf_dir, "forecast"), edges, turns, likes=liking(edges)))


@query()
def alternative_routes(spark, sf_dir):
    edges, turns = network(spark, sf_dir)
    orders, trips = asked(spark, sf_dir)
    return to_orders(orders, rt.alternative_routes(trips, *profiles(spark, sf_dir, "forecast"), edges, turns, preference=liking(edges)))


@query()
def snapshot_baseline(spark, sf_dir):
    edges, turns = network(spark, sf_dir)
    orders, trips = asked(spark, sf_dir)
    return to_orders(orders, rt.snapshot_baseline(trips, *profiles(spark, sf_dir, "snapshot", "forecast"), edges, turns, preference=liking(edges)))


@query()
def congestion_detours(spark, sf_dir):
    """The grid of the smallest tables is a kilometre wide, so trips count from 300 m on, and detours from six seconds and 20 m on."""
    edges, turns = network(spark, sf_dir)
    orders, trips = asked(spark, sf_dir)
    return to_orders(orders, rt.congestion_detours(trips, *profiles(spark, sf_dir, "forecast", "free"), edges, turns, 300.0, 0.1, 0.02))


def measured(edges):
    sliced = edges.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(19))))
    return sliced.select("edge", "slice", F.greatest(F.lit(5.0), F.col("kph") * (0.5 + ((F.col("edge") + F.col("slice") * 7) % 10) / 20.0)).alias("kph"))


@query()
def backtest_routers(spark, sf_dir):
    kinds = ("forecast", "snapshot", "historical")
    edges, turns = network(spark, sf_dir)
    orders, trips = asked(spark, sf_dir)
    hot = b.incidents(spark, sf_dir).select(F.explode("edges").alias("edge"))
    packed = dict(zip(kinds, profiles(spark, sf_dir, *kinds), strict=True))
    return to_orders(orders, rt.backtest_routers(trips, packed, measured(edges), edges, turns, hot, preference=liking(edges)))


@query()
def leave_by(spark, sf_dir):
    packed, edges, turns = costs(spark, sf_dir)
    way = routes(spark, sf_dir)
    deadlines = way.groupBy("route").agg(F.count(F.lit(1)).alias("n")).select("route", F.lit(0.0).alias("now"), (F.col("n") * (20.0 + F.col("route") % 60)).alias("deadline"))
    return rt.leave_by(way, deadlines, packed, edges, turns)


_P90 = "ln(1 + pow(sd / actual_s, 2))"


@query(f"""WITH {b.TRIPS}, r AS (SELECT trip, CAST(o_orderkey % 3 AS INTEGER) AS place, actual_s, abs(promised_p90_s - actual_s) / 1.2816 AS sd, distance_m AS metres FROM trips),
m AS (SELECT *, actual_s / sqrt(1 + pow(sd / actual_s, 2)) AS mid, exp(-1.2815515655446004 * sqrt({_P90})) AS sure0, actual_s / sqrt(1 + pow(sd / actual_s, 2)) * exp(1.2815515655446004 * sqrt({_P90})) AS late FROM r),
n AS (SELECT *, least(greatest(mid / greatest(late, 1.0), 0.0), 1.0) AS sure FROM m),
f AS (SELECT trip, place, mid, sure, metres, first_value(mid) OVER w AS mid0, first_value(sure) OVER w AS s0, first_value(metres) OVER w AS m0 FROM n WINDOW w AS (PARTITION BY trip ORDER BY place)),
g AS (SELECT *, round((mid0 - mid) / greatest(mid0, 1.0), 9) AS faster, round((m0 - metres) / greatest(m0, 1.0), 9) AS shorter, round(sure - s0, 9) AS steadier FROM f)
SELECT trip, place, CASE WHEN place = 0 THEN 'Recommended' WHEN steadier > 0.025 AND faster > -0.18 THEN 'More predictable' WHEN faster > 0.03 THEN 'Quicker, less certain' WHEN shorter > 0.08 THEN 'Shorter, slower'
 WHEN metres > m0 * 1.08 THEN 'Wider roads' ELSE 'Alternative ' || place END AS label FROM g""")
def route_label(spark, sf_dir):
    sd = F.abs(F.col("promised_p90_s") - F.col("actual_s")) / 1.2816
    rows = b.trips(spark, sf_dir).select("trip", (F.col("o_orderkey") % 3).cast("int").alias("place"), F.col("actual_s").alias("mean_s"), sd.alias("sd_s"), F.col("distance_m").alias("metres"))
    return rt.route_label(rows).select("trip", "place", "label")


# the lines of an order as the stretches of a route
_VERBS = ("Continue onto", "Bear left onto", "Turn right onto", "Turn left onto", "Bear right onto", "Make a U-turn onto")
_STRETCHES = f"""stretches AS (SELECT l_orderkey AS route, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS run, 'Road ' || (l_partkey % 2) AS name,
 ({list(_VERBS)})[l_suppkey % {len(_VERBS)} + 1] AS verb, l_quantity * 10 AS metres, l_quantity * 1.5 AS seconds FROM lineitem)"""


@query(f"""WITH {_STRETCHES}, a AS (SELECT *, sum(CASE WHEN run = 1 OR metres >= 130 THEN 1 ELSE 0 END) OVER w AS g FROM stretches WINDOW w AS (PARTITION BY route ORDER BY run)),
b AS (SELECT route, g, arg_min(name, run) AS name, arg_min(verb, run) AS verb, sum(metres) AS metres, sum(seconds) AS seconds FROM a GROUP BY 1, 2),
c AS (SELECT *, coalesce(name = lag(name) OVER (PARTITION BY route ORDER BY g), false) AS same, verb LIKE 'Continue%' OR verb LIKE 'Bear%' AS soft FROM b),
d AS (SELECT route, g, name, CASE WHEN same AND NOT soft THEN replace(verb, ' onto', ' to stay on') ELSE verb END AS verb, metres, seconds, sum(CASE WHEN same AND soft THEN 0 ELSE 1 END) OVER (PARTITION BY route ORDER BY g) AS h FROM c),
e AS (SELECT route, h, arg_min(name, g) AS name, arg_min(verb, g) AS verb, sum(metres) AS metres, sum(seconds) AS seconds, count(*) OVER (PARTITION BY route) AS n FROM d GROUP BY 1, 2),
f AS (SELECT *, EXISTS (SELECT 1 FROM e x WHERE x.route = e.route AND x.h = 1 AND x.metres < 130 AND x.n > 1) AS tiny FROM e),
k AS (SELECT route, CAST(CASE WHEN tiny THEN greatest(h - 1, 1) ELSE h END AS INTEGER) AS step, arg_max(name, h) AS name, arg_max(verb, h) AS verb, sum(metres) AS metres, sum(seconds) AS seconds FROM f GROUP BY 1, 2)
SELECT route, step, CASE WHEN step = 1 AND verb LIKE '% onto' AND verb NOT LIKE 'Make%' THEN 'Start on' ELSE verb END || ' ' || name AS instruction, name, metres, seconds FROM k
UNION ALL SELECT route, max(step) + 1, 'Arrive at your destination', arg_max(name, step), 0.0, 0.0 FROM k GROUP BY route""", "metres seconds")
def compact_steps(spark, sf_dir):
    run = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    verb = F.element_at(F.array(*map(F.lit, _VERBS)), (F.col("l_suppkey") % len(_VERBS) + 1).cast("int"))
    road = F.concat(F.lit("Road "), (F.col("l_partkey") % 2).cast("string"))
    lines = dealt_by(b.table(spark, sf_dir, "lineitem"), "l_orderkey")
    rows = lines.select(F.col("l_orderkey").alias("route"), run.alias("run"), road.alias("name"), verb.alias("verb"), (F.col("l_quantity") * 10).alias("metres"), (F.col("l_quantity") * 1.5).alias("seconds"))
    return rt.compact_steps(rows).withColumn("step", F.col("step").cast("int"))


@query(f"""{rd.WITH_STATE}, {rd.DEGREE}, {rd._WEIGHT}, {rd.profile_sql('forecast')}, {ROUTES}, path AS (SELECT route, pos, edge, len, kph AS free FROM routes JOIN edges USING (edge)),
fold(route, pos, t, ratio) AS (SELECT DISTINCT route, 0::BIGINT, 0.0::DOUBLE, NULL::DOUBLE FROM routes UNION ALL SELECT f.route, p.pos, f.t + p.len / (q.kph / 3.6) + q.delay_s, q.kph / p.free
 FROM fold f JOIN path p ON p.route = f.route AND p.pos = f.pos + 1 JOIN prof q ON q.edge = p.edge AND q.step = CAST(least(floor(f.t / 120.0), 45) AS INTEGER)) SELECT route, pos, ratio FROM fold WHERE pos > 0""", "ratio")
def route_speed_ratios(spark, sf_dir):
    packed, edges, _ = costs(spark, sf_dir)
    return rt.route_speed_ratios(routes(spark, sf_dir), packed, edges).withColumn("pos", F.col("pos").cast("bigint"))


_MEASURED = "measured AS (SELECT edge, slice, greatest(5.0, kph * (0.5 + ((edge + slice * 7) % 10) / 20.0)) AS kph FROM edges, (SELECT CAST(unnest(range(20)) AS INTEGER) AS slice))"


@query(f"""{E.replace('WITH ', 'WITH RECURSIVE ', 1)}, {_MEASURED}, path AS (SELECT route, pos, edge, len FROM routes JOIN edges USING (edge)), fold(route, pos, t) AS (SELECT DISTINCT route, 0::BIGINT, 0.0::DOUBLE FROM routes UNION ALL
 SELECT f.route, p.pos, f.t + p.len / (q.kph / 3.6) FROM fold f JOIN path p ON p.route = f.route AND p.pos = f.pos + 1 JOIN measured q ON q.edge = p.edge AND q.slice = CAST(least(floor(f.t / 45.0), 19) AS INTEGER))
SELECT route, t AS seconds FROM fold QUALIFY row_number() OVER (PARTITION BY route ORDER BY pos DESC) = 1""", "seconds")
def replay_route(spark, sf_dir):
    edges = b.edges(spark, sf_dir)
    return rt.replay_route(routes(spark, sf_dir), measured(edges), edges)


@query(f"""{E}, {b.INCIDENTS}, {rd.EXY}, mid AS (SELECT edge, (x1 + x2) / 2 AS x, (y1 + y2) / 2 AS y FROM exy),
near AS (SELECT DISTINCT r.route, i.incident FROM incidents i JOIN mid a ON a.edge = i.edges[1], routes r JOIN mid m ON m.edge = r.edge WHERE (r.pos - 1) % 4 = 0 AND pow(a.x - m.x, 2) + pow(a.y - m.y, 2) <= 450 * 450)
SELECT route, incident FROM near n WHERE NOT EXISTS (SELECT 1 FROM incidents i JOIN routes r ON list_contains(i.edges, r.edge) WHERE i.incident = n.incident AND r.route = n.route)""")
def near_but_off_route(spark, sf_dir):
    mids = rd.xy_edges(spark, sf_dir).select("edge", ((F.col("x1") + F.col("x2")) / 2).alias("x"), ((F.col("y1") + F.col("y2")) / 2).alias("y"))
    return rt.near_but_off_route(routes(spark, sf_dir), b.incidents(spark, sf_dir), mids)
