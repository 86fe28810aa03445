"""Operators on routes: (route, pos, edge), in order of pos, and what they cost on a packed profile."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import traffic as tf
from ..storage import Rounds, save
from . import regions as rg
from .numbering import dealt_by, dense_ids
from .regions import STEP_S, STEPS

WIDEN = 1.28 * 1.28  # variance inflation
P90 = 1.2815515655446004
# Fixed values of alternatives: what a used edge costs more, the likeness from which a route is none, and how many are tried
DIVERSE, ALIKE, TRIES = 1.7, 0.72, 3
#: Seconds of a slice of measured speeds.
SLICE_S = 45.0
# Minutes of waiting that are compared with leaving now.
WAITS_MIN = (0, 15, 30, 45, 60)


def _paths(routes: DataFrame, packed: DataFrame, edges: DataFrame, turns: DataFrame) -> DataFrame:
    """(route, path): a route's edges in order, each with its length, the turn into it and its whole profile; routes are short arrays."""
    w = Window.partitionBy("route").orderBy("pos")
    pairs = routes.withColumn("before", F.lag("edge").over(w))
    met = pairs.join(packed, "edge").join(edges.select("edge", "len"), "edge").join(turns.select(F.col("edge").alias("before"), F.col("next").alias("edge"), "turn_s"), ["before", "edge"], "left")
    return met.groupBy("route").agg(F.array_sort(F.collect_list(F.struct("pos", "len", F.coalesce("turn_s", F.lit(0.0)).alias("turn_s"), "steps"))).alias("path"))


def _driven(path: Column, depart: Column) -> Column:
    """What a path costs from a departure on: (t, mean, var, metres). The clock advances edge by edge; speeds are those of the step it has reached."""

    def advance(a: Column, e: Column) -> Column:
        step = F.least(F.greatest(F.floor(a["t"] / STEP_S), F.lit(0)), F.lit(STEPS - 1)).cast("int")
        now = F.get(e["steps"], step)
        drive = e["len"] / (now["kph"] / 3.6)
        seconds = drive + now["delay_s"] + e["turn_s"]
        return F.struct((a["t"] + seconds).alias("t"), (a["mean"] + seconds).alias("mean"), (a["var"] + F.pow((drive + now["delay_s"]) * now["sigma"], 2) * WIDEN).alias("var"), (a["metres"] + e["len"]).alias("metres"))

    zero = F.struct(depart.cast("double").alias("t"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("var"), F.lit(0.0).alias("metres"))
    return F.aggregate(path, zero, advance)


def evaluate_route(routes: DataFrame, packed: DataFrame, edges: DataFrame, turns: DataFrame, depart: float = 0.0, asked: DataFrame | None = None) -> DataFrame:
    """(route, mean_s, sd_s, metres) of routes that start ``depart`` seconds into the profile, or as (route, depart_s, turn_weight) ``asked`` says."""
    folded = _paths(routes, packed, edges, turns)
    if asked is None:
        folded = folded.withColumn("r", _driven(F.col("path"), F.lit(depart)))
    else:
        weighed = F.transform("path", lambda e: e.withField("turn_s", e["turn_s"] * F.col("turn_weight")))
        folded = folded.join(asked.select("route", "depart_s", "turn_weight"), "route").withColumn("path", weighed).withColumn("r", _driven(F.col("path"), F.col("depart_s")))
    return folded.select("route", F.col("r.mean").alias("mean_s"), F.sqrt("r.var").alias("sd_s"), F.col("r.metres").alias("metres"))


def costed_departures(routes: DataFrame, packed: DataFrame, edges: DataFrame, turns: DataFrame, waits: tuple[int, ...] = WAITS_MIN) -> DataFrame:
    """(trip, wait, median_s, p90_s) of fixed routes costed at each departure, all in one fold; for ``trips.go_now_or_wait``."""
    each = F.explode(F.array(*map(F.lit, waits)))
    rows = routes.withColumn("wait", each).select(F.struct("route", "wait").alias("route"), "pos", "edge")
    asked = routes.select("route").distinct().withColumn("wait", each).select(F.struct("route", "wait").alias("route"), (F.col("wait") * 60.0).alias("depart_s"), F.lit(1.0).alias("turn_weight"))
    found = evaluate_route(rows, packed, edges, turns, asked=asked)
    return found.select(F.col("route.route").alias("trip"), "route.wait", *_median_p90())


def _median_p90() -> tuple[Column, Column]:
    return tuple(tf.eta_percentile(F.col("mean_s"), F.col("sd_s"), z).alias(n) for z, n in ((0.0, "median_s"), (P90, "p90_s")))


def planned_departures(trips: DataFrame, packed: DataFrame, edges: DataFrame, turns: DataFrame, waits: tuple[int, ...] = WAITS_MIN, preference: DataFrame | None = None) -> DataFrame:
    """(trip, wait, median_s, p90_s) of trips that are planned anew at each departure; one solve of all trips and departures."""
    each = as_asked(trips).withColumn("wait", F.explode(F.array(*map(F.lit, waits))))
    each = save(each.withColumns({"trip": F.struct("trip", "wait"), "depart_s": F.col("depart_s") + F.col("wait") * 60}).drop("wait"), "departures")
    likes = None if preference is None else preference.withColumn("wait", F.explode(F.array(*map(F.lit, waits)))).select(F.struct("trip", "wait").alias("trip"), "edge", "factor")
    path = along(batch_shortest_paths(each, packed, edges, turns, penalty=likes))
    found = evaluate_route(path, packed, edges, turns, asked=_routes_asked(each))
    return found.select("route.trip", "route.wait", *_median_p90())


def leave_by_planned(trips: DataFrame, packed: DataFrame, edges: DataFrame, turns: DataFrame, z: float = P90, probes: int = 9, preference: DataFrame | None = None) -> DataFrame:
    """(trip, depart_s) of trips with ``now`` and ``deadline``: the latest departure found at which the trip, planned anew, arrives in time at the percentile; null where none is.

    Bisection of all trips at once: each probe is one solve. A trip without a way has no departure.
    """
    whole = as_asked(trips).join(trips.select("trip", F.col("now").cast("double").alias("lo"), F.col("deadline").cast("double").alias("hi"), F.col("deadline").cast("double").alias("deadline")), "trip")
    state = save(whole.drop("depart_s").withColumn("best", F.lit(None).cast("double")), "probes")
    for _ in range(probes):
        tried = state.withColumn("depart_s", (F.col("lo") + F.col("hi")) / 2)
        path = along(batch_shortest_paths(tried, packed, edges, turns, penalty=preference))
        found = evaluate_route(path, packed, edges, turns, asked=_routes_asked(tried)).select(F.col("route").alias("trip"), tf.eta_percentile(F.col("mean_s"), F.col("sd_s"), z).alias("took"))
        met = tried.join(found, "trip").withColumn("meets", F.col("depart_s") + F.col("took") <= F.col("deadline"))
        pick = lambda yes, no: F.when(F.col("meets"), F.col(yes)).otherwise(F.col(no))
        state = save(met.select("trip", "origin", "dest", "risk", "turn_weight", "deadline", pick("depart_s", "lo").alias("lo"), pick("hi", "depart_s").alias("hi"), pick("depart_s", "best").alias("best")), "probes")
    return trips.select("trip").join(state.select("trip", F.col("best").alias("depart_s")), "trip", "left")


def leave_by(routes: DataFrame, deadlines: DataFrame, packed: DataFrame, edges: DataFrame, turns: DataFrame, z: float = P90, probes: int = 9) -> DataFrame:
    """(route, depart_s) for (route, now, deadline): the latest departure found whose percentile of arrival meets the deadline; null where none does.

    Bisection on a fixed route, folded in one expression: probes cost no shuffle.
    """

    def probe(a: Column, _: Column) -> Column:
        mid = (a["lo"] + a["hi"]) / 2
        arrives = F.transform(F.array(_driven(F.col("path"), mid)), lambda r: mid + tf.eta_percentile(r["mean"], F.sqrt(r["var"]), z))
        part = lambda meets: F.struct(F.when(meets, mid).otherwise(a["lo"]).alias("lo"), F.when(meets, a["hi"]).otherwise(mid).alias("hi"), F.when(meets, mid).otherwise(a["best"]).alias("best"))
        return F.get(F.transform(F.transform(arrives, lambda x: x <= F.col("deadline")), part), F.lit(0))

    start = F.struct(F.col("now").cast("double").alias("lo"), F.col("deadline").cast("double").alias("hi"), F.lit(None).cast("double").alias("best"))
    rows = _paths(routes, packed, edges, turns).join(deadlines.select("route", "now", "deadline"), "route")
    return rows.select("route", F.aggregate(F.sequence(F.lit(1), F.lit(probes)), start, probe)["best"].alias("depart_s"))


def route_overlap(sets: DataFrame) -> DataFrame:
    """(a, b, overlap) of pairs of edge sets: shared over all."""
    return sets.select("a", "b", (F.size(F.array_intersect("edges_a", "edges_b")) / F.size(F.array_union("edges_a", "edges_b"))).alias("overlap"))


def main_roads(routes: DataFrame, edges: DataFrame, most: int = 4) -> DataFrame:
    """(route, name, metres, place): the roads that carry most of a route."""
    carried = routes.join(edges.select("edge", "name", "len"), "edge").groupBy("route", "name").agg(F.round(F.sum("len"), 2).alias("metres"))
    place = F.row_number().over(Window.partitionBy("route").orderBy(F.desc("metres"), "name"))
    return carried.withColumn("place", place).where(F.col("place") <= most)


def _runs(rows: DataFrame, value: str) -> DataFrame:
    w = Window.partitionBy("route").orderBy("pos")
    changed = F.coalesce((F.col(value) != F.lag(value).over(w)).cast("int"), F.lit(0))
    return rows.withColumn("changed", changed).withColumn("run", F.sum("changed").over(w))


def traffic_runs(routes: DataFrame, state: DataFrame, edges: DataFrame) -> DataFrame:
    """(route, run, level, edges, metres): stretches of equal traffic level."""
    ratio = F.round(F.col("now") / F.col("kph"), 6)
    met = routes.join(state.select("edge", F.col("kph").alias("now")), "edge").join(edges.select("edge", "kph", "len"), "edge").withColumn("level", tf.traffic_level(ratio))
    return _runs(met, "level").groupBy("route", "run").agg(F.first("level").alias("level"), F.count(F.lit(1)).alias("edges"), F.sum("len").alias("metres"))


def direction_steps(routes: DataFrame, edges: DataFrame) -> DataFrame:
    """(route, run, name, verb, metres, seconds): stretches of one road name, the turn into each, and the time at the edges' kph.

    A road without a name goes by its class. The instruction is verb and name.
    """
    w = Window.partitionBy("route").orderBy("pos")
    bearing = tf.bearing_deg(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))
    named = F.when(F.coalesce("name", F.lit("")) != "", F.col("name")).otherwise(F.concat(F.translate("hw", "_", " "), F.lit(" road")))
    met = routes.join(edges.select("edge", named.alias("name"), "len", (F.col("len") / (F.col("kph") / 3.6)).alias("s"), bearing.alias("bearing")), "edge")
    delta = F.round(F.pmod(F.col("bearing") - F.lag("bearing").over(w) + 180, F.lit(360.0)) - 180, 4)
    run = _runs(met.withColumn("delta", delta), "name")
    side = F.when(F.col("d") > 0, "right").otherwise("left")
    turn = F.when(F.abs("d") < 20, "Continue onto").when(F.abs("d") > 150, "Make a U-turn onto").otherwise(F.concat(F.when(F.abs("d") > 70, "Turn ").otherwise("Bear "), side, F.lit(" onto")))
    grouped = run.groupBy("route", "run").agg(F.first("name").alias("name"), F.min_by("delta", "pos").alias("d"), F.sum("len").alias("metres"), F.sum("s").alias("seconds"))
    return grouped.select("route", "run", "name", F.when((F.col("run") == 0) | F.col("d").isNull(), "Head out on").otherwise(turn).alias("verb"), "metres", "seconds")


def route_geometry(routes: DataFrame, edges: DataFrame) -> DataFrame:
    """(route, points): the line of a route, each joint once."""
    met = routes.join(edges.select("edge", "u", "v"), "edge")
    return met.groupBy("route").agg(F.array_sort(F.collect_list(F.struct("pos", "u", "v"))).alias("p")).select("route", F.concat(F.slice(F.transform("p", lambda x: x["u"]), 1, 1), F.transform("p", lambda x: x["v"])).alias("points"))


def live_share(routes: DataFrame, state: DataFrame, edges: DataFrame) -> DataFrame:
    """(route, informed, sure, observed): shares of the way with support over .02 and .20, and edges seen."""
    met = routes.join(state.select("edge", "support", "observed"), "edge").join(edges.select("edge", "len"), "edge")
    part = lambda x: F.sum(F.when(F.col("support") > x, F.col("len")).otherwise(0.0)) / F.sum("len")
    return met.groupBy("route").agg(part(0.02).alias("informed"), part(0.20).alias("sure"), F.sum(F.col("observed").cast("int")).cast("bigint").alias("observed"))


def sensors_on_route(routes: DataFrame, watch: DataFrame, most: int = 3) -> DataFrame:
    """(route, camera_id, place): the first sensors along a route."""
    met = routes.join(watch.select("camera_id", "edge"), "edge")
    place = F.row_number().over(Window.partitionBy("route").orderBy("pos", "camera_id"))
    return met.withColumn("place", place).where(F.col("place") <= most).select("route", "camera_id", "place")


def edge_preference(asked: DataFrame, edges: DataFrame, users: DataFrame) -> DataFrame:
    """(user_id, edge, factor) of the edges asked for (user_id, edge): taste for main roads, dislike of narrow ones, the vehicle's bulk, and learned bias by road name."""
    narrow = F.when(F.col("rank") >= 6, 1 + 0.85 * F.col("avoid_narrow")).otherwise(1.0)
    main = F.when(F.col("rank") <= 3, 1 - 0.18 * F.col("prefer_arterial")).otherwise(1.0)
    bulk = F.when(F.col("rank") >= 7, 1 + F.col("size_penalty")).otherwise(1.0)
    bias = F.coalesce(F.try_element_at("road_bias", F.col("name")), F.lit(1.0))
    met = asked.join(edges.select("edge", "rank", "name"), "edge").join(users, "user_id")
    return met.select("user_id", "edge", (narrow * main * bulk * bias).alias("factor"))


# Fixed values of learning: a road's bias at first, its least and greatest; risk aversion at first, least and greatest, and its moves by a vote up or down
BIAS, RISK, RISK_MOVES = (1.0, 0.6, 1.8), (0.8, 0.0, 2.5), (-0.04, 0.12)
#: Biases are kept to three decimals, so a road's bias has so many states and a stretch of votes is a table from each to the one it leads to.
_STATES = np.arange(round(BIAS[1] * 1000), round(BIAS[2] * 1000) + 1)


def _moved(now: np.ndarray, move: float) -> np.ndarray:
    """Biases in thousandths after a vote: clipped, and kept as they were where they hardly move."""
    old = now / 1000
    new = np.clip(old + move, BIAS[1], BIAS[2])
    return np.where(np.abs(new - old) > 1e-3, np.floor(np.round(new * 1000, 9) + 0.5).astype(now.dtype), now)


def _stretches(batches: Iterator[pa.RecordBatch], keys: int, start: Callable, step: Callable) -> Iterator[tuple[tuple, object, bool]]:
    """(key, state, whole) of each run of equal keys in sorted rows: ``step`` folds what follows the keys. The first and the last run may go on in other partitions."""
    rows = itertools.chain.from_iterable(zip(*(c.to_pylist() for c in b.columns), strict=True) for b in batches)
    held = None
    for number, (key, votes) in enumerate(itertools.groupby(rows, key=lambda r: r[:keys])):
        if held is not None:
            yield held
        state = start()
        for vote in votes:
            state = step(state, *vote[keys:])
        held = key, state, number > 0
    if held is not None:
        yield held[0], held[1], False


def _learned_bias(feedback: DataFrame, strength: float) -> DataFrame:
    """(user_id, name, bias) by stretches of votes in order: a range of all votes a task, whoever's they are."""

    def tables(batches):
        step = lambda table, _, share, up: _moved(table, (-4 if up else 4) * strength * (share or 0.0))
        for (user, name), table, whole in _stretches(batches, 2, _STATES.copy, step):
            value = None if whole is False else int(table[round(BIAS[0] * 1000) - _STATES[0]])
            yield pa.RecordBatch.from_arrays([pa.array([user], kind), pa.array([name], pa.string()), pa.array([TaskContext.get().partitionId()]), pa.array([value], pa.int64()), pa.array([None if whole else table.astype("<i2").tobytes()], pa.binary())], names)

    def joined(batches):
        for b in batches:
            out = []
            for parts in b.column(2).to_pylist():
                now = round(BIAS[0] * 1000)
                for part in parts:
                    now = int(np.frombuffer(part["states"], "<i2")[now - _STATES[0]])
                out.append(now)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.int64())], ["user_id", "name", "value"])

    names = ["user_id", "name", "part", "value", "states"]
    user = feedback.schema["user_id"].dataType
    kind = to_arrow_type(user)
    order = ("user_id", "name", "seq")
    placed = feedback.select(*order, F.col("share").cast("double").alias("share"), "up").repartitionByRange(*order).sortWithinPartitions(*order)
    found = save(placed.mapInArrow(tables, f"user_id {user.simpleString()}, name string, part long, value long, states binary"), "votes")
    # a user's road has one stretch a partition at most
    several = found.where("value is null").groupBy("user_id", "name").agg(F.array_sort(F.collect_list(F.struct("part", "states"))).alias("parts"))
    whole = found.where("value is not null").select("user_id", "name", "value").unionByName(several.mapInArrow(joined, f"user_id {user.simpleString()}, name string, value long"))
    return whole.select("user_id", "name", (F.col("value") / 1000).alias("bias"))


def _learned_risk(feedback: DataFrame) -> DataFrame:
    """(user_id, risk, trips): a stretch of votes shifts risk aversion and clips it, which is one shift between two bounds again."""

    def shifts(batches):
        def step(state, _, up):
            move = RISK_MOVES[0] if up else RISK_MOVES[1]
            clip = lambda x: min(max(x + move, RISK[1]), RISK[2])
            return state[0] + move, clip(state[1]), clip(state[2]), state[3] + 1

        for (user,), state, _ in _stretches(batches, 1, lambda: (0.0, -math.inf, math.inf, 0), step):
            yield pa.RecordBatch.from_arrays([pa.array([user], kind), pa.array([TaskContext.get().partitionId()]), *(pa.array([x]) for x in state)], names)

    names = ["user_id", "part", "shift", "lo", "hi", "n"]
    user = feedback.schema["user_id"].dataType
    kind = to_arrow_type(user)
    votes = feedback.select("user_id", "seq", "up").distinct().repartitionByRange("user_id", "seq").sortWithinPartitions("user_id", "seq")
    found = save(votes.mapInArrow(shifts, f"user_id {user.simpleString()}, part long, shift double, lo double, hi double, n long"), "votes")
    parts = found.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("part", "shift", "lo", "hi"))).alias("parts"), F.sum("n").cast("int").alias("trips"))
    risk = F.aggregate("parts", F.lit(RISK[0]), lambda now, p: F.least(F.greatest(now + p["shift"], p["lo"]), p["hi"]))
    return parts.select("user_id", risk.alias("risk"), "trips")


def learn_feedback(feedback: DataFrame, strength: float = 0.08) -> DataFrame:
    """(user_id, name, bias, risk, trips) from votes (user_id, seq, name, share, up): ``share`` of the way that the vote's route had on road ``name``.

    A road's bias moves with its share, risk aversion with each vote; each step clips. Votes are range-partitioned in order, a task folds its
    stretches, and a user's stretches are composed in order, so a user with a third of all votes is dealt over many tasks.
    """
    return _learned_bias(feedback, strength).join(_learned_risk(feedback), "user_id")


def as_asked(trips: DataFrame, *more: str) -> DataFrame:
    """(trip, origin, dest, depart_s, risk, turn_weight) of trips that may lack the last three: seconds into the profile (0), what a second of deviation costs (0), and the weight of turns (1)."""
    given = {"depart_s": 0.0, "risk": 0.0, "turn_weight": 1.0}
    return trips.select("trip", "origin", "dest", *(F.coalesce(F.col(c).cast("double"), F.lit(x)).alias(c) if c in trips.columns else F.lit(x).alias(c) for c, x in given.items()), *more)


#: Nodes whose edges make a region, and those whose edges travel together in one row.
REGION_NODES, BLOCK_NODES = 65_536, 1024


class Network(NamedTuple):
    """A road network on one profile, cut into regions: (edge, region), (edge, to) of edges and the other regions that they lead to, (region, block) of edges packed, and how many regions."""

    placed: DataFrame
    feeds: DataFrame
    blocks: DataFrame
    regions: int


def network(packed: DataFrame, edges: DataFrame, turns: DataFrame, likes: DataFrame | None = None, region_nodes: int = REGION_NODES) -> Network:
    """Edges with region, profile, turns into them and tastes (taste, edge, factor). Regions are ranges of tails, and a task holds one region at a time."""
    road = edges.select("edge", "u", "v", "len").join(packed, "edge")
    no = F.col("no")
    number = dense_ids(road.select("u").distinct(), ("u",), "no").select("u", F.floor(no / region_nodes).alias("region"), F.floor(no / min(BLOCK_NODES, region_nodes)).alias("block"))
    road = save(road.join(number, "u"), "roads")
    pairs = turns.select(F.col("edge").alias("via"), F.col("next").alias("edge"), "turn_s").join(road.select("edge", "region"), "edge").join(road.select(F.col("edge").alias("via"), F.col("region").alias("came")), "via")
    pairs = save(pairs, "turns")
    feeds = save(pairs.where("region <> came").select(F.col("via").alias("edge"), F.col("region").alias("to")).distinct(), "feeds")
    into = pairs.groupBy("edge").agg(F.collect_list(F.struct("via", "turn_s")).alias("into"))
    graph = road.join(into, "edge", "left").join(feeds.select("edge", F.lit(1).cast("long").alias("out")).distinct(), "edge", "left")
    if likes is None:
        graph = graph.withColumn("likes", F.array().cast("array<struct<taste:long,factor:double>>"))
    else:
        liked = likes.groupBy("edge").agg(F.collect_list(F.struct(F.col("taste").cast("long").alias("taste"), F.col("factor").cast("double").alias("factor"))).alias("likes"))
        graph = graph.join(liked, "edge", "left")
    parts = 2 * edges.sparkSession.sparkContext.defaultParallelism
    rows = graph.select("region", "block", "edge", "u", "v", "len", "out", "steps", F.col("into").cast("array<struct<via:long,turn_s:double>>").alias("into"), "likes")
    blocks = save(rows.repartition(parts, "region", "block").sortWithinPartitions("region", "block", "edge").mapInArrow(rg.blocks, rg.BLOCKS), "network")
    return Network(road.select("edge", "region"), feeds, blocks, road.agg(F.coalesce(F.max("region") + 1, F.lit(1))).first()[0])


def _wide(kind: int, rows: DataFrame, **given: str) -> DataFrame:
    """Rows of one kind in the columns that a task reads."""
    fields = [x.split(" ", 1) for x in rg.COLUMNS.split(", ")]
    made = {"kind": F.lit(kind)} | {k: F.col(v) for k, v in {"cell": "cell", "tid": "tid", **given}.items()}
    return rows.select(*[made.get(n, F.lit(None)).cast(t).alias(n) for n, t in fields])


def _dealt(net: Network, here: DataFrame, rows: list[DataFrame], deal: int) -> DataFrame:
    """Rows by cell, each cell's blocks first; ``here`` has the cells (region, cell) that are there. A cell is a part of the trips of a region, so that a region's trips spread over tasks."""
    cells = F.broadcast(here.select("region", "cell").distinct())
    whole = reduce(DataFrame.unionByName, [_wide(rg.BLOCK, net.blocks.join(cells, "region").withColumn("tid", F.lit(-1)), block="block"), *rows])
    parts = min(4 * here.sparkSession.sparkContext.defaultParallelism, net.regions * deal)
    return whole.repartitionById(parts, F.pmod("cell", F.lit(parts)).cast("int")).sortWithinPartitions("cell", "tid", "kind", "edge")


def _cell(net: Network, spark: SparkSession) -> tuple[Column, int]:
    """The cell of a trip (tid) in a region, and how many cells a region has: more than one where regions are few."""
    deal = -(-2 * spark.sparkContext.defaultParallelism // net.regions)
    return F.col("region") * deal + F.pmod(F.xxhash64("tid"), F.lit(deal)), deal


def batch_shortest_paths(
    trips: DataFrame, packed: DataFrame, edges: DataFrame, turns: DataFrame, most_rounds: int = 10_000, penalty: DataFrame | None = None, likes: DataFrame | None = None, region_nodes: int = REGION_NODES,
    net: Network | None = None, used: DataFrame | None = None,
) -> DataFrame:
    """(trip, cost_s, mean_s, sd_s, edges) of many trips at once, on time-dependent profiles; each trip with its own departure, risk aversion and weight of turns (see ``as_asked``).

    A leg's mean is its drive and delay at the step that the clock has reached, times ``penalty`` (trip, edge, factor), ``likes`` (taste, edge, factor; trips have a
    ``taste``) and DIVERSE for each time that an edge is in ``used`` (trip, edges) where there are any; its deviation is drive and delay times sigma. Cost grows by mean, turn and risk
    times deviation, the clock by mean and turn alone. ``mean_s`` and ``sd_s`` are those of the search, penalties counted in. ``net`` is the profile's ``network`` with
    ``likes``, where several solves share it. The result is a written table.

    The network is cut into regions of ``region_nodes`` tails, and a task labels some trips inside one region as Dijkstra's algorithm does, given the labels of edges that lead there. Where
    one region holds the network, that is all. Where there are more, labels of edges that leave a region, or end a trip, go into the table of a round. A label is computed from all its predecessors
    as they are: a changed clock may make it dearer, too. Regions that a label has changed for are labelled anew, unless the trip has an end that costs no more: what is cheaper than
    every change still to come stays. Costs grow along a path, so what stands still is what Dijkstra's algorithm settles. Paths are walked back over regions by doubling, then
    inside all their regions at once.
    """
    spark = trips.sparkSession
    taste = F.col("taste").cast("long") if "taste" in trips.columns else F.lit(None).cast("long")
    asked = save(as_asked(trips.withColumn("taste", taste), "taste").withColumn("tid", F.monotonically_increasing_id()), "asked")
    net = net or network(packed, edges, turns, likes, region_nodes)
    feeds, placed = net.feeds, net.placed
    dearer = []
    if penalty is not None:
        dearer.append(penalty.join(asked.select("trip", "tid"), "trip").groupBy("tid", "factor").agg(F.collect_list("edge").alias("edges")).select("tid", "edges", "factor"))
    if used is not None:
        dearer.append(used.join(asked.select("trip", "tid"), "trip").select("tid", "edges", F.lit(DIVERSE).alias("factor")))
    if dearer and net.regions > 1:
        dearer = [save(x, "penalties") for x in dearer]
    cell, deal = _cell(net, spark)
    starts = asked.join(edges.join(placed, "edge").select(F.col("u").alias("origin"), "region").distinct(), "origin").select("tid", "region")

    def solved(touched: DataFrame, kind: str, schema: str, state: DataFrame | None = None, walk: DataFrame | None = None) -> DataFrame:
        here = save(touched.withColumn("cell", cell), "touched")
        rows = [_wide(rg.TRIP, here.join(asked, "tid"), n1="origin", n2="dest", n3="taste", x="depart_s", y="risk", z="turn_weight")]
        if state is not None:
            reaching = state.where(F.col("out") & (F.col("cost") < math.inf))
            rows.append(_wide(rg.BEFORE, reaching.join(feeds, "edge").withColumnRenamed("to", "region").join(here, ["tid", "region"]), edge="edge", x="cost", y="clock", z="var"))
        for dear in dearer:
            rows.append(_wide(rg.PENALTY, dear.join(here, "tid"), edges="edges", x="factor"))
        if walk is not None:
            rows.append(_wide(rg.WALK, walk.join(here, ["tid", "region"]), edge="edge", n1="back"))
        return _dealt(net, here, rows, deal).mapInArrow(rg.solve(kind), schema)

    told = ("trip", F.col("cost").alias("cost_s"), (F.col("clock") - F.col("depart_s")).alias("mean_s"), F.sqrt(F.col("var") * WIDEN).alias("sd_s"))
    if net.regions == 1:
        return save(solved(starts, "found", rg.FOUND).join(asked, "tid").select(*told, "edges"), "solved")
    rounds, state, touched = Rounds(spark, "labels"), None, starts
    for _ in range(most_rounds):
        new = solved(touched, "ends", rg.LABELS, state)
        if state is None:
            state = rounds.put(new.where(F.col("cost") < math.inf).withColumn("pending", F.col("cost")))
        else:
            now = F.struct("cost", "clock", "var", "entry", "out", "end")
            met = marked.select("tid", "edge", now.alias("old"), F.when(~F.col("due"), F.col("pending")).alias("kept")).join(new.select("tid", "edge", now.alias("new")), ["tid", "edge"], "full")
            # infinite: an edge that nothing settled has reached, or none does any more
            met = met.where(F.col("old").isNotNull() | (F.col("new.cost") < math.inf))
            same = F.col("new").isNull() | F.coalesce((F.col("new.cost") == F.col("old.cost")) & (F.col("new.clock") == F.col("old.clock")) & (F.col("new.var") == F.col("old.var")), F.lit(False))
            # the least value that neighbours have used or will use
            pending = F.least("kept", F.when(~same, F.least("old.cost", "new.cost")))
            state = rounds.put(met.withColumn("is", F.coalesce("new", "old")).select("tid", "edge", "is.*", pending.alias("pending")))
        reached = state.where(F.col("end") & (F.col("cost") < math.inf)).groupBy("tid").agg(F.min("cost").alias("least"))
        due = F.coalesce(F.col("out") & F.col("pending").isNotNull() & (F.col("least").isNull() | (F.col("pending") < F.col("least"))), F.lit(False))
        marked = state.join(reached, "tid", "left").withColumn("due", due)
        touched = save(marked.where("due").join(feeds, "edge").select("tid", F.col("to").alias("region")).distinct(), "due")
        if touched.isEmpty():
            break
    else:
        raise RuntimeError(f"labels still change after {most_rounds} rounds")
    state = state.where(F.col("cost") < math.inf)
    best = state.where("end").groupBy("tid").agg(F.min(F.struct("cost", "edge", "clock", "var")).alias("b"))
    best = save(best.select("tid", "b.*").join(asked.select("tid", "trip", "depart_s"), "tid").select("tid", "edge", *told), "ends")
    found, hop = best.select("tid", "edge", F.lit(0).cast("long").alias("back")), 1
    jump = state.where("entry >= 0").select("tid", "edge", F.col("entry").alias("via"))
    walked, jumps = Rounds(spark, "walked"), Rounds(spark, "jumps")
    while True:
        farther = found.join(jump, ["tid", "edge"]).select("tid", F.col("via").alias("edge"), (F.col("back") + hop).alias("back"), F.lit(True).alias("farther"))
        whole = walked.put(found.withColumn("farther", F.lit(False)).unionByName(farther))
        found = whole.drop("farther")
        if whole.where("farther").isEmpty():
            break
        jump = jumps.put(jump.join(jump.select("tid", F.col("edge").alias("via"), F.col("via").alias("to")), ["tid", "via"]).select("tid", "edge", F.col("to").alias("via")))
        hop *= 2
    legs = found.join(placed, "edge")
    pieces = solved(legs.select("tid", "region").distinct(), "walked", rg.WALKED, state, legs)
    paths = pieces.groupBy("tid").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("back")).alias("at"), "edges"))), lambda x: x["edges"])).alias("edges"))
    return save(best.drop("edge").join(paths, "tid").select("trip", "cost_s", "mean_s", "sd_s", "edges"), "solved")


def driven(solved: DataFrame, asked: DataFrame, nets: dict[str, tuple[Network, float]]) -> DataFrame:
    """(trip, network, seconds, mean_s, sd_s, metres): what solved paths (trip, edges) cost on each named network with steps of so many seconds, from (trip, depart_s, turn_weight) on.

    As ``evaluate_route`` and ``replay_route`` have it, for paths of any length: a task drives many paths side by side through one region, each to the region's end; then the rest goes on in the next.
    """
    spark = solved.sparkSession
    paths = save(solved.select("trip", "edges").join(asked.select("trip", "depart_s", "turn_weight"), "trip").withColumn("tid", F.monotonically_increasing_id()), "paths")
    zero = {c: F.lit(0.0) for c in ("mean", "var", "metres")}
    told = None
    for name, (net, step_s) in nets.items():
        cell, deal = _cell(net, spark)
        state = paths.select("tid", F.lit(0).cast("long").alias("at"), F.col("depart_s").alias("clock")).withColumns(zero)
        done, rest = None, state.join(paths.select("tid", "edges", "turn_weight"), "tid") if net.regions > 1 else paths.withColumns({"at": F.lit(0).cast("long"), "clock": F.col("depart_s"), **zero})
        while True:
            if net.regions > 1:
                here = rest.withColumn("edge", F.get("edges", F.col("at").cast("int"))).join(net.placed, "edge").withColumn("cell", cell)
                cells = save(here.select("region", "cell").distinct(), "cells")
            else:
                here = rest.withColumn("region", F.lit(0).cast("long")).withColumn("cell", cell)
                cells = spark.range(deal).select(F.lit(0).cast("long").alias("region"), F.col("id").alias("cell"))
            rows = [_wide(rg.TRIP, here, n1="at", x="clock", y="mean", z="var", w="turn_weight", m="metres", edges="edges")]
            now = save(_dealt(net, cells, rows, deal).mapInArrow(rg.drive(step_s, WIDEN), rg.DRIVEN), "driven")
            if net.regions > 1:
                met = now.join(paths.select("tid", "edges", "turn_weight"), "tid")
                rest = met.where(F.col("at") < F.size("edges"))
                now = met.where(F.col("at") >= F.size("edges")).select(*now.columns)
            done = now if done is None else done.unionByName(now)
            if net.regions == 1 or rest.isEmpty():
                break
        part = done.join(paths.select("tid", "trip", "depart_s"), "tid").select("trip", F.lit(name).alias("network"), (F.col("clock") - F.col("depart_s")).alias("seconds"), F.col("mean").alias("mean_s"), F.sqrt("var").alias("sd_s"), "metres")
        told = part if told is None else told.unionByName(part)
    return told


def route_speed_ratios(routes: DataFrame, packed: DataFrame, edges: DataFrame) -> DataFrame:
    """(route, pos, ratio): speed over free flow at the moment each edge is reached, turns left out."""
    met = routes.join(packed, "edge").join(edges.select("edge", "len", F.col("kph").alias("free")), "edge")
    rows = met.groupBy("route").agg(F.array_sort(F.collect_list(F.struct("pos", "len", "free", "steps"))).alias("path"))

    def advance(a: Column, e: Column) -> Column:
        now = F.get(e["steps"], F.least(F.floor(a["t"] / STEP_S), F.lit(STEPS - 1)).cast("int"))
        return F.struct((a["t"] + e["len"] / (now["kph"] / 3.6) + now["delay_s"]).alias("t"), F.concat(a["out"], F.array(F.struct(e["pos"].alias("pos"), (now["kph"] / e["free"]).alias("ratio")))).alias("out"))

    zero = F.struct(F.lit(0.0).alias("t"), F.array().cast(f"array<struct<pos:{dict(routes.dtypes)['pos']},ratio:double>>").alias("out"))
    return rows.select("route", F.explode(F.aggregate("path", zero, advance)["out"]).alias("r")).select("route", "r.pos", "r.ratio")


def replay_route(routes: DataFrame, measured: DataFrame, edges: DataFrame, slice_s: float = SLICE_S, departs: DataFrame | None = None) -> DataFrame:
    """(route, seconds): a fixed path driven through measured speeds (edge, slice, kph) from the first slice on, or from (route, depart_s); the last slice holds on."""
    slices = measured.groupBy("edge").agg(F.transform(F.array_sort(F.collect_list(F.struct("slice", "kph"))), lambda s: s["kph"]).alias("speeds"))
    met = routes.join(slices, "edge").join(edges.select("edge", "len"), "edge")
    rows = met.groupBy("route").agg(F.array_sort(F.collect_list(F.struct("pos", "len", "speeds"))).alias("path"))
    rows = rows.withColumn("depart_s", F.lit(0.0)) if departs is None else rows.join(departs.select("route", "depart_s"), "route")
    drive = lambda t, e: t + e["len"] / (F.get(e["speeds"], F.least(F.floor(t / slice_s).cast("int"), F.size(e["speeds"]) - 1)) / 3.6)
    return rows.select("route", (F.aggregate("path", F.col("depart_s"), drive) - F.col("depart_s")).alias("seconds"))


def near_but_off_route(routes: DataFrame, incidents: DataFrame, mids: DataFrame, most_m: float = 450.0, every: int = 4) -> DataFrame:
    """(route, incident): incidents that no route edge is part of, near the middle of one of every fourth edges.

    ``incidents``: (incident, edges); ``mids``: (edge, x, y). An incident lies where its first edge does.
    """
    cell = lambda c: F.floor(F.col(c) / most_m)
    around = F.array(F.lit(-1), F.lit(0), F.lit(1))
    some = routes.where((F.col("pos") - 1) % every == 0).join(mids, "edge").select("route", F.col("x").alias("rx"), F.col("y").alias("ry"), cell("x").alias("cx0"), cell("y").alias("cy0"))
    some = some.withColumn("dx", F.explode(around)).withColumn("dy", F.explode(around)).select("route", "rx", "ry", (F.col("cx0") + F.col("dx")).alias("cx"), (F.col("cy0") + F.col("dy")).alias("cy"))
    at = incidents.select("incident", F.col("edges")[0].alias("edge")).join(mids, "edge").select("incident", "x", "y", cell("x").alias("cx"), cell("y").alias("cy"))
    near = at.join(some, ["cx", "cy"]).where(F.pow(F.col("x") - F.col("rx"), 2) + F.pow(F.col("y") - F.col("ry"), 2) <= most_m**2).select("route", "incident").distinct()
    on = incidents.select("incident", F.explode("edges").alias("edge")).join(routes.select("route", "edge"), "edge").select("route", "incident").distinct()
    return near.join(on, ["route", "incident"], "left_anti")


def along(solved: DataFrame) -> DataFrame:
    """(route, pos, edge) of solved trips (trip, edges); pos counts from 1."""
    return solved.select(F.col("trip").alias("route"), F.posexplode("edges").alias("p", "edge")).select("route", (F.col("p") + 1).alias("pos"), "edge")


def _routes_asked(trips: DataFrame) -> DataFrame:
    return as_asked(trips).select(F.col("trip").alias("route"), "depart_s", "turn_weight")


def _weighed(preference: DataFrame | None) -> dict[str, DataFrame | None]:
    """A preference by trip (trip, edge, factor) or by taste (taste, edge, factor) as ``batch_shortest_paths`` takes it."""
    return {"likes" if preference is not None and "taste" in preference.columns else "penalty": preference}


def alternative_routes(trips: DataFrame, packed: DataFrame, edges: DataFrame, turns: DataFrame, tries: int = TRIES, preference: DataFrame | None = None) -> DataFrame:
    """(trip, place, edges, mean_s, sd_s, metres, label): up to ``tries`` different routes a trip, at their true cost, in the order found.

    Each try is one solve of all trips, in which the edges that the trip's earlier tries used are dearer; a route too like a kept one is dropped and its try is spent.
    ``preference`` (trip, edge, factor), or by the trips' taste (taste, edge, factor), weighs edges in every try.
    """
    weighed = _weighed(preference)
    net = network(packed, edges, turns, weighed.get("likes"))
    kept, used = None, None
    for turn in range(tries):
        found = batch_shortest_paths(trips, packed, edges, turns, net=net, used=used, **weighed).select("trip", "edges", F.lit(turn).alias("turn"))
        used = found if used is None else used.unionByName(found)
        if kept is None:
            kept = found
            continue
        alike = F.size(F.array_intersect("edges", "e2")) / F.size(F.array_union("edges", "e2"))
        same = found.join(kept.select("trip", F.col("edges").alias("e2")), "trip").where(alike > ALIKE).select("trip").distinct()
        kept = save(kept.unionByName(found.join(same, "trip", "left_anti")), "kept")
    place = F.row_number().over(Window.partitionBy("trip").orderBy("turn")) - 1
    kept = save(kept.withColumn("place", place).select(F.struct("trip", "place").alias("route"), "edges"), "kept")
    asked = kept.select("route", F.col("route.trip").alias("trip")).join(as_asked(trips), "trip").select(F.col("route").alias("trip"), "depart_s", "turn_weight")
    cost = driven(kept.withColumnRenamed("route", "trip"), asked, {"": (net, STEP_S)}).select(F.col("trip").alias("route"), "mean_s", "sd_s", "metres")
    return route_label(kept.join(cost, "route").select("route.trip", "route.place", "edges", "mean_s", "sd_s", "metres"))


def route_label(routes: DataFrame) -> DataFrame:
    """Routes (trip, place, mean_s, sd_s, metres) with ``label``: what makes each worth offering beside the trip's first (place 0)."""
    w = Window.partitionBy("trip").orderBy("place")
    mid, late = tf.eta_percentile(F.col("mean_s"), F.col("sd_s"), 0.0), tf.eta_percentile(F.col("mean_s"), F.col("sd_s"), P90)
    rows = routes.withColumn("_r", F.struct(mid.alias("mid"), tf.clip(mid / F.greatest(late, F.lit(1.0)), 0.0, 1.0).alias("sure"), F.col("metres").alias("metres")))
    rows = rows.withColumn("_b", F.first("_r").over(w))
    gain = lambda c: F.round((F.col(f"_b.{c}") - F.col(f"_r.{c}")) / F.greatest(F.col(f"_b.{c}"), F.lit(1.0)), 9)
    label = (
        F.when(F.col("place") == 0, "Recommended")
        .when((F.round(F.col("_r.sure") - F.col("_b.sure"), 9) > 0.025) & (gain("mid") > -0.18), "More predictable")
        .when(gain("mid") > 0.03, "Quicker, less certain")
        .when(gain("metres") > 0.08, "Shorter, slower")
        .when(F.col("_r.metres") > F.col("_b.metres") * 1.08, "Wider roads")
        .otherwise(F.concat(F.lit("Alternative "), F.col("place").cast("string")))
    )
    return rows.withColumn("label", label).drop("_r", "_b")


def compact_steps(steps: DataFrame, least_m: float = 130.0) -> DataFrame:
    """(route, step, instruction, name, metres, seconds) from ``direction_steps``: only what is worth saying aloud, and the arrival.

    Short stretches go to the one before; a road that carries on is one instruction, or "to stay on" after a turn; a
    short first stretch goes to the second. Each rule looks one row back only, so all are running sums over a route's rows.
    Routes are dealt over as many tasks as their rows ask for: what a task sorts and holds does not grow with the table.
    """
    steps = dealt_by(steps, "route")
    w = Window.partitionBy("route").orderBy("run")
    sums = (F.sum("metres").alias("metres"), F.sum("seconds").alias("seconds"))
    begin = F.min_by(F.struct("verb", "name"), "run").alias("b")

    def merged(rows: DataFrame, starts: Column) -> DataFrame:
        numbered = rows.withColumn("starts", starts.cast("int")).withColumn("g", F.sum("starts").over(w))
        return numbered.groupBy("route", "g").agg(begin, *sums).select("route", F.col("g").alias("run"), "b.*", "metres", "seconds")

    first = F.row_number().over(w) == 1
    same = F.coalesce(F.col("name") == F.lag("name").over(w), F.lit(False))
    long = merged(steps, first | (F.col("metres") >= least_m))
    said = long.withColumn("same", same).withColumn("verb", F.when(F.col("same") & ~F.col("verb").rlike("^(Continue|Bear)"), F.regexp_replace("verb", " onto$", " to stay on")).otherwise(F.col("verb")))
    said = merged(said, ~F.col("same") | ~F.col("verb").rlike("^(Continue|Bear)"))
    at, n = F.row_number().over(w), F.count(F.lit(1)).over(Window.partitionBy("route"))
    tiny = F.max(F.when((F.col("at") == 1) & (F.col("metres") < least_m) & (F.col("n") > 1), 1)).over(Window.partitionBy("route")).isNotNull()
    marked = said.withColumns({"at": at, "n": n}).withColumn("tiny", tiny)
    marked = marked.withColumn("step", F.when(F.col("tiny"), F.greatest(F.col("at") - 1, F.lit(1))).otherwise(F.col("at")))
    # of a first stretch that went on to the second, the second's wording counts
    whole = marked.groupBy("route", "step").agg(F.max_by(F.struct("verb", "name"), "at").alias("b"), *sums)
    opening = (F.col("step") == 1) & F.col("b.verb").rlike("^((Turn|Bear) (left|right)|Continue) onto$|^Head out on$")
    spoken = whole.select("route", "step", F.concat(F.when(opening, "Start on").otherwise(F.col("b.verb")), F.lit(" "), F.col("b.name")).alias("instruction"), F.col("b.name").alias("name"), "metres", "seconds")
    # the last step brings the arrival along
    shown = F.struct("step", "instruction", "name", "metres", "seconds")
    arrival = F.struct((F.col("step") + 1).alias("step"), F.lit("Arrive at your destination").alias("instruction"), "name", F.lit(0.0).alias("metres"), F.lit(0.0).alias("seconds"))
    last = F.lead("step").over(Window.partitionBy("route").orderBy("step")).isNull()
    return spoken.withColumn("last", last).select("route", F.explode(F.when(F.col("last"), F.array(shown, arrival)).otherwise(F.array(shown))).alias("s")).select("route", "s.*")


def snapshot_baseline(trips: DataFrame, snapshot: DataFrame, packed: DataFrame, edges: DataFrame, turns: DataFrame, preference: DataFrame | None = None) -> DataFrame:
    """(trip, claimed_s, mean_s, sd_s, metres): the route that the frozen profile picks, what it promises, and what it costs under the forecast."""
    weighed = _weighed(preference)
    frozen, honest = network(snapshot, edges, turns, weighed.get("likes")), network(packed, edges, turns)
    solved = batch_shortest_paths(trips, snapshot, edges, turns, net=frozen, **weighed)
    told = driven(solved, as_asked(trips), {"claimed": (frozen, STEP_S), "honest": (honest, STEP_S)})
    claimed = told.where("network = 'claimed'").select("trip", F.col("mean_s").alias("claimed_s"))
    return claimed.join(told.where("network = 'honest'").select("trip", "mean_s", "sd_s", "metres"), "trip")


def congestion_detours(trips: DataFrame, live: DataFrame, plain: DataFrame, edges: DataFrame, turns: DataFrame, least_m: float = 1500.0, least_min: float = 2.0, least_km: float = 0.2, preference: DataFrame | None = None) -> DataFrame:
    """(trip, chosen_km, chosen_min, short_km, short_min, saved_min, extra_km): trips (with ``straight_m``) whose live route is longer but clearly quicker than the traffic-blind one, both under the live profile."""
    far = save(trips.where(F.col("straight_m") >= least_m), "far")

    weighed = _weighed(preference)
    nets = [network(p, edges, turns, weighed.get("likes")) for p in (live, plain)]

    def cost(net: Network, name: str) -> DataFrame:
        found = driven(batch_shortest_paths(far, live, edges, turns, net=net, **weighed), as_asked(far), {name: (nets[0], STEP_S)})
        return found.select("trip", (F.col("metres") / 1000).alias(f"{name}_km"), (tf.eta_percentile(F.col("mean_s"), F.col("sd_s"), 0.0) / 60).alias(f"{name}_min"))

    met = cost(nets[0], "chosen").join(cost(nets[1], "short"), "trip").withColumns({"saved_min": F.col("short_min") - F.col("chosen_min"), "extra_km": F.col("chosen_km") - F.col("short_km")})
    return met.where((F.col("saved_min") >= least_min) & (F.col("extra_km") > least_km))


def backtest_routers(trips: DataFrame, profiles: dict[str, DataFrame], measured: DataFrame, edges: DataFrame, turns: DataFrame, hot: DataFrame, natural: str = "historical", preference: DataFrame | None = None) -> DataFrame:
    """(trip, method, claimed_s, promised_p90_s, actual_s, distance_m, disrupted): each profile's route, what it promises, and its drive through ``measured``.

    A trip is disrupted where the ``natural`` profile's route has one of the ``hot`` edges. Trips that a profile can't solve drop out.
    """
    weighed = _weighed(preference)
    slices = measured.groupBy("edge").agg(F.transform(F.array_sort(F.collect_list(F.struct("slice", "kph"))), lambda x: F.struct(x["kph"], F.lit(0.0).alias("sigma"), F.lit(0.0).alias("delay_s"))).alias("steps"))
    replayed = network(slices, edges, turns.where(F.lit(False)))
    rows, disrupted = None, None
    for name, packed in profiles.items():
        net = network(packed, edges, turns, weighed.get("likes"))
        solved = batch_shortest_paths(trips, packed, edges, turns, net=net, **weighed)
        both = driven(solved, as_asked(trips), {"claimed": (net, STEP_S), "actual": (replayed, SLICE_S)})
        told = both.where("network = 'claimed'").join(both.where("network = 'actual'").select("trip", F.col("seconds").alias("actual_s")), "trip")
        late = tf.eta_percentile(F.col("mean_s"), F.col("sd_s"), P90)
        part = told.select("trip", F.lit(name).alias("method"), F.col("mean_s").alias("claimed_s"), late.alias("promised_p90_s"), "actual_s", F.col("metres").alias("distance_m"))
        rows = part if rows is None else rows.unionByName(part)
        if name == natural:
            disrupted = solved.select("trip", F.explode("edges").alias("edge")).join(hot.select("edge").distinct(), "edge").select("trip", F.lit(True).alias("disrupted")).distinct()
    rows = save(rows, "backtest")
    whole = rows.groupBy("trip").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(profiles)).select("trip")
    met = rows.join(whole, "trip").join(disrupted, "trip", "left") if disrupted is not None else rows.join(whole, "trip").withColumn("disrupted", F.lit(None).cast("boolean"))
    return met.withColumn("disrupted", F.coalesce("disrupted", F.lit(False)))
