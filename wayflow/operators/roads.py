"""Operators on the road graph: (edge, u, v, name, hw, kph, rank, len, lanes, twin, lat1, lon1, lat2, lon2)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import traffic as tf
from ..schema import DOWNSTREAM_M, TURN_OFF_M
from ..storage import save


def adjacency_join(edges: DataFrame) -> DataFrame:
    """(edge, next): edges that begin where another ends, but for its own reverse."""
    a, b = edges.select("edge", "v", "twin"), edges.select(F.col("edge").alias("next"), F.col("u").alias("v"))
    return a.join(b, "v").where(F.col("twin").isNull() | (F.col("next") != F.col("twin"))).select("edge", "next")


def upstream_downstream(edges: DataFrame) -> DataFrame:
    """(edge, near, extra): edges that feed an edge (extra 0 m) and that leave it (DOWNSTREAM_M)."""
    e = edges.select("edge", "u", "v")
    up = e.join(edges.select(F.col("edge").alias("near"), F.col("v").alias("u")), "u").select("edge", "near", F.lit(0.0).alias("extra"))
    down = e.join(edges.select(F.col("edge").alias("near"), F.col("u").alias("v")), "v").select("edge", "near", F.lit(DOWNSTREAM_M).alias("extra"))
    return up.unionByName(down)


def local_metres(points: DataFrame, lat0: Column) -> DataFrame:
    return points.withColumns({"x": F.col("lon") * 111320.0 * F.cos(F.radians(lat0)), "y": F.col("lat") * 110540.0})


def nearest_node(points: DataFrame, nodes: DataFrame, key: str, reach_m: float = 300.0) -> DataFrame:
    """(key, node, metres): nearest node within reach, the least on a tie; both sides in local metres (x, y).

    Points meet nodes of their own and the eight next cells of ``reach_m``, never all nodes.
    """
    cell = lambda c: F.floor(F.col(c) / reach_m)
    around = F.array(F.lit(-1), F.lit(0), F.lit(1))
    asked = points.select(key, F.col("x").alias("px"), F.col("y").alias("py"), cell("x").alias("cx0"), cell("y").alias("cy0"))
    asked = asked.withColumn("dx", F.explode(around)).withColumn("dy", F.explode(around)).withColumns({"cx": F.col("cx0") + F.col("dx"), "cy": F.col("cy0") + F.col("dy")})
    given = nodes.select("node", "x", "y", cell("x").alias("cx"), cell("y").alias("cy"))
    far = F.sqrt(F.pow(F.col("px") - F.col("x"), 2) + F.pow(F.col("py") - F.col("y"), 2))
    met = asked.join(given, ["cx", "cy"]).withColumn("metres", far).where(F.col("metres") <= reach_m)
    return met.groupBy(key).agg(F.min(F.struct(F.round("metres", 6).alias("m"), "node")).alias("best")).select(key, "best.node", F.col("best.m").alias("metres"))


def map_match_sensors(sensors: DataFrame, nodes: DataFrame, edges: DataFrame, most_m: float = 120.0, rank_factor: float = 0.30) -> DataFrame:
    """(camera_id, edge, metres): of the edges at a sensor's nearest node that of least distance x (1 + rank_factor x rank).

    Distance is to the edge's middle; what is too far drops out; of sensors on one edge the closest stays.
    """
    near = nearest_node(sensors, nodes, "camera_id")
    at = near.select("camera_id", "node").join(sensors.select("camera_id", "x", "y"), "camera_id")
    ends = edges.select("edge", "rank", ((F.col("x1") + F.col("x2")) / 2).alias("mx"), ((F.col("y1") + F.col("y2")) / 2).alias("my"), F.explode(F.array("u", "v")).alias("node"))
    d = F.sqrt(F.pow(F.col("x") - F.col("mx"), 2) + F.pow(F.col("y") - F.col("my"), 2))
    scored = at.join(ends, "node").withColumn("d", d).withColumn("score", F.round(F.col("d") * (1 + rank_factor * F.col("rank")), 6))
    best = scored.groupBy("camera_id").agg(F.min(F.struct("score", "edge", "d")).alias("b")).select("camera_id", "b.edge", F.round("b.d", 6).alias("metres")).where(F.col("metres") <= most_m)
    return best.groupBy("edge").agg(F.min(F.struct("metres", "camera_id")).alias("b")).select("b.camera_id", "edge", "b.metres")


def point_segment_distance(points: DataFrame, edges: DataFrame, reach_m: float = 300.0) -> DataFrame:
    """(camera_id, metres): least distance to a segment (not its line), both in local metres; grid cells of ``reach_m``."""
    cell = lambda c: F.floor(F.col(c) / reach_m)
    low = lambda a, b: F.floor((F.least(a, b)) / reach_m) - 1
    high = lambda a, b: F.floor((F.greatest(a, b)) / reach_m) + 1
    seg = edges.select("x1", "y1", "x2", "y2", F.explode(F.sequence(low("x1", "x2"), high("x1", "x2"))).alias("cx"), "edge").withColumn("cy", F.explode(F.sequence(low("y1", "y2"), high("y1", "y2"))))
    met = points.select("camera_id", "x", "y", cell("x").alias("cx"), cell("y").alias("cy")).join(seg, ["cx", "cy"])
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    k = tf.clip(((F.col("x") - F.col("x1")) * dx + (F.col("y") - F.col("y1")) * dy) / F.greatest(dx * dx + dy * dy, F.lit(1e-9)), 0.0, 1.0)
    d = F.sqrt(F.pow(F.col("x") - F.col("x1") - k * dx, 2) + F.pow(F.col("y") - F.col("y1") - k * dy, 2))
    return met.groupBy("camera_id").agg(F.min(d).alias("metres"))


def junction_degree(edges: DataFrame) -> DataFrame:
    """(edge, out_degree, in_degree, junction, weight) of each edge's tail, where the delay is met: a junction has three ways out.

    The weight grows with the larger degree and with the edge's own class.
    """
    out = edges.groupBy("u").agg(F.count(F.lit(1)).alias("out_degree"))
    into = edges.groupBy(F.col("v").alias("u")).agg(F.count(F.lit(1)).alias("in_degree"))
    met = edges.select("edge", "u", "rank").join(out, "u").join(into, "u", "left").withColumn("in_degree", F.coalesce("in_degree", F.lit(0)))
    junction = F.col("out_degree") >= 3
    worth = F.when(F.col("rank") <= 2, 1.0).when(F.col("rank") <= 4, 0.78).otherwise(0.30)
    weight = F.when(junction, worth * tf.clip(F.greatest("out_degree", "in_degree") / 3, 0.7, 1.8)).otherwise(0.0)
    return met.select("edge", "out_degree", "in_degree", junction.alias("junction"), weight.alias("weight"))


def render_subset(edges: DataFrame, state: DataFrame, most_rank: int = 5, most: int = 5000) -> DataFrame:
    """(edge, rank, congestion) of the larger roads, the most congested ones where there are more than ``most``."""
    met = edges.where(F.col("rank") <= most_rank).join(state.select("edge", F.col("kph").alias("now")), "edge")
    jam = F.round(tf.edge_congestion(F.col("now"), F.col("kph")), 6)
    return met.select("edge", "rank", jam.alias("congestion")).orderBy(F.desc("congestion"), "edge").limit(most)


def place_anchor(edges: DataFrame) -> DataFrame:
    """(key, edge, node): of each street name the longest segment (least id on a tie) and its tail."""
    best = F.min(F.struct((-F.col("len")).alias("l"), "edge", "u"))
    return edges.groupBy(tf.normalise_name(F.col("name")).alias("key")).agg(best.alias("b")).select("key", "b.edge", F.col("b.u").alias("node"))


def landmark_union(streets: DataFrame, landmarks: DataFrame) -> DataFrame:
    """(key, node, kind): both, a landmark wins a name that both have."""
    both = streets.select("key", "node", F.lit("street").alias("kind"), F.lit(1).alias("p")).unionByName(landmarks.select("key", "node", F.lit("landmark").alias("kind"), F.lit(0).alias("p")))
    return both.groupBy("key").agg(F.min(F.struct("p", "node", "kind")).alias("b")).select("key", "b.node", "b.kind")


def bidirectional_edges(ways: DataFrame) -> DataFrame:
    """Two-way edges (edge, u, v, oneway, geom) with their reverses, linked by ``twin``."""
    both = ways.where("not oneway")
    ahead = ways.withColumn("twin", F.when(~F.col("oneway"), F.col("edge") * 2 + 1)).withColumn("id", F.col("edge") * 2)
    back = both.withColumns({"twin": F.col("edge") * 2, "id": F.col("edge") * 2 + 1}).select("id", F.col("v").alias("u"), F.col("u").alias("v"), F.reverse("geom").alias("geom"), "twin")
    return ahead.select("id", "u", "v", "geom", "twin").unionByName(back)


def turn_cost(edges: DataFrame, user_weight: float = 1.0) -> DataFrame:
    """(edge, next, turn_s): seconds a turn costs; straight on or along the same named road is free, across traffic dear."""
    bearing = tf.bearing_deg(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))
    e = edges.withColumn("bearing", bearing)
    pairs = adjacency_join(edges).join(e.select("edge", "name", "bearing"), "edge").join(e.select(F.col("edge").alias("next"), F.col("name").alias("name2"), F.col("bearing").alias("bearing2")), "next")
    delta = F.pmod(F.col("bearing2") - F.col("bearing") + 180, F.lit(360.0)) - 180
    d = F.round(delta, 6)
    base = F.when(F.abs(d) > 70, 9.0).otherwise(4.0) * F.when(d > 45, 1.8).otherwise(1.0) + F.when(F.abs(d) > 150, 25.0).otherwise(0.0)
    cost = F.when((F.col("name") == F.col("name2")) | (F.abs(d) < 22), 0.0).otherwise(base * user_weight)
    return pairs.select("edge", "next", cost.alias("turn_s"))


def corridor_costs(starts: DataFrame, edges: DataFrame, reach_m: float, most_rounds: int = 200) -> DataFrame:
    """(camera_id, edge, metres): least effective distance from a sensor's edge, up to ``reach_m``.

    Rounds of a frontier join: labels that got better go on to their neighbours; each round is a written table.
    """
    near = upstream_downstream(edges).join(edges.select("edge", "name"), "edge").join(edges.select(F.col("edge").alias("near"), F.col("name").alias("name2"), "len"), "near")
    step = F.col("len") + F.col("extra") + F.when((F.col("name") == F.col("name2")) & (F.col("name") != ""), 0.0).otherwise(TURN_OFF_M)
    steps = save(near.select("edge", "near", step.alias("step")), "steps")
    best = save(starts.select("camera_id", "edge", F.lit(0.0).alias("metres")), "labels")
    frontier = best
    for _ in range(most_rounds):
        tried = frontier.join(steps, "edge").select("camera_id", F.col("near").alias("edge"), (F.col("metres") + F.col("step")).alias("metres")).where(F.col("metres") <= reach_m)
        tried = tried.groupBy("camera_id", "edge").agg(F.min("metres").alias("metres"))
        old = best.withColumnRenamed("metres", "old")
        better = save(tried.join(old, ["camera_id", "edge"], "left").where(F.col("old").isNull() | (F.col("metres") < F.col("old") - 1e-9)).select("camera_id", "edge", "metres"), "better")
        if better.isEmpty():
            return best
        best = save(best.join(better.withColumnRenamed("metres", "new"), ["camera_id", "edge"], "full").select("camera_id", "edge", F.coalesce("new", "metres").alias("metres")), "labels")
        frontier = better
    raise RuntimeError(f"labels still change after {most_rounds} rounds")


def split_ways(ways: DataFrame, kept: DataFrame) -> DataFrame:
    """(way, chunk, refs): ways (way, refs) cut at junction nodes (node), which both chunks keep; single points and loops drop out."""
    points = ways.select("way", F.posexplode("refs").alias("pos", "node"))
    marked = points.join(kept.select("node", F.lit(1).alias("cut")), "node", "left")
    w = Window.partitionBy("way").orderBy("pos")
    upto = F.coalesce(F.sum(F.when((F.col("cut") == 1) & (F.col("pos") > 0), 1).otherwise(0)).over(w), F.lit(0))
    numbered = marked.withColumn("upto", upto)
    # a junction ends one chunk and begins the next
    ends = numbered.where("cut = 1 and pos > 0").select("way", (F.col("upto") - 1).alias("chunk"), "pos", "node")
    rows = numbered.select("way", F.col("upto").alias("chunk"), "pos", "node").unionByName(ends)
    grouped = rows.groupBy("way", "chunk").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "node"))), lambda x: x["node"]).alias("refs"))
    return grouped.where((F.size("refs") > 1) & (F.element_at("refs", 1) != F.element_at("refs", -1)))


def junction_nodes(ways: DataFrame) -> DataFrame:
    """(node, uses): nodes that ways use at least twice, their ends counted once more."""
    inner = ways.select(F.explode("refs").alias("node"))
    ends = ways.select(F.explode(F.array(F.element_at("refs", 1), F.element_at("refs", -1))).alias("node"))
    return inner.unionByName(ends).groupBy("node").agg(F.count(F.lit(1)).alias("uses")).where("uses >= 2")


def _reach(start: DataFrame, edges: DataFrame, most_rounds: int) -> DataFrame:
    """Least label that reaches each node along ``edges`` (a, b), from labels (node, label)."""
    labels = start
    before = None
    for _ in range(most_rounds):
        onward = labels.join(edges, F.col("node") == F.col("a")).select(F.col("b").alias("node"), "label")
        labels = save(labels.unionByName(onward).groupBy("node").agg(F.min("label").alias("label")), "labels")
        now = labels.agg(F.sum(F.col("label").cast("decimal(38,0)")), F.count(F.lit(1))).first()
        if now == before:
            return labels
        before = now
    raise RuntimeError(f"labels still change after {most_rounds} rounds")


#: Arcs of a block whose strong components one task finds at once.
BLOCK_ARCS = 1 << 16


def _local_components(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, least) of the nodes that the arcs of one task join to a lesser one in a strong component: Tarjan's algorithm without recursion."""
    ahead: dict[int, list[int]] = {}
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ahead.setdefault(a, []).append(b)
    seen, low, stack, placed, found = {}, {}, [], set(), []
    for root in ahead:
        if root in seen:
            continue
        work = [(root, iter(ahead[root]))]
        seen[root] = low[root] = len(seen)
        stack.append(root)
        while work:
            at, more = work[-1]
            for to in more:
                if to not in seen:
                    seen[to] = low[to] = len(seen)
                    stack.append(to)
                    work.append((to, iter(ahead.get(to, ()))))
                    break
                if to not in placed:
                    low[at] = min(low[at], seen[to])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[at])
                if low[at] == seen[at]:
                    part = [stack.pop()]
                    while part[-1] != at:
                        part.append(stack.pop())
                    placed.update(part)
                    least = min(part)
                    found += [(x, least) for x in part if x != least]
    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["node", "least"])


def _contracted(arcs: DataFrame, names: DataFrame, blocks: int) -> tuple[DataFrame, DataFrame]:
    """``arcs`` (a, b) and ``names`` (node, component) after each of ``blocks`` ranges of tails has made one node, the least, of each of its strong components.

    All arcs out of a node lie in one range, so no node is in components of two ranges.
    """
    least = save(arcs.repartitionByRange(blocks, "a").mapInArrow(_local_components, "node long, least long"), "local")
    renamed = lambda df, c: df.join(least.select(F.col("node").alias(c), F.col("least").alias("to")), c, "left").withColumn(c, F.coalesce("to", c)).drop("to")
    new = renamed(renamed(arcs, "a"), "b").where("a <> b").distinct()
    return save(new, "arcs"), save(renamed(names, "component"), "names")


def strong_components(edges: DataFrame, most_rounds: int = 10_000, block: int = BLOCK_ARCS) -> DataFrame:
    """(node, component) of the network's strong components, each named by its least node.

    First, ranges of some ``block`` arcs are contracted, a range a task: whatever is strongly connected within a range is so in the whole. What is left
    is dealt anew until one range holds it all, or until ranges have nothing to contract; then it is coloured in rounds (``_coloured``). Node numbers
    that lie near each other on the map make for few passes, any others for the same result.
    """
    nodes = save(edges.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "nodes")
    names = nodes.select("node", F.col("node").alias("component"))
    left = save(edges.select(F.col("u").alias("a"), F.col("v").alias("b")).where("a <> b").distinct(), "arcs")
    n = left.count()
    while n:
        blocks = -(-n // block)
        left, names = _contracted(left, names, blocks)
        before, n = n, left.count()
        if blocks == 1:
            # one range has seen every arc: no two nodes that are left reach each other
            return _least_named(names)
        if n > 0.9 * before:
            break
    if not n:
        return _least_named(names)
    found = save(_coloured(left, most_rounds), "coloured")
    met = names.join(found.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left")
    return _least_named(met.select("node", F.coalesce("to", "component").alias("component")))


def _least_named(names: DataFrame) -> DataFrame:
    least = names.groupBy("component").agg(F.min("node").alias("least"))
    return names.join(least, "component").select("node", F.col("least").alias("component"))


def _coloured(left: DataFrame, most_rounds: int) -> DataFrame:
    """(node, component) of arcs (a, b) by colouring: forward least labels, then back within a colour from its root.

    Nodes without a way in or out are components of their own and go first. Rounds write to the shared folder.
    """
    nodes = save(left.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "nodes")
    done = None
    for _ in range(most_rounds):
        while True:
            both = left.select(F.col("a").alias("node")).intersect(left.select(F.col("b").alias("node")))
            live = save(left.join(both.withColumnRenamed("node", "a"), "a", "left_semi").join(both.withColumnRenamed("node", "b"), "b", "left_semi"), "arcs")
            same = live.count() == left.count()
            left = live
            if same:
                break
        if left.isEmpty():
            break
        here = left.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        colour = _reach(here.withColumn("label", F.col("node")), left, most_rounds)
        ca, cb = colour.select(F.col("node").alias("a"), F.col("label").alias("la")), colour.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        inside = save(left.join(ca, "a").join(cb, "b").where("la = lb").select("a", "b"), "inside")
        back = _reach(colour.where("node = label").select("node", "label"), inside.select(F.col("b").alias("a"), F.col("a").alias("b")), most_rounds)
        found = save(back.select("node", F.col("label").alias("component")), "found")
        done = found if done is None else done.unionByName(found)
        gone = found.select("node")
        left = save(left.join(gone.withColumnRenamed("node", "a"), "a", "left_anti").join(gone.withColumnRenamed("node", "b"), "b", "left_anti"), "arcs")
    if done is None:
        return nodes.select("node", F.col("node").alias("component"))
    return nodes.join(done, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def largest_scc(edges: DataFrame) -> DataFrame:
    """Nodes of the largest strong component; of equal ones that with the least node."""
    parts = save(strong_components(edges), "components")
    best = parts.groupBy("component").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "component").limit(1)
    return parts.join(F.broadcast(best.select("component")), "component", "left_semi").select("node")


def farthest_point_sample(points: DataFrame, n: int) -> DataFrame:
    """(camera_id, turn): starting at the first, always the point farthest from those chosen (least id on a tie).

    A round is one aggregate over all points; the chosen one, a single row, goes to the next round as literals.
    """
    first = points.orderBy("camera_id").limit(1).collect()
    if not first:
        return points.select("camera_id", F.lit(0).alias("turn"))
    chosen = [(first[0]["camera_id"], 0)]
    at, left = first[0], points.withColumn("least", F.lit(float("inf")))
    for turn in range(1, n):
        d = F.pow(F.col("x") - at["x"], 2) + F.pow(F.col("y") - at["y"], 2)
        left = save(left.where(F.col("camera_id") != at["camera_id"]).withColumn("least", F.least("least", F.round(d, 6))), "distances")
        rows = left.orderBy(F.desc("least"), "camera_id").limit(1).collect()
        if not rows:
            break
        at = rows[0]
        chosen.append((at["camera_id"], turn))
    return points.sparkSession.createDataFrame(chosen, "camera_id long, turn int")


RANK_WORTH = (1.00, 0.95, 0.90, 0.78, 0.60, 0.42, 0.30, 0.18, 0.10)


def watching_value(edges: DataFrame) -> DataFrame:
    """(id, value): worth of watching an edge, from its class, the edges leaving its end, and its length."""
    leaving = edges.groupBy(F.col("u").alias("v")).agg(F.count(F.lit(1)).alias("ways"))
    worth = F.get(F.array(*map(F.lit, RANK_WORTH)), F.least(F.greatest(F.col("rank"), F.lit(0)), F.lit(len(RANK_WORTH) - 1)).cast("int"))
    junction = 0.55 + 0.45 * F.least(F.coalesce("ways", F.lit(0)) / 4.0, F.lit(1.6))
    value = worth * junction * F.least(F.greatest(F.col("len") / 140.0, F.lit(0.3)), F.lit(1.0))
    return edges.select("edge", "v", "rank", "len").join(leaving, "v", "left").select(F.col("edge").alias("id"), value.alias("value"))


def spacing_conflicts(edges: DataFrame, least_m: float = 150.0) -> DataFrame:
    """(a, b) both ways: edges whose middles (x, y) are less than ``least_m`` apart, and both directions of a street.

    Middles meet over grid cells of ``least_m`` and the cells around them.
    """
    cell = lambda c: F.floor(F.col(c) / least_m)
    around = F.array(F.lit(-1), F.lit(0), F.lit(1))
    at = edges.select(F.col("edge").alias("b"), F.col("x").alias("bx"), F.col("y").alias("b_y"), cell("x").alias("cx"), cell("y").alias("cy"))
    near = edges.select(F.col("edge").alias("a"), "x", "y", cell("x").alias("cx0"), cell("y").alias("cy0")).withColumn("dx", F.explode(around)).withColumn("dy", F.explode(around))
    near = near.select("a", "x", "y", (F.col("cx0") + F.col("dx")).alias("cx"), (F.col("cy0") + F.col("dy")).alias("cy"))
    close = near.join(at, ["cx", "cy"]).where((F.col("a") != F.col("b")) & (F.pow(F.col("x") - F.col("bx"), 2) + F.pow(F.col("y") - F.col("b_y"), 2) < least_m**2)).select("a", "b")
    twins = edges.where("twin is not null").select(F.col("edge").alias("a"), F.col("twin").alias("b"))
    return close.unionByName(twins).unionByName(twins.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def spaced_greedy_select(candidates: DataFrame, conflicts: DataFrame, budget: int, most_rounds: int = 1000) -> DataFrame:
    """The first ``budget`` of what a greedy scan by (value descending, id) would take, never two in conflict.

    Candidates (id, value); conflicts (a, b) both ways. In each round all take part at once: who beats every undecided
    neighbour is chosen, its neighbours are out. That is what the scan chooses. Once ``budget`` are chosen, what ranks
    behind them is left out, as the scan would not come to it.
    """
    left = save(candidates.select("id", "value"), "left")
    taken = None
    for _ in range(most_rounds):
        if left.isEmpty():
            break
        rank = F.struct((-F.col("value")).alias("v"), F.col("id").alias("i"))
        rivals = conflicts.join(left.select(F.col("id").alias("b"), rank.alias("rank")), "b").groupBy(F.col("a").alias("id")).agg(F.min("rank").alias("best"))
        won = save(left.join(rivals, "id", "left").where(F.col("best").isNull() | (rank < F.col("best"))).select("id", "value"), "won")
        taken = won if taken is None else taken.unionByName(won)
        out = conflicts.join(won.select(F.col("id").alias("a")), "a", "left_semi").select(F.col("b").alias("id"))
        left = left.join(won.select("id").unionByName(out), "id", "left_anti")
        first = taken.orderBy(F.desc("value"), "id").limit(budget).collect()
        if len(first) == budget:
            value, at = (first[-1]["value"], first[-1]["id"]) if first else (float("inf"), 0)
            left = left.where((F.col("value") > value) | ((F.col("value") == value) & (F.col("id") < at)))
        left = save(left, "left")
    else:
        if not left.isEmpty():
            raise RuntimeError(f"candidates still undecided after {most_rounds} rounds")
    return (candidates.select("id", "value").where("false") if taken is None else taken).orderBy(F.desc("value"), "id").limit(budget)
