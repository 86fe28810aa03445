"""Operators over solved routes against plain Python on a small random network."""

from __future__ import annotations

import heapq
import math
import random

import pytest
from pyspark.sql import functions as F

from wayflow.operators import routes as rt
from wayflow.storage import save

TRIPS = [(0, 0, 5), (1, 1, 7), (2, 3, 2), (3, 6, 4)]
r = random.Random(9)
EDGES = [e for e in ((i, r.randrange(8), r.randrange(8), 100.0 + r.randrange(400)) for i in range(30)) if e[1] != e[2]]
BY = {e[0]: e for e in EDGES}
LIVE, FROZEN = ({e[0]: [(5.0 + r.randrange(60), 0.1 + r.random() / 5, float(r.randrange(9))) for _ in range(rt.STEPS)] for e in EDGES} for _ in range(2))
TURNS = {(a[0], b[0]): float(r.randrange(0, 9)) for a in EDGES for b in EDGES if a[2] == b[1]}
SLICES = {(e[0], k): 10.0 + r.randrange(40) for e in EDGES for k in range(6)}


def leg(speed, e, t):
    kph, sigma, delay = speed[e][min(int(t // rt.STEP_S), rt.STEPS - 1)]
    drive = BY[e][3] / (kph / 3.6)
    return drive, drive + delay, sigma


def cost(path, speed, depart=0.0):
    t, var = depart, 0.0
    for before, e in zip([None, *path], path, strict=False):
        _, seconds, sigma = leg(speed, e, t)
        t += seconds + TURNS.get((before, e), 0.0)
        var += (seconds * sigma) ** 2 * rt.WIDEN
    return t - depart, math.sqrt(var), sum(BY[e][3] for e in path)


def percentile(mean, sd, z):
    cv = math.log1p((sd / mean) ** 2)
    return mean / math.exp(cv / 2) * math.exp(z * math.sqrt(cv))


def solve(o, d, speed, dear=None):
    dear, best = dear or {}, {}
    heap = [(dear.get(e, 1.0) * leg(speed, e, 0.0)[1], e, None) for e in BY if BY[e][1] == o]
    heapq.heapify(heap)
    while heap:
        c, e, via = heapq.heappop(heap)
        if e in best:
            continue
        best[e] = (c, via)
        for (a, b), s in TURNS.items():
            if a == e and b not in best:
                heapq.heappush(heap, (c + s + dear.get(b, 1.0) * leg(speed, b, c)[1], b, e))
    ends = [(best[e][0], e) for e in best if BY[e][2] == d]
    if not ends:
        return None
    path = [min(ends)[1]]
    while best[path[0]][1] is not None:
        path.insert(0, best[path[0]][1])
    return path


@pytest.fixture(scope="module")
def net(spark):
    pack = lambda s: save(spark.createDataFrame(list(s.items()), "edge long, steps array<struct<kph:double,sigma:double,delay_s:double>>"), "packed")
    return {
        "trips": save(spark.createDataFrame([(*t, 2000.0 if t[0] else 100.0) for t in TRIPS], "trip long, origin long, dest long, straight_m double"), "trips"),
        "live": pack(LIVE),
        "frozen": pack(FROZEN),
        "edges": save(spark.createDataFrame(EDGES, "edge long, u long, v long, len double"), "edges"),
        "turns": save(spark.createDataFrame([(*k, v) for k, v in TURNS.items()], "edge long, next long, turn_s double"), "turns"),
        "measured": spark.createDataFrame([(*k, v) for k, v in SLICES.items()], "edge long, slice int, kph double"),
    }


def solve_with_risk(o, d, speed, depart, risk, weight, dear):
    """Dijkstra over edges, settled by cost; the clock runs beside it."""
    best, heap = {}, []

    def push(e, via, cost, clock, var, turn):
        _, seconds, sigma = leg(speed, e, clock)
        mean, sd = dear.get(e, 1.0) * seconds, seconds * sigma
        heapq.heappush(heap, (cost + mean + turn + risk * sd, e, via, clock + mean + turn, var + sd * sd))

    for e in BY:
        if BY[e][1] == o:
            push(e, None, 0.0, depart, 0.0, 0.0)
    while heap:
        cost, e, via, clock, var = heapq.heappop(heap)
        if e not in best:
            best[e] = cost, via, clock, var
            for (a, b), s in TURNS.items():
                if a == e and b not in best:
                    push(b, e, cost, clock, var, s * weight)
    ends = [(best[e][0], e) for e in best if BY[e][2] == d]
    if not ends:
        return None
    path = [min(ends)[1]]
    cost, _, clock, var = best[path[0]]
    while best[path[0]][1] is not None:
        path.insert(0, best[path[0]][1])
    return path, cost, clock - depart, math.sqrt(var * rt.WIDEN)


def test_risk_departure_and_preferences(spark, net):
    """Risk 0, 1 and 2.5 at three departures, with turns weighed and edges liked; equal to Dijkstra's labels."""
    rows = [(100 * k + t, o, d, depart, risk, weight) for t, o, d in TRIPS for k, (depart, risk, weight) in enumerate((x, y, 1.0 if y else 0.5) for x in (0.0, 700.0, 4000.0) for y in (0.0, 1.0, 2.5))]
    likes = [(row[0], e, 0.6 + (e % 5) / 4) for row in rows if row[0] % 2 for e in BY if e % 3 == 0]
    trips = spark.createDataFrame(rows, "trip long, origin long, dest long, depart_s double, risk double, turn_weight double")
    liking = spark.createDataFrame(likes, "trip long, edge long, factor double")
    got = {x["trip"]: x for x in rt.batch_shortest_paths(trips, net["live"], net["edges"], net["turns"], penalty=liking).collect()}
    want = {t: solve_with_risk(o, d, LIVE, depart, risk, weight, {e: f for k, e, f in likes if k == t}) for t, o, d, depart, risk, weight in rows}
    assert set(got) == {t for t, x in want.items() if x}
    for t, x in got.items():
        assert x["edges"] == want[t][0]
        assert [x["cost_s"], x["mean_s"], x["sd_s"]] == pytest.approx(want[t][1:], abs=1e-3)
    assert len({tuple(x["edges"]) for x in got.values()}) > len(TRIPS)
    asked = trips.select(trips["trip"].alias("route"), "depart_s", "turn_weight")
    told = rt.evaluate_route(rt.along(rt.batch_shortest_paths(trips, net["live"], net["edges"], net["turns"])), net["live"], net["edges"], net["turns"], asked=asked).collect()
    plain = {t: solve_with_risk(o, d, LIVE, depart, risk, weight, {}) for t, o, d, depart, risk, weight in rows}
    assert {x["route"]: [pytest.approx(x["mean_s"], abs=1e-3), pytest.approx(x["sd_s"], abs=1e-3)] for x in told} == {t: list(x[2:]) for t, x in plain.items() if x}


def test_paths_over_many_regions(spark):
    """A street of crossings in regions of five nodes, with side roads, one-way stretches, risk and tastes: equal to Dijkstra's labels, in few rounds."""
    r = random.Random(4)
    ends = [(k, k + 1) for k in range(40)] + [(k + 1, k) for k in range(40) if k % 9] + [(k, min(k + 2, 40)) for k in range(0, 40, 3)] + [(min(k + 3, 40), k) for k in range(0, 40, 4)]
    edges = {i: (i, a, b, 100.0 + r.randrange(400)) for i, (a, b) in enumerate(ends) if a != b}
    speed = {e: [(5.0 + r.randrange(60), 0.1 + r.random() / 5, float(r.randrange(9))) for _ in range(rt.STEPS)] for e in edges}
    turns = {(a, b): float(r.randrange(9)) for a in edges for b in edges if edges[a][2] == edges[b][1]}
    liked = {e: 0.7 + e % 4 / 5 for e in edges if e % 3 == 0}
    rows = [(t, r.randrange(41), r.randrange(41), 300.0 * (t % 3), t % 2 * 1.5, t % 2) for t in range(24)]
    trips = spark.createDataFrame(rows, "trip long, origin long, dest long, depart_s double, risk double, taste long")
    packed = spark.createDataFrame(list(speed.items()), "edge long, steps array<struct<kph:double,sigma:double,delay_s:double>>")
    likes = spark.createDataFrame([(1, *x) for x in liked.items()], "taste long, edge long, factor double")
    asked = (trips, packed, spark.createDataFrame(list(edges.values()), "edge long, u long, v long, len double"), spark.createDataFrame([(*k, v) for k, v in turns.items()], "edge long, next long, turn_s double"))
    # 9 regions: far fewer rounds than edges on a path
    got = {x["trip"]: x for x in rt.batch_shortest_paths(*asked, likes=likes, region_nodes=5, most_rounds=25).collect()}
    old = BY.copy(), TURNS.copy()
    try:
        BY.clear(), TURNS.clear(), BY.update(edges), TURNS.update(turns)
        want = {t: solve_with_risk(o, d, speed, depart, risk, 1.0, liked if taste else {}) for t, o, d, depart, risk, taste in rows}
    finally:
        BY.clear(), TURNS.clear(), BY.update(old[0]), TURNS.update(old[1])
    assert set(got) == {t for t, x in want.items() if x}
    assert max(len(x["edges"]) for x in got.values()) > 12
    for t, x in got.items():
        assert x["edges"] == want[t][0]
        assert [x["cost_s"], x["mean_s"], x["sd_s"]] == pytest.approx(want[t][1:], abs=1e-3)


def _street(spark, nodes):
    """A two-way street: (trips end to end and back, edges, turns, profile)."""
    edges = [(2 * k, k, k + 1, 100.0) for k in range(nodes - 1)] + [(2 * k + 1, k + 1, k, 100.0) for k in range(nodes - 1)]
    turns = [(e[0], e[0] + d, 1.0) for e in edges for d in ((2,) if e[0] % 2 == 0 else (-2,)) if 0 <= e[0] + d < 2 * nodes - 2]
    steps = F.transform(F.sequence(F.lit(0), F.lit(rt.STEPS - 1)), lambda k: F.struct((F.lit(36.0) - k % 3).alias("kph"), F.lit(0.1).alias("sigma"), F.lit(0.5).alias("delay_s")))
    rows = save(spark.createDataFrame(edges, "edge long, u long, v long, len double"), "edges")
    trips = spark.createDataFrame([(0, 0, nodes - 1), (1, nodes - 1, 0)], "trip long, origin long, dest long")
    return trips, rows, save(spark.createDataFrame(turns, "edge long, next long, turn_s double"), "turns"), save(rows.select("edge", steps.alias("steps")), "packed")


def test_long_street_in_one_round(spark):
    """A network of some thousand nodes lies in one region: one round, not one for each region crossed."""
    trips, edges, turns, packed = _street(spark, 2500)
    got = {x["trip"]: x for x in rt.batch_shortest_paths(trips, packed, edges, turns, most_rounds=1).collect()}
    assert {t: x["edges"] for t, x in got.items()} == {0: list(range(0, 4998, 2)), 1: list(range(4997, 0, -2))}
    clock = 0.0
    for k in range(2499):
        clock += 100.0 / ((36.0 - min(int(clock // rt.STEP_S), rt.STEPS - 1) % 3) / 3.6) + 0.5 + (1.0 if k else 0.0)
    assert [x["mean_s"] for x in got.values()] == [pytest.approx(clock, abs=1e-2)] * 2


def test_trips_without_a_way(spark):
    """None of the trips has a way on a one-way street, which is told without a search."""
    trips, edges, turns, packed = _street(spark, 30)
    ahead = edges.where("edge % 2 = 0")
    assert rt.batch_shortest_paths(trips.where("trip = 1"), packed, ahead, turns.where("edge % 2 = 0"), most_rounds=1).count() == 0


def test_alternatives_solve_on_one_network(spark, net, monkeypatch):
    """Profiles are packed once for all tries, and routes don't meet profiles edge by edge."""
    made = []
    whole = rt.network
    monkeypatch.setattr(rt, "network", lambda *a, **k: made.append(1) or whole(*a, **k))
    monkeypatch.setattr(rt, "evaluate_route", None)
    rt.alternative_routes(net["trips"], net["live"], net["edges"], net["turns"]).collect()
    assert len(made) == 1


def test_detours_drive_paths_side_by_side(net, monkeypatch):
    monkeypatch.setattr(rt, "evaluate_route", None)
    assert rt.congestion_detours(net["trips"], net["live"], net["frozen"], net["edges"], net["turns"], least_min=-99.0, least_km=-99.0).count() > 0


def test_baseline_drives_paths_side_by_side(net, monkeypatch):
    monkeypatch.setattr(rt, "evaluate_route", None)
    assert rt.snapshot_baseline(net["trips"], net["frozen"], net["live"], net["edges"], net["turns"]).count() > 0


def test_backtest_drives_paths_side_by_side(spark, net, monkeypatch):
    monkeypatch.setattr(rt, "evaluate_route", None)
    monkeypatch.setattr(rt, "replay_route", None)
    hot = spark.createDataFrame([(0,)], "edge long")
    assert rt.backtest_routers(net["trips"], {"a": net["live"]}, net["measured"], net["edges"], net["turns"], hot, natural="a").count() > 0


def test_driven_over_many_regions(spark):
    """Paths driven region by region cost what they cost edge by edge."""
    trips, edges, turns, packed = _street(spark, 40)
    asked = rt.as_asked(trips.withColumn("depart_s", F.col("trip") * 700.0).withColumn("turn_weight", F.lit(0.5)))
    solved = rt.batch_shortest_paths(asked, packed, edges, turns, region_nodes=7)
    want = {x["route"]: x for x in rt.evaluate_route(rt.along(solved), packed, edges, turns, asked=rt._routes_asked(asked)).collect()}
    for nodes in (7, 100):
        net = rt.network(packed, edges, turns, region_nodes=nodes)
        assert net.regions == (6 if nodes == 7 else 1)
        got = {x["trip"]: x for x in rt.driven(solved, asked, {"a": (net, rt.STEP_S)}).collect()}
        assert len(got) == len(want) == 2
        for t, x in got.items():
            assert [x["mean_s"], x["sd_s"], x["metres"], x["seconds"]] == pytest.approx([want[t]["mean_s"], want[t]["sd_s"], want[t]["metres"], want[t]["mean_s"]], abs=1e-6)


def test_alternatives(net):
    want = {}
    for trip, o, d in TRIPS:
        dear, kept = {}, []
        for _ in range(rt.TRIES):
            path = solve(o, d, LIVE, dear)
            if path is None:
                break
            if all(len(set(path) & set(x)) / len(set(path) | set(x)) <= rt.ALIKE for x in kept):
                kept.append(path)
            for e in path:
                dear[e] = dear.get(e, 1.0) * rt.DIVERSE
        want |= {(trip, k): (p, *cost(p, LIVE)) for k, p in enumerate(kept)}
    got = {(x["trip"], x["place"]): x for x in rt.alternative_routes(net["trips"], net["live"], net["edges"], net["turns"]).collect()}
    assert {k: x["edges"] for k, x in got.items()} == {k: v[0] for k, v in want.items()}
    assert max(k[1] for k in got) > 0
    for k, x in got.items():
        assert [x["mean_s"], x["sd_s"], x["metres"]] == pytest.approx(want[k][1:], abs=1e-4)
        assert (x["label"] == "Recommended") == (k[1] == 0)


def test_baseline_and_detours(net):
    frozen = {t: solve(o, d, FROZEN) for t, o, d in TRIPS}
    live = {t: solve(o, d, LIVE) for t, o, d in TRIPS}
    got = {x["trip"]: x for x in rt.snapshot_baseline(net["trips"], net["frozen"], net["live"], net["edges"], net["turns"]).collect()}
    assert set(got) == {t for t, p in frozen.items() if p}
    for t, x in got.items():
        assert x["claimed_s"] == pytest.approx(cost(frozen[t], FROZEN)[0], abs=1e-3)
        assert [x["mean_s"], x["sd_s"], x["metres"]] == pytest.approx(cost(frozen[t], LIVE), abs=1e-4)
    found = {x["trip"]: x["saved_min"] for x in rt.congestion_detours(net["trips"], net["live"], net["frozen"], net["edges"], net["turns"], least_min=-99.0, least_km=-99.0).collect()}
    minutes = lambda p: percentile(*cost(p, LIVE)[:2], 0.0) / 60
    assert found == {t: pytest.approx(minutes(frozen[t]) - minutes(live[t]), abs=1e-6) for t in frozen if t and frozen[t]}


def test_backtest(spark, net):
    hot = spark.createDataFrame([(next(p for _, o, d in TRIPS if (p := solve(o, d, FROZEN)))[0],)], "edge long")
    got = {(x["trip"], x["method"]): x for x in rt.backtest_routers(net["trips"], {"a": net["live"], "b": net["frozen"]}, net["measured"], net["edges"], net["turns"], hot, natural="b").collect()}
    solved = [t for t in TRIPS if solve(*t[1:], LIVE)]
    assert {t for t, _ in got} == {t[0] for t in solved}
    for t, o, d in solved:
        for name, speed in (("a", LIVE), ("b", FROZEN)):
            path = solve(o, d, speed)
            mean, sd, metres = cost(path, speed)
            at = 0.0
            for e in path:
                at += BY[e][3] / (SLICES[e, min(int(at // 45), 5)] / 3.6)
            x = got[t, name]
            assert [x["claimed_s"], x["promised_p90_s"], x["actual_s"], x["distance_m"]] == pytest.approx([mean, percentile(mean, sd, rt.P90), at, metres], abs=1e-4)
            assert x["disrupted"] == (hot.first()["edge"] in solve(o, d, FROZEN))


def test_leave_by(spark, net):
    paths = {t: p for t, o, d in TRIPS if (p := solve(o, d, LIVE))}
    ends = {t: (1.0, 3000.0, 900.0)[k % 3] for k, t in enumerate(paths)}
    want = {}
    for t, path in paths.items():
        lo, hi, best = 100.0, ends[t], None
        for _ in range(9):
            mid = (lo + hi) / 2
            if mid + percentile(*cost(path, LIVE, mid)[:2], rt.P90) <= ends[t]:
                lo = best = mid
            else:
                hi = mid
        want[t] = best
    routes = rt.along(spark.createDataFrame(list(paths.items()), "trip long, edges array<long>"))
    deadlines = spark.createDataFrame([(t, 100.0, x) for t, x in ends.items()], "route long, now double, deadline double")
    got = {x["route"]: x["depart_s"] for x in rt.leave_by(routes, deadlines, net["live"], net["edges"], net["turns"]).collect()}
    assert got == {t: None if x is None else pytest.approx(x) for t, x in want.items()}
    assert None in got.values()


def test_planned_departures_and_leave_by(spark, net):
    """Planned anew at every departure and at every probe."""
    rows = [(t, o, d, 1.0, 0.5) for t, o, d in TRIPS]
    trips = spark.createDataFrame(rows, "trip long, origin long, dest long, risk double, turn_weight double")
    plan = lambda o, d, depart: solve_with_risk(o, d, LIVE, depart, 1.0, 0.5, {})
    want = {(t, w): plan(o, d, 60.0 * w)[2:] for t, o, d in TRIPS for w in (0, 30) if plan(o, d, 60.0 * w)}
    got = {(x["trip"], x["wait"]): (x["median_s"], x["p90_s"]) for x in rt.planned_departures(trips, net["live"], net["edges"], net["turns"], waits=(0, 30)).collect()}
    assert got == {k: pytest.approx((percentile(*v, 0.0), percentile(*v, rt.P90)), abs=1e-3) for k, v in want.items()}
    ends = {t: (1.0, 2500.0, 700.0, 4000.0)[k] for k, (t, _, _) in enumerate(TRIPS)}
    best = {}
    for t, o, d in TRIPS:
        lo, hi, best[t] = 50.0, ends[t], None
        for _ in range(4):
            mid = (lo + hi) / 2
            found = plan(o, d, mid)
            if found is None:
                break
            if mid + percentile(*found[2:], rt.P90) <= ends[t]:
                lo = best[t] = mid
            else:
                hi = mid
    asked = spark.createDataFrame([(*row, 50.0, ends[row[0]]) for row in rows], "trip long, origin long, dest long, risk double, turn_weight double, now double, deadline double")
    found = {x["trip"]: x["depart_s"] for x in rt.leave_by_planned(asked, net["live"], net["edges"], net["turns"], probes=4).collect()}
    assert found == best and None in found.values() and any(found.values())


def test_steps_worth_saying(spark):
    rows = [
        (1, 0, "A", "Head out on", 90.0, 9.0), (1, 1, "B", "Turn left onto", 200.0, 20.0), (1, 2, "C", "Bear left onto", 40.0, 4.0), (1, 3, "B", "Bear right onto", 300.0, 30.0), (1, 4, "B", "Turn right onto", 150.0, 15.0),
        (2, 0, "A", "Head out on", 10.0, 1.0),
        (3, 0, "A", "Head out on", 500.0, 1.0), (3, 1, "D", "Make a U-turn onto", 130.0, 2.0),
    ]
    got = rt.compact_steps(spark.createDataFrame(rows, "route long, run int, name string, verb string, metres double, seconds double")).orderBy("route", "step").collect()
    end = "Arrive at your destination"
    assert [(x["route"], x["instruction"], x["metres"], x["seconds"]) for x in got] == [
        (1, "Start on B", 630.0, 63.0), (1, "Turn right to stay on B", 150.0, 15.0), (1, end, 0.0, 0.0), (2, "Start on A", 10.0, 1.0), (2, end, 0.0, 0.0), (3, "Start on A", 500.0, 1.0), (3, "Make a U-turn onto D", 130.0, 2.0), (3, end, 0.0, 0.0)
    ]
