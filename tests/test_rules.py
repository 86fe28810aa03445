"""Small exact cases and properties of the sensing operators."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from wayflow.functions import traffic as tf
from wayflow.operators import nowcast as nc
from wayflow.operators import readings as op
from wayflow.operators import roads as ro


def value(spark, c):
    return spark.range(1).select(c.alias("v")).first()["v"]


@pytest.mark.parametrize(("count", "tracks", "moving", "quiet", "busy", "want"), [(0, 0, 0.0, None, None, None), (1, 1, 0.0, None, None, None), (14, 12, 0.0, None, None, 1.0), (14, 12, 1.0, None, None, 0.0), (7, 5, 0.4, 2.0, 12.0, 0.555)])
def test_congestion_abstains_or_says(spark, count, tracks, moving, quiet, busy, want):
    lit = lambda x: F.lit(x).cast("double")
    got = value(spark, tf.reading_to_congestion(lit(count), F.lit(tracks), lit(moving), lit(quiet), lit(busy)))
    assert got == (None if want is None else pytest.approx(want))


def test_levels_percentiles_delay(spark):
    assert [value(spark, tf.traffic_level(F.lit(x))) for x in (1.0, 0.7, 0.5, 0.2)] == [0, 1, 2, 3]
    assert value(spark, tf.eta_percentile(F.lit(600.0), F.lit(120.0), 0.0)) == pytest.approx(588.348405)
    assert value(spark, tf.haversine_m(F.lit(51.5), F.lit(-0.10), F.lit(51.5), F.lit(-0.12))) == pytest.approx(1384.411295, abs=1e-5)
    assert value(spark, tf.junction_delay(F.lit(20.902040), F.lit(50.0), F.lit(1.0))) == pytest.approx(66.749230, abs=1e-4)


def test_clock(spark):
    for text, want in (("18:45", 67500), ("8:05am", 29100), ("7pm", 68400), ("0845", 31500), ("soon", 32400), ("9h30", 34200), ("at 9:30", 34200), ("9 30", 34200), ("12am", 0), ("99:99", 86340)):
        assert value(spark, tf.parse_clock(F.lit(text))) == want


def test_sound_key(spark):
    keys = {value(spark, tf.sound_key(F.lit(x))) for x in ("Parkk Sirkus", "park sirkus", "Parksircus", "Park Circus")}
    assert len(keys) == 1
    for text, want in (("shahid", "shahid"), ("dhaka", "dhaka"), ("budh", "bud"), ("phil rick", "filrik"), ("Circe Quay", "sirsekuay"), ("chowringhee", "khowringhe")):
        assert value(spark, tf.sound_key(F.lit(text))) == want


def test_names(spark):
    for text, want in (("Café Royal", "cafe royal"), ("Zürich", "zurich"), ("Stra\u00dfe", "strae"), ("e\u0301tude", "etude"), ("\ufb01eld \u00bd", "field 12"), ("a - b", "a   b"), ("\u09aa\u09be\u09b0\u09cd\u0995, 7?", "7"), ("\u09aa\u09be\u09b0\u09cd\u0995!", "\u09aa\u09be\u09b0\u09cd\u0995"), ("", ""), (None, "")):
        assert value(spark, tf.normalise_name(F.lit(text).cast("string"))) == want


def test_incident_envelope(spark):
    from wayflow.operators import trips as tr

    for u, want in ((0.0, 0.0), (0.06, 0.5), (0.12, 1.0), (0.56, 1 - 0.5**1.4), (1.0, 0.0)):
        assert value(spark, tr.incident_envelope(F.lit(100.0 + 1000 * u), F.lit(100.0), F.lit(1000.0))) == pytest.approx(want)


def test_feedback_and_preference(spark):
    from wayflow.operators import routes as rt

    votes = [(1, 1, "A", 0.75, True), (1, 1, "B", 0.25, True), (1, 2, "A", 1.0, False), (2, 1, "C", 0.001, False)]
    got = {(r["user_id"], r["name"]): (r["bias"], round(r["risk"], 6), r["trips"]) for r in rt.learn_feedback(spark.createDataFrame(votes, "user_id long, seq long, name string, share double, up boolean")).collect()}
    assert got == {(1, "A"): (1.08, 0.88, 2), (1, "B"): (0.92, 0.88, 2), (2, "C"): (1.0, 0.92, 1)}
    edges = spark.createDataFrame([(1, 7, "lane"), (2, 3, "A"), (3, 6, "x")], "edge long, rank int, name string")
    users = spark.createDataFrame([(1, 1.0, 0.5, 0.2, {"A": 1.08})], "user_id long, avoid_narrow double, prefer_arterial double, size_penalty double, road_bias map<string,double>")
    asked = spark.createDataFrame([(1, 1), (1, 2), (1, 3)], "user_id long, edge long")
    got = {r["edge"]: round(r["factor"], 6) for r in rt.edge_preference(asked, edges, users).collect()}
    assert got == {1: 2.22, 2: 0.9828, 3: 1.85}


def test_fused_anomaly_and_memory(spark):
    joined = spark.createDataFrame([(1, 7, 0.8, math.log(0.5))], "camera_id long, edge long, w double, log_ratio double")
    r = nc.nowcast_fuse(joined).first()
    assert (r["support"], r["anomaly"]) == (pytest.approx(0.727273, abs=1e-6), pytest.approx(0.604045, abs=1e-6))
    ticks = spark.createDataFrame([(1, t, s, 0.5) for t, s in ((1, 0.5), (2, 0.0), (3, 0.0))], "edge long, tick int, support double, anomaly double")
    assert nc.temporal_memory(ticks).orderBy("tick").collect()[-1]["memory"] == pytest.approx(0.6302, abs=1e-4)


def test_strong_components_as_brute_force(spark):
    for seed in range(2):
        r = random.Random(seed)
        arcs = {(r.randrange(20), r.randrange(20)) for _ in range(40)}
        arcs = {(a, b) for a, b in arcs if a != b}
        reach = {n: {n} for e in arcs for n in e}
        for _ in range(20):
            for a, b in arcs:
                reach[a] |= reach[b]
        want = {n: min(m for m in reach[n] if n in reach[m]) for n in reach}
        got = {x["node"]: x["component"] for x in ro.strong_components(spark.createDataFrame(sorted(arcs), "u long, v long")).collect()}
        assert got == want


def test_strong_components_in_blocks(spark, monkeypatch):
    """A street of many crossings in ranges of a few arcs; random arcs, too, whose ranges hold little of a component. A long street takes no rounds of colouring."""
    street = {(k, k + 1) for k in range(120)} | {(k + 1, k) for k in range(120) if k not in (40, 90)}
    for arcs, block in ((street, 16), *(({(r.randrange(30), r.randrange(30)) for _ in range(55)}, 8) for r in map(random.Random, range(1)))):
        arcs = {(a, b) for a, b in arcs if a != b}
        reach = {n: {n} for e in arcs for n in e}
        while any(len(reach[a]) < len(reach[a] | reach[b]) for a, b in arcs):
            for a, b in arcs:
                reach[a] |= reach[b]
        want = {n: min(m for m in reach[n] if n in reach[m]) for n in reach}
        if arcs == street:
            monkeypatch.setattr(ro, "_coloured", None)
        got = {x["node"]: x["component"] for x in ro.strong_components(spark.createDataFrame(sorted(arcs), "u long, v long"), block=block).collect()}
        monkeypatch.undo()
        assert got == want


def test_greedy_rounds_equal_the_scan(spark):
    r = random.Random(3)
    rows = [(i, float(r.randrange(20))) for i in range(40)]
    near = {(a, b) for a in range(40) for b in range(40) if a != b and abs(a - b) <= 2}
    taken = []
    for i, _ in sorted(rows, key=lambda x: (-x[1], x[0])):
        if not any((i, j) in near for j in taken):
            taken.append(i)
    got = ro.spaced_greedy_select(spark.createDataFrame(rows, "id long, value double"), spark.createDataFrame(sorted(near), "a long, b long"), 8)
    assert [x["id"] for x in got.collect()] == taken[:8]


def test_greedy_rounds_that_run_out(spark):
    rows = [(i, float(-i)) for i in range(9)]
    chain = spark.createDataFrame([(a, b) for a in range(9) for b in (a - 1, a + 1) if 0 <= b < 9], "a long, b long")
    table = spark.createDataFrame(rows, "id long, value double")
    assert [x["id"] for x in ro.spaced_greedy_select(table, chain, 9).collect()] == [0, 2, 4, 6, 8]
    with pytest.raises(RuntimeError):
        ro.spaced_greedy_select(table, chain, 9, most_rounds=2)


def test_chosen_edges_as_the_scan(spark):
    """The registered query against the sequential scan of all edges, by distance between middles."""
    from wayflow.plans import roads as rr
    from wayflow.plans.registry import QUERIES

    path = "/root/testdata/sf0.01"
    edges = rr.xy_edges(spark, path).collect()
    ways = {}
    for e in edges:
        ways[e["u"]] = ways.get(e["u"], 0) + 1
    worth = [1.00, 0.95, 0.90, 0.78, 0.60, 0.42, 0.30, 0.18, 0.10]
    value = {e["edge"]: worth[min(max(e["rank"], 0), 8)] * (0.55 + 0.45 * min(ways.get(e["v"], 0) / 4.0, 1.6)) * min(max(e["len"] / 140.0, 0.3), 1.0) for e in edges}
    middle = {e["edge"]: ((e["x1"] + e["x2"]) / 2, (e["y1"] + e["y2"]) / 2) for e in edges}
    twin = {e["edge"]: e["twin"] for e in edges}
    want = []
    for i in sorted(value, key=lambda i: (-value[i], i)):
        if len(want) < 40 and all(twin[j] != i and math.dist(middle[i], middle[j]) >= 150 for j in want):
            want.append(i)
    got = QUERIES["spaced_greedy_select"](spark, path).collect()
    assert [x["id"] for x in got] == want
    assert [x["value"] for x in got] == pytest.approx([value[i] for i in want])


def test_runs_of_an_empty_log(spark):
    empty = spark.createDataFrame([], "camera_id long, event_id long, t double, count_mean double, tracks int, moving_frac double")
    assert op.collection_runs(empty, 10.0).count() == 0
    assert op.dense_hour_series(empty).count() == 0
    assert op.longest_run_crop(empty, 10.0).count() == 0


def test_batch_paths_equal_dijkstra(spark):
    """Time-dependent costs on a small random graph, edge by edge."""
    import heapq

    from wayflow.operators import routes as rt

    r = random.Random(9)
    edges = [(i, r.randrange(8), r.randrange(8), 100.0 + r.randrange(400)) for i in range(26)]
    edges = [e for e in edges if e[1] != e[2]]
    speed = {e[0]: [5.0 + r.randrange(60) for _ in range(rt.STEPS)] for e in edges}
    turns = [(a[0], b[0], float(r.randrange(0, 9))) for a in edges for b in edges if a[2] == b[1]]

    def drive(e, t):
        return round(e[3] / (speed[e[0]][min(int(t // rt.STEP_S), rt.STEPS - 1)] / 3.6), 6)

    by = {e[0]: e for e in edges}
    want = {}
    for trip, (o, d) in enumerate([(0, 5), (1, 7), (3, 2), (6, 4)]):
        best, heap = {}, [(drive(e, 0.0), e[0]) for e in edges if e[1] == o]
        heapq.heapify(heap)
        while heap:
            c, e = heapq.heappop(heap)
            if e in best:
                continue
            best[e] = c
            for a, b, s in turns:
                if a == e and b not in best:
                    heapq.heappush(heap, (c + s + drive(by[b], c), b))
        ends = [c for e, c in best.items() if by[e][2] == d]
        if ends:
            want[trip] = min(ends)
    packed = spark.createDataFrame([(i, [(k, 0.1, 0.0) for k in s]) for i, s in speed.items()], "edge long, steps array<struct<kph:double,sigma:double,delay_s:double>>")
    got = rt.batch_shortest_paths(
        spark.createDataFrame([(0, 0, 5), (1, 1, 7), (2, 3, 2), (3, 6, 4)], "trip long, origin long, dest long"), packed, spark.createDataFrame(edges, "edge long, u long, v long, len double"), spark.createDataFrame(turns, "edge long, next long, turn_s double")
    ).collect()
    assert {x["trip"]: pytest.approx(x["cost_s"], abs=1e-3) for x in got} == want
    for x in got:
        assert all(by[a][2] == by[b][1] for a, b in zip(x["edges"], x["edges"][1:], strict=False))
