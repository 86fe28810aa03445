"""Map tiles, the graph made of them and dense numbers, against plain Python."""

from __future__ import annotations

import collections
import math
import random

import pytest
from pyspark.sql import functions as F

from wayflow.operators import ingest
from wayflow.operators.numbering import dense_ids
from wayflow.sources import osm
from wayflow.storage import new_folder

A = """<?xml version="1.0" encoding="UTF-8"?>
<osm version="0.6">
 <bounds minlat="0" minlon="0" maxlat="1" maxlon="1"/>
 <node id="1" lat="1.0" lon="2.0" version="3"/>
 <node id="2" lat="1.1" lon="2.1"><tag k="highway" v="traffic_signals"/></node>
 <way id="10"><nd ref="1"/><nd ref="2"/><tag k="highway" v="primary"/><tag k="name" v="Strand &amp; Söhne"/></way>
 <way id="11"><nd ref="1"/><nd ref="2"/><tag k="highway" v="footway"/></way>
 <way id="12"><nd ref="1"/><nd ref="2"/><tag k="highway" v="service"/><tag k="access" v="private"/></way>
 <way id="13"><nd ref="1"/><tag k="highway" v="primary"/></way>
 <way id="14"><nd ref="2"/><nd ref="1"/></way>
</osm>"""
B = """<osm>
 <node id="2" lat="9.0" lon="9.0"/><node id="3" lat="1.2" lon="2.2"/>
 <way id="10"><nd ref="2"/><nd ref="3"/><tag k="highway" v="trunk"/></way>
 <way id="12"><nd ref="3"/><nd ref="2"/><tag k="highway" v="service"/><tag k="ref" v="A1"/><tag k="oneway" v="-1"/></way>
 <relation id="1"><member type="way" ref="10" role=""/></relation>
</osm>"""


def test_first_tile_wins(spark):
    path = new_folder(spark, "tiles")
    for name, text in (("b", B), ("a", A)):
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{path}/tile={name}")
    nodes, ways = osm.parse_osm_xml(spark, path)
    assert {tuple(r) for r in nodes.collect()} == {(1, 1.0, 2.0), (2, 1.1, 2.1), (3, 1.2, 2.2)}
    got = {r["way"]: r for r in ways.collect()}
    # the private copy of 12 doesn't keep the open one out
    assert set(got) == {10, 12} and got[10]["refs"] == [1, 2] and got[10]["name"] == "Strand & Söhne" and got[10]["highway"] == "primary"
    assert (got[12]["name"], got[12]["oneway"], got[12]["refs"]) == ("A1", "-1", [3, 2])


WAY = "way long, refs array<long>, highway string, name string, oneway string, junction string, lanes string"


def plain_graph(nodes: dict, ways: list[tuple]) -> tuple[list, set]:
    uses = collections.Counter(r for w in ways for r in [*w[1], w[1][0], w[1][-1]])
    ranks = {"primary": 2, "residential": 6, "motorway": 0}
    chunks = []
    for way, refs, hw, name, oneway, junction, lanes in ways:
        known, at, number = [r for r in refs if r in nodes], [], 0
        flag = 1 if (oneway or "").lower() in ("yes", "true", "1") else -1 if (oneway or "").lower() in ("-1", "reverse") else 1 if (junction == "roundabout" or hw == "motorway") and (oneway or "").lower() != "no" else 0
        for i, r in enumerate(known):
            at.append(r)
            if i and (uses[r] >= 2 or i == len(known) - 1):
                if at[0] != at[-1]:
                    n = int(float(lanes.split(";")[0])) if lanes else None
                    n = (n if flag else max(1, n // 2)) if n else 3 if ranks[hw] <= 1 else 2 if ranks[hw] <= 3 else 1
                    chunks.append((way, number, at if flag >= 0 else at[::-1], name, hw, flag != 0, n))
                number += 1
                at = [r]
    out = collections.defaultdict(set)
    for _, _, refs, _, _, one, _ in chunks:
        out[refs[0]].add(refs[-1])
        if not one:
            out[refs[-1]].add(refs[0])

    def reach(x):
        seen, todo = {x}, [x]
        while todo:
            for y in out[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        return seen

    every = {r for c in chunks for r in (c[2][0], c[2][-1])}
    reached = {x: reach(x) for x in every}
    parts = collections.defaultdict(set)
    for x in every:
        parts[min(y for y in reached[x] if x in reached[y])].add(x)
    inside = max(parts.items(), key=lambda p: (len(p[1]), -p[0]))[1]
    kept = sorted(c for c in chunks if c[2][0] in inside and c[2][-1] in inside)
    ids = {x: i for i, x in enumerate(sorted({r for c in kept for r in (c[2][0], c[2][-1])}))}
    rows = []
    for way, number, refs, name, hw, one, n in kept:
        first = len(rows)
        p = [nodes[r] for r in refs]
        length = 0.0
        for (a, b), (c, d) in zip(p, p[1:], strict=False):
            h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
            length += 2 * 6371008.8 * math.asin(min(1.0, math.sqrt(h)))
        length = round(max(length, 1.0), 2)
        rows.append((first, ids[refs[0]], ids[refs[-1]], way, number, name, hw, pytest.approx(length, abs=0.011), n, one, None if one else first + 1))
        if not one:
            rows.append((first + 1, ids[refs[-1]], ids[refs[0]], way, number, name, hw, pytest.approx(length, abs=0.011), n, one, first))
    return rows, {(i, x) for x, i in ids.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_graph_as_plain_python(spark, seed):
    r = random.Random(seed)
    nodes = {10 * k: (51 + r.random() / 50, r.random() / 50) for k in range(30)}
    ways = []
    for w in range(26):
        refs = [10 * r.randrange(30) for _ in range(r.randrange(2, 7))]
        refs = [x for i, x in enumerate(refs) if i == 0 or refs[i - 1] != x]
        if len(refs) > 1:
            refs = refs + [999] * (w % 5 == 0)
            ways.append((w, refs, r.choice(["primary", "residential", "motorway"]), f"w{w}", r.choice([None, None, "yes", "-1", "no", "reverse"]), r.choice([None, "roundabout"]), r.choice([None, "3", "4;2", "2.5"])))
    ways.append((900, [5000, 5010], "primary", "apart", None, None, None))
    nodes |= {5000: (10.0, 10.0), 5010: (10.0, 10.1)}
    want, ids = plain_graph(nodes, ways)
    given = spark.createDataFrame([(k, *v) for k, v in nodes.items()], "node long, lat double, lon double")
    found, edges = ingest.build_graph(given, spark.createDataFrame(ways, WAY).repartition(3))
    assert {(x["id"], x["node"]) for x in found.collect()} == ids
    got = [tuple(x)[:11] for x in edges.orderBy("edge").collect()]
    assert len(got) == len(want) > 10 and all(a == b for a, b in zip(got, want, strict=True))


def test_dense_ids(spark):
    rows = spark.range(1000).repartition(7).select((F.col("id") * 37 % 1000).alias("k"), (F.col("id") % 3).alias("n"))
    got = dense_ids(rows, ("k",), "i").orderBy("k").collect()
    assert [x["i"] for x in got] == list(range(1000))
    same = dense_ids(rows.select(F.lit(1).alias("k")), ("k",), "i").collect()
    assert sorted(x["i"] for x in same) == list(range(1000))
    assert dense_ids(rows.where("k < 0"), ("k",), "i").count() == 0
