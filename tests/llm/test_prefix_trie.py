"""The trie of conversations against plain dictionaries."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayflow.llm import prefix_trie
from wayflow.llm.parens import Parens

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows: list[tuple]) -> set[tuple]:
    turns = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            r, t = role or "", text or ""
            turns[conv].append((turn is not None, turn or 0, hashlib.sha256(f"{len(r)}:{r}{t}".encode()).digest()[:16], (r, t)))
    original = {c: [x[3] for x in sorted(ts)] for c, ts in turns.items()}
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c, own in original.items():
        h = zlib.crc32(str(c).encode()) % 6
        path = (original.get(c - int(math.fmod(c, 100)), [])[:h]) + own[h:]
        ends[tuple(path)].append(c)
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    children, leaves, saved = collections.Counter(), collections.Counter(), collections.Counter()
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, of in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(of) - 1) * len(node[-1][1]) if node else 0
    digest = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return {
        (min(of), len(node), min(members[node[:-1]]) if node else None, len(of), children[node], leaves[node], saved[node], digest(ends.get(node, [])))
        for node, of in members.items()
    }


def conversations(seed: int) -> list[tuple]:
    r = random.Random(seed)
    said = [("user", "hello " * k) for k in range(4)] + [("assistant", "naïve 😀"), (None, "x"), ("system", None), ("", "")]
    rows = []
    for c in [*range(0, 260), *range(500, 530), -3, -100, -105]:
        for turn in range(r.choice([0, 1, 1, 2, 3, 5, 9])):
            rows.append((c, turn, *r.choice(said[: r.choice([2, 8])])))
    for c in range(300, 400):  # copies and long common beginnings
        rows += [(c, turn, "user", "same") for turn in range(12)] + [(c, 12 + k, "user", f"own {c % 7}") for k in range(c % 4)]
    rows += [(40, None, "user", "no number"), (40, None, "user", "no number"), (41, 1, "user", "tie"), (41, 1, "user", "tie"), (41, 1, "bot", "tie"), (None, 1, "user", "nobody")]
    rows += [(700 + c, t, "user", f"turn {t if t < 30 + c % 3 * 9 else (c, t)}") for c in range(9) for t in range(45 - c)]
    return rows


def said(df) -> set[tuple]:
    found = [tuple(r) for r in df.collect()]
    assert len(found) == len(set(found))
    return set(found)


@pytest.mark.parametrize(("level", "nodes"), [(128, 1 << 17), (128, 40), (4, 1 << 17), (3, 25)])
def test_as_plain_dictionaries(spark, monkeypatch, level, nodes):
    """One shard or many; whole conversations or segments of a few turns."""
    monkeypatch.setattr(prefix_trie, "LEVEL", level)
    monkeypatch.setattr(prefix_trie, "SHARD_NODES", nodes)
    rows = conversations(level + nodes)
    turns = spark.createDataFrame(rows, SCHEMA).repartition(4).withColumns({"pos": F.lit("clash"), "key": F.lit(1), "shard": F.lit(2)})
    assert said(prefix_trie.prefix_trie(turns)) == plain(rows)


def test_edges(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(7, 0, None, None)]  # borrows from a conversation that isn't there
    assert said(prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == plain(rows)


def test_long_lists_of_ids(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "_CHUNK", 10)
    rows = [(c, t, "user", "same") for c in range(1000, 1400) for t in range(7)]
    assert said(prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(3))) == plain(rows)


def test_find_close():
    r = random.Random(2)
    for n in (1, 2, 50, 5000):
        bits, depth = [], 0
        while len(bits) < 2 * n:
            opening = depth == 0 or (r.random() < 0.55 and bits.count(1) < n)
            opening = opening and sum(bits) < n
            bits.append(int(opening))
            depth += 1 if opening else -1
        want, stack = {}, []
        for i, b in enumerate(bits):
            if b:
                stack.append(i)
            else:
                want[stack.pop()] = i
        trie = Parens(np.array(bits, np.int8))
        assert trie.find_close(trie.opens).tolist() == [want[i] for i in trie.opens.tolist()]
