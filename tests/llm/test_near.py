"""Near duplicates: groups whose members are near each other but far from their bucket's pivot, and recall against brute force."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from wayflow.llm import near_dedup
from wayflow.llm.hyperminhash import band_keys, estimate, registers
from wayflow.llm.words import shingle_sets

SCHEMA = "doc_id long, text string"


def test_many_near_each_other_and_far_from_the_pivot(spark):
    """5,000 distinct texts within .75 of a hidden base, of which the least id shares only a passage."""
    r = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    rows = [(0, " ".join(base[:70] + [f"own{i}" for i in range(50)]))]
    for i in range(1, 5001):
        words = base[:]
        words[r.randrange(120)] = f"new{i}"
        rows.append((i, " ".join(words)))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(4))
    assert {(x["component_id"], x["count"]) for x in got.groupBy("component_id").count().collect()} == {(0, 1), (1, 5000)}


def test_tiles_of_a_large_bucket(spark, monkeypatch):
    """Blocks of few classes give the same links as one block."""
    r, rows = random.Random(9), []
    for g in range(12):
        base = [f"g{g}_{i}" if i > 60 else f"common{i}" for i in range(110)]
        for k in range(20):
            words = base[:]
            words[r.randrange(110)] = f"n{g}_{k}"
            rows.append((100 * g + k, " ".join(words)))
    table = spark.createDataFrame(rows, SCHEMA)
    want = {i: 100 * (i // 100) for i, _ in rows}
    assert {x["doc_id"]: x["component_id"] for x in near_dedup.near_duplicates(table).collect()} == want
    for name in ("BLOCK", "SET_BLOCK", "STAR_BLOCK"):
        monkeypatch.setattr(near_dedup, name, 3)
    assert {x["doc_id"]: x["component_id"] for x in near_dedup.near_duplicates(table).collect()} == want


def test_no_pair_at_the_threshold_is_lost():
    """Of 1,500 pairs at or just over .75 none is lost by bands, sizes or estimate."""
    r, width, lost, seen = random.Random(7), near_dedup.WIDTH, 0, 0
    while seen < 1500:
        n = r.choice((8, 30, 120, 400))
        both = -(-75 * n // 100)
        extra = n - both  # union n, intersection both
        cut = r.randrange(extra + 1)
        ids = np.array([r.getrandbits(64) for _ in range(n)], np.uint64)
        a, b = np.sort(ids[: both + cut]), np.sort(np.concatenate([ids[:both], ids[both + cut :]]))
        regs = np.stack([registers(a, width), registers(b, width)])
        keys = band_keys(regs, near_dedup.BANDS)
        near = estimate(np.array([(regs[0] == regs[1]).sum()]), np.array([len(a)]), np.array([len(b)]), width)[0]
        lost += not ((keys[0] == keys[1]).any() and near >= 0.75 - near_dedup.MARGIN and 100 * min(len(a), len(b)) >= 75 * max(len(a), len(b)))
        seen += 1
    assert lost == 0


def test_shared_counts():
    r = np.random.Generator(np.random.PCG64(2))
    sets = [np.unique(r.integers(0, 50, n).astype(np.uint64)) for n in (1, 5, 30, 49, 2)]
    for x in sets:
        assert near_dedup._shared(x, sets).tolist() == [len(np.intersect1d(x, y)) for y in sets]


def test_one_document_of_megabytes(spark):
    words = " ".join(f"w{i}" for i in range(400_000))
    rows = [(1, words), (2, words + " tail"), (3, None), (4, ""), (4, "x y z")]
    got = sorted((x["doc_id"], x["n_shingles"], x["component_id"]) for x in near_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(1, 399_996, 1), (2, 399_997, 1), (3, 0, 3), (4, 0, 4), (4, 1, 4)]
    assert len(list(shingle_sets(pa.array([None, "a"])))) == 2


def test_clashing_columns(spark):
    rows = [(i, "the same five words here again" + " x" * (i % 2)) for i in range(6)]
    names = ("id", "node", "n", "a", "b", "band", "key", "lo", "hi", "pivot", "component", "text_a", "component_id", "n_shingles", "kept", "digest", "regs")
    table = spark.createDataFrame(rows, SCHEMA).withColumns({n: F.lit(7) for n in names})
    assert {x["doc_id"]: x["component_id"] for x in near_dedup.near_duplicates(table).collect()} == {i: i % 2 for i in range(6)}
