"""Fingerprints against the generalised Jaccard similarity itself, for short and long texts."""

from __future__ import annotations

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayflow.llm import fingerprints

SCHEMA = "doc_id long, text string"


def similarity(a: str, b: str) -> float:
    x, y = (collections.Counter(t.lower().split()) for t in (a, b))
    return sum((x & y).values()) / sum((x | y).values())


@pytest.mark.parametrize(("n", "pairs"), [(3, 400), (30, 400), (3000, 60)])
def test_no_bias_at_any_length(spark, n, pairs):
    """Words of uneven frequency, as in prose; the second text takes over a part of the first and repeats some words more often."""
    r = random.Random(n)
    words = [f"w{i}" for i in range(4 * n)]
    odds = [1 / (i + 1) for i in range(4 * n)]
    rows, want = [], []
    for i in range(pairs):
        a = r.choices(words, odds, k=n)
        b = a[: r.randrange(n + 1)] + r.choices(words, odds, k=r.randrange(1, n))
        rows.append((i, " ".join(a), " ".join(b)))
        want.append(similarity(rows[-1][1], rows[-1][2]))
    table = spark.createDataFrame(rows, "key long, a string, b string")
    printed = fingerprints.fingerprints(table, ["key"], ["a", "b"])
    got = {x["key"]: x["near"] for x in printed.select("key", fingerprints.likeness(F.col("a"), F.col("b")).alias("near")).collect()}
    want = np.array(want)
    errors = np.array([got[i] for i in range(pairs)]) - want
    spread = np.sqrt((want * (1 - want)).mean() / fingerprints.SAMPLES)
    print(n, round(errors.mean(), 4), round(errors.std(), 4), round(spread, 4))
    assert abs(errors.mean()) < 4 * spread / np.sqrt(pairs) + 0.001 and errors.std() < 1.25 * spread + 0.005


def test_weights_decide(spark):
    """One word ten times against once: the samples' share is that of the weights, not that of the sets."""
    rows = [(i, f"a{i} " * 10 + f"b{i}", f"a{i} b{i}") for i in range(400)]
    printed = fingerprints.fingerprints(spark.createDataFrame(rows, "key long, a string, b string"), ["key"], ["a", "b"])
    got = [x[0] for x in printed.select(fingerprints.likeness(F.col("a"), F.col("b"))).collect()]
    assert np.mean(got) == pytest.approx(2 / 11, abs=0.015)


def test_defined_cases(spark):
    rows = [(5, "one two two"), (5, "one two two"), (4, None), (3, ""), (None, "lost"), (2, "x " * 50_000), (1, "x")]
    table = spark.createDataFrame(rows, SCHEMA).withColumns({n: F.lit(3) for n in ("key", "row", "n", "word", "form", "k", "lead", "print", "part", "next", "of")})
    got = [x.asDict() for x in fingerprints.edited_fingerprints(table).collect()]
    assert sorted(str(x["doc_id"]) for x in got) == sorted(str(i) for i, _ in rows)
    by = {x["doc_id"]: x for x in got}
    assert by[4]["fingerprint"] == by[3]["fingerprint"] == "" and by[4]["near_next"] == 1.0 and by[3]["near_next"] == 0.0
    twice = [x["fingerprint"] for x in got if x["doc_id"] == 5]
    assert len(set(twice)) == 1 and len(twice[0]) == 4 * fingerprints.SAMPLES
    assert by[None]["n_chars"] == 4 and by[2]["n_chars"] == 100_000
    assert fingerprints.edited_fingerprints(table.limit(0)).count() == 0
