"""Feedback of users with many votes, dealt over tasks, against a plain fold."""

from __future__ import annotations

import random
from decimal import ROUND_HALF_UP, Decimal

import pytest

from wayflow.operators import routes as rt


def plain(rows: list[tuple]) -> dict:
    bias, risk, seen = {}, {}, set()
    for user, seq, name, share, up in sorted(rows):
        now = bias.get((user, name), 1.0)
        new = min(max(now + (-0.32 if up else 0.32) * share, 0.6), 1.8)
        bias[user, name] = float(Decimal(str(new)).quantize(Decimal("0.001"), ROUND_HALF_UP)) if abs(new - now) > 1e-3 else now
        if (user, seq) not in seen:
            seen.add((user, seq))
            risk[user] = min(max(risk.get(user, 0.8) + (-0.04 if up else 0.12), 0.0), 2.5)
    return {k: (v, pytest.approx(risk[k[0]]), sum(u == k[0] for u, _ in seen)) for k, v in bias.items()}


def test_hot_user_as_plain_fold(spark):
    r = random.Random(5)
    rows = []
    for seq in range(3000):
        user = 7 if seq % 3 else r.randrange(40)
        up = r.random() < 0.6
        rows += [(user, seq, name, round(r.random(), r.choice([1, 2, 6])) * r.choice([1, 0.003]), up) for name in r.sample(["Strand", "Mall", "Rue É"], r.randrange(1, 3))]
    votes = spark.createDataFrame(rows, "user_id long, seq long, name string, share double, up boolean")
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(x["user_id"], x["name"]): (x["bias"], x["risk"], x["trips"]) for x in rt.learn_feedback(votes.repartition(4)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])
    want = plain(rows)
    assert got.keys() == want.keys()
    assert all(got[k] == (pytest.approx(v[0], abs=1e-9), v[1], v[2]) for k, v in want.items())
    assert rt.learn_feedback(votes.where("false")).count() == 0
