"""Quantiles by rounds of histograms against sorting, and verdicts on departures."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayflow.operators import quantiles, trips


@pytest.mark.parametrize("few", [1, 50])
def test_as_numpy(spark, monkeypatch, few):
    """Ties, one value, skewed and huge values, negative ones, nulls and a null group."""
    monkeypatch.setattr(quantiles, "FEW", few)
    monkeypatch.setattr(quantiles, "BUCKETS", 8)
    r = random.Random(3)
    groups = {
        "ties": [r.randrange(4) / 2 for _ in range(301)],
        "one": [7.25],
        "same": [3.5] * 100,
        "skewed": [2.0 ** r.randrange(-40, 60) for _ in range(150)],
        "plain": [r.gauss(0, 1000) for _ in range(400)],
        None: [float(k) for k in range(10)],
    }
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("plain", None), ("empty", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    got = {(x["g"], x["share"]): x["quantile"] for x in quantiles.exact_quantiles(df, "x", ("g",), (0.0, 0.2, 0.5, 0.85, 1.0)).collect()}
    assert got == {(k, q): pytest.approx(float(np.quantile(vs, q))) for k, vs in groups.items() for q in (0.0, 0.2, 0.5, 0.85, 1.0)}
    upper = {x["g"]: x["quantile"] for x in quantiles.exact_quantiles(df, "x", ("g",), (0.5,), upper=True).collect()}
    assert upper == {k: sorted(vs)[len(vs) // 2] for k, vs in groups.items()}
    whole = quantiles.exact_quantiles(df, "x", (), (0.5,)).collect()
    assert [x["quantile"] for x in whole] == [pytest.approx(float(np.median([v for vs in groups.values() for v in vs])))]
    assert quantiles.exact_quantiles(df.where("false"), "x", ("g",), (0.5,)).count() == 0


def test_verdicts(spark):
    rows = [(1, 0, 1200.0), (1, 15, 900.0), (2, 0, 3000.0), (2, 30, 900.0), (3, 0, 600.0), (3, 15, 590.0), (4, 0, 600.0), (4, 15, 600.0)]
    costed = spark.createDataFrame(rows, "trip long, wait int, median_s double").withColumn("p90_s", F.col("median_s") * 1.5)
    got = {x["trip"]: tuple(x)[1:] for x in trips.go_now_or_wait(costed).collect()}
    assert got == {
        1: (0, 15, 1200.0, 1800.0, 5, 10, "now, though the drive would be shorter"),
        2: (30, 30, 3000.0, 4500.0, 35, -5, "wait"),
        3: (0, 15, 600.0, 900.0, 0, 15, "now"),
        4: (0, 0, 600.0, 900.0, 0, 0, "now"),
    }
