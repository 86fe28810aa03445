"""Plans that decide what large tables cost."""

from __future__ import annotations

from wayflow.operators import numbering
from wayflow.operators import routes as rt
from wayflow.operators import validation as va


def test_pairs_shuffle_once_for_both_times(spark):
    """Expected counts of a pair's two times come with one join by sensor; another for each time and level would shuffle all pairs four times."""
    pairs = spark.createDataFrame([(1, 0.0, 1800.0), (2, 0.0, 0.0), (3, 0.0, 0.0)], "camera_id long, t0 double, t1 double")
    profile = spark.createDataFrame([(1, 0, 5.0, 0), (1, None, 6.0, 1), (2, None, 7.0, 1), (None, None, 8.0, 3)], "camera_id long, bucket int, mean_count double, level int")
    found = va.expected_pairs(pairs, profile)
    assert sorted((r["camera_id"], r["h_now"], r["h_then"]) for r in found.collect()) == [(1, 5.0, 6.0), (2, 7.0, 7.0), (3, 8.0, 8.0)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") <= 3


def test_matches_lie_in_one_bucket_or_two(spark):
    """Matches on both edges of the tolerance are found, and the earlier wins."""
    rows = spark.createDataFrame([(1, k, 10.0 * k, float(k)) for k in range(60)], "camera_id long, event_id long, t double, count_mean double")
    got = {r["event_id"]: r["t1"] for r in va.nearest_after_join(rows, 105.0, 5.0).collect()}
    assert got == {k: 10.0 * k + 100 for k in range(50)}


def test_steps_in_tasks_of_bounded_size(spark, monkeypatch):
    """A task of compact_steps holds so many rows, however many routes there are, and the rows are gone through once: the arrivals come with the last steps."""
    monkeypatch.setattr(numbering.dealt_by, "__defaults__", (500,))
    rows = spark.range(8000).selectExpr("id div 4 as route", "cast(id % 4 as int) as run", "concat('Road ', id % 3) as name", "'Turn left onto' as verb", "200D as metres", "20D as seconds")
    found = rt.compact_steps(rows)
    sizes = [r["n"] for r in found.selectExpr("spark_partition_id() as p").groupBy("p").agg({"*": "count"}).toDF("p", "n").collect()]
    assert sum(sizes) == 10_000 and len(sizes) == 16 and max(sizes) < 1250
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (") == 1 and "Union" not in plan
