"""State that is carried over micro-batches: equal to batch operators after every tick, through restarts and failures, and gone by timeout."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from wayflow.operators import nowcast as nc
from wayflow.operators import readings as op
from wayflow.plans import streams
from wayflow.storage import new_folder
from wayflow.streaming import readings as st

MEMORY_SCHEMA = "edge long, tick int, support double, anomaly double, ts timestamp"


def stamped(df):
    return df.withColumn("ts", F.timestamp_micros(((F.col("t") + 1_000_000) * 1_000_000).cast("long")))


def test_memory_as_the_batch_operator(spark):
    r = random.Random(1)
    rows = [(e, k, r.choice([0.0, 0.01, 0.4]), 0.5 + r.random(), float(60 * k)) for e in range(9) for k in range(30) if r.random() < 0.8]
    ticks = stamped(spark.createDataFrame(rows, "edge long, own int, support double, anomaly double, t double"))
    folder = new_folder(spark, "memory")
    start = lambda s: st.batches_of(folder)(st.stream_memory(s.withColumnRenamed("own", "tick"), "1 minute", 1e6))
    st.in_ticks(ticks.withColumn("tick", F.floor(F.col("own") / 3).cast("int")), 10, start)
    want = {(x["edge"], x["tick"]): x["memory"] for x in nc.temporal_memory(ticks.withColumnRenamed("own", "tick")).collect()}
    got = {(x["edge"], x["tick"]): x["memory"] for x in spark.read.parquet(f"{folder}/rows").collect()}
    assert sorted(want.keys() - got.keys()) == []
    assert got == pytest.approx(want)


def test_memory_leaves_by_timeout(spark):
    """Edge 1 is silent while edge 2 moves the watermark on; when it comes back its memory is gone. Edge 3 comes back in time."""
    rows = [(1, 0, 0.5, 2.0, 0.0), (3, 0, 0.5, 2.0, 0.0)]
    rows += [(2, k, 0.0, 1.0, 1000.0 * k) for k in range(6)] + [(1, 5, 0.0, 1.0, 5000.0), (3, 1, 0.0, 1.0, 1000.0), (3, 5, 0.0, 1.0, 5000.0)]
    ticks = stamped(spark.createDataFrame(rows, "edge long, own int, support double, anomaly double, t double"))
    for idle, first in ((1500.0, 1.0), (1e6, 1 + 0.86**5)):
        folder = new_folder(spark, "memory")
        start = lambda s, idle=idle, folder=folder: st.batches_of(folder)(st.stream_memory(s.withColumnRenamed("own", "tick"), "1 second", idle))
        st.in_ticks(ticks.withColumn("tick", F.col("own")), 6, start)
        got = {(x["edge"], x["tick"]): x["memory"] for x in spark.read.parquet(f"{folder}/rows").collect()}
        assert got[1, 5] == pytest.approx(first) and got[3, 1] == pytest.approx(1 + 0.86)


def test_memory_in_tables(spark):
    """The form with state in tables, without a call of Python an edge: equal to the batch operator where nothing is idle, and rid of edge 1 after its timeout."""
    rows = [(1, 0, 0.5, 2.0, 0.0), (3, 0, 0.5, 2.0, 0.0)]
    rows += [(2, k, 0.0, 1.0, 1000.0 * k) for k in range(6)] + [(1, 5, 0.0, 1.0, 5000.0), (3, 1, 0.0, 1.0, 1000.0), (3, 5, 0.0, 1.0, 5000.0)]
    ticks = stamped(spark.createDataFrame(rows, "edge long, own int, support double, anomaly double, t double"))
    for idle, first in ((1500.0, 1.0), (1e6, 1 + 0.86**5)):
        folder = new_folder(spark, "memory")
        start = lambda s, idle=idle, folder=folder: st.memory_stream(s.withColumnRenamed("own", "tick"), folder, 1.0, idle)
        st.in_ticks(ticks.withColumn("tick", F.col("own")), 6, start)
        got = {(x["edge"], x["tick"]): x["memory"] for x in spark.read.parquet(f"{folder}/rows").collect()}
        assert len(got) == len(rows) and got[1, 5] == pytest.approx(first) and got[3, 1] == pytest.approx(1 + 0.86)
    assert got == pytest.approx({(x["edge"], x["tick"]): x["memory"] for x in nc.temporal_memory(ticks.withColumnRenamed("own", "tick")).collect()})


def test_late_readings_are_dropped(spark):
    rows = [(k, 1000.0 * k, k) for k in range(6)] + [(100, 100.0, 1), (101, 100.0, 5), (102, 3500.0, 5), (0, 0.0, 0), (3, 3000.0, 4)]
    arriving = stamped(spark.createDataFrame(rows, "event_id long, t double, tick int"))
    folder = new_folder(spark, "late")
    st.in_ticks(arriving, 6, lambda s: st.batches_of(folder)(st.stream_late_drop(s, "2000 seconds")))
    got = sorted(x["event_id"] for x in spark.read.parquet(f"{folder}/rows").collect())
    assert got == [0, 1, 2, 3, 4, 5, 100, 102]  # 101 is behind the watermark, repeats of 0 and 3 are known


@pytest.fixture(scope="module")
def network(spark):
    edges = spark.createDataFrame([(1, 50.0, 10.0), (2, 40.0, 8.0), (3, 30.0, 6.0)], "edge long, kph double, len double")
    free = spark.createDataFrame([(10, 1, 50.0), (20, 2, 40.0)], "camera_id long, edge long, kph double")
    kernel = spark.createDataFrame([(10, 1, 1.0), (10, 2, 0.5), (20, 2, 1.0), (20, 3, 0.4)], "camera_id long, edge long, weight double")
    baselines = spark.createDataFrame([(10, 1.0, 5.0), (20, 1.0, 5.0)], "camera_id long, quiet double, busy double")
    return baselines, free, edges.select("edge", F.col("kph").alias("hist")), kernel


def readings(spark):
    r = random.Random(4)
    rows = [(c, 100 * c + k, 60.0 * k, float(r.randrange(7)), r.randrange(6), r.random(), k // 2) for c in (10, 20) for k in range(10) if not (c == 20 and 4 <= k < 8)]
    return spark.createDataFrame(rows, "camera_id long, event_id long, t double, count_mean double, tracks int, moving_frac double, tick int")


def by_batch(spark, rows, network, stale: float) -> dict:
    baselines, free, expected, kernel = network
    memory, out = None, {}
    for tick in range(5):
        latest = op.latest_reading_asof(rows.where(F.col("tick") <= tick).drop("tick"))
        now = latest.agg(F.max("t")).first()[0]
        seen = nc.one_per_edge(nc.observed_ratio(op.reading_to_observation(op.with_congestion(latest, baselines), free, F.lit(now), stale), expected))
        state = nc.nowcast_state(expected, nc.nowcast_fuse(nc.observation_kernel_join(seen, kernel)), seen, memory)
        got = state.collect()
        memory = spark.createDataFrame([(x["edge"], x["memory"]) for x in got], "edge long, memory double")
        out |= {(tick, x["edge"]): (x["kph"], x["memory"], x["support"], x["observed"]) for x in got}
    return out


def states(spark, folder: str) -> dict:
    return {(x["tick"], x["edge"]): (x["kph"], x["memory"], x["support"], x["observed"]) for x in spark.read.parquet(f"{folder}/state").collect()}


def test_nowcast_as_batch_after_every_tick(spark, network):
    """Also when the query is stopped and another goes on from its checkpoint, and when a batch fails halfway and runs again."""
    rows = readings(spark)
    want = by_batch(spark, rows, network, 150.0)
    folder = new_folder(spark, "nowcast")
    start = lambda s: st.nowcast_stream(s, folder, *network, stale_s=150.0)
    inbox = st.in_ticks(rows, 3, start)
    assert states(spark, folder) == {k: pytest.approx(v) for k, v in want.items() if k[0] < 3}
    broken = network[:3] + (network[3].withColumn("weight", F.raise_error(F.lit("lost"))),)
    with pytest.raises(Exception, match="lost"):
        st.in_ticks(rows, 4, lambda s: st.nowcast_stream(s, folder, *broken, stale_s=150.0), first=3, inbox=inbox)
    spark.readStream.schema(rows.drop("tick").schema).parquet(inbox)
    again = st.nowcast_stream(spark.readStream.schema(rows.drop("tick").schema).parquet(inbox), folder, *network, stale_s=150.0)
    again.trigger(availableNow=True).start().awaitTermination()
    st.in_ticks(rows, 5, start, first=4, inbox=inbox)
    assert states(spark, folder) == {k: pytest.approx(v) for k, v in want.items()}


def test_spent_tables_go(spark, network):
    folder = new_folder(spark, "nowcast")
    st.in_ticks(readings(spark), 5, lambda s: st.nowcast_stream(s, folder, *network, stale_s=150.0, keep=2))
    there = lambda kind: sorted(x for x in os.listdir(f"{folder.removeprefix('file://')}/{kind}") if x.startswith("batch="))
    assert there("latest") == ["batch=3", "batch=4"] and there("state") == ["batch=3", "batch=4"]


@pytest.mark.parametrize("name, columns", [("stream_nowcast", set(st.READING)), ("stream_memory", {"edge", "own", "support", "anomaly", "ts"}), ("stream_late_drop", {"camera_id", "event_id", "t", "ts", "came"})])
def test_a_tick_reads_its_own_rows(spark, monkeypatch, name, columns):
    """No tick reads the rows of the others, makes a window over all or carries columns that nothing asks for; and no row is lost or in two ticks."""

    class Fed(Exception):
        pass

    def fed(rows, ticks, start):
        raise Fed(rows)

    monkeypatch.setattr(st, "in_ticks", fed)
    with pytest.raises(Fed) as got:
        getattr(streams, name)(spark, "/root/testdata/sf0.001")
    rows = got.value.args[0]
    assert set(rows.columns) == columns | {"tick"}
    a_file = rows.groupBy(F.input_file_name()).agg(F.count_distinct("tick").alias("ticks")).collect()
    assert a_file and all(x["ticks"] == 1 for x in a_file)
    plan = rows.where(F.col("tick") == 3)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(tick" in plan and "Window" not in plan
    assert sum(rows.where(F.col("tick") == k).count() for k in range(streams.TICKS)) == spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()
