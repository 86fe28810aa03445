"""Streaming forms of the reading operators, on a readings stream with an event time ``ts``."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState

from ..operators import nowcast as nc
from ..operators import readings as op
from ..schema import LEAST_SUPPORT, MEMORY, STALE_S
from ..storage import forget, new_folder

#: What a nowcast takes of a reading.
READING = ("camera_id", "event_id", "t", "count_mean", "tracks", "moving_frac")


def stream_latest(stream: DataFrame) -> DataFrame:
    """Newest reading of each sensor; state is one row a sensor. Complete or update mode."""
    best = F.max_by(F.struct("event_id", "t", "count_mean", "tracks"), F.struct(F.col("t"), -F.col("event_id")))
    return stream.groupBy("camera_id").agg(best.alias("r")).select("camera_id", "r.event_id", "r.t", "r.count_mean", "r.tracks")


def stream_tick_counts(stream: DataFrame, width: str = "5 minutes", late: str = "1 hour") -> DataFrame:
    """Readings of each sensor by tumbling window; windows older than the watermark leave the state."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "camera_id").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "camera_id", "n")


def stream_runs(stream: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    """Unbroken runs of each sensor: closed by a pause of more than ``gap``."""
    runs = stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "camera_id")
    return runs.agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("first"), F.max("t").alias("last")).select("camera_id", "n", "first", "last")


def replay_stream(stream: DataFrame, clock: float) -> DataFrame:
    """Only what was known at a moment."""
    return stream.where(F.col("t") <= clock)


def stream_late_drop(stream: DataFrame, late: str) -> DataFrame:
    """Each reading once, unless it comes when the watermark (the latest time seen in earlier batches, less ``late``) has passed it: then it is dropped.

    The state holds ids of readings that the watermark has not passed, and no others.
    """
    return stream.withWatermark("ts", late).dropDuplicates(["event_id", "ts"])


def stream_memory(stream: DataFrame, late: str, idle_s: float) -> DataFrame:
    """(edge, tick, memory) of rows (edge, tick, support, anomaly, ts): the last supported anomaly, faded by the ticks since, carried from batch to batch.

    State is one pair of numbers an edge. It leaves once the watermark is ``idle_s`` past the edge's last row: what is remembered has faded by then, and an
    edge that comes back starts at 1. Ticks of an edge have to come in order from batch to batch; within a batch they are sorted.
    """

    def fade(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        memory, at = state.get if state.exists else (1.0, None)
        rows = pd.concat(list(parts)).sort_values("tick")
        out = []
        for tick, support, anomaly in zip(rows["tick"].tolist(), rows["support"].tolist(), rows["anomaly"].tolist(), strict=True):
            memory = anomaly if support > LEAST_SUPPORT else 1 + (memory - 1) * MEMORY ** (tick - at if at is not None else 0)
            at = tick
            out.append((key[0], tick, memory))
        state.update((memory, at))
        state.setTimeoutTimestamp(max(int(rows["ts"].max().timestamp() * 1000 + idle_s * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["edge", "tick", "memory"])

    keyed = stream.withWatermark("ts", late).groupBy("edge")
    return keyed.applyInPandasWithState(fade, "edge long, tick int, memory double", "memory double, tick int", "append", "EventTimeTimeout")


def memory_stream(stream: DataFrame, folder: str, late_s: float, idle_s: float) -> DataStreamWriter:
    """``stream_memory`` with its state in tables: ``folder``/rows/batch=k has (edge, tick, memory) of micro-batch k, ``folder``/state/batch=k a row an edge (edge, memory, tick, ts).

    A batch's rows and the state before it are faded in one window an edge, in columns, however many edges there are. An edge's state leaves once the watermark (the latest time
    seen in earlier batches, less ``late_s``) is ``idle_s`` past its last row. A batch that runs again reads the state of the one before and replaces its own.
    """
    spark = stream.sparkSession
    at = lambda kind, number: f"{folder}/{kind}/batch={number}"

    def fade(batch: DataFrame, number: int) -> None:
        # what an edge remembers is a supported row at its last tick
        rows = batch.select("edge", "tick", F.when(F.col("support") > LEAST_SUPPORT, F.col("anomaly")).alias("told"), "ts", F.lit(True).alias("new"))
        if number:
            held = spark.read.parquet(at("state", number - 1))
            seen = spark.read.parquet(at("mark", number - 1))
            passed = F.unix_micros("ts") + F.lit(int(idle_s * 1_000_000)) > F.unix_micros("top") - F.lit(int(late_s * 1_000_000))
            kept = held.crossJoin(F.broadcast(seen)).where(F.col("top").isNull() | passed)
            rows = rows.unionByName(kept.select("edge", "tick", F.col("memory").alias("told"), "ts", F.lit(False).alias("new")))
        w = Window.partitionBy("edge").orderBy("tick", "new").rowsBetween(Window.unboundedPreceding, 0)
        last = F.last(F.when(F.col("told").isNotNull(), F.struct("told", F.col("tick").alias("at"))), ignorenulls=True).over(w)
        memory = F.coalesce(1 + (F.col("last.told") - 1) * F.pow(F.lit(MEMORY), F.col("tick") - F.col("last.at")), F.lit(1.0))
        rows.withColumn("last", last).select("edge", "tick", memory.alias("memory"), "ts", "new").write.mode("overwrite").parquet(at("faded", number))
        faded = spark.read.parquet(at("faded", number))
        faded.where("new").select("edge", "tick", "memory").write.mode("overwrite").parquet(at("rows", number))
        newest = faded.groupBy("edge").agg(F.max_by(F.struct("memory", "tick"), F.struct("tick", "new")).alias("s"), F.max("ts").alias("ts"))
        newest.select("edge", "s.memory", "s.tick", "ts").write.mode("overwrite").parquet(at("state", number))
        tops = batch.select("ts") if not number else batch.select("ts").unionByName(seen.select(F.col("top").alias("ts")))
        tops.agg(F.max("ts").alias("top")).write.mode("overwrite").parquet(at("mark", number))
        for kind, back in (("faded", 0), ("state", 2), ("mark", 2)):
            if number >= back:
                forget(spark, at(kind, number - back))

    return stream.writeStream.foreachBatch(fade).option("checkpointLocation", f"{folder}/progress")


def nowcast_stream(stream: DataFrame, folder: str, baselines: DataFrame, free: DataFrame, expected: DataFrame, kernel: DataFrame, stale_s: float = STALE_S, keep: int | None = None) -> DataStreamWriter:
    """The network's state, anew with every micro-batch of readings: ``folder``/state/batch=k has a row for each edge after tick k.

    A tick folds the batch into the newest reading of each sensor, turns those that are fresh at the newest moment seen into observations, and
    estimates the state from them and the memory that the tick before left. What is carried on, one row a sensor and one an edge, lies in tables named
    by batch: a batch that runs again after a failure, or a query that goes on from its checkpoint, reads those of the batch before and
    replaces its own. Spent tables of readings go; states go after ``keep`` ticks, if that is given.
    """
    spark = stream.sparkSession
    at = lambda kind, number: f"{folder}/{kind}/batch={number}"

    def tick(batch: DataFrame, number: int) -> None:
        rows = batch.select(*READING)
        memory = None
        if number:
            rows = rows.unionByName(spark.read.parquet(at("latest", number - 1)))
            memory = spark.read.parquet(at("state", number - 1)).select("edge", "memory")
        op.latest_reading_asof(rows).write.mode("overwrite").parquet(at("latest", number))
        latest = spark.read.parquet(at("latest", number))
        clock = latest.agg(F.max("t").alias("now"))
        known = op.with_congestion(latest, baselines).crossJoin(F.broadcast(clock))
        seen = nc.one_per_edge(nc.observed_ratio(op.reading_to_observation(known, free, F.col("now"), stale_s), expected))
        state = nc.nowcast_state(expected, nc.nowcast_fuse(nc.observation_kernel_join(seen, kernel)), seen, memory)
        state.withColumn("tick", F.lit(number)).write.mode("overwrite").parquet(at("state", number))
        if number > 1:
            forget(spark, at("latest", number - 2))
        if keep is not None and number >= keep:
            forget(spark, at("state", number - keep))

    return stream.writeStream.foreachBatch(tick).option("checkpointLocation", f"{folder}/progress")


def in_ticks(rows: DataFrame, ticks: int, start: Callable[[DataFrame], DataStreamWriter], first: int = 0, inbox: str | None = None) -> str:
    """Feeds rows with a column ``tick`` (0 to ``ticks`` - 1) to a stream, a tick at a time, and returns the folder they came through.

    For each tick its files are put into the inbox, and the query goes on from its checkpoint until it has read them: one micro-batch a tick.
    """
    spark = rows.sparkSession
    inbox = inbox or new_folder(spark, "inbox")
    for k in range(first, ticks):
        rows.where(F.col("tick") == k).drop("tick").write.mode("append").parquet(inbox)
        start(spark.readStream.schema(rows.drop("tick").schema).parquet(inbox)).trigger(availableNow=True).start().awaitTermination()
    return inbox


def batches_of(folder: str, mode: str = "append") -> Callable[[DataFrame], DataStreamWriter]:
    """Writes each micro-batch of a stream as a table of its own, ``folder``/rows/batch=k; a batch that runs again replaces itself."""

    def start(stream: DataFrame) -> DataStreamWriter:
        put = lambda batch, number: batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")
        return stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{folder}/progress")

    return start


def drain(stream: DataFrame, mode: str, tag: str) -> DataFrame:
    """Runs a query over all that is there now and returns its result: the last state in complete mode, else all rows.

    Every batch is written under its own number, so a batch that runs again after a failure replaces itself.
    """
    spark = stream.sparkSession
    base = new_folder(spark, tag)
    seen: list[int] = []

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/rows/batch={number}")
        seen.append(number)

    query = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{base}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    if not seen:
        return spark.createDataFrame([], stream.schema)
    paths = [f"{base}/rows/batch={n}" for n in (seen[-1:] if mode == "complete" else sorted(set(seen)))]
    return spark.read.schema(stream.schema).parquet(*paths)
