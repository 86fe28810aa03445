"""From observations of a few edges to the state of all, and its projection forward."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import traffic as tf
from ..schema import CORRIDOR_M, LEAST_KPH, LEAST_SUPPORT, LEAST_WEIGHT, MEMORY, OWN_ROAD_FACTOR, PRIOR_WEIGHT, RANK_FACTOR, REACH_M, RESIDUAL_TAU_S, SIGMA_FLOOR, SIGMA_GROWTH
from .roads import corridor_costs


def corridor_kernel(watch: DataFrame, edges: DataFrame, reach_m: float = REACH_M) -> DataFrame:
    """(camera_id, edge, weight): how far a sensor on (camera_id, edge) speaks for other edges."""
    costs = corridor_costs(watch, edges, reach_m)
    own = watch.join(edges.select("edge", F.col("name").alias("own_name"), F.col("rank").alias("own_rank")), "edge").select("camera_id", "own_name", "own_rank")
    met = costs.join(edges.select("edge", "name", "rank"), "edge").join(own, "camera_id")
    w = F.exp(-F.col("metres") / CORRIDOR_M) * F.pow(F.lit(RANK_FACTOR), F.abs(F.col("rank") - F.col("own_rank")))
    same = (F.col("name") == F.col("own_name")) & (F.col("own_name") != "")
    return met.select("camera_id", "edge", F.when(same, F.least(F.lit(1.0), w * OWN_ROAD_FACTOR)).otherwise(w).alias("weight")).where(F.col("weight") >= LEAST_WEIGHT)


def observation_kernel_join(observations: DataFrame, kernel: DataFrame) -> DataFrame:
    """(camera_id, seen, edge, w, log_ratio): each observation at every edge it speaks for; observations have ``ratio`` and confidence."""
    o = observations.select("camera_id", F.ln("ratio").alias("log_ratio"), "confidence")
    return kernel.join(o, "camera_id").select("camera_id", "edge", (F.col("weight") * F.col("confidence")).alias("w"), "log_ratio")


def nowcast_fuse(joined: DataFrame) -> DataFrame:
    """(edge, support, anomaly): weighted mean of log ratios, drawn to 1 where support is thin."""
    sums = joined.groupBy("edge").agg(F.sum(F.col("w") * F.col("log_ratio")).alias("num"), F.sum("w").alias("den"))
    support = F.col("den") / (F.col("den") + PRIOR_WEIGHT)
    return sums.select("edge", support.alias("support"), F.exp(F.col("num") / F.greatest("den", F.lit(1e-9)) * support).alias("anomaly"))


def observed_ratio(observations: DataFrame, expected: DataFrame) -> DataFrame:
    """Observations with ``ratio`` of their speed to the expected one (edge, hist), clipped."""
    met = observations.join(expected.select("edge", F.greatest("hist", F.lit(LEAST_KPH)).alias("hist")), "edge")
    return met.withColumn("ratio", tf.clip(F.col("speed_kph") / F.col("hist"), 0.12, 2.2))


def one_per_edge(observations: DataFrame) -> DataFrame:
    """Of several observations of an edge that of the least sensor."""
    columns = [c for c in observations.columns if c not in ("edge", "camera_id")]
    return observations.groupBy("edge").agg(F.min_by(F.struct("camera_id", *columns), "camera_id").alias("o")).select("edge", "o.*")


def nowcast_state(expected: DataFrame, fused: DataFrame, observations: DataFrame, memory: DataFrame | None = None, prior_sigma: float = 0.16) -> DataFrame:
    """Per edge: kph, anomaly, sigma, support, queue_m, observed, and the memory for the next tick (from before observed edges are pinned)."""
    mem = memory if memory is not None else expected.select("edge", F.lit(1.0).alias("memory"))
    o = observations.select("edge", F.col("speed_kph").alias("o_kph"), F.col("confidence").alias("o_conf"), F.col("queue_m").alias("o_queue"))
    met = expected.select("edge", F.greatest("hist", F.lit(LEAST_KPH)).alias("hist")).join(fused, "edge", "left").join(o, "edge", "left").join(mem, "edge", "left")
    support = F.coalesce("support", F.lit(0.0))
    faded = 1 + (F.coalesce("memory", F.lit(1.0)) - 1) * MEMORY
    believed = F.when(support > LEAST_SUPPORT, F.coalesce("anomaly", F.lit(1.0))).otherwise(faded)
    seen = F.col("o_kph").isNotNull()
    free = F.greatest(F.col("hist") * F.col("believed"), F.lit(LEAST_KPH))
    trust = tf.clip(F.col("o_conf"), 0.0, 1.0)
    kph = F.when(seen, F.greatest(F.col("o_kph") * trust + free * (1 - trust), F.lit(LEAST_KPH))).otherwise(free)
    sigma = F.when(seen, SIGMA_FLOOR + 0.05 * (1 - F.col("o_conf"))).otherwise(prior_sigma * (1 - 0.72 * F.col("s")) + SIGMA_FLOOR)
    made = met.select("*", support.alias("s"), believed.alias("believed")).select("edge", "hist", kph.alias("kph"), sigma.alias("sigma"), F.col("s").alias("support"), F.coalesce("o_queue", F.lit(0.0)).alias("queue_m"), seen.alias("observed"), F.col("believed").alias("memory"))
    return made.withColumn("anomaly", tf.clip(F.col("kph") / F.col("hist"), 0.08, 2.4))


def temporal_memory(ticks: DataFrame) -> DataFrame:
    """(edge, tick, memory) from (edge, tick, support, anomaly): the last supported anomaly, faded by the ticks since.

    The closed form of the tick-by-tick rule: ``1 + (a - 1) * MEMORY ** n``.
    """
    w = Window.partitionBy("edge").orderBy("tick").rowsBetween(Window.unboundedPreceding, 0)
    fresh = F.col("support") > LEAST_SUPPORT
    last = F.last(F.when(fresh, F.struct("anomaly", F.col("tick").alias("at"))), ignorenulls=True).over(w)
    memory = F.coalesce(1 + (F.col("last.anomaly") - 1) * F.pow(F.lit(MEMORY), F.col("tick") - F.col("last.at")), F.lit(1.0))
    return ticks.withColumn("last", last).select("edge", "tick", memory.alias("memory"))


def kernel_reach(kernel: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: share of edges, and of main roads, that sensors say something of."""
    reach = kernel.groupBy("edge").agg(F.sum("weight").alias("reach"))
    met = edges.select("edge", "rank").join(reach, "edge", "left")
    known = (F.coalesce("reach", F.lit(0.0)) > LEAST_WEIGHT).cast("double")
    return met.agg(F.count(F.lit(1)).alias("edges"), F.sum(known).cast("bigint").alias("inferable"), (100 * F.avg(known)).alias("pct"), (100 * F.avg(F.when(F.col("rank") <= 3, known))).alias("pct_main"))


def sensor_coverage(watch: DataFrame, edges: DataFrame) -> DataFrame:
    seen = watch.select("edge").distinct().withColumn("seen", F.lit(1.0))
    met = edges.select("edge", "rank", "len").join(seen, "edge", "left").withColumn("seen", F.coalesce("seen", F.lit(0.0)))
    return met.agg(F.sum("seen").cast("bigint").alias("watched"), (100 * F.avg("seen")).alias("pct"), (100 * F.avg(F.when(F.col("rank") <= 3, F.col("seen")))).alias("pct_main"), (F.sum(F.col("len") * F.col("seen")) / 1000).alias("km"))


def network_stats(state: DataFrame, edges: DataFrame) -> DataFrame:
    met = state.join(edges.select("edge", F.col("kph").alias("free"), "rank"), "edge")
    jam = (tf.edge_congestion(F.col("kph"), F.col("free")) > 0.55).cast("double")
    return met.agg(
        F.avg("kph").alias("mean_kph"), F.avg(F.when(F.col("rank") <= 3, F.col("kph"))).alias("main_kph"), (100 * F.avg(jam)).alias("pct_congested"),
        F.sum(F.col("observed").cast("int")).cast("bigint").alias("reporting"), (100 * F.avg((F.col("support") > LEAST_SUPPORT).cast("double"))).alias("pct_informed"),
    )


def road_report(state: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, mean_kph, free_kph, watched, mood) over the edges at a node."""
    at = edges.select("edge", F.col("kph").alias("free"), F.explode(F.array("u", "v")).alias("node"))
    grouped = state.join(at, "edge").groupBy("node").agg(F.avg("kph").alias("mean_kph"), F.avg("free").alias("free_kph"), F.sum(F.col("observed").cast("int")).cast("bigint").alias("watched"))
    return grouped.withColumn("mood", tf.mood(F.round(F.col("mean_kph") / F.col("free_kph"), 6)))


def expected_speed(edges: DataFrame, congestion: Column) -> DataFrame:
    """(edge, hist): free flow less the usual congestion, of which minor roads get a part."""
    c = congestion * F.when(F.col("rank") <= 3, 1.0).otherwise(0.6)
    return edges.select("edge", F.greatest(F.lit(LEAST_KPH), F.col("kph") * (1 - 0.8 * c)).alias("hist"))


def forecast_profile(state: DataFrame, edges: DataFrame, steps: int = 46, step_s: float = 120.0, kind: str = "forecast") -> DataFrame:
    """(edge, step, kph, sigma, delay_s). ``state`` has hist, anomaly, sigma; ``edges`` kph and junction weight.

    Kinds: ``forecast`` relaxes the anomaly to 1, ``snapshot`` freezes it, ``historical`` has none, ``free`` is free flow without delays.
    """
    met = state.select("edge", "hist", "anomaly", "sigma").join(edges.select("edge", F.col("kph").alias("free"), "weight"), "edge").withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    dt = F.col("step") * step_s
    a = tf.clip(F.col("anomaly"), 0.12, 2.2)
    kph = {"forecast": F.greatest(F.col("hist") * (1 + (a - 1) * F.exp(-dt / RESIDUAL_TAU_S)), F.lit(LEAST_KPH)), "snapshot": F.greatest(F.col("hist") * a, F.lit(LEAST_KPH)), "historical": F.col("hist"), "free": F.col("free")}[kind]
    grown = F.col("sigma") + SIGMA_GROWTH * dt / 600 if kind == "forecast" else F.col("sigma")
    sigma = F.lit(0.22) if kind in ("historical", "free") else tf.clip(grown, SIGMA_FLOOR, 0.55)
    delay = F.lit(0.0) if kind == "free" else tf.junction_delay(F.col("v"), F.col("free"), F.col("weight"))
    return met.withColumn("v", kph).select("edge", "step", F.col("v").alias("kph"), sigma.alias("sigma"), delay.alias("delay_s"))


def personalise_profile(profile: DataFrame, edges: DataFrame, users: DataFrame, asked: DataFrame) -> DataFrame:
    """(user_id, edge, step, kph, delay_s) of the edges asked for (user_id, edge): riders that filter through gain where it is congested; nobody passes 1.05 x free flow."""
    wanted = asked.join(users.select("user_id", "bonus", "skill"), "user_id").join(edges.select("edge", F.col("kph").alias("free")), "edge")
    met = profile.join(wanted, "edge")
    gain = (1 + F.col("bonus") * F.pow(tf.edge_congestion(F.col("kph"), F.col("free")), 1.5)) * F.col("skill")
    return met.select("user_id", "edge", "step", F.least(F.col("kph") * gain, F.col("free") * 1.05).alias("kph"), (F.col("delay_s") * (1 - 0.45 * F.col("bonus"))).alias("delay_s"))


def pack(profile: DataFrame) -> DataFrame:
    """(edge, steps): a profile's steps in order in one array a row, for lookups by step."""
    return profile.groupBy("edge").agg(F.transform(F.array_sort(F.collect_list(F.struct("step", "kph", "sigma", "delay_s"))), lambda s: F.struct(s["kph"], s["sigma"], s["delay_s"])).alias("steps"))
