"""Reproducible draws of trips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import save
from .numbering import dense_ids

# Share of trips between landmarks, least and most metres, least metres between landmarks, tries before the fallback.
LANDMARK_SHARE, LEAST_M, MOST_M, NEAR_M, MOST_TRIES = 0.65, 1800.0, 7000.0, 400.0, 240
CELL_M = 500.0


def _draw(seed: int, role: str, below: Column) -> Column:
    """A number from 0 to ``below`` - 1, the same for the same seed, role, trip and try whatever the partitions."""
    return F.pmod(F.xxhash64("trip", "attempt", F.lit(seed), F.lit(role)), below.cast("long"))


def _rings(nodes: DataFrame, least_m: float, most_m: float) -> tuple[DataFrame, DataFrame]:
    """(cell, total, ring) with the occupied cells that may hold nodes in the distance band, each with the sum of their sizes so far, and (cell, place, node, x, y)."""
    cell = F.struct(F.floor(F.col("x") / CELL_M).alias("cx"), F.floor(F.col("y") / CELL_M).alias("cy"))
    placed = save(nodes.select("node", "x", "y", cell.alias("cell")).withColumn("place", F.row_number().over(Window.partitionBy("cell").orderBy("node")) - 1), "cells")
    sizes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    steps = int(most_m // CELL_M) + 1
    far = range(-steps, steps + 1)
    # nearest and farthest two points of cells so far apart
    gap = lambda d: max(abs(d) - 1, 0) * CELL_M
    around = [(dx, dy) for dx in far for dy in far if (gap(dx) ** 2 + gap(dy) ** 2) ** 0.5 <= most_m and (((abs(dx) + 1) ** 2 + (abs(dy) + 1) ** 2) ** 0.5) * CELL_M >= least_m]
    offsets = nodes.sparkSession.createDataFrame(around, "dx long, dy long")
    met = sizes.select("cell").crossJoin(F.broadcast(offsets)).select("cell", F.struct((F.col("cell.cx") + F.col("dx")).alias("cx"), (F.col("cell.cy") + F.col("dy")).alias("cy")).alias("to"))
    found = met.join(sizes.withColumnRenamed("cell", "to"), "to").withColumn("upto", F.sum("n").over(Window.partitionBy("cell").orderBy("to").rowsBetween(Window.unboundedPreceding, 0)))
    ring = found.groupBy("cell").agg(F.max("upto").alias("total"), F.array_sort(F.collect_list(F.struct("upto", "n", "to"))).alias("ring"))
    return save(ring, "rings"), placed


def sample_od_pairs(spark: SparkSession, nodes: DataFrame, landmarks: DataFrame, trips: int, seed: int, share: float = LANDMARK_SHARE, least_m: float = LEAST_M, most_m: float = MOST_M, near_m: float = NEAR_M) -> DataFrame:
    """(trip, origin, dest, metres, between_landmarks) of ``trips`` trips a commuter might make; equal for equal seeds.

    A share is between two landmarks (node) more than ``near_m`` apart or in the band; the others start at any node and end at one whose distance
    lies in the band. Ends are looked up by number: landmarks by their dense number, other ends by the occupied grid cells around the start, by size, and a place in the
    cell; so a try costs lookups, never a join of all pairs. What misses the band (cells at its edge) tries again, MOST_TRIES times, then takes the first and the last node.
    With under four landmarks all trips are of the other kind. ``nodes``: (node, x, y) in metres.
    """
    known = save(dense_ids(nodes.select("node", "x", "y"), ("node",), "id"), "nodes")
    marks = save(dense_ids(landmarks.select("node").distinct().join(known.select("node", "x", "y"), "node"), ("node",), "id"), "landmarks")
    n, m = known.count(), marks.count()
    if n < 2:
        return known.select(F.col("id").alias("trip"), F.col("node").alias("origin"), F.col("node").alias("dest"), F.lit(0.0).alias("metres"), F.lit(False).alias("between_landmarks")).where("false")
    rings, placed = _rings(known, least_m, most_m)
    kind = F.pmod(F.xxhash64("trip", F.lit(seed), F.lit("kind")), F.lit(1_000_000)) < F.lit(int(share * 1_000_000) if m >= 4 else 0)
    left = save(spark.range(trips).select(F.col("id").alias("trip")).withColumn("between", kind), "trips")
    end = lambda df, to: df.select(F.col("id").alias(f"{to}_id"), F.col("node").alias(to), F.col("x").alias(f"{to}_x"), F.col("y").alias(f"{to}_y"))
    metres = F.sqrt(F.pow(F.col("origin_x") - F.col("dest_x"), 2) + F.pow(F.col("origin_y") - F.col("dest_y"), 2))
    done, tried = None, 0
    while tried < MOST_TRIES and not left.isEmpty():
        # few tries at first, as most succeed
        tries = min(4 if not tried else 40, MOST_TRIES - tried)
        asked = left.withColumn("attempt", F.explode(F.sequence(F.lit(tried), F.lit(tried + tries - 1))))
        tried += tries
        two = asked.where("between").withColumns({"origin_id": _draw(seed, "origin", F.lit(max(m, 1))), "dest_id": _draw(seed, "dest", F.lit(max(m, 1)))})
        two = two.where("origin_id <> dest_id").join(end(marks, "origin"), "origin_id").join(end(marks, "dest"), "dest_id")
        one = asked.where("not between").withColumn("origin_id", _draw(seed, "origin", F.lit(n))).join(end(known, "origin"), "origin_id")
        # rings are long arrays that unpack to many times their file: never broadcast
        one = one.withColumn("cell", F.struct(F.floor(F.col("origin_x") / CELL_M).alias("cx"), F.floor(F.col("origin_y") / CELL_M).alias("cy"))).join(rings.hint("merge"), "cell").withColumn("u", _draw(seed, "dest", F.col("total")))
        hit = F.get(F.filter("ring", lambda r: r["upto"] > F.col("u")), F.lit(0))
        one = one.withColumn("hit", hit).select("trip", "between", "attempt", "origin", "origin_x", "origin_y", F.col("hit.to").alias("cell"), (F.col("u") - F.col("hit.upto") + F.col("hit.n")).alias("place"))
        one = one.join(placed.select("cell", F.col("place").cast("long").alias("place"), F.col("node").alias("dest"), F.col("x").alias("dest_x"), F.col("y").alias("dest_y")), ["cell", "place"])
        columns = ("trip", "between", "attempt", "origin", "dest", "origin_x", "origin_y", "dest_x", "dest_y")
        met = two.select(*columns).unionByName(one.select(*columns)).withColumn("metres", metres)
        good = met.where((F.col("origin") != F.col("dest")) & (F.col("metres").between(least_m, most_m) | (F.col("between") & (F.col("metres") > near_m))))
        first = save(good.groupBy("trip").agg(F.min_by(F.struct("origin", "dest", "metres", "between"), "attempt").alias("b")).select("trip", "b.*"), "drawn")
        done = first if done is None else done.unionByName(first)
        left = save(left.join(first, "trip", "left_anti"), "left")
    ends = end(known.where("id = 0"), "origin").crossJoin(end(known.where(F.col("id") == n - 1), "dest")).withColumn("metres", metres)
    rest = left.crossJoin(F.broadcast(ends.select("origin", "dest", "metres"))).select("trip", "origin", "dest", "metres", F.lit(False).alias("between"))
    whole = rest if done is None else done.unionByName(rest)
    return whole.withColumnRenamed("between", "between_landmarks")
