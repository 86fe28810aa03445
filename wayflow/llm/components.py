"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import save


def _checksum(edges: DataFrame) -> tuple[int, int]:
    n, total = edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b") % 1_000_003), F.lit(0))).first()
    return n, total


def _step(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: each node's larger neighbours go to its least one. Small star: each node and its smaller neighbours do."""
    pairs = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = save(pairs.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("least")), "least")
    met = pairs.join(least, "a")
    if large:
        moved = met.where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        moved = met.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(least.select("a", F.col("least").alias("b")))
    return moved.where("a <> b").distinct()


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of all nodes in ``edges`` (a, b); a component is named by its least node.

    Each round is written to the shared folder; the number of rounds grows with the logarithm of the
    longest chain. A node with many edges is reduced before the shuffle and its join can be split.
    """
    now = save(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    seen = _checksum(now)
    for _ in range(most_rounds):
        if not seen[0]:
            break
        now = save(_step(_step(now, large=True), large=False), "edges")
        before, seen = seen, _checksum(now)
        if before == seen:
            break
    else:
        raise RuntimeError(f"no fixed point after {most_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
