"""From map ways to a routable graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import traffic as tf
from ..schema import DEFAULT_CLASS, ROAD_CLASSES
from ..storage import save
from .numbering import dense_ids
from .roads import junction_nodes, largest_scc, split_ways


def cut_edges(nodes: DataFrame, ways: DataFrame) -> DataFrame:
    """(way, chunk, u, v, points, len, name, hw, oneway, lanes): ways cut at junctions, in their direction of travel.

    Points that the extract lacks drop out of a way after junctions are found. Length is at least a metre.
    """
    cut = save(junction_nodes(ways).select("node"), "junctions")
    where = nodes.select("node", F.struct("lat", "lon").alias("at"))
    known = ways.select("way", F.posexplode("refs").alias("pos", "node")).join(where.select("node"), "node")
    kept = known.groupBy("way").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "node"))), lambda x: x["node"]).alias("refs")).where(F.size("refs") >= 2)
    chunks = save(split_ways(kept, cut), "chunks")
    points = chunks.select("way", "chunk", F.posexplode("refs").alias("pos", "node")).join(where, "node")
    lines = points.groupBy("way", "chunk").agg(F.array_sort(F.collect_list(F.struct("pos", "node", "at"))).alias("p"))
    legs = F.zip_with(F.slice("p", 1, F.size("p") - 1), F.slice("p", 2, F.size("p")), lambda a, b: tf.haversine_m(a["at"]["lat"], a["at"]["lon"], b["at"]["lat"], b["at"]["lon"]))
    length = F.round(F.greatest(F.aggregate(legs, F.lit(0.0), lambda a, x: a + x), F.lit(1.0)), 2)
    hw = F.coalesce("highway", F.lit(DEFAULT_CLASS))
    classes = F.create_map(*[F.lit(x) for c in ROAD_CLASSES for x in (c[0], c[3])])
    rank = F.coalesce(F.try_element_at(classes, hw), F.lit(dict((c[0], c[3]) for c in ROAD_CLASSES)[DEFAULT_CLASS]))
    flag = tx.oneway_flag(F.col("oneway"), F.col("junction"), hw)
    tags = ways.select("way", "name", hw.alias("hw"), flag.alias("flag"), tx.lane_count(F.col("lanes"), rank, flag != 0).alias("lanes"))
    path = F.when(F.col("flag") < 0, F.reverse("p")).otherwise(F.col("p"))
    met = lines.withColumn("len", length).join(tags, "way").withColumn("p", path)
    ends = (F.element_at("p", 1)["node"].alias("u"), F.element_at("p", -1)["node"].alias("v"))
    return met.select("way", "chunk", *ends, F.transform("p", lambda x: x["at"]).alias("points"), "len", "name", "hw", (F.col("flag") != 0).alias("oneway"), "lanes")


def build_graph(nodes: DataFrame, ways: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, node, lat, lon) and directed edges (edge, u, v, way, chunk, name, hw, len, lanes, oneway, twin, points) of a routable graph.

    Of the directed stretches between junctions only those within the largest strong component stay. Its nodes are numbered 0 to n - 1 by map id, its edges
    0 to m - 1 by way, chunk and direction; a two-way stretch is two edges that name each other as twin.
    """
    edges = save(cut_edges(nodes, ways), "edges")
    arcs = edges.select("u", "v").unionByName(edges.where("not oneway").select(F.col("v").alias("u"), F.col("u").alias("v")))
    inside = save(largest_scc(arcs), "component")
    kept = edges.join(inside.withColumnRenamed("node", "u"), "u", "left_semi").join(inside.withColumnRenamed("node", "v"), "v", "left_semi")
    ends = kept.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    numbered = save(dense_ids(ends.join(nodes, "node"), ("node",), "id"), "numbered")
    number = lambda end: numbered.select(F.col("node").alias(end), F.col("id").alias(f"{end}_id"))
    renamed = kept.join(number("u"), "u").join(number("v"), "v").drop("u", "v").withColumnsRenamed({"u_id": "u", "v_id": "v"})
    ahead = renamed.withColumn("back", F.lit(0))
    back = renamed.where("not oneway").withColumns({"u": F.col("v"), "v": F.col("u"), "points": F.reverse("points"), "back": F.lit(1)})
    directed = dense_ids(ahead.unionByName(back), ("way", "chunk", "back"), "edge")
    # both directions of a stretch are neighbours in that order
    twin = F.when(~F.col("oneway"), F.col("edge") + 1 - 2 * F.col("back"))
    columns = ("edge", "u", "v", "way", "chunk", "name", "hw", "len", "lanes", "oneway")
    return numbered.select("id", "node", "lat", "lon"), directed.select(*columns, twin.alias("twin"), "points")
