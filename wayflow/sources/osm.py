"""Map extracts in XML: tiles that overlap, read as nodes and ways."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import ROAD_CLASSES

_NODE = "_id long, _lat double, _lon double"
_WAY = "_id long, nd array<struct<_ref: long>>, tag array<struct<_k: string, _v: string>>"
WANTED = tuple(hw for hw, *_ in ROAD_CLASSES)


def _first(rows: DataFrame, key: str) -> DataFrame:
    """One row of each key: that of the tile whose path comes first, there the first by its columns."""
    others = [c for c in rows.columns if c not in (key, "tile")]
    return rows.groupBy(key).agg(F.min(F.struct("tile", *others)).alias("first")).select(key, *[F.col(f"first.{c}").alias(c) for c in others])


def parse_osm_xml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, lat, lon) and ways (way, refs, highway, name, oneway, junction, lanes) of all tiles under ``path``.

    Ways of another class than the wanted ones, closed to the public or of fewer than two points drop out. Tiles overlap: of the copies of an id the
    first tile's stays, among those that aren't dropped. A way's name is its ``name`` or else its ``ref``; other tags are null where the map lacks them.
    """
    read = lambda row, schema: spark.read.format("xml").schema(schema).option("rowTag", row).load(path).withColumn("tile", F.col("_metadata.file_path"))
    nodes = read("node", _NODE).select(F.col("_id").alias("node"), "tile", F.col("_lat").alias("lat"), F.col("_lon").alias("lon")).where("node is not null")
    pairs = F.filter(F.coalesce("tag", F.array()), lambda t: t["_k"].isNotNull())
    # of a tag that comes twice the last counts
    tag = lambda k: F.get(F.reverse(F.filter("tags", lambda t: t["_k"] == k)), F.lit(0))["_v"].alias(k)
    ways = read("way", _WAY).where("_id is not null").select(F.col("_id").alias("way"), "tile", F.transform(F.coalesce("nd", F.array()), lambda n: n["_ref"]).alias("refs"), pairs.alias("tags"))
    named = ways.select("way", "tile", "refs", *map(tag, ("highway", "access", "name", "ref", "oneway", "junction", "lanes")))
    open_ways = named.where(F.col("highway").isin(*WANTED) & ~F.coalesce(F.col("access").isin("private", "no"), F.lit(False)) & (F.size("refs") >= 2))
    name = F.coalesce(F.when(F.col("name") != "", F.col("name")), F.col("ref"), F.lit(""))
    return _first(nodes, "node"), _first(open_ways.select("way", "tile", "refs", "highway", name.alias("name"), "oneway", "junction", "lanes"), "way")
