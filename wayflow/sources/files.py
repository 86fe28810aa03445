"""Readers and writers of the domain's files."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import traffic as tf
from ..operators.roads import nearest_node
from ..schema import DEFAULT_CLASS, READING, ROAD_CLASSES, road_classes
from ..storage import forget

BAD = "_bad"


def read_readings(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Readings of a JSON-lines log and, as one row, how many lines could not be parsed or have no id. Blank lines are skipped."""
    schema = T.StructType([*READING.fields, T.StructField(BAD, T.StringType())])
    rows = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD).json(path)
    # the parser fills the corrupt-record column only where other columns are read too
    good = rows.where(F.col(BAD).isNull() & F.col("camera_id").isNotNull())
    return good.drop(BAD), rows.agg(F.count(F.when(F.col(BAD).isNotNull() | F.col("camera_id").isNull(), F.lit(1))).alias("bad"))


def append_readings(readings: DataFrame, path: str) -> None:
    """Adds files of one line a reading; writers need not know of each other."""
    readings.write.mode("append").json(path)


def write_road_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def read_road_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges; an unknown road class counts as DEFAULT_CLASS, a missing twin is null."""
    classes = road_classes(spark)
    default = next(rank for hw, _, _, rank in ROAD_CLASSES if hw == DEFAULT_CLASS)
    edges = spark.read.parquet(f"{path}/edges").drop("rank").join(F.broadcast(classes.select("hw", "rank")), "hw", "left")
    return spark.read.parquet(f"{path}/nodes"), edges.withColumn("rank", F.coalesce("rank", F.lit(default)))


def read_id_list(spark: SparkSession, path: str) -> DataFrame:
    """Distinct ids of a text file; blank lines and comments drop out."""
    line = F.trim("value")
    return spark.read.text(path).select(line.alias("id")).where("id <> '' and id not like '#%'").distinct()


def flatten_registry(registry: DataFrame) -> DataFrame:
    """(camera_id, image_url, video_url) of registry rows that have both among additionalProperties (key, value)."""
    found = registry.withColumn("p", F.map_from_entries("additionalProperties"))
    rows = found.select(F.regexp_replace("id", "^JamCams_", "").alias("camera_id"), F.try_element_at("p", F.lit("imageUrl")).alias("image_url"), F.try_element_at("p", F.lit("videoUrl")).alias("video_url"))
    return rows.where("image_url is not null and video_url is not null")


def sensors_geojson(sensors: DataFrame) -> DataFrame:
    """(camera_id, feature): a GeoJSON feature a sensor."""
    point = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), F.struct("camera_id").alias("properties"))
    return sensors.select("camera_id", F.to_json(feature).alias("feature"))


def replay_instant(text: F.Column, zone: str = "Europe/London") -> F.Column:
    """Unix seconds of 'YYYY-MM-DD HH:MM' on a zone's clock; blank is null, anything else an error."""
    clean = F.trim(text)
    # a local clock becomes an instant by reading it as UTC and going back by the zone's offset
    local = F.to_timestamp_ntz(clean, F.lit("yyyy-MM-dd HH:mm"))
    utc = F.convert_timezone(F.lit(zone), F.lit("UTC"), local)
    return F.when(clean != "", F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), utc))


_LANDMARKS = "city string, landmarks array<struct<name: string, lat: double, lon: double, aliases: array<string>>>"


def read_gazetteer(spark: SparkSession, path: str, nodes: DataFrame, reach_m: float = 300.0) -> DataFrame:
    """(key, name, node, lat, lon): a row for each name and alias of the landmarks in JSON files, at the node nearest to the landmark.

    Files hold one object over many lines: ``{"city", "landmarks": [{"name", "lat", "lon", "aliases"}]}``. Keys are normalised names, in other
    scripts too; of equal keys the last in order of file and place counts. Landmarks without a node within ``reach_m`` drop out, as do names without a key.
    ``nodes``: (node, lat, lon).
    """
    blobs = spark.read.schema(_LANDMARKS).option("multiLine", True).json(path).select(F.col("_metadata.file_path").alias("file"), F.posexplode("landmarks").alias("pos", "m"))
    marks = blobs.select(F.struct("file", "pos").alias("mark"), "m.name", "m.lat", "m.lon", F.array_union(F.array("m.name"), F.coalesce("m.aliases", F.array().cast("array<string>"))).alias("names"))
    middle = nodes.agg(F.avg("lat").alias("lat0"))
    metric = lambda df: df.crossJoin(F.broadcast(middle)).withColumns({"x": F.col("lon") * 111320.0 * F.cos(F.radians("lat0")), "y": F.col("lat") * 110540.0}).drop("lat0")
    near = nearest_node(metric(marks).select("mark", "x", "y"), metric(nodes), "mark", reach_m).select("mark", "node")
    named = marks.join(near, "mark").select("mark", "name", "node", F.posexplode("names").alias("alias", "said")).withColumn("key", tf.normalise_name(F.col("said"))).where("key <> ''")
    last = named.groupBy("key").agg(F.max_by(F.struct("name", "node"), F.struct("mark", "alias")).alias("b")).select("key", "b.*")
    return last.join(nodes.select("node", "lat", "lon"), "node").select("key", "name", "node", "lat", "lon")


class NotPublished(ValueError):
    """A result that must not be shown: nothing there, without provenance, or without a fitted forecaster."""


def publish_validation(scores: DataFrame, path: str, source: str, from_collector: bool) -> None:
    """Publishes scores (forecaster, ..., tau, damp) under ``path``, whole or not at all, with where they come from.

    Without rows or with an unfitted forecaster (null tau or damp) nothing is published and the call fails; what was published before stays. Rows are
    written beside and renamed in one step once all are there, so readers never see a part. Later versions have later names.
    """
    spark = scores.sparkSession
    version = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
    staged = f"{path}/_staging-{version}"
    named = scores.withColumns({"source": F.lit(source), "from_collector": F.lit(from_collector), "generated_at": F.current_timestamp()})
    named.write.json(staged, ignoreNullFields=False)
    written = spark.read.json(staged, schema=named.schema)
    if written.where("tau is not null and damp is not null").isEmpty() or not written.where("tau is null or damp is null").isEmpty():
        forget(spark, staged)
        raise NotPublished("no fitted forecaster, so nothing is published")
    put = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/version-{version}")
    if not put.getFileSystem(spark._jsc.hadoopConfiguration()).rename(spark._jvm.org.apache.hadoop.fs.Path(staged), put):
        raise NotPublished(f"{put} could not be put in place")


def read_published(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """The newest published scores (columns of ``schema``, and source, from_collector, generated_at). Fails where there are none, or where they don't
    come from the collector's own log.
    """
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted(x.getPath().getName() for x in files.listStatus(where)) if files.exists(where) else []
    versions = [n for n in names if n.startswith("version-")]
    if not versions:
        raise NotPublished(f"nothing is published under {path}")
    whole = T.StructType([*(T.StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields, *T.StructType.fromDDL("source string, from_collector boolean, generated_at timestamp").fields])
    found = spark.read.json(f"{path}/{versions[-1]}", schema=whole)
    if not found.where("from_collector is null or not from_collector").isEmpty():
        raise NotPublished("the published scores don't come from the collector's log and can't be shown as real")
    return found
