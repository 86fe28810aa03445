"""Queries on files' shapes, over tables written to and read from the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import bindings as b
from ..operators import sampling
from ..operators import validation as va
from ..sources import files
from ..storage import new_folder
from . import roads as rr
from .core import query
from . import validation as vd
from .readings import R


@query(f"{R}, {b.NODES}, {b.SENSORS} SELECT camera_id, round(lon, 6) AS lon, round(lat, 6) AS lat FROM sensors")
def sensors_geojson(spark, sf_dir):
    found = files.sensors_geojson(b.sensors(spark, sf_dir))
    at = lambda k: F.round(F.get_json_object("feature", f"$.geometry.coordinates[{k}]").cast("double"), 6)
    return found.select("camera_id", at(0).alias("lon"), at(1).alias("lat"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS camera_id, 'i' || p_partkey AS image_url, 'v' || p_partkey AS video_url FROM part WHERE p_partkey % 3 <> 0")
def flatten_registry(spark, sf_dir):
    k = F.col("p_partkey").cast("string")
    entry = lambda name, c: F.struct(F.lit(name).alias("key"), c.alias("value"))
    both = F.array(entry("imageUrl", F.concat(F.lit("i"), k)), entry("videoUrl", F.concat(F.lit("v"), k)), entry("view", F.lit("N")))
    one = F.array(entry("imageUrl", F.concat(F.lit("i"), k)))
    rows = b.table(spark, sf_dir, "part").select(F.concat(F.lit("JamCams_"), k).alias("id"), F.when(F.col("p_partkey") % 3 != 0, both).otherwise(one).alias("additionalProperties"))
    return files.flatten_registry(rows)


@query("SELECT event_id, CAST(epoch(strptime(strftime(ts, '%Y-%m-%d %H:%M'), '%Y-%m-%d %H:%M') AT TIME ZONE 'Europe/London') AS BIGINT) AS t FROM events")
def replay_instant(spark, sf_dir):
    text = F.date_format(F.col("ts"), "yyyy-MM-dd HH:mm")
    return b.table(spark, sf_dir, "events").select("event_id", files.replay_instant(text).alias("t"))


@query(f"{rr.E} SELECT edge, u, v, hw, CAST(rank AS INTEGER) AS rank, twin FROM edges")
def read_road_graph(spark, sf_dir):
    path = new_folder(spark, "graph")
    files.write_road_graph(b.nodes(spark, sf_dir), b.edges(spark, sf_dir), path)
    return files.read_road_graph(spark, path)[1].select("edge", "u", "v", "hw", "rank", "twin")


@query("SELECT CAST(user_id AS VARCHAR) AS camera_id, count(*) AS n, sum(value / 10) AS total FROM events GROUP BY 1", "total")
def append_readings(spark, sf_dir):
    path = new_folder(spark, "log")
    r = b.readings(spark, sf_dir).select(F.col("camera_id").cast("string").alias("camera_id"), F.col("t").alias("t_wall"), "count_mean", "tracks", "moving_frac")
    for part in (0, 1):
        files.append_readings(r.where(F.pmod(F.hash("t_wall"), F.lit(2)) == part), path)
    good, _ = files.read_readings(spark, path)
    return good.groupBy("camera_id").agg(F.count(F.lit(1)).alias("n"), F.sum("count_mean").alias("total"))


_LETTERS = "абвгдежзиклмнопрстуфхцчшщ"


@query(f"""WITH {b.NODES}, marks AS (SELECT n_nationkey AS k, n_name AS name, n.node, n.lat, n.lon FROM nation JOIN nodes n ON n.node = (SELECT min(node) FROM nodes) + n_nationkey * 3),
named AS (SELECT k, 0 AS alias, replace(lower(name), '_', ' ') AS key, name, node, lat, lon FROM marks UNION ALL SELECT k, 1, substring('{_LETTERS}', k + 1, 1) || ' площадь', name, node, lat, lon FROM marks
 UNION ALL SELECT k, 2, 'old ' || (k % 7), name, node, lat, lon FROM marks)
SELECT key, name, node, lat, lon FROM named QUALIFY row_number() OVER (PARTITION BY key ORDER BY k DESC, alias DESC) = 1""", "lat lon")
def read_gazetteer(spark, sf_dir):
    path = new_folder(spark, "gazetteer")
    nodes = b.nodes(spark, sf_dir)
    first = F.broadcast(nodes.agg(F.min("node").alias("lo")))
    k = F.col("n_nationkey")
    met = b.table(spark, sf_dir, "nation").crossJoin(first).join(nodes, F.col("node") == F.col("lo") + k * 3)
    aliases = F.array(F.concat(F.substring(F.lit(_LETTERS), k + 1, F.lit(1)), F.lit("-Площадь")), F.concat(F.lit("Óld "), (k % 7).cast("string")), F.lit("?!"))
    mark = F.struct(F.col("n_name").alias("name"), (F.col("lat") + 0.0001).alias("lat"), F.col("lon").alias("lon"), aliases.alias("aliases"))
    listed = met.agg(F.transform(F.array_sort(F.collect_list(F.struct(k.alias("k"), mark.alias("m")))), lambda x: x["m"]).alias("landmarks"))
    # one object over many lines, as an editor writes it
    listed.select(F.to_json(F.struct(F.lit("grid").alias("city"), "landmarks"), {"pretty": "true"}).alias("value")).coalesce(1).write.text(path)
    return files.read_gazetteer(spark, path, nodes.select("node", "lat", "lon"))


@query(f"SELECT 'readings' AS source, true AS from_collector, v.* FROM ({vd.VALIDATED}) v", vd.SCORES + " tau damp")
def publish_validation(spark, sf_dir):
    path = new_folder(spark, "published")
    scores = va.validate_forecast(b.readings(spark, sf_dir), vd.H, vd.TOL)
    files.publish_validation(scores, path, "readings", True)
    return files.read_published(spark, path, scores.schema).select("source", "from_collector", *scores.columns)


@query()
def sample_od_pairs(spark, sf_dir):
    """Trips between customers laid out as places on a wide grid, every 23rd a landmark; as many as there are orders."""
    k = F.col("c_custkey")
    nodes = b.table(spark, sf_dir, "customer").select(k.alias("node"), (k % 120 * 90.0).alias("x"), (F.floor(k / 120) * 110.0 + k % 7).alias("y"))
    trips = b.table(spark, sf_dir, "orders").count()
    return sampling.sample_od_pairs(spark, nodes, nodes.where("node % 23 = 0").select("node"), trips, 99)
