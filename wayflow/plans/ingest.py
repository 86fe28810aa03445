"""Queries on map extracts: streets of the grid written as overlapping tiles of XML, read back and made a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import bindings as b
from ..operators import ingest
from ..sources import osm
from ..storage import new_folder, save
from . import roads as rr
from .core import query

_TILE = 4  # streets of a tile
#: Streets: rows and columns of the grid as ways. Every seventh is private; some are one-way along or against; a street of an unwanted class drops out.
STREETS = f"""streets AS (SELECT row * 2 AS way, list(node ORDER BY col) AS refs, row AS k, 0 AS dir FROM nodes GROUP BY row UNION ALL SELECT col * 2 + 1, list(node ORDER BY row), col, 1 FROM nodes GROUP BY col),
ways AS (SELECT way, refs, k, dir, CASE WHEN dir = 0 THEN 'Row ' ELSE 'Col ' END || k AS name, (['primary', 'secondary', 'residential'])[k % 3 + 1] AS highway,
 CASE WHEN k % 5 = 3 THEN 'yes' WHEN k % 5 = 4 AND dir = 1 THEN '-1' END AS oneway FROM streets WHERE len(refs) >= 2 AND way % 7 <> 5 AND way % 11 <> 7)"""


def tiles(spark: SparkSession, sf_dir: str) -> str:
    """Writes the grid as tiles: nodes and streets of _TILE rows or columns each, with a later copy of some in the next tile under another name."""
    n = save(b.nodes(spark, sf_dir), "nodes")
    street = lambda key, other, dir: n.groupBy(F.col(key).alias("k")).agg(F.transform(F.array_sort(F.collect_list(F.struct(other, "node"))), lambda x: x["node"]).alias("refs")).withColumn("dir", F.lit(dir))
    ways = street("row", "col", 0).unionByName(street("col", "row", 1)).withColumn("way", F.col("k") * 2 + F.col("dir"))
    tag = lambda k, v: F.concat(F.lit(f'<tag k="{k}" v="'), v, F.lit('"/>'))
    name = F.concat(F.when(F.col("dir") == 0, "Row ").otherwise("Col "), F.col("k").cast("string"))
    highway = F.when(F.col("way") % 11 == 7, "footway").otherwise(F.element_at(F.array(*map(F.lit, ("primary", "secondary", "residential"))), (F.col("k") % 3 + 1).cast("int")))
    oneway = F.when(F.col("k") % 5 == 3, tag("oneway", F.lit("yes"))).when((F.col("k") % 5 == 4) & (F.col("dir") == 1), tag("oneway", F.lit("-1"))).otherwise("")
    access = F.when(F.col("way") % 7 == 5, tag("access", F.lit("private"))).otherwise("")
    points = F.array_join(F.transform("refs", lambda r: F.concat(F.lit('<nd ref="'), r.cast("string"), F.lit('"/>'))), "")
    line = lambda suffix: F.concat(F.lit('<way id="'), F.col("way").cast("string"), F.lit('" version="1">'), points, tag("highway", highway), tag("name", F.concat(name, F.lit(suffix))), oneway, access, F.lit("</way>"))
    tile = F.floor(F.col("k") / _TILE).cast("int")
    made = ways.select(tile.alias("tile"), F.lit(2).alias("part"), line("").alias("value"))
    copies = ways.where("way % 3 = 0").select((tile + 1).alias("tile"), F.lit(2).alias("part"), line(" copy").alias("value"))
    at = lambda c: F.format_string("%.6f", c)
    node = F.concat(F.lit('<node id="'), F.col("node").cast("string"), F.lit('" lat="'), at(F.col("lat")), F.lit('" lon="'), at(F.col("lon")), F.lit('"/>'))
    moved = F.concat(F.lit('<node id="'), F.col("node").cast("string"), F.lit('" lat="0.0" lon="0.0"/>'))
    own = F.floor(F.col("row") / _TILE).cast("int")
    points = n.select(own.alias("tile"), F.lit(1).alias("part"), node.alias("value")).unionByName(n.where("node % 4 = 0").select((own + 1).alias("tile"), F.lit(1).alias("part"), moved.alias("value")))
    body = made.unionByName(copies).unionByName(points)
    frame = body.select("tile").distinct().select("tile", F.inline(F.array(F.struct(F.lit(0).alias("part"), F.lit("<osm>").alias("value")), F.struct(F.lit(3).alias("part"), F.lit("</osm>").alias("value")))))
    path = new_folder(spark, "tiles")
    # a tile is as small as a map server gives it out, and one file
    body.unionByName(frame).withColumn("tile", F.format_string("%08d", "tile")).repartition("tile").sortWithinPartitions("tile", "part").select("tile", "value").write.partitionBy("tile").text(path)
    return path


def extract(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nodes, ways = osm.parse_osm_xml(spark, tiles(spark, sf_dir))
    return save(nodes, "map_nodes"), save(ways, "map_ways")


@query(f"WITH {b.NODES}, {STREETS} SELECT way, highway, name, oneway, refs FROM ways")
def parse_osm_xml(spark, sf_dir):
    return extract(spark, sf_dir)[1].select("way", "highway", "name", "oneway", "refs")


_GRAPH = f"""WITH RECURSIVE {b.NODES}, {STREETS}, uses AS (SELECT unnest(refs) AS node FROM ways UNION ALL SELECT refs[1] FROM ways UNION ALL SELECT refs[len(refs)] FROM ways),
junctions AS (SELECT node FROM uses GROUP BY node HAVING count(*) >= 2),
points AS (SELECT way, unnest(refs) AS node, unnest(range(len(refs))) AS pos FROM ways),
cuts AS (SELECT p.*, row_number() OVER (PARTITION BY way ORDER BY pos) - 1 AS chunk, lead(pos) OVER (PARTITION BY way ORDER BY pos) AS until, lead(node) OVER (PARTITION BY way ORDER BY pos) AS other FROM points p SEMI JOIN junctions USING (node)),
legs AS (SELECT a.way, c.chunk, sum({rr._HAV.replace("lat1", "n1.lat").replace("lat2", "n2.lat").replace("lon1", "n1.lon").replace("lon2", "n2.lon")}) AS len FROM cuts c JOIN points a ON a.way = c.way AND a.pos >= c.pos AND a.pos < c.until
 JOIN points z ON z.way = a.way AND z.pos = a.pos + 1 JOIN nodes n1 ON n1.node = a.node JOIN nodes n2 ON n2.node = z.node GROUP BY ALL),
chunks AS (SELECT c.way, c.chunk, CASE WHEN w.oneway = '-1' THEN other ELSE node END AS u, CASE WHEN w.oneway = '-1' THEN node ELSE other END AS v, w.oneway IS NOT NULL AS oneway, w.highway AS hw, w.name, round(greatest(l.len, 1.0), 2) AS len
 FROM cuts c JOIN ways w USING (way) JOIN legs l ON l.way = c.way AND l.chunk = c.chunk WHERE until IS NOT NULL),
arcs AS (SELECT u, v FROM chunks UNION SELECT v, u FROM chunks WHERE NOT oneway),
r(a, b) AS (SELECT u, v FROM arcs UNION SELECT r.a, e.v FROM r JOIN arcs e ON e.u = r.b),
comp AS (SELECT n.node, coalesce(least(n.node, min(x.b)), n.node) AS component FROM (SELECT u AS node FROM arcs UNION SELECT v FROM arcs) n
 LEFT JOIN (SELECT r1.a, r1.b FROM r r1 JOIN r r2 ON r1.a = r2.b AND r1.b = r2.a) x ON x.a = n.node GROUP BY 1),
best AS (SELECT component FROM comp GROUP BY 1 ORDER BY count(*) DESC, component LIMIT 1),
inside AS (SELECT node FROM comp WHERE component = (SELECT component FROM best)),
kept AS (SELECT c.* FROM chunks c WHERE u IN (FROM inside) AND v IN (FROM inside)),
ids AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS id FROM (SELECT u AS node FROM kept UNION SELECT v FROM kept)),
directed AS (SELECT *, 0 AS back FROM kept UNION ALL SELECT * REPLACE (v AS u, u AS v), 1 FROM kept WHERE NOT oneway),
numbered AS (SELECT *, row_number() OVER (ORDER BY way, chunk, back) - 1 AS edge FROM directed)"""


@query(f"""{_GRAPH} SELECT e.edge, a.id AS u, z.id AS v, way, CAST(chunk AS BIGINT) AS chunk, name, hw, len, CASE WHEN hw = 'residential' THEN 1 ELSE 2 END AS lanes, oneway, CASE WHEN NOT oneway THEN edge + 1 - 2 * back END AS twin
FROM numbered e JOIN ids a ON a.node = e.u JOIN ids z ON z.node = e.v""", "len")
def build_graph(spark, sf_dir):
    _, edges = ingest.build_graph(*extract(spark, sf_dir))
    return edges.select("edge", "u", "v", "way", F.col("chunk").cast("long").alias("chunk"), "name", "hw", "len", "lanes", "oneway", "twin")
