"""Queries on names, places, sensors' panels and map ways."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import bindings as b
from ..functions import traffic as tf
from ..operators import places as pl
from ..operators import readings as op
from ..operators import roads as ro
from ..operators.numbering import dealt_by
from ..storage import save
from . import readings as rd
from . import roads as rr
from .core import query

NORM = "trim(regexp_replace(lower(strip_accents({})), '[^a-z0-9 ]+', ' ', 'g'))"
#: Places: part names; those from a to g are landmarks, the others streets, and every brand of a name is a street of its own.
GAZ = f"""gaz AS (SELECT key, min(node) AS node, min(kind) AS kind FROM (SELECT {NORM.format("p_name")} AS key, p_partkey AS node, CASE WHEN p_name < 'h' THEN 'landmark' ELSE 'street' END AS kind FROM part
 UNION ALL SELECT {NORM.format("p_name || ' ' || p_brand")}, p_partkey, 'street' FROM part) GROUP BY key)"""
_FORMS = {
    0: "concat(p_name, ' ', p_type)",
    1: "p_name",
    2: "concat(substring(p_name, 1, 1), substring(p_name, 3))",
    3: "concat(p_type, ' ', substring(p_name, 1, 5))",
    4: "substring(p_name, 2, 4)",
    5: "concat('51.4', CAST(p_partkey % 2 + 8 AS VARCHAR(4)), CAST(p_partkey % 9 AS VARCHAR(4)), ', -0.15', CAST(p_partkey % 8 AS VARCHAR(4)))",
}
ASKS = "asks AS (SELECT *, " + NORM.format("text") + " AS q FROM (" + " UNION ALL ".join(f"SELECT p_partkey * 6 + {k} AS ask, {t} AS text FROM part" for k, t in _FORMS.items()) + "))"


def gazetteer(spark, sf_dir):
    p = b.table(spark, sf_dir, "part").groupBy("p_name", "p_brand").agg(F.min("p_partkey").alias("p_partkey"))
    names = p.select("p_name", "p_partkey", F.when(F.col("p_name") < "h", "landmark").otherwise("street").alias("kind"))
    both = names.unionByName(p.select(F.concat_ws(" ", "p_name", "p_brand").alias("p_name"), "p_partkey", F.lit("street").alias("kind")))
    return save(both.groupBy(tf.normalise_name(F.col("p_name")).alias("key")).agg(F.min("p_partkey").alias("node"), F.min("kind").alias("kind"), F.min("p_name").alias("name")), "places")


def asks(spark, sf_dir):
    forms = F.explode(F.array(*[F.struct((F.col("p_partkey") * 6 + k).alias("ask"), F.expr(t).alias("text")) for k, t in _FORMS.items()])).alias("r")
    # a small file of many rows would be read, and its texts normalised, in one task
    part = dealt_by(b.table(spark, sf_dir, "part"), "p_partkey", 20_000)
    return save(pl.asked(part.select(forms).select("r.*"), "text", "ask"), "asks")


def grid(spark, sf_dir):
    return rr.xy(b.nodes(spark, sf_dir)).select("node", "x", "y")


# an accent in every second name
ACCENTED = "CASE WHEN p_partkey % 2 = 0 THEN translate(p_name, 'aeou', 'áèôü') ELSE p_name || ' - ' || p_brand END"


@query(f"SELECT p_partkey, {NORM.format(ACCENTED)} AS key FROM part")
def normalise_name(spark, sf_dir):
    return b.table(spark, sf_dir, "part").select("p_partkey", tf.normalise_name(F.expr(ACCENTED)).alias("key"))


@query()
def sound_key(spark, sf_dir):
    return b.table(spark, sf_dir, "part").select("p_partkey", tf.sound_key(F.col("p_name")).alias("key"))


_PAIR = r"regexp_matches(text, '^\s*-?\d+\.\d+\s*,\s*-?\d+\.\d+\s*$')"
_XY = rr.XY.format(lon="lon", lat="lat", x="x", y="y")


@query(f"""WITH {GAZ}, {ASKS}, {b.NODES}, n AS (SELECT node, {_XY} FROM nodes), c AS (SELECT ask, CAST(split_part(text, ',', 1) AS DOUBLE) AS lat, CAST(split_part(text, ',', 2) AS DOUBLE) AS lon FROM asks WHERE {_PAIR}),
p AS (SELECT DISTINCT lat, lon FROM c), d AS (SELECT lat, lon, {_XY} FROM p), m AS (SELECT lat, lon, n.node FROM d, n QUALIFY row_number() OVER (PARTITION BY lat, lon ORDER BY round(sqrt(pow(d.x - n.x, 2) + pow(d.y - n.y, 2)), 6), n.node) = 1)
SELECT ask, printf('%.5f, %.5f', lat, lon) AS key, node FROM c JOIN m USING (lat, lon) UNION ALL SELECT ask, key, node FROM asks JOIN gaz ON q = key WHERE NOT {_PAIR}""")
def geocode_exact(spark, sf_dir):
    return pl.geocode_exact(asks(spark, sf_dir), gazetteer(spark, sf_dir), grid(spark, sf_dir), rr.LAT0)


_HELD = "held AS (SELECT q, key, node FROM texts, gaz WHERE {} (contains(key, q) OR contains(q, key)) QUALIFY row_number() OVER (PARTITION BY q ORDER BY length(key), key) = 1)"
_TEXTS = "texts AS (SELECT DISTINCT q FROM asks WHERE q <> '')"


@query(f"WITH {GAZ}, {ASKS}, {_TEXTS}, {_HELD.format(chr(39) + 'landmark' + chr(39) + ' = kind AND')} SELECT ask, key, node FROM asks JOIN held USING (q)")
def geocode_phrase(spark, sf_dir):
    return pl.geocode_phrase(asks(spark, sf_dir), gazetteer(spark, sf_dir))


@query(f"""WITH {GAZ}, {ASKS}, {_TEXTS}, {_HELD.format('')}, words AS (SELECT q, list_filter(list_distinct(string_split(q, ' ')), lambda w: w <> '') AS w FROM texts WHERE q NOT IN (SELECT q FROM held)),
s AS (SELECT q, key, node, round(CAST(len(list_intersect(w, list_distinct(string_split(key, ' ')))) AS DOUBLE) / len(list_distinct(list_concat(w, list_filter(string_split(key, ' '), lambda w: w <> '')))), 6) AS score FROM words, gaz),
t AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, key DESC) AS place FROM s WHERE score >= 0.34 QUALIFY place <= 5),
u AS (SELECT q, key, node, score FROM t QUALIFY row_number() OVER (PARTITION BY q ORDER BY length(key), place) = 1 UNION ALL SELECT q, key, node, 1.0 FROM held) SELECT ask, key, node, score FROM asks JOIN u USING (q)""", "score")
def geocode_partial(spark, sf_dir):
    return pl.geocode_partial(asks(spark, sf_dir), gazetteer(spark, sf_dir))


@query()
def geocode_typo(spark, sf_dir):
    return pl.geocode_typo(asks(spark, sf_dir), gazetteer(spark, sf_dir))


@query()
def geocode_cascade(spark, sf_dir):
    return pl.geocode_cascade(asks(spark, sf_dir), gazetteer(spark, sf_dir), grid(spark, sf_dir), rr.LAT0)


@query()
def suggest_names(spark, sf_dir):
    return pl.suggest_names(asks(spark, sf_dir), gazetteer(spark, sf_dir))


@query("""WITH c AS (SELECT event_id, lpad(CAST(hour(ts) AS VARCHAR), 2, '0') AS h, lpad(CAST(minute(ts) AS VARCHAR), 2, '0') AS m, hour(ts) AS hh, hour(ts) * 3600 + minute(ts) * 60 AS s FROM events)
SELECT event_id, CASE event_id % 5 WHEN 0 THEN h || ':' || m WHEN 1 THEN 'at ' || h || 'h' || m WHEN 2 THEN 'leave ' || h || m || ' please' WHEN 3 THEN CASE WHEN hh < 12 THEN h || '.' || m || ' AM' ELSE lpad(CAST(hh - 12 AS VARCHAR), 2, '0') || '.' || m || 'pm' END ELSE 'soon' END AS text,
 CAST(CASE WHEN event_id % 5 = 4 THEN 32400 ELSE s END AS DOUBLE) AS seconds FROM c""", "seconds")
def parse_clock(spark, sf_dir):
    clock = tf.format_clock(F.floor(b.micros("ts") / F.lit(1000000.0)))
    h, m = F.substring("clock", 1, 2), F.substring("clock", 4, 2)
    half = F.when(h < "12", F.concat(h, F.lit("."), m, F.lit(" AM"))).otherwise(F.concat(F.lpad((h.cast("int") - 12).cast("string"), 2, "0"), F.lit("."), m, F.lit("pm")))
    said = F.array(F.col("clock"), F.concat(F.lit("at "), h, F.lit("h"), m), F.concat(F.lit("leave "), h, m, F.lit(" please")), half, F.lit("soon"))
    asked = b.table(spark, sf_dir, "events").withColumn("clock", clock).select("event_id", F.get(said, (F.col("event_id") % 5).cast("int")).alias("text"))
    return asked.withColumn("seconds", tf.parse_clock(F.col("text")))


@query(f"""{rd.R}, a AS (SELECT camera_id, event_id, t - 43200 AS at FROM readings), m AS (SELECT camera_id, event_id, (SELECT max(t) FROM readings r WHERE r.camera_id = a.camera_id AND r.t <= a.at) AS t0, (SELECT min(t) FROM readings r WHERE r.camera_id = a.camera_id) AS t1 FROM a)
SELECT event_id AS ask, coalesce(t0, t1) AS t FROM m""", "t")
def state_at_lag(spark, sf_dir):
    r = b.readings(spark, sf_dir)
    found = pl.state_at_lag(r.select("camera_id", "t", F.col("count_mean").alias("value")), r.select("camera_id", "t", F.col("event_id").alias("ask")), 43200.0)
    return found.select("ask", "t")


@query(f"""{rd.R}, {b.NODES}, {b.SENSORS}, l AS (SELECT * FROM readings QUALIFY row_number() OVER (PARTITION BY camera_id ORDER BY t DESC, event_id) = 1)
SELECT s.camera_id, l.event_id, 100 * moving_frac AS moving_pct, {rd.NOW} - t AS age_s, coalesce({rd.NOW} - t <= {rd.STALE}, false) AS reporting FROM sensors s LEFT JOIN l USING (camera_id)""", "moving_pct age_s")
def camera_panel(spark, sf_dir):
    now = F.lit(rd.now(spark, sf_dir))
    last = op.latest_reading_asof(b.readings(spark, sf_dir)).select("camera_id", "event_id", "moving_frac", "t")
    met = b.sensors(spark, sf_dir).select("camera_id").join(last, "camera_id", "left")
    return met.select("camera_id", "event_id", (100 * F.col("moving_frac")).alias("moving_pct"), (now - F.col("t")).alias("age_s"), F.coalesce(now - F.col("t") <= rd.STALE, F.lit(False)).alias("reporting"))


@query(f"{rr.E} SELECT edge, rank <= 4 AS main, round(len / 1000, 5) AS km FROM edges")
def state_columns(spark, sf_dir):
    return b.edges(spark, sf_dir).select("edge", (F.col("rank") <= 4).alias("main"), F.round(F.col("len") / 1000, 5).alias("km"))


_WAYS = "ways AS (SELECT l_orderkey AS way, list(l_partkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS refs FROM lineitem GROUP BY 1)"


def ways(spark, sf_dir):
    rows = b.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("way")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("r"))
    return rows.select("way", F.transform("r", lambda x: x["l_partkey"]).alias("refs"))


@query(f"WITH {_WAYS}, u AS (SELECT unnest(refs) AS node FROM ways UNION ALL SELECT unnest([refs[1], refs[-1]]) FROM ways) SELECT node, count(*) AS uses FROM u GROUP BY 1 HAVING count(*) >= 2")
def junction_nodes(spark, sf_dir):
    return ro.junction_nodes(ways(spark, sf_dir))


@query(f"""WITH {_WAYS}, p AS (SELECT way, unnest(refs) AS node, generate_subscripts(refs, 1) AS pos FROM ways), m AS (SELECT *, CAST(coalesce(sum(CASE WHEN node % 7 = 0 AND pos > 1 THEN 1 END) OVER (PARTITION BY way ORDER BY pos), 0) AS BIGINT) AS upto FROM p),
r AS (SELECT way, upto AS chunk, pos, node FROM m UNION ALL SELECT way, upto - 1, pos, node FROM m WHERE node % 7 = 0 AND pos > 1),
g AS (SELECT way, chunk, list(node ORDER BY pos) AS refs FROM r GROUP BY 1, 2) SELECT way, chunk, array_to_string(refs, ',') AS refs FROM g WHERE len(refs) > 1 AND refs[1] <> refs[-1]""")
def split_ways(spark, sf_dir):
    w = ways(spark, sf_dir)
    kept = w.select(F.explode("refs").alias("node")).where("node % 7 = 0").distinct()
    return ro.split_ways(w, kept).select("way", "chunk", F.array_join("refs", ",").alias("refs"))


@query()
def farthest_point_sample(spark, sf_dir):
    return ro.farthest_point_sample(rr.xy(b.sensors(spark, sf_dir)), 12)


@query()
def spaced_greedy_select(spark, sf_dir):
    e = rr.xy_edges(spark, sf_dir).withColumns({"x": (F.col("x1") + F.col("x2")) / 2, "y": (F.col("y1") + F.col("y2")) / 2})
    e = save(e, "edges")
    return ro.spaced_greedy_select(ro.watching_value(e), save(ro.spacing_conflicts(e), "conflicts"), 40)
