"""Matching free text to a gazetteer (key, node, kind); kind is 'landmark' or 'street'.

Requests are (ask, text, q), as ``asked`` makes them. Every stage works on the distinct ``q`` and brings its answer
back to the requests by an equi-join, so a text that is asked a million times is matched once.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import traffic as tf
from ..storage import save
from .roads import local_metres, nearest_node

PAIR = r"^\s*(-?\d+\.\d+)\s*,\s*(-?\d+\.\d+)\s*$"
TYPO, SOUND, SUGGESTED, OVERLAP = 0.8, 0.9, 0.7, 0.34  # least likeness of the stages


def asked(texts: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """(ask, text, q): requests with their normalised text; those without any are left out. Each distinct text is normalised once."""
    rows = texts.select(F.col(id_col).alias("ask"), F.col(text_col).alias("text"))
    # written tables: the test of q would else be put before the distinct, and by the join's equality to all requests
    known = save(save(rows.select("text").distinct(), "spelt").select("text", tf.normalise_name(F.col("text")).alias("q")).where("q <> ''"), "normalised")
    return rows.join(known, "text").select("ask", "text", "q")


def _texts(asks: DataFrame) -> DataFrame:
    return asks.select("q").distinct()


def _answer(asks: DataFrame, found: DataFrame) -> DataFrame:
    return asks.select("ask", "q").join(found, "q").drop("q")


def landmarks(places: DataFrame) -> DataFrame:
    return places.where("kind = 'landmark'")


def nearest_anywhere(points: DataFrame, nodes: DataFrame, key: str, reach_m: float = 300.0, most_rounds: int = 18) -> DataFrame:
    """(key, node, metres): the nearest node however far; the reach doubles for the points that found none."""
    found, left = None, points
    for k in range(most_rounds):
        near = save(nearest_node(left, nodes, key, reach_m * 2**k), "nearest")
        found = near if found is None else found.unionByName(near)
        left = save(left.join(near.select(key), key, "left_anti"), "far")
        if left.isEmpty():
            break
    return found


def coordinates(asks: DataFrame, nodes: DataFrame, lat0: float) -> DataFrame:
    """(ask, key, node) of texts that are a 'lat,lon' pair: the nearest of ``nodes`` (node, x, y in local metres about ``lat0``)."""
    part = lambda i: F.regexp_extract("text", PAIR, i).cast("double")
    pairs = asks.where(F.col("text").rlike(PAIR)).select("ask", part(1).alias("lat"), part(2).alias("lon")).withColumn("key", F.format_string("%.5f, %.5f", "lat", "lon"))
    points = local_metres(pairs.groupBy("key").agg(F.min("lat").alias("lat"), F.min("lon").alias("lon")), F.lit(lat0))
    return pairs.select("ask", "key").join(nearest_anywhere(points, nodes, "key").select("key", "node"), "key").select("ask", "key", "node")


def geocode_exact(asks: DataFrame, places: DataFrame, nodes: DataFrame | None = None, lat0: float = 0.0) -> DataFrame:
    """(ask, key, node): a coordinate pair (where ``nodes`` are given), else the place whose key the text is; a landmark before a street."""
    order = F.struct((F.col("kind") != "landmark").alias("later"), "node")
    best = places.groupBy("key").agg(F.min_by("node", order).alias("node"))
    if nodes is None:
        return _answer(asks, best.withColumn("q", F.col("key")))
    named = _answer(asks.where(~F.col("text").rlike(PAIR)), best.withColumn("q", F.col("key")))
    return coordinates(asks, nodes, lat0).unionByName(named.select("ask", "key", "node"))


def _holding(texts: DataFrame, keys: DataFrame, both: bool = True, n: int = 4) -> DataFrame:
    """(q, key): texts inside a key and, with ``both``, keys inside a text.

    What is inside another begins with up to ``n`` letters that the other has somewhere: an equi-join on them, then the test.
    """
    start = lambda c: F.substring(c, 1, n)
    inner = lambda c: F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: F.substring(c, i, k)))))
    held = texts.select("q", start(F.col("q")).alias("gram")).join(keys.select("key", F.explode(inner(F.col("key"))).alias("gram")), "gram").where(F.contains("key", "q"))
    if both:
        held = held.unionByName(texts.select("q", F.explode(inner(F.col("q"))).alias("gram")).join(keys.select("key", start(F.col("key")).alias("gram")), "gram").where(F.contains("q", "key")))
    return held.select("q", "key").distinct()


def _shortest(held: DataFrame, places: DataFrame) -> DataFrame:
    nodes = places.groupBy("key").agg(F.min_by("node", F.struct((F.col("kind") != "landmark").alias("later"), "node")).alias("node"))
    best = held.groupBy("q").agg(F.min(F.struct(F.length("key").alias("l"), "key")).alias("b")).select("q", F.col("b.key").alias("key"))
    return best.join(nodes, "key")


def geocode_phrase(asks: DataFrame, places: DataFrame) -> DataFrame:
    """(ask, key, node): the landmark of shortest key (then least) that the text holds or that holds the text."""
    marks = landmarks(places)
    return _answer(asks, _shortest(_holding(_texts(asks), marks.select("key").distinct()), marks))


def _overlapping(texts: DataFrame, keys: DataFrame, least: float, most: int = 5) -> DataFrame:
    """(q, key, score): of the ``most`` keys of greatest token Jaccard of at least ``least`` (the greater key on a tie) the shortest.

    Two token sets of that likeness share one of their rarest tokens: only so many of each side go into the join.
    """
    words = lambda c: F.array_distinct(F.filter(F.split(c, " "), lambda w: w != ""))
    k = keys.select("key", words(F.col("key")).alias("their"))
    often = k.select(F.explode("their").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("uses"))

    def rarest(df: DataFrame, name: str, tokens: str) -> DataFrame:
        single = df.select(name, F.size(tokens).alias("n"), F.explode(tokens).alias("token")).join(often, "token", "left")
        ordered = single.groupBy(name, "n").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("uses", F.lit(0)).alias("uses"), "token"))).alias("s"))
        return ordered.select(name, F.explode(F.slice("s", F.lit(1), (F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1).cast("int"))).alias("r")).select(name, "r.token")

    t = texts.select("q", words(F.col("q")).alias("tokens"))
    met = rarest(t, "q", "tokens").join(rarest(k, "key", "their"), "token").select("q", "key").distinct().join(t, "q").join(k, "key")
    score = F.round(F.size(F.array_intersect("tokens", "their")) / F.size(F.array_union("tokens", "their")), 6)
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.desc("key")))
    top = met.select("q", "key", score.alias("score")).where(F.col("score") >= least).withColumn("place", place).where(F.col("place") <= most)
    return top.groupBy("q").agg(F.min(F.struct(F.length("key").alias("l"), "place", "key", "score")).alias("b")).select("q", "b.key", "b.score")


def geocode_partial(asks: DataFrame, places: DataFrame, least: float = OVERLAP) -> DataFrame:
    """(ask, key, node, score): the shortest key that holds the text or that the text holds (score 1), else by shared words."""
    texts, keys = _texts(asks), places.select("key").distinct()
    held = _shortest(_holding(texts, keys), places).withColumn("score", F.lit(1.0))
    shared = _overlapping(texts.join(held.select("q"), "q", "left_anti"), keys, least)
    nodes = places.groupBy("key").agg(F.min_by("node", F.struct((F.col("kind") != "landmark").alias("later"), "node")).alias("node"))
    return _answer(asks, held.select("q", "key", "node", "score").unionByName(shared.join(nodes, "key").select("q", "key", "node", "score")))


@F.pandas_udf(T.DoubleType())
def _ratio(key: pd.Series, text: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, a, b).ratio() for a, b in zip(key, text, strict=True)], dtype="float64")


def _numbered(c: Column, n: int) -> Column:
    """The n-grams of a text, each with the number of its kind so far, so that sets of them intersect as bags."""
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(n)))
    return F.transform(grams, lambda g, i: F.concat(g, F.lit("\t"), F.size(F.filter(F.slice(grams, F.lit(1), i + 1), lambda x: x == g)).cast("string")))


def _close(texts: DataFrame, keys: DataFrame, least: float) -> DataFrame:
    """(q, key, score): keys of matching-blocks ratio of at least ``least`` to (q, said) and (key, theirs).

    No pair is lost before the ratio. With ``t`` letters in both texts and ``m`` matched, at most ``t - 2m`` letters part
    the matched blocks, so the texts share at least ``(1.5 least - 1) t - 1`` pairs of letters; where that says nothing
    (short texts), they meet over single letters. Then the bags of letters must allow the ratio.
    """
    slope = 1.5 * least - 1
    short = int(1 / slope)  # letters in both, up to which no pair need be shared
    one, two = (lambda c: _numbered(F.col(c), 1)), (lambda c: _numbered(F.col(c), 2))
    t = texts.where("said <> ''").select("q", "said", one("said").alias("l1"), two("said").alias("g1"))
    k = keys.where("theirs <> ''").select("key", "theirs", one("theirs").alias("l2"), two("theirs").alias("g2"))
    brief = lambda c: F.length(c) < short
    feature = lambda c, letters, grams: F.explode(F.when(brief(c), F.concat(letters, grams)).otherwise(F.col(grams)))
    met = t.select("q", feature("said", "l1", "g1").alias("f")).join(k.select("key", feature("theirs", "l2", "g2").alias("f")), "f").select("q", "key").distinct()
    total = F.length("said") + F.length("theirs")
    may = (2 * F.size(F.array_intersect("l1", "l2")) >= least * total - 1e-9) & (F.size(F.array_intersect("g1", "g2")) >= slope * total - 1 - 1e-9)
    near = met.join(t, "q").join(k, "key").where(may).select("q", "said", "key", "theirs")
    return near.withColumn("score", _ratio("theirs", "said")).where(F.col("score") >= least).select("q", "key", F.round("score", 6).alias("score"))


def _closest(close: DataFrame) -> DataFrame:
    """The key of greatest score, the greater key on a tie."""
    return close.groupBy("q").agg(F.max(F.struct("score", "key")).alias("b")).select("q", "b.key", "b.score")


def _misspelt(texts: DataFrame, keys: DataFrame, least: float, sound: bool = False) -> DataFrame:
    heard = tf.sound_key if sound else (lambda c: c)
    return _closest(_close(texts.withColumn("said", heard(F.col("q"))), keys.withColumn("theirs", heard(F.col("key"))), least))


def geocode_typo(asks: DataFrame, places: DataFrame, known: str = "landmark") -> DataFrame:
    """(ask, key, node, score): a misspelt place. ``landmark``: landmarks by spelling, then by sound; ``any``: all places by spelling."""
    texts = _texts(asks)
    given = landmarks(places) if known == "landmark" else places
    keys = given.select("key").distinct()
    found = _misspelt(texts, keys, TYPO)
    if known == "landmark":
        found = save(found, "spelt")
        found = found.unionByName(_misspelt(texts.join(found.select("q"), "q", "left_anti"), keys, SOUND, sound=True))
    nodes = given.groupBy("key").agg(F.min_by("node", F.struct((F.col("kind") != "landmark").alias("later"), "node")).alias("node"))
    return _answer(asks, found.join(nodes, "key").select("q", "key", "node", "score"))


def geocode_cascade(asks: DataFrame, places: DataFrame, nodes: DataFrame | None = None, lat0: float = 0.0) -> DataFrame:
    """(ask, key, node, stage): exact, phrase, misspelt landmark, partial, misspelt place; each stage gets what the ones before left.

    The stages pass distinct texts on to one another, each asking for itself; requests take part in two steps only, where these are found and where they are answered.
    """
    texts, places = save(asks.select("text", "q").distinct().withColumn("ask", F.col("text")), "texts"), save(places, "places")
    stages = (
        ("exact", lambda a: geocode_exact(a, places, nodes, lat0)),
        ("phrase", lambda a: geocode_phrase(a, places)),
        ("typo", lambda a: geocode_typo(a, places)),
        ("partial", lambda a: geocode_partial(a, places)),
        ("typo", lambda a: geocode_typo(a, places, "any")),
    )
    done, left = None, texts
    for name, stage in stages:
        found = save(stage(left).select("ask", "key", "node", F.lit(name).alias("stage")), "matched")
        done = found if done is None else done.unionByName(found)
        left = save(left.join(found.select("ask"), "ask", "left_anti"), "left")
    return asks.select("ask", "text").join(done.withColumnRenamed("ask", "text"), "text").select("ask", "key", "node", "stage")


def suggest_names(asks: DataFrame, places: DataFrame, most: int = 6, least: float = SUGGESTED) -> DataFrame:
    """(ask, place, name): up to ``most`` names, first of keys that hold the text, by length, then of the ``most`` keys most like it."""
    texts, keys = _texts(asks), places.groupBy("key").agg(F.min(F.coalesce("name", "key")).alias("name"))
    held = _holding(texts, keys, both=False).select("q", "key", F.struct(F.lit(0).alias("later"), F.length("key").cast("double").alias("by"), F.lit(0).alias("turn")).alias("o"))
    near = _close(texts.withColumn("said", F.col("q")), keys.withColumn("theirs", F.col("key")), least)
    turn = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.desc("key")))
    near = near.withColumn("turn", turn).where(F.col("turn") <= most).select("q", "key", F.struct(F.lit(1).alias("later"), F.lit(0.0).alias("by"), F.col("turn").alias("turn")).alias("o"))
    named = held.unionByName(near).join(keys, "key").groupBy("q", "name").agg(F.min(F.struct("o", "key")).alias("o"))
    place = F.row_number().over(Window.partitionBy("q").orderBy("o"))
    return _answer(asks, named.withColumn("place", place).where(F.col("place") <= most).select("q", "place", "name"))


def state_at_lag(states: DataFrame, asks: DataFrame, lag: float) -> DataFrame:
    """(ask, t, value): the latest state at least ``lag`` old, else the oldest. Both sides are keyed; one sorted pass a key."""
    both = states.select("camera_id", F.col("t").alias("at"), F.struct("t", "value").alias("s"), F.lit(None).cast("bigint").alias("ask")).unionByName(
        asks.select("camera_id", (F.col("t") - lag).alias("at"), F.lit(None).cast("struct<t:double,value:double>").alias("s"), "ask")
    )
    w = Window.partitionBy("camera_id").orderBy("at", F.col("ask").isNotNull())
    oldest = F.min("s").over(Window.partitionBy("camera_id"))
    met = both.withColumn("found", F.coalesce(F.last("s", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), oldest)).where("ask is not null")
    return met.select("ask", "found.t", "found.value")
