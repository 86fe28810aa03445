"""Geocoding against a plain scan of the gazetteer, text by text."""

from __future__ import annotations

import difflib
import random

from wayflow.functions import traffic as tf
from wayflow.operators import places as pl
from wayflow.storage import save

MARKS = ["park circus", "city hall", "ab", "grand hotel", "old fort", "new market"]
STREETS = ["park street", "city hall road", "mayo road", "canal west road", "fort lane", "axb", "market road", "old mill road"]
TEXTS = ["Park Circus", "near city hall please", "parkk sirkus", "cty hall", "mayo rd", "mayyo road", "west canal", "fort", "axb", "aab", "zzzz", "road", "old mil road", "hotel grand", "gramd hotle", "nw markt", "ab", "b", "51.4903, -0.1512", "80.5,10.25", "  "]


def scan(text: str, marks: list, places: list, sounds: dict):
    if text in marks or text in places:
        return text, "exact"
    held = [k for k in marks if text in k or k in text]
    if held:
        return min(held, key=lambda k: (len(k), k)), "phrase"
    if near := difflib.get_close_matches(text, marks, 1, 0.8):
        return near[0], "typo"
    if near := difflib.get_close_matches(sounds[text], [sounds[m] for m in marks], 1, 0.9):
        return next(m for m in marks if sounds[m] == near[0]), "typo"
    held = [k for k in places if text in k or k in text]
    if held:
        return min(held, key=lambda k: (len(k), k)), "partial"
    mine = set(text.split())
    scored = sorted(((len(mine & set(k.split())) / len(mine | set(k.split())), k) for k in places), reverse=True)[:5]
    held = [k for s, k in scored if s >= 0.34]
    if held:
        return min(held, key=len), "partial"
    if near := difflib.get_close_matches(text, places, 1, 0.8):
        return near[0], "typo"
    return None


def fixture(spark):
    r = random.Random(5)
    made = ["".join(r.choice("abcde ") for _ in range(r.randrange(1, 9))).strip() or "e" for _ in range(150)]
    texts = spark.createDataFrame(list(enumerate(TEXTS + made)), "id long, t string")
    rows = [(k, i, "landmark", k.title()) for i, k in enumerate(MARKS)] + [(k, 100 + i, "street", k.title()) for i, k in enumerate(STREETS)]
    return save(pl.asked(texts, "t", "id"), "asks"), spark.createDataFrame(rows, "key string, node long, kind string, name string")


def test_cascade_as_the_scan(spark):
    asks, places = fixture(spark)
    nodes = spark.createDataFrame([(0, 0.0, 51.49 * 110540.0), (1, 9.0, 80.5 * 110540.0)], "node long, x double, y double")
    rows = asks.collect()
    words = sorted({r["q"] for r in rows} | set(MARKS))
    sounds = {r["t"]: r["s"] for r in spark.createDataFrame([(w,) for w in words], "t string").select("t", tf.sound_key("t").alias("s")).collect()}
    got = {r["ask"]: (r["key"], r["stage"]) for r in pl.geocode_cascade(asks, places, nodes, 51.49).collect()}
    seen = set()
    for r in rows:
        if "," in r["text"]:
            assert got[r["ask"]] == (("51.49030, -0.15120" if r["text"][0] == "5" else "80.50000, 10.25000"), "exact")
            continue
        want = scan(r["q"], MARKS, STREETS + MARKS, sounds)
        assert got.get(r["ask"]) == want, r["text"]
        seen.add(want and want[1])
    assert seen >= {"exact", "phrase", "typo", "partial", None}


def test_suggestions_as_the_scan(spark):
    asks, places = fixture(spark)
    keys = STREETS + MARKS
    got: dict = {}
    for r in pl.suggest_names(asks, places).orderBy("ask", "place").collect():
        got.setdefault(r["ask"], []).append(r["name"])
    for r in asks.collect():
        held = sorted((k for k in keys if r["q"] in k), key=lambda k: (len(k), k))
        want = list(dict.fromkeys(k.title() for k in held + difflib.get_close_matches(r["q"], keys, 6, 0.7)))[:6]
        assert got.get(r["ask"], []) == want, r["text"]


def test_no_requests_no_places(spark):
    asks, places = fixture(spark)
    assert pl.geocode_cascade(asks.where("false"), places).count() == 0
    assert pl.geocode_cascade(asks, places.where("false")).count() == 0


def test_requests_for_one_text_cost_one_text(spark):
    """Texts are normalised, and go through the stages of the cascade, once each; requests meet their answers in one join, which keeps all of them."""
    rows = spark.range(3000).selectExpr("id as ask", "array('Large Ring', 'large rimg', '', null)[cast(id % 4 as int)] as text")
    asks = pl.asked(rows, "text", "ask")
    places = spark.createDataFrame([("large ring", 7, "landmark", "Large Ring")], "key string, node long, kind string, name string")
    assert sorted((r["text"], r["q"], r["count"]) for r in asks.groupBy("text", "q").count().collect()) == [("Large Ring", "large ring", 750), ("large rimg", "large rimg", 750)]
    assert "regexp_replace" not in asks._jdf.queryExecution().optimizedPlan().toString()  # it was run on distinct texts, before
    found = pl.geocode_cascade(asks, places)
    assert sorted((r["key"], r["node"], r["stage"], r["count"]) for r in found.groupBy("key", "node", "stage").count().collect()) == [("large ring", 7, "exact", 750), ("large ring", 7, "typo", 750)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 1
