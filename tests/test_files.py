"""Readers and sinks on files as they come: broken lines, other scripts, results that must not be shown; and drawn trips."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from wayflow.operators import sampling
from wayflow.sources import files
from wayflow.storage import new_folder


def put(spark, text: str) -> str:
    path = new_folder(spark, "files")
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    return path


def test_broken_lines_are_counted(spark):
    lines = ['{"camera_id": "a", "t_wall": 1.0, "count_mean": 2}', "", '{"camera_id": "b", "t_wall": 2.0', "not json", '{"t_wall": 3.0}', '{"camera_id": "c", "other": [1]}']
    good, bad = files.read_readings(spark, put(spark, "\n".join(lines)))
    assert {(r["camera_id"], r["t_wall"]) for r in good.collect()} == {("a", 1.0), ("c", None)}
    assert bad.first()["bad"] == 3


def test_id_list(spark):
    path = put(spark, "# sensors\nA1\n  B2 \n\nA1\n#C3")
    assert {r["id"] for r in files.read_id_list(spark, path).collect()} == {"A1", "B2"}


def test_gazetteer(spark):
    nodes = spark.createDataFrame([(1, 51.5, -0.1), (2, 51.51, -0.1)], "node long, lat double, lon double")
    marks = [
        {"name": "Tower Bridge", "lat": 51.5001, "lon": -0.1, "aliases": ["टावर ब्रिज", "The Bridge!", "", "?"]},
        {"name": "Market", "lat": 51.5099, "lon": -0.1},
        {"name": "the bridge", "lat": 51.51, "lon": -0.1, "aliases": None},
        {"name": "Far away", "lat": 60.0, "lon": 5.0, "aliases": []},
    ]
    path = put(spark, json.dumps({"city": "x", "landmarks": marks}, indent=2, ensure_ascii=False))
    got = {(r["key"], r["name"], r["node"]) for r in files.read_gazetteer(spark, path, nodes).collect()}
    assert got == {("tower bridge", "Tower Bridge", 1), ("टावर ब्रिज", "Tower Bridge", 1), ("the bridge", "the bridge", 2), ("market", "Market", 2)}


SCORES = "forecaster string, mae double, tau double, damp double"


def test_published_whole_or_not_at_all(spark):
    path = new_folder(spark, "published")
    with pytest.raises(files.NotPublished, match="nothing"):
        files.read_published(spark, path, SCORES)
    made = lambda *rows: spark.createDataFrame(list(rows), SCORES)
    files.publish_validation(made(("blend", 1.0, 600.0, 0.0), ("historical", 1.2, 600.0, 0.0)), path, "log", True)
    for broken in (made(("blend", 9.0, None, 0.0)), made()):
        with pytest.raises(files.NotPublished, match="fitted"):
            files.publish_validation(broken, path, "log", True)
    with pytest.raises(Exception, match="halfway"):
        files.publish_validation(made(("blend", 9.0, 1.0, 0.0)).withColumn("mae", F.raise_error(F.lit("halfway")).cast("double")), path, "log", True)
    got = files.read_published(spark, path, SCORES).collect()
    assert {(r["forecaster"], r["mae"], r["source"], r["from_collector"]) for r in got} == {("blend", 1.0, "log", True), ("historical", 1.2, "log", True)}
    files.publish_validation(made(("blend", 0.5, 300.0, 0.5)), path, "log", True)
    assert [r["mae"] for r in files.read_published(spark, path, SCORES).collect()] == [0.5]
    files.publish_validation(made(("blend", 0.0, 300.0, 0.5)), path, "made up", False)
    with pytest.raises(files.NotPublished, match="real"):
        files.read_published(spark, path, SCORES)


def test_drawn_trips(spark):
    """In the band, in the asked shares, and the same whatever the partitions and the order of rows."""
    nodes = spark.range(4000).select(F.col("id").alias("node"), ((F.col("id") % 80) * 110.0).alias("x"), (F.floor(F.col("id") / 80) * 130.0).alias("y"))
    marks = nodes.where("node % 37 = 5").select("node")
    got = sampling.sample_od_pairs(spark, nodes, marks, 2000, 7).collect()
    assert {r["trip"] for r in got} == set(range(2000)) and len(got) == 2000
    between = [r for r in got if r["between_landmarks"]]
    assert abs(len(between) / 2000 - 0.65) < 0.04 and all(r["origin"] % 37 == r["dest"] % 37 == 5 for r in between)
    assert all(r["metres"] > 400 and r["origin"] != r["dest"] for r in between) and any(r["metres"] < 1800 for r in between)
    others = [r for r in got if not r["between_landmarks"]]
    assert all(1800 <= r["metres"] <= 7000 for r in others) and len({r["dest"] for r in others}) > 300
    again = sampling.sample_od_pairs(spark, nodes.repartition(7).orderBy(F.desc("x")), marks.repartition(3), 2000, 7)
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in got}
    assert {tuple(r) for r in sampling.sample_od_pairs(spark, nodes, marks, 2000, 8).collect()} != {tuple(r) for r in got}
    few = sampling.sample_od_pairs(spark, nodes, marks.limit(3), 50, 7).collect()
    assert not any(r["between_landmarks"] for r in few)


def test_trips_without_room(spark):
    """Nodes closer than the band: the first and the last node, as after all tries."""
    nodes = spark.createDataFrame([(k, 10.0 * k, 0.0) for k in range(5)], "node long, x double, y double")
    got = sampling.sample_od_pairs(spark, nodes, nodes.select("node"), 20, 1).collect()
    assert len(got) == 20 and {(r["origin"], r["dest"]) for r in got} == {(0, 4)}
    assert sampling.sample_od_pairs(spark, nodes.limit(0), nodes.select("node").limit(0), 5, 1).count() == 0
