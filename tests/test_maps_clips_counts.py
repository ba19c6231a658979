"""Routes, predictions, clips and counter timelines on small cases."""

import math

import pytest
from pyspark.sql import functions as F

from tidemark.operators import clips, counts, maps

POINT = "key long, t double, x double, y double, direction double, confidence double"


@pytest.fixture(scope="module")
def points(spark):
    return spark.createDataFrame([(1, 10.0, 100.0, 100.0, 350.0, 0.8), (1, 14.0, 140.0, 100.0, 10.0, 0.6)], POINT)


def test_routes_and_predictions(spark, points):
    got = {r["t"]: r for r in maps.route(points, ["key"]).collect()}
    assert sorted(got) == [10.0, 11.0, 12.0, 13.0, 14.0]
    assert (got[12.0]["x"], got[12.0]["direction"], got[12.0]["source"]) == (120.0, 0.0, "inferred")
    assert got[12.0]["confidence"] == round(0.6 * math.exp(-2 / 18), 3)
    moved = maps.motion_predictions(points, ["key"]).orderBy("t").collect()
    assert [(r["t"], r["x"]) for r in moved] == [(14.0 + k, 140.0 + 10 * k) for k in range(7)]
    ahead = maps.heading_predictions(points, ["key"]).where("observed_at = 10").orderBy("t").collect()
    assert [r["t"] for r in ahead] == [10.0, 11.0, 12.0, 13.0] and ahead[3]["x"] == round(100 + math.cos(math.radians(350)) * 36, 1)


def test_threats_sights_and_episodes(spark, points):
    deaths = spark.createDataFrame([(1, 12.0, 0.9), (1, 60.0, 0.9)], "key long, t double, confidence double")
    zones = maps.threat_zones(deaths, points, ["key"]).orderBy("t").collect()
    assert [(r["t"], r["x"], r["radius"]) for r in zones] == [(12.0 + k, 140.0, 55.0 + 11 * k) for k in range(7)]
    frames = spark.createDataFrame([(1, "e", 10.0, 0.4, 0.2, 0.2, 0.6), (1, "e", 14.0, 0.4, 0.2, 0.2, 0.6)], "key long, id string, t double, x double, width double, height double, confidence double")
    own = points.select("key", "t", "x", "y", F.lit(0.0).alias("direction"), "confidence")
    seen = maps.sight_predictions(frames, own, ["key"]).orderBy("t").collect()
    assert [(r["t"], r["x"], r["radius"]) for r in seen][:2] == [(14.0, 250.0, 85), (15.0, 260.0, 113)]
    samples = [(1, float(t), True, 0.5, 0.5, (10.0 * t, 5.0, 90.0, c)) for t, c in ((1, 0.6), (2, 0.9), (3, 0.4), (9, 0.4), (20, 0.7))]
    df = spark.createDataFrame(samples, "key long, t double, visible boolean, neutral double, score double, marker struct<x: double, y: double, direction: double, confidence: double>")
    assert [(r["t"], r["x"], r["until"]) for r in maps.self_observations(df, ["key"]).orderBy("t").collect()] == [(2.0, 20.0, 3.0), (20.0, 200.0, 20.0)]
    maps_ = df.withColumn("structure", F.lit(0.3)).withColumn("visible", F.col("t") > 1)
    assert maps.best_frame(maps_.withColumn("score", F.lit(0.5) - F.col("t") / 100), deaths.select("key", F.lit(18.0).alias("t")), ["key"]).first()["t"] == 20.0


def test_fragments_clips_and_rebasing(spark):
    matches = spark.createDataFrame([(1, 1, 3.0, 9.0)], "key long, number int, start double, end double")
    parts = spark.createDataFrame([(1, "a", 0.0, 4.0), (1, "b", 4.0, 8.0), (1, "c", 8.0, 12.0), (1, "d", 12.0, 16.0)], "key long, file_name string, start double, end double")
    got = clips.fragment_manifest(matches, parts, "key").orderBy("source_start").collect()
    assert [(r["file_name"], r["timeline_start"]) for r in got] == [("a", 0.0), ("b", 4.0), ("c", 8.0)]
    series = spark.createDataFrame([(1, 2.0, "x"), (1, 3.5, "y")], "key long, t double, v string")
    assert [tuple(r) for r in clips.rebased(series, matches, "key").collect()] == [(1, 1, 0.5, "y")]
    patterns = spark.createDataFrame([(1, "p", 30.0, [("d1", -8.0, 2.0, "l"), ("d1", -8.0, 2.0, "l"), ("d2", 5.0, 20.0, "l"), ("d2", 1.8, 2.0, "l"), ("zz", 0.0, 5.0, "l")])], "key long, pattern string, duration double, clips array<struct<death_id: string, start: double, end: double, label: string>>")
    deaths = spark.createDataFrame([(1, "d1", 5.0), (1, "d2", 20.0)], "key long, id string, t double")
    ranges = clips.clip_ranges(patterns, deaths, ["key"])
    assert sorted((r["death_id"], r["start"], r["end"]) for r in ranges.collect()) == [("d1", 0.0, 7.0), ("d2", 25.0, 30.0)]
    times = spark.createDataFrame([(1, 6.0), (1, 15.0), (1, 17.0)], "key long, t double")
    assert {r["t"]: r["death_id"] for r in clips.nearest_clip(ranges, times, ["key"]).collect()} == {6.0: "d1", 15.0: "d1", 17.0: "d2"}


def test_count_timelines(spark):
    one = lambda v, c=0.05: [] if v is None else [(v, c, 1)]
    left = [None, 100, 100, 99, 98, None, 96, 0]
    right = [100, 100, 100, 100, 100, 100, 97, 97]
    rows = [(1, 10 + i * 0.5, one(a), one(b), one(12) if i >= 3 else [], []) for i, (a, b) in enumerate(zip(left, right, strict=True))]
    df = spark.createDataFrame(rows, f"key long, t double, left {counts.READING}, right {counts.READING}, left_penalty {counts.READING}, right_penalty {counts.READING}")
    got = counts.count_timeline(df, ["key"], 10.0, 100.0).orderBy("t").collect()
    assert [r["t"] for r in got] == [10.5 + 0.5 * i for i in range(7)]
    assert [r["team_count"] for r in got] == [100, 100, 99, 98, 97, 96, 96]
    assert [r["enemy_count"] for r in got] == [100, 100, 100, 100, 99, 97, 97]  # a panel counts only beside the other, so tick 4 is bridged
    assert [r["team_penalty"] for r in got][3:] == [12] * 4 and got[0]["enemy_penalty_source"] == "observed"
    summary = counts.count_summary(counts.count_timeline(df, ["key"], 10.0, 100.0), ["key"]).first()
    assert (summary["team_count"], summary["enemy_count"], summary["most_team_penalty"]) == (96, 97, 12)
    hidden = spark.createDataFrame([(1, 12.0)], "key long, t double")
    kept = counts.cleaned(df, ["key"], hidden).where("t between 11.3 and 12.7").collect()
    assert all(not r["left"] and not r["right"] for r in kept)
