"""Sources on files made here, kernels on small pictures with known answers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import columns as fx
from tidemark.operators.templates import bhattacharyya
from tidemark.sources import frame_source, recordings, stores
from tidemark.vision import kernels, udfs


def test_scan_probe_lists_and_profiles(spark, tmp_path):
    (tmp_path / "v").mkdir()
    for name, size in (("a.mp4", 5), ("b.txt", 3), ("c.MKV", 1), ("d.webm", 2)):
        (tmp_path / "v" / name).write_bytes(b"x" * size)
    found = recordings.scan(spark, f"file://{tmp_path}/v")
    assert sorted((r["name"], r["size"]) for r in found.collect()) == [("a.mp4", 5), ("d.webm", 2)]
    before = found.withColumn("size", F.lit(2))
    assert {r["name"]: r["growing"] for r in recordings.changed(found, before, F.current_timestamp()).collect()} == {"a.mp4": True, "d.webm": False}
    log = "Input #0\n Duration: 01:02:03.50, start\n Stream Video: H264 (High), yuv420p, 1920x1080, 59.94 fps, \n Audio: aac, 48000"
    got = spark.createDataFrame([(log,), ("no media",)], "s string").select(recordings.probe(F.regexp_replace("s", "\n", " ")).alias("p")).collect()
    assert tuple(got[0]["p"]) == (3723.5, "h264", 1920, 1080, 59.94, "aac") and got[1]["p"] is None
    (tmp_path / "list.csv").write_text('"/x/s0.mp4",0.0,4.0\nbad\ns1.mp4,4.0,9.5\ns2.mp4,5,5\n')
    assert [tuple(r) for r in recordings.segment_lists(spark, f"file://{tmp_path}/list.csv").orderBy("start").collect()] == [("s0.mp4", 0.0, 4.0, 4.0), ("s1.mp4", 4.0, 9.5, 5.5)]
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "one.ini").write_text("[Output]\nMode=Advanced\n[AdvOut]\nRecFilePath=D:\\\\rec\n[SimpleOutput]\nFilePath=E:\\\\x\n")
    (tmp_path / "p" / "two.ini").write_text("[SimpleOutput]\nFilePath=d:\\\\REC\n")
    roots = recordings.recording_roots(recordings.ini_values(spark, f"file://{tmp_path}/p"))
    assert [r["root"].lower() for r in roots.collect()] == ["d:\\rec"]
    names = spark.createDataFrame([("A_B_エリア.webp",), ("x.png",)], "name string")
    assert [tuple(r) for r in recordings.stage_catalog(names).collect()] == [("A_B", "エリア", "A_B_エリア.webp")]
    version = lambda rows: recordings.catalog_version(spark.createDataFrame(rows, "a string, b string"), ["a", "b"]).first()["version"]
    assert version([("1", "x"), ("2", "y")]) == version([("2", "y"), ("1", "x")]) != version([("1", "x")])


def test_documents_caches_and_capacity(spark, tmp_path):
    (tmp_path / "good").mkdir()
    (tmp_path / "bad").mkdir()
    (tmp_path / "good" / "a.json").write_text('{"version": 1,\n "id": "a"}')
    (tmp_path / "bad" / "a.json").write_text("{broken")
    schema = "version int, id string"
    at = lambda n: f"file://{tmp_path}/{n}"
    assert stores.read_documents(spark, at("good"), schema, 2).count() == 0
    for path in ("bad", "missing"):
        assert [r["id"] for r in stores.read_or_backup(spark, at(path), at("good"), schema).collect()] == ["a"]
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    for model in ("1", "1", "2"):
        assert stores.cached(spark, at("cache"), model, "k", make).count() == 3
    assert len(made) == 2
    assert stores.fits(spark.createDataFrame([(5,), (7,)], "s long"), "s", 3, 15).first()["fits"]


def test_frames_are_cut_timed_and_measured(spark, tmp_path):
    rng = np.random.default_rng(0)
    clip = rng.integers(0, 256, (5, 12, 16, 3), dtype=np.uint8)
    (tmp_path / "clip.rgb").write_bytes(clip.tobytes() + b"tail")
    rows = frame_source.frames(spark, f"file://{tmp_path}/clip.rgb", 16, 12, 0.25)
    assert [(r["n"], r["t"]) for r in rows.orderBy("n").select("n", "t").collect()] == [(i, i * 0.25) for i in range(5)]
    assert [r["n"] for r in frame_source.frames(spark, f"file://{tmp_path}/clip.rgb", 16, 12, 0.25, 0.5, 1.0).orderBy("n").collect()] == [2, 3]
    fragments = recordings.fragment_frames(spark, f"file://{tmp_path}/clip.rgb", 16, 12, 0.25)
    assert sorted((r["n"], r["t"], bytes(r["rgb"])) for r in fragments.collect()) == sorted((r["n"], r["t"], bytes(r["rgb"])) for r in rows.collect())
    got = udfs.frame_features(recordings.with_previous(rows), 16, 12).orderBy("n").collect()
    assert got[0]["difference"] == 0.0
    assert got[2]["difference"] == pytest.approx(np.abs(clip[2].astype(int) - clip[1].astype(int)).mean())
    assert got[3]["brightness"] == pytest.approx(clip[3].mean())
    cut = rows.select(udfs.cropped(F.col("rgb"), 16, 12, 2, 3, 4, 5).alias("c")).first()["c"]
    assert bytes(cut) == clip[0][3:8, 2:6].tobytes()
    histogram = rows.select(udfs.hue_histograms(F.col("rgb"), 16, 12).alias("h")).first()["h"]
    assert sum(histogram) == pytest.approx(1.0)


def test_fragments_stream_as_frames(spark, tmp_path):
    from tidemark.streaming import flows

    (tmp_path / "in").mkdir()
    for name, n in (("a.rgb", 2), ("b.rgb", 3)):
        (tmp_path / "in" / name).write_bytes(bytes(range(12)) * n)
    stream = recordings.fragment_stream(spark, f"file://{tmp_path}/in", 2, 2, 0.5)
    flows.run_once(stream, f"{tmp_path}/log", f"{tmp_path}/state")
    got = spark.read.parquet(f"{tmp_path}/log")
    assert sorted((r["n"], r["t"]) for r in got.select("n", "t").collect()) == [(0, 0.0), (0, 0.0), (1, 0.5), (1, 0.5), (2, 1.0)]
    assert bytes(got.first()["rgb"]) == bytes(range(12))


def test_components_holes_threshold_and_runs():
    mask = np.array([[1, 1, 0, 0], [0, 0, 1, 0], [0, 0, 0, 1], [1, 0, 0, 0]], bool)
    assert len(kernels.components(mask)) == 4 and sorted(c["area"] for c in kernels.components(mask, eight=True)) == [1, 4]
    ring = np.ones((5, 5), bool)
    ring[2, 2] = False
    assert kernels.holes(ring) == 1 and kernels.holes(np.ones((3, 3), bool)) == 0
    gray = np.array([10] * 50 + [200] * 50, np.uint8)
    assert 10 <= kernels.otsu(gray) < 200
    assert kernels.projection_runs(mask, 1) == [(0, 4)] and kernels.projection_runs(np.array([[1, 0, 1]], bool), 0) == [(0, 1), (2, 3)]


def test_glyphs_shifts_and_hues():
    one, bar = np.zeros((30, 20), bool), np.zeros((30, 20), bool)
    one[2:28, 9:11], bar[14:16, 2:18] = True, True
    shape = lambda m: (kernels.normalized_glyph(m), float(np.ptp(np.nonzero(m)[1]) + 1) / (np.ptp(np.nonzero(m)[0]) + 1))
    templates = [("one", *shape(one)), ("bar", *shape(bar))]
    assert [k for k, _ in kernels.nearest_glyphs(np.roll(one, 3, axis=1), templates)] == ["one", "bar"]
    image = np.zeros((12, 12))
    image[5:8, 6:9] = 1
    template = np.zeros((12, 12))
    template[4:7, 4:7] = 1
    score, dy, dx = kernels.shifted_correlation(image, template, 3)
    assert score == pytest.approx(1.0) and (dy, dx) == (1, 2)
    red = np.zeros((4, 4, 3), np.int16)
    red[..., 0] = 250
    degrees, share = kernels.hue_peak(kernels.hue_histogram(red))
    assert share == pytest.approx(1.0) and (degrees < 20 or degrees > 340)
    moved = red.copy()
    moved[1:3] = 0
    assert [c["area"] for c in kernels.colour_motion(red, moved, 0.0, least_area=4)] == [8]


def test_column_functions(spark):
    row = lambda *c: tuple(spark.range(1).select(*c).first())
    assert row(fx.half_up(F.lit(-2.5)), fx.half_up(F.lit(2.5)), fx.clock(F.lit(125.9)), fx.clamp(F.lit(7), 0, 5)) == (-2, 3, "02:05", 5)
    assert row(fx.formatted(F.lit(0.256), "percent"), fx.formatted(F.lit(None).cast("double"), "ratio"), fx.formatted(F.lit(3.0), "seconds")) == ("25.6%", "—", "3.0秒")
    assert row(fx.bucket(F.lit(5), fx.DEATH_BUCKETS), fx.bucket(F.lit(9), fx.DEATH_BUCKETS), fx.bucket(F.lit(None).cast("int"), fx.DEATH_BUCKETS)) == ("3–5デス", "9デス以上", None)
    assert row(fx.outcome_label(F.lit(None).cast("string"), F.lit(10), F.lit(30)), fx.outcome_label(F.lit("lose"), F.lit(1), F.lit(2))) == ("WIN", "LOSE")
    assert row(fx.normalized_name(F.lit("ス・プ ラ.")), fx.blank_to_null(F.lit("  ")), fx.finite(F.lit("x")), fx.finite(F.lit("2.5"))) == ("スプラ", None, None, 2.5)
    at = row(fx.recorded_at(F.lit("rec 2024-03-01 10-20-30.mkv"), F.lit(65.7)).cast("string"))[0]
    assert at == "2024-03-01 10:21:35"
    assert row(F.round(bhattacharyya(F.array(F.lit(0.5), F.lit(0.5)), F.array(F.lit(0.5), F.lit(0.5))), 6), fx.seconds_of(F.lit("1:01:01.5"))) == (0.0, 3661.5)
    assert row(stores.thumbnail_time(F.lit(10.0), F.lit(300.0)), stores.thumbnail_time(F.lit(10.0), F.lit(1.0))) == (45.0, 11.0)
