"""Recordings as a data source: windows cost their own bytes, growing files are read once."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, StringContains

from tidemark.sources import frame_source
from tidemark.streaming import flows

SIZE = 12


def frame(n):
    return bytes((n * 7 + i) % 256 for i in range(SIZE))


def recording(path, frames, start=0, tail=b""):
    with open(path, "ab") as f:
        f.write(b"".join(frame(n) for n in range(start, start + frames)) + tail)


def options(path, **more):
    return {"path": str(path), "width": "2", "height": "2", "interval": "0.25", **{k: str(v) for k, v in more.items()}}


def told(reader):
    return [(r["path"].rsplit("/", 1)[1], r["n"], r["t"], bytes(r["rgb"])) for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]


@pytest.fixture
def read_bytes(monkeypatch):
    """What is read of files, as (offset, length)."""
    seen, plain = [], frame_source.opened

    class Watched:
        def __init__(self, file):
            self.file = file

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.file.close()

        def read_at(self, n, offset):
            seen.append((offset, n))
            return self.file.read_at(n, offset)

    monkeypatch.setattr(frame_source, "opened", lambda path: Watched(plain(path)))
    return seen


def test_a_window_reads_its_own_bytes(tmp_path, read_bytes):
    recording(tmp_path / "a.rgb", 1000, tail=b"part")
    got = told(frame_source.FrameReader(options(tmp_path, start=100.0, end=102.0)))
    assert got == [("a.rgb", n, n * 0.25, frame(n)) for n in range(400, 408)]
    assert read_bytes == [(400 * SIZE, 8 * SIZE)]
    read_bytes.clear()
    got = told(frame_source.FrameReader(options(tmp_path, start=100.0, end=110.0, every=10)))
    assert [r[1] for r in got] == [400, 410, 420, 430]
    assert sum(n for _, n in read_bytes) == 4 * SIZE


def test_filters_narrow_what_is_read(tmp_path, read_bytes):
    recording(tmp_path / "a.rgb", 1000)
    for filters, want in [
        ([GreaterThanOrEqual(("t",), 10.0), LessThan(("t",), 11.0)], range(40, 44)),
        ([GreaterThan(("t",), 10.0), LessThanOrEqual(("t",), 11.0)], range(41, 45)),
        ([EqualTo(("t",), 10.25)], range(41, 42)),
        ([EqualTo(("t",), 10.3)], range(0)),
        ([GreaterThan(("n",), 996)], range(997, 1000)),
        ([LessThan(("n",), 2), GreaterThan(("t",), 500.0)], range(0)),
        ([LessThan(("t",), -5.0)], range(0)),
    ]:
        read_bytes.clear()
        reader = frame_source.FrameReader(options(tmp_path))
        assert list(reader.pushFilters(filters)) == []
        assert [r[1] for r in told(reader)] == list(want)
        assert sum(n for _, n in read_bytes) == len(want) * SIZE
    other = StringContains(("path",), "a")
    assert list(frame_source.FrameReader(options(tmp_path)).pushFilters([other])) == [other]


def test_one_file_is_dealt_to_many_tasks(spark, tmp_path):
    recording(tmp_path / "a.rgb", 1000, tail=b"x")
    recording(tmp_path / "b.rgb", 3)
    (tmp_path / "_hidden").write_bytes(b"x" * 100)
    df = frame_source.frames(spark, str(tmp_path), 2, 2, 0.25, partition_bytes=100 * SIZE)
    assert df.rdd.getNumPartitions() == 11
    rows = df.groupBy(F.element_at(F.split("path", "/"), -1).alias("name")).agg(F.count("*").alias("k"), F.countDistinct("n").alias("d"), F.max("t").alias("t")).collect()
    assert sorted(map(tuple, rows)) == [("a.rgb", 1000, 1000, 249.75), ("b.rgb", 3, 3, 0.5)]
    assert frame_source.frames(spark, str(tmp_path / "b.rgb"), 2, 2, 0.25, start=9.0).count() == 0


def test_spark_pushes_comparisons_down(spark, tmp_path):
    recording(tmp_path / "a.rgb", 1000)
    df = frame_source.frames(spark, str(tmp_path), 2, 2, 0.25, partition_bytes=50 * SIZE).where("t >= 100 and t < 101 and n % 2 = 0")
    assert sorted(r["n"] for r in df.collect()) == [400, 402]
    assert df.rdd.getNumPartitions() == 1


def test_a_growing_file_is_read_once_over_restarts(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()

    def run():
        flows.run_once(frame_source.frame_stream(spark, str(source), 2, 2, 0.25), f"{tmp_path}/log", f"{tmp_path}/state")
        return sorted((r["path"].rsplit("/", 1)[1], r["n"], bytes(r["rgb"])) for r in spark.read.parquet(f"{tmp_path}/log").collect())

    recording(source / "a.rgb", 5, tail=frame(5)[:4])
    assert run() == [("a.rgb", n, frame(n)) for n in range(5)]
    with open(source / "a.rgb", "ab") as f:
        f.write(frame(5)[4:])
    recording(source / "a.rgb", 4, start=6)
    recording(source / "b.rgb", 2)
    want = [("a.rgb", n, frame(n)) for n in range(10)] + [("b.rgb", n, frame(n)) for n in range(2)]
    assert run() == want
    assert run() == want


def test_a_file_that_gets_shorter_is_an_error(tmp_path):
    recording(tmp_path / "a.rgb", 2)
    stream = frame_source.FrameStream(options(tmp_path))
    with pytest.raises(ValueError, match="shorter"):
        stream.partitions({f"{tmp_path}/a.rgb": 5}, stream.latestOffset())


def test_frames_fan_out_to_streams(spark, tmp_path):
    recording(tmp_path / "a.rgb", 9)
    df = frame_source.fan_out(frame_source.frames(spark, str(tmp_path), 2, 2, 0.25), {"hud": 1, "map": 2, "coarse": 8})
    got = {r["stream"]: r["ns"] for r in df.groupBy("stream").agg(F.sort_array(F.collect_list("n")).alias("ns")).collect()}
    assert got == {"hud": list(range(9)), "map": [0, 2, 4, 6, 8], "coarse": [0, 8]}


@pytest.mark.parametrize("every", [1, 3])
def test_small_frames_are_held_in_bounded_numbers(tmp_path, every):
    n = 3 * frame_source.BLOCK_FRAMES + 5
    path = tmp_path / "small"
    path.write_bytes(b"".join(b"%012d" % k for k in range(n)))
    layout = frame_source.Layout({"width": "2", "height": "2", "interval": "0.25", "every": str(every)})
    sizes, seen = [], []
    for batch in layout.read(frame_source.Range(str(path), 0, n)):
        sizes.append(len(batch))
        seen += [(k, int(rgb)) for k, rgb in zip(batch.column("n").to_pylist(), batch.column("rgb").to_pylist(), strict=True)]
    assert max(sizes) <= frame_source.BLOCK_FRAMES and seen == [(k, k) for k in range(0, n, every)]
    with pytest.raises(ValueError, match="shorter"):
        list(layout.read(frame_source.Range(str(path), 0, n + 9)))
