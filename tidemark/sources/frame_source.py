"""Recordings of packed RGB24 frames as a Spark data source: a window of a file costs its own bytes, and a growing file is a stream.

``spark.read.format("frames")`` with the options ``width, height, interval`` (seconds from one frame to the next), and where wanted ``every`` (a stride),
``start, end`` (seconds; the end is left out) and ``partitionBytes`` gives ``path, n, t, rgb``, one row per frame. A file is dealt in ranges of
bytes, so one file of any length is read by many tasks. Comparisons of ``n`` and ``t`` with constants narrow the ranges, as ``start``, ``end`` and ``every``
do; Spark wants ``spark.sql.python.filterPushdown.enabled`` for a source that takes comparisons, and :func:`registered` sets it for the session. Bytes after the last whole frame aren't a frame.

As a stream, an offset holds the number of whole frames of each file. Frames that were appended since the last batch are read, each once; after a restart the
checkpoint's offsets go on where they stopped. Files must only grow: one that got shorter is an error.

Paths are whatever pyarrow's file systems reach (local disks, HDFS, object stores). For a store that Spark alone reaches see
:func:`tidemark.sources.recordings.fragment_frames`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

#: Bytes that one task reads, and that it holds at a time.
PARTITION_BYTES, BLOCK_BYTES = 64 << 20, 4 << 20
#: Frames that a task holds at a time, however small they are.
BLOCK_FRAMES = 16_384
SCHEMA = pa.schema([("path", pa.string()), ("n", pa.int32()), ("t", pa.float64()), ("rgb", pa.binary())])


@dataclass
class Range(InputPartition):
    """Frames ``first`` to ``last`` (exclusive) of a file, every ``every``-th of all."""

    path: str
    first: int
    last: int


def listed(path: str) -> list[tuple[str, int]]:
    """Path and size of each file under a path, itself included; names that start with a dot or an underscore don't count."""
    store, inner = fs.FileSystem.from_uri(path)
    scheme = path.split("://", 1)[0] + "://" if "://" in path else ""
    info = store.get_file_info(inner)
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(inner, recursive=True))
    return sorted((scheme + f.path, f.size) for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_")))


def opened(path: str):
    store, inner = fs.FileSystem.from_uri(path)
    return store.open_input_file(inner)


class Layout:
    """Where frames lie in a file, and which are wanted."""

    def __init__(self, options):
        self.size = int(options["width"]) * int(options["height"]) * 3
        self.interval, self.every = float(options["interval"]), int(options.get("every", 1))
        self.step = max(1, int(options.get("partitionbytes", options.get("partitionBytes", PARTITION_BYTES))) // self.size)
        if self.size <= 0 or self.interval <= 0 or self.every <= 0:
            raise ValueError("width, height, interval and every are more than zero")
        self.low, self.high = 0, math.inf
        if "start" in options:
            self.narrow(GreaterThanOrEqual(("t",), float(options["start"])))
        if "end" in options:
            self.narrow(LessThan(("t",), float(options["end"])))

    def time(self, n: int) -> float:
        return round(n * self.interval, 3)

    def narrow(self, f) -> None:
        """Leave out frames that a comparison of ``n`` or ``t`` rules out; frames near a bound are looked at one by one."""
        column, value = f.attribute[0], f.value
        of = self.time if column == "t" else (lambda n: n)
        near = value / self.interval if column == "t" else value
        if not math.isfinite(near):
            return
        if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
            n = max(0, math.floor(near) - 2)
            while of(n) < value or (isinstance(f, GreaterThan) and of(n) == value):
                n += 1
            self.low = max(self.low, n)
        if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
            n = max(0, math.ceil(near) + 2)
            while n > 0 and (of(n - 1) > value or (isinstance(f, LessThan) and of(n - 1) == value)):
                n -= 1
            self.high = min(self.high, n)

    def ranges(self, path: str, first: int, last: int) -> list[Range]:
        first, last = max(first, self.low), min(last, self.high)
        step = self.step * self.every
        return [Range(path, a, min(a + step, last)) for a in range(first, int(last), step)] if last > first else []

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        """The wanted frames of a range. Neighbours are read together; with a stride only the wanted frames' bytes are."""
        size = self.size
        at_once = min(BLOCK_FRAMES, max(1, BLOCK_BYTES // size))
        numbers = range(-(-part.first // self.every) * self.every, part.last, self.every)
        with opened(part.path) as file:
            for k in range(0, len(numbers), at_once):
                own = numbers[k : k + at_once]
                raw = file.read_at(len(own) * size, own[0] * size) if self.every == 1 else b"".join([file.read_at(size, n * size) for n in own])
                if len(raw) < len(own) * size:
                    raise ValueError(f"{part.path} got shorter while it was read")
                # No object is made for a frame.
                ends = pa.py_buffer(np.arange(len(own) + 1, dtype=np.int32) * np.int32(size))
                rgb = pa.Array.from_buffers(pa.binary(), len(own), [None, ends, pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays([pa.array([part.path] * len(own)), pa.array(own, pa.int32()), pa.array([self.time(n) for n in own]), rgb], schema=SCHEMA)


class FrameReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.layout = options["path"], Layout(options)

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.attribute in (("n",), ("t",)) and f.value is not None:
                self.layout.narrow(f)
            else:
                yield f

    def partitions(self):
        # A reader needs a partition even where there is nothing to read.
        return [r for path, size in listed(self.path) for r in self.layout.ranges(path, 0, size // self.layout.size)] or [Range("", 0, 0)]

    def read(self, partition: Range):
        if partition.path:
            yield from self.layout.read(partition)


class FrameStream(DataSourceStreamReader):
    def __init__(self, options):
        self.path, self.layout = options["path"], Layout(options)

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {path: size // self.layout.size for path, size in listed(self.path)}

    def partitions(self, start: dict, end: dict):
        out = []
        for path, n in end.items():
            if n < start.get(path, 0):
                raise ValueError(f"{path} got shorter: {n} frames after {start[path]}")
            out += self.layout.ranges(path, start.get(path, 0), n)
        return out or [Range("", 0, 0)]

    def read(self, partition: Range):
        if partition.path:
            yield from self.layout.read(partition)

    def commit(self, end: dict) -> None:
        pass


class Frames(DataSource):
    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return "path string, n int, t double, rgb binary"

    def reader(self, schema) -> FrameReader:
        return FrameReader(self.options)

    def streamReader(self, schema) -> FrameStream:
        return FrameStream(self.options)


def _options(width: int, height: int, interval: float, every: int, start: float | None, end: float | None, partition_bytes: int | None) -> dict[str, str]:
    given = {"width": width, "height": height, "interval": interval, "every": every, "start": start, "end": end, "partitionBytes": partition_bytes}
    return {k: str(v) for k, v in given.items() if v is not None}


def registered(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(Frames)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def frames(spark: SparkSession, path: str, width: int, height: int, interval: float, start: float | None = None, end: float | None = None, every: int = 1, partition_bytes: int | None = None) -> DataFrame:
    """``path, n, t, rgb`` of the recordings at a path; only the bytes of the window's frames are read."""
    registered(spark)
    return spark.read.format("frames").options(**_options(width, height, interval, every, start, end, partition_bytes)).load(path)


def frame_stream(spark: SparkSession, path: str, width: int, height: int, interval: float, every: int = 1, partition_bytes: int | None = None) -> DataFrame:
    """The frames of recordings as they are appended, and of new recordings as they come."""
    registered(spark)
    return spark.readStream.format("frames").options(**_options(width, height, interval, every, None, None, partition_bytes)).load(path)


def fan_out(rows: DataFrame, strides: dict[str, int]) -> DataFrame:
    """Add ``stream``: a row for each stream that a frame belongs to; a stream takes every ``strides[stream]``-th frame of a recording."""
    named = F.array(*[F.when(F.pmod("n", F.lit(every)) == 0, F.lit(name)) for name, every in strides.items()])
    return rows.withColumn("stream", F.explode(F.filter(named, lambda s: s.isNotNull())))
