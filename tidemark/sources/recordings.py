"""Reading recordings, their lists, logs and frames with Spark's own readers, so any store that Spark reaches will do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import seconds_of

#: File kinds that count as recordings; rules that a stage picture's name may end in.
VIDEO = ("mp4", "mov", "mkv", "webm")
RULES = ("ナワバリ", "エリア", "ヤグラ", "ホコ", "アサリ")


def scan(spark: SparkSession, root: str) -> DataFrame:
    """``path, name, size, modified`` of the recordings under a folder. Contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{%s}" % ",".join(VIDEO)).load(root)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def changed(now: DataFrame, before: DataFrame, at: Column, settle: float = 15.0) -> DataFrame:
    """Add ``growing`` (larger than at the last look) and ``recent`` (changed within ``settle`` seconds of ``at``)."""
    met = now.join(before.select("path", F.col("size").alias("_size")), "path", "left")
    return met.select(*now.columns, F.coalesce(F.col("size") > F.col("_size"), F.lit(False)).alias("growing"), (F.unix_seconds(at) - F.unix_seconds("modified") < settle).alias("recent"))


def unfinished(files: DataFrame, known: DataFrame, done: str = "ready") -> DataFrame:
    """Files that no finished recording stands for."""
    return files.join(known.where(F.col("status") == done), "path", "left_anti")


#: What a decoder prints about a stream: its kind, then comma-separated fields, of which the first is the codec.
STREAM = r"(?m)\b%s: *(\S[^\n]*)$"


def _fields(text: Column, kind: str) -> Column:
    """The comma-separated fields of the first stream of a kind; those in brackets stay whole."""
    return F.split(F.nullif(F.regexp_extract(text, STREAM % kind, 1), F.lit("")), r", *(?![^(\[]*[)\]])")


def _first(fields: Column, pattern: str, group: int) -> Column:
    """A group of the first field that a pattern matches whole."""
    return F.regexp_extract(F.get(F.filter(fields, lambda f: f.rlike(f"^{pattern}$")), 0), f"^{pattern}$", group)


def probe(text: Column) -> Column:
    """Duration, codec, size and rate out of what a decoder prints about a file; null without a duration or picture."""
    video, audio = _fields(text, "Video"), _fields(text, "Audio")
    codec = lambda f: F.nullif(F.get(F.split(F.get(f, 0), " "), 0), F.lit(""))
    size, rate = r"(\d+)x(\d+)(?: .*)?", r"(\d+(?:\.\d+)?) fps"
    duration = seconds_of(F.regexp_extract(text, r"\bDuration: *([0-9:.]+)", 1))
    found = F.struct(
        duration.alias("duration"),
        F.lower(codec(video)).alias("codec"),
        _first(video, size, 1).try_cast("int").alias("width"),
        _first(video, size, 2).try_cast("int").alias("height"),
        _first(video, rate, 1).try_cast("double").alias("fps"),
        codec(audio).alias("audio_codec"),
    )
    return F.when(duration.isNotNull() & codec(video).isNotNull(), found)


def segment_lists(spark: SparkSession, path: str) -> DataFrame:
    """``file_name, start, end, duration`` from lists of name,start,end lines; malformed and empty spans are dropped."""
    lines = spark.read.schema("name string, start double, end double, more string").option("mode", "PERMISSIVE").csv(path)
    rows = lines.where("name is not null and more is null").select(F.element_at(F.split("name", r"[/\\]"), -1).alias("file_name"), "start", "end")
    return rows.where("start >= 0 and end > start").withColumn("duration", F.col("end") - F.col("start"))


def ini_values(spark: SparkSession, path: str) -> DataFrame:
    """``file, section, name, value`` of every entry; a heading holds for the lines after it, within its file."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("n", "line"))
    bare = F.trim("line")
    heading = F.when(F.startswith(bare, F.lit("[")) & F.endswith(bare, F.lit("]")), F.substring(bare, F.lit(2), F.length(bare) - 2))
    held = text.withColumn("section", F.last(heading, ignorenulls=True).over(Window.partitionBy("file").orderBy("n")))
    parts = F.split("line", "=", 2)
    entry = held.where(F.contains("line", F.lit("=")) & ~F.startswith(bare, F.lit("["))).select("file", "section", F.trim(F.get(parts, 0)).alias("name"), F.trim(F.get(parts, 1)).alias("value"))
    return entry.where("name <> ''").select("file", F.coalesce("section", F.lit("")).alias("section"), "name", F.replace("value", F.lit("\\\\"), F.lit("\\")).alias("value"))


def recording_roots(values: DataFrame) -> DataFrame:
    """The folder each profile records to, by its mode; one of those that differ in case alone."""
    pick = lambda s, n: F.max(F.when((F.col("section") == s) & (F.col("name") == n), F.col("value")))
    by = values.groupBy("file").agg(F.when(pick("Output", "Mode") == "Advanced", pick("AdvOut", "RecFilePath")).otherwise(pick("SimpleOutput", "FilePath")).alias("root"))
    return by.where("root is not null and root <> ''").groupBy(F.lower("root").alias("k")).agg(F.min("root").alias("root")).drop("k")


def stage_catalog(names: DataFrame, name: str = "name") -> DataFrame:
    """``stage, rule, name`` from picture names stage_rule.webp."""
    part = lambda k: F.regexp_extract(F.col(name), rf"^(.*)_({'|'.join(RULES)})\.webp$", k)
    return names.select(part(1).alias("stage"), part(2).alias("rule"), F.col(name).alias("name")).where("rule <> ''").distinct()


def catalog_version(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``version``: a digest that any change of a catalog changes, whatever order its rows come in."""
    row = F.struct(*columns)
    total = lambda h: F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).cast("string")
    sums = F.concat_ws("/", F.count("*").cast("string"), total(F.xxhash64(row)), total(F.xxhash64(F.lit(1), row)))
    return rows.agg(F.sha2(sums, 256).alias("version"), F.count("*").alias("entries"))


_FILES = "path string, modificationTime timestamp, length long, content binary"


def _cut(files: DataFrame, width: int, height: int, interval: float, start: float, end: float | None, every: int) -> DataFrame:
    size = width * height * 3
    count = F.floor(F.col("length") / size).cast("int")
    numbered = files.where(count > 0).select("path", "content", F.explode(F.sequence(F.lit(0), count - 1)).alias("n"))
    timed = numbered.withColumn("t", F.round(F.col("n") * interval, 3)).where((F.col("t") >= start) & (F.pmod("n", F.lit(every)) == 0))
    if end is not None:
        timed = timed.where(F.col("t") < end)
    return timed.select("path", "n", "t", F.substring("content", F.col("n") * size + 1, F.lit(size)).alias("rgb"))


def fragment_frames(spark: SparkSession, path: str, width: int, height: int, interval: float, start: float = 0.0, end: float | None = None, every: int = 1) -> DataFrame:
    """``path, n, t, rgb`` of packed RGB24 recordings in a store that Spark alone reaches, one row per frame.

    A file is one row of Spark's own reader, so a recording is stored in fragments that fit a task; others are read by :func:`tidemark.sources.frame_source.frames`."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return _cut(files, width, height, interval, start, end, every)


def fragment_stream(spark: SparkSession, path: str, width: int, height: int, interval: float, every: int = 1) -> DataFrame:
    """The frames of whole fragments as they are added to a folder of such a store."""
    files = spark.readStream.schema(_FILES).format("binaryFile").load(path)
    return _cut(files, width, height, interval, 0.0, None, every)


def with_previous(rows: DataFrame) -> DataFrame:
    """Add ``previous``: the frame before, null for the first of a file."""
    return rows.withColumn("previous", F.lag("rgb").over(Window.partitionBy("path").orderBy("n")))
