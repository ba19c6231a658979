"""Registered queries that SQL can't express: folds and streams over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import folds, joins, matching, monotone, penalty, picks, segments, windows
from tidemark.operators.tables import scratch
from tidemark.plans.adapters import timeline
from tidemark.streaming import flows, lifecycle

SESSION_GAP = 21_600.0
KEYS = ["key", "session"]


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timelines cut by session: a fold's group is one session, however many events a key has."""
    return windows.gap_sessions(timeline(spark, sf_dir), ["key"], ["t", "id"], SESSION_GAP)


def _readings(rows: DataFrame) -> DataFrame:
    """Each event as a noisy reading of a counter that runs down from 100."""
    run = rows.withColumn("value", F.greatest(F.lit(0), F.lit(100) - F.floor(F.col("value")).cast("int")))
    reading = F.struct(F.col("value").cast("int").alias("value"), (F.pmod("id", F.lit(40)) / 100).alias("cost"), F.lit(1).alias("support"))
    return run.select(*KEYS, "t", "id", F.when(F.col("kind") != "error", F.array(reading)).otherwise(F.array().cast(reading_type())).alias("candidates"), F.lit(True).alias("visible"))


def reading_type() -> str:
    return "array<struct<value: int, cost: double, support: int>>"


def viterbi_monotone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monotone.monotone_counts(_readings(_sessions(spark, sf_dir)), KEYS)


def greedy_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.greedy_counts(_readings(_sessions(spark, sf_dir)), KEYS, rate=folds.RATES["area"])


def penalty_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _readings(_sessions(spark, sf_dir)).withColumns({"visible": F.size("candidates") > 0, "other_visible": F.pmod("id", F.lit(3)) > 0})
    return penalty.penalty_counts(rows, KEYS)


def smooth_flips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.smooth_flips(_sessions(spark, sf_dir).withColumn("confidence", F.lit(0.9)), KEYS, "t", "kind", "confidence", 40_000.0, tie=["id"])


def greedy_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return picks.greedy_spacing(_sessions(spark, sf_dir), KEYS, ["t", "id"], 1800.0)


def greedy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = _sessions(spark, sf_dir).select(*KEYS, "kind", F.col("t"), (F.col("t") + F.col("value") * 60).alias("end"), F.lit(0.7).alias("confidence"))
    return matching.match_evidence(spans.where("kind = 'error'").drop("kind"), spans.where("kind = 'click'").drop("kind"), KEYS)


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sessions(spark, sf_dir).select(*KEYS, "t", "id", (F.col("value") * 3).alias("x"), F.pmod("id", F.lit(97)).cast("double").alias("y"), F.col("value").alias("score"))


def cluster_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.cluster_points(_points(spark, sf_dir), KEYS, ["t", "id"], 18.0)


def track_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.track_objects(_points(spark, sf_dir), KEYS, "t", 60.0)


def longest_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.longest_chain(_points(spark, sf_dir), KEYS, "t", 40.0, 7200.0)


def suppress_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.suppress_peaks(_points(spark, sf_dir), KEYS, 32.0, 6)


def match_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timelines read as recordings with a frame per event."""
    v = F.col("value")
    frames = timeline(spark, sf_dir).select("key", F.col("t").alias("time"), (v * 2).alias("brightness"), F.lit(0.3).alias("saturation"), v.alias("difference"), (v / 1000).alias("hud_white_ratio"), (v / 500).alias("hud_edge_ratio"), F.when(F.col("kind") == "signup", 0.25).otherwise(0.9).alias("center_dark_ratio"), F.lit(0.05).alias("center_white_ratio"), F.lit(0.12).alias("center_edge_ratio"))
    classified = segments.classify(frames, "key")
    return segments.segments(classified, classified.groupBy("key").agg(F.max("time").alias("duration")), "key", 2.0)


def hidden_then_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings near a hidden time are dropped before they are decoded."""
    rows = _sessions(spark, sf_dir)
    seen = joins.suppress_near(rows, rows.where("kind = 'error'").select(*KEYS, "t"), KEYS, "t", 300.0)
    return monotone.monotone_counts(_readings(seen), KEYS)


def _observations(events: DataFrame) -> DataFrame:
    t = (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t")
    kind = F.when(F.col("event_type").isin("signup", "view"), "intro").when(F.col("event_type") == "click", "outcome").otherwise("result").alias("kind")
    return events.select(F.col("user_id").alias("key"), t, kind, F.when(F.col("event_type") == "error", 0.0).otherwise(1.0).alias("value"))


def lifecycle_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The match lifecycle over finished timelines; times are scaled so that events fall within its windows."""
    seen = _observations(spark.read.parquet(f"{sf_dir}/events.parquet"))
    return lifecycle.lifecycle_batch(seen.withColumn("t", F.col("t") / 1e5), "key")


def stream_gap_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions found by a stream that takes in the event files and stops."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    timed = stream.select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"))
    at = scratch(spark)
    flows.run_once(flows.sessions(timed, ["key"], "ts", f"{int(SESSION_GAP)} seconds"), f"{at}/log", f"{at}/state", "complete")
    seconds = lambda c: F.round(F.unix_micros(c) / 1e6, 3)
    return spark.read.parquet(f"{at}/log").select("key", "rows", seconds("start").alias("start"), seconds("end").alias("end"))


QUERIES = [viterbi_monotone, greedy_decode, penalty_decode, smooth_flips, greedy_spacing, greedy_match, cluster_points, track_objects, longest_chain, suppress_peaks, match_segments, hidden_then_counts, lifecycle_events, stream_gap_sessions]
