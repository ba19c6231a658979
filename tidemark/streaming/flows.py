"""Event-time sessions, windows, change detection and publishing on Structured Streaming.

Every transformation takes a streaming or a batch DataFrame, so a stream over a finished input gives the batch result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.joins import within_intervals


def sessions(events: DataFrame, keys: list[str], time: str, gap: str, late: str | None = None) -> DataFrame:
    """Sessions of events at most ``gap`` apart: start, last event, events. Events later than ``late`` are dropped."""
    timed = events.withWatermark(time, late) if late else events
    return timed.groupBy(*keys, F.session_window(time, gap).alias("w")).agg(F.min(time).alias("start"), F.max(time).alias("end"), F.count("*").alias("rows")).drop("w")


def windowed(events: DataFrame, keys: list[str], time: str, width: str, slide: str | None, measures: list[Column], late: str | None = None) -> DataFrame:
    """Measures over tumbling (no slide) or sliding windows of event time."""
    timed = events.withWatermark(time, late) if late else events
    return timed.groupBy(F.window(time, width, slide or width).alias("w"), *keys).agg(*measures).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "*").drop("w")


def decimated(samples: DataFrame, time: str, rate: float, keep: int = 2) -> DataFrame:
    """Every ``keep``-th sample of a stream with ``rate`` samples a second, told by its time alone."""
    return samples.where(F.pmod(F.floor(F.col(time) * rate + 0.5), F.lit(keep)) == 0)


def routed(samples: DataFrame, matches: DataFrame, key: str, time: str, usual: float = 600.0) -> DataFrame:
    """Samples of all streams inside a match (usually ``usual`` seconds long), timed from its start; those outside are dropped."""
    met = within_intervals(samples, matches.select(key, "number", "start", "end"), [key], time, usual)
    return met.select(*[c for c in samples.columns if c != time], "number", F.round(F.col(time) - F.col("start"), 3).alias(time))


def changes(rows: DataFrame, key: str, signature: list[str], time: str, late: str) -> DataFrame:
    """Each state of a key once within the watermark, however often it is reported."""
    marked = rows.withColumn("signature", F.sha2(F.concat_ws("\x1f", *[F.col(c).cast("string") for c in signature]), 256))
    return marked.withWatermark(time, late).dropDuplicatesWithinWatermark([key, "signature"])


def next_attempt(attempts: Column, last: Column, first: int, longest: int, most: int) -> Column:
    """When to try again: the wait doubles from ``first`` to ``longest`` seconds; null after ``most`` attempts."""
    wait = F.least(F.lit(float(longest)), first * F.pow(F.lit(2.0), F.greatest(attempts - 1, F.lit(0))))
    return F.when(attempts < most, F.timestamp_seconds(F.unix_seconds(last) + wait.cast("long")))


def publish(log: str):
    """A foreachBatch function: each batch goes to its own folder of a log, so a batch that runs again replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{log}/batch={batch_id}")

    return write


def published(spark: SparkSession, log: str, key: str, seq: str) -> DataFrame:
    """The last version of every key in a log of batches."""
    rows = spark.read.parquet(log)
    rest = [c for c in rows.columns if c not in (key, "batch")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(seq, "batch")).alias("r")).select(key, "r.*")


def compact(spark: SparkSession, log: str, to: str, key: str, seq: str) -> None:
    """Write the last versions as the first batch of a new log."""
    published(spark, log, key, seq).write.mode("overwrite").parquet(f"{to}/batch=0")


def run_once(stream: DataFrame, log: str, checkpoint: str, mode: str = "append") -> None:
    """Take in what there is and stop."""
    stream.writeStream.foreachBatch(publish(log)).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
