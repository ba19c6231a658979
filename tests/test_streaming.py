"""Streams give what the batch gives."""

import pytest
from pyspark.sql import functions as F

from tidemark.streaming import flows, lifecycle

INTRO, RESULT = ("intro", 0.9), ("result", 1.0)


def story():
    rows = [(k, t + 1000.0 * m, *o) for k in (1, 2) for m in range(2) for t, o in [
        (10.0, ("intro", 0.5)), (11.0, INTRO), (12.0, INTRO), (200.0, ("outcome", 1.0)), (205.0, ("outcome", 1.0)),
        (210.0, RESULT), (211.0, RESULT), (211.25, RESULT), (211.5, RESULT), (212.0, ("result", 0.0)), (212.25, ("result", 0.0)), (213.0, ("result", 0.0)),
    ]]
    return sorted(rows, key=lambda r: (r[1], r[0]))


def test_lifecycle_of_a_match():
    state, events = lifecycle.fresh(), []
    for k, t, kind, value in story():
        if k == 1:
            events += [(e["event"], e["number"], e["start"], e["active_end"], e["end"]) for e in lifecycle.step(state, t, kind, value)]
    assert events[:3] == [("match-start", 1, 11.0, None, None), ("result-detected", 1, 11.0, 200.0, 211.75), ("match-finalized", 1, 11.0, 200.0, 212.0)]
    assert [e[1] for e in events] == [1, 1, 1, 2, 2, 2]


@pytest.mark.parametrize("files", [1, 4])
def test_lifecycle_stream_equals_batch(spark, tmp_path, files):
    schema = "key long, t double, kind string, value double"
    rows = story()
    size = -(-len(rows) // files)
    for i in range(files):
        spark.createDataFrame(rows[i * size : (i + 1) * size], schema).coalesce(1).write.parquet(f"{tmp_path}/in/part={i}")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    flows.run_once(lifecycle.lifecycle_stream(stream, "key"), f"{tmp_path}/log", f"{tmp_path}/state")
    got = spark.read.parquet(f"{tmp_path}/log").drop("batch")
    want = lifecycle.lifecycle_batch(spark.createDataFrame(rows, schema), "key")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert want.count() == 12


def test_publishing_twice_keeps_the_last(spark, tmp_path):
    write = flows.publish(f"{tmp_path}/log")
    first = spark.createDataFrame([("a", 1, "new"), ("b", 1, "new")], "id string, seq long, status string")
    again = spark.createDataFrame([("a", 2, "final")], "id string, seq long, status string")
    write(first, 0)
    write(again, 1)
    write(again, 1)  # a batch that runs again replaces itself
    rows = {r["id"]: r["status"] for r in flows.published(spark, f"{tmp_path}/log", "id", "seq").collect()}
    assert rows == {"a": "final", "b": "new"}
    flows.compact(spark, f"{tmp_path}/log", f"{tmp_path}/log2", "id", "seq")
    assert flows.published(spark, f"{tmp_path}/log2", "id", "seq").count() == 2


def test_windows_changes_and_retries(spark):
    rows = spark.createDataFrame([("a", "2024-01-01 00:00:10", 1), ("a", "2024-01-01 00:00:50", 1), ("a", "2024-01-01 00:01:10", 2)], "k string, ts string, v long").withColumn("ts", F.to_timestamp("ts"))
    counted = flows.windowed(rows, ["k"], "ts", "1 minute", None, [F.count("*").alias("n")]).orderBy("start").collect()
    assert [r["n"] for r in counted] == [2, 1]
    assert len(flows.windowed(rows, ["k"], "ts", "1 minute", "30 seconds", [F.count("*").alias("n")]).collect()) == 4
    wait = spark.createDataFrame([(1,), (3,), (30,)], "n long").select(flows.next_attempt(F.col("n"), F.timestamp_seconds(F.lit(0)), 30, 3600, 24).alias("at")).collect()
    assert [r["at"] and int(r["at"].timestamp()) for r in wait] == [30, 120, None]
    ticks = spark.createDataFrame([(i * 0.25,) for i in range(8)], "t double")
    assert [r["t"] for r in flows.decimated(ticks, "t", 4.0).orderBy("t").collect()] == [0.0, 0.5, 1.0, 1.5]


def test_changes_are_seen_once(spark, tmp_path):
    rows = [("a", "x", 1), ("a", "x", 2), ("a", "y", 3), ("b", "x", 4)]
    spark.createDataFrame(rows, "id string, body string, s long").withColumn("ts", F.timestamp_seconds("s")).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id string, body string, s long, ts timestamp").parquet(f"{tmp_path}/in")
    flows.run_once(flows.changes(stream, "id", ["body"], "ts", "1 hour"), f"{tmp_path}/log", f"{tmp_path}/state")
    assert sorted((r["id"], r["body"]) for r in spark.read.parquet(f"{tmp_path}/log").collect()) == [("a", "x"), ("a", "y"), ("b", "x")]


def test_samples_are_routed_to_their_match(spark):
    samples = spark.createDataFrame([(1, 5.0, "a"), (1, 15.0, "b"), (2, 15.0, "c")], "key long, t double, stream string")
    matches = spark.createDataFrame([(1, 1, 10.0, 20.0)], "key long, number long, start double, end double")
    assert [tuple(r) for r in flows.routed(samples, matches, "key", "t").collect()] == [(1, "b", 1, 5.0)]
