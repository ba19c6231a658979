"""Registered queries of recordings, live collection and jobs over the driver's tables, beside their DuckDB SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import joins, monotone, picks
from tidemark.operators.tables import scratch
from tidemark.plans.adapters import TIMELINE_SQL, table, timeline
from tidemark.plans.fold_queries import _readings
from tidemark.sources import frame_source
from tidemark.streaming import collector, flows, ledger

QUERIES: dict = {}
SQL: dict[str, str] = {}
KEY, ORDER = ["key"], ["t", "id"]


def registered(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


# Recordings ----------------------------------------------------------------------------------------------------------


def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as frames of 12 bytes, by day: eleven digits of the event's number and the line's end."""
    events = table(spark, sf_dir, "events")
    return events.select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_id", F.lpad(F.pmod("event_id", F.lit(100_000_000_000)).cast("string"), 11, "0").alias("value"))


def _recorded(days: DataFrame, path: str) -> str:
    """One recording for each day, its frames in the events' order."""
    days.repartition("day").sortWithinPartitions("day", "event_id").select("day", "value").write.mode("append").partitionBy("day").text(path)
    return path


def _seen(frames: DataFrame) -> DataFrame:
    return frames.select(F.regexp_extract("path", "day=([0-9-]+)/", 1).alias("day"), "n", "t", F.trim(F.replace(F.col("rgb").cast("string"), F.lit("\n"))).cast("long").alias("value"))


_FRAMES = "f AS (SELECT strftime(ts, '%Y-%m-%d') AS day, event_id, row_number() OVER (PARTITION BY strftime(ts, '%Y-%m-%d') ORDER BY event_id) - 1 AS n FROM events)"


@registered(f"WITH {_FRAMES} SELECT day, n::INTEGER AS n, (n * 0.25)::DOUBLE AS t, event_id % 100000000000 AS value FROM f WHERE n % 2 = 0 AND n * 0.25 >= 2.0 AND n * 0.25 < 30")
def recording_window(spark, sf_dir):
    """Every other frame from second 2 to 30 of each day's recording; no other frame's bytes are read."""
    path = _recorded(_days(spark, sf_dir), f"{scratch(spark)}/recordings")
    return _seen(frame_source.frames(spark, path, 2, 2, 0.25, start=2.0, every=2)).where("t < 30")


@registered(f"WITH {_FRAMES} SELECT day, count(*) AS frames, sum(event_id % 100000000000)::BIGINT AS total, max(n * 0.25)::DOUBLE AS last FROM f GROUP BY day")
def recording_tail(spark, sf_dir):
    """Recordings that come while a stream reads them, in two runs of it from one checkpoint."""
    at = scratch(spark)
    days = _days(spark, sf_dir)
    later = F.pmod(F.xxhash64("day"), F.lit(3)) == 0
    for part in (days.where(~later), days.where(later)):
        path = _recorded(part, f"{at}/recordings")
        flows.run_once(_seen(frame_source.frame_stream(spark, path, 2, 2, 0.25)), f"{at}/log", f"{at}/state")
    return spark.read.parquet(f"{at}/log").groupBy(F.col("day").cast("string").alias("day")).agg(F.count("*").alias("frames"), F.sum("value").alias("total"), F.max("t").alias("last"))


# Live collection -----------------------------------------------------------------------------------------------------


def _observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of neighbouring users as one recording with a row every quarter of a second; each 400 rows tell a match's story.

    What a row says of the story comes from the event: which kills are read, who wins, what is sampled."""
    events = table(spark, sf_dir, "events")
    n = F.row_number().over(Window.partitionBy("key").orderBy("event_id")) - 1
    rows = events.select((F.col("user_id") / 40).cast("long").alias("key"), "event_id", "value").withColumn("n", n).withColumn("p", F.col("n") % 400)
    p = F.col("p")
    coarse = p.isin(0, 2) | (p % 40 == 0)
    result, after, outcome = p.between(300, 307), p.between(308, 320), p.isin(250, 252, 254)
    streams = F.array(*[F.lit(s) for s in ("battle_hud", "respawn", "perception", "score_count", "objective_count")])
    stream = F.when(coarse, "coarse").when(result | after | outcome, "full").otherwise(F.get(streams, (p % 5).cast("int")))
    reading = F.to_json(F.struct(F.array(F.struct(F.greatest(F.lit(0), 100 - p / 4).cast("int").alias("value"), F.lit(0.05).alias("cost"), F.lit(1).alias("support"))).alias("candidates")))
    return rows.select(
        "key", stream.alias("stream"), (F.col("n") * 0.25).alias("t"), F.when(coarse, F.when(p.isin(0, 2), 0.9).otherwise(0.1)).when(result, 0.8).alias("score"), result.alias("result"),
        F.when(result, F.pmod(F.floor("value"), F.lit(2))).cast("int").alias("kills"), F.when(result, 3).alias("deaths"), F.when(outcome, F.when(F.col("event_id") % 2 == 0, "win").otherwise("lose")).alias("outcome"),
        F.when(stream == "score_count", reading).otherwise(F.to_json(F.struct("event_id"))).alias("sample"),
    )


@registered()
def collected_matches(spark, sf_dir):
    """The records that the batch operators make of each match's samples, when its result is detected and when it is finished."""
    return collector.finalized(collector.collect_batch(_observed(spark, sf_dir), "key"), "key")


@registered()
def stream_collected_matches(spark, sf_dir):
    """The same from a stream over seven streams of samples in files, with the last version of each match's record; late matches end with the input."""
    at, held = scratch(spark), spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    rows = _observed(spark, sf_dir)
    # One row far ahead of its key lets the watermark pass all others.
    ahead = rows.agg(F.max("t").alias("t")).select(F.lit(-1).cast("long").alias("key"), F.lit("end").alias("stream"), (F.col("t") + 10_000).alias("t"))
    rows.where("t is not null").unionByName(ahead, allowMissingColumns=True).write.parquet(f"{at}/in")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(spark.read.parquet(f"{at}/in").schema).parquet(f"{at}/in")
        flows.run_once(collector.collect_stream(stream, "key", "5 seconds", idle=1e6), f"{at}/collected", f"{at}/state")
    finally:
        if held:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", held)
        else:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    return collector.finalized(spark.read.parquet(f"{at}/collected").drop("batch"), "key")


# Long keys -----------------------------------------------------------------------------------------------------------


@registered()
def viterbi_by_key(spark, sf_dir):
    """The counter decoded over whole keys, chunk by chunk."""
    rows = timeline(spark, sf_dir).withColumn("session", F.lit(0))
    return monotone.monotone_counts(_readings(rows), KEY, tie=["id"], chunk=5 * 86_400.0)


@registered(f"""WITH RECURSIVE {TIMELINE_SQL}, pick AS (SELECT key, min(t) AS t FROM timeline GROUP BY key UNION ALL SELECT s.key, min(s.t) FROM pick p JOIN timeline s ON s.key = p.key AND s.t >= p.t + 7200 GROUP BY s.key, p.t)
SELECT key, min(id) AS id FROM pick JOIN timeline USING (key, t) GROUP BY key, t""")
def greedy_picks_by_key(spark, sf_dir):
    return picks.greedy_spacing(timeline(spark, sf_dir).select("key", "t", "id"), KEY, ORDER, 7200.0).select("key", "id")


@registered(f"""WITH {TIMELINE_SQL}, s AS (SELECT key, id, kind, t AS start, t + value * value * value * 60 AS "end" FROM timeline WHERE value > 0)
SELECT a.key, a.id, b.id AS right_id, round(least(a."end", b."end") - greatest(a.start, b.start), 3) AS shared FROM s a JOIN s b ON a.key = b.key AND a.kind = 'error' AND b.kind = 'purchase' AND a."end" > b.start AND a.start < b."end" """)
def interval_overlap_long(spark, sf_dir):
    """Intervals from seconds to months; the long ones stand in two buckets at most."""
    rows = timeline(spark, sf_dir).where("value > 0").select("key", "id", "kind", F.col("t").alias("start"), (F.col("t") + F.col("value") * F.col("value") * F.col("value") * 60).alias("end"))
    out = joins.interval_overlap(rows.where("kind = 'error'"), rows.where("kind = 'purchase'"), KEY, 3600.0)
    return out.select("key", "id", "right_id", F.round("shared", 3).alias("shared"))


# Jobs ----------------------------------------------------------------------------------------------------------------


@registered("""WITH a AS (SELECT o_custkey AS job, o_orderkey AS attempt, o_orderstatus AS s, epoch(o_orderdate)::DOUBLE AS since, o_orderkey % 2 AS signature FROM orders),
last AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY job ORDER BY attempt DESC) = 1),
parts AS (SELECT DISTINCT o_custkey AS job, o_orderkey % 2 AS signature, l_linenumber AS part FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_linestatus = 'F'),
done AS (SELECT job, signature, count(*) AS done FROM parts GROUP BY ALL)
SELECT last.job::VARCHAR AS job, attempt, CASE s WHEN 'F' THEN 'complete' WHEN 'P' THEN 'error' ELSE CASE WHEN since + 86400 > 900000000 THEN 'running' ELSE 'interrupted' END END AS status, coalesce(done, 0) AS done,
  CASE s WHEN 'F' THEN false WHEN 'P' THEN true ELSE since + 86400 <= 900000000 END AS retryable FROM last LEFT JOIN done USING (job, signature)""")
def job_states(spark, sf_dir):
    """Each customer's orders as attempts at a job, their shipped lines as committed parts: which jobs run, ended, or were interrupted, and how far they came."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    at = F.unix_seconds(F.col("o_orderdate").cast("timestamp")).cast("double")
    tried = orders.select(F.col("o_custkey").cast("string").alias("job"), F.col("o_orderkey").alias("attempt"), at.alias("at"), (F.col("o_orderkey") % 2).cast("string").alias("signature"), "o_orderstatus")
    event = lambda df, name, lease, part: df.select("job", "attempt", F.lit(name).alias("event"), "at", lease.cast("double").alias("lease"), "signature", part.cast("long").alias("part"))
    none = F.lit(None)
    started = event(tried, "started", F.col("at") + 86_400, none)
    ended = event(tried.where("o_orderstatus = 'F'"), "finished", none, none).unionByName(event(tried.where("o_orderstatus = 'P'"), "failed", none, none))
    shipped = lines.where("l_linestatus = 'F'").join(tried, lines.l_orderkey == tried.attempt)
    done = event(shipped, "done", none, F.col("l_linenumber"))
    return ledger.states(started.unionByName(ended).unionByName(done), F.lit(900_000_000.0))
