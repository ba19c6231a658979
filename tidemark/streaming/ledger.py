"""Jobs that outlive the process that runs them: a ledger of what was started, done and finished, and going on after a restart.

A ledger is an append-only log of rows ``job, attempt, event, at, lease, signature, part``: ``started`` (with a lease that its runner renews by ``alive`` rows), ``done`` for each
part that was committed, ``finished`` or ``failed``. A job with a start but no end is found by an anti-join: it is running while its lease lasts, and interrupted after that.
What it committed under the same signature counts; a changed signature (other inputs, another version) starts anew.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "job string, attempt long, event string, at double, lease double, signature string, part long"
ENDS = ("finished", "failed")


def append(spark: SparkSession, log: str, rows: list[tuple] | DataFrame) -> None:
    """Add rows to a log; each append is a file of its own, whole or not there."""
    df = rows if isinstance(rows, DataFrame) else spark.createDataFrame(rows, SCHEMA)
    df.coalesce(1).write.mode("append").parquet(log)


def ledger(spark: SparkSession, log: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(log)


def states(rows: DataFrame, now: Column) -> DataFrame:
    """``job, attempt, status, done, retryable`` of each job's last attempt.

    ``status`` is complete, error, running, or interrupted: started, not ended, and its lease (the latest of its rows) is over. ``done`` counts the parts that
    are committed under the last attempt's signature, in whatever attempt."""
    tries = ["job", "attempt"]
    started = rows.where("event = 'started'").groupBy(*tries).agg(F.max("signature").alias("signature"))
    leases = rows.groupBy(*tries).agg(F.max("lease").alias("lease"))
    ended = rows.where(F.col("event").isin(*ENDS)).groupBy(*tries).agg(F.max_by("event", "at").alias("end"))
    last = started.groupBy("job").agg(F.max_by(F.struct("attempt", "signature"), "attempt").alias("l")).select("job", "l.*")
    open_ = last.join(ended, tries, "left_anti").join(leases, tries).withColumn("status", F.when(F.col("lease") > now, "running").otherwise("interrupted"))
    closed = last.join(ended, tries).withColumn("status", F.when(F.col("end") == "finished", "complete").otherwise("error"))
    both = open_.select(*tries, "signature", "status").unionByName(closed.select(*tries, "signature", "status"))
    done = rows.where("event = 'done'").select("job", "signature", "part").distinct().groupBy("job", "signature").agg(F.count("*").alias("done"))
    met = both.join(done, ["job", "signature"], "left")
    return met.select(*tries, "status", F.coalesce("done", F.lit(0)).alias("done"), F.col("status").isin("interrupted", "error").alias("retryable"))


def interrupted(rows: DataFrame, now: Column) -> DataFrame:
    """The jobs to go on with."""
    return states(rows, now).where("status = 'interrupted'")


def remaining(parts: DataFrame, rows: DataFrame, signature: str | Column) -> DataFrame:
    """The parts (``job, part``) that weren't committed under a signature."""
    wanted = signature if isinstance(signature, Column) else F.lit(signature)
    done = rows.where("event = 'done'").select("job", "part", F.col("signature").alias("_s"))
    return parts.withColumn("_s", wanted).join(done, ["job", "part", "_s"], "left_anti").drop("_s")


def run_job(spark: SparkSession, log: str, out: str, job: str, signature: str, items: DataFrame, part: Column, parts: int, work: Callable[[DataFrame], DataFrame], clock: Callable[[], float], lease: float = 3600.0) -> int:
    """Do what is left of a job, part by part: ``work`` of the items of a part is written to ``out/part=<n>``, then the part is told done. The number of parts done now.

    A part that was being written when its runner died is written again in whole, so nothing is there twice. A job whose lease lasts belongs to
    another runner: an error."""
    known = ledger(spark, log)
    before = {r["status"]: r for r in states(known.where(F.col("job") == job), F.lit(clock())).collect()} if _exists(known) else {}
    if "running" in before:
        raise RuntimeError(f"{job} is being run by another")
    # At most a row for each part.
    done = {r["part"] for r in known.where((F.col("job") == job) & (F.col("event") == "done") & (F.col("signature") == signature)).select("part").distinct().collect()} if before else set()
    attempt = 1 + max((r["attempt"] for r in before.values()), default=0)
    row = lambda event, n=None: (job, attempt, event, clock(), clock() + lease, signature, n)
    append(spark, log, [row("started")])
    try:
        for n in sorted(set(range(parts)) - done):
            work(items.where(part == n)).write.mode("overwrite").parquet(f"{out}/part={n}")
            append(spark, log, [row("done", n)])
    except Exception:
        append(spark, log, [row("failed")])
        raise
    append(spark, log, [row("finished")])
    return parts - len(done)


def _exists(df: DataFrame) -> bool:
    return len(df.inputFiles()) > 0
