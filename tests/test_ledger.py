"""Jobs go on after a restart."""

import pytest
from pyspark.sql import functions as F

from tidemark.streaming import ledger


def row(job, attempt, event, at, lease=None, signature="v1", part=None):
    return (job, attempt, event, float(at), None if lease is None else float(lease), signature, part)


def test_states_by_starts_ends_and_leases(spark):
    rows = [
        row("whole", 1, "started", 0, 10), row("whole", 1, "done", 1, 10, part=0), row("whole", 1, "finished", 2),
        row("lost", 1, "started", 0, 10), row("lost", 1, "done", 1, 10, part=0), row("lost", 1, "done", 1, 10, part=0), row("lost", 1, "done", 2, 10, part=1),
        row("alive", 1, "started", 0, 10), row("alive", 1, "alive", 9, 60),
        row("bad", 1, "started", 0, 10), row("bad", 1, "failed", 3),
        row("again", 1, "started", 0, 10), row("again", 1, "done", 1, 10, part=4), row("again", 2, "started", 20, 90), row("again", 2, "done", 21, 90, part=5),
        row("changed", 1, "started", 0, 10), row("changed", 1, "done", 1, 10, part=0), row("changed", 2, "started", 11, 20, "v2"),
    ]
    df = spark.createDataFrame(rows, ledger.SCHEMA)
    got = {r["job"]: (r["attempt"], r["status"], r["done"], r["retryable"]) for r in ledger.states(df, F.lit(50.0)).collect()}
    assert got == {
        "whole": (1, "complete", 1, False), "lost": (1, "interrupted", 2, True), "alive": (1, "running", 0, False), "bad": (1, "error", 0, True),
        "again": (2, "running", 2, False), "changed": (2, "interrupted", 0, True),
    }
    assert sorted(r["job"] for r in ledger.interrupted(df, F.lit(50.0)).collect()) == ["changed", "lost"]
    parts = spark.createDataFrame([("lost", p) for p in range(4)] + [("changed", 0)], "job string, part long")
    assert sorted(map(tuple, ledger.remaining(parts, df, F.when(F.col("job") == "changed", "v2").otherwise("v1")).collect())) == [("changed", 0), ("lost", 2), ("lost", 3)]


def test_a_job_goes_on_from_what_was_committed(spark, tmp_path):
    log, out, now = f"{tmp_path}/log", f"{tmp_path}/out", [0.0]
    items = spark.range(100).withColumn("v", F.col("id") * 2)
    seen = []

    def work(fail_at):
        def run(df):
            n = df.first()["id"] % 5
            if n == fail_at:
                raise KeyboardInterrupt  # the process is killed: nothing is told to the ledger
            seen.append(n)
            return df
        return run

    go = lambda fail_at=None, signature="v1": ledger.run_job(spark, log, out, "j", signature, items, F.pmod("id", F.lit(5)), 5, work(fail_at), lambda: now[0], 100.0)
    ledger.append(spark, log, [row("other", 1, "started", 0, 1e9)])
    with pytest.raises(KeyboardInterrupt):
        go(fail_at=3)
    state = lambda: next(r for r in ledger.states(ledger.ledger(spark, log), F.lit(now[0])).collect() if r["job"] == "j")
    assert (state()["status"], state()["done"]) == ("running", 3)
    with pytest.raises(RuntimeError, match="another"):
        go()
    now[0] = 500.0
    assert (state()["status"], state()["retryable"]) == ("interrupted", True)
    # What a killed runner left half written is written again.
    spark.range(7).withColumn("v", F.lit(0).cast("long")).write.parquet(f"{out}/part=3")
    assert go() == 2 and seen == [0, 1, 2, 3, 4]
    assert (state()["status"], state()["attempt"], state()["done"]) == ("complete", 2, 5)
    assert spark.read.parquet(out).groupBy().agg(F.count("*"), F.sum("v")).first()[:2] == (100, 9900)
    assert go() == 0
    assert go(signature="v2") == 5
