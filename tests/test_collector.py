"""Samples collected by match: the gate of readings, what is held and dropped, and the stream against the batch."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tidemark.streaming import collector, flows

SCHEMA = "key long, stream string, t double, score double, result boolean, kills int, deaths int, outcome string, end double, sample string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def row(stream, t, score=None, result=None, kills=None, deaths=None, outcome=None, end=None, sample=None):
    return {"stream": stream, "t": t, "score": score, "result": result, "kills": kills, "deaths": deaths, "outcome": outcome, "end": end, "sample": sample}


def intro(t, score=0.9):
    return row("coarse", t, score, sample=json.dumps({"motion": t}))


def full(t, kills=None, deaths=None, result=None, outcome=None):
    return row("full", t, 0.8 if kills is not None else None, result, kills, deaths, outcome, sample=json.dumps({"map": t}))


def after(rows):
    state, held, out = collector.fresh(), collector.Held(), []
    for r in sorted(rows, key=collector._place):
        out += [dict(zip(collector._NAMES, x, strict=True)) for x in collector.told(state, held, r)]
    return state, held, out


def events(out):
    return [(e["event"], e["number"], e["start"], e["active_end"], e["end"]) for e in out if e["stream"] is None]


OPEN = [intro(20.0, 0.1), intro(21.0), intro(22.0)]


def test_a_result_waits_for_two_readings_that_agree():
    state, _, out = after([*OPEN, full(320.0, 6, 6, True), full(320.25, 6, 5, True), full(320.5, 6, 4, True)])
    assert [e[0] for e in events(out)] == ["match-start"] and state["match"]["active"]["end"] is None
    # The second of the pair is the first that counts; the match takes two that count.
    _, _, out = after([*OPEN, full(310.0, outcome="win"), full(320.0, 6, 5, True), full(320.25, 6, 5, True), full(320.5, 6, 5, True)])
    assert events(out) == [("match-start", 1, 21.0, None, None), ("result-detected", 1, 21.0, 310.0, 321.0)]


def test_readings_start_anew_after_a_gap_and_four_are_kept():
    _, _, out = after([*OPEN, full(320.0, 6, 5, True), full(320.7, 6, 5, True), full(321.4, 6, 5, True)])
    assert [e[0] for e in events(out)] == ["match-start"]
    state, _, _ = after([*OPEN, *[full(320.0 + k / 4, k, 5, True) for k in range(9)]])
    assert [r[1] for r in state["readings"]] == [5, 6, 7, 8]


def test_structural_results_move_the_end_once_it_is_confirmed_and_not_before():
    structural = [full(320.0 + k / 4, result=True) for k in range(4)]
    assert [e[0] for e in events(after([*OPEN, *structural])[2])] == ["match-start"]
    tail = [full(321.0, result=True), full(321.25, result=True), full(321.5), full(321.75)]
    _, held, out = after([*OPEN, *[full(320.0 + k / 4, 6, 5, True) for k in range(3)], *tail])
    assert events(out)[-1] == ("match-finalized", 1, 21.0, 321.25, 321.75)
    assert not held.lists


def test_samples_are_held_only_while_a_match_is_open():
    early = [row("battle_hud", t / 4, sample="early") for t in range(80)]
    during = [row("battle_hud", 30.0 + t / 4, sample=f"b{t}") for t in range(4)] + [row("perception", 30.0, sample="p")]
    close = [*[full(320.0 + k / 4, 6, 5, True) for k in range(3)], full(320.75), full(321.0)]
    state, held, out = after([*early, *OPEN, *during])
    assert held.lists["battle_hud"] == [(9.0 + t / 4, f"b{t}") for t in range(4)] and "early" not in str(held.lists)
    _, held, out = after([*early, *OPEN, *during, *close, row("battle_hud", 330.0, sample="late")])
    final = [(e["stream"], e["sample_t"], e["sample"]) for e in out if e["event"] == "match-finalized" and e["stream"]]
    assert [s for s in final if s[0] == "battle_hud"] == [("battle_hud", 9.0 + t / 4, f"b{t}") for t in range(4)]
    assert [s[1] for s in final if s[0] == "map"] == [299.0, 299.5, 300.0]
    assert [json.loads(s[2])["kills"] for s in final if s[0] == "personal_results"] == [6, 6, 6]
    assert not held.lists and "late" not in str(out)


def test_fragments_are_dropped_unless_a_match_needs_them():
    pieces = [row("fragment", 6.0 * k, end=6.0 * k + 6, sample=f"f{k}") for k in range(80)]
    idle = [row("coarse", t / 2, 0.0) for t in range(0, 800)]
    state, _, out = after([*pieces, *idle])
    # At 390, the last look before 400, those that end by 378 are gone.
    assert [e["sample"] for e in out if e["event"] == "fragment-dropped"][:3] == ["f0", "f1", "f2"]
    assert min(f[1] for f in state["fragments"]) > 378.0
    game = [*OPEN, *[full(320.0 + k / 4, 6, 5, True) for k in range(3)], full(320.75), full(321.0)]
    _, _, out = after([*pieces, *[r for r in idle if r["t"] < 20 or r["t"] > 22], *game])
    mine = [e["sample"] for e in out if e["event"] == "match-finalized" and e["stream"] == "fragments"]
    assert mine == [f"f{k}" for k in range(3, 54)]
    dropped = {e["sample"] for e in out if e["event"] == "fragment-dropped"}
    assert dropped.isdisjoint(mine) and {"f0", "f1"} <= dropped


def test_state_is_bounded_over_many_rows():
    state, held = collector.fresh(), collector.Held()
    most = 0
    for k in range(100_000):
        t = k / 8
        r = [row("coarse", t, 0.3, sample="x"), row("battle_hud", t, sample="x"), row("fragment", t, end=t + 1, sample=f"f{k}"), full(t, k % 7, 2, True)][k % 4]
        collector.told(state, held, r)
        if k % 1000 == 0:
            most = max(most, len(json.dumps(state)))
    assert most < 8000 and not held.lists


def story(keys=(1, 2), start=0.0):
    """Two matches a key, all streams, samples of every kind."""
    rng, out = random.Random(8), []
    for key in keys:
        for base in (start, start + 400.0):
            rows = [intro(base + 20.0, 0.1), intro(base + 21.0), intro(base + 22.0), full(base + 300.0, outcome="win"), full(base + 300.25, outcome="win"), full(base + 301.0, outcome="lose")]
            rows += [full(base + 320.0 + k / 4, 6, 2 + (k == 0), True) for k in range(5)] + [full(base + 321.25), full(base + 321.5)]
            rows += [row("score_count", base + 25.0 + k / 2, sample=json.dumps({"candidates": [{"value": 100 - k // 20, "cost": 0.05, "support": 1}]})) for k in range(500)]
            rows += [row("respawn", base + 50.0 + 100 * j + k / 4, sample=json.dumps({"kind": "plain", "score": 0.7, "white": 0.5, "fine_white": 0.6})) for j in range(2) for k in range(12)]
            rows += [row(s, base + rng.uniform(0, 330), sample=s) for s in ("battle_hud", "perception", "objective_count") for _ in range(20)]
            rows += [row("fragment", base + 6.0 * k, end=base + 6.0 * k + 6, sample=f"{base}-{k}") for k in range(60)]
            rows += [row("coarse", base + 24.0 + k, 0.0, sample="c") for k in range(370)]
            out += [(key, *r.values()) for r in rows]
    return out


@pytest.mark.parametrize("files", [1, 5])
def test_streams_in_any_order_give_the_batch_result(spark, tmp_path, files):
    rows = story(start=1000.0)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    # Within a file rows are shuffled; the files follow each other, 20 seconds overlapping; one row far ahead lets the watermark pass the others.
    rng, span = random.Random(1), 800.0 / files
    dealt = [[] for _ in range(files)]
    for r in rows:
        dealt[max(0, min(files - 1, int((r[2] - 1000.0 - rng.uniform(0, 20)) // span)))].append(r)
    for k, part in enumerate([*dealt, [(9, *row("coarse", 5000.0, 0.0).values())]]):
        rng.shuffle(part)
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/part={k:02d}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    flows.run_once(collector.collect_stream(stream, "key", "60 seconds"), f"{tmp_path}/log", f"{tmp_path}/state")
    got = spark.read.parquet(f"{tmp_path}/log").drop("batch")
    want = collector.collect_batch(spark.createDataFrame(rows, SCHEMA), "key")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert want.where("event = 'match-finalized' and stream is null").count() == 4


def test_matches_are_finalized_by_the_batch_operators(spark, tmp_path):
    rows = spark.createDataFrame(story((1,)), SCHEMA)
    collected = collector.collect_batch(rows, "key")
    got = {(r["number"], r["event"]): r for r in collector.finalized(collected, "key").collect()}
    assert sorted(got) == [(1, "match-finalized"), (1, "result-detected"), (2, "match-finalized"), (2, "result-detected")]
    r = got[1, "match-finalized"]
    assert (r["start"], r["end"], r["duration"], r["gameplay_end"]) == (21.0, 321.5, 300.5, 279.0)
    assert (r["kills"], r["deaths"], r["outcome"], r["score_left"], r["respawns"], r["matched"]) == (6, 2, "win", 76, 2, True)
    assert got[1, "result-detected"]["end"] == 321.25
    # A batch's records go to the log; of a match told twice the last version counts.
    write = collector.finalize_into(f"{tmp_path}/log", "key")
    write(collected, 0)
    write(collected, 0)
    records = spark.read.parquet(f"{tmp_path}/log").withColumn("id", F.concat_ws("/", "key", "number"))
    assert records.groupBy("id").agg(F.max_by("event", "end").alias("e")).where("e = 'match-finalized'").count() == 2


def test_odd_rows(spark):
    rows = [(None, *intro(1.0).values()), (None, *intro(2.0).values()), (1, None, 3.0, *[None] * 7), (1, "coarse", None, *[None] * 7), (1, "other", 3.0, *[None] * 7), (1, "full", 3.0, *[None] * 7)]
    got = collector.collect_batch(spark.createDataFrame(rows, SCHEMA), "key").collect()
    assert [(r["key"], r["event"]) for r in got] == [(None, "match-start")]
    assert collector.collect_batch(spark.createDataFrame([], SCHEMA).select("key", "stream", "t"), "key").count() == 0


class State:
    """A list state that counts its writes."""

    def __init__(self):
        self.rows, self.writes = [], 0

    def get(self):
        return iter(self.rows)

    def put(self, rows):
        self.rows, self.writes = list(rows), self.writes + 1

    def appendList(self, rows):
        self.rows, self.writes = [*self.rows, *rows], self.writes + 1

    def clear(self):
        self.rows, self.writes = [], self.writes + 1


def test_samples_are_written_to_state_once_a_call():
    states = {n: State() for n in collector.LISTS}
    kept, plain = collector.Lists(states), collector.Held()
    rng = random.Random(3)
    for call in range(12):
        before = sum(s.writes for s in states.values())
        for k in range(300):
            if call % 3 == 2 and k == 150:
                kept.clear()
                plain.clear()
            sample = (rng.choice(collector.LISTS[:-1]), float(k), str(k))
            kept.add(*sample)
            plain.add(*sample)
        assert list(kept.items()) == list(plain.items())
        kept.flush()
        assert list(kept.items()) == list(plain.items())
        assert sum(s.writes for s in states.values()) - before <= len(collector.LISTS)
    kept.clear()
    kept.flush()
    assert not any(s.rows for s in states.values()) and list(kept.items()) == []
