"""Streams of samples collected by match while it is played, and a record of each match when its result shows.

Rows are ``stream, t`` and what the stream carries: ``coarse`` an intro ``score``; ``full`` whether a result screen shows (``result``), the ``kills`` and ``deaths``
read from it, an announced ``outcome``; ``fragment`` a stored piece of the recording up to ``end``, named by its sample; other streams
only their ``sample``, a text (a JSON document, say). Rows of a key are taken in order of time, of the streams' names in STREAMS, and of the sample.

* A stable pair of intros opens a match. Samples are held only while a match is open, from its start on, in a list of their own for each stream, timed from the start.
* A result counts once two readings in a row agree in kills and deaths (at most 0.625 s apart, the last four are kept); after that any result screen does.
* When the result is detected, and when two other screens have finished the match, its event comes out together with all samples collected so far.
* A fragment is held from the start of the open match on, else for 12 seconds; others are reported as dropped, but for the last two and those that a match needs.

The batch and the stream take the same steps. The stream holds rows back until the watermark passes them, so streams may arrive in any order within
``late``; a key without rows for ``idle`` seconds is forgotten.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators import battle, choices, monotone
from tidemark.streaming import flows, lifecycle

#: The order of rows of one time. Lists that samples are held in: full frames make map frames (every other one), outcomes and results.
STREAMS = ("coarse", "battle_hud", "respawn", "full", "perception", "score_count", "objective_count", "fragment")
LISTS = ("coarse", "battle_hud", "respawn", "perception", "map", "score_count", "objective_count", "outcomes", "personal_results")
#: Seconds: between two readings of kills and deaths; of fragments held without a match; between two prunings. Readings kept; fragments that may still be written to.
READING_GAP, IDLE_FRAGMENTS, PRUNE_EVERY = 0.625, 12.0, 10.0
READINGS, WRITTEN = 4, 2
READS = ["stream", "t", "score", "result", "kills", "deaths", "outcome", "end", "sample"]
TOLD = "event string, number long, start double, active_end double, end double, t double, stream string, sample_t double, sample string"
_NAMES = [c.split()[0] for c in TOLD.split(", ")]


def fresh() -> dict:
    return {"match": lifecycle.fresh(), "readings": [], "fragments": [], "pruned": -math.inf, "last": None}


def _none(x):
    return None if x is None or x != x else x


class Taken:
    """What one row does: events, samples to hold (list, time, sample), fragments dropped; ``opened``: what was held before is void."""

    def __init__(self):
        self.events, self.held, self.dropped, self.opened = [], [], [], False


def take(state: dict, row: dict) -> Taken:
    """Take one row in."""
    out, t, stream, match = Taken(), row["t"], row["stream"], state["match"]

    def step(kind: str, value: float) -> None:
        for e in lifecycle.step(match, t, kind, value):
            if e["event"] == "match-start":
                state["readings"], out.opened = [], True
            out.events.append(e)

    def hold(name: str, sample: str | None) -> None:
        now = match["active"]
        if now and t >= now["start"]:
            out.held.append((name, round(t - now["start"], 3), sample))

    state["last"] = t
    if stream == "coarse":
        step("intro", row["score"] or 0.0)
        hold("coarse", row["sample"])
        if t - state["pruned"] >= PRUNE_EVERY:
            state["pruned"] = t
            out.dropped = pruned(state, t)
    elif stream == "full":
        if row["outcome"] is not None:
            step("outcome", 1.0)
            hold("outcomes", json.dumps({"outcome": row["outcome"]}))
        if math.floor(t * 4 + 0.5) % 2 == 0:
            hold("map", row["sample"])
        now, read = match["active"], row["kills"] is not None and row["deaths"] is not None
        if now and read:
            hold("personal_results", json.dumps({"kills": int(row["kills"]), "deaths": int(row["deaths"]), "confidence": row["score"]}))
            held = state["readings"] if state["readings"] and t - state["readings"][-1][0] <= READING_GAP else []
            state["readings"] = [*held, [t, int(row["kills"]), int(row["deaths"])]][-READINGS:]
        confirmed = bool(now and now["end"] is not None)
        two = state["readings"][-2:]
        stable = read and len(two) == 2 and two[0][1:] == two[1][1:]
        step("result", 1.0 if (bool(row["result"]) if confirmed else stable) else 0.0)
    elif stream == "fragment":
        state["fragments"].append([t, row["end"] if row["end"] is not None else t, row["sample"], False])
    else:
        hold(stream, row["sample"])
    for e in out.events:
        if e["event"] != "match-start":
            for f in state["fragments"]:
                f[3] = f[3] or (f[1] > e["start"] and f[0] < e["end"])
    return out


def pruned(state: dict, t: float) -> list[str]:
    """Forget fragments that nothing needs any more; the names of those that no match needs."""
    now = state["match"]["active"]
    since = now["start"] if now else max(0.0, t - IDLE_FRAGMENTS)
    old, last = state["fragments"][:-WRITTEN], state["fragments"][-WRITTEN:]
    gone = [f for f in old if f[1] <= since]
    state["fragments"] = [f for f in old if f[1] > since] + last
    return [f[2] for f in gone if not f[3]]


def _row(values) -> dict:
    return {c: _none(v) for c, v in zip(READS, values, strict=True)}


def _place(row: dict) -> tuple:
    return row["t"], STREAMS.index(row["stream"]) if row["stream"] in STREAMS else len(STREAMS), row["stream"], row["sample"] or ""


class Held:
    """The samples of the open match of one key."""

    def __init__(self):
        self.lists: dict[str, list] = {}

    def clear(self) -> None:
        self.lists.clear()

    def add(self, name: str, t: float, sample) -> None:
        self.lists.setdefault(name, []).append((t, sample))

    def items(self):
        return ((name, t, sample) for name in LISTS for t, sample in self.lists.get(name, []))


def told(state: dict, held, row: dict) -> list[tuple]:
    """Rows of TOLD that one row causes; ``held`` takes in and gives out the samples of the open match."""
    taken, out = take(state, row), []
    if taken.opened:
        held.clear()
    for sample in taken.held:
        held.add(*sample)
    for e in taken.events:
        head = tuple(e[c] for c in _NAMES[:6])
        out.append((*head, None, None, None))
        if e["event"] != "match-start":
            out += [(*head, *s) for s in held.items()]
            out += [(*head, "fragments", round(f[0] - e["start"], 3), f[2]) for f in state["fragments"] if f[1] > e["start"] and f[0] < e["end"]]
        if e["event"] == "match-finalized":
            held.clear()
    return out + [("fragment-dropped", None, None, None, None, row["t"], "fragments", None, name) for name in taken.dropped]


def _frame(key_name: str, key, rows: list[tuple]) -> pd.DataFrame:
    columns = dict(zip(_NAMES, zip(*rows, strict=True), strict=True))
    kinds = {"number": "Int64", "start": "float64", "active_end": "float64", "end": "float64", "t": "float64", "sample_t": "float64"}
    return pd.DataFrame({key_name: [key] * len(rows), **{n: pd.array(v, dtype=kinds[n]) if n == "number" else pd.Series(v, dtype=kinds.get(n, object)) for n, v in columns.items()}})


def _schema(df: DataFrame, key: str) -> T.StructType:
    kinds = {"string": T.StringType(), "long": T.LongType(), "double": T.DoubleType()}
    return T.StructType([df.schema[key], *[T.StructField(c.split()[0], kinds[c.split()[1]]) for c in TOLD.split(", ")]])


def _reads(observations: DataFrame, key: str) -> DataFrame:
    """The columns that are read; those that an input lacks are null."""
    kinds = {"t": "double", "score": "double", "result": "boolean", "kills": "int", "deaths": "int", "end": "double"}
    return observations.select(key, *[(F.col(c) if c in observations.columns else F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in READS])


def collect_batch(observations: DataFrame, key: str) -> DataFrame:
    """Events, samples and dropped fragments of finished recordings; a task holds the samples of one match at a time."""
    rows = _reads(observations, key).where("t is not null and stream is not null")
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, STREAMS)), F.col("stream")), F.lit(0))
    placed = rows.withColumn("_rank", F.when(rank == 0, len(STREAMS) + 1).otherwise(rank)).withColumn("_text", F.coalesce("sample", F.lit("")))

    def run(frames):
        at, state, held = None, fresh(), Held()
        for frame in frames:
            out: list[tuple] = []
            for k, *values in frame[[key, *READS]].itertuples(index=False, name=None):
                if at is None or not (k == at[0] or k != k and at[0] != at[0]):
                    if out:
                        yield _frame(key, at[0], out)
                    at, state, held, out = (k,), fresh(), Held(), []
                out += told(state, held, _row(values))
            if out:
                yield _frame(key, at[0], out)

    return placed.repartition(key).sortWithinPartitions(key, "t", "_rank", "stream", "_text").mapInPandas(run, _schema(observations, key))


class Lists:
    """The same, in one list state for each stream. What a call adds is held until :meth:`flush`, so a match that ends within it never gets there."""

    def __init__(self, states: dict):
        self.states, self.fresh, self.void = states, {}, False
        self.stored: dict[str, list] = {}

    def clear(self) -> None:
        self.void = True
        self.fresh.clear()

    def add(self, name: str, t: float, sample) -> None:
        self.fresh.setdefault(name, []).append((t, sample))

    def _stored(self, name: str) -> list:
        if name not in self.stored:
            self.stored[name] = [tuple(r) for r in self.states[name].get()]
        return self.stored[name]

    def items(self):
        return ((name, t, sample) for name in LISTS for t, sample in [*([] if self.void else self._stored(name)), *self.fresh.get(name, [])])

    def flush(self) -> None:
        """Write what is held at the end of a call: one write for a list that changed."""
        for name, state in self.states.items():
            rows = self.fresh.get(name)
            if self.void and rows:
                state.put(rows)
            elif self.void:
                state.clear()
            elif rows:
                state.appendList(rows)
        self.fresh, self.void, self.stored = {}, False, {}


class Collector(StatefulProcessor):
    """State of a key: the match and its gate (one small record), a list of samples for each stream, the rows that the watermark hasn't passed."""

    def __init__(self, key: str, idle: float):
        self.key, self.idle = key, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        sample = T.StructType([T.StructField("t", T.DoubleType()), T.StructField("sample", T.StringType())])
        text = T.StructType([T.StructField("record", T.StringType())])
        self.handle = handle
        self.match, self.waiting = handle.getValueState("match", text), handle.getListState("waiting", text)
        self.held = Lists({n: handle.getListState(f"held_{n}", sample) for n in LISTS})

    def _advance(self, key, fresh_rows: list[dict], watermark: float) -> Iterator[pd.DataFrame]:
        rows = [json.loads(r[0]) for r in self.waiting.get()] + fresh_rows
        ripe = sorted((r for r in rows if r["t"] <= watermark), key=_place)
        rest = [r for r in rows if r["t"] > watermark]
        state = json.loads(self.match.get()[0]) if self.match.exists() else fresh()
        out = [x for r in ripe for x in told(state, self.held, r)]
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if rest:
            self.waiting.put([(json.dumps(r),) for r in rest])
        else:
            self.waiting.clear()
        if rest or state["last"] is not None and state["last"] + self.idle > watermark:
            self.match.update((json.dumps(state),))
            due = min(r["t"] for r in rest) if rest else state["last"] + self.idle
            self.handle.registerTimer(int(1000 * due) + 1)
        else:
            self.match.clear()
            self.held.clear()
        self.held.flush()
        if out:
            yield _frame(self.key, key[0], out)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh_rows = [_row(v) for frame in rows for v in frame[READS].itertuples(index=False, name=None)]
        yield from self._advance(key, fresh_rows, timerValues.getCurrentWatermarkInMs() / 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance(key, [], timerValues.getCurrentWatermarkInMs() / 1000)

    def close(self) -> None:
        pass


def collect_stream(observations: DataFrame, key: str, late: str = "10 seconds", idle: float = 3600.0) -> DataFrame:
    """The same rows as they happen. The session must use the RocksDB state store; rows later than ``late`` are dropped."""
    rows = _reads(observations, key).where("t is not null and stream is not null")
    timed = rows.withColumn("_ts", F.timestamp_micros((F.col("t") * 1_000_000).cast("long"))).withWatermark("_ts", late)
    return timed.groupBy(key).transformWithStateInPandas(Collector(key, idle), _schema(observations, key), "append", "eventTime")


def finalized(collected: DataFrame, key: str) -> DataFrame:
    """One record for each match and event at which it was told: the batch operators over its samples.

    ``kills, deaths`` are the most frequent pair read, ``outcome`` the most frequent announcement seen twice or more, ``score_left`` the last value of the decoded counter,
    ``respawns`` the runs of respawn screens and ``matched`` whether they are as many as the deaths read."""
    keys = [key, "number", "event"]
    heads = collected.where("stream is null and event <> 'match-start'").select(*keys, "start", "end", F.coalesce("active_end", F.col("end") - lifecycle.TAIL).alias("active_end"))
    samples = collected.where("stream is not null and number is not null")

    def parsed(stream: str, schema: str) -> DataFrame:
        return samples.where(F.col("stream") == stream).select(*keys, F.col("sample_t").alias("t"), F.from_json("sample", schema).alias("s")).select(*keys, "t", "s.*")

    sizes = samples.groupBy(*keys).agg(F.count("*").alias("samples"), F.countDistinct("stream").alias("streams"))
    pair = choices.mode_of(parsed("personal_results", "kills int, deaths int, confidence double"), keys, ["kills", "deaths"], "confidence", ["t"]).select(*keys, "kills", "deaths")
    outcome = choices.consensus(parsed("outcomes", "outcome string"), keys, "outcome").select(*keys, "outcome")
    counted = monotone.monotone_counts(parsed("score_count", "candidates array<struct<value: int, cost: double, support: int>>").withColumn("visible", F.lit(True)), keys)
    left = choices.final_value(counted, keys, ["t"], "value", F.col("source") == "observed").select(*keys, F.col("final").alias("score_left"))
    runs = battle.respawn_runs(parsed("respawn", "kind string, score double, white double, fine_white double"), keys, 0.0, 1e12).groupBy(*keys).agg(F.count("*").alias("respawns"))
    out = heads
    for more in (sizes, pair, outcome, left, runs):
        out = out.join(more, keys, "left")
    respawns = F.coalesce("respawns", F.lit(0))
    return out.select(
        *keys, "start", "end", F.round(F.col("end") - F.col("start"), 3).alias("duration"), F.round(F.col("active_end") - F.col("start"), 3).alias("gameplay_end"), F.coalesce("samples", F.lit(0)).alias("samples"),
        F.coalesce("streams", F.lit(0)).alias("streams"), "kills", "deaths", "outcome", "score_left", respawns.alias("respawns"), (respawns == F.col("deaths")).alias("matched"),
    )


def finalize_into(log: str, key: str):
    """A foreachBatch function: the records of each batch's matches go to a log, by batch; see :func:`tidemark.streaming.flows.published`."""
    write = flows.publish(log)

    def run(batch: DataFrame, batch_id: int) -> None:
        write(finalized(batch, key), batch_id)

    return run
