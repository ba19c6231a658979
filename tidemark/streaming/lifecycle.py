"""Match lifecycle from a stream of observations, one step function for batch and stream.

Observations are ``t, kind, value``: kind ``intro`` with a score, ``outcome``, or ``result`` with value 1 for a personal result screen. A
stable pair of intros opens a match; two result screens in a row set its end; two other screens after that finish it. Events come out as rows
``event, number, start, active_end, end, t``. State is one small record per key: it doesn't grow with the stream.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Seconds: intros remembered, apart at most in a stable pair, results apart at most in one run; from a result to the end; least intro score.
MEMORY, PAIR_GAP, RUN_GAP, TAIL, LEAST = 8.0, 1.5, 0.375, 0.5, 0.82
EVENT = "event string, number long, start double, active_end double, end double, t double"


def fresh() -> dict:
    return {"number": 0, "intros": [], "active": None, "run": [], "after": 0}


def step(state: dict, t: float, kind: str, value: float) -> list[dict]:
    """Take one observation in, return the events it causes."""
    out, now = [], state["active"]

    def tell(event: str) -> None:
        out.append({"event": event, "number": state["number"], "start": state["active"]["start"], "active_end": state["active"]["active_end"], "end": state["active"]["end"], "t": t})

    if kind == "intro":
        state["intros"] = [x for x in state["intros"] if x[0] >= t - MEMORY] + [[t, value]]
        if now is None:
            pairs = zip(state["intros"], state["intros"][1:], strict=False)
            start = next((a[0] for a, b in pairs if b[0] - a[0] <= PAIR_GAP and min(a[1], b[1]) >= LEAST), None)
            if start is not None:
                state |= {"number": state["number"] + 1, "active": {"start": start, "active_end": None, "end": None}, "run": [], "after": 0}
                tell("match-start")
    elif now is None:
        pass
    elif kind == "outcome":
        now["active_end"] = t if now["active_end"] is None else now["active_end"]
    elif value:
        run = state["run"] if state["run"] and t - state["run"][-1] <= RUN_GAP else []
        state |= {"run": [*run, t][-2:], "after": 0}
        if now["end"] is not None:
            now["end"] = round(t + TAIL, 3)
        elif len(state["run"]) >= 2:
            now["end"] = round(t + TAIL, 3)
            tell("result-detected")
    elif now["end"] is None:
        state["run"] = []
    else:
        state["after"] += 1
        if state["after"] >= 2:
            if now["active_end"] is None:
                now["active_end"] = round(now["end"] - TAIL, 3)
            tell("match-finalized")
            state |= {"active": None, "intros": [], "run": [], "after": 0}
    return out


def _folded(state: dict, frames: Iterator[pd.DataFrame]) -> list[dict]:
    rows = pd.concat(list(frames)).sort_values("t", kind="stable")
    return [e for t, k, v in rows[["t", "kind", "value"]].itertuples(index=False, name=None) for e in step(state, t, k, v)]


def _event_fields() -> list[T.StructField]:
    kinds = {"string": T.StringType(), "long": T.LongType(), "double": T.DoubleType()}
    return [T.StructField(name, kinds[kind]) for name, kind in (c.split() for c in EVENT.split(", "))]


def _schema(df: DataFrame, key: str) -> T.StructType:
    return T.StructType([df.schema[key], *_event_fields()])


def lifecycle_batch(observations: DataFrame, key: str) -> DataFrame:
    """All events of finished recordings, read in order of key and time; a task keeps one match's record, not its observations."""
    names = [c.split()[0] for c in EVENT.split(", ")]

    def run(frames):
        at, state = None, fresh()
        for frame in frames:
            for k, rows in frame.groupby(key, sort=False, dropna=False):
                if at is None or not (k == at[0] or k != k and at[0] != at[0]):
                    at, state = (k,), fresh()
                if out := _folded(state, iter([rows])):
                    yield pd.DataFrame(out, columns=names).assign(**{key: k})[[key, *names]]

    return observations.repartition(key).sortWithinPartitions(key, "t").mapInPandas(run, _schema(observations, key))


class Lifecycle(StatefulProcessor):
    """The same steps with the record of each key kept as streaming state."""

    def __init__(self, key: str):
        self.key = key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("match", T.StructType([T.StructField("record", T.StringType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = json.loads(self.kept.get()[0]) if self.kept.exists() else fresh()
        out = _folded(state, rows)
        self.kept.update((json.dumps(state),))
        if out:
            yield pd.DataFrame(out).assign(**{self.key: key[0]})[[self.key, *[c.split()[0] for c in EVENT.split(", ")]]]

    def close(self) -> None:
        pass


def lifecycle_stream(observations: DataFrame, key: str) -> DataFrame:
    """Events as they happen. The session must use the RocksDB state store."""
    return observations.groupBy(key).transformWithStateInPandas(Lifecycle(key), _schema(observations, key), "append", "none")
