"""Rows picked greedily, each at least so far from the last that was picked, over keys of any length.

Within a chunk of time every row points to the first one far enough after it; doubling the pointers tells for every row that may be picked first which
is picked last, and how many there are. That is a function from the last time picked before a chunk to the last in it; functions of chunks are composed in a
tree. A function holds the rows that may come first alone: those less than the least distance after the chunk's first, and one more.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.folds import _several, per_frame, per_group, per_key
from tidemark.operators.scans import _met, long_keys, rows_of, scan, with_states
from tidemark.operators.tables import stored

#: Seconds of a timeline that one task picks from in a row.
CHUNK = 86_400.0


def first_far(times: np.ndarray, last: np.ndarray, least: float) -> np.ndarray:
    """The place of the first of the rising ``times`` with ``time - last >= least``; their number if there is none."""
    at, n = np.searchsorted(times, last + least), len(times)
    ends = np.append(times, np.inf)
    # The sum and the difference may round apart.
    while (late := (at > 0) & (times[np.maximum(at - 1, 0)] - last >= least) if n else np.zeros(len(at), bool)).any():
        at = at - late
    while (soon := (at < n) & (ends[at] - last < least)).any():
        at = at + soon
    return at


def picked_from(times: np.ndarray, least: float) -> np.ndarray:
    """Three rows: the times that may be picked first, the last time picked then, how many are picked."""
    n = len(times)
    after = np.append(first_far(times, times, least), n) if n else np.zeros(1, np.int64)
    last, count = np.arange(n + 1), np.append(np.ones(n, np.int64), 0)
    jump = after.copy()
    while (jump[:n] < n).any():
        live = jump < n
        count[live], last[live] = count[live] + count[jump[live]], last[jump[live]]
        jump[live] = jump[jump[live]]
    near = min(n, int(first_far(times, times[:1], least)[0]) + 1) if n else 0
    return np.stack([times[:near], times[last[:near]], count[:near].astype(float)]) if n else np.zeros((3, 0))


def known(last: float, count: float) -> np.ndarray:
    """A state: the last time picked and how many were."""
    return np.array([[np.nan], [last], [count]])


def after(function: np.ndarray, last: np.ndarray, count: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    at = first_far(function[0], last, least)
    hit = at < function.shape[1]
    safe = np.where(hit, at, 0)
    return (np.where(hit, function[1][safe], last), count + np.where(hit, function[2][safe], 0)) if function.shape[1] else (last, count)


def composed(least: float):
    def compose(first: bytes, then: bytes) -> bytes:
        f, g = (np.frombuffer(b).reshape(3, -1) for b in (first, then))
        if not f.shape[1]:
            return then
        out = np.stack([f[0], *after(g, f[1], f[2], least)])
        if not np.isnan(f[0, 0]):
            # Nothing of the first chunk may be far enough; then the second one's rows come first.
            more = g[:, g[0] > f[0, -1]] if f[0, -1] - f[0, 0] < least else g[:, :0]
            out = np.concatenate([out, more], axis=1)
            out = out[:, : int(first_far(out[0], out[0, :1], least)[0]) + 1]
        return out.tobytes()

    return compose


def kept(times: np.ndarray, last: float, count: float, least: float, most: int | None) -> np.ndarray:
    """Places of the rows that are picked after ``last``, of which ``count`` came before."""
    out, at = [], int(first_far(times, np.array([last]), least)[0])
    following = first_far(times, times, least).tolist()
    while at < len(times) and (most is None or count + len(out) < most):
        out.append(at)
        at = following[at]
    return np.array(out, np.int64)


#: Up to this many rows of a key one look at each is faster than arrays.
FEW = 64


def picked_of(frame: pd.DataFrame, starts: np.ndarray, time: str, least: float, most: int | None) -> pd.DataFrame:
    """The rows of each key that are picked from its start."""
    t = frame[time].to_numpy(float)
    valid = ~np.isnan(t)
    keep = valid & (most is None or most > 0)
    times = t.tolist()
    for a, b in _several(starts):
        keep[a:b] = False
        if b - a > FEW:
            own = a + np.flatnonzero(valid[a:b])
            keep[own[kept(t[own], -np.inf, 0, least, most)]] = True
            continue
        last, count = None, 0
        for i in range(a, b):
            if most is not None and count >= most:
                break
            if times[i] == times[i] and (last is None or times[i] - last >= least):
                keep[i], last, count = True, times[i], count + 1
    return frame[keep]


def greedy_spacing(df: DataFrame, keys: list[str], order: list[str], least: float, most: int | None = None, chunk: float | None = CHUNK) -> DataFrame:
    """Rows at least ``least`` (more than 0) seconds after the last one that was kept, the first ``most`` of them; rows without a time are not kept.

    ``order`` orders a key's rows completely, its first column is the time."""

    def pick(frame: pd.DataFrame, last: float = -np.inf, count: float = 0) -> pd.DataFrame:
        frame = frame[frame[order[0]].notna()]
        return frame.iloc[kept(frame[order[0]].to_numpy(float), last, count, least, most)]

    whole = lambda frame, starts: picked_of(frame, starts, order[0], least, most)
    if chunk is None:
        return per_frame(df, keys, order, whole, df.schema)
    at = F.floor(F.col(order[0]) / chunk).cast("long")
    chunks = stored(long_keys(df, keys, at))
    if chunks.isEmpty():
        return per_frame(df, keys, order, whole, df.schema)
    rows, group, binary = rows_of(df, keys, chunks, True), [*keys, "_chunk"], T.BinaryType()
    heads = chunks.where("_left > 0")

    def summed(head, place, times):
        own = times[~head.astype(bool)].astype(float)
        if len(own) == len(times):
            return None
        function = picked_from(own[~np.isnan(own)], least)
        if place[head.astype(bool)][0] == 0:
            function = known(*(float(x[0]) for x in after(function, np.array([-np.inf]), np.zeros(1), least)))
        return [np.array([function.tobytes()], object)]

    both = with_states(rows.select(*keys, *order), keys, at, heads, [])
    functions = stored(per_group(both, group, order, ["_head", "_at", order[0]], summed, [("payload", binary)]))
    states = scan(_met(chunks, functions, group, "left"), keys, "_at", composed(least))
    known_at = _met(chunks, states, [*keys, "_at"], "left")

    def picks(frame: pd.DataFrame) -> pd.DataFrame:
        head = frame["_head"].to_numpy(bool)
        state = frame["state"][head]
        last, count = (-np.inf, 0) if not len(state) or state.iloc[0] is None else np.frombuffer(state.iloc[0]).reshape(3, -1)[1:, 0]
        return pick(frame[~head], last, count)

    long = per_key(with_states(rows, keys, at, known_at, ["state"]), group, order, picks, df.schema)
    return per_frame(rows_of(df, keys, chunks, False), keys, order, whole, df.schema).unionByName(long)
