"""Decoding of a counter that only runs down: the cheapest never-rising path through its readings, then short gaps filled."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.operators.decoding import CHUNK, FAR, decoded, units
from tidemark.operators.folds import DECODED, TOP, cheapest, fill_short_gaps, per_group
from tidemark.operators.tables import stored

#: What a fall costs, and each step of it; what a value costs that isn't read where others are; weights of a reading's cost.
STEP_COST, DROP_COST, UNSEEN_COST, BEYOND_BEST, OWN = 0.025, 0.07, 0.7, 4, 0.08
#: Ticks of a gap that is filled.
GAP = 3


class Monotone:
    """Ticks are readings, value -> cost. A value that isn't read can only be held; one that is read may be fallen to from any above."""

    values, start = TOP + 1, TOP

    def __init__(self):
        self.fall = units(STEP_COST + DROP_COST * np.arange(self.values))
        self.fall[0] = 0
        self.unseen = int(units(UNSEEN_COST))

    def _read(self, seen: dict[int, float]) -> list[tuple[int, int]]:
        best = min(seen.values())
        return [(v, int(units(max(0.0, c - best) * BEYOND_BEST + c * OWN))) for v, c in seen.items()]

    def least(self, costs: np.ndarray, seen: dict[int, float]) -> np.ndarray:
        if not seen:
            return costs
        now = costs + self.unseen
        for v, cost in self._read(seen):
            now[:, v] = (costs[:, v:] + self.fall[: self.values - v]).min(axis=1) + cost
        return now

    def step(self, costs: np.ndarray, seen: dict[int, float]) -> tuple[np.ndarray, np.ndarray]:
        """Of equal values before, the one nearest to the value counts."""
        back = np.arange(self.values, dtype=np.uint8)
        if not seen:
            return costs, back
        now = costs + self.unseen
        for v, cost in self._read(seen):
            ways = costs[v:] + self.fall[: self.values - v]
            k = int(ways.argmin())
            now[v] = ways[k] + cost
            if ways[k] < FAR:
                back[v] = v + k
        return now, back


def readings(candidates) -> list[dict[int, float]]:
    """A tick's readings; where a credible one has two digits, those of one digit cost more."""
    out = []
    for row in candidates:
        sure = row is not None and any(c["value"] >= 10 and c["cost"] <= 0.3 for c in row)
        out.append(cheapest(row, 0.008, 0.04, lambda c, sure=sure: 0.3 if c["value"] < 10 and sure else 0.0))
    return out


def _visible(flags) -> np.ndarray:
    return np.array([v is not None and v == True for v in flags], bool)  # noqa: E712


def _told(path, before, candidates, visible):
    cost = np.array([s.get(int(v), np.nan) for s, v in zip(readings(candidates), path, strict=True)])
    read = ~np.isnan(cost)
    source = np.where(read, "observed", np.where(before == path, "held", "inferred")).astype(object)
    sure = np.where(read, np.clip(1 - np.nan_to_num(cost) / 0.5, 0.4, 0.98), np.where(source == "held", 0.5, 0.4))
    shown = _visible(visible)
    filled = fill_short_gaps(path, source, shown, GAP)
    return path, np.where(filled, "inferred", source), np.where(filled, 0.62, sure), shown


def monotone_counts(df: DataFrame, keys: list[str], time: str = "t", tie: list[str] | None = None, chunk: float | None = CHUNK) -> DataFrame:
    """Readings ``candidates: array<struct<value, cost, support>>`` and ``visible`` to ``value, source, confidence`` at each tick.

    Keys longer than ``chunk`` seconds are decoded chunk by chunk, with the same result. ``tie``: columns that order ticks of one time."""
    order = [time, *(tie or [])]
    more = (*DECODED, ("_visible", T.BooleanType()))
    short, long = decoded(df, keys, order, ["candidates", "visible"], Monotone(), lambda candidates, _: readings(candidates), _told, more, chunk)
    names = [*keys, *order, *[n for n, _ in DECODED]]
    if long is None:
        return short.select(*names)
    long = stored(long)
    # A gap over the border of chunks is filled from the ticks around the border: so many of each side.
    near = f"_pos <= {GAP} or _pos >= _size - {GAP + 1}"

    def fill(chunk, pos, size, value, source, sure, visible, *rest):
        value, source, sure = value.copy(), source.copy(), sure.copy()
        joins = (pos[1:] == pos[:-1] + 1) & (chunk[1:] == chunk[:-1]) | (pos[1:] == 0) & (pos[:-1] == size[:-1] - 1)
        cuts = np.concatenate([[0], np.flatnonzero(~joins) + 1, [len(pos)]])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            own = value[a:b].astype(np.int64)
            filled = fill_short_gaps(own, source[a:b], _visible(visible[a:b]), GAP)
            value[a:b] = own
            source[a:b][filled], sure[a:b][filled] = "inferred", 0.62
        return [*rest, value, source, sure]

    out = [*[(c, df.schema[c].dataType) for c in order], *DECODED]
    edges = per_group(long.where(near), keys, order, ["_chunk", "_pos", "_size", "value", "source", "confidence", "_visible", *order], fill, out)
    return short.select(*names).unionByName(long.where(f"not ({near})").select(*names)).unionByName(edges.select(*names))
