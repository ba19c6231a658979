"""Decoding of a second counter that appears, runs down and goes: a cheapest path, then repairs of what flicker does to it."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.chunks import framed, last_known, neighbours, run_numbers, running_sum
from tidemark.operators.decoding import CHUNK, FAR, cheapest_path, decoded, units
from tidemark.operators.folds import DECODED, _several, cheapest, per_group, runs_of
from tidemark.operators.tables import stored

VALUES = 100
#: Fixed values. Costs up to which a reading makes a tick readable, and up to which it is clear.
READABLE, CLEAR = 0.24, 0.12
#: Ticks on each side in which a readable tick needs another; in which an unreadable one needs readable ones on both; and how long one shows after.
NEIGHBOURS, SURROUNDED, RECENT = 2, 4, 2
#: A clear higher reading must come again within so many ticks, and the value before be clear in SUPPORT of the last WITHIN ticks.
AGAIN, SUPPORT, WITHIN = 2, 2, 4
#: Seconds for which a counter may vanish, show one other value, or wander, before its old value comes back.
VANISHED, OTHER, WANDERED = 4.0, 1.5, 5.0
#: Confidence of what is only held.
HELD = 0.45


def _count(flags: np.ndarray, back: int, ahead: int, first: np.ndarray | int, end: np.ndarray | int) -> np.ndarray:
    """How many flags are set from ``back`` ticks before to ``ahead`` ticks after each (negative: later, earlier), within its key's ``first`` and ``end``."""
    upto = np.concatenate([[0], np.cumsum(flags)])
    at = np.arange(len(flags))
    return upto[np.clip(at + ahead + 1, first, end)] - upto[np.clip(at - back, first, end)]


def kinds_of(seen: np.ndarray, other: np.ndarray, starts: np.ndarray | None = None) -> np.ndarray:
    """visible, occluded, absent or hidden for each tick, from whether it was read and whether its neighbour counter was.

    ``starts``: where each of many keys starts, the end included; else all ticks are of one."""
    bounds = (0, len(seen)) if starts is None else (np.repeat(starts[:-1], np.diff(starts)), np.repeat(starts[1:], np.diff(starts)))
    count = lambda back, ahead: _count(seen, back, ahead, *bounds)
    accompanied = count(NEIGHBOURS, NEIGHBOURS) >= 2
    surrounded = (count(SURROUNDED, -1) > 0) & (count(-1, SURROUNDED) > 0)
    lasting = np.where(seen, accompanied, surrounded) | (count(RECENT, -1) > 0)
    return np.select([seen & accompanied, lasting, other], ["visible", "occluded", "absent"], "hidden")


#: A drop up to SMALL and one beyond it, each with what a step more costs; a rise; a start from nothing; a fall to nothing, where the counter
#: is absent and elsewhere; what any move costs where the counter isn't seen; a value that isn't read, and nothing, where it is; weights of a reading's cost.
SMALL, FALL, DROP, RISE, START, GONE, LOST, UNSEEN_MOVE = 4, (0.16, 0.02), (0.45, 0.004), (0.4, 0.004), (0.12, 0.001), 0.06, 0.9, 0.4
OTHERS, NOTHING, BEYOND_BEST, OWN, ABSENT, HIDDEN = 0.2, 1.4, 3, 0.15, 0.6, 0.025


class Penalty:
    """Ticks are (readings value -> cost, kind of tick). The counter may appear, run down, jump and go, each at its price."""

    values, start = VALUES, 0

    def __init__(self):
        now, was = np.arange(VALUES)[:, None], np.arange(VALUES)[None, :]
        drop = was - now
        cost = np.where(drop > 0, np.where(drop <= SMALL, FALL[0] + drop * FALL[1], DROP[0] + drop * DROP[1]), RISE[0] - drop * RISE[1])
        cost = np.where(was == 0, START[0] + now * START[1], cost)
        to_zero = lambda c: units(np.where(drop == 0, 0.0, np.where((now == 0) & (was > 0), c, cost)))
        gone, there = to_zero(GONE), to_zero(LOST)
        unseen = there + units(UNSEEN_MOVE) * (1 - np.eye(VALUES, dtype=np.int64))
        self.moves = {"absent": gone, "visible": there, "hidden": unseen, "occluded": unseen}
        place = np.arange(VALUES)
        self.small, self.drop, self.rise, self.begin = (units(c) for c in (FALL[0] + place * FALL[1], place * DROP[1], place * RISE[1], START[0] + place * START[1]))
        self.drop_base, self.rise_base, self.extra = int(units(DROP[0])), int(units(RISE[0])), int(units(UNSEEN_MOVE))
        self.to_zero = {"absent": int(units(GONE)), "visible": int(units(LOST))}

    def emission(self, seen: dict[int, float], kind: str) -> np.ndarray:
        if kind == "visible":
            out = np.full(VALUES, OTHERS)
            out[0] = NOTHING
            best = min(seen.values(), default=0.0)
            for v, c in seen.items():
                out[v] = max(0.0, c - best) * BEYOND_BEST + c * OWN
        elif kind == "absent":
            out = np.where(np.arange(VALUES) == 0, 0.0, ABSENT)
        else:
            out = np.full(VALUES, HIDDEN)
        return units(out)

    def step(self, costs: np.ndarray, tick: tuple) -> tuple[np.ndarray, np.ndarray]:
        """The first of equals on both axes counts."""
        seen, kind = tick
        if (costs < FAR).sum() == 1:
            # The first tick: what can't be reached is never the cheapest to come from.
            only = int(costs.argmin())
            return costs[only] + self.moves[kind][:, only] + self.emission(seen, kind), np.full(VALUES, only, np.uint8)
        total = costs[None, :] + self.moves[kind] + self.emission(seen, kind)[:, None]
        return total.min(axis=1), total.argmin(axis=1).astype(np.uint8)

    def least(self, costs: np.ndarray, tick: tuple) -> np.ndarray:
        """The same least costs for many rows: the prices of falls and rises are linear in the distance, so running minima say them all."""
        seen, kind = tick
        extra = 0 if kind in ("absent", "visible") else self.extra
        best = np.full_like(costs, FAR)
        for d in range(1, SMALL + 1):
            best[:, :-d] = np.minimum(best[:, :-d], costs[:, d:] + self.small[d])
        # From far above: the price grows with the value before.
        above = np.minimum.accumulate((costs + self.drop)[:, ::-1], axis=1)[:, ::-1]
        best[:, : -SMALL - 1] = np.minimum(best[:, : -SMALL - 1], above[:, SMALL + 1 :] - self.drop[: -SMALL - 1] + self.drop_base)
        # From below, but not from nothing.
        below = np.minimum.accumulate((costs - self.rise)[:, 1:], axis=1)
        best[:, 2:] = np.minimum(best[:, 2:], below[:, :-1] + self.rise[2:] + self.rise_base)
        best[:, 1:] = np.minimum(best[:, 1:], costs[:, :1] + self.begin[1:])
        best[:, 0] = costs[:, 1:].min(axis=1) + self.to_zero.get(kind, self.to_zero["visible"])
        return np.minimum(costs, best + extra) + self.emission(seen, kind)


def unconfirmed(path: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Ticks of a positive run before the second of two readable ticks in a row; a run at the first tick counts at once where that is readable."""
    out = np.zeros(len(path), bool)
    twice = seen & np.append(False, seen[:-1])
    positive = path > 0
    for a, b in zip(*runs_of(positive), strict=True):
        if positive[a] and not (a == 0 and seen[0]):
            sure = np.flatnonzero(twice[a:b])
            out[a : a + sure[0] if len(sure) else b] = True
    return out


def early_rises(read: list[dict[int, float]]) -> list[tuple[int, int, int]]:
    """(first, end, value): stretches where an old value holds until a clear, lasting higher one is first seen.

    Of the ticks with a reading before a rise the last tells the old value; the stretch goes back as far as that is read without a gap."""
    clear: dict[int, list[int]] = defaultdict(list)
    for k, r in enumerate(read):
        for v, c in r.items():
            if c <= CLEAR:
                clear[v].append(k)
    times_in = lambda v, a, b: bisect_right(clear[v], b) - bisect_left(clear[v], a)
    out, old, last, streak = [], 0, -1, {}
    for i, r in enumerate(read):
        if not r:
            continue
        new = min(r, key=r.get)
        if 0 < old < new and r[new] <= CLEAR and times_in(new, i + 1, i + AGAIN) and times_in(old, last - WITHIN + 1, last) >= SUPPORT:
            out.append((last - streak[old] + 1, i, old))
        # How long each value has been read without a gap.
        streak = {v: (streak.get(v, 0) if last == i - 1 else 0) + 1 for v in r}
        old, last = new, i
    return out


def bridged(path: np.ndarray, time) -> np.ndarray:
    """Ticks whose value gives way to that of a positive run before and after: one other value for a moment, then any short way back.

    ``path`` is changed there."""
    given = np.zeros(len(path), bool)
    first, end = (x.tolist() for x in runs_of(path))
    value = path[first].tolist() if len(path) else []
    took = False
    for r in range(1, len(first) - 1):
        # A run after one that gave way continues the run before it.
        short = time[end[r] - 1] - time[first[r]] <= (VANISHED if value[r] == 0 else OTHER)
        took = not took and value[r - 1] > 0 and value[r + 1] == value[r - 1] and short
        if took:
            path[first[r] : end[r]], given[first[r] : end[r]] = value[r - 1], True
    first, end = (x.tolist() for x in runs_of(path))
    value = path[first].tolist() if len(path) else []
    r = 0
    while r < len(first):
        left = end[r] - 1
        again = next((q for q in range(r + 2, len(first)) if value[q] == value[r]), None) if value[r] > 0 else None
        back = None if again is None else first[again]
        if back is not None and (back == left + 2 or time[back - 1] - time[left] <= WANDERED):
            path[left + 1 : back], given[left + 1 : back] = value[r], True
            r = again
        else:
            r += 1
    return given


def _flag(c) -> np.ndarray:
    return np.array([v is not None and v == True for v in c], bool)  # noqa: E712


def _readings(candidates) -> list[dict[int, float]]:
    return [{v: c for v, c in cheapest(r, 0.012, 0.06).items() if 0 < v < VALUES} for r in candidates]


def _seen(candidates, visible) -> np.ndarray:
    return _flag(visible) & np.array([r is not None and any(c["cost"] <= READABLE for c in r) for r in candidates], bool)


def _sources(path, before, read, kind) -> tuple[np.ndarray, np.ndarray]:
    """Where each tick's value is from, and how sure it is."""
    cost = np.array([r.get(int(v), np.nan) for r, v in zip(read, path, strict=True)])
    told, none, same = ~np.isnan(cost), (kind == "absent") & (path == 0), before == path
    source = np.where(told | none, "observed", np.where(same, "held", "inferred")).astype(object)
    return source, np.select([told, none, same], [np.clip(1 - np.nan_to_num(cost) / 0.5, 0.35, 0.98), 0.9, HELD], 0.35)


def _give_up(path, source, sure, early) -> None:
    path[early] = 0
    source[early], sure[early] = "held", np.minimum(sure[early], HELD)


def _repair(path, source, sure, read, times) -> None:
    """Rises that came too early, and what flicker parted, in place."""
    for a, b, v in early_rises(read):
        mine = np.array([r.get(v, np.nan) for r in read[a:b]])
        path[a:b] = v
        source[a:b] = np.where(np.isnan(mine), "held", "observed")
        sure[a:b] = np.where(np.isnan(mine), HELD, np.clip(1 - np.nan_to_num(mine) / 0.5, 0.35, 0.98))
    gave = bridged(path, times)
    source[gave], sure[gave] = "held", np.minimum(sure[gave], HELD)


def _told(path, before, times, candidates, visible, other):
    seen, read = _seen(candidates, visible), _readings(candidates)
    source, sure = _sources(path, before, read, kinds_of(seen, _flag(other)))
    _give_up(path, source, sure, unconfirmed(path, seen))
    _repair(path, source, sure, read, times)
    return path, source, sure


def told_many(starts, times, candidates, visible, other, decoder: Penalty):
    """What :func:`_told` says of the cheapest path of each of many keys.

    Where no tick of a key is visible, to stay at nothing costs least at every tick, so there is no path to look for; a lone tick is never visible."""
    several = _several(starts)
    rows = np.flatnonzero(np.repeat(np.diff(starts) > 1, np.diff(starts)))
    seen = np.zeros(len(times), bool)
    seen[rows] = _seen(candidates[rows], visible[rows])
    kind = kinds_of(seen, _flag(other), starts)
    none, shown = kind == "absent", np.concatenate([[0], np.cumsum(kind == "visible")]).tolist()
    path, source, sure = np.zeros(len(times), np.int64), np.where(none, "observed", "held").astype(object), np.where(none, 0.9, HELD)
    for a, b in several:
        on = shown[b] > shown[a]
        # An early rise takes two ticks of the old value and two of the new one.
        if not on and b - a < SUPPORT + 2:
            continue
        read = _readings(candidates[a:b])
        if on:
            path[a:b], before = cheapest_path(decoder, list(zip(read, kind[a:b], strict=True)))
            source[a:b], sure[a:b] = _sources(path[a:b], before, read, kind[a:b])
            _give_up(path[a:b], source[a:b], sure[a:b], unconfirmed(path[a:b], seen[a:b]))
        _repair(path[a:b], source[a:b], sure[a:b], read, times[a:b])
    return path, source, sure


#: Ticks without a reading on both sides of a cut, so that no count of clear readings reaches over it; ticks in which a long run shows.
APART, STEADY = 4, 12
_LONG = (*DECODED, ("_first", T.IntegerType()), ("_seen", T.BooleanType()))


def _prepared(keys: list[str], order: list[str], chunk: float):
    """Add ``_kind``, which looks at the ticks around each, to rows of long keys."""

    def prepare(rows: DataFrame) -> DataFrame:
        readable = F.exists("candidates", lambda c: c["cost"] <= READABLE)
        flags = rows.withColumn("_seen", (F.coalesce("visible", F.lit(False)) & F.coalesce(readable, F.lit(False))).cast("int")).withColumn("_other", F.coalesce("other_visible", F.lit(False)))

        def kinds(w) -> dict:
            count = lambda a, b: F.coalesce(F.sum("_seen").over(w.rowsBetween(a, b)), F.lit(0))
            seen, accompanied = F.col("_seen") == 1, count(-NEIGHBOURS, NEIGHBOURS) >= 2
            lasting = F.when(seen, accompanied).otherwise((count(-SURROUNDED, -1) > 0) & (count(1, SURROUNDED) > 0)) | (count(-RECENT, -1) > 0)
            return {"_kind": F.when(seen & accompanied, "visible").when(lasting, "occluded").when(F.col("_other"), "absent").otherwise("hidden")}

        return framed(flags, keys, order, SURROUNDED, SURROUNDED, kinds, chunk).drop("_seen", "_other")

    return prepare


def _long_told(path, before, candidates, visible, kind):
    seen, read = _seen(candidates, visible), _readings(candidates)
    source, sure = _sources(path, before, read, kind)
    first = np.array([min(r, key=r.get) if r else None for r in read], object)
    return path, source, sure, first, seen


def _repaired(rows: DataFrame, keys: list[str], order: list[str], chunk: float) -> DataFrame:
    """The repairs over long keys: what isn't confirmed goes by windows; the rest by stretches that no repair reaches over.

    A stretch may end in the middle of a gap without readings, of a run that is too long to be bridged, where no rise lies across. A key whose
    counter never rests so long is one stretch."""
    numbered = run_numbers(rows.withColumn("_on", F.col("value") > 0), keys, order, ["_on"], lambda b, n: b["_on"] != n["_on"], "_run", chunk)
    near = neighbours(numbered, keys, order, ["_seen"], chunk, before="_b")
    twice = F.col("_on") & F.col("_seen") & (F.col("_b").isNull() | F.col("_b._seen"))
    sure = last_known(near, keys, order, F.when(twice, F.col("_run")), chunk, before="_sure")
    early = F.col("_on") & ~F.coalesce(F.col("_sure") == F.col("_run"), F.lit(False))
    given = sure.withColumns({"value": F.when(early, 0).otherwise(F.col("value")), "source": F.when(early, "held").otherwise(F.col("source")), "confidence": F.when(early, F.least("confidence", F.lit(HELD))).otherwise(F.col("confidence"))})
    given = given.drop("_on", "_run", "_b", "_sure")
    known = last_known(given, keys, order, F.col("_first"), chunk, before="_old", after="_new")

    def cuts(w) -> dict:
        past = w.rowsBetween(-STEADY, 0)
        steady = (F.min("value").over(past) == F.max("value").over(past)) & (F.count("*").over(past) > STEADY) & (F.col(order[0]) - F.min(order[0]).over(past) > WANDERED)
        around = w.rowsBetween(-APART, APART - 1)
        silent = (F.count("_first").over(around) == 0) & (F.count("*").over(around) == 2 * APART)
        return {"_cut": (steady & silent & ~F.coalesce((F.col("_old") > 0) & (F.col("_old") < F.col("_new")), F.lit(False))).cast("int")}

    cut = running_sum(framed(known, keys, order, STEADY, APART, cuts, chunk), keys, order, F.col("_cut"), "_stretch", chunk)

    def fold(times, value, source, confidence, candidates, *rest):
        value, source, confidence = value.astype(np.int64), source.copy(), confidence.copy()
        _repair(value, source, confidence, _readings(candidates), times)
        return [*rest, value, source, confidence]

    out = [*[(c, rows.schema[c].dataType) for c in order], *DECODED]
    return per_group(cut, [*keys, "_stretch"], order, [order[0], "value", "source", "confidence", "candidates", *order], fold, out)


def penalty_counts(df: DataFrame, keys: list[str], time: str = "t", tie: list[str] | None = None, chunk: float | None = CHUNK) -> DataFrame:
    """Readings ``visible, candidates: array<struct<value, cost, support>>`` and ``other_visible`` to ``value, source, confidence``.

    Keys longer than ``chunk`` seconds are decoded chunk by chunk, with the same result. ``tie``: columns that order ticks of one time."""
    order = [time, *(tie or [])]
    ticks = lambda _, candidates, visible, other: list(zip(_readings(candidates), kinds_of(_seen(candidates, visible), _flag(other)), strict=True))
    kept = ("candidates", df.schema["candidates"].dataType)
    long_ticks = lambda candidates, _, kind: list(zip(_readings(candidates), kind, strict=True))
    tell = lambda path, before, candidates, visible, kind: (*_long_told(path, before, candidates, visible, kind), candidates)
    long_form = (_prepared(keys, order, chunk), ["candidates", "visible", "_kind"], long_ticks, tell, (*_LONG, kept)) if chunk is not None else None
    decoder = Penalty()
    many = lambda starts, *columns: told_many(starts, *columns, decoder)
    short, long = decoded(df, keys, order, [time, "candidates", "visible", "other_visible"], decoder, ticks, _told, DECODED, chunk, long_form, many)
    names = [*keys, *order, *[n for n, _ in DECODED]]
    return short.select(*names) if long is None else short.select(*names).unionByName(_repaired(stored(long), keys, order, chunk).select(*names))
