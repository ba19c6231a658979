"""Order-dependent folds: what a window can't say because each step depends on what the last one chose.

Each runs over the rows of a key in order. Rows are dealt and sorted by key, and a task folds one key after the other from its stream of
Arrow batches, so many small keys cost no more than their rows. A key is one recording's timeline: bounded by its length. A key that is longer is
cut first, where nothing is carried over, or by session (:func:`tidemark.operators.windows.gap_sessions`), and folded by (key, session).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.chunks import neighbours, running_sum

#: Values of a counter that runs down.
TOP = 100
#: Seconds of a chunk of a timeline.
CHUNK = 30 * 86_400.0


def _schema(df: DataFrame, names: list[str], *more: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([df.schema[n] for n in names] + [T.StructField(n, t) for n, t in more])


def per_key(df: DataFrame, keys: list[str], order: list[str], fold, schema: T.StructType) -> DataFrame:
    """``fold`` of each key's rows, which come sorted by ``order``. A key that goes on in the next batch is kept back until it ends."""
    names = schema.fieldNames()

    def run(frames):
        for frame, starts in _whole(frames, keys):
            out = [x for a, b in zip(starts[:-1], starts[1:], strict=True) if len(x := fold(frame.iloc[a:b]))]
            if out:
                yield pd.concat(out, ignore_index=True)[names]

    return _sorted(df, keys, order).mapInPandas(run, schema)


def per_frame(df: DataFrame, keys: list[str], order: list[str], fold, schema: T.StructType) -> DataFrame:
    """``fold(frame, starts)`` of many whole keys at once: where the rows of each begin, the end included. No frame is made for a key."""
    names = schema.fieldNames()

    def run(frames):
        for frame, starts in _whole(frames, keys):
            yield fold(frame, starts)[names]

    return _sorted(df, keys, order).mapInPandas(run, schema)


def _ordered(frame: pd.DataFrame, starts: np.ndarray, by: list[str], ascending: list[bool] | None = None) -> pd.DataFrame:
    """The rows of each key ordered, with what isn't a number last; keys stay where they are."""
    rising = [True] * len(by) if ascending is None else ascending
    whose = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    # A column of its own: rows of a key are together, whatever the keys are.
    return frame.assign(_whose=whose).sort_values(["_whose", *by], ascending=[True, *rising], kind="stable").drop(columns="_whose").reset_index(drop=True)


def _several(starts: np.ndarray) -> list[tuple[int, int]]:
    """First and end of each key with more than one row; most keys may have but one, which needs no fold."""
    more = np.flatnonzero(np.diff(starts) > 1)
    return list(zip(starts[more].tolist(), starts[more + 1].tolist(), strict=True))


def _sorted(df: DataFrame, keys: list[str], order: list[str], tasks: int | None = None) -> DataFrame:
    # The number of tasks is given, or small rows with much work each would be merged to one.
    return df.repartition(tasks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys, *order)


def _whole(frames, keys: list[str]):
    """Frames that end where a key ends, and where their keys start, the end included. Batches of one key are put together once."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        if not len(frame):
            continue
        if held and len(_key_starts(frame, keys)) == 1 and len(_key_starts(pd.concat([held[-1].tail(1), frame.head(1)]), keys)) == 1:
            held.append(frame)
            continue
        whole = pd.concat([*held, frame], ignore_index=True) if held else frame.reset_index(drop=True)
        starts = _key_starts(whole, keys)
        if len(starts) > 1:
            yield whole.iloc[: starts[-1]], starts
        held = [whole.iloc[starts[-1] :]]
    if held:
        whole = pd.concat(held, ignore_index=True)
        yield whole, np.array([0, len(whole)])


def _key_starts(frame: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """Where the rows of a key begin; null keys are equal."""
    changes = np.zeros(len(frame) - 1, bool)
    for k in keys:
        v = frame[k].to_numpy()
        changes |= (v[1:] != v[:-1]) & ~(pd.isna(v[1:]) & pd.isna(v[:-1]))
    return np.concatenate([[0], np.flatnonzero(changes) + 1])


def per_group(df: DataFrame, keys: list[str], order: list[str], reads: list[str], fold, out: list[tuple[str, T.DataType]], tasks: int | None = None) -> DataFrame:
    """The keys and what ``fold`` makes of the columns ``reads`` of each key's rows: arrays of one length, or None. No frame is made for a key."""
    schema = _schema(df, keys, *out)

    def run(frames):
        for frame, starts in _whole(frames, keys):
            columns, made, whose = [frame[c].to_numpy() for c in reads], [], []
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                if (got := fold(*(c[a:b] for c in columns))) is not None and len(got[0]):
                    made.append(got)
                    whose.append(np.full(len(got[0]), a))
            if made:
                told = frame.iloc[np.concatenate(whose)][keys].reset_index(drop=True)
                yield told.assign(**{n: np.concatenate([m[k] for m in made]) for k, (n, _) in enumerate(out)})

    return _sorted(df.select(*dict.fromkeys([*keys, *order, *reads])), keys, order, tasks).mapInPandas(run, schema)


def per_row(df: DataFrame, keys: list[str], order: list[str], reads: list[str], fold, *more: tuple[str, T.DataType], many: bool = False) -> DataFrame:
    """Like :func:`per_key` for folds that give each row some values: no frame is made for a key.

    ``fold`` gets the columns ``reads`` of a key's rows as arrays and returns the new columns ``more`` in that order; with ``many`` it gets where each
    of many whole keys starts, the end included, and the columns of all of them."""
    kept = [*keys, *order]

    def run(frames):
        for frame, starts in _whole(frames, keys):
            columns = [frame[c].to_numpy() for c in reads]
            parts = [fold(starts, *columns)] if many else [fold(*(c[a:b] for c in columns)) for a, b in zip(starts[:-1], starts[1:], strict=True)]
            yield frame[kept].assign(**{n: np.concatenate([p[k] for p in parts]) for k, (n, _) in enumerate(more)})

    return _sorted(df.select(*dict.fromkeys([*kept, *reads])), keys, order).mapInPandas(run, _schema(df, kept, *more))


#: What the decoders add to a tick.
DECODED = (("value", T.LongType()), ("source", T.StringType()), ("confidence", T.DoubleType()))


def runs_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end (exclusive) place of each run of equal values."""
    if not len(values):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    first = np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1])
    return first, np.append(first[1:], len(values))


def fill_short_gaps(path: np.ndarray, source: np.ndarray, visible: np.ndarray, most: int = 3) -> np.ndarray:
    """Which places to fill, with ``path`` changed there: a run of at most ``most`` held, visible ticks between two observed ones of
    which the later is lower lies on the line between them (rounded half up)."""
    filled = np.zeros(len(path), bool)
    gap = (source == "held") & visible
    for a, b in zip(*runs_of(gap), strict=True):
        if gap[a] and b - a <= most and 0 < a and b < len(path) and source[a - 1] == source[b] == "observed" and path[b] < path[a - 1]:
            share = np.arange(1, b - a + 1) / (b - a + 1)
            path[a:b] = np.floor(path[a - 1] + (path[b] - path[a - 1]) * share + 0.5).astype(path.dtype)
            filled[a:b] = True
    return filled


def cheapest(row, bonus: float, most: float, penalty=None) -> dict[int, float]:
    """Value -> least cost of the readings of one tick; support beyond one makes a reading cheaper by ``bonus`` each, up to ``most``."""
    held: dict[int, float] = {}
    for c in [] if row is None else row:
        cost = c["cost"] - min(most, max(0, (c["support"] or 1) - 1) * bonus) + (penalty(c) if penalty else 0.0)
        held[int(c["value"])] = min(cost, held.get(int(c["value"]), np.inf))
    return held


def flips_of(frame: pd.DataFrame, starts: np.ndarray, value: str, confidence: str, cap: float) -> pd.DataFrame:
    several = _several(starts)
    if not several:
        return frame
    v, after, c = frame[value].tolist(), frame["_next"].tolist(), frame[confidence].tolist()
    for a, b in several:
        for i in range(a + 1, b):
            if v[i - 1] == after[i]:
                v[i], c[i] = v[i - 1], min(c[i], cap)
    return frame.assign(**{value: v, confidence: c})


def smooth_flips(df: DataFrame, keys: list[str], time: str, value: str, confidence: str, span: float = 3.0, cap: float = 0.65, tie: list[str] | None = None, chunk: float | None = CHUNK) -> DataFrame:
    """A value between two equal ones within ``span`` seconds takes theirs; from left to right, each seeing what was changed before.

    A row whose successor is equal to it, or whose neighbours are too far apart, keeps its value whatever comes before, so a key is cut there."""
    order = [time, *(tie or [])]
    near = neighbours(df, keys, order, [time, value], chunk, before="_b", after="_a")
    may = F.col("_b").isNotNull() & F.col("_a").isNotNull() & (F.col(f"_a.{time}") - F.col(f"_b.{time}") <= span) & ~F.col(f"_a.{value}").eqNullSafe(F.col(value))
    plain = near.select(*df.columns, F.col(f"_a.{value}").alias("_next"), F.when(may, 0).otherwise(1).alias("_keeps"))
    cut = running_sum(plain, keys, order, F.col("_keeps"), "_stretch", chunk)

    fold = lambda frame, starts: flips_of(frame, starts, value, confidence, cap)
    return per_frame(cut, [*keys, "_stretch"], order, fold, df.schema)


def clusters_of(frame: pd.DataFrame, starts: np.ndarray, order: list[str], radius: float) -> pd.DataFrame:
    frame = _ordered(frame, starts, order)
    names = np.ones(len(frame), np.int64)
    xs, ys = frame["x"].tolist(), frame["y"].tolist()
    for a, b in _several(starts):
        means: list[list[float]] = []
        for i in range(a, b):
            x, y = xs[i], ys[i]
            near = min(((np.hypot(m[0] - x, m[1] - y), k) for k, m in enumerate(means)), default=(np.inf, -1))
            if near[0] > radius:
                means.append([x, y, 1.0])
                names[i] = len(means)
                continue
            m = means[near[1]]
            m[2] += 1
            m[0] += (x - m[0]) / m[2]
            m[1] += (y - m[1]) / m[2]
            names[i] = near[1] + 1
    return frame.assign(cluster=names)


def cluster_points(df: DataFrame, keys: list[str], order: list[str], radius: float) -> DataFrame:
    """Add ``cluster``: each point ``x, y`` joins the nearest cluster within ``radius`` of its running mean, else starts one."""
    fold = lambda frame, starts: clusters_of(frame, starts, order, radius)
    return per_frame(df, keys, order, fold, _schema(df, df.columns, ("cluster", T.LongType())))


def tracks_of(frame: pd.DataFrame, starts: np.ndarray, time: str, reach: float, most: int) -> pd.DataFrame:
    frame = _ordered(frame, starts, [time, "x", "y"])
    n, t = len(frame), frame[time].to_numpy()
    opens = np.ones(n, bool)
    opens[1:] = t[1:] != t[:-1]
    opens[starts[:-1]] = True
    first = np.maximum.accumulate(np.where(opens, np.arange(n), 0))
    taken = (np.arange(n) - first < most) & ~pd.isna(t)
    names = np.ones(n, np.int64)
    xs, ys, fresh, held = frame["x"].tolist(), frame["y"].tolist(), opens.tolist(), taken.tolist()
    for a, b in _several(starts):
        last: list[tuple[float, float]] = []
        used: set[int] = set()
        for i in range(a, b):
            if fresh[i]:
                used = set()
            if not held[i]:
                continue
            x, y = xs[i], ys[i]
            near = min(((np.hypot(p[0] - x, p[1] - y), k) for k, p in enumerate(last) if k not in used), default=(np.inf, -1))
            k = near[1]
            if near[0] > reach:
                last.append((x, y))
                k = len(last) - 1
            last[k] = (x, y)
            used.add(k)
            names[i] = k + 1
    return frame.assign(track=names)[taken]


def track_objects(df: DataFrame, keys: list[str], time: str, reach: float, most: int = 3) -> DataFrame:
    """Add ``track``: at each time the first ``most`` points continue the nearest free track within ``reach``, else open one."""
    fold = lambda frame, starts: tracks_of(frame, starts, time, reach, most)
    return per_frame(df, keys, [time, "x", "y"], fold, _schema(df, df.columns, ("track", T.LongType())))


def chains_of(frame: pd.DataFrame, starts: np.ndarray, keys: list[str], time: str, move: float, gap: float) -> pd.DataFrame:
    frame = _ordered(frame, starts, [time, "x", "y"])
    ts, xs, ys = (frame[c].to_numpy(float) for c in (time, "x", "y"))
    heads = starts[:-1]
    length, start, end = np.ones(len(heads), np.int64), ts[heads].copy(), ts[heads].copy()
    several = np.flatnonzero(np.diff(starts) > 1).tolist()
    for g, (a, b) in zip(several, _several(starts), strict=True):
        t, x, y = ts[a:b], xs[a:b], ys[a:b]
        size, since = np.ones(b - a, np.int64), t.copy()
        lows = np.searchsorted(t, t - gap)
        # A row that no other comes before in time starts a chain.
        for i in np.flatnonzero(lows < np.arange(b - a)).tolist():
            j = np.arange(lows[i], i)
            j = j[(t[j] < t[i]) & (np.hypot(x[j] - x[i], y[j] - y[i]) <= move)]
            if len(j):
                before = j[int(size[j].argmax())]
                size[i], since[i] = size[before] + 1, since[before]
        best = int(size.argmax())
        length[g], start[g], end[g] = size[best], since[best], t[best]
    return frame.iloc[heads][keys].assign(length=length, start=start, end=end)


def longest_chain(df: DataFrame, keys: list[str], time: str, move: float, gap: float) -> DataFrame:
    """``length, start, end`` of the longest chain of points ``x, y``, each near the one before in place and time."""
    fold = lambda frame, starts: chains_of(frame, starts, keys, time, move, gap)
    needed = df.select(*dict.fromkeys([*keys, time, "x", "y"]))
    return per_frame(needed, keys, [time, "x", "y"], fold, _schema(df, keys, ("length", T.LongType()), ("start", T.DoubleType()), ("end", T.DoubleType())))


def peaks_of(frame: pd.DataFrame, starts: np.ndarray, distance: float, most: int) -> pd.DataFrame:
    frame = _ordered(frame, starts, ["score", "x", "y"], [False, True, True])
    keep = np.zeros(len(frame), bool)
    keep[starts[:-1]] = most > 0
    x, y = frame["x"].to_numpy(float), frame["y"].to_numpy(float)
    for a, b in _several(starts):
        kept = [a]
        for i in range(a + 1, b):
            if len(kept) >= most:
                break
            if all(np.hypot(x[i] - x[k], y[i] - y[k]) > distance for k in kept):
                kept.append(i)
                keep[i] = True
    return frame[keep]


def suppress_peaks(df: DataFrame, keys: list[str], distance: float, most: int) -> DataFrame:
    """Points ``x, y, score``, best first, farther than ``distance`` from every better one that was kept; ``most`` at the most."""
    fold = lambda frame, starts: peaks_of(frame, starts, distance, most)
    return per_frame(df, keys, ["score", "x", "y"], fold, df.schema)


#: Fixed values. Rates a second at which a counter of a rule can fall, and how much more a fall may be.
RATES = {"area": 2.25, "tower": 2.5, "carry": 6.0}
LEAST_ELAPSED, SPARE = 0.5, 1
#: How far a reading's cost may lie above the cheapest for the value held to stay, and for a fall.
STAYS, FALLS = 0.14, 0.16
#: Costs up to which a reading is clear, and up to which it renews trust; ticks looked ahead for one that bears a fall out and for
#: one that takes it back; seconds for which a fall keeps the count moving.
CLEAR, TRUSTED, FUTURE, RECOVERY, SCORING = 0.24, 0.3, 4, 6, 2.0
#: A reading below 10 costs more where one of two digits is credible; a 1 before 2 to 9 is what is left of 11 (for counts from 10 to 19).
SHORT_COST, ELEVEN, ELEVEN_FROM, ELEVEN_TO, REST = 0.2, 11, 10, 19, range(2, 10)
#: From a count of this on, a fall below 10 needs both kinds of evidence.
FAR_FROM_ZERO = 20


class RunningCount:
    """A count that only falls. Evidence for a fall: the count is moving, or the next reading bears the fall out."""

    def __init__(self, top: int, start: float, rate: float | None):
        self.value, self.moved, self.trusted, self.rate = top, -np.inf, start, rate

    def reach(self, t: float) -> float:
        """The lowest value that the rate allows by now."""
        return -np.inf if self.rate is None else self.value - np.ceil(max(LEAST_ELAPSED, t - self.trusted) * self.rate) - SPARE

    def halved_eleven(self, low: int, soon: tuple[int, float] | None) -> bool:
        return low == 1 and ELEVEN_FROM <= self.value <= ELEVEN_TO and soon is not None and soon[0] in REST

    def accepts(self, t: float, low: int, soon: tuple[int, float] | None, ahead: list[int]) -> bool:
        """``soon``: the next reading's best; ``ahead``: clear best values in the ticks to come."""
        taken_back = any(low < v <= self.value for v in ahead) and not self.halved_eleven(low, soon)
        evidence = (t - self.moved <= SCORING) + (soon is not None and soon[0] <= low and soon[1] <= CLEAR)
        return not taken_back and low >= self.reach(t) and evidence >= (2 if low < 10 and self.value >= FAR_FROM_ZERO else 1)

    def take(self, t: float, held: dict[int, float], soon: tuple[int, float] | None, ahead: list[int]) -> bool:
        """Take one tick's readings in; whether the count fell."""
        below = {v: c for v, c in held.items() if v <= self.value}
        two_digits = self.value >= 10 and any(v >= 10 and c <= TRUSTED for v, c in below.items())
        ranked = sorted(((c + (SHORT_COST if v < 10 and two_digits else 0.0), k, v) for k, (v, c) in enumerate(below.items())))
        falls = [] if not ranked or held.get(self.value, np.inf) <= ranked[0][0] + STAYS else [(c, v) for c, _, v in ranked]
        # Only readings that are no dearer than the value held compete with it.
        own = next((k for k, (_, v) in enumerate(falls) if v == self.value), len(falls))
        low = next((v for c, v in falls[:own] if c <= falls[0][0] + FALLS and self.accepts(t, v, soon, ahead)), self.value)
        low = ELEVEN if self.halved_eleven(low, soon) else low
        fell = low < self.value
        if fell:
            self.value, self.moved = low, t
        if held.get(self.value, 1.0) <= TRUSTED:
            self.trusted = t
        return fell


def decode_greedy(times, seen: list[dict[int, float]], rate: float | None, top: int = TOP) -> tuple[list[int], list[bool]]:
    """Value at each tick and whether it fell there."""
    best = [min(s.items(), key=lambda x: x[1]) if s else None for s in seen]
    count = RunningCount(top, times[0] if len(times) else 0.0, rate)
    values, fell = [], []
    for i, (t, held) in enumerate(zip(times, seen, strict=True)):
        coming = best[i + 1 : i + 1 + RECOVERY]
        soon = next((b for b in coming[:FUTURE] if b), None)
        fell.append(count.take(t, held, soon, [b[0] for b in coming if b and b[1] <= CLEAR]))
        values.append(count.value)
    return values, fell


def greedy_counts(df: DataFrame, keys: list[str], time: str = "t", rate: float | None = None) -> DataFrame:
    """Like :func:`monotone_counts` for panels that are read digit by digit: falls must be possible at ``rate`` and borne out."""

    def fold(times, candidates):
        seen = [cheapest(row, 0.012, 0.06) for row in candidates]
        path, fell = decode_greedy(times, seen, rate)
        cost = np.array([s.get(v, np.nan) for s, v in zip(seen, path, strict=True)])
        source = np.where(~np.isnan(cost), "observed", np.where(fell, "inferred", "held"))
        sure = np.where(~np.isnan(cost), np.clip(1 - np.maximum(0.0, np.nan_to_num(cost)) / 0.5, 0.35, 0.98), np.where(fell, 0.7, 0.45))
        return np.array(path, np.int64), source, sure

    return per_row(df, keys, [time], [time, "candidates"], fold, *DECODED)
