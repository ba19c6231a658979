"""Cheapest paths through readings, for timelines of any length.

Costs are whole numbers of a trillionth, so that sums don't depend on how they are put together, and ties are ties. A chunk of a long
timeline is a matrix: the least cost from each value before it to each value after it. Matrices are composed in a tree
(:mod:`tidemark.operators.scans`), which tells each chunk the costs it starts with. Then each chunk knows, for every value it may end with, the value
it began with; these maps are composed from the end. Last, each chunk follows its own path.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.folds import per_group, per_row
from tidemark.operators.scans import _met, long_keys, rows_of, scan, with_states
from tidemark.operators.tables import stored

UNIT, FAR = 10**12, np.int64(1) << np.int64(60)
#: Seconds of a timeline that one task decodes in a row.
CHUNK = 4 * 3600.0


def units(cost):
    """Costs as whole numbers."""
    return np.rint(np.asarray(cost, float) * UNIT).astype(np.int64)


def fewest(costs: np.ndarray) -> np.ndarray:
    """The same costs with the least at zero; what can't be reached stays so."""
    return np.where(costs >= FAR, FAR, costs - costs.min())


def unreached(values: int, start: int) -> np.ndarray:
    costs = np.full((1, values), FAR)
    costs[0, start] = 0
    return costs


def between(values: int) -> np.ndarray:
    """The matrix of no ticks."""
    return np.where(np.eye(values, dtype=bool), 0, FAR)


def advanced(decoder, costs: np.ndarray, ticks: list) -> np.ndarray:
    """The costs after these ticks, for one row of costs or a matrix."""
    for tick in ticks:
        costs = np.minimum(decoder.least(costs, tick), FAR)
    return costs


def traced(decoder, costs: np.ndarray, ticks: list) -> tuple[np.ndarray, np.ndarray]:
    """The costs after these ticks, and for each tick and value the value before it."""
    back = np.empty((len(ticks), decoder.values), np.uint8)
    costs = costs[0]
    for i, tick in enumerate(ticks):
        costs, back[i] = decoder.step(costs, tick)
        costs = np.minimum(costs, FAR)
    return costs, back


def followed(back: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The path that ends with a value, and the value before each of its ticks."""
    path, before = np.zeros(len(back), np.int64), np.zeros(len(back), np.int64)
    for i in range(len(back) - 1, -1, -1):
        path[i], before[i] = end, back[i, end]
        end = int(back[i, end])
    return path, before


def beginnings(back: np.ndarray, values: int) -> np.ndarray:
    """For each value at the end the value before the first tick."""
    at = np.arange(values)
    for i in range(len(back) - 1, -1, -1):
        at = back[i, at]
    return at.astype(np.uint8)


def cheapest_path(decoder, ticks: list) -> tuple[np.ndarray, np.ndarray]:
    """The path of least cost and the value before each tick; of equal ends the smallest value."""
    costs, back = traced(decoder, unreached(decoder.values, decoder.start), ticks)
    return followed(back, int(costs.argmin()))


def composed_costs(values: int) -> Callable[[bytes, bytes], bytes]:
    """Least costs over two stretches, one after the other."""

    def compose(first: bytes, then: bytes) -> bytes:
        a, b = (np.frombuffer(x, np.int64).reshape(-1, values) for x in (first, then))
        out = np.stack([(row[:, None] + b).min(axis=0) for row in a])
        return np.where(out >= FAR, FAR, fewest(np.minimum(out, FAR))).tobytes()

    return compose


def composed_maps(first: bytes, then: bytes) -> bytes:
    return np.frombuffer(then, np.uint8)[np.frombuffer(first, np.uint8)].tobytes()


def decoded(
    df: DataFrame, keys: list[str], order: list[str], reads: list[str], decoder, ticks_of: Callable, tell: Callable, more: tuple, chunk: float | None = CHUNK, long_form: tuple | None = None, many: Callable | None = None,
) -> tuple[DataFrame, DataFrame | None]:
    """Rows ``keys, order, more``: of keys that fit a chunk, and of longer ones (with ``_chunk, _pos, _size``; None where there are none).

    ``ticks_of`` makes ticks for the decoder of the columns ``reads``; ``tell(path, value before, *columns)`` makes the columns ``more``. ``order`` must order
    a key's rows completely. ``long_form`` stands for (prepare, reads, ticks_of, tell, more) of the longer keys, whose rows ``prepare`` gets first, where a
    chunk alone can't tell what the whole can. ``many(starts, *columns)`` makes the columns ``more`` of many short keys at once."""

    def alone(*columns):
        return tell(*cheapest_path(decoder, ticks_of(*columns)), *columns)

    def whole(rows: DataFrame) -> DataFrame:
        return per_row(rows, keys, order, reads, many or alone, *told, many=many is not None)

    told = more
    if chunk is None:
        return whole(df), None
    at, n = F.floor(F.col(order[0]) / chunk).cast("long"), decoder.values
    chunks = stored(long_keys(df, keys, at))
    if chunks.isEmpty():
        return whole(df), None
    short = whole(rows_of(df, keys, chunks, False))
    rows = rows_of(df, keys, chunks, True)
    if long_form:
        prepare, reads, ticks_of, tell, more = long_form
        rows = stored(prepare(rows))
    rows = rows.select(*dict.fromkeys([*keys, *order, *reads]))
    group, binary = [*keys, "_chunk"], T.BinaryType()

    def chunked(heads: DataFrame, carried: list[str], fold, out: list) -> DataFrame:
        """``fold(head, *columns)`` of the chunks that have a head; the head is a dict of what it carries."""
        names = ["_at", "_left", *carried]

        def run(*columns):
            head = columns[0].astype(bool)
            if not head.any():
                return None
            return fold({c: v[head][0] for c, v in zip(names, columns[1 : 1 + len(names)], strict=True)}, *[v[~head] for v in columns[1 + len(names) :]])

        both = with_states(rows, keys, at, heads, carried)
        return per_group(both, group, order, ["_head", *names, *dict.fromkeys([*order, *reads])], run, out)

    given = lambda columns: dict(zip(dict.fromkeys([*order, *reads]), columns, strict=True))
    own = lambda columns: [given(columns)[c] for c in reads]

    def summed(head, *columns):
        costs = unreached(n, decoder.start) if head["_at"] == 0 else between(n)
        return [np.array([fewest(advanced(decoder, costs, ticks_of(*own(columns)))).tobytes()], object)]

    def entry(head):
        return unreached(n, decoder.start) if head["_at"] == 0 else np.frombuffer(head["_entry"], np.int64).reshape(1, n)

    def mapped(head, *columns):
        costs, back = traced(decoder, entry(head), ticks_of(*own(columns)))
        first = beginnings(back, n)
        # The last chunk ends with the least of all costs.
        return [np.array([(first[[int(costs.argmin())]] if head["_left"] == 0 else first).tobytes()], object)]

    def pathed(head, *columns):
        costs, back = traced(decoder, entry(head), ticks_of(*own(columns)))
        end = int(costs.argmin()) if head["_left"] == 0 else bytes(head["_exit"])[0]
        told = tell(*followed(back, end), *own(columns))
        size = len(columns[0])
        return [*[given(columns)[c] for c in order], *told, np.arange(size), np.full(size, size)]

    functions = stored(chunked(chunks.where("_left > 0"), [], summed, [("payload", binary)]))
    entries = stored(_met(chunks, scan(_met(chunks, functions, group, "left"), keys, "_at", composed_costs(n)).withColumnRenamed("state", "_entry"), [*keys, "_at"], "left"))
    maps = stored(chunked(entries, ["_entry"], mapped, [("payload", binary)]))
    exits = stored(_met(entries, scan(_met(chunks, maps, group, "left"), keys, "_left", composed_maps).withColumnRenamed("state", "_exit"), [*keys, "_left"], "left"))
    kinds = [(c, df.schema[c].dataType) for c in order]
    long = chunked(exits, ["_entry", "_exit"], pathed, [*kinds, *more, ("_pos", T.LongType()), ("_size", T.LongType())])
    return short, long
