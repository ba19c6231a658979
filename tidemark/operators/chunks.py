"""Window primitives over long timelines that no single task has to hold.

A plain window over a key puts all rows of the key in one task. Here a timeline is cut in chunks of time: rows meet by
(key, chunk), and what a chunk needs from those before or after it (the last row, a running total, the last known
value) comes from a summary with one row per chunk. The rows are shuffled once, the summaries are small, and a key that
holds a third of all rows is spread over as many tasks as it has chunks. The input is read twice, once for the summary.

With ``chunk`` None a plain window is used: for keys of bounded length, such as one recording, where several of these are chained.
``order`` must name columns that order the rows of a key completely; its first column is the time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_CHUNK = "_chunk"
#: Rows of a key that one task of a framed window takes, beside those its frames reach into.
BLOCK_ROWS = 100_000


def _chunked(df: DataFrame, order: list[str], chunk: float) -> DataFrame:
    return df.withColumn(_CHUNK, F.floor(F.col(order[0]) / chunk).cast("long"))


def _within(keys: list[str], order: list[str], chunk: float | None, backwards: bool = False):
    turned = [F.col(c).desc() for c in order] if backwards else [F.col(c) for c in order]
    return Window.partitionBy(*keys, *([] if chunk is None else [_CHUNK])).orderBy(*turned)


def _over_chunks(keys: list[str], backwards: bool = False):
    return Window.partitionBy(*keys).orderBy(F.col(_CHUNK).desc() if backwards else F.col(_CHUNK))


def _carried(df: DataFrame, keys: list[str], carry: DataFrame, names: list[str]) -> DataFrame:
    """Join each chunk's carry to its rows; both are dealt by (key, chunk) already."""
    renamed = carry.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(_CHUNK).alias("_kc"), *names)
    on = F.col(_CHUNK) == F.col("_kc")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return df.join(renamed, on, "left").drop("_kc", *[f"_k{i}" for i in range(len(keys))])


def neighbours(df: DataFrame, keys: list[str], order: list[str], columns: list[str], chunk: float | None, before: str | None = None, after: str | None = None) -> DataFrame:
    """Add a struct of ``columns`` of the row before, the row after, or both, under the names given; null at the key's ends."""
    value, place = F.struct(*columns), F.struct(*order)
    sides = [(n, back) for n, back in ((before, False), (after, True)) if n]
    if chunk is None:
        return df.withColumns({n: F.lag(value).over(_within(keys, order, None, back)) for n, back in sides})
    rows = _chunked(df, order, chunk)
    ends = rows.groupBy(*keys, _CHUNK).agg(F.max_by(value, place).alias("_last"), F.min_by(value, place).alias("_first"))
    carry = ends.withColumns({f"_c{i}": F.lag("_first" if back else "_last").over(_over_chunks(keys, back)) for i, (_, back) in enumerate(sides)})
    local = rows.withColumns({f"_l{i}": F.lag(value).over(_within(keys, order, chunk, back)) for i, (_, back) in enumerate(sides)})
    met = _carried(local, keys, carry, [f"_c{i}" for i in range(len(sides))])
    named = met.withColumns({n: F.coalesce(f"_l{i}", f"_c{i}") for i, (n, _) in enumerate(sides)})
    return named.drop(_CHUNK, *[f"_{x}{i}" for x in "lc" for i in range(len(sides))])


def running_sum(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str, chunk: float | None) -> DataFrame:
    """Add ``name``: the sum of ``value`` up to and with each row."""
    if chunk is None:
        return df.withColumn("_v", value).withColumn(name, F.coalesce(F.sum("_v").over(_within(keys, order, None).rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))).drop("_v")
    rows = _chunked(df, order, chunk).withColumn("_v", value)
    totals = rows.groupBy(*keys, _CHUNK).agg(F.sum("_v").alias("_t"))
    carry = totals.withColumn("_c", F.coalesce(F.sum("_t").over(_over_chunks(keys).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    local = rows.withColumn("_l", F.sum("_v").over(_within(keys, order, chunk).rowsBetween(Window.unboundedPreceding, 0)))
    return _carried(local, keys, carry, ["_c"]).withColumn(name, F.coalesce("_l", F.lit(0)) + F.col("_c")).drop("_l", "_c", "_v", _CHUNK)


def most_before(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str, chunk: float | None) -> DataFrame:
    """Add ``name``: the greatest ``value`` of the rows before each, null where there is none."""
    earlier = (Window.unboundedPreceding, -1)
    if chunk is None:
        return df.withColumn("_v", value).withColumn(name, F.max("_v").over(_within(keys, order, None).rowsBetween(*earlier))).drop("_v")
    rows = _chunked(df, order, chunk).withColumn("_v", value)
    totals = rows.groupBy(*keys, _CHUNK).agg(F.max("_v").alias("_t"))
    carry = totals.withColumn("_c", F.max("_t").over(_over_chunks(keys).rowsBetween(*earlier)))
    local = rows.withColumn("_l", F.max("_v").over(_within(keys, order, chunk).rowsBetween(*earlier)))
    return _carried(local, keys, carry, ["_c"]).withColumn(name, F.greatest("_l", "_c")).drop("_l", "_c", "_v", _CHUNK)


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str, chunk: float | None) -> DataFrame:
    """Add ``name``: the place of each row in its key, from 1."""
    return running_sum(df, keys, order, F.lit(1), name, chunk)


def run_numbers(df: DataFrame, keys: list[str], order: list[str], columns: list[str], starts: Callable[[Column, Column], Column], name: str, chunk: float | None) -> DataFrame:
    """Add ``name``: how many runs have started up to and with each row.

    ``starts(before, now)`` says whether a row starts a run, from structs of ``columns``; ``before`` is null for a key's first row. In a chunk
    all but its first row know the row before them; the summary tells the first rows, and how many runs the chunks before have started."""
    now = F.struct(*columns)
    begin = lambda b, n: F.coalesce(starts(b, n), F.lit(False)).cast("long")
    if chunk is None:
        marked = df.withColumn("_s", begin(F.lag(now).over(_within(keys, order, None)), now))
        return marked.withColumn(name, F.sum("_s").over(_within(keys, order, None).rowsBetween(Window.unboundedPreceding, 0))).drop("_s")
    window = _within(keys, order, chunk)
    rows = _chunked(df, order, chunk).withColumn("_now", now).withColumn("_b", F.lag("_now").over(window))
    rows = rows.withColumn("_s", F.when(F.col("_b").isNotNull(), begin(F.col("_b"), F.col("_now"))).otherwise(0))
    place = F.struct(*order)
    ends = rows.groupBy(*keys, _CHUNK).agg(F.min_by("_now", place).alias("_first"), F.max_by("_now", place).alias("_last"), F.sum("_s").alias("_n"))
    met = ends.withColumn("_prev", F.lag("_last").over(_over_chunks(keys))).withColumn("_opens", begin(F.col("_prev"), F.col("_first")))
    upto = F.sum(F.col("_n") + F.col("_opens")).over(_over_chunks(keys).rowsBetween(Window.unboundedPreceding, -1))
    carry = met.withColumn("_c", F.coalesce(upto, F.lit(0)) + F.col("_opens"))
    local = rows.withColumn("_l", F.sum("_s").over(window.rowsBetween(Window.unboundedPreceding, 0)))
    return _carried(local, keys, carry, ["_c"]).withColumn(name, F.col("_l") + F.col("_c")).drop("_l", "_c", "_s", "_b", "_now", _CHUNK)


def last_known(df: DataFrame, keys: list[str], order: list[str], value: Column, chunk: float | None, before: str | None = None, after: str | None = None) -> DataFrame:
    """Add the last non-null ``value`` up to and with each row, the first from it on, or both, under the names given."""
    sides = [(n, back) for n, back in ((before, False), (after, True)) if n]
    frame = lambda back: _within(keys, order, chunk, back).rowsBetween(Window.unboundedPreceding, 0)
    if chunk is None:
        return df.withColumn("_v", value).withColumns({n: F.last("_v", ignorenulls=True).over(frame(back)) for n, back in sides}).drop("_v")
    rows = _chunked(df, order, chunk).withColumn("_v", value)
    held = F.when(F.col("_v").isNotNull(), F.struct(*order))
    known = rows.groupBy(*keys, _CHUNK).agg(F.max_by("_v", held).alias("_last"), F.min_by("_v", held).alias("_first"))
    carry = known.withColumns({f"_c{i}": F.last("_first" if back else "_last", ignorenulls=True).over(_over_chunks(keys, back).rowsBetween(Window.unboundedPreceding, -1)) for i, (_, back) in enumerate(sides)})
    local = rows.withColumns({f"_l{i}": F.last("_v", ignorenulls=True).over(frame(back)) for i, (_, back) in enumerate(sides)})
    met = _carried(local, keys, carry, [f"_c{i}" for i in range(len(sides))])
    named = met.withColumns({n: F.coalesce(f"_l{i}", f"_c{i}") for i, (n, _) in enumerate(sides)})
    return named.drop("_v", _CHUNK, *[f"_{x}{i}" for x in "lc" for i in range(len(sides))])


def framed(df: DataFrame, keys: list[str], order: list[str], before: int, after: int, columns: Callable, chunk: float | None, block: int | None = None) -> DataFrame:
    """Add columns over frames of rows from ``before`` places back to ``after`` places on; ``columns`` is a function of the window.

    A key's rows are dealt in blocks by their place. Rows near a block's edge also go to the block beside it, so every frame is whole there; those
    guests are dropped again."""
    if chunk is None:
        return df.withColumns(columns(_within(keys, order, None)))
    size = block or BLOCK_ROWS
    placed = numbered(df, keys, order, "_at", chunk).withColumn("_own", F.floor((F.col("_at") - 1) / size))
    inside = (F.col("_at") - 1) % size
    near = F.array(F.col("_own"), F.when(inside >= size - before, F.col("_own") + 1), F.when(inside < after, F.col("_own") - 1))
    guests = placed.withColumn("_block", F.explode(F.filter(near, lambda b: b.isNotNull())))
    window = Window.partitionBy(*keys, "_block").orderBy(*order)
    return guests.withColumns(columns(window)).where("_block = _own").drop("_at", "_own", "_block")
