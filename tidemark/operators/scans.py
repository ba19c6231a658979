"""What depends on all that came before, over keys that no task holds whole.

A key's timeline is cut in chunks of time. Each chunk is summed up, by itself, as a function from the state before it to the state after it; functions
are composed in a tree, ``FAN`` at a time, and a second pass down the tree tells every chunk the state that it starts with. Then each chunk
is worked out by itself again. What a state and a function are is the caller's: bytes, and how two of them are composed.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.folds import per_group
from tidemark.operators.tables import stored

#: Functions that one task composes in a row; rows of a key that one task may hold, however long the time they span.
FAN, HELD = 64, 4096


def _met(left: DataFrame, right: DataFrame, names: list[str], how: str) -> DataFrame:
    """Join on columns of equal names; nulls are equal."""
    renamed = right.select(*[F.col(n).alias(f"_on{i}") for i, n in enumerate(names)], *[c for c in right.columns if c not in names])
    on = [F.col(n).eqNullSafe(F.col(f"_on{i}")) for i, n in enumerate(names)]
    return left.join(renamed, on, how).drop(*[f"_on{i}" for i in range(len(names))])


def long_keys(rows: DataFrame, keys: list[str], chunk: Column) -> DataFrame:
    """``keys, _chunk, _at, _left`` of every chunk of the keys that have more than one and more rows than HELD: its place from the start and from the end."""
    each = rows.select(*keys, chunk.alias("_chunk")).groupBy(*keys, "_chunk").agg(F.count("*").alias("_rows"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("_chunk"))
    back = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("_chunk").desc()))
    whole = F.sum("_rows").over(Window.partitionBy(*keys))
    placed = each.select(*keys, "_chunk", (place - 1).cast("long").alias("_at"), (back - 1).cast("long").alias("_left"), whole.alias("_whole"))
    return placed.where(f"_at + _left > 0 and _whole > {HELD}").drop("_whole")


def rows_of(rows: DataFrame, keys: list[str], chunks: DataFrame, long: bool) -> DataFrame:
    """The rows of the long keys, or of all others."""
    return _met(rows, chunks.where("_at = 0").select(*keys), keys, "left_semi" if long else "left_anti")


def with_states(rows: DataFrame, keys: list[str], chunk: Column, chunks: DataFrame, carried: list[str]) -> DataFrame:
    """The rows with ``_chunk``, and one more at each chunk's head that holds its place and what is carried to it; ``_head`` tells them apart.

    So a state of some kilobytes goes to a chunk once and not to each of its rows."""
    own = ["_at", "_left", *carried]
    plain = rows.withColumn("_chunk", chunk).withColumn("_head", F.lit(False))
    plain = plain.withColumns({c: F.lit(None).cast(chunks.schema[c].dataType) for c in own})
    heads = chunks.withColumn("_head", F.lit(True))
    return plain.unionByName(heads.select(*keys, "_chunk", "_head", *own), allowMissingColumns=True)


def scan(chunks: DataFrame, keys: list[str], at: str, compose: Callable[[bytes, bytes], bytes], fan: int = FAN) -> DataFrame:
    """``keys, at, state``: what the functions (column ``payload``) of all chunks before a place make of the start; null for the first.

    ``compose(f, g)`` is f followed by g. The first chunk's function is a state: it knows where it starts."""
    binary = ("state", T.BinaryType())
    n, top = chunks.agg(F.count("*"), F.max(at)).first()
    tasks = max(1, -(-n // fan))

    def carried(places, payloads, befores):
        state, out = next((bytes(b) for b in befores if b is not None), None), []
        for p in payloads:
            out.append(state)
            state = None if p is None else bytes(p) if state is None else compose(state, bytes(p))
        return [places, np.array(out, object)]

    if n == 0 or top < fan:
        alone = chunks.select(*keys, at, "payload", F.lit(None).cast("binary").alias("before"))
        return per_group(alone, keys, [at], [at, "payload", "before"], carried, [(at, T.LongType()), binary], tasks)

    def composed(payloads):
        if any(p is None for p in payloads):
            return [np.array([None], object)]
        whole = bytes(payloads[0])
        for p in payloads[1:]:
            whole = compose(whole, bytes(p))
        return [np.array([whole], object)]

    dealt = chunks.withColumn("_up", F.floor(F.col(at) / fan))
    up = stored(per_group(dealt.select(*keys, "_up", at, "payload"), [*keys, "_up"], [at], ["payload"], composed, [("payload", T.BinaryType())], tasks))
    outer = scan(up.withColumnRenamed("_up", at), keys, at, compose, fan).select(*keys, F.col(at).alias("_up"), F.col("state").alias("before"))
    # The state goes to the first chunk of its group alone.
    first = dealt.where(F.col(at) % fan == 0).select(*keys, "_up", at)
    heads = _met(first, outer, [*keys, "_up"], "left").withColumn("payload", F.lit(None).cast("binary")).withColumn("_head", F.lit(0))
    both = dealt.select(*keys, "_up", at, "payload", F.lit(None).cast("binary").alias("before"), F.lit(1).alias("_head")).unionByName(heads)

    def placed(places, payloads, befores, head):
        real = head == 1
        before = next((bytes(b) for b in befores if b is not None), None)
        return carried(places[real], payloads[real], [before])

    return per_group(both, [*keys, "_up"], ["_head", at], [at, "payload", "before", "_head"], placed, [(at, T.LongType()), binary], tasks).select(*keys, at, "state")
