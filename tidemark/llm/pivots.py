"""Exact top-k inner products by pivot-table elimination.

Many pivots are chosen far apart on a bounded sample. For a query q and a candidate x, the greatest |d(q,p) - d(x,p)| over
the pivots p bounds their distance from below, so (|q|^2 + |x|^2 - bound^2) / 2 bounds their inner product from above.
Rows lie in blocks by nearest pivot. A first pass searches each query's own block and so finds the score it must beat. The
pivot table of a block is kept as the least and greatest distance to each pivot, that of a chunk of queries likewise; these
small tables alone decide which chunk must be sent to which block, and vectors are shipped to those that are left. There
candidates are evaluated in order of their bounds until the next bound is below the k-th best score: what wasn't evaluated
can't be in the result.

Defined cases: null vectors, empty ones, null ids, and vectors with null or non-finite components take no part; vectors only
meet vectors of their own length; equal scores go to the smaller id; repeated rows are rows of their own, as candidates and as
queries (a query's list then holds pairs of all rows with its id); a query's own id is never its neighbour. Scores are exact
up to 2^53; further columns are left alone.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import discard, durable

#: Vectors that pivots are chosen from, pivots of a vector length, rows of a block, queries of a chunk.
SAMPLE, PIVOTS, BLOCK, CHUNK = 4096, 64, 2048, 512
#: Pivots that order one query's candidates: those that are nearest to it and farthest from it.
ORDERING = 16
#: Parts of chunks, and blocks, whose tables one task holds against each other.
PARTS_MATCHED, BLOCKS_MATCHED = 1024, 4096
SLACK = 1e-6


def integers(vector: Column) -> Column:
    """floor(256 * x) of every component as a double; null where a component is null or non-finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when(fine & (F.size(vector) > 0), F.transform(vector, lambda x: F.floor(x.cast("double") * 256).cast("double")))


def choose_pivots(sample: dict[int, np.ndarray], pivots: int = PIVOTS) -> dict[int, np.ndarray]:
    """For each vector length, points far from each other, each the farthest from those before it; neighbours in order where they can be."""
    out = {}
    for dim, points in sample.items():
        picked = [points[0]]
        apart = ((points - points[0]) ** 2).sum(axis=1)
        while len(picked) < min(pivots, len(points)) and apart.max() > 0:
            picked.append(points[int(apart.argmax())])
            apart = np.minimum(apart, ((points - picked[-1]) ** 2).sum(axis=1))
        out[dim] = _chained(np.array(picked))
    return out


def _chained(points: np.ndarray) -> np.ndarray:
    """Each point followed by the nearest of those left, so that cells with near numbers are near."""
    left, at, order = list(range(1, len(points))), 0, [0]
    while left:
        at = min(left, key=lambda i: ((points[i] - points[at]) ** 2).sum())
        left.remove(at)
        order.append(at)
    return points[order]


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (x**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1) - 2 * x @ pivots.T))


def _bytes(x: np.ndarray) -> list[bytes]:
    """Rows of whole numbers, in two bytes a component where they fit."""
    return [v.astype(np.int16).tobytes() if np.abs(v).max() < 32768 else v.tobytes() for v in x]


def _matrix(rows, dim: int) -> np.ndarray:
    raw = list(rows)
    if {len(v) for v in raw} == {2 * dim}:
        return np.frombuffer(b"".join(raw), np.int16).reshape(-1, dim).astype(np.float64)
    return np.array([np.frombuffer(v, np.int16 if len(v) == 2 * dim else np.float64) for v in raw], np.float64).reshape(-1, dim)


def _upper(bound: np.ndarray) -> np.ndarray:
    """A bound with room for rounding."""
    return bound + SLACK * np.abs(bound) + 1


def search_block(q_ids, q, q_dist, floors, ids, x, x_dist, k: int):
    """(query id, candidate id, score) of each query's k best in a block, none below its floor, in bound order."""
    out = []
    q_norm, x_norm = (q**2).sum(axis=1), (x**2).sum(axis=1)
    lo, hi = x_dist.min(axis=0), x_dist.max(axis=0)
    away = np.maximum(0.0, np.maximum(lo - q_dist, q_dist - hi).max(axis=1))
    enter = np.flatnonzero(_upper((q_norm + x_norm.max() - away**2) / 2) >= floors)
    half = min(ORDERING, x_dist.shape[1]) // 2
    for row in enter:
        by_distance = np.argsort(q_dist[row], kind="stable")
        told = np.concatenate([by_distance[: half + 1], by_distance[len(by_distance) - half :]])
        apart = np.abs(x_dist[:, told] - q_dist[row, told]).max(axis=1)
        upper = _upper((q_norm[row] + x_norm - apart**2) / 2)
        order = np.argsort(-upper, kind="stable")
        order = order[(upper[order] >= floors[row]) & (ids[order] != q_ids[row])]
        best_id, best = np.empty(0, np.int64), np.empty(0)
        for at in range(0, len(order), 256):
            part = order[at : at + 256]
            if len(best) >= k and upper[part[0]] < best[k - 1]:
                break
            best_id, best = np.concatenate([best_id, ids[part]]), np.concatenate([best, x[part] @ q[row]])
            top = np.lexsort((best_id, -best))[:k]
            best_id, best = best_id[top], best[top]
        keep = best >= floors[row]
        out.append((np.full(int(keep.sum()), q_ids[row]), best_id[keep], best[keep]))
    return [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]


def deal_cells(counts: dict[tuple[int, int], int], size: int) -> list[tuple[int, int, int, int]]:
    """(dim, cell, first block, parts): large cells are split in parts of about ``size`` rows, small neighbours share a block."""
    out, block, held, last = [], -1, 0, None
    for (dim, cell), n in sorted(counts.items()):
        parts = -(-n // size)
        if dim == last and held and held + n <= size:
            held += n
            out.append((dim, cell, block, 1))
        else:
            out.append((dim, cell, block + 1, parts))
            block += parts
            held = n if parts == 1 else 0
        last = dim
    return out


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query, by score and then the smaller id; every task cuts its own before they are shuffled."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.select("query_id", "vec_id", "score").withColumn("rank", rank).where(F.col("rank") <= k)


def _table(dist: np.ndarray) -> bytes:
    return np.concatenate([dist.min(axis=0), dist.max(axis=0)]).tobytes()


def surviving(chunks: pd.DataFrame, blocks: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of a part of a chunk and a block whose tables allow a score of the part's lowest floor."""
    c, b = (np.array([np.frombuffer(t, np.float64) for t in f["bounds"]]) for f in (chunks, blocks))
    n = c.shape[1] // 2
    floors, norms, longest = chunks["floor"].to_numpy(), chunks["norm"].to_numpy(), blocks["norm"].to_numpy()
    out = []
    for i in range(len(c)):
        away = np.maximum(0.0, np.maximum(b[:, :n] - c[i, n:], c[i, :n] - b[:, n:]).max(axis=1))
        out.append(np.flatnonzero(_upper((norms[i] + longest - away**2) / 2) >= floors[i]))
    return np.repeat(np.arange(len(c)), [len(x) for x in out]), np.concatenate(out)


def plan_pairs(chunks: DataFrame, blocks: DataFrame) -> DataFrame:
    """``chunk, block``: who must be searched by whom, from tables ``dim, norm, bounds`` (and ``floor``) that hold no vectors.

    A chunk has a table for each block its queries come from, so it may span several without blurring its bounds."""
    groups = [max(1, -(-df.count() // size)) for df, size in ((chunks, PARTS_MATCHED), (blocks, BLOCKS_MATCHED))]
    cs = chunks.withColumn("cg", F.pmod(F.xxhash64("chunk", "norm", "bounds"), F.lit(groups[0]))).withColumn("bg", F.explode(F.sequence(F.lit(0), F.lit(groups[1] - 1))))
    bs = blocks.withColumn("bg", F.pmod(F.xxhash64("block"), F.lit(groups[1])).cast("int")).withColumn("cg", F.explode(F.sequence(F.lit(0), F.lit(groups[0] - 1))))

    def match(c: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(c) or not len(b):
            return pd.DataFrame({"chunk": [], "block": []}, dtype="int64")
        i, j = surviving(c, b)
        return pd.DataFrame({"chunk": c["chunk"].to_numpy()[i], "block": b["block"].to_numpy()[j]})

    keyed = cs.withColumn("cg", F.col("cg").cast("int")).groupBy("dim", "cg", "bg")
    return keyed.cogroup(bs.groupBy("dim", "cg", "bg")).applyInPandas(match, "chunk long, block long").distinct()


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE, pivots: int = PIVOTS) -> DataFrame:
    """``query_id, rank, vec_id, score`` for every row for which ``is_query`` (a column over ``id``) holds."""
    spark = vectors.sparkSession
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), integers(vectors[vector_col]).alias("x")).where("id is not null and x is not null")
    rows = rows.select("id", "x", F.size("x").alias("dim"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    n = rows.count()
    scale = 1 << 30
    drawn = rows.where(F.pmod(F.xxhash64("id"), F.lit(scale)) <= int(min(1.0, sample / max(1, n)) * scale)).select("dim", "x").limit(4 * sample).toPandas()
    points = choose_pivots({int(dim): np.array(g["x"].tolist()) for dim, g in drawn.groupby("dim")}, pivots)
    sent = spark.sparkContext.broadcast(points)

    def pivots_of(dim: int) -> np.ndarray:
        return sent.value.get(dim, np.zeros((1, dim)))

    def locate(frames):
        for frame in frames:
            for dim, g in frame.groupby("dim"):
                x = np.array(g["x"].tolist(), np.float64)
                cell = distances(x, pivots_of(int(dim))).argmin(axis=1).astype(np.int32)
                yield pd.DataFrame({"id": g["id"], "dim": g["dim"], "asks": g["asks"], "cell": cell, "v": _bytes(x)})

    located = durable(rows.mapInPandas(locate, "id long, dim int, asks boolean, cell int, v binary"))
    # At most ``pivots`` rows for each vector length.
    counts = {(r["dim"], r["cell"]): r["count"] for r in located.groupBy("dim", "cell").count().collect()}
    dealt = deal_cells(counts, BLOCK)
    cells = spark.createDataFrame(dealt, "dim int, cell int, first long, parts long")
    at = F.col("first") + F.pmod(F.xxhash64("id", "v"), F.col("parts"))
    blocked = durable(located.join(F.broadcast(cells), ["dim", "cell"]).select("id", "dim", "asks", "v", at.alias("block")))
    discard(located)

    def own(frame: pd.DataFrame) -> pd.DataFrame:
        """A block's table, and what its own queries find in it."""
        dim = int(frame["dim"].iloc[0])
        x, ids, asks = _matrix(frame["v"], dim), frame["id"].to_numpy(), frame["asks"].to_numpy(bool)
        dist = distances(x, pivots_of(dim))
        a, b, s = search_block(ids[asks], x[asks], dist[asks], np.full(int(asks.sum()), -np.inf), ids, x, dist, k)
        head = pd.DataFrame({"block": [frame["block"].iloc[0]], "dim": [dim], "norm": [(x**2).sum(axis=1).max()], "bounds": [_table(dist)], "query_id": pd.array([None], "Int64"), "vec_id": pd.array([None], "Int64"), "score": pd.array([None], "Int64")})
        hits = pd.DataFrame({"block": frame["block"].iloc[0], "dim": dim, "norm": np.nan, "bounds": None, "query_id": pd.array(a, "Int64"), "vec_id": pd.array(b, "Int64"), "score": pd.array(s.astype(np.int64), "Int64")})
        return pd.concat([head, hits]) if len(hits) else head

    first = durable(blocked.groupBy("block").applyInPandas(own, "block long, dim int, norm double, bounds binary, query_id long, vec_id long, score long"))
    found = first.where("query_id is not null").select("query_id", "vec_id", "score")
    tables = first.where("query_id is null").select("block", "dim", "norm", "bounds")
    floors = _best(found, k).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").cast("double").alias("floor"))
    asking = blocked.where("asks").join(floors, "id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    # Queries of neighbouring blocks share a chunk; where many ask in few blocks, their chunk is split.
    blocks, queries = sum(p for *_, p in dealt), blocked.where("asks").count()
    together = max(1, CHUNK * blocks // max(1, queries))
    asking = asking.withColumn("near", F.floor(F.col("block") / together))
    sizes = asking.groupBy("dim", "near").agg(F.ceil(F.count("*") / CHUNK).alias("parts"))
    asking = durable(asking.join(sizes, ["dim", "near"]).withColumn("chunk", F.xxhash64("dim", "near", F.pmod(F.xxhash64("id", "v"), "parts"))).select("id", "dim", "v", "floor", "block", "chunk"))

    def described(frame: pd.DataFrame) -> pd.DataFrame:
        dim = int(frame["dim"].iloc[0])
        x = _matrix(frame["v"], dim)
        return pd.DataFrame({"chunk": [frame["chunk"].iloc[0]], "dim": [dim], "norm": [(x**2).sum(axis=1).max()], "floor": [frame["floor"].min()], "bounds": [_table(distances(x, pivots_of(dim)))]})

    chunks = durable(asking.groupBy("chunk", "block").applyInPandas(described, "chunk long, dim int, norm double, floor double, bounds binary"))
    pairs = durable(plan_pairs(chunks, tables))

    def search(key, q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        # A query has searched its own block already.
        q = q[q["block"] != key[1]]
        if not len(q) or not len(x):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        dim = int(q["dim"].iloc[0])
        qs, xs, p = _matrix(q["v"], dim), _matrix(x["v"], dim), pivots_of(dim)
        a, b, s = search_block(q["id"].to_numpy(), qs, distances(qs, p), q["floor"].to_numpy(), x["id"].to_numpy(), xs, distances(xs, p), k)
        return pd.DataFrame({"query_id": a, "vec_id": b, "score": s.astype(np.int64)})

    q_side = pairs.withColumnRenamed("block", "other").join(asking, "chunk").select("chunk", "other", "id", "dim", "v", "floor", "block")
    x_side = pairs.join(blocked.select("block", "id", "v"), "block").select(F.col("chunk").alias("by"), F.col("block").alias("at"), "id", "v")
    more = q_side.groupBy("chunk", "other").cogroup(x_side.groupBy("by", "at")).applyInPandas(search, "query_id long, vec_id long, score long")
    result = durable(_best(found.union(more), k).select("query_id", "rank", "vec_id", "score"))
    for done in (blocked, first, asking, chunks, pairs):
        discard(done)
    return result
