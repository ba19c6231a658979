"""Hard negatives by a vertical scan of columnar blocks.

Rows are kept in blocks, each stored one dimension after the other beside the least and greatest value of each dimension. An
anchor reads a block's dimensions in the descending order of its own components' size, some at a time: the sums so far, and the least
and greatest that the dimensions still unread can add, bound every score from both sides. A bitmap of candidates shrinks as bounds part them:
of the rows of the anchor's label those stay that may still be among its best; of the others those that may still be among the best
of a window below one of its positives. What stays when all dimensions are read has its exact score.

Blocks and chunks of anchors lie in order of label and salt, so few blocks hold an anchor's label, a label of any size is split, and small
labels share a block. Tables of labels and of least and greatest values alone decide which chunk is sent to which block.

Defined cases: null ids and labels, null and empty vectors, vectors with null or non-finite components take no part; vectors meet vectors of their own
length only; labels are whole numbers; equal scores go to the smaller id; a row is never its own positive, and rows that share an id are never
each other's; a row that is repeated counts as often as it is there, as candidate and as anchor. Anchors without positives, and positives with an empty window, give no rows.
Scores are exact up to 2^53. Further columns are left alone.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import discard, durable
from tidemark.llm.pivots import integers

#: Cells of a block and its most rows, anchors of a chunk, dimensions read between two looks at the bounds.
CELLS, BLOCK, CHUNK, STRIDE = 1 << 19, 8192, 1024, 8
#: Chunks, and blocks, whose tables one task holds against each other.
CHUNKS_MATCHED, BLOCKS_MATCHED = 1024, 4096

STORED = "part long, dim int, low long, high long, ids binary, labels binary, columns binary, least binary, greatest binary"


def _stored(number: int, frame: pd.DataFrame, dim: int) -> dict:
    """One block: its rows dimension by dimension, in two bytes a value where they fit."""
    columns = np.ascontiguousarray(np.array(frame["x"].tolist(), np.float64).T)
    small = np.abs(columns).max() < 32768
    labels = frame["label"].to_numpy(np.int64)
    return {
        "part": number, "dim": dim, "low": labels.min(), "high": labels.max(), "ids": frame["id"].to_numpy(np.int64).tobytes(), "labels": labels.tobytes(),
        "columns": (columns.astype(np.int16) if small else columns).tobytes(), "least": columns.min(axis=1).tobytes(), "greatest": columns.max(axis=1).tobytes(),
    }


def _blocks(rows: DataFrame, most: int, n: int) -> DataFrame:
    """Rows in order of length, label and salt, cut into blocks of at most ``most`` rows and CELLS values."""

    def cut(frames):
        held, number = None, TaskContext.get().partitionId() << 32
        for frame in frames:
            held = frame if held is None else pd.concat([held, frame], ignore_index=True)
            while len(held):
                dim = int(held["dim"].iloc[0])
                size = max(1, min(most, CELLS // dim))
                same = int((held["dim"] == dim).sum())
                if same == len(held) and same < size:
                    break
                yield pd.DataFrame([_stored(number, held.iloc[: min(size, same)], dim)])
                held, number = held.iloc[min(size, same) :], number + 1
        if held is not None and len(held):
            yield pd.DataFrame([_stored(number, held, int(held["dim"].iloc[0]))])

    tasks = max(1, min(-(-n // most), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    salted = rows.withColumn("salt", F.xxhash64("id", "x"))
    ordered = salted.repartitionByRange(tasks, "dim", "label", "salt").sortWithinPartitions("dim", "label", "salt")
    return ordered.select("dim", "label", "id", "x").mapInPandas(cut, STORED)


class Block:
    """A stored block, or the anchors of a chunk, as arrays."""

    def __init__(self, row):
        self.ids, self.labels = (np.frombuffer(row[c], np.int64) for c in ("ids", "labels"))
        n, dim = len(self.ids), int(row["dim"])
        raw = row["columns"]
        self.columns = np.frombuffer(raw, np.int16 if len(raw) == 2 * n * dim else np.float64).reshape(dim, n).astype(np.float64)
        self.least, self.greatest = np.frombuffer(row["least"]), np.frombuffer(row["greatest"])


def vertical(anchor: np.ndarray, block: Block, candidates: np.ndarray, undecided: Callable) -> tuple[np.ndarray, np.ndarray]:
    """Places and exact scores of the candidates (a bitmap) that ``undecided(least score, greatest score)`` never gave up."""
    order = np.argsort(-np.abs(anchor), kind="stable")
    ends = np.stack([anchor * block.least, anchor * block.greatest])[:, order]
    # What the dimensions from each place of the order on can still add.
    unread = [np.append(np.cumsum(e[::-1])[::-1], 0.0) for e in (ends.min(axis=0), ends.max(axis=0))]
    at = np.flatnonzero(candidates)
    sums = np.zeros(len(at))
    for read in range(0, len(order) + STRIDE, STRIDE):
        keep = undecided(sums + unread[0][min(read, len(order))], sums + unread[1][min(read, len(order))])
        if not keep.all():
            at, sums = at[keep], sums[keep]
        if read >= len(order) or not len(at):
            break
        dims = order[read : read + STRIDE]
        values = block.columns[dims] if len(at) == len(candidates) else block.columns[np.ix_(dims, at)]
        sums = sums + anchor[dims] @ values
    return at, sums


def _kth(scores: np.ndarray, k: int) -> float:
    return np.partition(scores, len(scores) - k)[len(scores) - k] if len(scores) >= k else -np.inf


def best_of_label(k: int) -> Callable:
    """Undecided: who may be among the k best."""
    return lambda least, greatest: greatest >= _kth(least, k)


def best_of_windows(windows: list[tuple[int, int]], k: int) -> Callable:
    """Undecided: who may be among the k best scores of one of these windows (least and greatest score, inclusive)."""

    def undecided(least, greatest):
        keep = np.zeros(len(least), bool)
        for low, high in windows:
            sure = least[(least >= low) & (greatest <= high)]
            keep |= (greatest >= max(low, _kth(sure, k))) & (least <= high)
        return keep

    return undecided


def _top(at: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids[at], -scores))[:k]


def positives_in(chunk: Block, block: Block, k: int) -> list[tuple[int, int, int]]:
    """(place of the anchor, id, score): each anchor's k best rows of its label in a block."""
    out = []
    for a in range(len(chunk.ids)):
        candidates = (block.labels == chunk.labels[a]) & (block.ids != chunk.ids[a])
        if candidates.any():
            at, scores = vertical(chunk.columns[:, a], block, candidates, best_of_label(k))
            top = _top(at, scores, block.ids, k)
            out += zip([a] * len(top), block.ids[at[top]].tolist(), scores[top].astype(np.int64).tolist(), strict=True)
    return out


def negatives_in(chunk: Block, block: Block, windows: dict[int, list[tuple[int, int]]], k: int) -> list[tuple[int, int, int]]:
    """(place of the anchor, id, score): rows of other labels in a block that are among the k best of a window of the anchor."""
    out = []
    for a, spans in windows.items():
        candidates = block.labels != chunk.labels[a]
        if candidates.any():
            at, scores = vertical(chunk.columns[:, a], block, candidates, best_of_windows(spans, k))
            told = np.zeros(len(at), bool)
            for low, high in spans:
                inside = np.flatnonzero((scores >= low) & (scores <= high))
                told[inside[_top(at[inside], scores[inside], block.ids, k)]] = True
            out += zip([a] * int(told.sum()), block.ids[at[told]].tolist(), scores[told].astype(np.int64).tolist(), strict=True)
    return out


def _ends(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.array([np.frombuffer(b) for b in frame[c]]) for c in ("least", "greatest"))


def may_hold_positives(chunks: pd.DataFrame, blocks: pd.DataFrame) -> np.ndarray:
    """Which chunk (row) may find a row of one of its labels in which block (column)."""
    return (chunks["low"].to_numpy()[:, None] <= blocks["high"].to_numpy()) & (blocks["low"].to_numpy() <= chunks["high"].to_numpy()[:, None])


def may_hold_negatives(chunks: pd.DataFrame, blocks: pd.DataFrame) -> np.ndarray:
    """Which chunk may find a row of another label with a score in its windows in which block, by least and greatest values."""
    (c0, c1), (b0, b1) = _ends(chunks), _ends(blocks)
    out = np.zeros((len(chunks), len(blocks)), bool)
    block_low, block_high = blocks["low"].to_numpy(), blocks["high"].to_numpy()
    for i, (low, high, floor, ceiling) in enumerate(zip(chunks["low"], chunks["high"], chunks["floor"], chunks["ceiling"], strict=True)):
        corners = np.stack([c0[i] * b0, c0[i] * b1, c1[i] * b0, c1[i] * b1])
        alike = (block_low == block_high) & (block_low == low) & (low == high)
        out[i] = (corners.max(axis=0).sum(axis=1) >= floor) & (corners.min(axis=0).sum(axis=1) <= ceiling) & ~alike
    return out


def _pairs(chunks: DataFrame, blocks: DataFrame, may: Callable) -> DataFrame:
    """``chunk, block``: who is sent where, told from tables that hold no vectors, in groups of bounded size."""
    groups = [max(1, -(-df.count() // size)) for df, size in ((chunks, CHUNKS_MATCHED), (blocks, BLOCKS_MATCHED))]
    cs = chunks.withColumn("cg", F.pmod(F.xxhash64("part"), F.lit(groups[0]))).withColumn("bg", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups[1] - 1).cast("long"))))
    bs = blocks.withColumn("bg", F.pmod(F.xxhash64("part"), F.lit(groups[1]))).withColumn("cg", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups[0] - 1).cast("long"))))

    def match(c: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(c) or not len(b):
            return pd.DataFrame({"chunk": [], "block": []}, dtype="int64")
        i, j = np.nonzero(may(c, b))
        return pd.DataFrame({"chunk": c["part"].to_numpy()[i], "block": b["part"].to_numpy()[j]})

    return durable(cs.groupBy("dim", "cg", "bg").cogroup(bs.groupBy("dim", "cg", "bg")).applyInPandas(match, "chunk long, block long"))


def _searched(pairs: DataFrame, chunks: DataFrame, blocks: DataFrame, search: Callable) -> DataFrame:
    """``anchor, id, score``: what ``search(row of a chunk, block)`` finds for each pair; an anchor is its chunk and its place there."""
    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = pairs.join(chunks.withColumnRenamed("part", "chunk"), "chunk").repartition(tasks, "chunk", "block")
    named = pairs.select(F.col("chunk").alias("by"), F.col("block").alias("at"))
    right = named.join(blocks.withColumnRenamed("part", "at"), "at").repartition(tasks, "by", "at")

    def found(key: tuple, c: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        hits = search(c.iloc[0], Block(b.iloc[0])) if len(c) and len(b) else []
        place, ids, scores = np.array(hits, np.int64).reshape(-1, 3).T
        return pd.DataFrame({"chunk": np.full(len(place), key[0], np.int64), "place": place, "id": ids, "score": scores})

    return left.groupBy("chunk", "block").cogroup(right.groupBy("by", "at")).applyInPandas(found, "chunk long, place long, id long, score long")


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100,
    id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Anchors are the rows for which ``is_anchor`` (a column over ``id``) holds. Of each its best ``positives`` rows of the same label, and for each of those
    the best ``negatives`` rows of other labels whose score is between ``low`` and ``high`` hundredths of the positive's."""
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[label_col].cast("long").alias("label"), integers(vectors[vector_col]).alias("x"))
    rows = rows.where("id is not null and label is not null and x is not null").withColumn("dim", F.size("x"))
    asking = rows.where(F.coalesce(is_anchor, F.lit(False)))
    blocks, chunks = durable(_blocks(rows, BLOCK, rows.count())), durable(_blocks(asking, CHUNK, asking.count()))
    heads = blocks.select("part", "dim", "low", "high", "least", "greatest")

    def same_label(c: pd.Series, block: Block) -> list:
        return positives_in(Block(c), block, positives)

    pairs = _pairs(chunks.select("part", "dim", "low", "high"), heads.drop("least", "greatest"), may_hold_positives)
    rank = F.row_number().over(Window.partitionBy("chunk", "place").orderBy(F.col("score").desc(), "id"))
    best = durable(_searched(pairs, chunks, blocks, same_label).withColumn("nth", rank).where(F.col("nth") <= positives))
    discard(pairs)

    # At most CHUNK * positives scores a chunk.
    spans = best.groupBy("chunk").agg(
        F.min(F.ceil(F.col("score") * low / 100) - 1).alias("floor"), F.max(F.floor(F.col("score") * high / 100) + 1).alias("ceiling"), F.collect_set(F.struct("place", "score")).alias("spans")
    )
    asked = durable(chunks.join(spans.withColumnRenamed("chunk", "part"), "part"))

    def other_labels(c: pd.Series, block: Block) -> list:
        windows: dict[int, list[tuple[int, int]]] = {}
        for s in c["spans"]:
            windows.setdefault(int(s["place"]), []).append((-(-int(s["score"]) * low // 100), int(s["score"]) * high // 100))
        return negatives_in(Block(c), block, windows, negatives)

    pairs = _pairs(asked.select("part", "dim", "low", "high", "least", "greatest", "floor", "ceiling"), heads, may_hold_negatives)
    found = durable(_searched(pairs, asked, blocks, other_labels))

    names = durable(chunks.select("part", "ids").mapInPandas(_anchor_ids, "chunk long, place long, anchor_id long"))
    told = best.join(names, ["chunk", "place"]).select("chunk", "place", "nth", "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    hits = found.select("chunk", "place", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    within = (F.col("positive_score") * low <= F.col("negative_score") * 100) & (F.col("negative_score") * 100 <= F.col("positive_score") * high)
    rank = F.row_number().over(Window.partitionBy("chunk", "place", "nth").orderBy(F.col("negative_score").desc(), "negative_id"))
    result = told.join(hits, ["chunk", "place"]).where(within).withColumn("rank", rank).where(F.col("rank") <= negatives)
    result = durable(result.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
    for done in (pairs, blocks, chunks, asked, best, found, names):
        discard(done)
    return result


def _anchor_ids(frames):
    for frame in frames:
        for part, raw in zip(frame["part"], frame["ids"], strict=True):
            ids = np.frombuffer(raw, np.int64)
            yield pd.DataFrame({"chunk": part, "place": np.arange(len(ids)), "anchor_id": ids})
