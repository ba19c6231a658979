"""SimHash near-dedup over a vantage-point tree of fingerprints.

Fingerprints are collapsed to distinct values first. A tree of vantage points, grown on a bounded sample, cuts the
Hamming space in shards: at a node, those within ``mu`` of the vantage point go inside and the others outside, and by
the triangle inequality a linked pair can only be split if the inner one is within ``radius`` of the border, so just
those are sent to both sides. Every linked pair so meets in a shard, where it is compared exactly; a shard that came
out large is cut again by a tree of its own before pairs are compared. A crowd that no vantage point cuts (pages of one
template, all within a few bits) isn't put in one task: its fingerprints are linked through the neighbours they share.

Defined cases: a null text counts as empty; a text without words has fingerprint 0 and links like any other; rows with
a null id take part, but don't give a component its id; repeated rows share their fingerprint and component.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import durable
from tidemark.llm.components import connected_components, joined

SEED = 42
#: Fingerprints on which the tree is grown: one of so many, within these bounds; every fingerprint is indexed.
SAMPLED, LEAST_SAMPLE, MOST_SAMPLE = 4096, 1 << 16, 1 << 20
#: A shard is cut while it is expected to hold more distinct fingerprints than this.
SHARD = 2048
#: A leaf that no vantage point cuts is a crowd if it is expected to hold more distinct fingerprints than this.
CROWD = 1 << 14
#: Candidate vantage points tried at a node.
TRIED = 8

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """64-bit SimHash of the shingles of a text in UTF-8, as an unsigned integer."""
    words = text.lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(b" ".join(words), SEED)
    runs = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
    hashes = np.fromiter((digest(r, SEED) for r in runs), np.uint64, len(words) - shingle + 1)
    lanes = hashes.view(np.uint8).reshape(-1, 8) + np.arange(0, 2048, 256)
    ones = np.einsum("kv,vb->kb", np.bincount(lanes.ravel(), minlength=2048).reshape(8, 256), _BITS).ravel()
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``id, fp`` (the 64 bits as a signed long) for every row."""

    def run(batches):
        for batch in batches:
            fps = [fingerprint(t or b"", shingle) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], names=["id", "fp"])

    picked = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    schema = T.StructType([T.StructField("id", picked.schema["id"].dataType), T.StructField("fp", T.LongType())])
    return picked.mapInArrow(run, schema).withColumnRenamed("id", id_col)


class VantageTree:
    """Nodes as arrays: vantage point, border distance, inside and outside child (-1 - shard at a leaf).

    ``crowds`` are the shards that hold more than ``crowd`` points of the sample."""

    def __init__(self, sample: np.ndarray, radius: int, leaf: int, crowd: float = float("inf")):
        self.radius, self.shards, self.crowd = radius, 0, crowd
        self.crowds: set[int] = set()
        self.nodes: list[list[int]] = []
        self.root = self._grow(sample, leaf, np.random.default_rng(len(sample)))

    def _grow(self, points: np.ndarray, leaf: int, rng: np.random.Generator) -> int:
        found = self._cut(points, rng) if len(points) > leaf else None
        if found is None:
            if len(points) > self.crowd:
                self.crowds.add(self.shards)
            self.shards += 1
            return -self.shards
        vantage, mu, d = found
        at = len(self.nodes)
        self.nodes.append([vantage, mu, 0, 0])
        self.nodes[at][2] = self._grow(points[d <= mu], leaf, rng)
        self.nodes[at][3] = self._grow(points[d > mu - self.radius], leaf, rng)
        return at

    def _cut(self, points: np.ndarray, rng: np.random.Generator):
        """The vantage point and border with the least pairs to compare below; None if no cut is worth it."""
        best, least = None, 0.85 * len(points) ** 2
        for vantage in rng.choice(points, TRIED):
            d = np.bitwise_count(points ^ vantage).astype(np.int64)
            upto = np.cumsum(np.bincount(d, minlength=66 + self.radius))
            mu = np.arange(64)
            inside, outside = upto[mu], len(points) - np.where(mu >= self.radius, upto[mu - self.radius], 0)
            work = inside.astype(float) ** 2 + outside.astype(float) ** 2
            k = int(work.argmin())
            if work[k] < least:
                best, least = (vantage, k, d), work[k]
        return best

    def place(self, points: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """(shard, positions of the points in it) for every shard that is reached."""
        out, todo = [], [(self.root, np.arange(len(points)))]
        while todo:
            at, rows = todo.pop()
            if not len(rows):
                continue
            if at < 0:
                out.append((-1 - at, rows))
                continue
            vantage, mu, inside, outside = self.nodes[at]
            d = np.bitwise_count(points[rows] ^ vantage).astype(np.int64)
            todo += [(inside, rows[d <= mu]), (outside, rows[d > mu - self.radius])]
        return out


def _close_pairs(points: np.ndarray, radius: int, rows: int = 256, columns: int = 8192):
    """All pairs within the radius, a block at a time: by the triangle inequality only points whose distances to a vantage point differ by no more are compared."""
    d = np.bitwise_count(points ^ points[0]).astype(np.int64)
    order = np.argsort(d, kind="stable")
    ranked = d[order]
    for at in range(0, len(points), rows):
        own = order[at : at + rows]
        end = int(np.searchsorted(ranked, ranked[at + len(own) - 1] + radius, "right"))
        for low in range(at, end, columns):
            others = order[low : min(end, low + columns)]
            i, j = np.nonzero(np.bitwise_count(points[own, None] ^ points[others][None, :]) <= radius)
            yield own[i], others[j]


def shard_links(points: np.ndarray, radius: int, leaf: int = 512) -> np.ndarray:
    """Links that join the points of a shard exactly as all its close pairs do: each point with its local root."""
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for _, rows in VantageTree(points, radius, leaf).place(points) if len(points) else []:
        for i, j in _close_pairs(points[rows], radius):
            # A block hands on a forest of its links, not all its pairs.
            root = joined(len(rows), i, j)
            moved = np.flatnonzero(root != np.arange(len(rows)))
            a.append(rows[moved])
            b.append(rows[root[moved]])
    return joined(len(points), np.concatenate(a), np.concatenate(b))


def _as_long(points: np.ndarray) -> np.ndarray:
    return points.astype(np.uint64).view(np.int64)


def crowd_links(fps: DataFrame, radius: int) -> DataFrame:
    """``a, b``: links between distinct fingerprints (column ``fp``) with the components of all pairs within ``radius``, without comparing pairs.

    Two fingerprints are within an even radius just if some 64 bits are within half of it from both. So each is written under all
    64 bits that near (65 for radius 2), and those under one key link to the smallest: rows grow with the fingerprints, and
    a key has no more of them than it has neighbours. For an odd radius, rounded up, the pairs under a key are checked."""
    reach = (radius + 1) // 2
    masks = [sum(1 << b for b in bits) for k in range(reach + 1) for bits in combinations(range(64), k)]
    signed = F.array(*[F.lit(int(m)).cast("long") for m in np.array(masks, np.uint64).view(np.int64)])
    near = fps.select("fp", F.explode(F.transform(signed, lambda m: F.col("fp").bitwiseXOR(m))).alias("near"))
    under = near.groupBy("near").agg(F.collect_list("fp").alias("of")).where(F.size("of") > 1)
    if radius % 2 == 0:
        return under.withColumn("b", F.array_min("of")).select(F.explode("of").alias("a"), "b").where("a <> b")
    pairs = under.select(F.explode("of").alias("a"), "of").select("a", F.explode("of").alias("b"))
    return pairs.where((F.col("a") > F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius))


def link_fingerprints(fps: DataFrame, radius: int = 2, sample: int | None = None, shard: int = SHARD) -> DataFrame:
    """``a, b``: links between distinct fingerprints (column ``fp``) with the components of all pairs within ``radius``.

    The tree is broadcast; its leaves hold 16 fingerprints of the sample or more, so it has fewer nodes than the sample, which is
    bounded. Up to 100 million fingerprints a shard is expected to hold ``shard`` of them; beyond 10^9 shards grow slowly, 16
    thousand at 10^9, 130 kilobytes. Inside a shard a tree of its own cuts on, so comparisons stay local. That holds where vantage
    points cut; what they don't cut and is expected over CROWD goes by crowd_links, each fingerprint once."""
    spark = fps.sparkSession
    n = fps.count()
    scale = 1 << 30
    sample = min(MOST_SAMPLE, max(LEAST_SAMPLE, n // SAMPLED)) if sample is None else sample
    share = min(1.0, sample / max(1, n))
    drawn = fps.where(F.pmod(F.xxhash64("fp"), F.lit(scale)) < int(share * scale) + 1).toPandas()["fp"].to_numpy(np.int64)
    tree = VantageTree(np.sort(drawn).view(np.uint64), radius, max(16, int(shard * share)), max(16, CROWD * share))
    sent = spark.sparkContext.broadcast(tree)

    def place(frames):
        for frame in frames:
            points = frame["fp"].to_numpy(np.int64).view(np.uint64)
            found = [(s, rows) for s, rows in sent.value.place(points) if s not in sent.value.crowds]
            if found:
                yield pd.DataFrame({"shard": np.concatenate([np.full(len(r), s) for s, r in found]), "fp": _as_long(np.concatenate([points[r] for _, r in found]))})

    def crowded(frames):
        for frame in frames:
            points = frame["fp"].to_numpy(np.int64).view(np.uint64)
            found = [rows for s, rows in sent.value.place(points) if s in sent.value.crowds]
            if found:
                yield pd.DataFrame({"fp": _as_long(points[np.unique(np.concatenate(found))])})

    def link(frame: pd.DataFrame) -> pd.DataFrame:
        points = frame["fp"].to_numpy(np.int64).view(np.uint64)
        root = shard_links(points, radius)
        moved = root != np.arange(len(points))
        return pd.DataFrame({"a": _as_long(points[moved]), "b": _as_long(points[root[moved]])})

    linked = fps.mapInPandas(place, "shard long, fp long").groupBy("shard").applyInPandas(link, "a long, b long")
    return linked.union(crowd_links(fps.mapInPandas(crowded, "fp long"), radius)) if tree.crowds else linked


def near_duplicates(docs: DataFrame, radius: int = 2, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, fingerprint`` (16 hex digits) and ``component_id`` (the smallest id that links reach) for every row."""
    prints = durable(fingerprints(docs, id_col, text_col, shingle))
    classes = durable(prints.groupBy("fp").agg(F.min(id_col).alias("first_id")))
    roots = connected_components(link_fingerprints(classes.select("fp"), radius), "a", "b")
    named = classes.join(roots, classes.fp == roots.node, "left").select(classes.fp, "first_id", F.coalesce("root", classes.fp).alias("root"))
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_print = durable(named.join(least, "root").select(F.col("fp").alias("_fp"), "component_id"))
    return prints.join(of_print, prints.fp == of_print["_fp"]).select(prints[id_col], F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
