"""Connected components: by alternating stars for a table of links, by smallest labels for the few links of one task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import discard, durable

#: Each round shortens every path to the smallest node by about half; so many rounds reach any length that fits a cluster.
MOST_ROUNDS = 40


def joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest place that links between places under ``n`` reach from each."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = np.minimum(root, root[root])
        if (root == before).all():
            break
    return root


def _star(links: DataFrame, large: bool) -> tuple[DataFrame, DataFrame]:
    """Hang neighbours on the smallest node around: the larger neighbours (large), or the node and its smaller ones. Also the table it reads."""
    if large:
        links = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    lowest = durable(links.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m")))
    met = links.join(lowest, links.u == lowest.n)
    if large:
        return met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")), lowest
    hung = met.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.union(lowest.select(F.col("n").alias("u"), F.col("m").alias("v"))), lowest


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``node, root`` for every node with a link to another: root is the smallest node that links reach.

    Links may come in either direction and more than once; a node linked only to itself is left out."""
    now = durable(links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    was = None
    for _ in range(MOST_ROUNDS):
        large, read = _star(now, large=True)
        small, read_too = _star(large.where("u <> v"), large=False)
        after = durable(small.where("u <> v").distinct())
        mark = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        for done in (now, read, read_too):
            discard(done)
        now = after
        if mark == was:
            break
        was = mark
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
