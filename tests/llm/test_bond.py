"""The vertical scan against all rows."""

import math

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.llm import bond, queries


def brute(rows, asks, positives=5, negatives=5):
    """Rows (id, label, vector) against all others, in plain Python; ids are unique."""
    fine = [
        (i, label, [math.floor(256 * float(x)) for x in v])
        for i, label, v in rows
        if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for a, label, x in (r for r in fine if asks(r[0])):
        scored = [(sum(p * q for p, q in zip(x, y, strict=True)), i, other == label) for i, other, y in fine if i != a and len(y) == len(x)]
        best = sorted(((-s, i) for s, i, same in scored if same))[:positives]
        for s, p in best:
            inside = sorted((-t, i) for t, i, same in scored if not same and 80 * -s <= 100 * t <= 100 * -s)[:negatives]
            out += [(a, p, k + 1, i, -s, -t) for k, (t, i) in enumerate(inside)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").selectExpr("*", "0 as id", "'x' as part", "1 as dim")


def found(df):
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


def clustered(n, dim, labels, seed):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(labels, dim)) * 0.1 + 0.15
    label = rng.integers(0, labels, n)
    label[: n // 3] = 0
    x = (middle[label] + rng.normal(size=(n, dim)) * 0.1).astype(np.float32)
    x[5::50] = x[5]
    return [(i, int(label[i]), x[i].tolist()) for i in range(n)]


@pytest.mark.parametrize("cells", [1 << 19, 16 * 40])
def test_equals_all_rows(spark, monkeypatch, cells):
    monkeypatch.setattr(bond, "CELLS", cells)
    monkeypatch.setattr(bond, "CHUNK", 7)
    rows = clustered(900, 16, 6, 3)
    assert found(bond.hard_negatives(frame(spark, rows), F.col("id") % 20 == 0)) == brute(rows, lambda i: i % 20 == 0)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, 1, [1.0, 2.0]), (1, 1, [1.0, 1.9]), (2, 1, None), (3, 1, [1.0, None]), (4, 1, [nan, 1.0]), (5, 2, [inf, 1.0]), (6, None, [1.0, 2.0]), (None, 2, [1.0, 2.0]),
        (8, 2, [1.0, 1.8]), (9, 2, [1.0, 1.8]), (10, 2, []), (11, 2, [1.0, 2.0, 3.0]), (12, 2, [0.0, 0.0]), (13, 3, [-1.0, -2.0]), (20, 7, [1.0, 1.0]), (30, 3, [-1.0, -1.0]), (40, 1, [1.0, 2.0, 3.0]),
    ]
    got = found(bond.hard_negatives(frame(spark, rows), F.col("id") % 10 == 0))
    assert got == brute(rows, lambda i: i % 10 == 0) and got
    empty = bond.hard_negatives(frame(spark, rows).limit(0), F.col("id") % 10 == 0)
    assert empty.count() == 0 and empty.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_repeated_rows_count_as_often_as_they_are_there(spark):
    rows = [(0, 1, [1.0, 1.0]), (0, 1, [1.0, 1.0]), (1, 1, [1.0, 1.0]), (1, 1, [1.0, 1.0]), (2, 2, [1.0, 0.9])]
    got = found(bond.hard_negatives(frame(spark, rows), F.col("id") == 0))
    assert got == [(0, 1, 1, 2, 131072, 124416)] * 4


def test_bitmaps_shrink_before_all_dimensions_are_read():
    rng = np.random.default_rng(1)
    x = (rng.normal(size=(4000, 64)) * np.geomspace(40, 0.5, 64)).round()
    stored = bond._stored(0, pd.DataFrame({"id": np.arange(4000), "label": 0, "x": x.tolist()}), 64)
    block, sizes = bond.Block(stored), []
    watch = bond.best_of_label(5)

    def undecided(least, greatest):
        keep = watch(least, greatest)
        sizes.append(int(keep.sum()))
        return keep

    at, scores = bond.vertical(x[7], block, np.ones(4000, bool), undecided)
    want = np.sort(x @ x[7])[::-1][:5]
    assert np.sort(scores)[::-1][:5].tolist() == want.tolist()
    assert sizes[0] == 4000 and sizes[len(sizes) // 2] < 400


def test_query_equals_its_sql(spark, sf_dir):
    embeddings = duckdb.connect()
    embeddings.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = sorted(tuple(r) for r in embeddings.execute(f"SELECT {', '.join(names)} FROM ({queries.NEGATIVES_SQL})").fetchall())
    assert found(queries.op13_bond_negatives(spark, sf_dir)) == want and want
