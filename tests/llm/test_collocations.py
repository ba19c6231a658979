"""SON mining against counting everything."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from tidemark.llm import collocations, queries


def brute(rows, support, most=2000):
    """Rows (lang, text), in plain Python."""
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                f[lang].update(" ".join(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        chosen = {p: a for p, a in counts.items() if a >= support and " " in p}
        best = []
        for p, a in chosen.items():
            w = p.split(" ")
            if any(f" {p} " in f" {q} " and q != p and 100 * b >= 80 * a for q, b in chosen.items() if len(q) > len(p)):
                continue
            score, _, left, right = min((2_000_000 * a // (x + y), k, x, y) for k in range(1, len(w)) for x, y in [(counts[" ".join(w[:k])], counts[" ".join(w[k:])])])
            best.append((-score, -a, p.encode(), left, right))
        out += [(lang, r + 1, p.decode(), -a, left, right, n[lang], -s) for r, (s, a, p, left, right) in enumerate(sorted(best)[:most])]
    return sorted(out)


def made(seed, n=400):
    rng = random.Random(seed)
    words = ["aa", "Bb", "cc", "dd", "é", "ÉA", "x y", "z" * 300, "it's"]
    gaps = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "\x0b", "! "]
    rows = [(rng.choice(["en", "de", None]), "".join(rng.choice(words[: rng.choice([3, 5, 9])]) + rng.choice(gaps) for _ in range(rng.randint(0, 30)))) for _ in range(n)]
    return [*rows, ("en", None), ("fr", ""), ("it", "one two"), (None, " . "), *[("en", "copied text of five words")] * 31]


def run(spark, rows, **how):
    docs = spark.createDataFrame(rows, "lang string, text string").selectExpr("lang", "text", "1 as a", "'x' as phrase", "2 as n", "3 as key")
    return sorted(tuple(r) for r in collocations.collocations(docs.repartition(5), **how).collect())


@pytest.mark.parametrize(("shards", "stretch", "buffer"), [(8, 4_000_000, 8_000_000), (3, 300, 900), (40, 1, 1)])
def test_equals_counting_everything(spark, monkeypatch, shards, stretch, buffer):
    monkeypatch.setattr(collocations, "SHARDS", shards)
    monkeypatch.setattr(collocations, "STRETCH", stretch)
    monkeypatch.setattr(collocations, "BUFFER", buffer)
    monkeypatch.setattr(collocations, "MINED", buffer)
    rows = made(1)
    want = brute(rows, 30)
    assert run(spark, rows) == want and want


def test_small_support_ties_and_short_lists(spark):
    rows = made(2, 60)
    assert run(spark, rows, support=2, most=7) == brute(rows, 2, 7)


def test_empty_tables(spark):
    assert run(spark, [("en", None), ("de", "  ")]) == []
    assert collocations.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0


def test_hashes_that_collide_change_nothing(spark, monkeypatch):
    """With bitmaps of few bits nearly everything passes, and the exact counts decide."""
    monkeypatch.setattr(collocations, "LEAST_BITS", 8)
    monkeypatch.setattr(collocations, "MOST_BITS", 8)
    rows = made(3, 100)
    assert run(spark, rows, support=5) == brute(rows, 5)


def test_equal_keys_are_told_apart_by_their_checks():
    keys, checks = np.array([5, 5, 9, 5, 9], np.uint64), np.array([1, 2, 3, 1, 3], np.uint64)
    first, counts = collocations.grouped(keys, checks)
    assert sorted(zip(first.tolist(), counts.tolist(), strict=True)) == [(0, 2), (1, 1), (2, 2)]


def test_shards_are_mined_completely():
    rng = np.random.default_rng(4)
    words = rng.integers(0, 6, 3000)
    keys, piece = collocations.mixed(words.astype(np.uint64)), np.sort(rng.integers(0, 200, 3000)).astype(np.int32)
    frequent = words != 5
    want = {k: Counter() for k in (2, 3, 4)}
    for k, counts in want.items():
        for i in range(3000 - k + 1):
            if piece[i] == piece[i + k - 1] and frequent[i : i + k].all():
                key = keys[i : i + 1]
                for j in range(1, k):
                    key = collocations.joined(key, keys[i + j : i + j + 1])
                counts[int(key[0])] += 1
    told = lambda pairs: [dict(zip(f.tolist(), c.tolist(), strict=True)) for f, c in collocations.mined(keys, piece, frequent, pairs)]
    assert told(None) == [want[2]]
    everything = collocations.Bitmap(8, b"\xff")
    assert told(everything) == [want[3], want[4]]


def test_shares_leave_no_phrase_out():
    rng = random.Random(6)
    for _ in range(200):
        sizes = [("en", s, rng.choice([0, 1, 7, 1000])) for s in range(8)]
        if sum(n for *_, n in sizes):
            assert sum(x - 1 for x in collocations.shares_of(sizes, 30)["en"].values()) < 30


def test_query_equals_its_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    got = sorted(tuple(r) for r in queries.op11_collocations_son(spark, sf_dir).collect())
    assert got == sorted(con.execute(queries.COLLOCATIONS_SQL).fetchall()) and got
