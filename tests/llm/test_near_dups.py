"""SimHash, embedding graph, top-k and components against brute force."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import knn_graph, pivots, simhash
from tidemark.llm.components import connected_components


def roots(n, links):
    up = list(range(n))

    def find(a):
        while up[a] != a:
            up[a] = up[up[a]]
            a = up[a]
        return a

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(a) for a in range(n)]


def plain_fingerprint(text):
    words = bytes(text or "", "utf-8").lower().split()
    runs = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if hashes and 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_components_of_paths_stars_and_cycles(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200, 201), (201, 202), (202, 200), (300, 300)]
    df = spark.createDataFrame(links + [(b, a) for a, b in links[:10]], "x long, y long")
    got = {r["node"]: r["root"] for r in connected_components(df, "x", "y").collect()}
    want = {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {i: 200 for i in range(200, 203)}
    assert got == want


@pytest.mark.parametrize("leaf", [4, 64])
def test_vantage_shards_keep_every_close_pair(leaf):
    rng = np.random.default_rng(leaf)
    points = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    near = points[:100] ^ (np.uint64(1) << rng.integers(0, 64, 100, dtype=np.uint64))
    points = np.unique(np.concatenate([points, near, near ^ np.uint64(5)]))
    got = simhash.shard_links(points, 2, leaf)
    d = np.bitwise_count(points[:, None] ^ points[None])
    want = roots(len(points), zip(*np.nonzero(np.triu(d <= 2, 1)), strict=True))
    assert roots(len(points), enumerate(got.tolist())) == want


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_crowds_link_as_all_pairs_do(spark, monkeypatch, radius):
    monkeypatch.setattr(simhash, "CROWD", 256)
    rng = np.random.default_rng(5)
    near = np.zeros(1500, np.uint64)
    for _ in range(6):
        near ^= np.uint64(1) << rng.integers(0, 64, len(near), np.uint64)
    spread = rng.integers(0, 1 << 63, 600, np.uint64)
    points = np.unique(np.concatenate([near, spread, spread[:200] ^ np.uint64(3), spread[200:300] ^ np.uint64(1 << 63)]))
    tree = simhash.VantageTree(points, radius, 64, 256)
    assert radius == 1 or tree.crowds and tree.shards > len(tree.crowds)  # a border of one bit still cuts this crowd
    a, b = np.nonzero(np.triu(np.bitwise_count(points[:, None] ^ points[None, :]) <= radius, 1))
    want = simhash.joined(len(points), a, b)
    longs = points.view(np.int64)
    fps = spark.createDataFrame([(int(x),) for x in longs], "fp long")
    at = {int(x): k for k, x in enumerate(longs)}
    for links in (simhash.link_fingerprints(fps, radius, shard=64), simhash.crowd_links(fps, radius)):
        found = [(at[r["a"]], at[r["b"]]) for r in links.collect()]
        got = simhash.joined(len(points), np.array([i for i, _ in found]), np.array([j for _, j in found]))
        assert (got == want).all()


def test_simhash_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    extra = [(10_000, None), (10_001, ""), (10_002, " \n"), (10_003, "one two"), (10_004, "ONE two"), (10_005, "a b c " * 5000), (0, "repeated id"), (None, "no id")]
    docs = docs.union(spark.createDataFrame(extra, "doc_id long, text string")).withColumn("fp", F.lit("clash")).withColumn("component_id", F.lit(1))
    rows = docs.select("doc_id", "text").collect()
    fps = [plain_fingerprint(r["text"]) for r in rows]
    arr = np.array(fps, np.uint64)
    group = roots(len(rows), zip(*np.nonzero(np.triu(np.bitwise_count(arr[:, None] ^ arr[None]) <= 2, 1)), strict=True))
    least = {}
    for g, r in zip(group, rows, strict=True):
        if r["doc_id"] is not None:
            least[g] = min(least.get(g, r["doc_id"]), r["doc_id"])
    want = sorted((str(r["doc_id"]), f"{f:016x}", str(least.get(g))) for r, f, g in zip(rows, fps, group, strict=True))
    got = sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in simhash.near_duplicates(docs).collect())
    assert got == want
    assert simhash.near_duplicates(docs.where("false")).count() == 0


def embeddings(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((120, 16))
    close = base[:40] + 0.05 * rng.standard_normal((40, 16))
    dense = base[5] + 0.04 * rng.standard_normal((60, 16))
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(np.concatenate([base, close, dense]))]
    rows += [(900 + i, base[7].tolist(), 1) for i in range(5)] + [(7, base[7].tolist(), 1)]
    rows += [(950, None, 1), (951, [0.0] * 16, 1), (952, [float("nan")] * 16, 1), (953, [None] * 16, 1), (954, [], 1), (955, base[7].tolist(), None), (None, base[7].tolist(), 1), (956, [1.0, 2.0], 1)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("key", F.lit(0)).withColumn("n_links", F.lit(0))


def test_nn_descent_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(knn_graph, "BLOCK", 16)
    df = embeddings(spark)
    rows = df.select("vec_id", "embedding", "label").collect()

    def fine(r):
        e = r["embedding"]
        return bool(r["label"] is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e))

    links = []
    for i, a in enumerate(rows):
        for j in range(i):
            b = rows[j]
            if fine(a) and fine(b) and a["label"] == b["label"] and len(a["embedding"]) == len(b["embedding"]):
                x, y = np.array(a["embedding"], float), np.array(b["embedding"], float)
                if x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= 0.98:
                    links.append((i, j))
    n = np.bincount(np.array(links).ravel(), minlength=len(rows))
    group = roots(len(rows), links)
    least = {}
    for g, r in zip(group, rows, strict=True):
        least[g] = min(least.get(g, 1 << 60), r["vec_id"] if r["vec_id"] is not None else 1 << 60)
    want = sorted((str(r["vec_id"]), int(k), str(least[g]), r["vec_id"] == least[g]) for r, k, g in zip(rows, n, group, strict=True))
    got = sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"]), r["kept"]) for r in knn_graph.near_duplicates(df).collect())
    assert len(links) > 500 and got == want
    assert knn_graph.near_duplicates(df.where("false")).count() == 0


def test_links_between_clusters_larger_than_a_list(spark):
    """Pairs of clusters 0.982 apart whose members, at 0.995, fill each other's lists."""
    rng = np.random.default_rng(8)
    found = []
    for pair in range(6):
        q = np.linalg.qr(rng.standard_normal((24, 24)))[0]
        apart = np.arccos(0.982 / 0.995)
        for centre in (q[0], np.cos(apart) * q[0] + np.sin(apart) * q[1]):
            noise = rng.standard_normal((60, 22))
            noise /= np.linalg.norm(noise, axis=1)[:, None]
            found.append((pair, np.sqrt(0.995) * centre + np.sqrt(0.005) * noise @ q[2:]))
    x = np.concatenate([v for _, v in found])
    label = np.concatenate([[pair % 2] * len(v) for pair, v in found])
    x = x.astype(np.float32).astype(float)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    hit = (unit @ unit.T >= 0.98) & (label[:, None] == label) & ~np.eye(len(x), dtype=bool)
    group = roots(len(x), zip(*np.nonzero(np.triu(hit)), strict=True))
    assert len(set(group)) == 6
    df = spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, label, strict=True))], "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in knn_graph.near_duplicates(df).collect()}
    assert got == {i: (int(hit[i].sum()), group[i], group[i] == i) for i in range(len(x))}


def planted_pairs(n, pairs, seed):
    """n random vectors, and for the first ``pairs`` a second one just over the threshold."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, 64)).astype(np.float32)
    u = x[:pairs] / np.linalg.norm(x[:pairs].astype(float), axis=1)[:, None]
    z = rng.standard_normal((pairs, 64))
    z -= (z * u).sum(axis=1)[:, None] * u
    z /= np.linalg.norm(z, axis=1)[:, None]
    c = rng.uniform(0.9801, 0.985, pairs)[:, None]
    return np.concatenate([x, (c * u + np.sqrt(1 - c * c) * z).astype(np.float32)])


def test_isolated_pairs_among_many_vectors_are_found(spark, tmp_path):
    x = planted_pairs(20_000, 1_300, 2)
    flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), 64).cast(pa.list_(pa.float32()))
    pq.write_table(pa.table({"vec_id": np.arange(len(x)), "embedding": flat, "label": np.zeros(len(x), np.int32)}), tmp_path / "e.parquet", row_group_size=4096)
    got = knn_graph.near_duplicates(spark.read.parquet(str(tmp_path / "e.parquet"))).where("n_links > 0").collect()
    assert sum(r["n_links"] for r in got) >= 0.99 * 2 * 1_300
    assert all(r["audited_recall"] >= 0.999 and r["component_id"] in (r["vec_id"], r["vec_id"] - 20_000) for r in got)


def test_vectors_with_a_common_mean_lose_no_links(spark, tmp_path):
    """Average cosine 0.9: planes through the origin would put most vectors on one side."""
    rng, n, planted = np.random.default_rng(12), 40_000, 500
    x = rng.standard_normal((n, 64)) + rng.standard_normal(64) * 3.0
    x /= np.linalg.norm(x, axis=1)[:, None]
    assert 0.85 < (x.mean(axis=0) ** 2).sum() < 0.95
    away = rng.standard_normal((planted, 64))
    away -= (away * x[:planted]).sum(axis=1)[:, None] * x[:planted]
    away /= np.linalg.norm(away, axis=1)[:, None]
    x = np.concatenate([x, 0.9815 * x[:planted] + np.sqrt(1 - 0.9815**2) * away]).astype(np.float32)
    exact = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1)[:, None]
    want = sum(int((exact[a : a + 2000] @ exact.T >= 0.98).sum()) for a in range(0, len(x), 2000)) - len(x)
    flat = pa.ListArray.from_arrays(pa.array(np.arange(0, 64 * len(x) + 1, 64), pa.int32()), pa.array(x.ravel()))
    pq.write_table(pa.table({"vec_id": np.arange(len(x)), "embedding": flat, "label": np.zeros(len(x), np.int32)}), tmp_path / "e.parquet", row_group_size=4096)
    got = knn_graph.near_duplicates(spark.read.parquet(str(tmp_path / "e.parquet"))).where("n_links > 0").collect()
    assert want >= 2 * planted and sum(r["n_links"] for r in got) >= 0.999 * want


def test_orders_follow_the_spread():
    assert knn_graph.orders_for(60_000, 0.98, spread=0.1)[1] == knn_graph.MOST_ORDERS > knn_graph.orders_for(60_000, 0.98, spread=0.5)[1] > knn_graph.orders_for(60_000, 0.98)[1]


def test_orders_grow_slowly_and_keep_the_chance():
    found = [knn_graph.orders_for(10**k, 0.98) for k in range(2, 10)]
    assert found[0] == (0, 2) and [t for _, t in found] == sorted(t for _, t in found) and found[-1][1] < 60
    for bits, orders in found:
        assert (1 - (1 - np.arccos(0.98) / np.pi) ** bits) ** orders <= 1e-4 or bits == 0


def test_blocks_count_what_all_pairs_count(spark, monkeypatch):
    """A long chain and a dense ball: blocks are skipped, counted whole, or compared."""
    monkeypatch.setattr(knn_graph, "BLOCK", 16)
    monkeypatch.setattr(knn_graph, "MATCHED", 4)
    rng = np.random.default_rng(4)
    turn = np.arange(150) * 0.05
    chain = np.stack([np.cos(turn), np.sin(turn), np.zeros(150)], axis=1)
    ball = np.array([0, 0, 1.0]) + 0.02 * rng.standard_normal((120, 3))
    wide = np.array([0, 0.5, 1.0]) + 0.09 * rng.standard_normal((120, 3))
    n = rng.integers(1, 4, 390)
    want, rows = {}, []
    for root, part in enumerate((chain, ball, wide)):
        at = len(rows)
        x = part / np.linalg.norm(part, axis=1)[:, None]
        hit = (x @ x.T >= 0.98) & ~np.eye(len(x), dtype=bool)
        want |= {at + i: int(c) for i, c in enumerate(hit @ n[at : at + len(x)])}
        rows += [(root, at + i, int(n[at + i]), 3, bytearray(v.tobytes())) for i, v in enumerate(part)]
    members = spark.createDataFrame(rows, "root long, cid long, n long, dim int, v binary")
    assert {r["cid"]: r["links"] for r in knn_graph.exact_counts(members, 0.98).collect()} == want


def test_missed_links_show_in_the_audit_and_raise(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((3000, 16))
    x[1::500] = x[::500] + 0.01
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    classes = spark.createDataFrame([(i, "0", 16, 1, bytearray(v.tobytes())) for i, v in enumerate(x)], "cid long, label string, dim int, n long, v binary")
    nothing = spark.createDataFrame([], "cid long, links long")
    assert knn_graph.audit(classes, nothing, nothing.select("cid"), 0.98) == 0.0
    monkeypatch.setattr(knn_graph, "audit", lambda *_: 0.5)
    with pytest.raises(RuntimeError, match="recall"):
        knn_graph.near_duplicates(spark.createDataFrame(rows[:100], "vec_id long, embedding array<float>, label int"), most_descents=1)


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(pivots, "BLOCK", 32)
    monkeypatch.setattr(pivots, "CHUNK", 8)
    monkeypatch.setattr(pivots, "BLOCKS_MATCHED", 3)
    monkeypatch.setattr(pivots, "PARTS_MATCHED", 2)
    df = embeddings(spark)
    # Repeated rows, as candidates and as queries.
    df = df.union(df.where("vec_id in (20, 25, 40)")).union(df.where("vec_id = 40"))
    rows = [(r["vec_id"], np.floor(256 * np.array(r["embedding"], float))) for r in df.select("vec_id", "embedding").collect() if r["vec_id"] is not None and r["embedding"] and all(x is not None and np.isfinite(x) for x in r["embedding"])]
    scored = {}
    for q, v in rows:
        if q % 20 == 0:
            scored.setdefault(q, []).extend((-int(v @ x), i) for i, x in rows if i != q and len(x) == len(v))
    want = [(q, k + 1, i, -s) for q, pairs in scored.items() for k, (s, i) in enumerate(sorted(pairs)[:5])]
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in pivots.top_k(df, F.col("id") % 20 == 0, 5, pivots=4).collect()]
    assert sorted(got) == sorted(want)
    assert pivots.top_k(df.where("false"), F.col("id") % 20 == 0).count() == 0


def test_blocks_out_of_reach_get_no_vectors(spark, monkeypatch):
    """Queries in a few clusters far from most blocks: the tables alone leave out most (chunk, block) pairs."""
    monkeypatch.setattr(pivots, "BLOCK", 64)
    monkeypatch.setattr(pivots, "CHUNK", 16)
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((24, 12))
    centres *= 8 / np.linalg.norm(centres, axis=1)[:, None]
    x = np.concatenate([c + 0.05 * rng.standard_normal((100, 12)) for c in centres])
    counted = []
    monkeypatch.setattr(pivots, "plan_pairs", lambda c, b, plan=pivots.plan_pairs: counted.append((plan(c, b).count(), c.count() * b.count())) or plan(c, b))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in pivots.top_k(df, F.col("id") % 20 == 0, 5).collect())
    v = np.floor(256 * x)
    want = []
    for q in range(0, len(v), 20):
        s = v @ v[q]
        want += [(q, k + 1, int(i), int(s[i])) for k, i in enumerate([i for i in np.lexsort((np.arange(len(v)), -s)) if i != q][:5])]
    assert got == want
    shipped, all_pairs = counted[0]
    assert shipped < 0.25 * all_pairs


def test_bounds_skip_no_answer():
    rng = np.random.default_rng(0)
    x = np.floor(rng.standard_normal((500, 8)) * 256)
    p = pivots.choose_pivots({8: x}, 6)[8]
    d = pivots.distances(x, p)
    a, b, s = pivots.search_block(np.arange(20), x[:20], d[:20], np.full(20, -np.inf), np.arange(500), x, d, 5)
    for q in range(20):
        scores = x @ x[q]
        scores[q] = -np.inf
        order = np.lexsort((np.arange(500), -scores))[:5]
        assert list(zip(b[a == q], s[a == q], strict=True)) == [(i, scores[i]) for i in order]
