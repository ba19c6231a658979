"""Embedding near-dedup by NN-descent.

Equal vectors of a label are one class. The first neighbour graph comes from several orders of the classes, each by the
signs of random projections and then by one projection: every class meets those in a window around it. Vectors are
projected from the mean of their label, since those with a common mean would lie on one side of nearly every plane. There are
so many orders that two vectors at the threshold miss each other in all with a chance of ``MISSED``, by their angle as seen from
the mean (at most MOST_ORDERS: a label that is denser than that is left to the rounds); a code's bits grow with the
logarithm of the rows, so the orders do as a small power of them. Rounds of NN-descent then compare neighbours of
neighbours: each class keeps a list of its nearest, whatever their cosine, lists without a new entry rest, pairs of
old entries aren't compared again, and a list whose entries all link is enlarged. Rounds end when they find no more links.

Every pair met that reaches the threshold is a link, also one that no list has a place for; a window or a list hands on
a spanning forest of its links instead of all pairs. Components of these links follow, and the links inside a component
are counted exactly: blocks of its members whose centres and radii prove all or no pairs to link (angles are a metric)
are counted whole, others are compared. Classes whose enlarged list is still full of links of their own component search
again outside it. An audit compares bounded samples of all, linked and saturated classes with all rows, that of all enlarged until it
has seen LEAST_LINKS links; while its recall
is below ``recall``, further orders are searched, and an error is raised if it still is after ``most_descents`` searches.

Defined cases: vectors that are null, zero or hold null or non-finite components, and rows with a null label, link with
nothing and are their own component; rows with a null id link like others but give a component no id and aren't kept;
vectors of different length don't link; repeated rows count as vectors of their own; further columns stay out.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import discard, durable
from tidemark.llm.components import connected_components, joined

#: Entries of a list; a saturated list holds up to twice as many. Rows of a window, expected rows of a code, rows of a block.
NEIGHBOURS, WINDOW, BUCKET, BLOCK = 8, 256, 128, 256
#: The nearest that each class takes from a window or a list.
TAKEN = 4
#: Chance that the first graph's orders never bring two vectors at the threshold together.
MISSED = 1e-4
MOST_ORDERS = 64
#: The audit compares about so many classes of each kind with all rows; of all classes up to MOST_AUDITED, until so many links were seen.
AUDITED, AUDITED_OF_ALL, MOST_AUDITED, LEAST_LINKS = 256, 4096, 65_536, 1000
#: A task sums vectors of so many labels at a time; a label's mean goes to so many shares of its rows.
SUMMED, SHARES = 1000, 32
#: Block pairs are matched in groups of so many blocks, so that no task holds all blocks of a large component.
MATCHED = 64
PAIRS = "u long, w long, sim double"


def usable(vector: Column) -> Column:
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(vector, lambda x: x != 0), F.lit(False))


def _units(vectors, dim: int) -> np.ndarray:
    """Vectors from their bytes (in single precision where that holds them exactly), scaled to length 1 in double."""
    raw = list(vectors)
    kinds = {len(v) // dim for v in raw}
    if len(kinds) == 1:
        x = np.frombuffer(b"".join(raw), np.float32 if kinds == {4} else np.float64).reshape(-1, dim).astype(np.float64)
    else:
        x = np.array([np.frombuffer(v, np.float32 if len(v) == 4 * dim else np.float64) for v in raw], np.float64).reshape(-1, dim)
    return x / np.sqrt((x**2).sum(axis=1))[:, None]


def groups_of(frames, keys: list[str]):
    """``frame, [(start, end), ...]`` with whole groups from frames sorted by their keys, also where a group goes on in the next frame."""
    held = None
    for frame in frames:
        if held is not None:
            frame = pd.concat([held, frame], ignore_index=True)
        if not len(frame):
            continue
        starts = _edges([frame[k].to_numpy() for k in keys])
        yield frame, list(zip(starts[:-1], starts[1:], strict=True))
        held = frame.iloc[starts[-1] :].reset_index(drop=True)
    if held is not None and len(held):
        yield held, [(0, len(held))]


def _edges(columns: list[np.ndarray]) -> np.ndarray:
    """Where a group of equal values starts."""
    changes = np.zeros(len(columns[0]) - 1, bool)
    for c in columns:
        changes |= c[1:] != c[:-1]
    return np.concatenate([[0], np.flatnonzero(changes) + 1])


def orders_for(largest: int, threshold: float, missed: float = MISSED, spread: float = 1.0) -> tuple[int, int]:
    """Bits of a code and how many orders, for ``largest`` vectors that may link with each other.

    A random plane through the mean parts two vectors at the threshold with chance angle / pi, the angle being that seen from the mean.
    ``spread``: the mean squared distance of the vectors, of length 1, from their mean."""
    bits = max(0, math.ceil(math.log2(max(1, largest / BUCKET))))
    seen = max(-1.0, 1 - (1 - threshold) / max(spread, 1e-9))
    same = (1 - math.acos(seen) / math.pi) ** bits
    if same > 0.99:
        return bits, 2
    return bits, MOST_ORDERS if same < 1e-3 else min(MOST_ORDERS, max(2, math.ceil(math.log(missed) / math.log(1 - same))))


def centres(classes: DataFrame) -> DataFrame:
    """``label, dim, n, mean``: the mean of each label's vectors, scaled to length 1."""
    schema = "label string, dim int, n long, mean binary"

    def summed(frames):
        held: dict[tuple, list] = {}

        def told():
            rows = [(label, dim, n, total.tobytes()) for (label, dim), (n, total) in held.items()]
            held.clear()
            return pd.DataFrame(rows, columns=["label", "dim", "n", "mean"])

        for frame in frames:
            for (label, dim), g in frame.groupby(["label", "dim"]):
                n, total = held.get((label, dim), (0, 0.0))
                held[label, dim] = n + len(g), total + _units(g["v"], int(dim)).sum(axis=0)
            if len(held) > SUMMED:
                yield told()
        yield told()

    def whole(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        total = np.array([np.frombuffer(m) for m in frame["mean"]]).sum(axis=0)
        n = int(frame["n"].sum())
        return pd.DataFrame({"label": [key[0]], "dim": [key[1]], "n": [n], "mean": [(total / n).tobytes()]})

    return classes.select("label", "dim", "v").mapInPandas(summed, schema).groupBy("label", "dim").applyInPandas(whole, schema)


def orders_of(means: DataFrame, threshold: float) -> tuple[int, int]:
    """Bits and orders that the most demanding label needs."""

    def each(frames):
        for frame in frames:
            told = [orders_for(int(n), threshold, spread=1 - float((np.frombuffer(m) ** 2).sum())) for n, m in zip(frame["n"], frame["mean"], strict=True)]
            yield pd.DataFrame(told, columns=["bits", "orders"])

    bits, orders = means.select("n", "mean").mapInPandas(each, "bits int, orders int").agg(F.max("bits"), F.max("orders")).first()
    return bits or 0, orders or 2


def _projected(classes: DataFrame, means: DataFrame, seed: int, bits: int, orders: int) -> DataFrame:
    """Each class once for each order: the signs of some random projections, seen from its label's mean, as a code, then a projection."""

    def run(frames):
        for frame in frames:
            for dim, g in frame.groupby("dim"):
                x = _units(g["v"], int(dim)) - np.frombuffer(b"".join(g["mean"])).reshape(-1, int(dim))
                for t in range(orders):
                    planes = np.random.default_rng([seed, t, int(dim)]).standard_normal((int(dim), bits + 1))
                    y = x @ planes
                    code = (y[:, :bits] > 0) @ (1 << np.arange(bits, dtype=np.int64))
                    yield pd.DataFrame({"t": np.full(len(g), t), "label": g["label"], "dim": g["dim"], "code": code.astype(np.int64), "at": y[:, bits], "cid": g["cid"], "root": g["root"], "v": g["v"]})

    # A label of any size meets its mean in several shares.
    dealt = classes.select("cid", "root", "label", "dim", "v").withColumn("share", F.pmod(F.xxhash64("cid"), F.lit(SHARES)))
    sent = means.select("label", "dim", "mean", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SHARES - 1).cast("long"))).alias("share"))
    placed = dealt.join(sent, ["label", "dim", "share"]).select("cid", "root", "label", "dim", "v", "mean")
    return placed.mapInPandas(run, "t int, label string, dim int, code long, at double, cid long, root long, v binary")


class _Found:
    """Pairs gathered from windows or lists: the nearest of each row, and links (sim is null) that unite what the pairs at the threshold unite."""

    def __init__(self, threshold: float):
        self.threshold, self.parts = threshold, []

    def meet(self, x: np.ndarray, ids: np.ndarray, root: np.ndarray, old: int = 0, settled: np.ndarray | None = None) -> None:
        """Rows from ``old`` on meet all rows; pairs of one known component, and of two ``settled`` rows, are left out."""
        sims = x[old:] @ x.T
        sims[root[old:, None] == root[None, :]] = -2
        if settled is not None:
            sims[np.ix_(settled[old:], settled)] = -2
        i, j = np.nonzero(sims >= self.threshold)
        if len(i):
            local = joined(len(x), i + old, j)
            moved = np.flatnonzero(local != np.arange(len(x)))
            self.parts.append((ids[moved], ids[local[moved]], np.full(len(moved), np.nan)))
        take = min(TAKEN, sims.shape[1])
        top = np.argpartition(-sims, take - 1, axis=1)[:, :take]
        best = np.take_along_axis(sims, top, 1)
        row, col = np.nonzero(best > -2)
        self.parts.append((ids[old:][row], ids[top[row, col]], np.round(best[row, col], 9)))

    def frame(self) -> pd.DataFrame:
        u, w, sim = (np.concatenate(c) for c in zip(*self.parts, strict=True)) if self.parts else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        self.parts = []
        return pd.DataFrame({"u": u, "w": w, "sim": pd.array(sim, "Float64")})


def _beside(projected: DataFrame, threshold: float, tasks: int) -> DataFrame:
    """What classes meet in the windows of each order: a window of rows meets itself and the window before."""

    def run(frames):
        tail = None
        for frame in frames:
            old = 0 if tail is None else len(tail)
            if old:
                frame = pd.concat([tail, frame], ignore_index=True)
            if len(frame) == old:
                continue
            ids, root, dim, v = (frame[c].to_numpy() for c in ("cid", "root", "dim", "v"))
            found = _Found(threshold)
            starts = [*_edges([frame["t"].to_numpy(), frame["label"].to_numpy(), dim]), len(frame)]
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                x = _units(v[a:b], int(dim[a]))
                for s in range(max(a, old), b, WINDOW):
                    lo, hi = max(a, s - WINDOW), min(b, s + WINDOW)
                    found.meet(x[lo - a : hi - a], ids[lo:hi], root[lo:hi], s - lo)
            yield found.frame()
            tail = frame.iloc[-WINDOW:].reset_index(drop=True)

    ordered = projected.repartitionByRange(tasks, "t", "label", "dim", "code", "at").sortWithinPartitions("t", "label", "dim", "code", "at")
    return ordered.mapInPandas(run, PAIRS)


def _lists(pairs: DataFrame, threshold: float, size: int = NEIGHBOURS) -> DataFrame:
    """``u, w, sim, new, fresh``: the ``size`` nearest of each class from pairs in one or both directions, twice as many while all of them link.

    Pairs are cut to the nearest before they are shuffled, so a hub's candidates are never gathered. ``new``: not in the list
    before; ``fresh``: the list has a new entry."""
    plain = pairs.where("sim is not null").select("u", "w", "sim", "new")
    both = plain.union(plain.select(F.col("w").alias("u"), F.col("u").alias("w"), "sim", "new"))
    near = F.dense_rank().over(Window.partitionBy("u").orderBy(F.col("sim").desc(), "w"))
    cut = both.withColumn("_near", near).where(F.col("_near") <= 2 * size).where((F.col("_near") <= size) | (F.col("sim") >= threshold))
    once = cut.groupBy("u", "w").agg(F.max("sim").alias("sim"), F.min("new").alias("new"))
    return once.withColumn("fresh", F.max("new").over(Window.partitionBy("u")))


def _joined(lists: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """Neighbours of neighbours: the entries of each list with a new entry meet each other, but not two old ones."""

    def run(frames):
        for frame, spans in groups_of(frames, ["u"]):
            ids, root, dim, v, new = (frame[c].to_numpy() for c in ("w", "root", "dim", "v", "new"))
            found = _Found(threshold)
            for a, b in spans:
                if b - a > 1:
                    found.meet(_units(v[a:b], int(dim[a])), ids[a:b], root[a:b], 0, ~new[a:b].astype(bool))
            yield found.frame()

    around = lists.where("fresh").join(classes.select(F.col("cid").alias("w"), "root", "dim", "v"), "w").select("u", "w", "root", "dim", "v", "new")
    return around.repartition("u").sortWithinPartitions("u").mapInPandas(run, PAIRS)


def _links(pairs: DataFrame) -> DataFrame:
    return pairs.where("sim is null").select(F.least("u", "w").alias("u"), F.greatest("u", "w").alias("w")).distinct()


def descend(classes: DataFrame, threshold: float, seed: int, known: DataFrame | None = None, most_rounds: int = 6, settled: float = 0.001) -> tuple[DataFrame, DataFrame]:
    """The neighbour lists once a round adds less than a share ``settled`` of linking entries; and all links found.

    Classes of one ``root`` are known to be of one component and don't meet. Lists ``known`` from before show ways into
    components, their entries count as old."""
    tasks = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    means = durable(centres(classes))
    first = durable(_beside(_projected(classes, means, seed, *orders_of(means, threshold)), threshold, tasks))
    discard(means)
    links = [durable(_links(first))]
    fresh = first.withColumn("new", F.lit(True))
    now = durable(_lists(fresh if known is None else fresh.union(known.select("u", "w", "sim", F.lit(False))), threshold))
    discard(first)
    had = now.where(F.col("sim") >= threshold).count()
    for _ in range(most_rounds):
        met = durable(_joined(now, classes, threshold))
        links.append(durable(_links(met)))
        better = durable(_lists(now.select("u", "w", "sim", F.lit(False).alias("new")).union(met.withColumn("new", F.lit(True))), threshold))
        discard(met)
        discard(now)
        now = better
        has = now.where(F.col("sim") >= threshold).count()
        if has - had <= settled * has:
            break
        had = has
    found = durable(reduce(DataFrame.union, links).distinct())
    for part in links:
        discard(part)
    return now, found


def _blocked(members: DataFrame) -> DataFrame:
    """Members ``root, cid, n, dim, v`` with ``block`` and ``at``: rows of a component that lie together in an order by one projection."""

    def project(frames):
        for frame in frames:
            for dim, g in frame.groupby("dim"):
                way = np.random.default_rng([17, int(dim)]).standard_normal(int(dim))
                yield g.assign(at=_units(g["v"], int(dim)) @ way)

    def deal(frames):
        last, taken, block = None, 0, -1
        for frame in frames:
            out = np.empty(len(frame), np.int64)
            for k, (root, part) in enumerate(zip(frame["root"].to_numpy(), frame["part"].to_numpy(), strict=True)):
                if root != last or taken == BLOCK:
                    last, taken, block = root, 0, (block if block >= 0 else int(part) << 32) + 1
                taken += 1
                out[k] = block
            yield frame.drop(columns="part").assign(block=out)

    tasks = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = members.select("root", "cid", "n", "dim", "v").mapInPandas(project, "root long, cid long, n long, dim int, v binary, at double")
    ordered = at.repartitionByRange(tasks, "root", "at").sortWithinPartitions("root", "at").withColumn("part", F.spark_partition_id())
    return ordered.mapInPandas(deal, "root long, cid long, n long, dim int, v binary, at double, block long")


def exact_counts(members: DataFrame, threshold: float) -> DataFrame:
    """``cid, links``: how many vectors (``n`` to a class) of its component each class links with, itself left out.

    Rows ``root, cid, n, dim, v``. Two blocks whose centres and radii prove that all or none of their pairs link are counted
    without comparing; only the undecided ones are shipped to each other."""
    reach = math.acos(threshold)
    blocked = durable(_blocked(members))

    def inside(frames):
        names = ["root", "block", "cid", "centre", "radius", "links"]
        for frame, spans in groups_of(frames, ["block"]):
            root, block, cid, n, dim, v = (frame[c].to_numpy() for c in ("root", "block", "cid", "n", "dim", "v"))
            counts, blocks = np.zeros(spans[-1][1] if spans else 0, np.int64), []
            for a, b in spans:
                x = _units(v[a:b], int(dim[a]))
                hit = x @ x.T >= threshold
                np.fill_diagonal(hit, False)
                counts[a:b] = hit @ n[a:b]
                centre = x.mean(axis=0)
                length = np.sqrt(centre @ centre)
                centre = centre / length if length > 1e-9 else x[0]
                radius = float(np.arccos(np.clip(x @ centre, -1, 1)).max()) + 1e-7
                blocks.append((root[a], block[a], None, centre.tobytes(), radius, int(n[a:b].sum())))
            if spans:
                end = len(counts)
                yield pd.DataFrame({"root": root[:end], "block": block[:end], "cid": cid[:end], "centre": None, "radius": np.nan, "links": counts})
                yield pd.DataFrame(blocks, columns=names).astype({"cid": "Int64"})

    def decide(frames):
        for frame in frames:
            for dim, g in frame.assign(dim=frame["ca"].map(len) // 8).groupby("dim"):
                x, y = (np.frombuffer(b"".join(g[c]), np.float64).reshape(-1, int(dim)) for c in ("ca", "cb"))
                apart = np.arccos(np.clip((x * y).sum(axis=1), -1, 1))
                wide = (g["ra"] + g["rb"]).to_numpy() + 1e-7
                verdict = np.where(apart + wide <= reach, 1, np.where(apart - wide > reach, -1, 0))
                yield g[["a", "b", "na", "nb"]].assign(verdict=verdict)[verdict >= 0]

    def across(frames):
        for frame, spans in groups_of(frames, ["a", "b"]):
            for s, e in spans:
                g = frame.iloc[s:e]
                x, ids, n, block = _units(g["v"], int(g["dim"].iloc[0])), g["cid"].to_numpy(), g["n"].to_numpy(), g["block"].to_numpy()
                left, right = np.flatnonzero(block == g["a"].iloc[0]), np.flatnonzero(block == g["b"].iloc[0])
                hit = x[left] @ x[right].T >= threshold
                yield pd.DataFrame({"cid": np.concatenate([ids[left], ids[right]]), "links": np.concatenate([hit @ n[right], hit.T @ n[left]])})

    dealt = blocked.repartition("block").sortWithinPartitions("block")
    within = durable(dealt.mapInPandas(inside, "root long, block long, cid long, centre binary, radius double, links long"))
    blocks = within.where("cid is null").select("root", "block", "centre", "radius", F.col("links").alias("held"))
    groups = blocks.groupBy("root").agg(F.ceil(F.count("*") / MATCHED).cast("int").alias("groups"), F.count("*").alias("many")).where("many > 1")
    sized = durable(blocks.join(groups, "root"))
    counts = [within.where("cid is not null").select("cid", "links")]
    if not sized.isEmpty():
        a = sized.select("root", F.col("block").alias("a"), F.col("centre").alias("ca"), F.col("radius").alias("ra"), F.col("held").alias("na"), F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("g"))
        b = sized.select("root", F.col("block").alias("b"), F.col("centre").alias("cb"), F.col("radius").alias("rb"), F.col("held").alias("nb"), F.pmod(F.xxhash64("block"), "groups").cast("int").alias("g"))
        decided = durable(a.join(b, ["root", "g"]).where("a < b").select("a", "b", "ca", "cb", "ra", "rb", "na", "nb").mapInPandas(decide, "a long, b long, na long, nb long, verdict int"))
        whole = decided.where("verdict = 1")
        gain = whole.select(F.col("a").alias("block"), F.col("nb").alias("n")).union(whole.select("b", "na")).groupBy("block").agg(F.sum("n").alias("links"))
        counts.append(blocked.select("cid", "block").join(gain, "block").select("cid", "links"))
        open_ = decided.where("verdict = 0").select("a", "b", F.explode(F.array("a", "b")).alias("block"))
        shipped = open_.join(blocked.select("block", "cid", "n", "dim", "v"), "block").repartition("a", "b").sortWithinPartitions("a", "b")
        counts.append(shipped.mapInPandas(across, "cid long, links long"))
    return reduce(DataFrame.union, counts).groupBy("cid").agg(F.sum("links").alias("links"))


def audit(classes: DataFrame, counted: DataFrame, full: DataFrame, threshold: float) -> float:
    """Share of the links of bounded samples of classes, found by comparing them with all rows, that ``counted`` has.

    The least share of three samples: of all classes, of those with a link and of those in ``full``, whose lists are
    saturated. 1.0 where no sampled class has a link in truth. Where the first sample of all holds too few links to tell a small loss, it is enlarged."""
    sample, n = AUDITED_OF_ALL, classes.count()
    while True:
        share, links = _audited(classes, counted, full, threshold, sample, n)
        if links >= LEAST_LINKS or sample >= min(n, MOST_AUDITED):
            return share
        sample = min(MOST_AUDITED, 4 * sample)


def _audited(classes: DataFrame, counted: DataFrame, full: DataFrame, threshold: float, of_all: int, n: int) -> tuple[float, int]:
    """The least share, and how many links the sample of all classes has in truth."""
    kinds = {"all": (None, of_all, n), "linked": (counted.where("links > 0").select("cid"), AUDITED, None), "full": (full, AUDITED, None)}
    drawn = []
    for among, sample, size in kinds.values():
        scale = 1 << 30
        size = among.count() if size is None else size
        picked = classes if among is None else classes.join(among, "cid", "left_semi")
        drawn.append(picked.where(F.pmod(F.xxhash64("cid", F.lit("audit")), F.lit(scale)) <= int(min(1.0, sample / max(1, size)) * scale)).select("cid", "label", "dim", "v").toPandas())
    queries = pd.concat(drawn).drop_duplicates("cid")
    if not len(queries):
        return 1.0, 0
    sent = classes.sparkSession.sparkContext.broadcast({key: (g["cid"].to_numpy(), _units(g["v"], key[1])) for key, g in queries.groupby(["label", "dim"])})

    def run(frames):
        for frame in frames:
            for key, g in frame.groupby(["label", "dim"]):
                if key in sent.value:
                    ids, x = sent.value[key]
                    y, cid, copies = _units(g["v"], key[1]).T, g["cid"].to_numpy(), g["n"].to_numpy()
                    for k in range(0, len(ids), AUDITED):
                        hit = (x[k : k + AUDITED] @ y >= threshold) & (ids[k : k + AUDITED, None] != cid)
                        true = hit @ copies
                        yield pd.DataFrame({"cid": ids[k : k + AUDITED], "truth": true})[true > 0]

    truth = classes.select("cid", "label", "dim", "n", "v").mapInPandas(run, "cid long, truth long").groupBy("cid").agg(F.sum("truth").alias("truth"))
    met = truth.join(counted, "cid", "left").select("cid", "truth", F.least("truth", F.coalesce("links", F.lit(0))).alias("got")).toPandas()
    shares = []
    for part in drawn:
        seen = met[met["cid"].isin(part["cid"])]
        shares.append(seen["got"].sum() / seen["truth"].sum() if len(seen) else 1.0)
    return float(min(shares)), int(met[met["cid"].isin(drawn[0]["cid"])]["truth"].sum())


def saturated(lists: DataFrame, threshold: float, size: int = NEIGHBOURS) -> DataFrame:
    """``cid``: classes whose enlarged list is full of links, so it may lack some."""
    return lists.where(F.col("sim") >= threshold).groupBy(F.col("u").alias("cid")).count().where(F.col("count") >= 2 * size).select("cid")


def _placed(classes: DataFrame, roots: DataFrame) -> DataFrame:
    """The classes with the ``root`` of their component, their own ``cid`` where nothing links."""
    return classes.join(roots, F.col("cid") == F.col("node"), "left").drop("node").withColumn("root", F.coalesce("root", "cid"))


def _packed(frames):
    for frame in frames:
        out = []
        for v in frame["x"]:
            x = np.array(v, np.float64)
            # A subnormal or overflowing value isn't held exactly, so it stays in double precision.
            with np.errstate(over="ignore"):
                short = x.astype(np.float32)
            out.append((short if (short == x).all() else x).tobytes())
        yield pd.DataFrame({"id": frame["id"], "label": frame["label"], "dim": frame["dim"], "v": out})


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, recall: float = 0.999, most_descents: int = 4, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``id, n_links, component_id, kept`` for every row, and ``audited_recall`` of the whole search."""
    plain = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[label_col].cast("string").alias("label"), vectors[vector_col].cast("array<double>").alias("x"))
    plain = plain.withColumn("takes_part", usable(F.col("x")) & F.col("label").isNotNull())
    taking = plain.where("takes_part").select("id", "label", F.size("x").alias("dim"), "x").mapInPandas(_packed, "id long, label string, dim int, v binary")
    rows = durable(taking.withColumn("key", F.sha2(F.concat(F.col("label").cast("binary"), F.lit(b"\0"), F.col("dim").cast("string").cast("binary"), F.lit(b"\0"), F.col("v")), 256)))
    classes = rows.groupBy("key").agg(F.min("id").alias("first_id"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("dim").alias("dim"), F.first("v").alias("v"))
    classes = durable(classes.withColumn("cid", F.monotonically_increasing_id()))

    def counted_from(links: DataFrame) -> tuple[DataFrame, DataFrame]:
        roots = durable(connected_components(links, "u", "w"))
        members = roots.select(F.col("node").alias("cid"), "root").join(classes.select("cid", "n", "dim", "v"), "cid")
        return roots, durable(exact_counts(members, threshold))

    links = full = lists = None
    for attempt in range(most_descents):
        # The first search of all classes meets every pair anew; each class is its own component.
        lists, more = descend(classes.withColumn("root", F.col("cid")), threshold, attempt, lists)
        links = more if links is None else links.union(more)
        roots, counted = counted_from(links)
        full = durable(saturated(lists, threshold))
        crowded = durable(_placed(classes, roots).join(full, "cid", "left_semi"))
        # Two ends that both have a full list of their own components' members may have missed each other.
        if crowded.select("root").distinct().limit(2).count() > 1:
            near = lists.join(full.withColumnRenamed("cid", "u"), "u", "left_semi").join(full.withColumnRenamed("cid", "w"), "w", "left_semi")
            outside, more = descend(crowded, threshold, most_descents + attempt, near)
            discard(outside)
            if not more.isEmpty():
                links = links.union(more)
                roots, counted = counted_from(links)
        reached = audit(classes, counted, full, threshold)
        if reached >= recall:
            break
    else:
        raise RuntimeError(f"audited recall of links is {reached:.4f}, under {recall}, after {most_descents} searches")
    named = _placed(classes, roots)
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_class = named.join(least, "root").join(counted, "cid", "left").select("key", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    linked = rows.select("id", "key").join(durable(of_class), "key").select("id", "n_links", "component_id")
    alone = plain.where("not takes_part").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.union(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"), F.lit(reached).alias("audited_recall"))
