"""Phrases that are collocations, found by partitioning (SON).

Words and pieces of text are cut out of whole buffers with numpy. First words are counted, whole. The input is in SHARDS shards, whatever its size; many tasks
mine a shard together. Each is mined completely at its share of the support: a phrase with f >= support in all has at least support * n_s / n, rounded up, in
some shard s of n_s of the n words of its language. First come pairs of frequent words, then phrases of three and four words all of whose
pairs are left. What the shards report, and the most that a shard may hold without reporting, bound a phrase's count from above; phrases whose bound is
below the support go. The union of the rest is kept as a bitmap of hashes of bounded size. Last, every phrase of the bitmap is counted in the whole
input, as text, and the exact sums decide. Hashes only choose what is counted: whatever passes by chance is counted exactly like the rest and
falls below the support, or belongs to the result.

Defined cases: null texts are empty; null languages are ``und``; a language without words has no rows; words are compared by their bytes with A-Z
in lower case; repeated rows count as often as they are there, ids are not read; a text of any length is whole, and phrases don't cross texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import discard, durable

#: Shards of the input; words that a task mines at a time, but for one buffer or one text more; bytes of text taken at a time, to count and to mine.
SHARDS, STRETCH, BUFFER, MINED = 8, 1_000_000, 6_000_000, 1_500_000
#: Keys that are sorted together, rows that leave a task together, texts that are unpacked together.
SORTED, SENT, UNPACKED = 250_000, 100_000, 256
#: Bits of a bitmap for each key, and of a bitmap at least and at most (2^28 bits are 32 MB).
SPARSE, LEAST_BITS, MOST_BITS = 32, 1 << 16, 1 << 28
#: Bits of a part of a bitmap that one task writes.
PART_BITS = 1 << 20
#: Bytes that end a piece and bytes that part words.
ENDS, GAPS = b".,;:!?\n\x0b\x0c\r", b" \t"
LONGEST = 4

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[9] = 32
_KIND = np.zeros(256, np.uint8)
_KIND[list(GAPS)], _KIND[list(ENDS)] = 1, 2
#: Keys are sums of random values of bytes times powers of an odd number; the second of each kind makes the check of a key.
_DRAWN = np.random.default_rng(11)
_UNITS = _DRAWN.integers(1 << 63, size=2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTES = _DRAWN.integers(1, 1 << 63, (2, 256), dtype=np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def joined(first: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The key of a phrase and one more word."""
    return mixed(first * _UNITS[0] + ~word)


def _sums(raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray, which: int) -> np.ndarray:
    """The keys of words, all first bytes together, then all second ones."""
    keys, unit, value = np.zeros(len(sizes), np.uint64), _UNITS[which], _BYTES[which]
    live = np.arange(len(sizes))
    for k in range(int(sizes.max()) if len(sizes) else 0):
        if len(live) < 64:  # the few that are very long, one by one
            for w in live.tolist():
                h = int(keys[w])
                for b in value[raw[starts[w] + k : starts[w] + sizes[w]]].tolist():
                    h = (h * int(unit) + b) & 0xFFFFFFFFFFFFFFFF
                keys[w] = h
            break
        keys[live] = keys[live] * unit + value[raw[starts[live] + k]]
        live = live[sizes[live] > k + 1]
    return mixed(keys)


class Words:
    """The words of a buffer of texts: where they start and end in bytes, their keys, and the piece each is in."""

    def __init__(self, buffer: bytes):
        self.raw = _FOLD[np.frombuffer(buffer, np.uint8)]
        kind = _KIND[self.raw]
        inside = np.zeros(len(kind) + 2, bool)
        inside[1:-1] = kind == 0
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.starts, self.ends = edges[::2], edges[1::2]
        self.piece = np.searchsorted(np.flatnonzero(kind == 2), self.starts).astype(np.int32)
        self.keys = _sums(self.raw, self.starts, self.ends - self.starts, 0)

    def checks(self) -> np.ndarray:
        return _sums(self.raw, self.starts, self.ends - self.starts, 1)

    def texts(self, first: np.ndarray, words: int) -> pa.Array:
        """The phrases of so many words from these words on, one space between words."""
        starts, ends = self.starts[first], self.ends[first + words - 1]
        gaps = sum(self.starts[first + k + 1] - self.ends[first + k] for k in range(words - 1)) if words > 1 else np.zeros(len(first), np.int64)
        sizes = ends - starts
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        flat = self.raw[np.repeat(starts - offsets[:-1], sizes) + np.arange(offsets[-1])]
        told = pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(flat))
        wide = np.flatnonzero(gaps != words - 1)
        if not len(wide):
            return told
        # Words that stand farther apart than one space.
        shown = told.to_pylist()
        for i in wide.tolist():
            shown[i] = " ".join(shown[i].split(" ")) if "  " not in shown[i] else " ".join(w for w in shown[i].split(" ") if w)
        return pa.array(shown, pa.string())


def grouped(keys: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first place of each distinct pair of key and check, and how often it is there."""
    order = np.argsort(keys, kind="stable")
    k, c = keys[order], checks[order]
    new = k[1:] != k[:-1]
    if (c[1:] != c[:-1])[~new].any():
        order = np.lexsort((checks, keys))
        k, c = keys[order], checks[order]
        new = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
    starts = np.flatnonzero(np.concatenate([[True], new])) if len(k) else np.empty(0, np.int64)
    return order[starts], np.diff(np.append(starts, len(k)))


class Bitmap:
    """A set of keys: no key of the set is denied, others are let through at times."""

    def __init__(self, bits: int, raw: bytes):
        self.mask, self.bytes = np.uint64(bits - 1), np.frombuffer(raw, np.uint8)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        out = np.empty(len(keys), bool)
        for a in range(0, len(keys), SORTED):
            at = keys[a : a + SORTED] & self.mask
            out[a : a + SORTED] = (self.bytes[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return out


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and how often each is there; sorted in parts of bounded size."""
    parts = 1 << max(0, (len(keys) // SORTED).bit_length())
    found = []
    for p in range(parts):
        own = np.sort(keys if parts == 1 else keys[(keys >> np.uint64(64 - (parts - 1).bit_length())) == p])
        starts = np.flatnonzero(np.concatenate([own[:1] == own[:1], own[1:] != own[:-1]]))
        found.append((own[starts], np.diff(np.append(starts, len(own)))))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def mined(keys: np.ndarray, piece: np.ndarray, frequent: np.ndarray, pairs: Bitmap | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys and counts of all pairs of frequent words; with ``pairs``, of all phrases of three and four words that hold such pairs alone."""
    at = np.flatnonzero(frequent[:-1] & frequent[1:] & (piece[:-1] == piece[1:])).astype(np.int32)
    heads = joined(keys[at], keys[at + 1])
    if pairs is None:
        yield counted(heads)
        return
    fit = pairs.holds(heads)
    at, heads = at[fit], heads[fit]
    for words in range(3, LONGEST + 1):
        # A longer phrase is one that starts with it, and one that starts a word later.
        begins = np.zeros(len(keys) + 1, bool)
        begins[at] = True
        longer = begins[at + 1]
        at, heads = at[longer], heads[longer]
        heads = joined(heads, keys[at + words - 1])
        yield counted(heads)


def _buffers(batches, most: int) -> Iterator[tuple[str, Words]]:
    """The words of the texts of each language, so many bytes at a time."""
    waiting: dict[str, list[bytes]] = {}
    size = 0
    for part in (batch.slice(at, UNPACKED) for batch in batches for at in range(0, batch.num_rows, UNPACKED)):
        for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
            waiting.setdefault(lang, []).append(text)
            size += len(text)
            if size > most:
                yield from ((x, Words(b"\n".join(texts))) for x, texts in waiting.items())
                waiting, size = {}, 0
    yield from ((x, Words(b"\n".join(texts))) for x, texts in waiting.items())


def _stretches(batches) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """Language, keys and pieces of the words of as many buffers as are mined at a time."""
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    n = 0

    def whole() -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
        for lang in list(held):
            parts = held.pop(lang)
            # Pieces of different buffers are different pieces.
            offset = np.cumsum([0, *[int(p[-1]) + 1 for _, p in parts[:-1]]]).astype(np.int32)
            yield lang, np.concatenate([k for k, _ in parts]), np.concatenate([p + o for (_, p), o in zip(parts, offset, strict=True)])

    for lang, words in _buffers(batches, MINED):
        if len(words.keys):
            held.setdefault(lang, []).append((words.keys, words.piece))
            n += len(words.keys)
        if n >= STRETCH:
            yield from whole()
            n = 0
    yield from whole()


def _rows(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    lang, text = F.coalesce(docs[lang_col].cast("string"), F.lit("und")), docs[text_col].cast("binary")
    return docs.select(lang.alias("lang"), text.alias("text")).where("text is not null and length(text) > 0")


def _batches(lang: str, **columns) -> Iterator[pa.RecordBatch]:
    """Columns of one length, or single values that hold for all rows, as batches of bounded size."""
    n = max(len(c) for c in columns.values() if isinstance(c, pa.Array))
    whole = [pa.repeat(pa.scalar(lang, pa.string()), n), *[c if isinstance(c, pa.Array) else pa.repeat(c, n) for c in columns.values()]]
    batch = pa.RecordBatch.from_arrays(whole, names=["lang", *columns])
    return (batch.slice(at, SENT) for at in range(0, n, SENT))


def bitmap(keys: DataFrame) -> tuple[int, bytes]:
    """The bitmap of a column ``key``, put together from parts that tasks write; at most MOST_BITS / 8 bytes reach the driver."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (SPARSE * keys.count()).bit_length()))
    part = min(bits, PART_BITS)

    def write(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(part, bool)
        out[frame["at"].to_numpy()] = True
        return pd.DataFrame({"nth": [key[0]], "raw": [np.packbits(out, bitorder="little").tobytes()]})

    at = F.col("key").bitwiseAND(F.lit(bits - 1).cast("long"))
    dealt = keys.select(at.alias("at")).distinct().select(F.floor(F.col("at") / part).alias("nth"), (F.col("at") % part).alias("at"))
    out = np.zeros(bits // 8, np.uint8)
    for row in dealt.groupBy("nth").applyInPandas(write, "nth long, raw binary").toLocalIterator():
        out[row["nth"] * part // 8 : (row["nth"] + 1) * part // 8] = np.frombuffer(row["raw"], np.uint8)
    return bits, out.tobytes()


def word_counts(rows: DataFrame) -> DataFrame:
    """``lang, shard, word, key, f``: every word of a language, and without a word the number of all words of each shard."""

    def run(batches):
        shard = TaskContext.get().partitionId() % SHARDS
        for lang, w in _buffers(batches, BUFFER):
            if len(w.keys):
                first, counts = grouped(w.keys, w.checks())
                yield from _batches(lang, shard=pa.scalar(None, pa.int32()), word=w.texts(first, 1), key=pa.array(w.keys[first].view(np.int64)), f=pa.array(counts, pa.int64()))
                yield from _batches(lang, shard=pa.scalar(shard, pa.int32()), word=pa.scalar(None, pa.string()), key=pa.scalar(None, pa.int64()), f=pa.array([len(w.keys)], pa.int64()))

    return rows.mapInArrow(run, "lang string, shard int, word string, key long, f long").groupBy("lang", "shard", "word").agg(F.first("key").alias("key"), F.sum("f").alias("f"))


def shares_of(sizes: list[tuple[str, int, int]], support: int) -> dict[str, dict[int, int]]:
    """Each shard's share of the support, by language, from (language, shard, words): a phrase with the support has it in some shard.

    That holds of any numbers of which each less one add up to less than the support, however rows are dealt to shards afterwards; these do."""
    total: dict[str, int] = {}
    for lang, _, n in sizes:
        total[lang] = total.get(lang, 0) + n
    out: dict[str, dict[int, int]] = {lang: {} for lang in total}
    for lang, shard, n in sizes:
        out[lang][shard] = -(-support * n // total[lang])
    return out


def candidates(rows: DataFrame, shares: dict[str, dict[int, int]], frequent: tuple[int, bytes], pairs: tuple[int, bytes] | None, support: int) -> DataFrame:
    """``lang, key``: phrases that may have the support, by what each shard holds at its share of it: pairs, or longer ones of these pairs."""
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast((frequent, pairs))

    def run(batches):
        known, fit = (b and Bitmap(*b) for b in sent.value)
        shard = TaskContext.get().partitionId() % SHARDS
        for lang, keys, piece in _stretches(batches):
            least = shares.get(lang, {}).get(shard, 1)
            for found, counts in mined(keys, piece, known.holds(keys), fit):
                yield from _batches(lang, shard=pa.scalar(shard, pa.int32()), least=pa.scalar(least, pa.int32()), key=pa.array(found.view(np.int64)), f=pa.array(counts, pa.int64()))

    told = rows.mapInArrow(run, "lang string, shard int, least int, key long, f long").groupBy("lang", "shard", "key").agg(F.sum("f").alias("f"), F.first("least").alias("least"))
    over = told.where("f >= least").groupBy("lang", "key").agg(F.sum(F.col("f") - F.col("least") + 1).alias("over"))
    # What all shards of a language together may hold without reporting it.
    silent = spark.createDataFrame([(lang, sum(x - 1 for x in of.values())) for lang, of in shares.items()], "lang string, silent long")
    return durable(over.join(silent, "lang").where(F.col("over") + F.col("silent") >= support).select("lang", "key"))


def phrase_counts(rows: DataFrame, frequent: tuple[int, bytes], chosen: tuple[int, bytes]) -> DataFrame:
    """``lang, phrase, words, a``: exact counts of all phrases that the bitmap holds."""
    sent = rows.sparkSession.sparkContext.broadcast((frequent, chosen))

    def run(batches):
        known, wanted = (Bitmap(*b) for b in sent.value)
        for lang, w in _buffers(batches, BUFFER):
            keys, n = w.keys, len(w.keys)
            checks, fine = w.checks(), known.holds(keys)
            at = np.flatnonzero(fine[:-1] & fine[1:] & (w.piece[:-1] == w.piece[1:])) if n > 1 else np.empty(0, np.int64)
            heads, marks = keys.copy(), checks.copy()
            for words in range(2, LONGEST + 1):
                phrase = joined(heads[at], keys[at + words - 1])
                fit = wanted.holds(phrase)
                at, phrase = at[fit], phrase[fit]
                if not len(at):
                    break
                mark = joined(marks[at], checks[at + words - 1])
                first, counts = grouped(phrase, mark)
                yield from _batches(lang, phrase=w.texts(at[first], words), words=pa.scalar(words, pa.int32()), a=pa.array(counts, pa.int64()))
                heads[at], marks[at] = phrase, mark
                at = at[at + words < n]
                at = at[w.piece[at] == w.piece[at + words]]

    return rows.mapInArrow(run, "lang string, phrase string, words int, a long").groupBy("lang", "phrase", "words").agg(F.sum("a").alias("a"))


def scored(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """``lang, phrase, words, a, l, r, score``: each phrase at its weakest cut; ``words`` has ``lang, phrase, a`` of single words."""
    known = phrases.select("lang", "phrase", "a").union(words.select("lang", "phrase", "a"))
    cut = phrases.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("words") - 1))).withColumn("w", F.split("phrase", " "))
    cut = cut.select("lang", "phrase", "words", "a", "cut", F.array_join(F.slice("w", F.lit(1), F.col("cut")), " ").alias("head"), F.array_join(F.slice("w", F.col("cut") + 1, F.col("words")), " ").alias("tail"))
    heads, tails = known.select("lang", F.col("phrase").alias("head"), F.col("a").alias("l")), known.select("lang", F.col("phrase").alias("tail"), F.col("a").alias("r"))
    both = cut.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"])
    score = F.expr("cast((cast(a as decimal(20,0)) * 2000000) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0))) as bigint)")
    weakest = both.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("m"))
    return weakest.select("lang", "phrase", "words", "a", "m.l", "m.r", "m.score")


def outlived(phrases: DataFrame, share: int = 80) -> DataFrame:
    """The phrases that don't lie inside a longer one with ``100 * f(longer) >= share * f``."""
    longer = phrases.where("words > 2").select("lang", "words", F.split("phrase", " ").alias("w"), F.col("a").alias("longer"))
    inner = longer.withColumn("size", F.explode(F.sequence(F.lit(2), F.col("words") - 1))).withColumn("at", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)))
    most = inner.select("lang", F.array_join(F.slice("w", F.col("at"), F.col("size")), " ").alias("phrase"), "longer").groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    swallowed = F.expr(f"cast(longer as decimal(20,0)) * 100 >= cast(a as decimal(20,0)) * {share}")
    return phrases.join(most, ["lang", "phrase"], "left").where(F.col("longer").isNull() | ~swallowed).drop("longer")


def collocations(docs: DataFrame, support: int = 30, most: int = 2000, share: int = 80, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's best phrases of 2 to 4 words that occur ``support`` times or more."""
    rows = _rows(docs, lang_col, text_col)
    every = durable(word_counts(rows))
    totals = durable(every.where("word is null").groupBy("lang").agg(F.sum("f").alias("n")))
    # A number for each language and shard.
    shares = shares_of([(r["lang"], r["shard"], r["f"]) for r in every.where("word is null").collect()], support)
    words = every.where((F.col("f") >= support) & F.col("word").isNotNull())
    frequent = bitmap(words)
    pairs = candidates(rows, shares, frequent, None, support)
    longer = candidates(rows, shares, frequent, bitmap(pairs), support)
    may = pairs.union(longer)
    phrases = durable(phrase_counts(rows, frequent, bitmap(may)).where(F.col("a") >= support))
    best = durable(scored(phrases, words.select("lang", F.col("word").alias("phrase"), F.col("f").alias("a"))))
    kept = outlived(best, share).withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # Each share of a language gives its own best first, so that no task ranks a whole language.
    near = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= most)
    top = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= most)
    result = durable(top.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))
    for done in (every, totals, pairs, longer, phrases, best):
        discard(done)
    return result
