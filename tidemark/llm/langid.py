"""Language identification by error-correcting output codes.

Every language gets a binary codeword. For each bit a binary classifier on hashed byte n-grams (naive Bayes log odds)
tells the languages with a 1 there from those with a 0. A text's bit margins are decoded to the codeword of least
weighted loss, a bit's weight being what its classifier got right on rows kept back from its fit; where the second-best
codeword is near, the text is flagged ambiguous.

The classifiers are fitted on a bounded sample of labelled rows (``sample``, and ``least`` of each language), drawn by a hash. Defined cases:
a null text, or one without any letter, is ``und`` with score 0; with no labelled rows every text is ``und``; with one
language every text with a letter gets it; repeated rows are predicted alike; further columns are left alone.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import durable, held_out

#: Labelled rows that the classifiers are fitted on, at most about so many.
SAMPLE = 12_000
#: And so many of each language at least.
LEAST = 200
BUCKETS = 1 << 15
GRAMS = (2, 3, 4)
#: Languages up to this many get every distinct bit there is; more get random codewords of 12 bits for each doubling.
EXHAUSTIVE = 6
UNKNOWN = "und"

_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def grams(text: str) -> np.ndarray:
    """Buckets of all byte n-grams of a text, lower-cased, with other ASCII characters as spaces."""
    raw = np.frombuffer(b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_PLAIN).split()) + b" ", np.uint8).astype(np.uint32)
    out = []
    for n in GRAMS:
        if len(raw) < n:
            continue
        key = np.full(len(raw) - n + 1, n, np.uint32)
        for k in range(n):
            key = key * np.uint32(0x01000193) ^ raw[k : len(raw) - n + 1 + k]
        key *= np.uint32(0x9E3779B1)
        out.append(key >> np.uint32(32 - BUCKETS.bit_length() + 1))
    return np.concatenate(out) if out else np.empty(0, np.uint32)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def codewords(n: int) -> np.ndarray:
    """A row of +1/-1 for each of n languages: all splits in two for few, else random columns with rows far apart."""
    if n < 2:
        return np.ones((n, 1))
    if n <= EXHAUSTIVE:
        splits = [s for size in range(1, n) for s in combinations(range(n), size) if 0 in s]
        return np.array([[1.0 if i in s else -1.0 for s in splits] for i in range(n)])
    rng, bits, best, far = np.random.default_rng(n), 12 * int(np.ceil(np.log2(n))), None, -1.0
    for _ in range(50):
        code = rng.choice([-1.0, 1.0], (n, bits))
        apart = ((bits - code @ code.T) / 2 + bits * np.eye(n)).min()
        if apart > far and (np.abs(code.sum(axis=0)) < n).all():
            best, far = code, apart
    return best


class CodeModel:
    """Codewords, a weight for each bucket and bit, and a weight for each bit."""

    def __init__(self, counts: dict[str, np.ndarray]):
        self.languages = sorted(counts)
        self.code = codewords(len(self.languages))
        share = np.array([(counts[k] + 0.5) / (counts[k] + 0.5).sum() for k in self.languages]) if counts else np.empty((0, BUCKETS))
        odds = [np.log(share[self.code[:, b] > 0].mean(axis=0)) - np.log(share[self.code[:, b] < 0].mean(axis=0)) for b in range(self.code.shape[1])] if len(counts) > 1 else [np.zeros(BUCKETS)]
        self.odds = np.ascontiguousarray(np.array(odds).T, dtype=np.float32)
        self.bit_weight = np.ones(self.odds.shape[1])

    def margins(self, text: str) -> np.ndarray:
        """Mean log odds of the text's n-grams for each bit."""
        found = grams(text)
        return np.add.reduce(self.odds[found], axis=0, dtype=np.float64) / max(1, len(found)) if len(found) else np.zeros(self.odds.shape[1])

    def weigh(self, margins: np.ndarray, language: np.ndarray) -> None:
        """Bits count by how often they were right on kept-back rows."""
        right = (np.sign(margins) == self.code[language]).mean(axis=0) if len(margins) else np.ones(self.odds.shape[1])
        self.bit_weight = np.log((right + 0.01) / (1.01 - right)).clip(0.05)
        self.bit_weight /= self.bit_weight.sum()

    def decode(self, margins: np.ndarray, sharp: float = 8.0) -> tuple[int, float, bool]:
        """The language of least weighted logistic loss, its share among all, and whether another is near."""
        if len(self.languages) == 1:
            return 0, 1.0, False
        loss = (np.logaddexp(0, -sharp * self.code * margins) * self.bit_weight).sum(axis=1)
        share = np.exp(-4 * (loss - loss.min()))
        share /= share.sum()
        best = int(loss.argmin())
        return best, float(share[best]), bool(np.sort(share)[-2] > 0.5 * share[best])


def fit(rows: DataFrame) -> CodeModel:
    """From stored, bounded rows ``lang, text, check`` (check: kept back to weigh the bits)."""

    def count(batches):
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(lang, np.zeros(BUCKETS, np.int64))
                held[lang] += np.bincount(grams(text), minlength=BUCKETS)
        for lang, counts in held.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["lang", "bucket", "n"])

    sums = rows.where("not check").select("lang", "text").mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = {lang: np.bincount(g["bucket"], weights=g["n"], minlength=BUCKETS) for lang, g in sums.groupby("lang")}
    model = CodeModel(counts)
    if len(counts) > 1:
        sent = rows.sparkSession.sparkContext.broadcast(model)
        at = {k: i for i, k in enumerate(model.languages)}

        def weigh(batches):
            for batch in batches:
                pairs = [(at[g], sent.value.margins(t).tolist()) for g, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if g in at]
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int32()), pa.array([p[1] for p in pairs], pa.list_(pa.float64()))], names=["lang", "margins"])

        checked = rows.where("check").select("lang", "text").mapInArrow(weigh, "lang int, margins array<double>").toPandas()
        if len(checked):
            model.weigh(np.array(checked["margins"].tolist()), checked["lang"].to_numpy())
    return model


def learned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, least: int = LEAST) -> CodeModel:
    """Fit on rows with a language and a letter that aren't held out (id's crc32 modulo 5 is not 0).

    Each language gives its share of ``sample``, but ``least`` rows where it has them: a rare language is learned as well."""
    rows = docs.select(docs[id_col].alias("id"), docs[lang_col].alias("lang"), docs[text_col].alias("text")).where("lang is not null and text is not null").where(~held_out(F.col("id"), 5, 0))
    rows = rows.where(F.col("text").rlike(r"\p{L}"))
    scale = 1 << 30
    mixed = F.pmod(F.xxhash64("id", F.xxhash64("text")), F.lit(scale))
    sizes = docs.where(F.col(lang_col).isNotNull() & docs[text_col].isNotNull() & ~held_out(docs[id_col], 5, 0)).groupBy(F.col(lang_col).alias("of")).agg(F.count("*").alias("n"))
    quota = F.greatest(F.lit(float(least)), F.lit(float(sample)) * F.col("n") / F.sum("n").over(Window.partitionBy()))
    sizes = durable(sizes.select("of", F.least(F.lit(1.0), quota / F.col("n")).alias("share")))
    drawn = rows.join(sizes, F.col("lang") == F.col("of")).where(mixed <= (F.col("share") * scale).cast("long"))
    check = F.pmod(F.xxhash64(F.lit("check"), "id", F.xxhash64("text")), F.lit(5)) == 0
    return fit(durable(drawn.select("lang", "text", check.alias("check"))))


def identify(docs: DataFrame, model: CodeModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, lang_pred, score, ambiguous`` for every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value
        for batch in batches:
            rows = [m.decode(m.margins(t)) if t and m.languages and has_letter(t) else (-1, 0.0, True) for t in batch.column(1).to_pylist()]
            names = [m.languages[k] if k >= 0 else UNKNOWN for k, _, _ in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array([r[1] for r in rows], pa.float64()), pa.array([r[2] for r in rows], pa.bool_())], names=["id", "lang_pred", "score", "ambiguous"])

    picked = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    schema = T.StructType([T.StructField("id", picked.schema["id"].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())])
    return picked.mapInArrow(run, schema).withColumnRenamed("id", id_col)
