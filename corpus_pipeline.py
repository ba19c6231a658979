"""From raw documents to packed training sequences; each stage is written as Parquet and read back by the next.

quality      rows that the rule ensemble, learned from ``labels``, scores under 0.5 go
line_dedup   later copies of repeated line runs are deleted; a document of which nothing is left goes
near_dups    one document of each group of near-equal SimHash fingerprints stays, the one with the smallest id
secrets      every reported secret is masked in the text
packing      the texts are tokenized and packed in sequences of at most 2048 tokens

All but the last return the columns of ``documents``; ``n_chars`` follows the text. Two rows with one id and different texts are two
documents; rows that repeat an id and a text are copies. Of a group the smallest id stays, one without an id only where the whole group
has none. Null texts count as empty: they are scored as such, have no lines to delete, share fingerprint zero and pack an end token alone.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import line_dedup, packing, quality, secrets, simhash
from tidemark.llm.common import aside, discard, durable, table

VOCAB = "word_bpe_49k.json"
#: The near-dup stage's key as a stored table gives it back; of one type on both sides, it needs one shuffle for join and window.
KEY = "struct<unnamed: boolean, id: bigint, sha: string>"


def _measured(docs: DataFrame) -> DataFrame:
    """``n_chars`` of the text as it is now."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scored = quality.score(docs, table(spark, sf_dir, "labels"))
    return scored.where("predicted = 1").select(*docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    left = line_dedup.dedup_lines(docs)
    return _measured(left.where("n_deleted = 0 or n_deleted < n_lines").select(*docs.columns))


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # Texts are told apart by id and text together: an id may be repeated or null.
    plain, names = aside(docs)
    id_, text = F.col(names["doc_id"]), F.coalesce(names["text"], F.lit(""))
    keyed = plain.withColumn("_key", F.struct(id_.isNull().alias("unnamed"), F.coalesce(id_, F.lit(0)).alias("id"), F.sha2(text, 256).alias("sha")).cast(KEY))
    groups = simhash.near_duplicates(keyed, id_col="_key", text_col=names["text"])
    stays = groups.where("_key = component_id").select("_key").distinct()
    named = keyed.join(stays, "_key", "left_semi")
    nth = F.row_number().over(Window.partitionBy("_key").orderBy(F.xxhash64(*names.values())))
    return named.withColumn("_nth", nth).where("_nth = 1").select(*[F.col(n).alias(c) for c, n in names.items()])


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _measured(secrets.mask(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path(VOCAB))


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_dedup_stage),
    ("near_dups", near_dup_stage),
    ("secrets", secret_stage),
    ("packing", packing_stage),
]

#: No SQL can express the learned, hashed and tokenizing stages; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
        discard(before)
        before = docs
    packed = durable(STAGES[-1][1](spark, docs, sf_dir))
    discard(before)
    return packed
