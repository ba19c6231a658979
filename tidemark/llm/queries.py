"""The registered queries of the training-data operators, with their production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bond, bpe, collocations, knn_graph, langid, line_dedup, packing, pii, pivots, quality, secrets, sentencepiece, simhash
from tidemark.llm.common import held_out, table

VOCAB, PIECES = "word_bpe_49k.json", "piece_bpe_32k.model"
#: The key of the registered query; a user passes a secret of their own.
PII_KEY = "tidemark registered query"


def op1_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn_graph.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCAB))


def op3_simhash_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", "predicted")


def op5_line_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCAB))


def op7_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op8_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)


def op9_secret_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


def op10_langid_ecoc(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.learned(docs))
    return found.withColumn("held_out", held_out(F.col("doc_id"), 5, 0))


def op11_collocations_son(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def op13_bond_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return bond.hard_negatives(vectors.withColumn("label", moved), F.col("id") % 100 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_nn_descent, op2_bpe, op3_simhash_vptree, op4_quality_rules, op5_line_suffixes, op6_packing, op7_pivot_topk, op8_pii_surrogates, op9_secret_links, op10_langid_ecoc, op11_collocations_son, op12_sentencepiece, op13_bond_negatives)}


#: Exact top 5 by integer inner product, all rows against all queries.
TOPK_SQL = """
WITH v AS (
  SELECT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND NOT list_bool_or([x IS NULL OR NOT isfinite(x) FOR x IN embedding])
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

#: All rows against all anchors, by label and by window.
NEGATIVES_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND NOT list_bool_or([x IS NULL OR NOT isfinite(x) FOR x IN embedding])
), scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS other_id, a.label = c.label AS alike, list_dot_product(a.e, c.e)::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id AND len(a.e) = len(c.e)
), positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
), ranked AS (
  SELECT p.anchor_id, positive_id, positive_score, s.other_id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.other_id)::INTEGER AS rank
  FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.alike AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 5
"""

#: All phrases of all pieces, counted.
COLLOCATIONS_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), cut AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), sized AS (
  SELECT lang, w, unnest([1, 2, 3, 4]) AS words FROM cut WHERE len(w) > 0
), counted AS (
  SELECT lang, words, phrase, count(*) AS a FROM (SELECT lang, words, unnest([array_to_string(w[i : i + words - 1], ' ') FOR i IN range(1, len(w) - words + 2)]) AS phrase FROM sized)
  GROUP BY ALL
), totals AS (
  SELECT lang, sum(a)::BIGINT AS n FROM counted WHERE words = 1 GROUP BY lang
), candidates AS (
  SELECT *, string_split(phrase, ' ') AS w FROM counted WHERE words > 1 AND a >= 30
), cuts AS (
  SELECT lang, phrase, words, a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1 :], ' ') AS tail FROM (SELECT *, unnest(range(1, words)) AS k FROM candidates)
), scored AS (
  SELECT c.lang, c.phrase, c.words, c.a, h.a AS l, t.a AS r, (2000000::HUGEINT * c.a // (h.a + t.a))::BIGINT AS score
  FROM cuts c JOIN counted h ON h.lang = c.lang AND h.phrase = c.head JOIN counted t ON t.lang = c.lang AND t.phrase = c.tail
  QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY 2000000::HUGEINT * c.a // (h.a + t.a), c.k) = 1
), inner_phrases AS (
  SELECT lang, a, array_to_string(w[i : i + size - 1], ' ') AS phrase
  FROM (SELECT *, unnest(range(1, words - size + 2)) AS i FROM (SELECT *, unnest(range(2, words)) AS size FROM candidates))
), swallowed AS (
  SELECT lang, phrase, max(a) AS longer FROM inner_phrases GROUP BY ALL
), kept AS (
  SELECT s.* FROM scored s LEFT JOIN swallowed x USING (lang, phrase) WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * s.a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept JOIN totals USING (lang)
QUALIFY rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_line_suffixes": line_dedup.ORACLE, "op7_pivot_topk": TOPK_SQL, "op11_collocations_son": COLLOCATIONS_SQL, "op13_bond_negatives": NEGATIVES_SQL}
