"""Quality classifier as a sparse rule ensemble.

Shallow trees are grown on statistics of labelled texts; every path from a root to a node is a conjunctive rule. A
logistic model with lasso penalty weighs the rules and drops most of them. What stays is compiled to one Spark column
over the statistics, so scoring is a projection.

The model is fitted on a bounded sample of labelled rows (``sample``), drawn by a hash of the id. Labels, language,
source and id never enter a score. Defined cases: null and empty texts are scored on their statistics like any other;
labels that are null or not 0/1, and labels of ids without a document, are left out; a repeated label counts once; where no labels or one class only
remain, every score is the share of label 1 (0.5 without labels); repeated rows score alike.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import islice
from operator import eq

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler, VectorSizeHint
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import aside, durable, held_out

#: Labelled rows that the trees and weights are fitted on, at most about so many.
SAMPLE = 20_000
TREES, DEPTH, LASSO = 30, 4, 0.0003

#: A condition (statistic, at most?, bound); a rule is a set of them.
Rule = frozenset

#: The statistics, and the ASCII characters that some of them count.
NAMES = ["log_words", "word_chars", "symbols", "shouts", "bars", "capitals", "repeats", "distinct", "ends", "commas", "digits", "lines"]
_AT = {n: [ord(c) for c in chars] for n, chars in {"symbols": "#$%&*+/<=>@[\\]^_`{}~", "shouts": "!", "bars": "|", "ends": ".?", "commas": ",;:", "digits": "0123456789", "lines": "\n", "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": "abcdefghijklmnopqrstuvwxyz"}.items()}


def measure(text: str | None) -> tuple[float, ...]:
    """Statistics of a whole text in the order of NAMES, none of which grows with its length."""
    words = (text or "").split()
    n = max(1, len(words))
    held = np.bincount(np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8), minlength=256)
    of = {k: int(held[at].sum()) for k, at in _AT.items()}
    return (
        math.log(n),
        len(text or "") / n,
        of["symbols"] / n,
        of["shouts"] / n,
        of["bars"] / n,
        of["upper"] / max(1, of["upper"] + of["lower"]),
        sum(map(eq, words, islice(words, 1, None))) / n,
        len(set(words)) / n,
        of["ends"] / n,
        of["commas"] / n,
        of["digits"] / n,
        of["lines"] / n,
    )


@F.pandas_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in NAMES]))
def statistics(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([measure(t) for t in texts], columns=NAMES, dtype="float64")


def _paths(node, at: Rule, out: set) -> None:
    """The conjunctions on the way to every node below ``node``."""
    if node.numDescendants() == 0:
        return
    name, bound = NAMES[node.split().featureIndex()], node.split().threshold()
    for child, low in ((node.leftChild(), True), (node.rightChild(), False)):
        rule = frozenset([*at, (name, low, bound)])
        out.add(rule)
        _paths(child, rule, out)


def _holds(rule: Rule) -> Column:
    return reduce(lambda a, b: a & b, [F.col(n) <= b if low else F.col(n) > b for n, low, b in sorted(rule)])


def flagged(rows: DataFrame, label: str, rules: list[Rule]) -> DataFrame:
    """``rules`` (a vector, 1 where the rule at that place holds) and the label of rows of statistics.

    The flags are worked out in bulk, as one array: with a column for each of some hundred rules the driver compiles half a
    million characters of generated code, in hundreds of MB."""
    conditions = sorted({c for r in rules for c in r})
    at = {c: i for i, c in enumerate(conditions)}
    sets = [[at[c] for c in r] for r in rules]

    @F.pandas_udf(T.ArrayType(T.ByteType()))
    def flags(stats: pd.DataFrame) -> pd.Series:
        met = np.array([(stats[n].to_numpy() <= bound) == low for n, low, bound in conditions])
        return pd.Series(list(np.array([met[s].all(axis=0) for s in sets], np.int8).T.copy()))

    arrays = rows.select(label, array_to_vector(flags(F.struct(*NAMES)).cast("array<double>")).alias("flags"))
    sized = VectorSizeHint(inputCol="flags", size=len(rules)).transform(arrays)
    # The assembler stores each vector sparse or dense, whichever is smaller.
    return VectorAssembler(inputCols=["flags"], outputCol="rules").transform(sized).select("rules", label)


def fit(labelled: DataFrame, label: str = "label", trees: int = TREES, depth: int = DEPTH, lasso: float = LASSO) -> tuple[float, list[tuple[Rule, float]]]:
    """Intercept and weighted rules from rows of statistics with a 0/1 label. ``labelled`` is bounded and stored."""
    share = labelled.agg(F.avg(label), F.count("*")).first()
    if share[0] is None or share[0] in (0.0, 1.0):
        return (0.0 if share[0] is None else 30.0 if share[0] == 1.0 else -30.0), []
    rows = VectorAssembler(inputCols=NAMES, outputCol="statistics").transform(labelled).select("statistics", label, *NAMES).coalesce(4).cache()
    forest = RandomForestClassifier(featuresCol="statistics", labelCol=label, numTrees=trees, maxDepth=depth, seed=7, subsamplingRate=0.7).fit(rows)
    found: set = set()
    for tree in forest.trees:
        _paths(tree._java_obj.rootNode(), frozenset(), found)
    rules = sorted(found, key=sorted)
    if not rules:
        rows.unpersist()
        return math.log(share[0] / (1 - share[0])), []
    vectors = flagged(rows, label, rules).cache()
    model = LogisticRegression(featuresCol="rules", labelCol=label, elasticNetParam=1.0, regParam=lasso, standardization=False, maxIter=60, tol=1e-5).fit(vectors)
    weights = [(r, float(w)) for r, w in zip(rules, model.coefficients.toArray(), strict=True) if abs(w) > 1e-9]
    rows.unpersist()
    vectors.unpersist()
    return float(model.intercept), weights


def compiled(intercept: float, weights: list[tuple[Rule, float]]) -> Column:
    """The model as one column over the statistics, from 0 to 1."""
    total = reduce(lambda a, b: a + b, [F.when(_holds(r), F.lit(w)).otherwise(F.lit(0.0)) for r, w in weights], F.lit(intercept))
    return 1.0 / (1.0 + F.exp(-total))


def learned(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Column:
    """Fit on the labelled rows that aren't held out (id's crc32 modulo 3 is not 1); the score as a column over statistics."""
    marks = labels.where(F.col(label_col).isin(0, 1) & ~held_out(F.col(id_col), 3, 1)).select(F.col(id_col).alias("_id"), F.col(label_col).cast("double").alias("label")).distinct()
    scale = 1 << 30
    share = min(1.0, sample / max(1, marks.count()))
    drawn = marks.where(F.pmod(F.xxhash64("_id"), F.lit(scale)) <= int(share * scale))
    texts = docs.select(docs[id_col].alias("_doc"), docs[text_col].alias("_text"))
    # An id has two labels at most, so the sample holds about twice ``sample`` rows at most and can be broadcast to the texts.
    met = texts.join(F.broadcast(drawn), F.col("_doc") == F.col("_id")).select("label", statistics("_text").alias("_s")).select("label", "_s.*")
    return compiled(*fit(durable(met)))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """The documents with ``score`` (0 to 1, higher: label 1 likelier) and ``predicted``; further columns stay."""
    model = learned(docs, labels, id_col, text_col, label_col, sample)
    plain, clash = aside(docs)
    scored = plain.withColumn("_s", statistics(clash[text_col])).select(*clash.values(), "_s.*").withColumn("_score", model)
    return scored.select(*[F.col(n).alias(c) for c, n in clash.items() if c not in ("score", "predicted")], F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))
