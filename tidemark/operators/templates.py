"""Nearest templates: prototypes of labelled vectors and the closest of them to every row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Prototypes are held as a constant by every task up to this many labels.
MOST_LABELS = 2_000


def prototypes(vectors: DataFrame, label: str, vector: str) -> DataFrame:
    """The mean vector of each label."""
    each = vectors.select(label, F.posexplode(vector).alias("at", "x")).groupBy(label, "at").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return each.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("prototype"))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def bhattacharyya(a: Column, b: Column) -> Column:
    """Distance of two histograms, each of sum 1."""
    shared = F.aggregate(F.zip_with(a, b, lambda x, y: F.sqrt(x * y)), F.lit(0.0), lambda s, v: s + v)
    return F.sqrt(F.greatest(F.lit(0.0), 1 - shared))


def nearest_templates(vectors: DataFrame, templates: DataFrame, vector: str, label: str, k: int = 3) -> DataFrame:
    """Add ``nearest``: the k labels with the closest prototypes and their distances, of equals the smaller label."""
    held = templates.where(F.col(label).isNotNull()).orderBy(label).limit(MOST_LABELS + 1).collect()
    if len(held) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} templates; search them with a query set in blocks instead")
    own = F.transform(vector, lambda x: x.cast("double"))
    scored = [F.struct(F.sqrt(squared_distance(own, F.lit(r["prototype"]))).alias("distance"), F.lit(r[label]).alias("label")) for r in held]
    kind = templates.schema[label].dataType.simpleString()
    ranked = F.array(*scored).cast(f"array<struct<distance: double, label: {kind}>>")
    return vectors.withColumn("nearest", F.slice(F.array_sort(ranked), 1, k))
