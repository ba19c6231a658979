"""Faceted search over match records: OR within a facet, AND across facets; compositions ask for every member."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import normalized_name


def _names(values) -> Column:
    return F.array(*[normalized_name(F.lit(v)) for v in values])


def filter_matches(records: DataFrame, selections: dict[str, set]) -> DataFrame:
    """Newest first, records without a time last. Weapons are compared by their normalized names."""
    out = records
    for facet, column in (("stages", "stage"), ("rules", "rule"), ("outcomes", "outcome")):
        if selections.get(facet):
            out = out.where(F.col(column).isin(*selections[facet]))
    if chosen := selections.get("self_weapons"):
        out = out.where(F.array_contains(_names(chosen), normalized_name(F.col("self_weapon"))))
    own = lambda c: F.transform(F.coalesce(c, F.array().cast("array<string>")), normalized_name)
    if chosen := selections.get("opponent_weapons"):
        out = out.where(F.arrays_overlap(own(F.col("enemy_weapons")), _names(chosen)))
    for facet, column in (("ally_compositions", "ally_weapons"), ("enemy_compositions", "enemy_weapons")):
        if chosen := selections.get(facet):
            out = out.where(F.size(F.array_except(_names(chosen), own(F.col(column)))) == 0)
    return out.orderBy(F.col("recorded_at").desc_nulls_last(), "id")


def dimension_values(records: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    """``facet, value``: the distinct values of every facet, with those of a catalog (``facet, value``), in collation order."""
    parts = [records.select(F.lit(f).alias("facet"), F.col(c).alias("value")) for f, c in (("stages", "stage"), ("rules", "rule"), ("self_weapons", "self_weapon"))]
    parts.append(records.select(F.lit("opponent_weapons").alias("facet"), F.explode("enemy_weapons").alias("value")))
    if catalog is not None:
        parts.append(catalog.select("facet", "value"))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.where("value is not null and value <> ''").distinct().orderBy("facet", F.collate("value", "ja"))


def catalog_match(names: DataFrame, catalog: DataFrame, name: str = "name") -> DataFrame:
    """Each name with its catalog entry: the equal one, else the only one that contains it or is contained, normalized.

    The catalog is a dimension of at most a few hundred rows; it is collected to an array behind a check of its size."""
    held = catalog.select(name, "type", normalized_name(F.col(name)).alias("norm")).limit(10_001).collect()
    if len(held) > 10_000:
        raise ValueError("a catalog holds at most 10,000 names")
    entries = F.array(*[F.struct(F.lit(r[0]).alias("name"), F.lit(r[1]).alias("type"), F.lit(r[2]).alias("norm")) for r in held])
    own = normalized_name(F.col(name))
    same = F.filter(entries, lambda e: e["name"] == F.col(name))
    near = F.filter(entries, lambda e: F.contains(e["norm"], own) | F.contains(own, e["norm"]))
    picked = F.when(F.size(same) > 0, F.get(same, 0)).when(F.size(near) == 1, F.get(near, 0))
    return names.withColumn("entry", picked).select("*", F.col("entry.name").alias("catalog_name"), F.coalesce("entry.type", F.lit("その他")).alias("type")).drop("entry")
