"""Metric by dimension over match records: a frozen spec becomes one lazy DataFrame plan.

Nulls follow the documented rule: a record without a value is left out of that metric's numerator and denominator. A blank
filter value means no predicate. Global and card filters are two filters, which the optimizer merges and pushes down.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import DEATH_BUCKETS, DISADVANTAGE_BUCKETS, bucket, outcome_name, ratio

METRICS = {
    "matchCount": "count", "winRate": "percent", "lossRate": "percent", "averageKills": "decimal", "averageDeaths": "decimal", "kdRatio": "ratio",
    "averageDisadvantage": "seconds", "averageAdvantage": "seconds", "averageDuration": "seconds", "rosterCoverage": "percent",
}
DIMENSIONS = ["none", "day", "stage", "rule", "selfWeapon", "opponentWeapon", "outcome", "deathBucket", "disadvantageBucket"]
NATURAL = ["day", "deathBucket", "disadvantageBucket", "outcome"]
TOP = {"bar": 12, "line": 18, "donut": 5}


@dataclass(frozen=True)
class QuerySpec:
    metric: str = "winRate"
    dimension: str = "none"
    minimum_samples: int = 1
    sort: str = "auto"
    chart: str = "bar"
    filters: dict = field(default_factory=dict)


def _given(value) -> bool:
    return value is not None and value != ""


def day_of(records: DataFrame) -> Column:
    return F.date_format("recorded_at", "yyyy-MM-dd")


def filter_records(records: DataFrame, filters: dict | None = None, now: datetime | None = None) -> DataFrame:
    """All given predicates together. ``period_days`` counts back from ``now``, which must be given with it."""
    f, out = filters or {}, records
    if _given(f.get("period_days")) and float(f["period_days"]) > 0:
        if now is None:
            raise ValueError("period_days needs now")
        out = out.where(F.col("recorded_at") >= F.lit(now) - F.make_dt_interval(secs=F.lit(float(f["period_days"]) * 86400)))
    for name, column in (("outcome", "outcome"), ("stage", "stage"), ("rule", "rule"), ("self_weapon", "self_weapon")):
        if _given(f.get(name)):
            out = out.where(F.col(column) == f[name])
    if _given(f.get("date_from")):
        out = out.where(day_of(out) >= f["date_from"])
    if _given(f.get("date_to")):
        out = out.where(day_of(out) <= f["date_to"])
    if _given(f.get("opponent_weapon")):
        out = out.where(F.array_contains("enemy_weapons", f["opponent_weapon"]))
    for name, column in (("deaths", "deaths"), ("disadvantage", "disadvantage_seconds")):
        if _given(f.get(f"{name}_min")):
            out = out.where(F.col(column) >= float(f[f"{name}_min"]))
        if _given(f.get(f"{name}_max")):
            out = out.where(F.col(column) <= float(f[f"{name}_max"]))
    if query := str(f.get("query") or "").strip():
        fields = F.concat_ws(" ", "recording_file_name", "stage", "rule", "outcome", "self_weapon", "enemy_weapons")
        out = out.where(F.contains(F.lower(fields), F.lower(F.lit(query))))
    return out


def summary() -> list[Column]:
    """All metrics of a group, in one aggregation."""
    decided = F.col("outcome").isin("win", "lose")
    pair = F.col("kills").isNotNull() & F.col("deaths").isNotNull()
    count = lambda c: F.count(F.when(c, 1))
    return [
        F.count("*").alias("matches"),
        count(decided).alias("decided"),
        count(F.col("outcome") == "win").alias("wins"),
        count(F.col("outcome") == "lose").alias("losses"),
        ratio(count(F.col("outcome") == "win"), count(decided)).alias("winRate"),
        ratio(count(F.col("outcome") == "lose"), count(decided)).alias("lossRate"),
        F.avg("kills").alias("averageKills"),
        F.avg("deaths").alias("averageDeaths"),
        ratio(F.sum(F.when(pair, F.col("kills"))), F.sum(F.when(pair, F.col("deaths")))).alias("kdRatio"),
        F.avg("disadvantage_seconds").alias("averageDisadvantage"),
        F.avg("advantage_seconds").alias("averageAdvantage"),
        F.avg("duration_seconds").alias("averageDuration"),
        ratio(count(F.size("enemy_weapons") > 0), F.count("*")).alias("rosterCoverage"),
    ]


def samples(metric: str) -> Column:
    """How many records of a group have a value for the metric."""
    held = {
        "winRate": F.col("outcome").isin("win", "lose"),
        "lossRate": F.col("outcome").isin("win", "lose"),
        "averageKills": F.col("kills").isNotNull(),
        "averageDeaths": F.col("deaths").isNotNull(),
        "kdRatio": F.col("kills").isNotNull() & F.col("deaths").isNotNull(),
        "averageDisadvantage": F.col("disadvantage_seconds").isNotNull(),
        "averageAdvantage": F.col("advantage_seconds").isNotNull(),
        "averageDuration": F.col("duration_seconds").isNotNull(),
    }.get(metric)
    return F.count("*") if held is None else F.count(F.when(held, 1))


def keyed(records: DataFrame, dimension: str) -> DataFrame:
    """One row for each distinct key of a record; records without a key are left out."""
    single = {
        "day": day_of(records), "stage": F.col("stage"), "rule": F.col("rule"), "selfWeapon": F.col("self_weapon"), "outcome": outcome_name(F.col("outcome")),
        "deathBucket": bucket(F.col("deaths"), DEATH_BUCKETS), "disadvantageBucket": bucket(F.col("disadvantage_seconds"), DISADVANTAGE_BUCKETS),
    }
    if dimension == "opponentWeapon":
        out = records.withColumn("key", F.explode(F.array_distinct("enemy_weapons")))
    else:
        out = records.withColumn("key", single.get(dimension, F.lit("全体")))
    return out.where("key is not null and key <> ''")


def ordered(groups: DataFrame, spec: QuerySpec) -> DataFrame:
    """Nulls last; ties by matches, then by key."""
    mode = ("natural" if spec.dimension in NATURAL else "desc") if spec.sort == "auto" else spec.sort
    key = F.collate("key", "ja")
    if mode == "natural":
        ranks = {name: i for names in (DEATH_BUCKETS, DISADVANTAGE_BUCKETS) for i, (name, _) in enumerate(names)} | {"WIN": 0, "LOSE": 1, "未取得": 2}
        place = F.coalesce(*[F.when(F.col("key") == k, i) for k, i in ranks.items()])
        return groups.orderBy(place.asc_nulls_last(), key)
    if mode == "asc":
        return groups.orderBy(F.col("value").asc_nulls_last(), F.desc("matches"), key)
    if mode == "matches":
        return groups.orderBy(F.desc("matches"), key)
    return groups.orderBy(F.col("value").desc_nulls_last(), F.desc("matches"), key)


def run_query(records: DataFrame, spec: QuerySpec, global_filters: dict | None = None, now: datetime | None = None) -> DataFrame:
    """``key, value, samples`` and the whole summary for each group; an unknown metric or dimension counts all matches."""
    metric = spec.metric if spec.metric in METRICS else "matchCount"
    dimension = spec.dimension if spec.dimension in DIMENSIONS else "none"
    chosen = filter_records(filter_records(records, global_filters, now), spec.filters, now)
    value = F.col("matches").cast("double") if metric == "matchCount" else F.col(metric)
    if dimension == "none":
        return chosen.agg(*summary(), samples(metric).alias("samples")).withColumn("value", value).withColumn("key", F.lit("全体"))
    groups = keyed(chosen, dimension).groupBy("key").agg(*summary(), samples(metric).alias("samples")).withColumn("value", value)
    return ordered(groups.where(F.col("samples") >= max(1, spec.minimum_samples or 1)), spec)


def chart(records: DataFrame, spec: QuerySpec, global_filters: dict | None = None, now: datetime | None = None) -> DataFrame:
    """The groups that a chart of the spec's kind shows."""
    groups = run_query(records, spec, global_filters, now)
    return groups.limit(TOP[spec.chart]) if spec.chart in TOP else groups


def members(records: DataFrame, spec: QuerySpec) -> DataFrame:
    """The records behind each group, a row each: what a drill-down reads. Nothing is collected into a group."""
    return keyed(filter_records(records, spec.filters), spec.dimension)


def cube_query(records: DataFrame, dimensions: list[str]) -> DataFrame:
    """The summary for every combination of dimensions and all their totals; ``grouping`` tells which are summed over."""
    out = records
    for i, d in enumerate(dimensions):
        out = keyed(out, d).withColumnRenamed("key", f"_key{i}")
    totals = out.cube(*[f"_key{i}" for i in range(len(dimensions))]).agg(F.grouping_id().alias("grouping"), *summary())
    return totals.withColumnsRenamed({f"_key{i}": d for i, d in enumerate(dimensions)})


def rollup_audit(records: DataFrame, by: str) -> DataFrame:
    """Per group and in total: records, those with stage, rule and outcome, and their share."""
    whole = F.col("stage").isNotNull() & F.col("rule").isNotNull() & F.col("outcome").isNotNull()
    return records.rollup(by).agg(F.grouping(by).cast("int").alias("is_total"), F.count("*").alias("records"), F.count(F.when(whole, 1)).alias("complete"), F.avg(whole.cast("double")).alias("coverage"))
