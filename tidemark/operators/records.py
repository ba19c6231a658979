"""The one-row-per-match store: effective records, override logs, checks of rows that come from outside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import blank_to_null, clamp, half_up

OVERRIDABLE = ["stage", "rule", "outcome", "self_weapon"]


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last version of each key: what is left of an upsert log."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(*keys, "_row.*")


def write_overrides(log: DataFrame) -> DataFrame:
    """From ``id, field, value, seq`` to one map per id: the last value of each field counts, a blank one deletes it.

    A death count is cut to 0..99 and rounded."""
    last = log.groupBy("id", "field").agg(F.max_by(F.struct("value"), F.struct("seq")).alias("v"))
    number = half_up(clamp(F.col("v.value").try_cast("double"), 0, 99)).cast("string")
    value = F.when(F.col("field") == "death_count", number).otherwise(blank_to_null(F.col("v.value")))
    kept = last.select("id", "field", value.alias("value")).where("value is not null")
    return kept.groupBy("id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("field", "value")))).alias("overrides"))


def effective(automatic: DataFrame, overrides: DataFrame, fields: list[str] = OVERRIDABLE) -> DataFrame:
    """Records with overridden fields on top, the names of those fields, and whether stage, rule and outcome are all known."""
    met = automatic.join(overrides.select("id", "overrides"), "id", "left")
    given = lambda f: F.coalesce(F.map_contains_key("overrides", F.lit(f)), F.lit(False))
    out = met.withColumns({f: F.when(given(f), F.try_element_at("overrides", F.lit(f))).otherwise(F.col(f)) for f in fields})
    manual = F.filter(F.array(*[F.when(given(f), F.lit(f)) for f in fields]), lambda x: x.isNotNull())
    whole = F.col("stage").isNotNull() & F.col("rule").isNotNull() & F.col("outcome").isNotNull()
    return out.withColumns({"manual_fields": manual, "analytics_status": F.when(whole, "ready").otherwise("partial")}).drop("overrides")


def checked_labels(rows: DataFrame, key: str, allowed: DataFrame, columns: list[str], order: list[str], text_cap: int = 240) -> DataFrame:
    """Rows whose columns form an allowed combination; of one key the first by order; confidence cut to 0..1, text to its cap."""
    known = rows.join(allowed.select(*columns).distinct(), columns, "left_semi")
    rest = [c for c in known.columns if c != key]
    first = known.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(key, "_row.*")
    return first.withColumns({"confidence": F.round(clamp(F.col("confidence"), 0.0, 1.0), 3), "evidence": F.substring("evidence", 1, text_cap)})


def valid_spans(df: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """Rows with finite times, a start of 0 or later and an end after it."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    s, e = F.col(start).cast("double"), F.col(end).cast("double")
    return df.where(finite(s) & finite(e) & (s >= 0) & (e > s))


def derive_record(docs: DataFrame) -> DataFrame:
    """Analysis documents to flat records: results before validated before detected deaths, clamps, trusted sources only."""
    result = F.col("personal_result")
    trusted = F.coalesce(result["source"] != "candidate-only", F.lit(False))
    deaths = F.coalesce(F.when(trusted, result["deaths"]), F.col("validated_deaths"), F.size(F.filter("events", lambda e: e["type"] == "death")))
    roster = F.slice(F.filter(F.transform("enemy_weapons", lambda w: F.nullif(F.trim(w), F.lit(""))), lambda w: w.isNotNull()), 1, 4)
    return docs.select(
        "id",
        "recording_id",
        "match_number",
        "recorded_at",
        blank_to_null(F.col("stage")).alias("stage"),
        blank_to_null(F.col("rule")).alias("rule"),
        F.when(F.col("outcome").isin("win", "lose"), F.col("outcome")).alias("outcome"),
        F.greatest(F.col("duration"), F.lit(0.0)).alias("duration_seconds"),
        F.when(trusted, F.struct(clamp(result["kills"], 0, 99).alias("kills"), clamp(result["deaths"], 0, 99).alias("deaths"))).alias("player_stats"),
        clamp(deaths, 0, 99).alias("death_count"),
        F.coalesce(roster, F.array().cast("array<string>")).alias("enemy_weapons"),
    )


def without_legacy(df: DataFrame, names: list[str]) -> DataFrame:
    return df.drop(*names)


def regression(baseline: DataFrame, candidate: DataFrame, key: str, truth: str, guess: str) -> DataFrame:
    """Per key: pass where both agree, improvement where only the candidate is right, failure where only the baseline was, change else."""
    b = baseline.select(key, F.col(truth).alias("truth"), F.col(guess).alias("before"))
    c = candidate.select(key, F.col(guess).alias("after"))
    right = lambda x: F.coalesce(F.col(x) == F.col("truth"), F.lit(False))
    verdict = F.when(F.col("before").eqNullSafe(F.col("after")), "pass").when(right("after"), "improvement").when(right("before"), "failure").otherwise("change")
    return b.join(c, key, "full_outer").withColumn("verdict", verdict)


def newest_first(df: DataFrame, time: str, tie: str) -> DataFrame:
    return df.orderBy(F.col(time).desc_nulls_last(), tie)


def numbered_by_time(df: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
