"""Votes, modes, finals and ranked choices: one or two aggregations each, none collects its group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.chunks import numbered, running_sum


def _two_best(df: DataFrame, keys: list[str], value: str, *more: Column) -> DataFrame:
    """``w`` (n, v and more) of the most frequent value of each key, of equals the greatest, and ``second``: the runner-up's votes."""
    votes = df.groupBy(*keys, value).agg(F.count("*").alias("n"), *more)
    rest = [c for c in votes.columns if c not in (*keys, value, "n")]
    two = top_per_key(votes, keys, [F.desc("n"), F.col(value).desc_nulls_last()], 2)
    winner = F.max(F.when(F.col("rank") == 1, F.struct("n", F.col(value).alias("v"), *rest))).alias("w")
    return two.groupBy(*keys).agg(winner, F.coalesce(F.max(F.when(F.col("rank") == 2, F.col("n"))), F.lit(0)).alias("second"))


def vote_margin(df: DataFrame, keys: list[str], value: str, confidence: str, least: int = 2, margin: int = 2, bonus: float = 0.015, most_bonus: float = 0.08, cap: float = 0.99) -> DataFrame:
    """The value with at least ``least`` votes and ``margin`` more than the runner-up; surer the more votes beyond ``least``."""
    top = _two_best(df, keys, value, F.avg(confidence).alias("mean"))
    sure = F.least(F.lit(cap), F.col("w.mean") + F.least(F.lit(most_bonus), bonus * (F.col("w.n") - least)))
    return top.where((F.col("w.n") >= least) & (F.col("w.n") >= F.col("second") + margin)).select(*keys, F.col("w.v").alias(value), F.col("w.n").alias("votes"), F.col("second").alias("runner_up"), sure.alias("confidence"))


def consensus(df: DataFrame, keys: list[str], value: str, least: int = 2) -> DataFrame:
    """The most frequent value, if it was seen ``least`` times and more often than any other."""
    top = _two_best(df, keys, value)
    return top.where((F.col("w.n") >= least) & (F.col("w.n") > F.col("second"))).select(*keys, F.col("w.v").alias(value), F.col("w.n").alias("votes"))


#: Into so many stretches of values a key's rows are dealt to find its median.
STRETCHES = 1024


def upper_medians(df: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
    """``name``: of each key the value at place floor(n / 2) (from 0) of its sorted values, 0 for none. No task holds a key's values."""
    each = df.select(*keys, value.cast("double").alias("_x")).where("_x is not null").groupBy(*keys, "_x").agg(F.count("*").alias("_n"))
    low, high = each.agg(F.min("_x"), F.max("_x")).first()
    width = (high - low) / STRETCHES if low is not None and high > low else 1.0
    upto = running_sum(each, keys, ["_x"], F.col("_n"), "_upto", width)
    totals = each.groupBy(*keys).agg(F.sum("_n").alias("_all"))
    found = upto.join(totals, keys).where(F.col("_upto") > F.floor(F.col("_all") / 2)).groupBy(*keys).agg(F.min("_x").alias("_m"))
    return df.select(*keys).distinct().join(found, keys, "left").select(*keys, F.coalesce("_m", F.lit(0.0)).alias(name))


def mode_of(df: DataFrame, keys: list[str], values: list[str], confidence: str, order: list[str]) -> DataFrame:
    """The most frequent tuple of values; of equals the one whose first row is surer."""
    first = F.min_by(F.col(confidence), F.struct(*order))
    counted = df.groupBy(*keys, *values).agg(F.count("*").alias("n"), first.alias("first_confidence"))
    best = counted.groupBy(*keys).agg(F.max(F.struct("n", "first_confidence", *values)).alias("b"))
    return best.select(*keys, *[F.col(f"b.{v}").alias(v) for v in values], F.col("b.n").alias("votes"), F.col("b.first_confidence").alias("confidence"))


def final_value(df: DataFrame, keys: list[str], order: list[str], value: str, observed: Column) -> DataFrame:
    """The last observed value, else the last of all; with the number of observed rows and the greatest value."""
    place = F.struct(*order)
    return df.groupBy(*keys).agg(
        F.coalesce(F.max_by(value, F.when(observed, place)), F.max_by(value, place)).alias("final"),
        F.count(F.when(observed, 1)).alias("observed"),
        F.max(value).alias("most"),
    )


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: Column | int) -> DataFrame:
    """The first k rows of each key in an order (k may differ by row of a key), numbered; Spark cuts each task's rows before the shuffle for a fixed k."""
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("rank", number).where(F.col("rank") <= k)


def renumber(df: DataFrame, keys: list[str], order: list[str], prefix: str, name: str = "id", chunk: float | None = 30 * 86400.0) -> DataFrame:
    """``name``: prefix-1, prefix-2 ... in order, of which the first column is a time."""
    placed = numbered(df, keys, order, "_nth", chunk)
    return placed.withColumn(name, F.concat(F.lit(f"{prefix}-"), F.col("_nth").cast("string"))).drop("_nth")


def arg_min(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The whole first row of each key in an order, by one aggregation."""
    named = F.struct(*[c.alias(f"_{i}") for i, c in enumerate(order)])
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), named).alias("_row")).select(*keys, "_row.*")


def evaluation(df: DataFrame, keys: list[str], truth: Column, guess: Column, tolerance: float | None = None) -> DataFrame:
    """Rows, coverage, accuracy of what was guessed; with a tolerance also mean error and how many are within it."""
    known, given = truth.isNotNull(), guess.isNotNull()
    columns = [
        F.count(F.when(known, 1)).alias("labelled"),
        F.count(F.when(known & given, 1)).alias("guessed"),
        F.count(F.when(known & (truth == guess), 1)).alias("right"),
        (F.count(F.when(known & given, 1)) / F.nullif(F.count(F.when(known, 1)), F.lit(0))).alias("coverage"),
        (F.count(F.when(known & (truth == guess), 1)) / F.nullif(F.count(F.when(known & given, 1)), F.lit(0))).alias("precision"),
    ]
    if tolerance is not None:
        off = F.abs(truth - guess)
        columns += [F.avg(off).alias("mean_error"), F.count(F.when(off <= tolerance, 1)).alias("within")]
    return df.groupBy(*keys).agg(*columns) if keys else df.agg(*columns)
