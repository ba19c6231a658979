"""Readings of a panel: digits to numbers, the best reading of a value, stable pairs, and the rule a match's opening tells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import picks
from tidemark.operators.joins import asof
from tidemark.operators.windows import CHUNK, neighbours

#: Most glyphs of a number, the worst first candidate of a glyph, numbers kept, the greatest number.
MOST_GLYPHS, WORST, MOST_NUMBERS, GREATEST = 3, 0.48, 12, 100
#: Readings of a sample that are kept; seconds after which a run of results starts anew.
MOST_READINGS, RESULT_GAP = 18, 0.625
#: Seconds of the opening before and after its start, panels it must show, and ticks in a row that tell the rule.
BEFORE_START, AFTER_START, LEAST_PANELS, LEAST_TICKS = 2.0, 12.0, 6, 4
RULE_NAMES = {"marker": "ヤグラ", "ticks": "エリア", "card": "アサリ"}
#: Seconds after the start from which a full roster counts, and until which.
ROSTER_FROM, ROSTER_UNTIL, ROSTER_GAP = 0.75, 20.0, 1.5


def numbers(glyphs: Column) -> Column:
    """Array of ``cost, value``, cheapest first, from glyphs (``array<array<struct<digit, score>>>``, best candidate first).

    Every way to pick a candidate for each glyph is a number; none starts with a 0 but 0 itself, none is above 100. A glyph
    without a believable candidate makes the panel unreadable. Of equal costs the smaller number comes first."""
    none = F.array(F.struct(F.lit("").alias("text"), F.lit(0.0).alias("cost")))

    def widen(held: Column, glyph: Column) -> Column:
        return F.flatten(F.transform(held, lambda h: F.transform(glyph, lambda c: F.struct(F.concat(h["text"], c["digit"].cast("string")).alias("text"), (h["cost"] + c["score"]).alias("cost")))))

    believable = F.size(glyphs).between(1, MOST_GLYPHS) & F.forall(glyphs, lambda g: F.coalesce(F.get(g, 0)["score"] <= WORST, F.lit(False)))
    every = F.transform(F.aggregate(glyphs, none, widen), lambda h: F.struct((h["cost"] / F.size(glyphs)).alias("cost"), h["text"].cast("int").alias("value"), (F.startswith(h["text"], F.lit("0")) & (h["text"] != "0")).alias("padded")))
    fit = F.filter(every, lambda h: ~h["padded"] & (h["value"] <= GREATEST))
    ranked = F.slice(F.array_sort(F.transform(fit, lambda h: F.struct(h["cost"].alias("cost"), h["value"].alias("value")))), 1, MOST_NUMBERS)
    return F.when(believable, ranked).otherwise(F.slice(ranked, 1, 0))


def best_readings(readings: DataFrame, keys: list[str], most: int = MOST_READINGS) -> DataFrame:
    """From ``value, cost`` under several thresholds the cheapest of each value, how many support it, and its rank by cost, then support."""
    each = readings.groupBy(*keys, "value").agg(F.min("cost").alias("cost"), F.count("*").alias("support"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("cost", F.desc("support"), "value"))
    return each.withColumn("rank", rank).where(F.col("rank") <= most)


def stable_results(results: DataFrame, keys: list[str], order: list[str], pair: list[str], gap: float = RESULT_GAP, chunk: float | None = CHUNK) -> DataFrame:
    """Add ``stable``: the result before, at most ``gap`` seconds ago, read the same pair."""
    t = order[0]
    near = neighbours(results, keys, order, [t, *pair], chunk, before="_b")
    same = F.col(t) - F.col(f"_b.{t}") <= gap
    for c in pair:
        same = same & (F.col(f"_b.{c}") == F.col(c))
    return near.withColumn("stable", F.coalesce(same, F.lit(False))).drop("_b")


def inferred_rule(samples: DataFrame, keys: list[str], time: str, start: Column, panel: Column, ticks: DataFrame) -> DataFrame:
    """``panels, ticks, rule`` of each key: score panels in the opening, and the longest run of ticks (``ticks`` of each key)."""
    opening = F.col(time).between(start - BEFORE_START, start + AFTER_START)
    seen = samples.groupBy(*keys).agg(F.count(F.when(opening & panel, 1)).alias("panels")).join(ticks, keys, "left")
    rule = F.when(F.col("panels") < LEAST_PANELS, RULE_NAMES["marker"]).when(F.col("ticks") >= LEAST_TICKS, RULE_NAMES["ticks"]).otherwise(RULE_NAMES["card"])
    return seen.select(*keys, "panels", F.when(F.col("panels") < LEAST_PANELS, 0).otherwise(F.coalesce("ticks", F.lit(0))).cast("long").alias("ticks"), rule.alias("rule"))


def surrounded(samples: DataFrame, keys: list[str], order: list[str], fits: Column, chunk: float | None = CHUNK) -> DataFrame:
    """Rows that fit and stand between two that fit."""
    near = neighbours(samples.withColumn("_fits", F.coalesce(fits, F.lit(False))), keys, order, ["_fits"], chunk, before="_b", after="_a")
    return near.where(F.col("_fits") & F.col("_b._fits") & F.col("_a._fits")).drop("_fits", "_b", "_a")


def opening_rosters(samples: DataFrame, keys: list[str], order: list[str], whole: Column, start: Column, latest: Column, most: int = 2, skip: int = 0, gap: float = ROSTER_GAP) -> DataFrame:
    """The first ``most`` times, after ``skip``, at which a whole roster stands between whole ones, ``gap`` seconds from the last picked."""
    t = F.col(order[0])
    fit = surrounded(samples, keys, order, whole).where((t >= start + ROSTER_FROM) & (t < F.least(latest, start + ROSTER_UNTIL)))
    picked = picks.greedy_spacing(fit, keys, order, gap, most + skip)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return picked.withColumn("_nth", rank).where(F.col("_nth") > skip).drop("_nth")


def changes_at(series: DataFrame, times: DataFrame, keys: list[str], order: list[str], value: str, chunk: float | None = CHUNK) -> DataFrame:
    """Rows of a series at the given times whose value isn't that of the row before: ``was`` and ``change``."""
    near = neighbours(series, keys, order, [value], chunk, before="_b")
    moved = near.where(F.col(f"_b.{value}").isNotNull() & (F.col(f"_b.{value}") != F.col(value)))
    at = [*keys, order[0]]
    told = moved.withColumns({"was": F.col(f"_b.{value}"), "change": F.col(value) - F.col(f"_b.{value}")}).drop("_b")
    return told.join(times.select(*at).distinct(), at, "left_semi")


def places_at(times: DataFrame, points: DataFrame, keys: list[str], time: str = "t", chunk: float | None = CHUNK) -> DataFrame:
    """Each time with the place ``x, y`` on the line between the points around it; null before the first and after the last point."""
    known = neighbours(points, keys, [time], [time, "x", "y", "confidence"], chunk, before="b")
    met = asof(times, known, keys, time, ["x", "y", "confidence", "b"], forward=True, chunk=chunk)
    exact = F.col(f"right_{time}") == F.col(time)
    before = lambda c: F.coalesce(F.col(f"right_b.{c}"), F.when(exact, F.col(f"right_{c}")))
    since = F.col(time) - before(time)
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), since / F.greatest(F.lit(0.001), F.col(f"right_{time}") - before(time))))
    line = lambda c: (before(c) + (F.col(f"right_{c}") - before(c)) * share).alias(c)
    sure = F.when(before("x").isNotNull(), F.least(F.coalesce(before("confidence"), F.lit(0.2)), F.coalesce("right_confidence", F.lit(0.2))))
    return met.select(*times.columns, line("x"), line("y"), sure.alias("confidence"))
