"""Recordings to matches: frame features to classified samples, active runs, match starts and segments.

A key is a recording of bounded length, so plain windows do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import windows
from tidemark.operators.choices import upper_medians

#: Bounds of the two looks of an intro card, and what each bound that holds adds.
STANDARD_CARD = [("center_dark_ratio", 0.22, 0.315, 0.42), ("center_white_ratio", 0.025, 0.14, 0.25), ("center_edge_ratio", 0.095, None, 0.25), ("saturation", 0.18, None, 0.08)]
BRIGHT_CARD = [("center_dark_ratio", 0.215, 0.235), ("center_white_ratio", 0.14, 0.22), ("center_edge_ratio", 0.14, None), ("saturation", 0.3, None)]


def _between(name: str, low: float, high: float | None) -> Column:
    c = F.col(name) >= low
    return F.coalesce(c if high is None else c & (F.col(name) <= high), F.lit(False))


def intro_score() -> Column:
    """0 to 1; 0 without a measured centre."""
    standard = sum((F.when(_between(n, lo, hi), w).otherwise(0.0) for n, lo, hi, w in STANDARD_CARD), F.lit(0.0))
    bright = F.lit(True)
    for n, lo, hi in BRIGHT_CARD:
        bright = bright & _between(n, lo, hi)
    return F.when(F.col("center_dark_ratio").isNull(), 0.0).otherwise(F.when(bright, F.greatest(F.lit(0.9), standard)).otherwise(standard))


def classify(samples: DataFrame, key: str) -> DataFrame:
    """Add ``hud, active, game_score, gameplay, rule_score, rule_intro``; two thresholds follow the recording's medians."""
    moving = upper_medians(samples, [key], F.when(F.col("difference") != 0, F.col("difference")), "_difference")
    medians = moving.join(upper_medians(samples, [key], F.col("hud_edge_ratio"), "_edge"), key)
    hud = (F.col("hud_white_ratio") >= 0.012) & (F.col("hud_edge_ratio") >= F.greatest(F.lit(0.035), F.col("_edge") * 0.9))
    active = (F.col("difference") >= F.greatest(F.lit(5.5), F.col("_difference") * 0.55)) & (F.col("saturation") >= 0.18) & (F.col("brightness") >= 28)
    game = F.when(F.col("hud"), 0.62).otherwise(0.0) + F.least(F.lit(0.25), F.col("hud_edge_ratio") * 2.2) + F.when(F.col("active"), 0.28).otherwise(0.0)
    out = samples.join(medians, key).withColumns({"hud": hud, "active": active}).withColumns({"game_score": game, "rule_score": intro_score()})
    return out.withColumns({"gameplay": F.col("game_score") >= 0.7, "rule_intro": F.col("rule_score") >= 0.82}).drop("_difference", "_edge")


def active_runs(classified: DataFrame, key: str, interval: float, least: float = 75.0) -> DataFrame:
    """``active_start, active_end`` of stretches with activity in at least 35 % of the half minute around."""
    dense = windows.rolling_density(classified, [key], ["time"], F.col("active"), int(-(-16 // interval)), 0.35, None)
    runs = windows.island_summary(dense, [key], ["time"], F.col("dense"), least, interval, None)
    return runs.select(key, F.col("start").alias("active_start"), F.col("end").alias("active_end"))


def intro_starts(classified: DataFrame, key: str, interval: float) -> DataFrame:
    """``start`` of matches by their intro card: the best frame of each card, the later of two within a minute, followed by activity."""
    ahead = lambda s: int(-(-s // interval))
    counted = windows.forward_count(classified, [key], ["time"], F.col("active"), ahead(8), ahead(120), None)
    cards = windows.gap_sessions(counted.where("rule_intro"), [key], ["time"], interval * 2, None)
    # A frame that is no card in between ends a card too.
    islands = windows.islands(counted, [key], ["time"], F.col("rule_intro"), None).select(key, "time", "island")
    split = cards.join(islands, [key, "time"])
    best = split.groupBy(key, "session", "island").agg(F.max_by(F.struct("time", "ahead"), F.struct("rule_score", -F.col("time"))).alias("b")).select(key, "b.time", "b.ahead")
    late = windows.gap_sessions(best, [key], ["time"], 60.0, None).groupBy(key, "session").agg(F.max_by("ahead", "time").alias("ahead"), F.max("time").alias("time"))
    followed = late.where(F.col("ahead") >= max(3, ahead(6)))
    return windows.min_spacing(followed, [key], ["time"], 120.0, None).select(key, F.col("time").alias("start"))


def segments(classified: DataFrame, durations: DataFrame, key: str, interval: float) -> DataFrame:
    """``start, end, active_start, active_end, detection`` of each match. ``durations`` has ``key, duration``.

    Recordings with intro cards are cut at them; the others at their active runs, overlaps settled halfway."""
    runs = active_runs(classified, key, interval)
    starts = windows.neighbours(intro_starts(classified, key, interval), [key], ["start"], ["start"], None, after="_next").join(durations, key)
    following = F.coalesce(F.col("_next.start"), F.col("duration"))
    fits = (F.col("r.active_end") > F.col("s.start")) & (F.col("r.active_start") >= F.col("s.start") - 60) & (F.col("r.active_start") < F.least(F.col("s.following") - 30, F.col("s.start") + 60))
    s = starts.withColumns({"following": following, "last": F.col("_next").isNull()}).drop("_next").alias("s")
    met = s.join(runs.alias("r"), (F.col(f"s.{key}") == F.col(f"r.{key}")) & fits, "left").groupBy(*[F.col(f"s.{c}") for c in (key, "start", "following", "last", "duration")]).agg(F.max("r.active_end").alias("run_end"))
    active_end = F.coalesce("run_end", F.least(F.col("following"), F.col("start") + 360))
    end = F.when(F.col("last"), F.least(F.col("duration"), active_end + 90)).otherwise(F.least(F.col("following") - 3, active_end + 70))
    by_card = met.select(key, "start", F.greatest(F.col("start") + 60, end).alias("end"), F.col("start").alias("active_start"), active_end.alias("active_end"), F.lit("rule-intro").alias("detection"))
    bare = runs.join(starts.select(key).distinct(), key, "left_anti").join(durations, key)
    bare = windows.neighbours(bare, [key], ["active_start"], ["active_start"], None, after="_next")
    until = F.least(F.col("duration"), F.coalesce(F.col("_next.active_start") - 3, F.col("duration")), F.col("active_end") + 90)
    spans = bare.select(key, F.greatest(F.lit(0.0), F.col("active_start") - 25).alias("start"), until.alias("end"), "active_start", "active_end", F.lit("activity").alias("detection"))
    return by_card.unionByName(windows.settle_overlaps(spans, [key], ["active_start"], None))
