"""Matches, fragments and clips as intervals of a recording."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import clamp
from tidemark.operators import choices, joins, windows


def fragment_manifest(matches: DataFrame, fragments: DataFrame, key: str) -> DataFrame:
    """For each match ``key, number, start, end`` its fragments in order, each with its place on the match's own timeline."""
    met = joins.interval_overlap(matches, fragments, [key], 60.0)
    parts = met.select(key, "number", "start", "end", F.col("right_file_name").alias("file_name"), F.col("right_start").alias("source_start"), F.col("right_end").alias("source_end"), (F.col("right_end") - F.col("right_start")).alias("duration"))
    placed = windows.offsets(parts, [key, "number"], ["source_start", "file_name"], "duration", None)
    return placed.withColumn("timeline_start", F.round("offset", 3)).drop("offset")


def rebased(series: DataFrame, matches: DataFrame, key: str, places: int = 3, usual: float = 600.0) -> DataFrame:
    """Points of a series inside a match (usually ``usual`` seconds long), timed from its start."""
    met = joins.within_intervals(series, matches.select(key, "number", "start", "end"), [key], "t", usual)
    return met.select(key, "number", F.round(F.col("t") - F.col("start"), places).alias("t"), *[c for c in series.columns if c not in (key, "t")])


def clip_ranges(patterns: DataFrame, deaths: DataFrame, keys: list[str]) -> DataFrame:
    """Clips (``pattern, clips: array<struct<death_id, start, end, label>>, duration``) on their recording: cut to it, half a second at least, once each."""
    each = patterns.select(*keys, "pattern", "duration", F.posexplode("clips").alias("nth", "c"))
    met = each.join(deaths.select(*keys, F.col("id").alias("death_id"), F.col("t").alias("at")), [*[each[k] == deaths[k] for k in keys], F.col("c.death_id") == F.col("death_id")])
    at = lambda c: clamp(F.col("at") + F.col(f"c.{c}"), 0.0, 1e12)
    cut = met.select(*[each[k] for k in keys], "pattern", "nth", "death_id", F.least(at("start"), "duration").alias("start"), F.least(at("end"), "duration").alias("end"), F.col("c.label").alias("label"))
    first = cut.where(F.col("end") - F.col("start") >= 0.5).groupBy(*keys, "pattern", "death_id", "start", "end").agg(F.min_by(F.struct("nth", "label"), "nth").alias("r"))
    return first.select(*keys, "pattern", "death_id", "start", "end", "r.nth", "r.label")


def nearest_clip(clips: DataFrame, times: DataFrame, keys: list[str], usual: float = 10.0) -> DataFrame:
    """For each time the clip that holds it, else the one with the nearest edge; the first (``nth``) of equals.

    Edges on both sides are found by as-of joins, so a time meets no clips but the nearest and those around it."""
    rest = [c for c in clips.columns if c not in keys]
    clip = F.struct(*rest)
    asked = times.select(*keys, "t").distinct()
    holding = joins.within_intervals(asked, clips.select(*keys, "start", "end", F.col("nth").alias("_nth"), clip.alias("clip")), keys, "t", usual)
    found = holding.select(*keys, "t", F.lit(0).alias("_far"), F.lit(0.0).alias("_gap"), "_nth", "clip")
    edges = clips.select(*keys, F.explode(F.array("start", "end")).alias("t"), (-F.col("nth")).alias("_turn"), F.col("nth").alias("_nth"), clip.alias("clip"))
    for forward in (False, True):
        # Of clips with an edge at one time the first counts, whichever way the edges are read.
        order = F.col("_turn") if not forward else -F.col("_turn")
        near = joins.asof(asked, edges.withColumn("_turn", order), keys, "t", ["_nth", "clip"], forward=forward, tie=["_turn"])
        met = near.where("right_clip is not null")
        found = found.union(met.select(*keys, "t", F.lit(1), F.abs(F.col("right_t") - F.col("t")), F.col("right__nth"), F.col("right_clip")))
    best = choices.arg_min(found, [*keys, "t"], [F.col("_far"), F.col("_gap"), F.col("_nth")])
    return best.select(*keys, "t", "clip.*")
