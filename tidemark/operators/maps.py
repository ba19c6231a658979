"""Positions on a map: what was observed, the route between, and short predictions from motion, heading and sight.

A key is a match, so plain windows do."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import clamp
from tidemark.operators import choices, joins, windows

EPISODE_GAP, SIDE = 2.1, 1000.0


def _place(x: Column) -> Column:
    return F.round(clamp(x, 0.0, SIDE), 1)


def self_observations(samples: DataFrame, keys: list[str]) -> DataFrame:
    """The surest own marker (``marker: struct<x, y, direction, confidence>``) of each time the map was open, once the map is plain."""
    cut = windows.gap_sessions(samples.where("visible"), keys, ["t"], EPISODE_GAP, None)
    fine = (F.col("neutral") >= 0.36) & (F.col("score") >= 0.32) & (F.col("marker.confidence") >= 0.5)
    until = cut.groupBy(*keys, "session").agg(F.max("t").alias("until"), F.max_by(F.struct("t", "marker"), F.when(fine, F.struct(F.col("marker.confidence").alias("c"), (-F.col("t")).alias("t")))).alias("b"))
    return until.where("b is not null").select(*keys, F.col("b.t").alias("t"), "b.marker.x", "b.marker.y", "b.marker.direction", "b.marker.confidence", "until")


def route(points: DataFrame, keys: list[str]) -> DataFrame:
    """Observations and, on every full second between two, a place on the line, the heading by the shorter arc, surer near either end."""
    near = windows.neighbours(points, keys, ["t"], ["t", "x", "y", "direction", "confidence"], None, after="n")
    first = F.ceil(F.col("t") + 1).cast("int")
    last = (F.ceil(F.col("n.t")) - 1).cast("int")
    made = near.where(F.col("n.t").isNotNull() & (first <= last)).withColumn("s", F.explode(F.sequence(first, last)))
    share = (F.col("s") - F.col("t")) / (F.col("n.t") - F.col("t"))
    line = lambda c: F.round(F.col(c) + (F.col(f"n.{c}") - F.col(c)) * share, 1)
    apart = F.least(F.col("s") - F.col("t"), F.col("n.t") - F.col("s"))
    sure = F.round(F.greatest(F.lit(0.12), F.least("confidence", "n.confidence") * F.exp(-apart / 18)), 3)
    between = made.select(*keys, F.col("s").cast("double").alias("t"), line("x").alias("x"), line("y").alias("y"), F.round(windows.angle_between(F.col("direction"), F.col("n.direction"), share), 1).alias("direction"), F.lit("inferred").alias("source"), sure.alias("confidence"))
    return points.select(*keys, "t", "x", "y", "direction", F.lit("observed").alias("source"), "confidence").union(between)


def motion_predictions(points: DataFrame, keys: list[str], seconds: int = 6) -> DataFrame:
    """A place for each of the next seconds, at the speed since the observation before; only believable speeds count."""
    near = windows.neighbours(points, keys, ["t"], ["t", "x", "y"], None, before="b")
    dt = F.col("t") - F.col("b.t")
    moving = near.withColumns({"vx": (F.col("x") - F.col("b.x")) / F.when(dt > 0, dt), "vy": (F.col("y") - F.col("b.y")) / F.when(dt > 0, dt)}).where((dt > 0) & (dt <= 90)).where(F.hypot("vx", "vy").between(0.4, 18))
    each = moving.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(seconds))))
    return each.select(*keys, F.col("t").alias("observed_at"), (F.col("t") + F.col("k")).alias("t"), _place(F.col("x") + F.col("vx") * F.col("k")).alias("x"), _place(F.col("y") + F.col("vy") * F.col("k")).alias("y"), F.round(F.col("confidence") * F.exp(-F.col("k") / 4.0), 3).alias("confidence"))


def heading_predictions(points: DataFrame, keys: list[str], seconds: int = 6, distance: float = 72.0, chunk: float | None = joins.CHUNK) -> DataFrame:
    """A place for each of the next seconds along the heading, until half a second before the next observation."""
    near = windows.neighbours(points, keys, ["t"], ["t"], chunk, after="n")
    lasts = F.least(F.lit(float(seconds)), F.coalesce(F.greatest(F.lit(0.0), F.col("n.t") - F.col("t") - 0.5), F.lit(float(seconds))))
    each = near.withColumn("lasts", lasts).where("direction is not null and lasts >= 1").withColumn("k", F.explode(F.sequence(F.lit(0), F.floor("lasts").cast("int"))))
    step = F.col("k") * distance / seconds
    return each.select(*keys, F.col("t").alias("observed_at"), (F.col("t") + F.col("k")).alias("t"), _place(F.col("x") + F.cos(F.radians("direction")) * step).alias("x"), _place(F.col("y") + F.sin(F.radians("direction")) * step).alias("y"), F.round(F.col("confidence") * F.exp(-F.col("k") / 3.5), 3).alias("confidence"))


def threat_zones(deaths: DataFrame, points: DataFrame, keys: list[str], seconds: int = 6, longest: float = 10.0, chunk: float | None = joins.CHUNK) -> DataFrame:
    """A growing circle around where a death's player was next seen within ``longest`` seconds."""
    met = joins.asof(deaths, points, keys, "t", ["x", "y", "confidence"], longest=longest, forward=True, chunk=chunk).where("right_x is not null")
    sure = F.round(F.least(F.lit(0.48), F.coalesce("confidence", F.lit(0.5)) * F.col("right_confidence") * 0.72), 3)
    each = met.withColumn("sure", sure).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(seconds))))
    return each.select(*keys, F.col("t").alias("death_t"), (F.col("t") + F.col("k")).alias("t"), F.col("right_x").alias("x"), F.col("right_y").alias("y"), (F.lit(55.0) + F.col("k") * 11).alias("radius"), F.round(F.col("sure") * F.exp(-F.col("k") / 3.5), 3).alias("confidence"))


def sight_predictions(frames: DataFrame, own: DataFrame, keys: list[str], seconds: int = 4) -> DataFrame:
    """Candidates on screen (``id, t, x, width, height, confidence``) put on the map along the heading, then carried on.

    ``own`` is a dense route with headings (``t, x, y, direction, confidence``); a frame uses the nearest of its seconds. The view is 90 degrees
    wide; the smaller a candidate, the farther. The last two places of an id give its speed, 18 a second at most."""
    seen = joins.range_join(frames, own, keys, "t", "t", 0.5, 0.5).where("right_direction is not null")
    ids = [*keys, "id", "t"]
    near = choices.arg_min(seen, ids, [F.abs(F.col("right_t") - F.col("t")), F.col("right_t")])
    bearing = F.radians("right_direction") + (F.col("x") + F.col("width") / 2 - 0.5) * (math.pi / 2)
    far = clamp(22 / F.greatest(F.lit(0.04), F.col("height")), 55.0, 210.0)
    put = near.select(*ids, clamp(F.col("right_x") + F.cos(bearing) * far, 0.0, SIDE).alias("mx"), clamp(F.col("right_y") + F.sin(bearing) * far, 0.0, SIDE).alias("my"), F.least(F.lit(0.28), F.col("confidence") * F.col("right_confidence") * 0.48).alias("sure"))
    placed = windows.neighbours(put, [*keys, "id"], ["t"], ["t", "mx", "my"], None, before="b")
    rest = [c for c in placed.columns if c not in (*keys, "id")]
    last = placed.groupBy(*keys, "id").agg(F.max_by(F.struct(*rest), "t").alias("r")).select(*keys, "id", "r.*")
    dt = F.greatest(F.lit(0.5), F.col("t") - F.col("b.t"))
    speed = lambda c: F.coalesce((F.col(c) - F.col(f"b.{c}")) / dt, F.lit(0.0))
    slow = F.least(F.lit(1.0), 18 / F.greatest(F.lit(1e-9), F.hypot("vx", "vy")))
    each = last.withColumns({"vx": speed("mx"), "vy": speed("my")}).withColumn("slow", slow).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(seconds))))
    return each.select(*keys, "id", (F.col("t") + F.col("k")).alias("t"), _place(F.col("mx") + F.col("vx") * F.col("slow") * F.col("k")).alias("x"), _place(F.col("my") + F.col("vy") * F.col("slow") * F.col("k")).alias("y"), (F.lit(85) + F.col("k") * 28).alias("radius"), F.round(F.col("sure") * F.exp(-F.col("k") / 2.4), 3).alias("confidence"))


def best_frame(samples: DataFrame, deaths: DataFrame, keys: list[str], least: float = 0.21) -> DataFrame:
    """The clearest map frame: visible before hidden, within half a second to five seconds after a death before elsewhere, then by score."""
    after = joins.range_join(samples, deaths, keys, "t", "t", 5.0, -0.5, "left_semi").select(*keys, "t").distinct().withColumn("after", F.lit(1))
    met = samples.where(F.col("structure") >= least).join(after, [*keys, "t"], "left")
    return choices.arg_min(met, keys, [F.when(F.col("visible"), 0).otherwise(1), -F.coalesce("after", F.lit(0)), -F.col("score"), F.col("t")]).drop("after")


def static_icons(clustered: DataFrame, keys: list[str], episodes: int = 3, white: float = 0.15) -> DataFrame:
    """Clusters (``cluster, session, x, y, white``) seen in several episodes with a white share: furniture, not players."""
    by = clustered.groupBy(*keys, "cluster").agg(F.count_distinct("session").alias("episodes"), F.avg("x").alias("x"), F.avg("y").alias("y"), F.avg("white").alias("white"))
    return by.where((F.col("episodes") >= episodes) & (F.col("white") >= white))
