"""Runs, sessions, densities and fills over timelines.

Every function takes the key columns, the order (time first, then what makes it unique) and returns a DataFrame. All look at other rows
through :mod:`tidemark.operators.chunks`, so no task has to hold a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import clamp
from tidemark.operators.chunks import framed, last_known, neighbours, run_numbers, running_sum

#: Seconds in a chunk of a timeline, if the caller gives none.
CHUNK = 30 * 86400.0


def rolling_density(df: DataFrame, keys: list[str], order: list[str], flag: Column, radius: int, threshold: float, chunk: float | None = CHUNK) -> DataFrame:
    """Add ``density`` of the flag among the rows up to ``radius`` places around, cut at the ends, and ``dense``."""
    near = framed(df, keys, order, radius, radius, lambda w: {"density": F.avg(flag.cast("double")).over(w.rowsBetween(-radius, radius))}, chunk)
    return near.withColumn("dense", F.col("density") >= threshold)


def gap_sessions(df: DataFrame, keys: list[str], order: list[str], gap: float, chunk: float | None = CHUNK) -> DataFrame:
    """Add ``session``, from 1 in each key: a new one starts where more than ``gap`` seconds went by."""
    t = order[0]
    return run_numbers(df, keys, order, [t], lambda before, now: before.isNull() | (now[t] - before[t] > gap), "session", chunk)


def session_summary(df: DataFrame, keys: list[str], order: list[str], gap: float, score: Column, chunk: float | None = CHUNK) -> DataFrame:
    """Per session: start, end, rows and the time of the first highest score."""
    t = order[0]
    cut = gap_sessions(df.withColumn("_score", score), keys, order, gap, chunk)
    peak = F.max_by(F.col(t), F.struct("_score", *[(-F.col(c)).alias(f"_{i}") for i, c in enumerate(order)]))
    return cut.groupBy(*keys, "session").agg(F.min(t).alias("start"), F.max(t).alias("end"), F.count("*").alias("rows"), peak.alias("peak"), F.max("_score").alias("peak_score"))


def islands(df: DataFrame, keys: list[str], order: list[str], flag: Column, chunk: float | None = CHUNK) -> DataFrame:
    """Add ``island``: a number for each run of rows with the flag, null elsewhere."""
    marked = df.withColumn("_flag", F.coalesce(flag, F.lit(False)))
    counted = run_numbers(marked, keys, order, ["_flag"], lambda before, now: now["_flag"] & ~F.coalesce(before["_flag"], F.lit(False)), "_n", chunk)
    return counted.withColumn("island", F.when(F.col("_flag"), F.col("_n"))).drop("_flag", "_n")


def island_summary(df: DataFrame, keys: list[str], order: list[str], flag: Column, least: float = 0.0, extend: float = 0.0, chunk: float | None = CHUNK) -> DataFrame:
    """Runs of the flag: start, end (plus ``extend``), rows; those shorter than ``least`` seconds go."""
    t = order[0]
    runs = islands(df, keys, order, flag, chunk).where("island is not null").groupBy(*keys, "island").agg(F.min(t).alias("start"), (F.max(t) + extend).alias("end"), F.count("*").alias("rows"))
    return runs.where(F.col("end") - F.col("start") >= least)


def longest_streak(df: DataFrame, keys: list[str], order: list[str], flag: Column, chunk: float | None = CHUNK) -> DataFrame:
    """``streak``: the most consecutive rows with the flag in each key, 0 for none."""
    runs = islands(df, keys, order, flag, chunk).groupBy(*keys, "island").agg(F.count("*").alias("n"))
    return runs.groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col("island").isNotNull(), F.col("n"))), F.lit(0)).alias("streak"))


def first_of_run(df: DataFrame, keys: list[str], order: list[str], flag: Column, required: int, otherwise: Column, chunk: float | None = CHUNK) -> DataFrame:
    """``first``: start of the first run of at least ``required`` rows with the flag; ``otherwise`` (an aggregate) for none."""
    t = order[0]
    cut = islands(df, keys, order, flag, chunk)
    runs = cut.where("island is not null").groupBy(*keys, "island").agg(F.min(t).alias("start"), F.count("*").alias("n")).where(F.col("n") >= required)
    first = runs.groupBy(*keys).agg(F.min("start").alias("_first"))
    every = df.groupBy(*keys).agg(otherwise.alias("_else"))
    return every.join(first, keys, "left").select(*keys, F.coalesce("_first", "_else").alias("first"))


def min_spacing(df: DataFrame, keys: list[str], order: list[str], least: float, chunk: float | None = CHUNK) -> DataFrame:
    """Rows at least ``least`` seconds after the row before them, which itself need not have been kept."""
    t = order[0]
    near = neighbours(df, keys, order, [t], chunk, before="_before")
    return near.where(F.col("_before").isNull() | (F.col(t) - F.col(f"_before.{t}") >= least)).drop("_before")


def collapse_close(df: DataFrame, keys: list[str], order: list[str], gap: float, chunk: float | None = CHUNK) -> DataFrame:
    """Of rows that follow each other within ``gap`` seconds the last: ``t`` and how many there were."""
    t = order[0]
    return gap_sessions(df, keys, order, gap, chunk).groupBy(*keys, "session").agg(F.max(t).alias("t"), F.count("*").alias("n")).drop("session")


def forward_count(df: DataFrame, keys: list[str], order: list[str], flag: Column, start: int, stop: int, chunk: float | None = CHUNK) -> DataFrame:
    """Add ``ahead``: rows with the flag among those ``start`` to ``stop - 1`` places on."""
    return framed(df, keys, order, 0, stop, lambda w: {"ahead": F.coalesce(F.sum(flag.cast("int")).over(w.rowsBetween(start, stop - 1)), F.lit(0))}, chunk)


def pair_test(df: DataFrame, keys: list[str], order: list[str], score: Column, least: float, gap: float, chunk: float | None = CHUNK) -> DataFrame:
    """``first``: the first row of two in a row that score ``least`` or more and are ``gap`` seconds apart at most."""
    t = order[0]
    near = neighbours(df.withColumn("_score", score), keys, order, [t, "_score"], chunk, after="_next")
    both = (F.col("_score") >= least) & (F.col("_next._score") >= least) & (F.col(f"_next.{t}") - F.col(t) <= gap)
    return near.where(both).groupBy(*keys).agg(F.min(t).alias("first"))


def last_stable_run(df: DataFrame, keys: list[str], order: list[str], gap: float, required: int, add: float, chunk: float | None = CHUNK) -> DataFrame:
    """``boundary``: ``add`` seconds after the start of the last session of at least ``required`` rows."""
    t = order[0]
    runs = gap_sessions(df, keys, order, gap, chunk).groupBy(*keys, "session").agg(F.min(t).alias("start"), F.count("*").alias("n"))
    return runs.where(F.col("n") >= required).groupBy(*keys).agg(F.round(F.max("start") + add, 3).alias("boundary"))


def sign_durations(df: DataFrame, keys: list[str], order: list[str], difference: Column, longest: float, last: float, chunk: float | None = CHUNK) -> DataFrame:
    """Seconds with a positive, a negative and no difference, and the greatest of either sign. A row lasts until the next, ``longest`` at most, the last one ``last``."""
    t = order[0]
    near = neighbours(df.withColumn("_d", difference), keys, order, [t], chunk, after="_next")
    dt = F.coalesce(clamp(F.col(f"_next.{t}") - F.col(t), 0.0, longest), F.lit(last))
    seconds = lambda c: F.round(F.coalesce(F.sum(F.when(c, dt)), F.lit(0.0)), 1)
    d = F.col("_d")
    return near.groupBy(*keys).agg(
        seconds(d > 0).alias("advantage_seconds"),
        seconds(d < 0).alias("disadvantage_seconds"),
        seconds(d == 0).alias("even_seconds"),
        F.greatest(F.max(d), F.lit(0)).alias("most_advantage"),
        F.greatest(F.max(-d), F.lit(0)).alias("most_disadvantage"),
    )


def bucket_mode(df: DataFrame, keys: list[str], time: str, value: str, width: float, least_rows: int = 2, least_share: float = 0.5) -> DataFrame:
    """Per bucket of time the most frequent value, of equals the one seen last, and its share; sparse and split buckets go."""
    counted = df.withColumn("bucket", F.floor(F.col(time) / width)).groupBy(*keys, "bucket", value).agg(F.count("*").alias("n"), F.max(time).alias("seen"))
    best = counted.groupBy(*keys, "bucket").agg(F.max_by(value, F.struct("n", "seen", value)).alias("mode"), F.max("n").alias("votes"), F.sum("n").alias("rows"))
    return best.where((F.col("rows") >= least_rows) & (F.col("votes") / F.col("rows") >= least_share)).withColumn("share", F.col("votes") / F.col("rows"))


def hold_forward(points: DataFrame, keys: list[str], time: str, columns: list[str], confidence: str, step: float, longest: float, decay: float, floor: float, chunk: float | None = CHUNK) -> DataFrame:
    """Points on a grid of ``step``; between two of them the earlier is held up to ``longest`` seconds, ever less surely.

    Each point brings its own held copies, so the grid is never built apart from the data."""
    near = neighbours(points, keys, [time], [time], chunk, after="_next")
    until = F.least(F.col(time) + longest, F.coalesce(F.col(f"_next.{time}") - step, F.col(time) + longest))
    steps = F.greatest(F.floor((until - F.col(time)) / step), F.lit(0)).cast("int")
    age = F.col("_k") * step
    out = near.withColumn("_k", F.explode(F.sequence(F.lit(0), steps)))
    sure = F.when(F.col("_k") == 0, F.col(confidence)).otherwise(F.greatest(F.lit(floor), F.col(confidence) * (1 - age / decay)))
    return out.select(*keys, (F.col(time) + age).alias(time), *columns, F.when(F.col("_k") == 0, "observed").otherwise("held").alias("source"), sure.alias(confidence))


def locf(df: DataFrame, keys: list[str], order: list[str], value: str, chunk: float | None = CHUNK) -> DataFrame:
    """``value`` with its nulls replaced by the last known before them."""
    return last_known(df, keys, order, F.col(value), chunk, before="_held").withColumn(value, F.col("_held")).drop("_held")


def nearest_fill(df: DataFrame, keys: list[str], order: list[str], value: str, chunk: float | None = CHUNK) -> DataFrame:
    """``value`` with its nulls replaced by the known one fewest rows away; the one before wins ties."""
    placed = running_sum(df, keys, order, F.lit(1), "_at", chunk)
    known = F.when(F.col(value).isNotNull(), F.struct("_at", value))
    both = last_known(placed, keys, order, known, chunk, before="_b", after="_a")
    nearer = F.col("_a").isNotNull() & (F.col("_b").isNull() | (F.col("_a._at") - F.col("_at") < F.col("_at") - F.col("_b._at")))
    return both.withColumn(value, F.when(nearer, F.col(f"_a.{value}")).otherwise(F.col(f"_b.{value}"))).drop("_at", "_a", "_b")


def visibility_bracket(df: DataFrame, keys: list[str], order: list[str], direct: Column, sound: Column, within: float, chunk: float | None = CHUNK) -> DataFrame:
    """Add ``visible``: seen directly, or sound and with directly seen rows on both sides within ``within`` seconds."""
    t = order[0]
    seen = F.when(direct, F.col(t))
    both = last_known(df, keys, order, seen, chunk, before="_b", after="_a")
    near = (F.col(t) - F.col("_b") <= within) & (F.col("_a") - F.col(t) <= within)
    return both.withColumn("visible", direct | F.coalesce(sound & near, F.lit(False))).drop("_a", "_b")


def settle_overlaps(spans: DataFrame, keys: list[str], order: list[str], chunk: float | None = CHUNK) -> DataFrame:
    """Spans ``start, end, active_start, active_end``: where one ends after the next starts, both meet halfway between their active parts."""
    sides = neighbours(spans, keys, order, ["start", "end", "active_start", "active_end"], chunk, before="_b", after="_a")
    start = F.when(F.col("_b.end") > F.col("start"), (F.col("_b.active_end") + F.col("active_start")) / 2).otherwise(F.col("start"))
    end = F.when(F.col("end") > F.col("_a.start"), (F.col("active_end") + F.col("_a.active_start")) / 2).otherwise(F.col("end"))
    return sides.withColumns({"start": start, "end": end}).drop("_a", "_b")


def offsets(df: DataFrame, keys: list[str], order: list[str], duration: str, chunk: float | None = CHUNK) -> DataFrame:
    """Add ``offset``: the durations of all rows before, summed."""
    total = running_sum(df, keys, order, F.col(duration), "_upto", chunk)
    return total.withColumn("offset", F.col("_upto") - F.col(duration)).drop("_upto")


def run_lengths(df: DataFrame, keys: list[str], order: list[str], value: str, chunk: float | None = CHUNK) -> DataFrame:
    """Runs of equal values: ``run`` from 1, value, start, end, rows."""
    t = order[0]
    runs = run_numbers(df, keys, order, [value], lambda before, now: before.isNull() | ~now[value].eqNullSafe(before[value]), "run", chunk)
    return runs.groupBy(*keys, "run").agg(F.first(value).alias(value), F.min(t).alias("start"), F.max(t).alias("end"), F.count("*").alias("rows"))


def short_returns(df: DataFrame, keys: list[str], order: list[str], value: str, longest: float, chunk: float | None = CHUNK) -> DataFrame:
    """Runs between two runs of one other value that are over within ``longest`` seconds."""
    runs = run_lengths(df, keys, order, value, chunk)
    sides = neighbours(runs, keys, ["start", "run"], [value, "start"], chunk, before="_b", after="_a")
    return sides.where((F.col(f"_b.{value}") == F.col(f"_a.{value}")) & (F.col("_a.start") - F.col("start") <= longest)).drop("_a", "_b")


def tick_runs(df: DataFrame, keys: list[str], order: list[str], value: str, rows: int = 12, least_valid: int = 8, chunk: float | None = CHUNK) -> DataFrame:
    """``ticks``: the most drops by exactly one within ``rows`` rows in a row that hold ``least_valid`` values and no rise."""
    step = F.col(value) - F.col(f"_before.{value}")
    marked = neighbours(df, keys, order, [value], chunk, before="_before").withColumns({"_drop": (step == -1).cast("int"), "_rise": (step > 0).cast("int")})

    def ticks(w):
        inner, outer = w.rowsBetween(-(rows - 2), 0), w.rowsBetween(-(rows - 1), 0)
        fine = (F.count(value).over(outer) >= least_valid) & (F.coalesce(F.sum("_rise").over(inner), F.lit(0)) == 0)
        return {"_ticks": F.when(fine, F.coalesce(F.sum("_drop").over(inner), F.lit(0)))}

    counted = framed(marked, keys, order, rows, 0, ticks, chunk)
    return counted.groupBy(*keys).agg(F.coalesce(F.max("_ticks"), F.lit(0)).alias("ticks"))


def linear_interpolation(points: DataFrame, keys: list[str], order: list[str], columns: list[str], step: float, longest: float, chunk: float | None = CHUNK) -> DataFrame:
    """Points every ``step`` seconds between neighbours at most ``longest`` seconds apart, the columns on a line between theirs."""
    t = order[0]
    near = neighbours(points, keys, order, [t, *columns], chunk, after="_next")
    span = F.col(f"_next.{t}") - F.col(t)
    between = near.where((span > step) & (span <= longest)).withColumn("_k", F.explode(F.sequence(F.lit(1), (F.ceil(span / step) - 1).cast("int"))))
    share = F.col("_k") * step / span
    made = between.select(*keys, (F.col(t) + F.col("_k") * step).alias(t), *[(F.col(c) + (F.col(f"_next.{c}") - F.col(c)) * share).alias(c) for c in columns], F.lit("inferred").alias("source"))
    return points.select(*keys, t, *columns, F.lit("observed").alias("source")).union(made)


def angle_between(a: Column, b: Column, share: Column) -> Column:
    """Degrees at ``share`` of the way from a to b by the shorter arc."""
    turn = F.pmod(b - a + 540, F.lit(360.0)) - 180
    return F.pmod(a + turn * share, F.lit(360.0))


def extrapolate(points: DataFrame, keys: list[str], order: list[str], x: str, steps: int, longest: float, slowest: float, fastest: float, low: float, high: float, chunk: float | None = CHUNK) -> DataFrame:
    """``steps`` predictions a second apart from each point whose speed since the one before lies within bounds; surer the nearer."""
    t = order[0]
    near = neighbours(points, keys, order, [t, x], chunk, before="_before")
    elapsed = F.col(t) - F.col(f"_before.{t}")
    speed = (F.col(x) - F.col(f"_before.{x}")) / F.when(elapsed > 0, elapsed)
    moving = near.withColumn("speed", speed).where((elapsed > 0) & (elapsed <= longest) & F.abs("speed").between(slowest, fastest))
    out = moving.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(steps))))
    return out.select(*keys, *order, "k", clamp(F.col(x) + F.col("speed") * F.col("k"), low, high).alias("predicted"), F.exp(-F.col("k") / 4.0).alias("confidence"))
