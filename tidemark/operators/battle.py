"""Icons to states, states to counts of players, crosses to deaths, deaths to descriptions.

A key is a match, so plain windows do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import clamp
from tidemark.operators import choices, folds, joins, windows


def dead_icon(i: Column) -> Column:
    """A grey icon with one strong and one supporting diagonal; by the measured cross where there is one."""
    strong, weak = F.greatest(i["cross_down"], i["cross_up"]), F.least(i["cross_down"], i["cross_up"])
    by_cross = (i["cross_neutral_ratio"] >= 0.38) & (strong >= 0.48) & (weak >= 0.35)
    by_gray = (i["gray_ratio"] >= 0.22) & (F.greatest(i["diagonal_down"], i["diagonal_up"]) >= 0.3) & (F.least(i["diagonal_down"], i["diagonal_up"]) >= 0.12)
    measured = i["cross_down"].isNotNull() & i["cross_up"].isNotNull()
    return F.coalesce(F.when(measured, by_cross).otherwise(by_gray), F.lit(False))


def cross(i: Column) -> Column:
    return (i["diagonal_down"] >= 0.2) & (i["diagonal_up"] >= 0.2)


def alive(i: Column) -> Column:
    return (i["saturated_ratio"] >= 0.35) & (i["gray_ratio"] <= 0.18) & ~cross(i)


def timer_visible() -> Column:
    return F.coalesce((F.col("timer.dark_ratio") >= 0.22) & (F.col("timer.white_ratio") >= 0.025) & (F.col("timer.edge_ratio") >= 0.035), F.lit(False))


def roster_visible() -> Column:
    icons = F.concat("team", "enemy")
    return timer_visible() & (F.size(icons) == 8) & (F.size(F.filter(icons, lambda i: i["saturated_ratio"] >= 0.3)) >= 7)


def gameplay_start(samples: DataFrame, keys: list[str], earliest: float, latest: float, required: int = 4, roster: bool = False) -> DataFrame:
    """``first``: start of the first ``required`` samples in a row with a visible timer (or roster), else ``latest``."""
    window = samples.where(F.col("t").between(earliest, latest))
    return windows.first_of_run(window, keys, ["t"], roster_visible() if roster else timer_visible(), required, F.lit(float(latest)), None)


def player_counts(samples: DataFrame, keys: list[str], hidden: DataFrame | None = None) -> DataFrame:
    """Per second the players alive on both sides by majority, single flips smoothed and gaps held for five seconds."""
    seen = samples if hidden is None else joins.suppress_near(samples, hidden, keys, "t", 0.6)
    count = lambda side: F.size(F.filter(side, lambda i: ~dead_icon(i)))
    states = seen.where(timer_visible()).select(*keys, "t", F.struct(count("team").alias("team_alive"), count("enemy").alias("enemy_alive")).alias("state"))
    mode = windows.bucket_mode(states, keys, "t", "state", 1.0)
    flat = mode.select(*keys, (F.col("bucket") + 0.5).alias("t"), F.concat_ws(":", "mode.team_alive", "mode.enemy_alive").alias("state"), "share")
    smooth = folds.smooth_flips(flat.withColumnRenamed("share", "confidence"), keys, "t", "state", "confidence")
    held = windows.hold_forward(smooth, keys, "t", ["state"], "confidence", 1.0, 5.0, 6.0, 0.2, None)
    part = lambda k: F.split_part("state", F.lit(":"), F.lit(k)).cast("int")
    return held.select(*keys, "t", part(1).alias("team_alive"), part(2).alias("enemy_alive"), (part(1) - part(2)).alias("difference"), "source", "confidence")


def self_deaths(samples: DataFrame, keys: list[str], start: float, end: float) -> DataFrame:
    """Runs of a crossed own icon of a second or more, ten seconds apart; each lasts until the icon is alive for three samples."""
    me = F.struct(*[c for c in samples.columns if c not in (*keys, "t")])
    score = F.least("diagonal_down", "diagonal_up")
    runs = windows.session_summary(samples.where(cross(me)), keys, ["t"], 0.5, score, None)
    fit = runs.where((F.col("start") >= start) & (F.col("start") <= end + 0.5) & (F.col("end") - F.col("start") >= 1))
    spaced = windows.min_spacing(fit.withColumnRenamed("start", "t"), keys, ["t"], 10.0, None)
    lives = windows.forward_count(samples.withColumn("_alive", F.coalesce(alive(me), F.lit(False))), keys, ["t"], F.col("_alive"), 0, 3, None).where("ahead = 3").select(*keys, "t")
    back = joins.asof(spaced.select(*keys, "t", "peak_score", F.col("end").alias("cross_end")), lives, keys, "t", [], shift=4.0, forward=True, chunk=None)
    until = F.when(F.col("right_t").isNull() | (F.col("right_t") > end + 0.5), end + 0.5).otherwise(F.greatest(F.col("t") + 1, F.col("right_t")))
    return back.select(*keys, "t", until.alias("end"), (until - F.col("t")).alias("duration"), clamp(0.62 + F.col("peak_score") * 0.75, 0.65, 0.99).alias("confidence"))


def describe(deaths: DataFrame, counts: DataFrame, keys: list[str]) -> DataFrame:
    """Each death with the balance of players a quarter of a second before it, at most three seconds old, as text."""
    met = joins.asof(deaths, counts, keys, "t", ["team_alive", "enemy_alive", "difference"], shift=-0.25, longest=3.0, chunk=None)
    d = F.col("right_difference")
    balance = F.when(d > 0, F.format_string("%d枚有利", d)).when(d < 0, F.format_string("%d枚不利", -d)).otherwise("人数は五分")
    text = F.format_string("デス直前は自軍%d人・相手%d人（%s）。", "right_team_alive", "right_enemy_alive", balance)
    return met.withColumn("situation", F.coalesce(F.when(d.isNotNull(), text), F.lit("デス直前の人数・カウント状況は判定できませんでした。")))


def respawn_runs(samples: DataFrame, keys: list[str], start: float, end: float) -> DataFrame:
    """Deaths by their countdown: sessions of recognised frames (``kind, score, white, fine_white``) with eight in a row."""
    bound = F.when(F.col("kind") == "tacticooler", 0.61).otherwise(0.56)
    seen = samples.where(F.col("t").between(start, end) & (F.col("score") >= bound) & (F.col("white") >= 0.34) & (F.col("fine_white") >= 0.46))
    cut = windows.gap_sessions(windows.gap_sessions(seen, keys, ["t"], 0.35, None).withColumnRenamed("session", "streak"), keys, ["t"], 0.75, None)
    streaks = cut.groupBy(*keys, "session", "streak").agg(F.count("*").alias("n"), F.min("t").alias("first"), F.max("t").alias("last"), F.max_by(F.struct("score", "kind"), F.struct("score", -F.col("t"))).alias("peak"))
    runs = streaks.groupBy(*keys, "session").agg(F.max("n").alias("longest"), F.sum("n").alias("observations"), F.min("first").alias("t"), F.max("last").alias("last"), F.max("peak").alias("peak"))
    sure = F.round(F.least(F.lit(0.99), 0.72 + F.col("peak.score") * 0.25), 3)
    return runs.where("longest >= 8").select(*keys, "t", (F.col("last") + 0.5).alias("end"), (F.col("last") - F.col("t") + 0.5).alias("duration"), sure.alias("confidence"), F.col("peak.kind").alias("variant"), "observations", F.col("longest").alias("consecutive"))


def expected_deaths(deaths: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """As many deaths as the result says (``expected``), confirmed ones first, then the surest; numbered by time."""
    ranked = deaths.join(expected, keys).where("expected >= 0")
    kept = choices.top_per_key(ranked, keys, [F.desc("confirmed"), F.desc("confidence"), F.asc("t")], F.col("expected"))
    return choices.renumber(kept.drop("rank", "expected"), keys, ["t"], "death", chunk=None)


def best_candidates(options: DataFrame, expected: DataFrame, keys: list[str], preferred: int | None = None) -> DataFrame:
    """The option ``slot, deaths, confirmed`` whose count is nearest to the expected one; then by confirmed, preference, slot."""
    met = options.join(expected, keys)
    order = [F.abs(F.col("deaths") - F.col("expected")), -F.col("confirmed"), F.when(F.col("slot") == preferred, 0).otherwise(1) if preferred is not None else F.lit(0), F.col("slot")]
    return choices.arg_min(met, keys, order)
