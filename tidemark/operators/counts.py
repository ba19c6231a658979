"""Counter timelines of a match: which readings count, when they start, and both sides with their penalties in one row a tick."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import joins, monotone, penalty
from tidemark.operators.chunks import framed

READING = "array<struct<value: int, cost: double, support: int>>"


def _none() -> Column:
    return F.array().cast(READING)


def readable(candidates: Column) -> Column:
    """Some reading is clear, or fair and supported."""
    return F.exists(candidates, lambda c: (c["cost"] <= 0.18) | (c["cost"] <= 0.24) & (F.coalesce(c["support"], F.lit(1)) >= 2))


def lone_zero(candidates: Column) -> Column:
    """A 0 that no near reading above 1 speaks against: what is left of a fading 100."""
    best = F.get(candidates, 0)
    return F.coalesce((best["value"] == 0) & ~F.exists(candidates, lambda c: (c["value"] > 1) & (c["cost"] <= best["cost"] + 0.12)), F.lit(False))


def cleaned(samples: DataFrame, keys: list[str], hidden: DataFrame | None = None, independent: bool = False) -> DataFrame:
    """``left`` and ``right`` emptied near hidden times, where a panel isn't readable (or the other isn't), and at lone zeros."""
    rows = samples
    if hidden is not None:
        shown = joins.suppress_near(samples.select(*keys, "t"), hidden, keys, "t", 0.75).distinct().withColumn("_shown", F.lit(True))
        rows = samples.join(shown, [*keys, "t"], "left")
        fields = [c for c in ("left", "right", "left_penalty", "right_penalty") if c in samples.columns]
        rows = rows.withColumns({c: F.when(F.col("_shown"), F.col(c)).otherwise(_none()) for c in fields}).drop("_shown")
    left, right = readable(F.col("left")), readable(F.col("right"))
    keep = lambda own, other, c: F.when(own & (F.lit(independent) | other) & ~lone_zero(F.col(c)), F.col(c)).otherwise(_none())
    return rows.withColumns({"left": keep(left, right, "left"), "right": keep(right, left, "right")})


def _full(c: str) -> Column:
    return F.exists(c, lambda r: (r["value"] == 100) & (r["cost"] <= 0.24))


def count_start(samples: DataFrame, keys: list[str], earliest: float) -> DataFrame:
    """``start``: the first tick at which both sides read 100 and do so again within four ticks; ``earliest`` for none."""
    both = samples.withColumn("_both", _full("left") & _full("right"))
    near = framed(both, keys, ["t"], 0, 4, lambda w: {"_again": F.max(F.col("_both").cast("int")).over(w.rowsBetween(1, 4))}, None)
    first = near.groupBy(*keys).agg(F.min(F.when(F.col("_both") & (F.col("_again") == 1), F.col("t"))).alias("s"))
    return first.select(*keys, F.greatest(F.lit(earliest), F.coalesce("s", F.lit(earliest))).alias("start"))


def count_timeline(samples: DataFrame, keys: list[str], earliest: float, latest: float, hidden: DataFrame | None = None, with_penalty: bool = True) -> DataFrame:
    """``team_count, enemy_count, team_penalty, enemy_penalty`` and their sources at each tick; a side without a value reads 100 (0), held."""
    fine = cleaned(samples, keys, hidden)
    timed = fine.join(count_start(fine, keys, earliest), keys).where((F.col("t") >= F.col("start")) & (F.col("t") <= latest))
    side = lambda c, name: monotone.monotone_counts(timed.select(*keys, "t", F.col(c).alias("candidates"), F.lit(True).alias("visible")), keys).select(*keys, "t", F.col("value").alias(f"{name}_count"), F.col("source").alias(f"{name}_source"), F.col("confidence").alias(f"{name}_confidence"))
    out = side("left", "team").join(side("right", "enemy"), [*keys, "t"], "left")
    for c, other, name in (("left_penalty", "left", "team"), ("right_penalty", "right", "enemy")):
        if with_penalty:
            rows = timed.select(*keys, "t", F.col(c).alias("candidates"), (F.size(c) > 0).alias("visible"), (F.size(other) > 0).alias("other_visible"))
            found = penalty.penalty_counts(rows, keys).select(*keys, "t", F.col("value").alias(f"{name}_penalty"), F.col("source").alias(f"{name}_penalty_source"))
            out = out.join(found, [*keys, "t"], "left")
        else:
            out = out.withColumns({f"{name}_penalty": F.lit(0).cast("long"), f"{name}_penalty_source": F.lit("held")})
    return out.select(
        *keys,
        "t",
        "team_count",
        F.coalesce("enemy_count", F.lit(100)).alias("enemy_count"),
        F.coalesce("team_penalty", F.lit(0)).alias("team_penalty"),
        F.coalesce("enemy_penalty", F.lit(0)).alias("enemy_penalty"),
        "team_source",
        *[F.coalesce(c, F.lit("held")).alias(c) for c in ("enemy_source", "team_penalty_source", "enemy_penalty_source")],
        F.least("team_confidence", F.coalesce("enemy_confidence", F.lit(0.35))).alias("confidence"),
    )


def count_summary(timeline: DataFrame, keys: list[str]) -> DataFrame:
    """The last observed counts (else the last), the greatest penalties and how many ticks were observed."""
    seen = (F.col("team_source") == "observed") | (F.col("enemy_source") == "observed")
    last = lambda c: F.coalesce(F.max_by(c, F.when(seen, F.col("t"))), F.max_by(c, "t")).alias(c)
    return timeline.groupBy(*keys).agg(last("team_count"), last("enemy_count"), F.max("team_penalty").alias("most_team_penalty"), F.max("enemy_penalty").alias("most_enemy_penalty"), F.count(F.when(seen, 1)).alias("observed"))
