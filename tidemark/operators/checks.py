"""Checks of nested rows that come from outside: array functions keep what is valid, filters drop the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import clamp
from tidemark.operators.choices import top_per_key

SLOT_CONFIDENCE = 0.92
#: Phases of a step.
PHASES = ("position", "information", "decision", "action", "outcome")


def text(x: Column, cap: int) -> Column:
    """Trimmed and cut text, null if nothing is left."""
    return F.nullif(F.substring(F.trim(x), 1, cap), F.lit(""))


def _distinct_by(items: Column, name: str) -> Column:
    """The first of the structs that share a field's value."""
    values = F.transform(items, lambda s: s[name])
    return F.filter(items, lambda s, i: F.array_position(values, s[name]) == i + 1)


def rosters(rows: DataFrame, weapons: DataFrame) -> DataFrame:
    """Rows ``id, seq, team, enemy, expected`` (slots: ``weapon, confidence, agreed``) with four valid slots on both sides.

    A slot is accepted if it is sure and not contradicted; the expected weapon must be such a slot of the team. Of one id the first valid row
    counts. The catalog of weapons is a dimension; it is collected behind a check of its size."""
    names = [r[0] for r in weapons.select("name").distinct().limit(10_001).collect()]
    if len(names) > 10_000:
        raise ValueError("a catalog holds at most 10,000 names")
    known = F.array(*[F.lit(n) for n in names]) if names else F.array().cast("array<string>")
    fine = lambda s: F.coalesce(F.array_contains(known, s["weapon"]) & s["confidence"].isNotNull() & ~F.isnan(s["confidence"]), F.lit(False))
    sure = lambda s: (s["confidence"] >= SLOT_CONFIDENCE) & F.coalesce(s["agreed"], F.lit(True))
    slots = F.concat("team", "enemy")
    own = F.filter("team", lambda s: (s["weapon"] == F.col("expected")) & sure(s))
    whole = rows.where((F.size("team") == 4) & (F.size("enemy") == 4) & F.forall(slots, fine) & (F.col("expected").isNull() | (F.size(own) > 0)))
    picked = lambda side: F.transform(F.filter(side, sure), lambda s: s["weapon"])
    at = F.when(F.col("expected").isNotNull(), F.array_position(F.transform("team", lambda s: (s["weapon"] == F.col("expected")) & sure(s)), F.lit(True)) - 1)
    allies = F.filter("team", lambda s, i: sure(s) & ~F.coalesce(i == at, F.lit(False)))
    checked = whole.select(
        "id",
        "seq",
        at.cast("int").alias("self_slot"),
        F.transform(allies, lambda s: s["weapon"]).alias("allies"),
        picked("enemy").alias("enemies"),
        F.round(clamp(F.array_min(F.transform(slots, lambda s: s["confidence"])), 0.0, 1.0), 3).alias("confidence"),
        F.forall(slots, sure).alias("complete"),
    )
    rest = [c for c in checked.columns if c != "id"]
    return checked.groupBy("id").agg(F.min_by(F.struct(*rest), "seq").alias("r")).select("id", "r.*").drop("seq")


def sequences(rows: DataFrame, known: DataFrame, phases: tuple[str, ...] = PHASES) -> DataFrame:
    """Rows ``id, seq, title, steps, tags`` of known ids with at least four valid steps, sorted, and one to four tags.

    A step (``offset, phase, observation, interpretation``) needs all four and an offset of its own. Of one id the first valid row counts."""
    filled = F.transform("steps", lambda s: F.struct(s["offset"].alias("offset"), s["phase"].alias("phase"), text(s["observation"], 300).alias("observation"), text(s["interpretation"], 300).alias("interpretation")))
    valid = F.filter(filled, lambda s: s["offset"].isNotNull() & ~F.isnan(s["offset"]) & s["phase"].isin(*phases) & s["observation"].isNotNull() & s["interpretation"].isNotNull())
    tags = F.slice(F.array_distinct(F.filter(F.transform("tags", lambda t: text(t, 60)), lambda t: t.isNotNull())), 1, 4)
    out = rows.join(known.select("id").distinct(), "id", "left_semi").select("id", "seq", text(F.col("title"), 120).alias("title"), valid.alias("steps"), tags.alias("tags"))
    out = out.withColumn("steps", F.array_sort(_distinct_by(F.col("steps"), "offset"))).where("title is not null and size(steps) >= 4 and size(tags) > 0")
    return out.groupBy("id").agg(F.min_by(F.struct("seq", "title", "steps", "tags"), "seq").alias("r")).select("id", "r.title", "r.steps", "r.tags")


def patterns(rows: DataFrame, most: int = 6, most_clips: int = 12) -> DataFrame:
    """Rows ``report, seq, id, title, known (ids), death_ids, clips`` with two known deaths or more, each shown by a clip.

    A clip (``death_id, start, end, label``) needs a label, a death of the pattern and a start before its end; equal ones count once."""
    deaths = F.array_intersect(F.array_distinct("death_ids"), F.col("known"))
    fine = F.filter("clips", lambda c: F.array_contains(F.col("deaths"), c["death_id"]) & (c["start"] < c["end"]) & text(c["label"], 120).isNotNull())
    key = lambda c: F.concat_ws("/", c["death_id"], c["start"].cast("string"), c["end"].cast("string"))
    out = rows.withColumn("deaths", deaths).withColumn("fine", fine).withColumn("keys", F.transform("fine", key))
    out = out.withColumn("shown", F.slice(F.filter("fine", lambda c, i: F.array_position(F.col("keys"), key(c)) == i + 1), 1, most_clips))
    covered = F.size(F.array_except("deaths", F.transform("shown", lambda c: c["death_id"]))) == 0
    out = out.where((F.size("deaths") >= 2) & (F.size("shown") >= 2) & covered & text(F.col("title"), 120).isNotNull() & text(F.col("id"), 80).isNotNull())
    first = out.groupBy("report", "id").agg(F.min_by(F.struct("seq", "title", F.col("deaths").alias("death_ids"), F.col("shown").alias("clips")), "seq").alias("r")).select("report", "id", "r.*")
    return top_per_key(first, ["report"], [F.col("seq"), F.col("id")], most).drop("rank")


def positions(rows: DataFrame, most: int = 20) -> DataFrame:
    """Rows ``key, seq, x, y`` with coordinates from 0 to 1000, the first ``most`` of each key."""
    return top_per_key(rows.where(F.col("x").between(0, 1000) & F.col("y").between(0, 1000)), ["key"], [F.col("seq")], most)
