"""Scalar and array functions on columns, all of built-in expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float, high: float) -> Column:
    """``x`` cut to [low, high]; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def half_up(x: Column) -> Column:
    """Round to an integer, halves upward (also of negative numbers)."""
    return F.floor(x + 0.5)


def blank_to_null(x: Column) -> Column:
    return F.nullif(F.trim(x), F.lit(""))


def finite(x: Column) -> Column:
    """The number in ``x``, null where it is blank, not a number or infinite."""
    n = x.try_cast("double")
    return F.when(~F.isnan(n) & (F.abs(n) != float("inf")), n)


def ratio(over: Column, under: Column) -> Column:
    """``over / under``, null where ``under`` is 0 or null."""
    return over.cast("double") / F.nullif(under.cast("double"), F.lit(0.0))


def upper_median(x: Column) -> Column:
    """Aggregate: the element at place floor(n / 2) of the sorted values (from 0), 0 for none.

    Collects the group, so it is for groups of bounded size, such as the samples of one recording."""
    values = F.array_sort(F.collect_list(x))
    return F.coalesce(F.get(values, F.floor(F.size(values) / 2).cast("int")), F.lit(0.0))


def normalized_name(x: Column) -> Column:
    """A name without middle dots, full stops and white space, and with one long form shortened."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(x, F.lit("")), r"[・.\s]", ""), "14式竹筒銃甲", "竹")


#: The buckets' labels and bounds (at most), in natural order.
DEATH_BUCKETS = [("0–2デス", 2), ("3–5デス", 5), ("6–8デス", 8), ("9デス以上", None)]
DISADVANTAGE_BUCKETS = [("0–15秒", 15), ("16–30秒", 30), ("31–60秒", 60), ("61秒以上", None)]
OUTCOME_NAMES = {"win": "WIN", "lose": "LOSE", None: "未取得"}


def bucket(x: Column, buckets: list[tuple[str, float | None]]) -> Column:
    """The first bucket whose bound is not below ``x``; null for null."""
    cases = reduce(lambda c, b: c.when(x <= b[1], b[0]), buckets[1:-1], F.when(x <= buckets[0][1], buckets[0][0]))
    return F.when(x.isNotNull(), cases.otherwise(buckets[-1][0]))


def outcome_name(outcome: Column) -> Column:
    return F.when(outcome == "win", "WIN").when(outcome == "lose", "LOSE").otherwise(OUTCOME_NAMES[None])


def outcome_label(outcome: Column, own_count: Column, other_count: Column) -> Column:
    """The recorded outcome, else the side whose last count is lower, else a draw; ``未取得`` without counts."""
    return (
        F.when(outcome == "win", "WIN")
        .when(outcome == "lose", "LOSE")
        .when(own_count < other_count, "WIN")
        .when(own_count > other_count, "LOSE")
        .when(own_count == other_count, "DRAW")
        .otherwise(OUTCOME_NAMES[None])
    )


def clock(seconds: Column) -> Column:
    """mm:ss of a number of seconds, not below 0."""
    whole = F.floor(F.greatest(seconds, F.lit(0.0)))
    return F.concat_ws(":", F.lpad(F.floor(whole / 60).cast("string"), 2, "0"), F.lpad((whole % 60).cast("string"), 2, "0"))


def seconds_of(hms: Column) -> Column:
    """Seconds of h:m:s text."""
    part = lambda k: F.regexp_extract(hms, r"^(\d+):(\d+):(\d+(?:\.\d+)?)$", k).try_cast("double")
    return part(1) * 3600 + part(2) * 60 + part(3)


def recorded_at(file_name: Column, offset_seconds: Column, zone: str = "UTC") -> Column:
    """Start of a match from its recording's name (YYYY-MM-DD HH-MM-SS, any of ' _' between) and whole seconds into it."""
    part = lambda k: F.regexp_extract(file_name, r"(\d{4}-\d{2}-\d{2})[ _](\d{2})-(\d{2})-(\d{2})", k)
    text = F.concat(part(1), F.lit(" "), F.concat_ws(":", part(2), part(3), part(4)))
    start = F.to_utc_timestamp(F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")), zone)
    return F.timestamp_seconds(F.unix_seconds(start) + F.floor(F.coalesce(offset_seconds, F.lit(0))))


def short_id(*parts: Column, length: int = 16) -> Column:
    """A stable id of several fields."""
    return F.substring(F.sha1(F.concat_ws("\x1f", *parts).cast("binary")), 1, length)


def signature(parts: Column) -> Column:
    """SHA-256 of the sorted strings of an array, a line each."""
    return F.sha2(F.array_join(F.array_sort(parts), "\n").cast("binary"), 256)


def formatted(value: Column, kind: str) -> Column:
    """A metric as text: percent and seconds and decimals with one place, counts whole, ratios with two; a dash for null."""
    shown = {
        "percent": F.format_string("%.1f%%", value * 100),
        "seconds": F.format_string("%.1f秒", value),
        "count": half_up(value).cast("string"),
        "ratio": F.format_string("%.2f", value),
    }.get(kind, F.format_string("%.1f", value))
    return F.coalesce(F.when(value.isNotNull(), shown), F.lit("—"))
