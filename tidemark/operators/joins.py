"""As-of, range and interval joins, all as equi-joins on buckets of time or as one sorted pass; no nested loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.chunks import last_known, numbered

CHUNK = 30 * 86400.0


def asof(left: DataFrame, right: DataFrame, keys: list[str], time: str, columns: list[str], shift: float = 0.0, longest: float | None = None, forward: bool = False, tie: list[str] | None = None, chunk: float | None = CHUNK) -> DataFrame:
    """Each left row with the latest right row at or before its time plus ``shift`` (``forward``: the first at or after it).

    Both sides are united and read in order once. Of right rows at one time the last by ``tie`` counts. Columns come as ``right_<name>``, null where none is within ``longest`` seconds."""
    ties = tie or []
    side = 1 if not forward else -1
    order_of = lambda *c: F.struct(*[x.cast("double").alias(f"o{i}") for i, x in enumerate(c)]) if c else F.struct(F.lit(0.0).alias("o0"))
    l_rows = left.select(*keys, (F.col(time) + shift).alias("_t"), F.lit(side).alias("_side"), order_of(*[F.lit(None) for _ in ties]).alias("_tie"), F.struct(*left.columns).alias("_left"), F.lit(None).alias("_right"))
    r_rows = right.select(*keys, F.col(time).alias("_t"), F.lit(0).alias("_side"), order_of(*[F.col(c) for c in ties]).alias("_tie"), F.lit(None).alias("_left"), F.struct(F.col(time).alias("_t"), *columns).alias("_right"))
    both = last_known(l_rows.union(r_rows), keys, ["_t", "_side", "_tie"], F.col("_right"), chunk, **{"after" if forward else "before": "_met"})
    found = both.where("_left is not null")
    if longest is not None:
        found = found.withColumn("_met", F.when(F.abs(F.col("_t") - F.col("_met._t")) <= longest, F.col("_met")))
    return found.select("_left.*", F.col("_met._t").alias(f"right_{time}"), *[F.col(f"_met.{c}").alias(f"right_{c}") for c in columns])


def _bucketed(df: DataFrame, start: Column, end: Column, width: float, name: str) -> DataFrame:
    """A row for each bucket of time that [start, end] touches."""
    return df.withColumn(name, F.explode(F.sequence(F.floor(start / width), F.floor(end / width))))


def range_join(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, before: float, after: float, how: str = "inner") -> DataFrame:
    """Rows whose right time lies from ``before`` seconds before to ``after`` seconds after the left time.

    The right side stands in its bucket, the left in all it can reach: (before + after) wide, so two at most and one more. ``how`` may be
    inner, left_semi or left_anti; the last two give each left row at most once."""
    width = max(before + after, 1e-9)
    l_col, r_col = F.col(f"l.{left_time}"), F.col(f"r.{right_time}")
    near = (r_col >= l_col - before) & (r_col <= l_col + after)
    same = lambda: [F.col(f"l.{k}") == F.col(f"r.{k}") for k in keys] + [F.col("l._b") == F.col("r._b")]
    on = near
    for c in same():
        on = on & c
    r = right.withColumn("_b", F.floor(F.col(right_time) / width)).alias("r")
    if how == "inner":
        reach = _bucketed(left, F.col(left_time) - before, F.col(left_time) + after, width, "_b").alias("l")
        return reach.join(r, on).select(*[F.col(f"l.{c}") for c in left.columns], *[F.col(f"r.{c}").alias(f"right_{c}") for c in right.columns])
    # A left row counts once: the right side reaches out instead.
    wide = _bucketed(right, F.col(right_time) - after, F.col(right_time) + before, width, "_b").alias("r")
    own = left.withColumn("_b", F.floor(F.col(left_time) / width)).alias("l")
    return own.join(wide, on, how).select(*[F.col(f"l.{c}") for c in left.columns])


def nearest(left: DataFrame, right: DataFrame, keys: list[str], time: str, within: float, row_id: list[str], column: str) -> DataFrame:
    """Each left row with the right column nearest in time within ``within`` seconds; the earlier of equals. Others are null."""
    met = range_join(left, right, keys, time, time, within, within)
    gap = F.abs(F.col(f"right_{time}") - F.col(time))
    best = met.groupBy(*row_id).agg(F.min_by(F.col(f"right_{column}"), F.struct(gap.alias("g"), F.col(f"right_{time}").alias("t"), F.col(f"right_{column}").alias("c"))).alias(f"nearest_{column}"))
    return left.join(best, row_id, "left")


def _level(start: Column, end: Column, width: float) -> Column:
    """How often ``width`` must be doubled to be as long as an interval: at that width it stands in two buckets at most."""
    return F.when(end - start <= width, 0).otherwise(F.ceil(F.log2((end - start) / width)).cast("int"))


def _at_levels(df: DataFrame, start: Column, end: Column, width: float, levels: Column) -> DataFrame:
    """A row for each of these levels (``_l``) and each bucket (``_b``) touched at its width."""
    wide = F.pow(F.lit(2.0), F.col("_l")) * width
    each = df.withColumn("_l", F.explode(levels))
    return each.withColumn("_b", F.explode(F.sequence(F.floor(start / wide), F.floor(end / wide))))


def _levels(df: DataFrame, width: float) -> list[int]:
    """The levels that intervals ``_s, _e`` stand at; at most some dozens, since each doubles the length."""
    return sorted(r["l"] for r in df.select(_level(F.col("_s"), F.col("_e"), width).alias("l")).distinct().collect() if r["l"] is not None)


def within_intervals(points: DataFrame, intervals: DataFrame, keys: list[str], time: str, width: float, start: str = "start", end: str = "end") -> DataFrame:
    """Each point with every interval that holds it, ends included; the interval's other columns come as they are.

    An interval stands in two buckets at most, at the level of its length (``width`` seconds, doubled); a point stands in its bucket at each level there is."""
    s, e = F.col(start), F.col(end)
    levels = _levels(intervals.select(s.alias("_s"), e.alias("_e")), width)
    p = _at_levels(points, F.col(time), F.col(time), width, F.array(*map(F.lit, levels)).cast("array<int>")).alias("p")
    i = _at_levels(intervals, s, e, width, F.array(_level(s, e, width))).alias("i")
    on = (F.col("p._l") == F.col("i._l")) & (F.col("p._b") == F.col("i._b")) & (F.col(f"p.{time}") >= F.col(f"i.{start}")) & (F.col(f"p.{time}") <= F.col(f"i.{end}"))
    for k in keys:
        on = on & (F.col(f"p.{k}") == F.col(f"i.{k}"))
    return p.join(i, on).select(*[F.col(f"p.{c}") for c in points.columns], *[F.col(f"i.{c}") for c in intervals.columns if c not in keys])


def interval_overlap(left: DataFrame, right: DataFrame, keys: list[str], width: float) -> DataFrame:
    """Pairs of intervals ``start, end`` that overlap (end > start of the other), once each, with the part they share.

    Of two intervals the longer stands in two buckets at most, at the level of its length (``width`` seconds, doubled), however long it is; the shorter
    is looked up at that level. Of two of one level the left one is looked up."""
    s, e = F.col("start"), F.col("end")
    own = _level(s, e, width)

    def met(short: DataFrame, long: DataFrame, first: str, then: str, levels: list[int], least: Column) -> DataFrame:
        higher = F.filter(F.array(*map(F.lit, levels)).cast("array<int>"), lambda x: x >= least)
        a = _at_levels(short, s, e, width, higher).alias(first)
        b = _at_levels(long, s, e, width, F.array(own)).alias(then)
        on = (F.col("l._l") == F.col("r._l")) & (F.col("l._b") == F.col("r._b")) & (F.col("l.end") > F.col("r.start")) & (F.col("l.start") < F.col("r.end"))
        for k in keys:
            on = on & (F.col(f"l.{k}") == F.col(f"r.{k}"))
        # Of the buckets two intervals share, only the first makes a row.
        once = F.col("l._b") == F.floor(F.greatest(F.col("l.start"), F.col("r.start")) / (F.pow(F.lit(2.0), F.col("l._l")) * width))
        shared = (F.least("l.end", "r.end") - F.greatest("l.start", "r.start")).alias("shared")
        return a.join(b, on & once).select(*[F.col(f"l.{c}") for c in left.columns], *[F.col(f"r.{c}").alias(f"right_{c}") for c in right.columns], shared)

    of = lambda df: _levels(df.select(s.alias("_s"), e.alias("_e")), width)
    lefts, rights = of(left), of(right)
    out = met(left, right, "l", "r", rights, own)
    return out if not rights or not lefts or lefts[-1] <= rights[0] else out.unionByName(met(right, left, "r", "l", lefts, own + 1))


def suppress_near(df: DataFrame, hidden: DataFrame, keys: list[str], time: str, tolerance: float) -> DataFrame:
    """Rows with no hidden time within ``tolerance`` seconds."""
    return range_join(df, hidden, keys, time, time, tolerance, tolerance, "left_anti")


def spatial_anti(df: DataFrame, fixed: DataFrame, keys: list[str], radius: float) -> DataFrame:
    """Rows ``x, y`` farther than ``radius`` from every fixed point; points meet by grid cell.

    The places of the rows, each once, stand in the nine cells around them; a fixed point, of which there may be many more, in its own alone."""
    cell = lambda c: F.floor(F.col(c) / radius)
    around = lambda c: F.explode(F.sequence(cell(c) - 1, cell(c) + 1))
    place = [*keys, "x", "y"]
    spots = df.select(*place).distinct().withColumn("_gx", around("x")).withColumn("_gy", around("y")).alias("l")
    own = fixed.select(*place).withColumn("_gx", cell("x")).withColumn("_gy", cell("y")).alias("r")
    on = (F.col("l._gx") == F.col("r._gx")) & (F.col("l._gy") == F.col("r._gy")) & (F.hypot(F.col("l.x") - F.col("r.x"), F.col("l.y") - F.col("r.y")) <= radius)
    for k in keys:
        on = on & (F.col(f"l.{k}") == F.col(f"r.{k}"))
    near = spots.join(own, on, "left_semi").select(*place).distinct()
    return df.join(near, place, "left_anti").select(*df.columns)


def positional_diff(left: DataFrame, right: DataFrame, keys: list[str], order: list[str], values: list[str], chunk: float | None = CHUNK) -> DataFrame:
    """The n-th row of one side beside the n-th of the other, with the differences of their values and ``exact``."""
    l = numbered(left, keys, order, "nth", chunk).select(*keys, "nth", *[F.col(v).alias(f"left_{v}") for v in values])  # noqa: E741
    r = numbered(right, keys, order, "nth", chunk).select(*keys, "nth", *[F.col(v).alias(f"right_{v}") for v in values])
    met = l.join(r, [*keys, "nth"], "full_outer")
    exact = F.lit(True)
    for v in values:
        exact = exact & F.col(f"left_{v}").eqNullSafe(F.col(f"right_{v}"))
    return met.select("*", *[(F.col(f"right_{v}") - F.col(f"left_{v}")).alias(f"diff_{v}") for v in values], exact.alias("exact"))
