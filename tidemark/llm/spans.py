"""Regular-expression matches with their places, in SQL functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lengths are summed in blocks of so many, so that a text with very many matches takes no quadratic time.
BLOCK = 64


def fixed(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are worked out once per row, whatever later reads them how often.

    A generator of one row is a border that the optimizer doesn't merge projections across."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def _block_sums(lengths: str) -> Column:
    return F.transform(F.sequence(F.lit(0), F.expr(f"cast(size({lengths}) div {BLOCK} as int)")), lambda b: _sum(F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK))))


def _sums_before(sums: str) -> Column:
    return F.transform(sums, lambda _, i: _sum(F.slice(sums, F.lit(1), i)))


def _placed(n: str):
    def place(m: Column, i: Column) -> Column:
        block = F.floor(i / BLOCK).cast("int")
        end = F.get(f"{n}_o", block) + _sum(F.slice(f"{n}_l", block * BLOCK + 1, i - block * BLOCK + 1))
        return F.struct((end - F.length(m)).alias("start"), end.alias("end"), m.alias("match"))

    return place


def last_before(df: DataFrame, out: str, points: Column, queries: Column, inclusive: bool) -> DataFrame:
    """Add ``out``: for each query place, in rising order, the greatest ``val`` of the points at or (unless ``inclusive``) before it; null if none.

    Points (``pos, val``) and queries lie sorted in one array; maxima of blocks, and of the blocks before, answer a query from
    a block's worth of entries, so many spans in one text cost little more than their number."""
    point = F.transform(points, lambda p: F.struct(p["pos"].alias("pos"), F.lit(0 if inclusive else 1).alias("turn"), p["val"].alias("val"), F.lit(False).alias("asks")))
    query = F.transform(queries, lambda q: F.struct(q.alias("pos"), F.lit(1 if inclusive else 0).alias("turn"), F.lit(None).cast("long").alias("val"), F.lit(True).alias("asks")))
    df = fixed(df, _e=F.when(F.size(queries) > 0, F.array_sort(F.concat(point, query))))
    df = fixed(df, _v=F.col("_e.val"))
    blocks = F.sequence(F.lit(0), F.expr(f"cast(size(_v) div {BLOCK} as int)"))
    df = fixed(df, _b=F.transform(blocks, lambda b: F.array_max(F.slice("_v", b * BLOCK + 1, F.lit(BLOCK)))))
    df = fixed(df, _o=F.transform("_b", lambda _, i: F.array_max(F.slice("_b", F.lit(1), i))))

    def answer(e: Column, i: Column) -> Column:
        block = F.floor(i / BLOCK).cast("int")
        own = F.array_max(F.slice("_v", block * BLOCK + 1, i - block * BLOCK + 1))
        return F.struct(e["asks"].alias("asks"), F.when(e["asks"], F.greatest(F.get("_o", block), own)).alias("val"))

    df = fixed(df, **{out: F.transform(F.filter(F.transform("_e", answer), lambda a: a["asks"]), lambda a: a["val"])})
    return df.drop("_e", "_v", "_b", "_o")


def with_matches(df: DataFrame, text: str, patterns: dict[str, str]) -> DataFrame:
    """For each name and pattern a column name: array of (start, end, match), in code points, end exclusive, leftmost non-overlapping.

    The text between the matches is split off by the same pattern; a match starts after all pieces and matches before it."""
    df = fixed(df, **{f"{n}_m": F.regexp_extract_all(text, F.lit(p), F.lit(0)) for n, p in patterns.items()})
    none = F.array().cast("array<string>")
    df = fixed(df, **{f"{n}_p": F.when(F.size(f"{n}_m") > 0, F.transform(F.split(text, p, -1), lambda x: F.length(x).cast("long"))).otherwise(F.array().cast("array<long>")) for n, p in patterns.items()})
    df = fixed(df, **{f"{n}_l": F.zip_with(f"{n}_m", F.slice(f"{n}_p", 1, F.size(f"{n}_m")), lambda m, p: p + F.length(m)) for n in patterns})
    df = fixed(df, **{f"{n}_b": _block_sums(f"{n}_l") for n in patterns})
    df = fixed(df, **{f"{n}_o": _sums_before(f"{n}_b") for n in patterns})
    found = {n: F.transform(F.coalesce(f"{n}_m", none), _placed(n)) for n in patterns}
    df = fixed(df, **found)
    return df.drop(*[f"{n}_{x}" for n in patterns for x in "mplbo"])
