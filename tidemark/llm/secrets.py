"""Secret scan with multipart credential linking, in SQL functions alone.

Strong kinds (``assign``, ``access``, ``hex``) are reported wherever they match. Weak kinds say little alone: a
40-character key, an account or client name, a service address. They are joined by interval within a scope (so many
code points around) and reported only when complementary parts are there: a weak key with an access identifier or an
account name; a name or an address only when an identifier, a key and the other are in the scope too.

Defined cases: a null text counts as empty; an empty text has no spans; ties sort by start, then by kind in the order
listed; repeated rows are scanned each; further columns are left alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import aside
from tidemark.llm.spans import fixed, last_before, with_matches

#: The strong patterns. Those of ``access`` and ``hex`` hold the least length, which for maximal runs
#: finds what dropping shorter runs would leave.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGN_VALUE = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""
STRONG = {"assign": ASSIGN, "access": r"AKIA[A-Z0-9]{12,}", "hex": r"[0-9a-f]{32,}"}
LEAST_VALUE = 8
#: Weak patterns.
WEAK = {
    "key40": r"(?<![A-Za-z0-9+/=])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])",
    "account": r"""(?i:account|user(?:name)?|login|client_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}""",
    "endpoint": r"(?i:https?|jdbc:[a-z]+|amqps?|rediss?|mongodb|postgres(?:ql)?|mysql)://[A-Za-z0-9._:@/-]{4,}",
}
KINDS = [*STRONG, *WEAK]
#: Code points between parts of one credential.
SCOPE = 240
#: Code points in a block that masking cuts from.
CUT = 4096


def _tagged(matches: Column, kind: str) -> Column:
    return F.transform(matches, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), s["end"].alias("end")))


def _linked(df: DataFrame, out: str, spans: str, others: str, scope: int) -> DataFrame:
    """Add ``out``: for each of ``spans`` whether one of ``others`` lies within the scope of it without overlapping it.

    An interval join by a sweep over the sorted ends before and the sorted starts after."""
    ends = F.transform(others, lambda o: F.struct(o["end"].alias("pos"), o["end"].alias("val")))
    starts = F.transform(others, lambda o: F.struct((-o["start"]).alias("pos"), (-o["start"]).alias("val")))
    df = last_before(df, "_left", ends, F.transform(spans, lambda s: s["start"]), True)
    df = last_before(df, "_right", starts, F.reverse(F.transform(spans, lambda s: -s["end"])), True)
    left = F.zip_with(spans, "_left", lambda s, end: F.coalesce(s["start"] - end <= scope, F.lit(False)))
    right = F.zip_with(spans, F.reverse("_right"), lambda s, start: F.coalesce(-start - s["end"] <= scope, F.lit(False)))
    df = fixed(df, _l=left, _r=right)
    return fixed(df, **{out: F.zip_with("_l", "_r", lambda x, y: x | y)}).drop("_left", "_right", "_l", "_r")


def _covered(df: DataFrame, out: str, spans: str) -> DataFrame:
    """Add ``out``: for each of ``spans`` whether a strong span overlaps it."""
    base = F.transform("base", lambda b: F.struct(b["start"].alias("pos"), b["end"].alias("val")))
    df = last_before(df, "_over", base, F.transform(spans, lambda s: s["end"]), False)
    return fixed(df, **{out: F.zip_with(spans, "_over", lambda s, end: F.coalesce(end > s["start"], F.lit(False)))}).drop("_over")


def _listed(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """Add ``base`` and ``found``: arrays of (start, rank of kind, end) of the strong spans, and of all spans. Columns of these names are replaced."""
    plain, names = aside(docs)
    df = fixed(plain, _text=F.coalesce(F.col(names[text_col]), F.lit("")))
    df = with_matches(df, "_text", {f"_{k}": p for k, p in {**STRONG, **WEAK}.items()})
    long_enough = F.filter("_assign", lambda s: F.length(F.regexp_extract(s["match"], ASSIGN_VALUE, 1)) >= LEAST_VALUE)
    df = fixed(df, **{k: _tagged(long_enough if k == "assign" else F.col(f"_{k}"), k) for k in KINDS})
    # Parts that may complete each other are joined only in texts with a weak part.
    weak = F.size("key40") + F.size("account") + F.size("endpoint") > 0
    only = lambda c: F.when(weak, F.sort_array(c)).otherwise(F.slice(F.col("key40"), 1, 0))
    df = fixed(df, base=F.concat("assign", "access", "hex"), _names=only(F.concat("access", "account")), _keys=only(F.concat("assign", "hex", "key40")), _places=only(F.col("endpoint")))
    needs = {"key40": ["_names"], "account": ["_keys", "_places"], "endpoint": ["_keys", "_names"]}
    for kind, others in needs.items():
        df = _covered(df, f"_c_{kind}", kind)
        for other in others:
            df = _linked(df, f"_n_{kind}{other}", kind, other, scope)
        met = reduce(lambda x, y: F.zip_with(x, y, lambda p, q: p & q), [F.col(f"_n_{kind}{o}") for o in others])
        df = fixed(df, **{f"_t_{kind}": F.zip_with(f"_c_{kind}", met, lambda c, n: n & ~c)})
    told = [F.filter(F.zip_with(k, f"_t_{k}", lambda s, t: F.when(t, s)), lambda s: s.isNotNull()) for k in needs]
    df = fixed(df, found=F.concat("base", F.when(weak, F.concat(*[F.coalesce(c, F.slice("base", 1, 0)) for c in told])).otherwise(F.slice("base", 1, 0))))
    return df.select(*[F.col(n).alias(c) for c, n in names.items() if c not in ("base", "found")], "base", "found")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts of the strong kinds, the digest of their spans, and all spans."""
    df = scan(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")))
    count = lambda k: F.size(F.filter("base", lambda s: s["rank"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return df.select(F.col("id").alias(id_col), count("assign"), count("access"), count("hex"), F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), _listed(F.col("found")).alias("spans"))


def mask(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The documents with every reported span replaced by ``mark``; overlapping spans become one mark.

    What stays lies between the ends so far and the next start beyond them; it is cut from blocks of the text, so that very
    many secrets in a very long text cost little more than its length."""
    plain, names = aside(docs)
    df = fixed(scan(plain, names[text_col]), _ordered=F.array_sort("found"))
    numbered = F.transform("_ordered", lambda s, i: F.struct(i.alias("pos"), s["end"].alias("val")))
    df = last_before(df, "_upto", numbered, F.transform("_ordered", lambda s, i: i), False)
    between = F.zip_with("_ordered", "_upto", lambda s, upto: F.struct(F.coalesce(upto, F.lit(0).cast("long")).alias("from"), s["start"].alias("to")))
    rest = F.struct(F.array_max("_ordered.end").alias("from"), F.length(names[text_col]).cast("long").alias("to"))
    some = F.size("_ordered") > 0
    df = fixed(df, _stays=F.when(some, F.filter(F.concat(between, F.array(rest)), lambda g: g["to"] >= g["from"])), _blocks=F.when(some, F.regexp_extract_all(names[text_col], F.lit(f"(?s).{{1,{CUT}}}"), F.lit(0))))

    def cut(g: Column) -> Column:
        first, last = F.floor(g["from"] / CUT).cast("int"), F.floor(g["to"] / CUT).cast("int")
        return F.substring(F.array_join(F.slice("_blocks", first + 1, last - first + 1), ""), (g["from"] - first * CUT).cast("int") + 1, (g["to"] - g["from"]).cast("int"))

    masked = F.when(some, F.array_join(F.transform("_stays", cut), mark)).otherwise(F.col(names[text_col]))
    return df.select(*[(masked if c == text_col else F.col(n)).alias(c) for c, n in names.items()])
