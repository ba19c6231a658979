"""Line dedup over a suffix array of line ids, built by distributed prefix doubling.

A repeated run is a sequence of lines with ``min_words`` words or more that stands at several places. The first place in the
order of (id, line) stays; every line that a run covers at a later place is deleted. Lines without words aren't compared:
such a line shares the fate of the line with words before it, and stays where there is none.

Only lines that occur more than once can be part of a run, so suffixes start at those alone. Round k ranks every suffix by its
first 2^k lines: the pair of its rank by 2^(k-1) lines and that of the suffix 2^(k-1) lines on is ranked among the distinct
pairs, in sorted order. In the array so sorted the longest common prefix (LCP) of each suffix with the one before is measured.
Suffixes that share d lines lie in one interval, and it ends where an LCP is under d. Two depths of a suffix
tell all: m, its shortest prefix with ``min_words`` words, and each further depth up to ``cap``, where the suffix that starts one
line later has enough words of its own. For a line inside a run of which min_words words end with that line lies in the shortest
such stretch of it, and any other line lies in the shortest prefix with min_words words of what follows the run's start.
A line has a word at least, so depths stay within ``min_words`` lines, and rounds end there: deeper intervals delete no more.

Very common lines and pairs of ranks (a 1024th of all rows or more, so at most 1024 of them) are looked up in a broadcast table,
the others by a shuffle, so that no task holds all places of one.

Defined cases: a null text stays null and takes no part; an empty text is one line without words; rows with a null id come before
all others; rows that repeat an id and a text count as one document and get the same result; texts that share an id
are told apart. A line's words are what white space separates; ``\\n`` alone ends a line.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import aside, discard, durable
from tidemark.llm.spans import fixed

WORD = r"[^ \t\r\f\x0B]+"
MIN_WORDS = 10
#: A key with this part of all rows or more is a common one; there can't be more of them than this.
COMMON = 1024


def worded(text: str = "text"):
    """Array of (pos, line, words) of the lines that have words."""
    lines = F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("pos"), x.alias("line"), F.regexp_count(x, F.lit(WORD)).alias("words")))
    return F.filter(lines, lambda s: s["words"] > 0)


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, th, ord, h1, h2, words`` of every line with words; th tells texts with one id apart, h1 and h2 identify the line."""
    plain = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).where("text is not null")
    each = plain.select("id", F.xxhash64("text").alias("th"), F.posexplode(worded()).alias("ord", "s"))
    return each.select("id", "th", "ord", F.xxhash64("s.line").alias("h1"), F.xxhash64(F.lit("tidemark"), "s.line").alias("h2"), F.col("s.words").alias("words"))


def looked_up(rows: DataFrame, table: DataFrame, keys: list[str], value: str, total: int) -> DataFrame:
    """``rows`` that ``table`` (keys, value, ``n`` rows of each) knows, with the value; common keys don't meet in one task."""
    is_common = F.col("n") * COMMON >= total
    hot = table.where(is_common).select(*[F.col(k).alias(f"_h{i}") for i, k in enumerate(keys)], F.col(value).alias("_hot"))
    rest = table.where(~is_common).select(*[F.col(k).alias(f"_c{i}") for i, k in enumerate(keys)], F.col(value).alias("_rest"), (F.col("n") < 0).alias("_never"))
    met = rows.join(F.broadcast(hot), [F.col(k) == F.col(f"_h{i}") for i, k in enumerate(keys)], "left")
    # What is found already is spread over the tasks by its own place, under a second key that nothing else has.
    met = met.withColumn("_own", F.when(F.col("_hot").isNotNull(), F.xxhash64("id", "th", "ord")))
    on = [F.col(k) == F.col(f"_c{i}") for i, k in enumerate(keys)]
    found = met.join(rest.withColumn("_none", F.when(F.col("_never"), F.lit(0).cast("long"))), [*on, F.col("_own").eqNullSafe(F.col("_none"))], "left")
    kept = found.where("_hot is not null or _rest is not null")
    return kept.select(*rows.columns, F.coalesce("_hot", "_rest").alias(value))


def measured(repeated: DataFrame, min_words: int) -> DataFrame:
    """Repeated lines ``id, th, ord, words, r`` with ``m`` and ``cap`` (null where too few words follow) and ``next``: the ids of the next ``min_words`` lines."""

    def run(frames):
        held = None
        for frame in frames:
            frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
            if not len(frame):
                continue
            doc = frame[["id", "th"]].astype("string").fillna("").agg("|".join, axis=1).to_numpy()
            last = int(np.flatnonzero(doc != doc[-1])[-1]) + 1 if (doc != doc[-1]).any() else 0
            yield depths(frame.iloc[:last], doc[:last])
            held = frame.iloc[last:].reset_index(drop=True)
        if held is not None and len(held):
            yield depths(held, np.zeros(len(held)))

    def depths(frame: pd.DataFrame, doc: np.ndarray) -> pd.DataFrame:
        at, words, r, n = frame["ord"].to_numpy(), frame["words"].to_numpy(np.int64), frame["r"].to_numpy(np.int64), len(frame)
        starts = np.concatenate([[True], (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1)]) if n else np.zeros(0, bool)
        ends = np.append(np.flatnonzero(starts), n)[np.cumsum(starts)] if n else np.zeros(0, np.int64)
        upto = np.cumsum(words)
        full = np.searchsorted(upto, upto - words + min_words)  # the line that completes min_words from each start
        later = np.append(full[1:], n) if n else full
        cap = np.where(full < ends, np.minimum(later, ends) - np.arange(n), -1)
        m = np.where(full < ends, full - np.arange(n) + 1, -1)
        ahead = np.arange(n)[:, None] + np.arange(min_words)
        ids = np.where(ahead < ends[:, None], r[np.minimum(ahead, max(0, n - 1))] if n else -1, -1).astype(np.int64)
        whole = lambda x: pd.arrays.IntegerArray(x.astype(np.int32), x < 0)
        return frame.drop(columns="words").assign(m=whole(m), cap=whole(np.maximum(cap, m)), next=[row.tobytes() for row in ids])

    ordered = repeated.select("id", "th", "ord", "words", "r").repartition("id", "th").sortWithinPartitions("id", "th", "ord")
    id_type = repeated.schema["id"].dataType.simpleString()
    return ordered.mapInPandas(run, f"id {id_type}, th long, ord int, r long, m int, cap int, next binary")


def ranked(pairs: DataFrame) -> DataFrame:
    """``r1, r2, rank, n`` of the distinct pairs in sorted order: how many suffixes come before, how many have it. No task sorts them all."""
    spark = pairs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    distinct = pairs.groupBy("r1", "r2").agg(F.count("*").alias("n"))
    dealt = durable(distinct.repartitionByRange(tasks, "r1", "r2").withColumn("part", F.spark_partition_id()))
    # One row for each task of the sort.
    sizes = sorted((r["part"], r["n"]) for r in dealt.groupBy("part").agg(F.sum("n").alias("n")).collect())
    before, rows = 0, []
    for part, n in sizes:
        rows.append((part, before))
        before += n
    offsets = spark.createDataFrame(rows, "of int, before long")
    order = Window.partitionBy("part").orderBy("r1", "r2")
    within = dealt.select("part", "r1", "r2", "n", (F.sum("n").over(order) - F.col("n")).alias("within"))
    out = durable(within.join(F.broadcast(offsets), F.col("part") == F.col("of")).select("r1", "r2", (F.col("before") + F.col("within")).alias("rank"), "n"))
    discard(dealt)
    return out


def doubled(ranks: DataFrame, by: int, total: int) -> DataFrame:
    """Ranks by twice as many lines, from ``id, th, ord, r`` by ``by`` lines; -1 stands for what is after a run's end."""
    ahead = lambda c: F.lead(c, by).over(Window.partitionBy("id", "th").orderBy("ord"))
    pairs = durable(ranks.select("id", "th", "ord", F.col("r").alias("r1"), F.when(ahead("ord") == F.col("ord") + by, ahead("r")).otherwise(-1).alias("r2")))
    table = ranked(pairs)
    out = durable(looked_up(pairs, table, ["r1", "r2"], "rank", total).select("id", "th", "ord", F.col("rank").alias("r")))
    discard(pairs)
    discard(table)
    return out


def intervals(array: DataFrame, min_words: int) -> DataFrame:
    """``id, th, ord, t, part, k``: which interval of depth m + t each suffix lies in, from the suffix array's rows in order.

    Intervals are numbered within a task (part, k). Suffixes alone in theirs are left out. Rows with ``edge`` (1: first, 2: last
    row of a task, both 3) tell where an interval may go on in the next task."""
    id_type = array.schema["id"].dataType.simpleString()

    def run(frames):
        part = TaskContext.get().partitionId()
        held, number = None, np.zeros(min_words, np.int64)
        first = True
        for frame in (*frames, None):
            last = frame is None
            if not last and not len(frame):
                continue
            if held is not None:
                frame = held if last else pd.concat([held, frame], ignore_index=True)
            if frame is None:
                return
            n = len(frame)
            ids = np.frombuffer(b"".join(frame["next"]), np.int64).reshape(n, min_words)
            m, cap = frame["m"].to_numpy(np.int64), frame["cap"].to_numpy(np.int64)
            lcp = np.append(0, np.cumprod(ids[1:] == ids[:-1], axis=1).sum(axis=1))
            out = []
            for t in range(min_words):
                depth = m + t
                inside = depth <= cap
                if not inside.any():
                    break
                opens = ~((lcp >= depth) & inside)
                if held is not None:
                    opens[0] = False  # counted with the frame before
                k = number[t] + np.cumsum(opens)
                number[t] = k[-1]
                goes_on = np.append(~opens[1:], True)
                joined_before = ~opens if held is None else np.append(held_joined[t], ~opens[1:])
                border = np.zeros(n, np.int64)
                if first:
                    border[0] |= 1
                if last:
                    border[-1] |= 2
                take = inside & (joined_before | goes_on | (border > 0))
                if not last:
                    take[-1] = False  # told when it is known what follows
                at = np.flatnonzero(take)
                out.append(frame.iloc[at][["id", "th", "ord", "m", "cap", "next"]].assign(t=t, part=part, k=k[at], edge=border[at]))
            held_joined = {t: False for t in range(min_words)}
            for t in range(min_words):
                if n > 1 or held is None:
                    held_joined[t] = bool(n > 1 and lcp[-1] >= m[-1] + t and m[-1] + t <= cap[-1])
            if out:
                told = pd.concat(out)
                told["next"] = told["next"].where(told["edge"] > 0, None)
                yield told
            if last:
                return
            first = first and n == 1
            held = frame.iloc[-1:].reset_index(drop=True)

    return array.mapInPandas(run, f"id {id_type}, th long, ord int, m int, cap int, next binary, t int, part int, k long, edge int")


def bridges(edges: pd.DataFrame, min_words: int) -> list[tuple[int, int, int, int, int]]:
    """(t, part, k, part it began in, k there) of intervals that go on over the borders of tasks; a few rows for each task."""
    out = []
    for t, rows in edges.groupby("t"):
        began: dict[tuple[int, int], tuple[int, int]] = {}
        firsts = {r.part: r for r in rows[(rows["edge"] & 1) > 0].itertuples()}
        lasts = {r.part: r for r in rows[(rows["edge"] & 2) > 0].itertuples()}
        before = None
        for part in sorted(set(edges["part"])):
            a, b = before, firsts.get(part)
            if a is not None and b is not None:
                x, y = (np.frombuffer(r.next, np.int64) for r in (a, b))
                if (x == y).cumprod().sum() >= b.m + t:
                    began[(part, b.k)] = began.get((a.part, a.k), (a.part, a.k))
                    out.append((int(t), part, int(b.k), *map(int, began[(part, b.k)])))
            before = lasts.get(part)
    return out


def later_copies(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, th, ord``: each line to delete, by its number among the lines with words, once."""
    spark = docs.sparkSession
    lines = durable(lines_of(docs, id_col, text_col))
    ids = durable(lines.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").withColumn("r", F.monotonically_increasing_id()))
    total = ids.agg(F.sum("n")).first()[0] or 0
    found = looked_up(lines, ids, ["h1", "h2"], "r", total).select("id", "th", "ord", "words", "r").dropDuplicates(["id", "th", "ord"])
    starts = durable(measured(found, min_words))
    discard(lines)
    discard(ids)
    longest = starts.agg(F.max("cap")).first()[0] or 0
    level, by = starts.select("id", "th", "ord", "r"), 1
    while 2 * by <= longest:
        deeper = doubled(level, by, total)
        if by > 1:
            discard(level)
        level, by = deeper, 2 * by
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranks = level.select(F.col("id").alias("i2"), F.col("th").alias("t2"), F.col("ord").alias("o2"), F.col("r").alias("rank"))
    suffixes = starts.where("m is not null").drop("r").join(ranks, F.col("id").eqNullSafe(F.col("i2")) & (F.col("th") == F.col("t2")) & (F.col("ord") == F.col("o2")))
    # Suffixes of one rank share 2^k lines; their further lines order them.
    keys = ["rank", "next", "id", "th", "ord"]
    array = suffixes.select(*keys, "m", "cap").repartitionByRange(tasks, *keys).sortWithinPartitions(*keys)
    told = durable(intervals(array, min_words))
    discard(starts)
    edges = told.where("edge > 0").select("t", "part", "k", "edge", "m", "next").toPandas()
    joined = spark.createDataFrame(bridges(edges, min_words), "bt int, bp int, bk long, part0 int, k0 long")
    named = told.join(F.broadcast(joined), (F.col("t") == F.col("bt")) & (F.col("part") == F.col("bp")) & (F.col("k") == F.col("bk")), "left")
    named = durable(named.select("id", "th", "ord", (F.col("m") + F.col("t")).alias("depth"), "t", F.coalesce("part0", "part").alias("part"), F.coalesce("k0", "k").alias("k")))
    place = F.struct("id", "th", "ord")
    kept = durable(named.groupBy("t", "part", "k").agg(F.min(place).alias("kept"), F.count("*").alias("n")).where("n > 1"))
    later = looked_up(named, kept, ["t", "part", "k"], "kept", named.count()).where(place > F.col("kept"))
    deepest = later.groupBy("id", "th", "ord").agg(F.max("depth").alias("depth"))
    return deepest.select("id", "th", F.explode(F.sequence("ord", F.col("ord") + F.col("depth") - 1)).alias("ord")).distinct()


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with later copies of repeated runs deleted from their text, and ``n_lines``, ``n_deleted``."""
    gone = durable(later_copies(docs, min_words, id_col, text_col).groupBy("id", "th").agg(F.collect_list("ord").alias("_gone")))
    docs, names = aside(docs)
    own_id, own_text = names[id_col], names[text_col]
    met = docs.withColumn("_th", F.xxhash64(own_text)).join(gone.select(F.col("id").alias("_id"), F.col("th").alias("_gth"), "_gone"), F.col(own_id).eqNullSafe(F.col("_id")) & (F.col("_th") == F.col("_gth")), "left")
    met = fixed(met, _lines=F.split(own_text, "\n"))
    met = fixed(met, _at=F.when(F.col("_gone").isNotNull(), F.concat(F.transform(worded(own_text), lambda s: s["pos"]), F.array(F.size("_lines")))))
    met = fixed(met, _out=F.flatten(F.transform("_gone", lambda o: F.sequence(F.get("_at", o), F.get("_at", o + 1) - 1))))
    left = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_out"))
    text = F.when(F.col("_gone").isNull(), F.col(own_text)).otherwise(F.array_join(F.transform(left, lambda i: F.get("_lines", i)), "\n"))
    n_lines = F.when(F.col(own_text).isNull(), 0).otherwise(F.size("_lines")).cast("long")
    n_gone = F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_out")).cast("long")
    own = [(text if c == text_col else F.col(n)).alias(c) for c, n in names.items() if c not in ("n_lines", "n_deleted")]
    return met.select(*own, n_lines.alias("n_lines"), n_gone.alias("n_deleted"))


#: The same result in DuckDB SQL. A window is the shortest run of lines with 10 words from its first line, or up to its last; what a
#: later copy of one covers goes, with the lines without words that follow.
ORACLE = """
WITH lines AS (
  SELECT doc_id, unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) AS pos, unnest(string_split(text, chr(10))) AS line FROM documents
), counted AS (
  SELECT *, len(regexp_extract_all(line, '[^ \\t\\r\\f\\x0B]+')) AS words FROM lines
), worded AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS ord, sum(words) OVER (PARTITION BY doc_id ORDER BY pos) AS upto,
    lead(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS following
  FROM counted WHERE words > 0
), ends AS (
  SELECT a.doc_id, a.ord AS first, min(b.ord) AS last FROM worded a JOIN worded b
  ON a.doc_id = b.doc_id AND b.ord BETWEEN a.ord AND a.ord + 9 AND b.upto - a.upto + a.words >= 10 GROUP BY ALL
  UNION
  SELECT a.doc_id, max(b.ord) AS first, a.ord AS last FROM worded a JOIN worded b
  ON a.doc_id = b.doc_id AND b.ord BETWEEN a.ord - 9 AND a.ord AND a.upto - b.upto + b.words >= 10 GROUP BY a.doc_id, a.ord
), windows AS (
  SELECT e.doc_id, e.first, e.last, string_agg(r.line, chr(10) ORDER BY r.ord) AS run FROM ends e JOIN worded r
  ON e.doc_id = r.doc_id AND r.ord BETWEEN e.first AND e.last GROUP BY ALL
), later AS (
  SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, first) AS nth FROM windows
), gone AS (
  SELECT DISTINCT l.doc_id, l.pos FROM later w JOIN worded r ON w.doc_id = r.doc_id AND r.ord BETWEEN w.first AND w.last AND w.nth > 1
  JOIN lines l ON l.doc_id = r.doc_id AND l.pos >= r.pos AND (r.following IS NULL OR l.pos < r.following)
)
SELECT l.doc_id, coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (g.pos IS NULL), '') AS text,
  count(*)::BIGINT AS n_lines, count(g.pos)::BIGINT AS n_deleted
FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id
"""
