"""Best-fit packing of token pieces after Martello-Toth dominance reduction.

Packing depends on piece lengths alone, and there are at most ``capacity`` of those. So Spark counts the pieces of
each length, and the packing is worked out on that histogram: every step places as many sequences of a kind at once as the
counts allow, so the plan grows with the lengths and not with the corpus. Each piece finds its place by its rank among the
pieces of its length. Ranks are taken within (length, salt), so that a length
shared by many pieces is spread over the tasks.

Defined cases: a null text is empty and yields its end token alone; repeated rows are packed each; an empty table
yields no rows.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import bpe
from tidemark.llm.common import durable

#: Places up to this many are broadcast; a plan beyond, which no known histogram gives, is joined.
BROADCAST = 1 << 18
#: A sequence filled alike many times: ((length, times), ...) and how many such sequences.
Pattern = tuple[tuple[tuple[int, int], ...], int]


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> tuple[list[Pattern], dict[int, int]]:
    """Fix sets that dominate every other set with the same largest piece; returns them and the lengths left.

    For the largest piece j: alone, if nothing fits beside it; with the largest piece that fits, if the two fill the
    sequence exactly, if no third piece can fit, or if that piece is no shorter than any two that fit beside j."""
    left = {k: n for k, n in counts.items() if n > 0}
    fixed: list[Pattern] = []
    order = sorted(left, reverse=True)

    def largest(at_most: int) -> int:
        return next((k for k in order if k <= at_most and left[k] > 0), 0)

    for j in order:
        while left[j] > 0:
            room = capacity - j
            smallest = sorted(k for k in order if left[k] > 0)
            others = [k for k in smallest for _ in range(min(3, left[k] - (k == j)))][:3]
            if not others or others[0] > room:
                fixed.append((((j, 1),), left[j]))
                left[j] = 0
                continue
            mate = largest(room)
            if mate == j and left[j] < 2:
                mate = next((k for k in order if k < j and k <= room and left[k] > 0), 0)
            at_most_one = len(others) < 2 or others[0] + others[1] > room
            at_most_two = len(others) < 3 or sum(others) > room
            if not (mate == room or at_most_one or at_most_two and mate >= _best_pair(left, order, room, j)):
                break
            # Fewer pieces leave each of these conditions true, and the mate the largest that fits, until one of the two is used up.
            if mate == j:
                times = left[j] // 2
                fixed.append((((j, 2),), times))
                left[j] -= 2 * times
            else:
                times = min(left[j], left[mate])
                fixed.append((((j, 1), (mate, 1)), times))
                left[j] -= times
                left[mate] -= times
    return fixed, {k: n for k, n in left.items() if n > 0}


def _best_pair(left: dict[int, int], order: list[int], room: int, j: int) -> int:
    """The largest sum of two pieces beside j within ``room``."""
    have = sorted(k for k in order if left[k] - (k == j) > 0)
    best, lo, hi = 0, 0, len(have) - 1
    while lo <= hi:
        total = have[lo] + have[hi]
        if total > room:
            hi -= 1
        else:
            if lo < hi or left[have[lo]] - (have[lo] == j) > 1:
                best = max(best, total)
            lo += 1
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best fit in order of falling length, all pieces of a length and all sequences with equal room at a time."""
    rooms: dict[int, list[list]] = defaultdict(list)  # room -> [pattern, sequences]
    for k in sorted(counts, reverse=True):
        n = counts[k]
        for room in range(k, capacity):
            while n and rooms.get(room):
                pattern, have = rooms[room].pop()
                each = room // k
                full = min(have, n // each)
                if full:
                    rooms[room - each * k].append([(*pattern, (k, each)), full])
                    n -= full * each
                if full < have:
                    some = min(n, each)
                    if some:
                        rooms[room - some * k].append([(*pattern, (k, some)), 1])
                        n -= some
                    if rest := have - full - (1 if some else 0):
                        rooms[room].append([pattern, rest])
            if not n:
                break
        each = capacity // k
        if n // each:
            rooms[capacity - each * k].append([((k, each),), n // each])
        if n % each:
            rooms[capacity - n % each * k].append([((k, n % each),), 1])
    return [(pattern, have) for groups in rooms.values() for pattern, have in groups]


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Places of all pieces: (length, first rank, end rank, first sequence, pieces in each, offset of the first)."""
    fixed, rest = reduce_by_dominance(counts, capacity)
    used: dict[int, int] = defaultdict(int)
    places, sequence = [], 0
    for pattern, have in [*fixed, *best_fit(rest, capacity)]:
        offset = 0
        for length, each in pattern:
            places.append((length, used[length], used[length] + have * each, sequence, each, offset))
            used[length] += have * each
            offset += length * each
        sequence += have
    return places


def pack(pieces: DataFrame, capacity: int, order_by: list[str], length_col: str = "length") -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a table of pieces whose lengths are 1 to ``capacity``.

    ``pieces`` must give the same rows whenever it is read (a stored table). The histogram holds at most
    ``capacity`` rows, the broadcast places a few for each of them."""
    spark = pieces.sparkSession
    salts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(*order_by), F.lit(salts)))
    groups = durable(salted.groupBy(F.col(length_col).alias("_len"), F.col("_salt").alias("_s")).agg(F.count("*").alias("_n")))
    counts = {r["_len"]: r["_n"] for r in groups.groupBy("_len").agg(F.sum("_n").alias("_n")).collect()}
    planned = plan(counts, capacity)
    places = spark.createDataFrame(planned, "_plen long, _from long, _to long, _seq long, _each long, _off long")
    places = F.broadcast(places) if len(planned) <= BROADCAST else places
    before = groups.select("_len", "_s", (F.sum("_n").over(Window.partitionBy("_len").orderBy("_s")) - F.col("_n")).alias("_before"))
    within = F.row_number().over(Window.partitionBy(length_col, "_salt").orderBy(*order_by))
    ranked = salted.withColumn("_within", within).join(before, (F.col(length_col) == F.col("_len")) & (F.col("_salt") == F.col("_s"))).withColumn("_rank", F.col("_before") + F.col("_within") - 1)
    placed = ranked.join(places, (F.col(length_col) == F.col("_plen")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
    nth = F.col("_rank") - F.col("_from")
    return placed.select(
        *[pieces[c] for c in pieces.columns],
        (F.col("_seq") + F.floor(nth / F.col("_each"))).alias("sequence_id"),
        (F.col("_off") + (nth % F.col("_each")) * F.col(length_col)).alias("offset"),
    )


def pack_documents(docs: DataFrame, vocab_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenize, append ``end_id``, cut what is longer than ``capacity`` and pack: one row per piece."""
    pieces = durable(bpe.piece_digests(docs, vocab_path, capacity, end_id, id_col, text_col))
    return pack(pieces, capacity, [id_col, "piece", "start", "length", "ids_crc32"])
