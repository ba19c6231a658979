"""Events and readings matched one to one, over keys of any length.

Readings that no event's window reaches, and windows that don't meet, have nothing to do with each other: a key is cut where no window spans. Within such a
stretch the free readings are a list in order of time with pointers to the next free one on both sides, so an event looks at two of them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.chunks import most_before, numbered, running_sum
from tidemark.operators.folds import per_group

#: Fixed values. Seconds a reading may lie before an event or after its end, and how long after an event its countdown shows.
BEFORE, AFTER, DELAY = 10.0, 7.0, 2.5
CHUNK = 86_400.0


class Free:
    """Times in rising order, each of which can be taken once; of equal times the first in order goes first."""

    def __init__(self, times: np.ndarray):
        self.times, first, counts = np.unique(times, return_index=True, return_counts=True)
        self.first, self.left = first.tolist(), counts.tolist()
        #: Where to look on for a free place, above and below each; below, places are counted from one and zero is none.
        self.above, self.below = list(range(len(self.left) + 1)), list(range(len(self.left) + 1))

    @staticmethod
    def _free(pointers: list[int], at: int) -> int:
        end = at
        while pointers[end] != end:
            end = pointers[end]
        while pointers[at] != end:
            pointers[at], at = end, pointers[at]
        return end

    def nearest(self, t: float, low: float, high: float) -> int | None:
        """Take the free time nearest to t within [low, high], the earlier of equals; its place in the original order."""
        at = int(np.searchsorted(self.times, t))
        sides = (self._free(self.below, at) - 1, self._free(self.above, at))
        ways = [(abs(self.times[i] - t), i) for i in sides if 0 <= i < len(self.left) and low <= self.times[i] <= high]
        if not ways:
            return None
        i = min(ways)[1]
        taken = self.first[i]
        self.first[i] += 1
        self.left[i] -= 1
        if not self.left[i]:
            self.above[i], self.below[i + 1] = i + 1, i
        return taken


def matched(t, end, sure, reading) -> list[tuple]:
    """``t, end, confidence, evidence_t, source`` of one stretch, whose rows come in order of time."""
    rows = list(zip(t, end, sure, reading, strict=True))
    readings = [r[:3] for r in rows if r[3]]
    free, used, out = Free(np.array([r[0] for r in readings], float)), set(), []
    for at, until, how, is_reading in rows:
        if is_reading:
            continue
        i = free.nearest(at, at - BEFORE, until + AFTER) if readings else None
        if i is None:
            out.append((at, until, how, None, "event"))
            continue
        used.add(i)
        seen = readings[i]
        start = min(at, round(max(0.0, seen[0] - DELAY), 2))
        out.append((start, until, max(how, seen[2]), seen[0], "evidence" if start < at else "event"))
    return out + [(round(max(0.0, r[0] - DELAY), 2), r[1], r[2], r[0], "evidence") for i, r in enumerate(readings) if i not in used]


def match_evidence(events: DataFrame, evidence: DataFrame, keys: list[str], chunk: float | None = CHUNK) -> DataFrame:
    """Events ``t, end, confidence`` and readings ``t, end, confidence`` matched one to one, nearest first in the events' order.

    A matched event starts no later than its reading less the delay and takes the greater confidence; a reading left over becomes an event of its own. Events are
    numbered by time; of equal times by end, confidence and evidence. Events and readings without a time are left out."""
    double = T.DoubleType()
    both = lambda df, reading: df.select(*keys, *[F.col(c).cast("double").alias(c) for c in ("t", "end", "confidence")], F.lit(reading).alias("_reading")).where("t is not null")
    rows = both(events, False).unionByName(both(evidence, True))
    rows = rows.withColumn("_from", F.when(F.col("_reading"), F.col("t")).otherwise(F.col("t") - BEFORE)).withColumn("_to", F.when(F.col("_reading"), F.col("t")).otherwise(F.greatest("t", F.coalesce("end", "t")) + AFTER))
    order = ["_from", "_to", "confidence", "_reading"]
    reached = most_before(rows, keys, order, F.col("_to"), "_reached", chunk)
    cut = running_sum(reached, keys, order, F.when(F.col("_reached").isNull() | (F.col("_from") > F.col("_reached")), 1).otherwise(0), "_stretch", chunk)

    def fold(*columns):
        out = matched(*columns)
        return [np.array([r[k] for r in out], object if k > 2 else float) for k in range(5)]

    made = [("t", double), ("end", double), ("confidence", double), ("evidence_t", double), ("source", T.StringType())]
    found = per_group(cut, [*keys, "_stretch"], ["t", "end", "confidence"], ["t", "end", "confidence", "_reading"], fold, made)
    placed = numbered(found, keys, ["t", "end", "confidence", "evidence_t", "source"], "nth", chunk)
    return placed.select(*keys, "nth", "t", "end", "confidence", "evidence_t", "source")
