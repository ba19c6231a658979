"""Recordings, matches and their analysis documents as nested rows: expanding, pruning, looking up, and rebuilding the store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The fields a search list shows; the fields of an event that hold a conclusion; the source prefix that marks one.
SEARCH_FIELDS = ["id", "recorded_at", "stage", "rule", "outcome", "self_weapon", "enemy_weapons", "kills", "deaths"]
CONCLUSIONS = ["title", "situation", "cause"]
CONCLUDED = "codex"
FULL_ROSTER = 4


def analysed_matches(recordings: DataFrame) -> DataFrame:
    """A row for each match of a recording (``matches: array<struct<..., analysis_url>>``) that has an analysis."""
    rest = [c for c in recordings.columns if c != "matches"]
    return recordings.select(*rest, F.inline("matches")).where("analysis_url is not null and analysis_url <> ''")


def search_view(records: DataFrame, fields: list[str] = SEARCH_FIELDS) -> DataFrame:
    """The columns of a search list; what a scan need not read is pruned."""
    return records.select(*fields)


def summary(documents: DataFrame) -> DataFrame:
    """What a list shows of an analysis document: the last count alone, and whether there is a death analysis."""
    return documents.select(
        "id",
        "outcome",
        F.slice("game_counts", -1, 1).alias("game_counts"),
        F.struct("stage", "rule").alias("stage_map"),
        F.struct("kills", "deaths").alias("player_stats"),
        F.coalesce(F.size("death_analysis") > 0, F.lit(False)).alias("has_death_analysis"),
    )


def detected_events(events: Column, fields: list[str]) -> Column:
    """Events (structs with ``fields``) as they were detected: an event of a concluded source loses its conclusions and its source."""
    gone = {*CONCLUSIONS, "analysis_source"}

    def plain(e: Column) -> Column:
        concluded = F.coalesce(F.startswith(e["analysis_source"], F.lit(CONCLUDED)), F.lit(False))
        return F.struct(*[(F.when(~concluded, e[f]) if f in gone else e[f]).alias(f) for f in fields])

    return F.transform(events, plain)


def looked_up(document: Column, path: str, kind: str) -> Column:
    """The value at a dotted path of a JSON text; null where a part is missing or has another type."""
    steps = "".join(f"[{p}]" if p.isdigit() else f".{p}" for p in path.split("."))
    return F.try_variant_get(F.try_parse_json(document), f"${steps}", kind)


def missing_details(records: DataFrame) -> DataFrame:
    """Records without a stage, a rule, an own weapon or a whole roster."""
    whole = F.coalesce(F.size("enemy_weapons") >= FULL_ROSTER, F.lit(False))
    return records.where(F.col("stage").isNull() | F.col("rule").isNull() | F.col("self_weapon").isNull() | ~whole)


def united(detections: list[DataFrame], time: str = "t") -> DataFrame:
    """The detections of several detectors, repeats included, by first time."""
    out = detections[0]
    for more in detections[1:]:
        out = out.unionByName(more)
    return out.orderBy(time)


def recovered(files: DataFrame, manifests: DataFrame, clips: DataFrame, analyses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The store rebuilt from listings: matches (``id, number, start, end, status, events``) and recordings (``id, status, matches``).

    ``manifests`` hold ``segments: array<struct<start, end>>``; a segment counts where its clip (``id, number``) is there, and is ready
    where its analysis (``id, number, events``) is. A recording is ready if it has matches and all are."""
    parts = files.join(manifests, "id").select("id", F.posexplode("segments").alias("at", "s"))
    cut = parts.select("id", (F.col("at") + 1).alias("number"), "s.start", "s.end").join(clips.select("id", "number").distinct(), ["id", "number"], "left_semi")
    told = analyses.groupBy("id", "number").agg(F.max("events").alias("events"))
    matches = cut.join(told, ["id", "number"], "left").select("id", "number", "start", "end", F.when(F.col("events").isNotNull(), "ready").otherwise("split").alias("status"), F.coalesce("events", F.lit(0)).alias("events"))
    by = matches.groupBy("id").agg(F.count("*").alias("matches"), F.count(F.when(F.col("status") == "ready", 1)).alias("ready"))
    status = F.when(F.col("matches") == F.col("ready"), "ready").otherwise("queued")
    recordings = files.join(by, "id", "left").select("id", F.coalesce(status, F.lit("queued")).alias("status"), F.coalesce("matches", F.lit(0)).alias("matches"))
    return matches, recordings
