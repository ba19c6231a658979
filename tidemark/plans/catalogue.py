"""The registered queries over the driver's tables, each beside the same result in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import columns as fx
from tidemark.operators import choices, joins, records, templates, windows
from tidemark.plans import fold_queries, live_queries, record_queries, search
from tidemark.plans.adapters import MATCH_RECORDS_SQL, TIMELINE_SQL, match_records, table, timeline
from tidemark.plans.analytics import QuerySpec, cube_query, filter_records, rollup_audit, run_query

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

KEY, ORDER = ["key"], ["t", "id"]
SESSION_GAP, HOLD = 21_600.0, 7_200.0
NOW = datetime(1996, 6, 1)


def registered(sql: str | None = None, name: str | None = None):
    def keep(f: Query) -> Query:
        _QUERIES[name or f.__name__] = f
        if sql:
            _SQL[name or f.__name__] = sql
        return f

    return keep


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n).cast("double"), 6) for n in names})


# Metric by dimension -------------------------------------------------------------------------------------------------

_VALUES = {
    "matchCount": ("count(*)::DOUBLE", "count(*)"),
    "winRate": ("count(*) FILTER (outcome = 'win') / nullif(count(outcome), 0)::DOUBLE", "count(outcome)"),
    "lossRate": ("count(*) FILTER (outcome = 'lose') / nullif(count(outcome), 0)::DOUBLE", "count(outcome)"),
    "averageKills": ("avg(kills)", "count(kills)"),
    "averageDeaths": ("avg(deaths)", "count(deaths)"),
    "kdRatio": ("sum(kills) FILTER (deaths IS NOT NULL) / nullif(sum(deaths) FILTER (kills IS NOT NULL), 0)", "count(*) FILTER (kills IS NOT NULL AND deaths IS NOT NULL)"),
    "averageDisadvantage": ("avg(disadvantage_seconds)", "count(disadvantage_seconds)"),
    "averageAdvantage": ("avg(advantage_seconds)", "count(advantage_seconds)"),
    "averageDuration": ("avg(duration_seconds)", "count(duration_seconds)"),
    "rosterCoverage": ("count(*) FILTER (len(enemy_weapons) > 0) / count(*)::DOUBLE", "count(*)"),
}
_CASE = lambda x, buckets: "CASE WHEN " + x + " IS NULL THEN NULL " + " ".join(f"WHEN {x} <= {b} THEN '{n}'" for n, b in buckets[:-1]) + f" ELSE '{buckets[-1][0]}' END"
_KEYS = {
    "none": "'全体'",
    "day": "strftime(recorded_at, '%Y-%m-%d')",
    "stage": "stage",
    "rule": "rule",
    "selfWeapon": "self_weapon",
    "opponentWeapon": "unnest(list_distinct(enemy_weapons))",
    "outcome": "CASE outcome WHEN 'win' THEN 'WIN' WHEN 'lose' THEN 'LOSE' ELSE '未取得' END",
    "deathBucket": _CASE("deaths", fx.DEATH_BUCKETS),
    "disadvantageBucket": _CASE("disadvantage_seconds", fx.DISADVANTAGE_BUCKETS),
}


def _cube_sql(metric: str, dimension: str, where: str = "true", least: int = 1) -> str:
    value, samples = _VALUES[metric]
    return f"""WITH {MATCH_RECORDS_SQL}, keyed AS (SELECT *, {_KEYS[dimension]} AS key FROM records WHERE {where})
    SELECT key, count(*) AS matches, {samples} AS samples, round({value}, 6) AS value FROM keyed
    WHERE key IS NOT NULL GROUP BY key HAVING {samples} >= {least}"""


def _cube(name: str, metric: str, dimension: str, least: int = 1, filters: dict | None = None, where: str = "true", sort: str = "auto") -> None:
    spec = QuerySpec(metric=metric, dimension=dimension, minimum_samples=least, sort=sort, filters=filters or {})

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = run_query(match_records(spark, sf_dir), spec, now=NOW)
        return _rounded(out.select("key", "matches", "samples", "value"), "value")

    _QUERIES[name] = run
    _SQL[name] = _cube_sql(metric, dimension, where, least)


for _metric in _VALUES:
    _cube(f"metric_{_metric}_overall", _metric, "none")
_cube("cube_loss_rate_by_stage", "lossRate", "stage")
_cube("cube_by_opponent", "lossRate", "opponentWeapon")
_cube("cube_day", "winRate", "day")
_cube("cube_rule", "averageKills", "rule", sort="asc")
_cube("cube_self_weapon", "kdRatio", "selfWeapon", sort="matches")
_cube("cube_outcome", "matchCount", "outcome")
_cube("cube_death_bucket", "lossRate", "deathBucket", sort="natural")
_cube("cube_disadvantage_bucket", "lossRate", "disadvantageBucket", sort="natural")
_cube("cube_minimum_samples", "averageDuration", "day", least=5)
_cube("filter_period", "winRate", "stage", filters={"period_days": 400}, where="recorded_at >= TIMESTAMP '1996-06-01' - INTERVAL 400 DAY")
_cube("filter_dates", "winRate", "rule", filters={"date_from": "1994-01-01", "date_to": "1995-12-31"}, where="strftime(recorded_at, '%Y-%m-%d') BETWEEN '1994-01-01' AND '1995-12-31'")
_cube("filter_member", "averageDeaths", "stage", filters={"opponent_weapon": "Brand#11"}, where="list_contains(enemy_weapons, 'Brand#11')")
_cube("filter_ranges", "matchCount", "stage", filters={"deaths_min": 1, "deaths_max": 2, "disadvantage_max": 60}, where="deaths BETWEEN 1 AND 2 AND disadvantage_seconds <= 60")
_cube("filter_text", "matchCount", "stage", filters={"query": " building "}, where="contains(lower(concat_ws(' ', recording_file_name, stage, rule, outcome, self_weapon, array_to_string(enemy_weapons, ' '))), 'building')")


@registered(f"""WITH {MATCH_RECORDS_SQL} SELECT rule, count(*) AS matches, round(avg(kills), 6) AS averageKills FROM records
WHERE outcome = 'win' AND stage = 'NATION_3' GROUP BY rule""")
def filter_global_card(spark, sf_dir):
    """Dashboard filters, then the card's own."""
    both = filter_records(filter_records(match_records(spark, sf_dir), {"outcome": "win"}), {"stage": "NATION_3"})
    return _rounded(both.groupBy("rule").agg(F.count("*").alias("matches"), F.avg("kills").alias("averageKills")), "averageKills")


@registered(f"""WITH {MATCH_RECORDS_SQL}
SELECT stage, rule, grouping(stage, rule)::BIGINT AS grouping, count(*) AS matches, count(outcome) AS decided,
round(count(*) FILTER (outcome = 'win') / nullif(count(outcome), 0)::DOUBLE, 6) AS winRate FROM records
WHERE stage IS NOT NULL AND rule IS NOT NULL GROUP BY CUBE (stage, rule)""")
def cube_grouping_sets(spark, sf_dir):
    out = cube_query(match_records(spark, sf_dir), ["stage", "rule"])
    return _rounded(out.select("stage", "rule", "grouping", "matches", "decided", "winRate"), "winRate")


@registered(f"""WITH {MATCH_RECORDS_SQL}
SELECT stage, grouping(stage)::INTEGER AS is_total, count(*) AS records, count(*) FILTER (stage IS NOT NULL AND rule IS NOT NULL AND outcome IS NOT NULL) AS complete,
round(avg((stage IS NOT NULL AND rule IS NOT NULL AND outcome IS NOT NULL)::INT), 6) AS coverage FROM records GROUP BY ROLLUP (stage)""")
def rollup_coverage(spark, sf_dir):
    return _rounded(rollup_audit(match_records(spark, sf_dir), "stage"), "coverage")


# Search and store ----------------------------------------------------------------------------------------------------


@registered(f"""WITH {MATCH_RECORDS_SQL} SELECT id, stage, outcome FROM records
WHERE stage IN ('NATION_1', 'NATION_2') AND outcome = 'win' AND list_has_any(enemy_weapons, ['Brand#12', 'Brand#13'])""")
def search_facets(spark, sf_dir):
    chosen = {"stages": {"NATION_1", "NATION_2"}, "outcomes": {"win"}, "opponent_weapons": {"Brand#12", "Brand#13"}}
    return search.filter_matches(match_records(spark, sf_dir), chosen).select("id", "stage", "outcome")


@registered(f"""WITH {MATCH_RECORDS_SQL} SELECT id, rule FROM records WHERE list_has_all(enemy_weapons, ['Brand#12', 'Brand#5'])""")
def search_composition(spark, sf_dir):
    return search.filter_matches(match_records(spark, sf_dir), {"enemy_compositions": {"Brand#12", "Brand#5"}}).select("id", "rule")


@registered(f"""WITH {MATCH_RECORDS_SQL}, every AS (
  SELECT 'stages' AS facet, stage AS value FROM records UNION ALL SELECT 'rules', rule FROM records UNION ALL SELECT 'self_weapons', self_weapon FROM records
  UNION ALL SELECT 'opponent_weapons', unnest(enemy_weapons) FROM records UNION ALL SELECT 'opponent_weapons', p_brand FROM part)
SELECT DISTINCT facet, value FROM every WHERE value <> ''""")
def dimension_values(spark, sf_dir):
    catalog = table(spark, sf_dir, "part").select(F.lit("opponent_weapons").alias("facet"), F.col("p_brand").alias("value"))
    return search.dimension_values(match_records(spark, sf_dir), catalog)


@registered(f"""WITH {MATCH_RECORDS_SQL} SELECT id, CASE WHEN id % 7 = 0 THEN 'edited' ELSE stage END AS stage, rule,
CASE WHEN id % 21 = 0 THEN 'win' ELSE outcome END AS outcome,
concat_ws(',', CASE WHEN id % 7 = 0 THEN 'stage' END, CASE WHEN id % 21 = 0 THEN 'outcome' END) AS manual,
CASE WHEN (id % 7 = 0 OR stage IS NOT NULL) AND rule IS NOT NULL AND (id % 21 = 0 OR outcome IS NOT NULL) THEN 'ready' ELSE 'partial' END AS analytics_status FROM records""")
def overlay_effective(spark, sf_dir):
    """Overrides written over automatic records: a log of edits, of which later ones win and blank ones delete."""
    ids = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    edit = lambda field, value, seq: ids.select("id", F.lit(field).alias("field"), F.lit(value).alias("value"), F.lit(seq).alias("seq"))
    log = edit("stage", "first", 1).where("id % 7 = 0").union(edit("stage", "edited", 2).where("id % 7 = 0")).union(edit("outcome", "win", 1).where("id % 21 = 0")).union(edit("rule", "x", 1).where("id % 5 = 0")).union(edit("rule", " ", 2).where("id % 5 = 0"))
    out = records.effective(match_records(spark, sf_dir), records.write_overrides(log))
    return out.select("id", "stage", "rule", "outcome", F.array_join("manual_fields", ",").alias("manual"), "analytics_status")


@registered("""WITH labelled AS (SELECT o_orderkey AS id, o_orderpriority AS rule, n_name AS stage, o_totalprice / 300000 AS confidence, o_orderdate AS seen FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
allowed AS (SELECT n_name AS stage FROM nation WHERE n_regionkey < 2), picked AS (
  SELECT rule, stage, id, confidence, row_number() OVER (PARTITION BY rule ORDER BY seen, id) AS nth FROM labelled WHERE stage IN (SELECT stage FROM allowed))
SELECT rule, stage, id, round(least(1, greatest(0, confidence)), 3) AS confidence FROM picked WHERE nth = 1""")
def validate_labels(spark, sf_dir):
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    rows = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    rows = rows.select(F.col("o_orderpriority").alias("rule"), F.col("n_name").alias("stage"), F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 300000).alias("confidence"), F.lit("").alias("evidence"), F.col("o_orderdate").alias("at"))
    allowed = n.where("n_regionkey < 2").select(F.col("n_name").alias("stage"))
    return records.checked_labels(rows, "rule", allowed, ["stage"], ["at", "id"]).select("rule", "stage", "id", "confidence")


@registered("""SELECT o.o_orderkey AS id, CASE WHEN o.o_orderkey % 3 = 0 THEN 'improvement' WHEN o.o_orderkey % 5 = 0 THEN 'failure' ELSE 'pass' END AS verdict FROM orders o""")
def regression_verdicts(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("truth"))
    before = o.withColumn("guess", F.when(F.col("id") % 3 == 0, "?").otherwise(F.col("truth")))
    after = o.withColumn("guess", F.when((F.col("id") % 3 != 0) & (F.col("id") % 5 == 0), "?").otherwise(F.col("truth")))
    return records.regression(before, after, "id", "truth", "guess").select("id", "verdict")


# Timelines -----------------------------------------------------------------------------------------------------------

_W = "WINDOW w AS (PARTITION BY key ORDER BY t, id)"
_SESSIONS = f"""{TIMELINE_SQL}, marked AS (SELECT *, CASE WHEN lag(t) OVER w IS NULL OR t - lag(t) OVER w > {SESSION_GAP} THEN 1 ELSE 0 END AS starts FROM timeline {_W}),
sessions AS (SELECT *, sum(starts) OVER (PARTITION BY key ORDER BY t, id) AS session FROM marked)"""
_ISLANDS = f"""{TIMELINE_SQL}, marked AS (SELECT *, CASE WHEN flag AND NOT coalesce(lag(flag) OVER w, false) THEN 1 ELSE 0 END AS starts FROM timeline {_W}),
numbered AS (SELECT *, sum(starts) OVER (PARTITION BY key ORDER BY t, id) AS island FROM marked),
runs AS (SELECT key, island, min(t) AS start, max(t) AS "end", count(*) AS rows FROM numbered WHERE flag GROUP BY key, island)"""


@registered(f"WITH {_SESSIONS} SELECT key, session, count(*) AS rows, round(min(t), 3) AS start, round(max(t), 3) AS \"end\", round(max(value), 6) AS peak_score FROM sessions GROUP BY key, session")
def gap_sessions(spark, sf_dir):
    out = windows.session_summary(timeline(spark, sf_dir), KEY, ORDER, SESSION_GAP, F.col("value"))
    return out.select("key", "session", "rows", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), F.round("peak_score", 6).alias("peak_score"))


@registered(f"""WITH {_SESSIONS}, peaks AS (SELECT *, row_number() OVER (PARTITION BY key, session ORDER BY value DESC, t, id) AS nth FROM sessions)
SELECT key, session, round(t, 3) AS peak FROM peaks WHERE nth = 1""")
def session_peak(spark, sf_dir):
    out = windows.session_summary(timeline(spark, sf_dir), KEY, ORDER, SESSION_GAP, F.col("value"))
    return out.select("key", "session", F.round("peak", 3).alias("peak"))


@registered(f"""WITH {TIMELINE_SQL}, timed AS (SELECT *, CASE WHEN lead(t) OVER w IS NULL THEN 1 ELSE least(greatest(lead(t) OVER w - t, 0), {HOLD}) END AS dt FROM timeline {_W})
SELECT key, round(coalesce(sum(dt) FILTER (difference > 0), 0), 1) AS advantage_seconds, round(coalesce(sum(dt) FILTER (difference < 0), 0), 1) AS disadvantage_seconds,
round(coalesce(sum(dt) FILTER (difference = 0), 0), 1) AS even_seconds, greatest(max(difference), 0) AS most_advantage, greatest(max(-difference), 0) AS most_disadvantage FROM timed GROUP BY key""")
def sign_durations(spark, sf_dir):
    return windows.sign_durations(timeline(spark, sf_dir), KEY, ORDER, F.col("difference"), HOLD, 1.0)


@registered(f"""WITH {TIMELINE_SQL} SELECT key, id, round(avg(flag::INT) OVER (PARTITION BY key ORDER BY t, id ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING), 6) AS density,
avg(flag::INT) OVER (PARTITION BY key ORDER BY t, id ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) >= 0.35 AS dense FROM timeline""")
def rolling_density(spark, sf_dir):
    out = windows.rolling_density(timeline(spark, sf_dir), KEY, ORDER, F.col("flag"), 4, 0.35)
    return _rounded(out.select("key", "id", "density", "dense"), "density")


@registered(f"WITH {_ISLANDS} SELECT key, round(start, 3) AS start, round(\"end\" + 60, 3) AS \"end\", rows FROM runs WHERE \"end\" + 60 - start >= 3600")
def islands_min_length(spark, sf_dir):
    out = windows.island_summary(timeline(spark, sf_dir), KEY, ORDER, F.col("flag"), 3600.0, 60.0)
    return out.select("key", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), "rows")


@registered(f"WITH {_ISLANDS} SELECT t.key, coalesce(max(r.rows), 0) AS streak FROM (SELECT DISTINCT key FROM timeline) t LEFT JOIN runs r ON t.key = r.key GROUP BY t.key")
def longest_streak(spark, sf_dir):
    return windows.longest_streak(timeline(spark, sf_dir), KEY, ORDER, F.col("flag"))


@registered(f"""WITH {_ISLANDS}, ends AS (SELECT key, max(t) AS last FROM timeline GROUP BY key)
SELECT e.key, round(coalesce(min(r.start), e.last), 3) AS first FROM ends e LEFT JOIN runs r ON e.key = r.key AND r.rows >= 4 GROUP BY e.key, e.last""")
def first_n_consecutive(spark, sf_dir):
    out = windows.first_of_run(timeline(spark, sf_dir), KEY, ORDER, F.col("flag"), 4, F.max("t"))
    return out.select("key", F.round("first", 3).alias("first"))


@registered(f"WITH {TIMELINE_SQL}, g AS (SELECT *, t - lag(t) OVER w AS gap FROM timeline {_W}) SELECT key, id FROM g WHERE gap IS NULL OR gap >= 3600")
def min_spacing(spark, sf_dir):
    return windows.min_spacing(timeline(spark, sf_dir), KEY, ORDER, 3600.0).select("key", "id")


@registered(f"WITH {_SESSIONS} SELECT key, round(max(t), 3) AS t, count(*) AS n FROM sessions GROUP BY key, session")
def collapse_close(spark, sf_dir):
    return windows.collapse_close(timeline(spark, sf_dir), KEY, ORDER, SESSION_GAP).select("key", F.round("t", 3).alias("t"), "n")


@registered(f"WITH {TIMELINE_SQL} SELECT key, id, coalesce(sum(flag::INT) OVER (PARTITION BY key ORDER BY t, id ROWS BETWEEN 2 FOLLOWING AND 9 FOLLOWING), 0)::BIGINT AS ahead FROM timeline")
def forward_count(spark, sf_dir):
    return windows.forward_count(timeline(spark, sf_dir), KEY, ORDER, F.col("flag"), 2, 10).select("key", "id", "ahead")


@registered(f"""WITH {TIMELINE_SQL}, n AS (SELECT *, lead(t) OVER w AS t2, lead(value) OVER w AS v2 FROM timeline {_W})
SELECT key, round(min(t), 3) AS first FROM n WHERE value >= 20 AND v2 >= 20 AND t2 - t <= 3600 GROUP BY key""")
def pair_test(spark, sf_dir):
    out = windows.pair_test(timeline(spark, sf_dir), KEY, ORDER, F.col("value"), 20.0, 3600.0)
    return out.select("key", F.round("first", 3).alias("first"))


@registered(f"""WITH {_SESSIONS}, s AS (SELECT key, session, min(t) AS start, count(*) AS n FROM sessions GROUP BY key, session)
SELECT key, round(max(start) + 0.5, 3) AS boundary FROM s WHERE n >= 2 GROUP BY key""")
def last_stable_run(spark, sf_dir):
    return windows.last_stable_run(timeline(spark, sf_dir), KEY, ORDER, SESSION_GAP, 2, 0.5)


@registered(f"""WITH {TIMELINE_SQL}, c AS (SELECT key, floor(t / 86400)::BIGINT AS bucket, kind, count(*) AS n, max(t) AS seen FROM timeline GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY key, bucket ORDER BY n DESC, seen DESC, kind DESC) AS nth, sum(n) OVER (PARTITION BY key, bucket) AS rows FROM c)
SELECT key, bucket, kind AS mode, n AS votes, rows::BIGINT AS rows, round(n / rows, 6) AS share FROM r WHERE nth = 1 AND rows >= 2 AND n / rows >= 0.5""")
def bucket_mode(spark, sf_dir):
    return _rounded(windows.bucket_mode(timeline(spark, sf_dir), KEY, "t", "kind", 86400.0), "share")


@registered(f"WITH {TIMELINE_SQL}, l AS (SELECT key, list_sort(list(value)) AS v FROM timeline GROUP BY key) SELECT key, v[len(v) // 2 + 1] AS median FROM l")
def upper_median(spark, sf_dir):
    return choices.upper_medians(timeline(spark, sf_dir), KEY, F.col("value"), "median")


@registered(f"""WITH {TIMELINE_SQL}, p AS (SELECT key, t, id, value, lead(t) OVER w AS t2 FROM (SELECT key, floor(t / 600) * 600 AS t, min(id) AS id, max(value) AS value FROM timeline GROUP BY ALL) {_W}),
g AS (SELECT *, unnest(generate_series(0, greatest(floor((least(t + 3600, coalesce(t2 - 600, t + 3600)) - t) / 600), 0)::BIGINT)) AS k FROM p)
SELECT key, t + k * 600 AS t, value, CASE WHEN k = 0 THEN 'observed' ELSE 'held' END AS source, round(CASE WHEN k = 0 THEN 1.0 ELSE greatest(0.2, 1.0 - k * 600 / 7200.0) END, 6) AS confidence FROM g""")
def hold_forward(spark, sf_dir):
    points = timeline(spark, sf_dir).groupBy("key", (F.floor(F.col("t") / 600) * 600).cast("double").alias("t")).agg(F.max("value").alias("value")).withColumn("confidence", F.lit(1.0))
    return _rounded(windows.hold_forward(points, KEY, "t", ["value"], "confidence", 600.0, 3600.0, 7200.0, 0.2), "confidence")


_GAPPY = f"{TIMELINE_SQL}, gappy AS (SELECT key, t, id, CASE WHEN kind = 'purchase' THEN value END AS value FROM timeline)"


def _gappy(spark, sf_dir):
    return timeline(spark, sf_dir).select("key", "t", "id", F.when(F.col("kind") == "purchase", F.col("value")).alias("value"))


@registered(f"WITH {_GAPPY} SELECT key, id, last_value(value IGNORE NULLS) OVER (PARTITION BY key ORDER BY t, id) AS value FROM gappy")
def locf(spark, sf_dir):
    return windows.locf(_gappy(spark, sf_dir), KEY, ORDER, "value").select("key", "id", "value")


@registered(f"""WITH {_GAPPY}, n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY t, id) AS pos FROM gappy),
s AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN pos END IGNORE NULLS) OVER (PARTITION BY key ORDER BY t, id) AS b,
  first_value(CASE WHEN value IS NOT NULL THEN pos END IGNORE NULLS) OVER (PARTITION BY key ORDER BY t, id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a FROM n)
SELECT s.key, s.id, v.value FROM s LEFT JOIN n v ON s.key = v.key AND v.pos = CASE WHEN s.b IS NULL OR s.a - s.pos < s.pos - s.b THEN s.a ELSE s.b END""")
def nearest_fill(spark, sf_dir):
    return windows.nearest_fill(_gappy(spark, sf_dir), KEY, ORDER, "value").select("key", "id", "value")


@registered(f"""WITH {TIMELINE_SQL}, b AS (SELECT *, last_value(CASE WHEN flag THEN t END IGNORE NULLS) OVER (PARTITION BY key ORDER BY t, id) AS b,
first_value(CASE WHEN flag THEN t END IGNORE NULLS) OVER (PARTITION BY key ORDER BY t, id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a FROM timeline)
SELECT key, id, flag OR coalesce(kind = 'view' AND t - b <= 20000 AND a - t <= 20000, false) AS visible FROM b""")
def visibility_bracket(spark, sf_dir):
    out = windows.visibility_bracket(timeline(spark, sf_dir), KEY, ORDER, F.col("flag"), F.col("kind") == "view", 20000.0)
    return out.select("key", "id", "visible")


@registered(f"""WITH {TIMELINE_SQL}, s AS (SELECT key, id, t AS active_start, t + value * 600 AS active_end, t - 9000 AS start, t + value * 600 + 9000 AS "end" FROM timeline)
SELECT key, id, round(CASE WHEN lag("end") OVER w > start THEN (lag(active_end) OVER w + active_start) / 2 ELSE start END, 3) AS start,
round(CASE WHEN "end" > lead(start) OVER w THEN (active_end + lead(active_start) OVER w) / 2 ELSE "end" END, 3) AS "end" FROM s WINDOW w AS (PARTITION BY key ORDER BY active_start, id)""")
def settle_overlaps(spark, sf_dir):
    t = F.col("t")
    spans = timeline(spark, sf_dir).select("key", "id", t.alias("active_start"), (t + F.col("value") * 600).alias("active_end"), (t - 9000).alias("start"), (t + F.col("value") * 600 + 9000).alias("end"))
    out = windows.settle_overlaps(spans, KEY, ["active_start", "id"])
    return out.select("key", "id", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"))


@registered(f"WITH {TIMELINE_SQL} SELECT key, id, round(coalesce(sum(value) OVER (PARTITION BY key ORDER BY t, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 4) AS \"offset\" FROM timeline")
def prefix_offsets(spark, sf_dir):
    return windows.offsets(timeline(spark, sf_dir), KEY, ORDER, "value").select("key", "id", F.round("offset", 4).alias("offset"))


_RUNS = f"""{TIMELINE_SQL}, m AS (SELECT *, CASE WHEN lag(kind) OVER w IS DISTINCT FROM kind THEN 1 ELSE 0 END AS starts FROM timeline {_W}),
n AS (SELECT *, sum(starts) OVER (PARTITION BY key ORDER BY t, id) AS run FROM m), runs AS (SELECT key, run, min(kind) AS kind, min(t) AS start, max(t) AS "end", count(*) AS rows FROM n GROUP BY key, run)"""


@registered(f"WITH {_RUNS} SELECT key, run, kind, rows, round(start, 3) AS start FROM runs")
def run_lengths(spark, sf_dir):
    return windows.run_lengths(timeline(spark, sf_dir), KEY, ORDER, "kind").select("key", "run", "kind", "rows", F.round("start", 3).alias("start"))


@registered(f"""WITH {_RUNS}, s AS (SELECT *, lag(kind) OVER w AS b, lead(kind) OVER w AS a, lead(start) OVER w AS s2 FROM runs WINDOW w AS (PARTITION BY key ORDER BY run))
SELECT key, run, kind FROM s WHERE a = b AND s2 - start <= 20000""")
def short_returns(spark, sf_dir):
    return windows.short_returns(timeline(spark, sf_dir), KEY, ORDER, "kind", 20000.0).select("key", "run", "kind")


@registered(f"""WITH {TIMELINE_SQL}, s AS (SELECT key, t, id, difference - lag(difference) OVER w AS step, difference FROM timeline {_W}),
c AS (SELECT key, count(difference) OVER (PARTITION BY key ORDER BY t, id ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS valid,
 coalesce(sum((step > 0)::INT) OVER (PARTITION BY key ORDER BY t, id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 0) AS rises,
 coalesce(sum((step = -1)::INT) OVER (PARTITION BY key ORDER BY t, id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 0) AS drops FROM s)
SELECT key, coalesce(max(drops) FILTER (valid >= 4 AND rises = 0), 0)::BIGINT AS ticks FROM c GROUP BY key""")
def tick_run_max(spark, sf_dir):
    return windows.tick_runs(timeline(spark, sf_dir), KEY, ORDER, "difference", 6, 4)


@registered(f"""WITH {TIMELINE_SQL}, n AS (SELECT *, lead(t) OVER w AS t2, lead(value) OVER w AS v2 FROM timeline {_W}),
g AS (SELECT *, unnest(generate_series(1, (ceil((t2 - t) / 3600) - 1)::BIGINT)) AS k FROM n WHERE t2 - t > 3600 AND t2 - t <= 36000)
SELECT key, round(t, 3) AS t, round(value, 4) AS value, 'observed' AS source FROM timeline UNION ALL
SELECT key, round(t + k * 3600, 3), round(value + (v2 - value) * (k * 3600 / (t2 - t)), 4), 'inferred' FROM g""")
def linear_interpolate(spark, sf_dir):
    out = windows.linear_interpolation(timeline(spark, sf_dir), KEY, ORDER, ["value"], 3600.0, 36000.0)
    return out.select("key", F.round("t", 3).alias("t"), F.round("value", 4).alias("value"), "source")


@registered(f"""WITH {TIMELINE_SQL}, n AS (SELECT *, lag(t) OVER w AS t0, lag(value) OVER w AS v0 FROM timeline {_W}), s AS (SELECT *, (value - v0) / (t - t0) AS speed FROM n WHERE t > t0 AND t - t0 <= 20000),
g AS (SELECT *, unnest(generate_series(0, 6)) AS k FROM s WHERE abs(speed) BETWEEN 0.0001 AND 18)
SELECT key, id, k::INT AS k, round(least(greatest(value + speed * k, 0), 1000), 4) AS predicted, round(exp(-k / 4.0), 6) AS confidence FROM g""")
def extrapolate(spark, sf_dir):
    out = windows.extrapolate(timeline(spark, sf_dir), KEY, ORDER, "value", 6, 20000.0, 0.0001, 18.0, 0.0, 1000.0)
    return out.select("key", "id", "k", F.round("predicted", 4).alias("predicted"), F.round("confidence", 6).alias("confidence"))


# Joins ---------------------------------------------------------------------------------------------------------------


@registered(f"""WITH {TIMELINE_SQL}, l AS (SELECT * FROM timeline WHERE kind = 'error'), r AS (SELECT * FROM timeline WHERE kind <> 'error'),
c AS (SELECT l.key, l.id, r.value, r.t AS rt, l.t, row_number() OVER (PARTITION BY l.key, l.id ORDER BY r.t DESC, r.id DESC) AS nth FROM l LEFT JOIN r ON l.key = r.key AND r.t <= l.t - 60)
SELECT key, id, CASE WHEN t - 60 - rt <= 86400 THEN value END AS right_value FROM c WHERE nth = 1""")
def last_state_asof(spark, sf_dir):
    rows = timeline(spark, sf_dir)
    out = joins.asof(rows.where("kind = 'error'"), rows.where("kind <> 'error'"), KEY, "t", ["value"], shift=-60.0, longest=86400.0, tie=["id"])
    return out.select("key", "id", "right_value")


@registered(f"""WITH {TIMELINE_SQL}, l AS (SELECT * FROM timeline WHERE kind = 'error'), r AS (SELECT * FROM timeline WHERE kind = 'purchase'),
c AS (SELECT l.key, l.id, r.id AS rid, r.t AS rt, l.t, row_number() OVER (PARTITION BY l.key, l.id ORDER BY r.t, r.id) AS nth FROM l LEFT JOIN r ON l.key = r.key AND r.t >= l.t)
SELECT key, id, CASE WHEN rt - t <= 86400 THEN rid END AS right_id FROM c WHERE nth = 1""")
def first_state_asof_forward(spark, sf_dir):
    rows = timeline(spark, sf_dir)
    out = joins.asof(rows.where("kind = 'error'"), rows.where("kind = 'purchase'"), KEY, "t", ["id"], longest=86400.0, forward=True, tie=["id"])
    return out.select("key", "id", "right_id")


_PAIR = f"{TIMELINE_SQL}, l AS (SELECT * FROM timeline WHERE kind = 'error'), r AS (SELECT * FROM timeline WHERE kind = 'purchase')"


@registered(f"WITH {_PAIR} SELECT l.key, l.id, r.id AS right_id FROM l JOIN r ON l.key = r.key AND r.t BETWEEN l.t - 14400 AND l.t + 900")
def range_join_tolerance(spark, sf_dir):
    rows = timeline(spark, sf_dir)
    out = joins.range_join(rows.where("kind = 'error'"), rows.where("kind = 'purchase'"), KEY, "t", "t", 14400.0, 900.0)
    return out.select("key", "id", "right_id")


@registered(f"WITH {_PAIR} SELECT l.key, l.id FROM l WHERE NOT EXISTS (SELECT 1 FROM r WHERE l.key = r.key AND abs(r.t - l.t) <= 7200)")
def suppress_near(spark, sf_dir):
    rows = timeline(spark, sf_dir)
    return joins.suppress_near(rows.where("kind = 'error'"), rows.where("kind = 'purchase'"), KEY, "t", 7200.0).select("key", "id")


@registered(f"""WITH {_PAIR}, c AS (SELECT l.key, l.id, r.value, row_number() OVER (PARTITION BY l.key, l.id ORDER BY abs(r.t - l.t), r.t, r.value) AS nth FROM l LEFT JOIN r ON l.key = r.key AND abs(r.t - l.t) <= 20000)
SELECT key, id, value AS nearest_value FROM c WHERE nth = 1""")
def nearest_in_time(spark, sf_dir):
    rows = timeline(spark, sf_dir)
    out = joins.nearest(rows.where("kind = 'error'"), rows.where("kind = 'purchase'"), KEY, "t", 20000.0, ["key", "id"], "value")
    return out.select("key", "id", "nearest_value")


@registered(f"""WITH {_PAIR}, a AS (SELECT key, id, t AS start, t + value * 300 AS "end" FROM l WHERE value > 0), b AS (SELECT key, id, t AS start, t + value * 300 AS "end" FROM r WHERE value > 0)
SELECT a.key, a.id, b.id AS right_id, round(least(a."end", b."end") - greatest(a.start, b.start), 3) AS shared FROM a JOIN b ON a.key = b.key AND a."end" > b.start AND a.start < b."end" """)
def interval_overlap(spark, sf_dir):
    rows = timeline(spark, sf_dir).where("value > 0").select("key", "id", "kind", F.col("t").alias("start"), (F.col("t") + F.col("value") * 300).alias("end"))
    out = joins.interval_overlap(rows.where("kind = 'error'"), rows.where("kind = 'purchase'"), KEY, 21600.0)
    return out.select("key", "id", "right_id", F.round("shared", 3).alias("shared"))


@registered("""WITH p AS (SELECT s_nationkey AS key, s_suppkey AS id, s_acctbal AS x, s_suppkey * 10.0 AS y FROM supplier), f AS (SELECT c_nationkey AS key, c_acctbal AS x, c_custkey * 1.0 AS y FROM customer)
SELECT key, id FROM p WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.key = p.key AND sqrt((f.x - p.x) ** 2 + (f.y - p.y) ** 2) <= 220)""")
def spatial_anti(spark, sf_dir):
    p = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("key"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("x"), (F.col("s_suppkey") * 10.0).alias("y"))
    f = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("key"), F.col("c_acctbal").alias("x"), (F.col("c_custkey") * 1.0).alias("y"))
    return joins.spatial_anti(p, f, KEY, 220.0).select("key", "id")


@registered(f"""WITH {_PAIR}, a AS (SELECT key, row_number() OVER (PARTITION BY key ORDER BY t, id) AS nth, value FROM l), b AS (SELECT key, row_number() OVER (PARTITION BY key ORDER BY t, id) AS nth, value FROM r)
SELECT key, nth, a.value AS left_value, b.value AS right_value, round(b.value - a.value, 4) AS diff_value, a.value IS NOT DISTINCT FROM b.value AS exact FROM a FULL JOIN b USING (key, nth)""")
def positional_diff(spark, sf_dir):
    rows = timeline(spark, sf_dir)
    out = joins.positional_diff(rows.where("kind = 'error'"), rows.where("kind = 'purchase'"), KEY, ORDER, ["value"])
    return out.withColumn("diff_value", F.round("diff_value", 4))


# Votes and choices ---------------------------------------------------------------------------------------------------


@registered(f"""WITH {TIMELINE_SQL}, v AS (SELECT key, kind, count(*) AS n, avg(value / 100) AS mean FROM timeline GROUP BY ALL),
r AS (SELECT *, row_number() OVER w AS nth, lead(n) OVER w AS next FROM v WINDOW w AS (PARTITION BY key ORDER BY n DESC, kind DESC))
SELECT key, kind, n AS votes, coalesce(next, 0) AS runner_up, round(least(0.99, mean + least(0.08, 0.015 * (n - 2))), 6) AS confidence FROM r WHERE nth = 1 AND n >= 2 AND n >= coalesce(next, 0) + 2""")
def vote_margin(spark, sf_dir):
    rows = timeline(spark, sf_dir).withColumn("sure", F.col("value") / 100)
    return _rounded(choices.vote_margin(rows, KEY, "kind", "sure"), "confidence")


@registered(f"""WITH {TIMELINE_SQL}, v AS (SELECT key, kind, count(*) AS n FROM timeline GROUP BY ALL), r AS (SELECT *, row_number() OVER w AS nth, lead(n) OVER w AS next FROM v WINDOW w AS (PARTITION BY key ORDER BY n DESC))
SELECT key, kind, n AS votes FROM r WHERE nth = 1 AND n >= 2 AND n > coalesce(next, 0)""")
def consensus(spark, sf_dir):
    return choices.consensus(timeline(spark, sf_dir), KEY, "kind")


@registered("""WITH l AS (SELECT l_suppkey AS key, l_returnflag AS a, l_linestatus AS b, count(*) AS n, min(l_orderkey) AS first FROM lineitem GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, -first DESC, a DESC, b DESC) AS nth FROM l) SELECT key, a, b, n AS votes FROM r WHERE nth = 1""")
def mode_pair(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("key"), F.col("l_returnflag").alias("a"), F.col("l_linestatus").alias("b"), (-F.col("l_orderkey")).alias("sure"), F.col("l_orderkey").alias("at"))
    return choices.mode_of(rows, KEY, ["a", "b"], "sure", ["at"]).select("key", "a", "b", "votes")


@registered(f"""WITH {TIMELINE_SQL} SELECT key, coalesce(arg_max(value, (t, id)) FILTER (kind = 'purchase'), arg_max(value, (t, id))) AS final, count(*) FILTER (kind = 'purchase') AS observed, max(value) AS most FROM timeline GROUP BY key""")
def final_value(spark, sf_dir):
    return choices.final_value(timeline(spark, sf_dir), KEY, ORDER, "value", F.col("kind") == "purchase")


@registered(f"""WITH {TIMELINE_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY flag DESC, value DESC, t, id) AS rank FROM timeline) SELECT key, id, rank::INT AS rank FROM r WHERE rank <= 3""")
def topk_per_key(spark, sf_dir):
    order = [F.desc("flag"), F.desc("value"), F.asc("t"), F.asc("id")]
    return choices.top_per_key(timeline(spark, sf_dir), KEY, order, 3).select("key", "id", "rank")


@registered(f"WITH {TIMELINE_SQL} SELECT key, id, 'death-' || row_number() OVER (PARTITION BY key ORDER BY t, id) AS name FROM timeline WHERE kind = 'error'")
def renumber(spark, sf_dir):
    return choices.renumber(timeline(spark, sf_dir).where("kind = 'error'"), KEY, ORDER, "death", "name").select("key", "id", "name")


@registered(f"""WITH {TIMELINE_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY abs(value - 30), t, id) AS nth FROM timeline) SELECT key, id, value FROM r WHERE nth = 1""")
def argmin_choice(spark, sf_dir):
    return choices.arg_min(timeline(spark, sf_dir), KEY, [F.abs(F.col("value") - 30), F.col("t"), F.col("id")]).select("key", "id", "value")


@registered("""SELECT o_orderpriority AS rule, count(*) AS labelled, count(*) AS guessed, count(*) FILTER (o_orderkey % 4 <> 0) AS "right", 1.0::DOUBLE AS coverage,
round(count(*) FILTER (o_orderkey % 4 <> 0) / count(*), 6) AS "precision", round(avg(CASE WHEN o_orderkey % 4 = 0 THEN 5 ELSE 0 END), 6) AS mean_error, count(*) FILTER (o_orderkey % 4 <> 0) AS "within" FROM orders GROUP BY 1""")
def evaluation_metrics(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "rule")
    guess = F.col("o_custkey") + F.when(F.col("o_orderkey") % 4 == 0, 5).otherwise(0)
    return _rounded(choices.evaluation(o, ["rule"], F.col("o_custkey"), guess, 3.0), "coverage", "precision", "mean_error")


@registered("""WITH x AS (SELECT label, unnest(range(len(embedding))) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings), p AS (SELECT label, pos, avg(x) AS m FROM x GROUP BY ALL),
e AS (SELECT vec_id, unnest(range(len(embedding))) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings),
d AS (SELECT e.vec_id, p.label, round(sqrt(sum((e.x - p.m) ** 2)), 4) AS distance FROM e JOIN p ON e.pos = p.pos GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance) AS nth FROM d)
SELECT vec_id, distance FROM r WHERE nth <= 3""")
def knn_templates(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    out = templates.nearest_templates(vectors, templates.prototypes(vectors, "label", "embedding"), "embedding", "label", 3)
    return out.select("vec_id", F.explode("nearest").alias("n")).select("vec_id", F.round("n.distance", 4).alias("distance"))


# Set operations ------------------------------------------------------------------------------------------------------


@registered("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 0")
def set_intersect(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(spark, sf_dir, "supplier").where("s_acctbal > 0").select("s_nationkey"))


@registered("SELECT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'A' EXCEPT ALL SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R'")
def set_except_all(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    pick = lambda f: lines.where(F.col("l_returnflag") == f).select(F.col("l_orderkey").alias("k"))
    return pick("A").exceptAll(pick("R"))


@registered("""WITH a AS (SELECT o_orderkey AS id, 'vision' AS source, 1 AS place FROM orders WHERE o_totalprice >= 270000 UNION ALL SELECT o_orderkey, 'intro', 2 FROM orders WHERE o_orderkey % 2 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY place) AS nth FROM a) SELECT id, source FROM r WHERE nth = 1""")
def union_with_precedence(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    first = o.where("o_totalprice >= 270000").select(F.col("o_orderkey").alias("id"), F.lit("vision").alias("source"), F.lit(1).alias("place"))
    second = o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("id"), F.lit("intro").alias("source"), F.lit(2).alias("place"))
    return choices.arg_min(first.union(second), ["id"], [F.col("place")]).select("id", "source")


@registered("SELECT c_custkey AS id FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def pending_anti(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select(F.col("c_custkey").alias("id"))


for _f in fold_queries.QUERIES:
    _QUERIES[_f.__name__] = _f
_SQL["stream_gap_sessions"] = f"WITH {_SESSIONS} SELECT key, count(*) AS rows, round(min(t), 3) AS start, round(max(t), 3) AS \"end\" FROM sessions GROUP BY key, session"


_QUERIES.update(record_queries.QUERIES)
_SQL.update(record_queries.SQL)
_QUERIES.update(live_queries.QUERIES)
_SQL.update(live_queries.SQL)


def queries() -> dict[str, Query]:
    """Name -> function of (spark, sf_dir)."""
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    """Name -> the same result in DuckDB SQL."""
    return dict(_SQL)
