"""Registered queries of documents, readings, clips, maps and checks over the driver's tables, each beside its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import columns as fx
from tidemark.operators import battle, checks, clips, documents, folds, joins, maps, picks, readings, records, templates, windows
from tidemark.operators.chunks import numbered
from tidemark.plans import search
from tidemark.plans.adapters import MATCH_RECORDS_SQL, TIMELINE_SQL, match_records, table, timeline
from tidemark.plans.analytics import QuerySpec, chart, members, run_query
from tidemark.streaming import flows

QUERIES: dict = {}
SQL: dict[str, str] = {}
KEY, ORDER = ["key"], ["t", "id"]
_W = "WINDOW w AS (PARTITION BY key ORDER BY t, id)"


def registered(sql: str):
    def keep(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return keep


def _r(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n).cast("double"), places) for n in names})


# Documents -----------------------------------------------------------------------------------------------------------


def _recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer as a recording, its orders as matches; those still pending have no analysis."""
    o = table(spark, sf_dir, "orders")
    match = F.struct(F.col("o_orderkey").alias("match_id"), F.when(F.col("o_orderstatus") != "P", F.concat(F.lit("/a/"), F.col("o_orderkey").cast("string"))).alias("analysis_url"))
    return o.groupBy(F.col("o_custkey").alias("recording_id")).agg(F.collect_list(match).alias("matches"))


@registered("SELECT o_custkey AS recording_id, o_orderkey AS match_id, '/a/' || o_orderkey AS analysis_url FROM orders WHERE o_orderstatus <> 'P'")
def analysed_matches(spark, sf_dir):
    return documents.analysed_matches(_recordings(spark, sf_dir))


@registered(f"WITH {MATCH_RECORDS_SQL} SELECT id, stage, rule, outcome, self_weapon, array_to_string(enemy_weapons, ',') AS enemy_weapons, kills, deaths FROM records")
def search_view(spark, sf_dir):
    return documents.search_view(match_records(spark, sf_dir)).drop("recorded_at").withColumn("enemy_weapons", F.array_join("enemy_weapons", ","))


@registered("""WITH l AS (SELECT l_orderkey AS id, max(l_quantity) AS kills, min(l_quantity) AS deaths, max(struct_pack(a := l_linenumber, b := l_partkey, c := l_suppkey, q := l_quantity)).q AS last_count FROM lineitem GROUP BY 1)
SELECT o_orderkey AS id, o_orderstatus AS outcome, last_count, o_orderpriority AS rule, kills, deaths, coalesce(deaths < 5, false) AS has_death_analysis FROM orders LEFT JOIN l ON o_orderkey = l.id""")
def document_summaries(spark, sf_dir):
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    counts = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(line)), lambda s: s["l_quantity"]).alias("game_counts"), F.max("l_quantity").alias("kills"), F.min("l_quantity").alias("deaths"))
    o = table(spark, sf_dir, "orders")
    docs = o.join(counts, o.o_orderkey == counts.l_orderkey, "left").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("outcome"), "game_counts", F.lit("s").alias("stage"), F.col("o_orderpriority").alias("rule"), "kills", "deaths", F.when(F.col("deaths") < 5, F.array(F.lit(1))).alias("death_analysis"))
    out = documents.summary(docs)
    return out.select("id", "outcome", F.get("game_counts", 0).alias("last_count"), "stage_map.rule", "player_stats.kills", "player_stats.deaths", "has_death_analysis")


@registered("""SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN NULL ELSE substr(text, 1, 20) END AS title, CASE WHEN role = 'assistant' THEN NULL ELSE role END AS source, length(text) AS n FROM conversations""")
def detected_events(spark, sf_dir):
    event = F.struct("turn", F.substring("text", 1, 20).alias("title"), F.when(F.col("role") == "assistant", "codex-review").otherwise(F.col("role")).alias("analysis_source"), F.length("text").alias("n"))
    docs = table(spark, sf_dir, "conversations").select("conv_id", F.array(event).alias("events"))
    plain = docs.select("conv_id", F.inline(documents.detected_events(F.col("events"), ["turn", "title", "analysis_source", "n"])))
    return plain.select("conv_id", "turn", "title", F.col("analysis_source").alias("source"), "n")


@registered("""SELECT event_id AS id, TRY_CAST(nullif(regexp_extract(props, '"k": *(-?[0-9]+)', 1), '') AS BIGINT) AS k, NULL::BIGINT AS missing FROM events""")
def dotted_lookup(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), documents.looked_up(F.col("props"), "k", "bigint").alias("k"), documents.looked_up(F.col("props"), "k.deeper.0", "bigint").alias("missing"))


@registered(f"WITH {MATCH_RECORDS_SQL} SELECT id FROM records WHERE stage IS NULL OR rule IS NULL OR self_weapon IS NULL OR len(enemy_weapons) < 4")
def missing_details(spark, sf_dir):
    return documents.missing_details(match_records(spark, sf_dir)).select("id")


@registered(f"WITH {TIMELINE_SQL} SELECT key, t, id, 'camera' AS detector FROM timeline WHERE kind = 'error' UNION ALL SELECT key, t, id, 'colour' FROM timeline WHERE kind IN ('purchase', 'error')")
def detections_united(spark, sf_dir):
    rows = timeline(spark, sf_dir).select("key", "t", "id", "kind")
    a = rows.where("kind = 'error'").select("key", "t", "id", F.lit("camera").alias("detector"))
    b = rows.where("kind in ('purchase', 'error')").select(F.lit("colour").alias("detector"), "id", "t", "key")
    return documents.united([a, b])


_RECOVER = """WITH seg AS (SELECT o_custkey AS id, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS number FROM orders),
ev AS (SELECT l_orderkey AS k, count(*) AS events FROM lineitem GROUP BY 1),
m AS (SELECT seg.id, number, k, CASE WHEN events IS NULL THEN 'split' ELSE 'ready' END AS status, coalesce(events, 0) AS events FROM seg LEFT JOIN ev USING (k) WHERE k % 4 <> 1)"""


def _recovered(spark: SparkSession, sf_dir: str):
    o, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    files = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    spans = F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda k: F.struct(k.cast("double").alias("start"), (k + 1).cast("double").alias("end")))
    manifests = o.groupBy(F.col("o_custkey").alias("id")).agg(spans.alias("segments"))
    placed = manifests.select("id", F.posexplode("segments").alias("at", "s")).select("id", (F.col("at") + 1).alias("number"), F.col("s.start").cast("long").alias("k"))
    told = lines.groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("events"))
    return documents.recovered(files, manifests, placed.where("k % 4 <> 1").select("id", "number"), placed.join(told, "k").select("id", "number", "events"))


@registered(f"{_RECOVER} SELECT id, number, k::DOUBLE AS start, status, events FROM m")
def recovered_matches(spark, sf_dir):
    return _recovered(spark, sf_dir)[0].select("id", "number", "start", "status", "events")


@registered(f"{_RECOVER}, r AS (SELECT id, count(*) AS matches, count(*) FILTER (status = 'ready') AS ready FROM m GROUP BY id) SELECT c_custkey AS id, CASE WHEN matches = ready THEN 'ready' ELSE 'queued' END AS status, coalesce(matches, 0) AS matches FROM customer LEFT JOIN r ON c_custkey = r.id")
def recovered_recordings(spark, sf_dir):
    return _recovered(spark, sf_dir)[1]


@registered("""WITH l AS (SELECT l_orderkey AS id, count(*) AS n FROM lineitem GROUP BY 1), d AS (SELECT o_orderkey AS id, o_orderstatus, nullif(trim(CASE WHEN o_orderkey % 9 = 0 THEN ' ' ELSE o_orderpriority END), '') AS rule, o_custkey / 8.0::DOUBLE AS kills, o_orderkey % 2 = 0 AS trusted, n FROM orders LEFT JOIN l ON o_orderkey = l.id)
SELECT id, rule, CASE o_orderstatus WHEN 'F' THEN 'win' WHEN 'O' THEN 'lose' END AS outcome, CASE WHEN trusted THEN round(least(99, kills), 4) END AS kills, least(99, CASE WHEN trusted THEN id % 120 WHEN id % 3 = 0 THEN 7 ELSE coalesce(n, 0) END)::DOUBLE AS death_count FROM d""")
def derived_records(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    events = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.lit("death").alias("type"))).alias("events"))
    none = F.array().cast("array<struct<type: string>>")
    docs = o.join(events, o.o_orderkey == events.l_orderkey, "left").select(
        F.col("o_orderkey").alias("id"), F.lit("r").alias("recording_id"), F.lit(1).alias("match_number"), F.col("o_orderdate").alias("recorded_at"), F.lit(" s ").alias("stage"),
        F.when(F.col("o_orderkey") % 9 == 0, " ").otherwise(F.col("o_orderpriority")).alias("rule"),
        F.when(F.col("o_orderstatus") == "F", "win").when(F.col("o_orderstatus") == "O", "lose").otherwise("?").alias("outcome"), F.lit(-1.0).alias("duration"),
        F.struct(F.when(F.col("o_orderkey") % 2 == 0, "result").otherwise("candidate-only").alias("source"), (F.col("o_custkey") / 8).alias("kills"), (F.col("o_orderkey") % 120).cast("double").alias("deaths")).alias("personal_result"),
        F.when(F.col("o_orderkey") % 3 == 0, 7.0).alias("validated_deaths"), F.coalesce("events", none).alias("events"), F.array(F.lit(" ")).alias("enemy_weapons"), F.lit("old").alias("legacy"))
    flat = records.derive_record(records.without_legacy(docs, ["legacy"]))
    return flat.select("id", "rule", "outcome", F.round("player_stats.kills", 4).alias("kills"), F.col("death_count").cast("double").alias("death_count"))


# Readings ------------------------------------------------------------------------------------------------------------


@registered("""WITH g AS (SELECT o_orderkey AS id, unnest([struct_pack(k := 0, a := 0.0::DOUBLE), struct_pack(k := 3, a := 0.125::DOUBLE), struct_pack(k := 5, a := 0.25::DOUBLE)]) AS c, o_orderkey % 13 AS x, o_custkey % 11 AS y, o_custkey % 10 AS d2 FROM orders),
p AS (SELECT a.id, (a.id + a.c.k) % 10 AS d1, a.x * 0.03125::DOUBLE + a.c.a AS s1, (b.d2 + b.c.k) % 10 AS d2, b.y * 0.03125::DOUBLE + b.c.a AS s2 FROM g a JOIN g b ON a.id = b.id WHERE a.x * 0.03125::DOUBLE <= 0.48 AND b.y * 0.03125::DOUBLE <= 0.48),
r AS (SELECT id, d1 * 10 + d2 AS value, round((s1 + s2) / 2, 9) AS cost FROM p WHERE d1 <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY cost, value) AS rank FROM r) SELECT id, rank, value::INTEGER AS value, round(cost, 6) AS cost FROM n WHERE rank <= 12""")
def digit_beam(spark, sf_dir):
    def glyph(digit, base):
        return F.array(*[F.struct(((digit + k) % 10).cast("int").alias("digit"), F.round(base + a, 9).alias("score")) for k, a in ((0, 0.0), (3, 0.125), (5, 0.25))])

    glyphs = F.array(glyph(F.col("o_orderkey"), (F.col("o_orderkey") % 13) * F.lit(0.03125)), glyph(F.col("o_custkey"), (F.col("o_custkey") % 11) * F.lit(0.03125)))
    rounded = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.posexplode(readings.numbers(glyphs)).alias("at", "n"))
    return _r(rounded.select("id", (F.col("at") + 1).alias("rank"), F.col("n.value").alias("value"), F.col("n.cost").alias("cost")), "cost")


@registered("""WITH r AS (SELECT l_suppkey AS key, l_quantity::INTEGER AS value, min(l_discount + l_tax) AS cost, count(*) AS support FROM lineitem GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY cost, support DESC, value) AS rank FROM r) SELECT key, value, round(cost, 6) AS cost, support, rank FROM n WHERE rank <= 18""")
def best_readings(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("key"), F.col("l_quantity").cast("int").alias("value"), (F.col("l_discount") + F.col("l_tax")).alias("cost"))
    return _r(readings.best_readings(rows, KEY), "cost")


@registered(f"""WITH {TIMELINE_SQL}, p AS (SELECT *, value >= 50 AS high FROM timeline) SELECT key, id, coalesce(t - lag(t) OVER w <= 20000 AND lag(kind) OVER w = kind AND lag(high) OVER w = high, false) AS stable FROM p {_W}""")
def stability_gate(spark, sf_dir):
    rows = timeline(spark, sf_dir).withColumn("high", F.col("value") >= 50)
    return readings.stable_results(rows, KEY, ORDER, ["kind", "high"], 20000.0).select("key", "id", "stable")


@registered(f"""WITH {TIMELINE_SQL}, f AS (SELECT *, min(t) OVER (PARTITION BY key) AS s FROM timeline), p AS (SELECT key, count(*) FILTER (value <= 60 AND t BETWEEN s + 400000 - 200000 AND s + 400000 + 1200000) AS panels FROM (SELECT key, value, t, s FROM f) GROUP BY key),
k AS (SELECT key, count(*) FILTER (kind = 'signup') // 20 AS ticks FROM timeline GROUP BY key)
SELECT key, panels, CASE WHEN panels < 6 THEN 0 ELSE ticks END AS ticks, CASE WHEN panels < 6 THEN 'ヤグラ' WHEN ticks >= 4 THEN 'エリア' ELSE 'アサリ' END AS rule FROM p JOIN k USING (key)""")
def inferred_rule(spark, sf_dir):
    rows = timeline(spark, sf_dir)
    first = rows.groupBy("key").agg(F.min("t").alias("s"))
    scaled = rows.join(first, "key").withColumn("at", (F.col("t") - F.col("s") - 400000) / 100000)
    ticks = rows.groupBy("key").agg(F.floor(F.count(F.when(F.col("kind") == "signup", 1)) / 20).alias("ticks"))
    return readings.inferred_rule(scaled, KEY, "at", F.lit(0.0), F.col("value") <= 60, ticks)


@registered(f"""WITH RECURSIVE {TIMELINE_SQL}, n AS (SELECT *, value >= 8 AS f, min(t) OVER (PARTITION BY key) AS s FROM timeline), a AS (SELECT *, lag(f) OVER w AS b, lead(f) OVER w AS c FROM n {_W}),
cand AS (SELECT key, t, id FROM a WHERE f AND b AND c AND t >= s + 0.75 AND t < s + 20), pick AS (
 SELECT key, min(t) AS t, 1 AS nth FROM cand GROUP BY key UNION ALL SELECT c.key, min(c.t), p.nth + 1 FROM pick p JOIN cand c ON c.key = p.key AND c.t >= p.t + 1.5 WHERE p.nth < 3 GROUP BY c.key, p.nth)
SELECT c.key, c.id FROM pick p JOIN cand c USING (key, t) WHERE p.nth > 1""".replace("epoch_us(ts) / 1e6", "epoch_us(ts) / 1e11"))
def opening_rosters(spark, sf_dir):
    rows = timeline(spark, sf_dir).withColumn("t", F.col("t") / 1e5)
    first = rows.groupBy("key").agg(F.min("t").alias("s"))
    return readings.opening_rosters(rows.join(first, "key"), KEY, ORDER, F.col("value") >= 8, F.col("s"), F.lit(1e12), 2, 1).select("key", "id")


@registered(f"""WITH {TIMELINE_SQL}, s AS (SELECT *, lag(value) OVER w AS was FROM timeline {_W}) SELECT key, id, was, round(value - was, 6) AS change FROM s WHERE was <> value AND kind IN ('error', 'purchase')""")
def changes_at_times(spark, sf_dir):
    rows = timeline(spark, sf_dir)
    times = rows.where("kind in ('error', 'purchase')").select("key", "t", "id")
    out = readings.changes_at(rows, times, KEY, ORDER, "value").join(times.select("key", "id"), ["key", "id"], "left_semi")
    return _r(out.select("key", "id", "was", "change"), "change")


@registered(f"""WITH {TIMELINE_SQL}, c AS (SELECT key, t, value AS x, id AS y, lag(t) OVER w AS bt, lag(value) OVER w AS bx, lag(id) OVER w AS by_ FROM timeline WHERE kind = 'click' {_W}),
m AS (SELECT e.key, e.id, e.t AS asked, c.* EXCLUDE (key) FROM (SELECT key, id, t FROM timeline WHERE kind = 'error') e ASOF LEFT JOIN c ON e.key = c.key AND e.t <= c.t)
SELECT key, id, round(bx + (x - bx) * ((asked - bt) / (t - bt)), 4) AS x, round(by_ + (y - by_) * ((asked - bt) / (t - bt)), 4) AS y, CASE WHEN bx IS NOT NULL THEN 0.5::DOUBLE END AS confidence FROM m""")
def places_at_times(spark, sf_dir):
    rows = timeline(spark, sf_dir)
    points = rows.where("kind = 'click'").select("key", "t", F.col("value").alias("x"), F.col("id").cast("double").alias("y"), F.lit(0.5).alias("confidence"))
    return _r(readings.places_at(rows.where("kind = 'error'").select("key", "t", "id"), points, KEY).select("key", "id", "x", "y", "confidence"), "x", "y", places=4)


@registered("SELECT a.label AS label, b.label AS other, round(sqrt(greatest(0, 1 - list_sum(list_transform(list_zip(a.h, b.h), lambda p: sqrt(p[1] * p[2]))))), 5) AS distance FROM (SELECT label, list_transform(l, lambda x: x / list_sum(l)) AS h FROM (SELECT label, [count(*) FILTER (vec_id % 4 = 0), count(*) FILTER (vec_id % 4 = 1), count(*) FILTER (vec_id % 4 = 2), count(*) FILTER (vec_id % 4 = 3)] AS l FROM embeddings GROUP BY label)) a JOIN (SELECT label, list_transform(l, lambda x: x / list_sum(l)) AS h FROM (SELECT label, [count(*) FILTER (vec_id % 4 = 0), count(*) FILTER (vec_id % 4 = 1), count(*) FILTER (vec_id % 4 = 2), count(*) FILTER (vec_id % 4 = 3)] AS l FROM embeddings GROUP BY label)) b ON b.label = a.label + 1")
def histogram_distance(spark, sf_dir):
    counts = [F.count(F.when(F.col("vec_id") % 4 == k, 1)).cast("double") for k in range(4)]
    by = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.array(*counts).alias("n"), F.count("*").alias("all"))
    shares = by.select("label", F.transform("n", lambda x: x / F.col("all")).alias("h"))
    other = shares.select((F.col("label") - 1).alias("label"), F.col("label").alias("other"), F.col("h").alias("g"))
    return _r(shares.join(other, "label").select("label", "other", templates.bhattacharyya(F.col("h"), F.col("g")).alias("distance")), "distance", places=5)


# Intervals, clips and maps -------------------------------------------------------------------------------------------

_WINDOWS = "win AS (SELECT key, row_number() OVER (PARTITION BY key ORDER BY t, id) AS number, t AS start, t + 3600 AS \"end\" FROM timeline WHERE kind = 'purchase')"


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    bought = timeline(spark, sf_dir).where("kind = 'purchase'")
    return numbered(bought, KEY, ORDER, "number", windows.CHUNK).select("key", "number", F.col("t").alias("start"), (F.col("t") + 3600).alias("end"))


@registered(f"""WITH {TIMELINE_SQL}, {_WINDOWS} SELECT l.key, l.id, number, round(l.t - start, 3) AS t FROM timeline l JOIN win ON l.key = win.key AND l.t BETWEEN start AND "end" """)
def routed_samples(spark, sf_dir):
    return flows.routed(timeline(spark, sf_dir).select("key", "id", "t"), _windows(spark, sf_dir), "key", "t", 3600.0)


@registered(f"""WITH {TIMELINE_SQL}, {_WINDOWS} SELECT l.key, number, round(l.t - start, 3) AS t, value FROM timeline l JOIN win ON l.key = win.key AND l.t BETWEEN start AND "end" WHERE kind = 'click'""")
def rebased_series(spark, sf_dir):
    series = timeline(spark, sf_dir).where("kind = 'click'").select("key", "t", "value")
    return clips.rebased(series, _windows(spark, sf_dir), "key", 3, 3600.0)


@registered(f"""WITH {TIMELINE_SQL}, {_WINDOWS}, f AS (SELECT key, 'f' || id AS file_name, t AS s, t + 5000 AS e FROM timeline WHERE kind = 'view'),
m AS (SELECT win.key, number, file_name, s, sum(e - s) OVER (PARTITION BY win.key, number ORDER BY s, file_name) - (e - s) AS before FROM win JOIN f ON win.key = f.key AND "end" > s AND start < e)
SELECT key, number, file_name, round(before, 3) AS timeline_start FROM m""")
def fragment_manifest(spark, sf_dir):
    files = timeline(spark, sf_dir).where("kind = 'view'").select("key", F.concat(F.lit("f"), F.col("id").cast("string")).alias("file_name"), F.col("t").alias("start"), (F.col("t") + 5000).alias("end"))
    return clips.fragment_manifest(_windows(spark, sf_dir), files, "key").select("key", "number", "file_name", "timeline_start")


@registered(f"""WITH {TIMELINE_SQL}, {_WINDOWS}, e AS (SELECT key, id, t FROM timeline WHERE kind = 'error'),
m AS (SELECT e.key, id, e.t, number, CASE WHEN e.t BETWEEN start AND "end" THEN 0 ELSE 1 END AS far, CASE WHEN e.t BETWEEN start AND "end" THEN 0 ELSE least(abs(e.t - start), abs(e.t - "end")) END AS gap FROM e JOIN win ON e.key = win.key),
r AS (SELECT *, row_number() OVER (PARTITION BY key, id ORDER BY far, gap, number) AS n FROM m) SELECT key, id, number FROM r WHERE n = 1""")
def nearest_clip(spark, sf_dir):
    times = timeline(spark, sf_dir).where("kind = 'error'").select("key", "t", "id")
    clip = _windows(spark, sf_dir).withColumn("nth", F.col("number"))
    return clips.nearest_clip(clip, times, KEY, 3600.0).join(times, ["key", "t"]).select("key", "id", "number")


@registered(f"""WITH {TIMELINE_SQL} SELECT e.key, e.id, CASE WHEN e.t - c.t <= 7200 THEN round(c.value, 6) END AS state FROM (SELECT * FROM timeline WHERE kind = 'error') e ASOF LEFT JOIN (SELECT * FROM timeline WHERE kind = 'click') c ON e.key = c.key AND e.t >= c.t""")
def tolerant_asof(spark, sf_dir):
    rows = timeline(spark, sf_dir)
    out = joins.asof(rows.where("kind = 'error'").select("key", "t", "id"), rows.where("kind = 'click'"), KEY, "t", ["value"], longest=7200.0)
    return _r(out.select("key", "id", F.col("right_value").alias("state")), "state")


@registered(f"""WITH {TIMELINE_SQL}, p AS (SELECT key, t, value * 10 AS x, 500.0 AS y, value * 3 AS d, 0.8 AS c, lead(t) OVER w AS n FROM timeline WHERE kind = 'signup' {_W}),
k AS (SELECT *, least(6, coalesce(greatest(0, (n - t) - 0.5), 6)) AS lasts FROM p), e AS (SELECT *, unnest(range(0, floor(lasts)::INT + 1)) AS s FROM k WHERE lasts >= 1)
SELECT key, s, floor(t + s)::BIGINT AS t, round(greatest(0, least(1000, x + cos(radians(d)) * s * 12)), 1) AS x, round(c * exp(-s / 3.5), 3) AS confidence FROM e""")
def heading_predictions(spark, sf_dir):
    points = timeline(spark, sf_dir).where("kind = 'signup'").select("key", "t", (F.col("value") * 10).alias("x"), F.lit(500.0).alias("y"), (F.col("value") * 3).alias("direction"), F.lit(0.8).alias("confidence"))
    out = maps.heading_predictions(points, KEY)
    return out.select("key", F.round(F.col("t") - F.col("observed_at")).cast("long").alias("s"), F.floor("t").alias("t"), "x", "confidence")


@registered(f"""WITH {TIMELINE_SQL}, m AS (SELECT e.key, e.t, c.value AS x, c.t AS ct FROM (SELECT * FROM timeline WHERE kind = 'error') e ASOF JOIN (SELECT * FROM timeline WHERE kind = 'click') c ON e.key = c.key AND e.t <= c.t)
SELECT key, s, floor(t + s)::BIGINT AS t, round(x, 4) AS x, (55.0 + s * 11)::DOUBLE AS radius, round(round(least(0.48, 0.5 * 0.9 * 0.72), 3) * exp(-s / 3.5), 3) AS confidence FROM (SELECT *, unnest(range(0, 7)) AS s FROM m WHERE ct - t <= 5000)""")
def threat_zones(spark, sf_dir):
    rows = timeline(spark, sf_dir)
    deaths = rows.where("kind = 'error'").select("key", "t", F.lit(0.5).alias("confidence"))
    points = rows.where("kind = 'click'").select("key", "t", F.col("value").alias("x"), F.lit(1.0).alias("y"), F.lit(0.9).alias("confidence"))
    out = maps.threat_zones(deaths, points, KEY, longest=5000.0)
    return out.select("key", F.round(F.col("t") - F.col("death_t")).cast("long").alias("s"), F.floor("t").alias("t"), F.round("x", 4).alias("x"), F.col("radius").cast("double").alias("radius"), "confidence")


@registered(f"""WITH {TIMELINE_SQL}, a AS (SELECT *, value >= 3 AS visible, EXISTS (SELECT 1 FROM timeline d WHERE d.key = s.key AND d.kind = 'error' AND s.t - d.t BETWEEN 0.5 AND 5) AS after FROM timeline s),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY visible DESC, after DESC, value DESC, t, id) AS n FROM a WHERE id % 100 / 100 >= 0.21) SELECT key, id FROM r WHERE n = 1""")
def best_frame(spark, sf_dir):
    rows = timeline(spark, sf_dir)
    frames = rows.select("key", "t", "id", (F.col("id") % 100 / 100).alias("structure"), (F.col("value") >= 3).alias("visible"), F.col("value").alias("score"))
    return maps.best_frame(frames, rows.where("kind = 'error'").select("key", "t"), KEY).select("key", "id")


@registered("""WITH c AS (SELECT c_custkey AS key, c_name AS a FROM customer), p AS (SELECT DISTINCT p_brand AS name, p_brand || 'x' AS other FROM part),
n AS (SELECT DISTINCT l_partkey AS id, CASE WHEN l_partkey % 3 = 0 THEN p_brand WHEN l_partkey % 3 = 1 THEN ' ' || p_brand || '・Z' ELSE 'none' || l_partkey END AS name FROM lineitem JOIN part ON p_partkey = l_partkey),
near AS (SELECT n.id, n.name, count(*) AS k, min(p.name) AS hit, count(*) FILTER (p.name = n.name) AS same FROM n JOIN p ON contains(regexp_replace(n.name, '[・.\\s]', '', 'g'), p.name) OR contains(p.name, regexp_replace(n.name, '[・.\\s]', '', 'g')) GROUP BY ALL)
SELECT n.id, CASE WHEN same > 0 THEN n.name WHEN k = 1 THEN hit END AS catalog_name FROM n LEFT JOIN near ON n.id = near.id AND n.name = near.name""")
def fuzzy_names(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    used = table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_partkey").alias("id"), "p_brand").distinct()
    third = F.col("id") % 3
    names = used.select("id", F.when(third == 0, F.col("p_brand")).when(third == 1, F.concat(F.lit(" "), F.col("p_brand"), F.lit("・Z"))).otherwise(F.concat(F.lit("none"), F.col("id").cast("string"))).alias("name")).distinct()
    return search.catalog_match(names, part.select(F.col("p_brand").alias("name"), F.lit("w").alias("type")).distinct()).select("id", "catalog_name")


# Checks and formats --------------------------------------------------------------------------------------------------


@registered("""SELECT l_orderkey AS id, l_linenumber AS n, l_quantity - 3 AS start, l_quantity * l_discount * 20 AS "end" FROM lineitem WHERE l_quantity >= 3 AND l_quantity * l_discount * 20 > l_quantity - 3""")
def valid_spans(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), (F.col("l_quantity") - 3).alias("start"), (F.col("l_quantity") * F.col("l_discount") * 20).alias("end"))
    return records.valid_spans(rows)


@registered(f"""WITH {TIMELINE_SQL}, r AS (SELECT key, id, row_number() OVER (PARTITION BY key ORDER BY id) AS n FROM timeline WHERE value * 15 BETWEEN 0 AND 1000 AND id % 1100 <= 1000) SELECT key, id FROM r WHERE n <= 20""")
def valid_positions(spark, sf_dir):
    rows = timeline(spark, sf_dir).select("key", F.col("id").alias("seq"), (F.col("value") * 15).alias("x"), (F.col("id") % 1100).alias("y"))
    return checks.positions(rows).select("key", F.col("seq").alias("id"))


@registered(f"""WITH {TIMELINE_SQL}, d AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY (value > 50) DESC, value DESC, t) AS n FROM timeline WHERE kind = 'error'), e AS (SELECT * FROM d WHERE n <= key % 4)
SELECT key, id, 'death-' || row_number() OVER (PARTITION BY key ORDER BY t) AS death FROM e""")
def expected_deaths(spark, sf_dir):
    rows = timeline(spark, sf_dir).where("kind = 'error'").select("key", "t", F.col("id").alias("event"), (F.col("value") > 50).alias("confirmed"), F.col("value").alias("confidence"))
    expected = rows.select("key", (F.col("key") % 4).alias("expected")).distinct()
    return battle.expected_deaths(rows, expected, KEY).select("key", F.col("event").alias("id"), F.col("id").alias("death"))


@registered(f"""WITH {TIMELINE_SQL}, o AS (SELECT key, (id % 8)::INT AS slot, count(*) AS deaths, count(*) FILTER (value > 40) AS confirmed FROM timeline WHERE kind = 'error' GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY abs(deaths - 3), confirmed DESC, slot) AS n FROM o) SELECT key, slot, deaths FROM r WHERE n = 1""")
def nearest_option(spark, sf_dir):
    options = timeline(spark, sf_dir).where("kind = 'error'").groupBy("key", (F.col("id") % 8).cast("int").alias("slot")).agg(F.count("*").alias("deaths"), F.count(F.when(F.col("value") > 40, 1)).alias("confirmed"))
    return battle.best_candidates(options, options.select("key", F.lit(3).alias("expected")).distinct(), KEY).select("key", "slot", "deaths")


@registered(f"""WITH {MATCH_RECORDS_SQL} SELECT rule, printf('%.2f', sum(kills) FILTER (deaths IS NOT NULL) / nullif(sum(deaths) FILTER (kills IS NOT NULL), 0)) AS kd, count(*)::VARCHAR AS n,
lpad((floor(min(duration_seconds)) // 60)::INT::VARCHAR, 2, '0') || ':' || lpad((floor(min(duration_seconds))::INT % 60)::VARCHAR, 2, '0') AS shortest FROM records GROUP BY rule""")
def formatted_metrics(spark, sf_dir):
    rows = match_records(spark, sf_dir)
    groups = run_query(rows, QuerySpec(metric="kdRatio", dimension="rule")).select(F.col("key").alias("rule"), "value", "matches")
    shortest = rows.groupBy("rule").agg(F.min("duration_seconds").alias("s"))
    return groups.join(shortest, "rule").select("rule", fx.formatted(F.col("value"), "ratio").alias("kd"), fx.formatted(F.col("matches"), "count").alias("n"), fx.clock(F.col("s")).alias("shortest"))


@registered(f"""WITH {MATCH_RECORDS_SQL}, g AS (SELECT strftime(recorded_at, '%Y-%m-%d') AS key, avg(kills) AS value, count(*) AS matches FROM records WHERE kills IS NOT NULL GROUP BY 1),
s AS (SELECT key, round(value, 6) AS value, row_number() OVER (ORDER BY value DESC, matches DESC, key) AS n FROM (SELECT strftime(recorded_at, '%Y-%m-%d') AS key, avg(kills) AS value, count(*) AS matches FROM records GROUP BY 1 HAVING count(kills) > 0)) SELECT key, value FROM s WHERE n <= 12""")
def chart_top(spark, sf_dir):
    return _r(chart(match_records(spark, sf_dir), QuerySpec(metric="averageKills", dimension="day", chart="bar", sort="desc")).select("key", "value"), "value")


@registered(f"WITH {MATCH_RECORDS_SQL} SELECT id, unnest(list_distinct(enemy_weapons)) AS key FROM records WHERE outcome = 'lose'")
def group_members(spark, sf_dir):
    return members(match_records(spark, sf_dir), QuerySpec(metric="lossRate", dimension="opponentWeapon", filters={"outcome": "lose"})).select("id", "key")


@registered(f"WITH {TIMELINE_SQL} SELECT key, id FROM timeline WHERE floor(t * 4 + 0.5)::BIGINT % 2 = 0")
def decimated_samples(spark, sf_dir):
    return flows.decimated(timeline(spark, sf_dir), "t", 4.0).select("key", "id")


@registered("SELECT o_orderkey AS id, CASE WHEN o_custkey % 4 < 3 THEN epoch(o_orderdate)::BIGINT + least(3600, 30 * pow(2, greatest(o_custkey % 4 - 1, 0)))::BIGINT END AS again FROM orders")
def next_attempts(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    again = flows.next_attempt(F.col("o_custkey") % 4, F.col("o_orderdate").cast("timestamp"), 30, 3600, 3)
    return o.select(F.col("o_orderkey").alias("id"), F.unix_seconds(again).alias("again"))


@registered(f"""WITH {TIMELINE_SQL}, f AS (SELECT *, CASE WHEN kind = 'view' THEN 'tacticooler' ELSE 'plain' END AS variant, value >= 3 AS seen FROM timeline WHERE value >= 3), m AS (SELECT *, CASE WHEN lag(t) OVER w IS NULL OR t - lag(t) OVER w > 0.35 THEN 1 ELSE 0 END AS a, CASE WHEN lag(t) OVER w IS NULL OR t - lag(t) OVER w > 0.75 THEN 1 ELSE 0 END AS b FROM f {_W}),
s AS (SELECT *, sum(a) OVER (PARTITION BY key ORDER BY t, id) AS streak, sum(b) OVER (PARTITION BY key ORDER BY t, id) AS session FROM m),
k AS (SELECT key, session, streak, count(*) AS n, min(t) AS first, max(t) AS last FROM s GROUP BY ALL), r AS (SELECT key, session, max(n) AS longest, sum(n) AS observations, min(first) AS t, max(last) AS last FROM k GROUP BY ALL)
SELECT key, round(t, 3) AS t, round(last - t + 0.5, 3) AS duration, observations::BIGINT AS observations, longest AS consecutive FROM r WHERE longest >= 8""".replace("epoch_us(ts) / 1e6", "epoch_us(ts) / 1e11"))
def respawn_runs(spark, sf_dir):
    rows = timeline(spark, sf_dir).withColumn("t", F.col("t") / 1e5)
    frames = rows.select("key", "t", F.when(F.col("kind") == "view", "tacticooler").otherwise("plain").alias("kind"), F.when(F.col("value") >= 3, 0.7).otherwise(0.1).alias("score"), F.lit(0.5).alias("white"), F.lit(0.5).alias("fine_white"))
    out = battle.respawn_runs(frames, KEY, 0.0, 1e12)
    return out.select("key", F.round("t", 3).alias("t"), F.round("duration", 3).alias("duration"), "observations", "consecutive")


@registered(f"""WITH RECURSIVE {TIMELINE_SQL}, marked AS (SELECT *, CASE WHEN lag(t) OVER w IS NULL OR t - lag(t) OVER w > 21600 THEN 1 ELSE 0 END AS starts FROM timeline {_W}),
s AS (SELECT key, t, id, sum(starts) OVER (PARTITION BY key ORDER BY t, id) AS session FROM marked),
pick AS (SELECT key, session, min(t) AS t FROM s GROUP BY ALL UNION ALL SELECT s.key, s.session, min(s.t) FROM pick p JOIN s ON s.key = p.key AND s.session = p.session AND s.t >= p.t + 1800 GROUP BY s.key, s.session, p.t)
SELECT key, session::BIGINT AS session, min(id) AS id FROM pick JOIN s USING (key, session, t) GROUP BY key, session, t""")
def greedy_picks(spark, sf_dir):
    rows = windows.gap_sessions(timeline(spark, sf_dir), KEY, ORDER, 21_600.0)
    return picks.greedy_spacing(rows.select("key", "session", "t", "id"), ["key", "session"], ORDER, 1800.0).select("key", "session", "id")


@registered(f"""WITH RECURSIVE {TIMELINE_SQL}, n AS (SELECT key, t, id, kind, row_number() OVER w AS nth, lead(kind) OVER w AS after, lead(t) OVER w AS after_t FROM timeline {_W}),
f AS (SELECT key, nth, id, kind, t FROM n WHERE nth = 1 UNION ALL
SELECT n.key, n.nth, n.id, CASE WHEN n.after_t - f.t <= 40000 AND f.kind = n.after AND n.kind <> f.kind THEN f.kind ELSE n.kind END, n.t FROM f JOIN n ON n.key = f.key AND n.nth = f.nth + 1)
SELECT key, id, kind FROM f""")
def flips_smoothed(spark, sf_dir):
    rows = timeline(spark, sf_dir).select("key", "t", "id", "kind", F.lit(0.9).alias("confidence"))
    return folds.smooth_flips(rows, KEY, "t", "kind", "confidence", 40_000.0, tie=["id"]).select("key", "id", "kind")


@registered("""WITH c(death_id, s, e, label, nth) AS (VALUES (1, -3.0::DOUBLE, 2.0::DOUBLE, 'a', 0), (2, -1.0, 0.25, 'b', 1), (1, -3.0, 2.0, 'c', 2), (3, -5.0, 30.0, 'd', 3)),
cut AS (SELECT o_orderkey AS key, o_orderpriority AS pattern, nth, label, death_id, least(greatest(l_quantity + s, 0.0), 40.0)::DOUBLE AS start, least(greatest(l_quantity + e, 0.0), 40.0)::DOUBLE AS "end" FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN c ON death_id = l_linenumber)
SELECT key, pattern, death_id, start, "end", min(nth) AS nth, arg_min(label, nth) AS label FROM cut WHERE "end" - start >= 0.5 GROUP BY key, pattern, death_id, start, "end\"""")
def clip_ranges(spark, sf_dir):
    clip = lambda d, s, e, label: F.struct(F.lit(d).alias("death_id"), F.lit(s).alias("start"), F.lit(e).alias("end"), F.lit(label).alias("label"))
    wanted = F.array(clip(1, -3.0, 2.0, "a"), clip(2, -1.0, 0.25, "b"), clip(1, -3.0, 2.0, "c"), clip(3, -5.0, 30.0, "d"))
    patterns = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("pattern"), F.lit(40.0).alias("duration"), wanted.alias("clips"))
    deaths = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").cast("int").alias("id"), F.col("l_quantity").cast("double").alias("t"))
    return clips.clip_ranges(patterns, deaths, KEY)


@registered(f"""WITH {TIMELINE_SQL}, v AS (SELECT key, t / 1e4 AS t, id, value FROM timeline WHERE kind <> 'error'),
m AS (SELECT *, CASE WHEN lag(t) OVER w IS NULL OR t - lag(t) OVER w > 2.1 THEN 1 ELSE 0 END AS opens FROM v {_W}),
s AS (SELECT *, sum(opens) OVER (PARTITION BY key ORDER BY t, id) AS session FROM m), u AS (SELECT key, session, max(t) AS until FROM s GROUP BY key, session),
f AS (SELECT *, row_number() OVER (PARTITION BY key, session ORDER BY id % 97 DESC, t) AS nth FROM s WHERE id % 97 >= 50 AND value >= 3)
SELECT key, round(t, 6) AS t, value AS x, (id % 1000)::DOUBLE AS y, (id % 360)::DOUBLE AS direction, (id % 97) / 100.0::DOUBLE AS confidence, round(until, 6) AS until FROM f JOIN u USING (key, session) WHERE nth = 1""")
def map_episodes(spark, sf_dir):
    rows = timeline(spark, sf_dir).withColumn("t", F.col("t") / 1e4)
    marker = F.struct(F.col("value").alias("x"), (F.col("id") % 1000).cast("double").alias("y"), (F.col("id") % 360).cast("double").alias("direction"), ((F.col("id") % 97) / 100.0).alias("confidence"))
    samples = rows.select("key", "t", (F.col("kind") != "error").alias("visible"), F.lit(0.4).alias("neutral"), F.when(F.col("value") >= 3, 0.4).otherwise(0.1).alias("score"), marker.alias("marker"))
    return _r(maps.self_observations(samples, KEY), "t", "until")
