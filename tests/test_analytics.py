"""Metric queries, search and record checks on small records with known answers."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.operators import battle, checks, records
from tidemark.plans import search
from tidemark.plans.analytics import QuerySpec, chart, cube_query, filter_records, members, run_query

SCHEMA = "id string, recorded_at timestamp, stage string, rule string, outcome string, self_weapon string, enemy_weapons array<string>, deaths double, kills double, disadvantage_seconds double, advantage_seconds double, duration_seconds double, recording_file_name string"


@pytest.fixture(scope="module")
def matches(spark):
    rows = [
        ("1", datetime(2026, 8, 10), "A", "エリア", "win", "竹", ["ローラー"], 2.0, 8.0, 10.0, None, 180.0, "r1"),
        ("2", datetime(2026, 8, 11), "A", "ヤグラ", "lose", "竹", ["ローラー", "ブラスター"], 5.0, 4.0, 42.0, None, 240.0, "r2"),
        ("3", datetime(2026, 8, 12), "B", "エリア", None, None, [], None, None, None, None, 300.0, "r3"),
    ]
    return spark.createDataFrame(rows, SCHEMA).cache()


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_filters_stack(matches):
    assert ids(filter_records(matches, {"rule": "エリア"})) == ["1", "3"]
    assert ids(filter_records(matches, {"deaths_max": 5})) == ["1", "2"]
    assert ids(filter_records(matches, {"disadvantage_max": 60})) == ["1", "2"]
    assert ids(filter_records(matches, {"rule": "", "query": "ブラ"})) == ["2"]
    assert ids(filter_records(matches, {"period_days": 1}, datetime(2026, 8, 12))) == ["2", "3"]
    spec = QuerySpec("lossRate", "opponentWeapon", filters={"opponent_weapon": "ローラー"})
    assert ids(members(filter_records(matches, {"outcome": "lose"}), spec).select("id").distinct()) == ["2"]
    with pytest.raises(ValueError):
        filter_records(matches, {"period_days": 1})


def test_unknown_counts_are_not_zero(spark, matches):
    r = run_query(matches, QuerySpec("kdRatio")).first()
    assert (r["matches"], r["decided"], r["winRate"], r["averageKills"], r["averageDeaths"], r["kdRatio"]) == (3, 2, 0.5, 6.0, 3.5, 12 / 7)
    more = matches.union(spark.createDataFrame([("4", None, None, None, None, None, [], 10.0, None, None, None, None, None)], SCHEMA))
    assert run_query(more, QuerySpec("kdRatio")).first()["kdRatio"] == 12 / 7


def test_groups_order_and_samples(matches):
    roller = run_query(matches, QuerySpec("winRate", "opponentWeapon")).where("key = 'ローラー'").first()
    assert (roller["matches"], roller["wins"], roller["losses"], roller["winRate"]) == (2, 1, 1, 0.5)
    keys = lambda spec: [r["key"] for r in run_query(matches, spec).collect()]
    assert keys(QuerySpec("matchCount", "deathBucket")) == ["0–2デス", "3–5デス"]
    assert keys(QuerySpec("matchCount", "disadvantageBucket")) == ["0–15秒", "31–60秒"]
    assert keys(QuerySpec("matchCount", "outcome")) == ["WIN", "LOSE", "未取得"]
    assert keys(QuerySpec("averageDuration", "stage", sort="asc")) == ["A", "B"] and keys(QuerySpec("averageDuration", "stage")) == ["B", "A"]
    got = run_query(matches, QuerySpec("lossRate", "stage", 1)).select("key", "samples").collect()
    assert [tuple(r) for r in got] == [("A", 2)]
    assert run_query(matches, QuerySpec("nonsense", "nonsense")).first()["value"] == 3.0
    assert chart(matches, QuerySpec("matchCount", "day", chart="donut")).count() == 3
    assert cube_query(matches, ["stage", "rule"]).where("grouping = 3").first()["matches"] == 3
    assert run_query(matches.where("false"), QuerySpec("winRate", "stage")).count() == 0


FOUND = "id string, recorded_at string, stage string, rule string, outcome string, self_weapon string, ally_weapons array<string>, enemy_weapons array<string>"


@pytest.fixture(scope="module")
def found(spark):
    rows = [
        ("a", "2026-08-20T12:00:00Z", "マサバ海峡大橋", "エリア", "win", "ホクサイ", ["スプラシューター", "ホクサイ"], ["もみじシューター", "ケルビン525"]),
        ("b", "2026-08-19T12:00:00Z", "ゴンズイ地区", "ヤグラ", "lose", "14式竹筒銃・甲", ["ホクサイ", "ケルビン525"], ["エクスプロッシャー", "プロモデラーRG"]),
        ("c", "2026-08-18T12:00:00Z", "マサバ海峡大橋", "ホコ", "win", "スペースシューターコラボ", ["スプラシューター", "もみじシューター"], ["ホクサイ", "ケルビン525"]),
    ]
    return spark.createDataFrame(rows, FOUND).cache()


def test_facets_are_or_within_and_across(found):
    chosen = {"stages": {"マサバ海峡大橋", "ゴンズイ地区"}, "rules": {"エリア", "ホコ"}, "opponent_weapons": {"ホクサイ", "ケルビン525"}}
    pick = lambda c: [r["id"] for r in search.filter_matches(found, c).collect()]
    assert pick(chosen) == ["a", "c"]
    assert pick(chosen | {"self_weapons": {"スペースシューターコラボ"}}) == ["c"]
    assert pick({"stages": chosen["stages"], "rules": {"ヤグラ"}, "self_weapons": {"竹"}}) == ["b"]
    assert pick({"outcomes": {"win"}, "ally_compositions": {"スプラシューター"}}) == ["a", "c"]
    assert pick({"outcomes": {"win"}, "ally_compositions": {"スプラシューター", "ホクサイ"}}) == ["a"]
    assert pick({"enemy_compositions": {"ホクサイ", "ケルビン525"}}) == ["c"]
    assert pick({}) == ["a", "b", "c"]


def test_dimension_values_in_collation_order(spark, found):
    values = lambda f, c=None: [r["value"] for r in search.dimension_values(found, c).where(F.col("facet") == f).collect()]
    assert values("stages") == ["ゴンズイ地区", "マサバ海峡大橋"]
    assert values("self_weapons") == ["14式竹筒銃・甲", "スペースシューターコラボ", "ホクサイ"]
    assert values("opponent_weapons") == ["エクスプロッシャー", "ケルビン525", "プロモデラーRG", "ホクサイ", "もみじシューター"]
    catalog = spark.createDataFrame([("opponent_weapons", ".52ガロン")], "facet string, value string")
    assert ".52ガロン" in values("opponent_weapons", catalog)
    weapons = spark.createDataFrame([("スプラシューター", "シューター"), ("ホクサイ", "フデ"), ("ホクサイ・ヒュー", "フデ")], "name string, type string")
    got = {r["name"]: (r["catalog_name"], r["type"]) for r in search.catalog_match(spark.createDataFrame([("ホクサイ",), ("ホクサイヒュー",), ("スプラシューターコラボ",), ("なし",)], "name string"), weapons).collect()}
    assert got == {"ホクサイ": ("ホクサイ", "フデ"), "ホクサイヒュー": (None, "その他"), "スプラシューターコラボ": ("スプラシューター", "シューター"), "なし": (None, "その他")}


def test_derived_records(spark):
    schema = "id string, recording_id string, match_number int, recorded_at timestamp, stage string, rule string, outcome string, duration double, personal_result struct<source: string, kills: double, deaths: double>, validated_deaths double, events array<struct<type: string>>, enemy_weapons array<string>"
    rows = [
        ("1", "r", 1, None, " A ", "", "win", 200.0, ("seen", 120.0, 3.0), 9.0, [("death",)], ["a", " ", "b", "c", "d", "e"]),
        ("2", "r", 2, None, "A", "R", "draw", -1.0, ("candidate-only", 1.0, 3.0), None, [("death",), ("other",), ("death",)], None),
        ("3", "r", 3, None, None, None, None, None, None, 4.0, [], []),
    ]
    got = {r["id"]: r for r in records.derive_record(spark.createDataFrame(rows, schema)).collect()}
    assert (got["1"]["stage"], got["1"]["rule"], got["1"]["death_count"], got["1"]["player_stats"]["kills"], got["1"]["enemy_weapons"]) == ("A", None, 3.0, 99.0, ["a", "b", "c", "d"])
    assert (got["2"]["outcome"], got["2"]["death_count"], got["2"]["player_stats"], got["2"]["duration_seconds"]) == (None, 2.0, None, 0.0)
    assert got["3"]["death_count"] == 4.0


def test_rosters_sequences_and_patterns(spark):
    slot = lambda w, c=0.95, a=None: (w, c, a)
    schema = "id string, seq int, team array<struct<weapon: string, confidence: double, agreed: boolean>>, enemy array<struct<weapon: string, confidence: double, agreed: boolean>>, expected string"
    weapons = spark.createDataFrame([(w,) for w in "abcdefgh"], "name string")
    team, enemy = [slot("a"), slot("b", 0.5), slot("c"), slot("d", 0.99, False)], [slot(w) for w in "efgh"]
    rows = [("1", 1, team, enemy, "a"), ("1", 2, team, enemy, None), ("2", 1, team[:3], enemy, None), ("3", 1, [slot("zz"), *team[1:]], enemy, None), ("4", 1, team, enemy, "b")]
    got = checks.rosters(spark.createDataFrame(rows, schema), weapons).collect()
    assert [(r["id"], r["self_slot"], r["allies"], r["enemies"], r["confidence"], r["complete"]) for r in got] == [("1", 0, ["c"], list("efgh"), 0.5, False)]
    step = lambda o, p="action", x="seen": (float(o), p, x, "why")
    schema = "id string, seq int, title string, steps array<struct<offset: double, phase: string, observation: string, interpretation: string>>, tags array<string>"
    good = [step(3), step(1), step(2), step(2), step(0), step(9, "nonsense"), step(5, x=" ")]
    rows = [("d1", 1, "t", good, ["x", "x", " ", "y"]), ("d1", 2, "later", good, ["x"]), ("d2", 1, "t", good[:3], ["x"]), ("zz", 1, "t", good, ["x"])]
    known = spark.createDataFrame([("d1",), ("d2",)], "id string")
    got = checks.sequences(spark.createDataFrame(rows, schema), known).collect()
    assert [(r["id"], r["title"], [s["offset"] for s in r["steps"]], r["tags"]) for r in got] == [("d1", "t", [0.0, 1.0, 2.0, 3.0], ["x", "y"])]
    schema = "report string, seq int, id string, title string, known array<string>, death_ids array<string>, clips array<struct<death_id: string, start: double, end: double, label: string>>"
    clips = [("d1", 0.0, 2.0, "l"), ("d1", 0.0, 2.0, "l"), ("d2", 1.0, 3.0, "l"), ("d2", 3.0, 3.0, "l"), ("d9", 0.0, 1.0, "l")]
    rows = [("r", 1, "p1", "t", ["d1", "d2"], ["d1", "d2", "d9"], clips), ("r", 2, "p2", "t", ["d1", "d2"], ["d1", "d2"], clips[:2]), ("r", 3, "p3", "t", ["d1"], ["d1"], clips)]
    got = checks.patterns(spark.createDataFrame(rows, schema)).collect()
    assert [(r["id"], r["death_ids"], len(r["clips"])) for r in got] == [("p1", ["d1", "d2"], 2)]
    spots = spark.createDataFrame([("k", 1, 5.0, 5.0), ("k", 2, -1.0, 5.0), ("k", 3, 7.0, 1000.0)], "key string, seq int, x double, y double")
    assert sorted(r["seq"] for r in checks.positions(spots).collect()) == [1, 3]


def test_countdowns_and_expected_deaths(spark):
    rows = [(1, 20 + i * 0.25, "plain", 0.6 + (0.1 if i == 3 else 0), 0.5, 0.5) for i in range(10)] + [(1, 40 + i * 0.5, "plain", 0.9, 0.5, 0.5) for i in range(12)] + [(1, 60 + i * 0.25, "tacticooler", 0.6, 0.5, 0.5) for i in range(10)]
    df = spark.createDataFrame(rows, "key long, t double, kind string, score double, white double, fine_white double")
    got = battle.respawn_runs(df, ["key"], 10.0, 100.0).collect()
    assert [(r["t"], r["end"], r["confidence"], r["observations"], r["consecutive"]) for r in got] == [(20.0, 22.75, 0.895, 10, 10)]
    deaths = spark.createDataFrame([(1, 30.0, 0.9, False), (1, 10.0, 0.7, True), (1, 20.0, 0.95, False), (2, 5.0, 0.9, False)], "key long, t double, confidence double, confirmed boolean")
    expected = spark.createDataFrame([(1, 2), (2, 0)], "key long, expected int")
    assert [(r["id"], r["t"]) for r in battle.expected_deaths(deaths, expected, ["key"]).orderBy("t").collect()] == [("death-1", 10.0), ("death-2", 20.0)]
    options = spark.createDataFrame([(1, 0, 3, 0), (1, 1, 1, 1), (1, 2, 2, 0), (1, 3, 2, 0)], "key long, slot int, deaths int, confirmed int")
    assert battle.best_candidates(options, expected.where("key = 1"), ["key"], 3).first()["slot"] == 3


def test_no_templates_no_neighbours(spark):
    from tidemark.operators import templates

    v = spark.createDataFrame([(1, [1.0, 0.0], 3), (2, [0.0, 1.0], 4)], "id long, v array<double>, label int")
    held = templates.prototypes(v, "label", "v")
    assert [n["label"] for n in templates.nearest_templates(v, held, "v", "label", 1).where("id = 2").first()["nearest"]] == [4]
    assert templates.nearest_templates(v, held.where("false"), "v", "label").first()["nearest"] == []
