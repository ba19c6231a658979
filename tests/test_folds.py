"""Folds and timelines against small worked cases and plain restatements."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import battle, choices, decoding, folds, joins, matching, monotone, penalty, picks, records, scans, segments, windows


def reading(value, cost, support=1):
    return {"value": value, "cost": cost, "support": support}


SCHEMA = "key long, t double, candidates array<struct<value: int, cost: double, support: int>>, visible boolean"


def plain_viterbi(seen):
    """All transitions one by one, first of equals."""
    inf = float("inf")
    costs, back = [inf] * 100 + [0.0], []
    for held in seen:
        best = min(held.values(), default=0)
        now, prev = [inf] * 101, [-1] * 101
        for v in range(101):
            e = (max(0, held[v] - best) * 4 + held[v] * 0.08 if v in held else 0.7) if held else 0
            for p in range(v, 101):
                c = costs[p] + (0 if p == v else 0.025 + (p - v) * 0.07 if v in held else inf) + e
                if c < now[v]:
                    now[v], prev[v] = c, p
        costs, back = now, [*back, prev]
    v = costs.index(min(costs))
    out = []
    for prev in reversed(back):
        out.append(v)
        v = v if prev[v] < 0 else prev[v]
    return out[::-1]


def test_decoding_equals_a_plain_viterbi():
    rng = random.Random(4)
    for _ in range(15):
        level, seen = 100, []
        for _ in range(25):
            level = max(0, level - rng.choice([0, 0, 1, 2]))
            held = {} if rng.random() < 0.2 else {level: rng.uniform(0.02, 0.2)}
            if rng.random() < 0.4:
                held[rng.randint(0, 100)] = rng.uniform(0.02, 0.4)
            seen.append(held)
        assert decoding.cheapest_path(monotone.Monotone(), seen)[0].tolist() == plain_viterbi(seen)


def test_counts_run_down_and_bridge_short_gaps(spark):
    values = [100, 100, 98, None, None, 92, 90]
    rows = [(1, i * 0.5, [] if v is None else [reading(v, 0.05)], True) for i, v in enumerate(values)]
    got = monotone.monotone_counts(spark.createDataFrame(rows, SCHEMA), ["key"]).orderBy("t").collect()
    assert [r["value"] for r in got] == [100, 100, 98, 96, 94, 92, 90]
    assert [r["source"] for r in got][2:6] == ["observed", "inferred", "inferred", "observed"]


def long_timeline(n, seed, step=0.5):
    """One key of so many ticks, with gaps in the readings and readings that are wrong."""
    rng, level, rows = random.Random(seed), 100.0, []
    for i in range(n):
        level = max(0.0, level - (rng.random() < 0.3) * 90 / n * 3)
        held = [] if rng.random() < 0.3 else [reading(int(level), rng.choice([0.02, 0.05, 0.1, 0.2]))]
        if rng.random() < 0.2:
            held.append(reading(rng.randint(0, 100), rng.choice([0.02, 0.1, 0.3])))
        rows.append((1, i * step, held, rng.random() < 0.9))
    return rows


@pytest.mark.parametrize(("chunk", "fan"), [(10.0, 3), (37.0, 64), (1.5, 4)])
def test_long_keys_decode_by_chunks_as_they_do_in_one_piece(spark, monkeypatch, chunk, fan):
    monkeypatch.setattr(scans.scan, "__defaults__", (fan,))
    monkeypatch.setattr(scans, "HELD", 1)
    rows = long_timeline(700, 5) + [(2, 3.0, [reading(97, 0.1)], True), (None, 1.0, [reading(99, 0.1)], True), (None, 90.0, [], True)]
    df = spark.createDataFrame(rows, SCHEMA)
    whole = monotone.monotone_counts(df, ["key"], chunk=None)
    parts = monotone.monotone_counts(df, ["key"], chunk=chunk)
    assert sorted(map(str, parts.collect())) == sorted(map(str, whole.collect()))
    assert whole.where("source = 'inferred'").count() > 5


def test_counts_never_rise(spark):
    rows = [(1, float(i), [reading(v, 0.1)], True) for i, v in enumerate([100, 97, 99, 97, 96, 98, 95])]
    got = [r["value"] for r in monotone.monotone_counts(spark.createDataFrame(rows, SCHEMA), ["key"]).orderBy("t").collect()]
    assert got == sorted(got, reverse=True)


def greedy(spark, values, step=0.5, rate=2.25):
    rows = [(1, i * step, [] if v is None else [reading(v, 0.05)], True) for i, v in enumerate(values)]
    return [r["value"] for r in folds.greedy_counts(spark.createDataFrame(rows, SCHEMA), ["key"], rate=rate).orderBy("t").collect()]


def test_greedy_counts_ask_for_what_bears_a_fall_out(spark):
    assert greedy(spark, [100, 100, 99, 98, 97, 97]) == [100, 100, 99, 98, 97, 97]
    assert greedy(spark, [100, 100, 60, 100, 99, 99]) == [100, 100, 100, 100, 99, 99]  # too fast, and it recovers
    assert greedy(spark, [12, 12, 1, 9, 8, 8], rate=None)[-1] <= 12
    assert greedy(spark, [100, 99, None, None, 97, 96]) == [100, 99, 99, 99, 97, 96]


PENALTY = "key long, t double, candidates array<struct<value: int, cost: double, support: int>>, visible boolean, other_visible boolean"


def penalties(spark, values):
    rows = [(1, i * 0.5, [reading(v, 0.05)] if v else [], bool(v), v is not None) for i, v in enumerate(values)]
    return [r["value"] for r in penalty.penalty_counts(spark.createDataFrame(rows, PENALTY), ["key"]).orderBy("t").collect()]


def test_penalties_hold_through_flicker(spark):
    assert penalties(spark, [0, 0, 22, 22, 22, 23, 22, 22, 22, 0, 0, 0])[3:9] == [22] * 6
    assert penalties(spark, [0, 0, 0, 0])[-1] == 0
    assert penalties(spark, [0, 0, 15, 0, 0, 0]) == [0] * 6


def penalty_story(n, seed):
    """A counter that comes, runs down, flickers and goes, with wrong readings and gaps."""
    rng, out, level, rest = random.Random(seed), [], 0, 5
    for i in range(n):
        rest -= 1
        if rest <= 0:
            level, rest = (rng.randint(5, 40), rng.randint(4, 25)) if level == 0 else (0, rng.choice([3, 8, 30, 60]))
        level = max(level - (rng.random() < 0.3), 1) if level else 0
        held = [reading(level, rng.choice([0.02, 0.05, 0.1, 0.2]))] if level and rng.random() < 0.8 else []
        if rng.random() < 0.08:
            held.append(reading(rng.randint(0, 99), rng.choice([0.02, 0.1, 0.3])))
        out.append((1, i * 0.5, held, bool(held), rng.random() < 0.7))
    return out


def test_penalty_costs_by_running_minima_are_those_of_all_moves():
    rng, model = np.random.default_rng(5), penalty.Penalty()
    for kind in ("visible", "absent", "hidden", "occluded"):
        costs = rng.integers(0, 10**12, (30, 100))
        costs[rng.random((30, 100)) < 0.3] = decoding.FAR
        seen = {7: 0.1, 30: 0.02} if kind == "visible" else {}
        dense = np.stack([np.minimum(model.step(row, (seen, kind))[0], decoding.FAR) for row in costs])
        assert (np.minimum(model.least(costs, (seen, kind)), decoding.FAR) == dense).all()


@pytest.mark.parametrize(("chunk", "seed"), [(20.0, 1), (133.0, 2)])
def test_long_penalties_decode_by_chunks_as_they_do_in_one_piece(spark, monkeypatch, chunk, seed):
    monkeypatch.setattr(scans.scan, "__defaults__", (3,))
    monkeypatch.setattr(scans, "HELD", 1)
    df = spark.createDataFrame(penalty_story(900, seed) + [(2, 3.0, [reading(9, 0.1)], True, True)], PENALTY)
    whole = penalty.penalty_counts(df, ["key"], chunk=None)
    parts = penalty.penalty_counts(df, ["key"], chunk=chunk)
    assert sorted(map(str, parts.collect())) == sorted(map(str, whole.collect()))
    assert whole.where("value > 0").count() > 100


def test_flips_between_equal_neighbours_are_smoothed(spark):
    rows = [(1, float(i), v, 0.9) for i, v in enumerate(["a", "b", "a", "a", "c", "d", "a"])]
    got = folds.smooth_flips(spark.createDataFrame(rows, "key long, t double, v string, c double"), ["key"], "t", "v", "c").orderBy("t").collect()
    assert [r["v"] for r in got] == ["a", "a", "a", "a", "c", "d", "a"] and got[1]["c"] == 0.65


def test_greedy_spacing_counts_from_the_last_kept(spark):
    rows = [(1, t) for t in (0.0, 1.0, 2.0, 3.0, 4.0, 9.0)]
    df = spark.createDataFrame(rows, "key long, t double")
    assert sorted(r["t"] for r in picks.greedy_spacing(df, ["key"], ["t"], 2.0).collect()) == [0.0, 2.0, 4.0, 9.0]
    assert sorted(r["t"] for r in picks.greedy_spacing(df, ["key"], ["t"], 2.0, 2).collect()) == [0.0, 2.0]
    # The window version compares with the row before, kept or not.
    assert sorted(r["t"] for r in windows.min_spacing(df, ["key"], ["t"], 2.0).collect()) == [0.0, 9.0]


def plain_picks(times, least, most=None):
    out, last = [], -float("inf")
    for t in sorted(times):
        if t - last >= least and (most is None or len(out) < most):
            out.append(t)
            last = t
    return out


@pytest.mark.parametrize(("least", "most", "chunk"), [(2.0, None, 5.0), (0.3, None, 1.0), (30.0, None, 4.0), (2.0, 17, 3.0), (0.1, None, 50.0)])
def test_long_keys_are_picked_from_by_chunks(spark, monkeypatch, least, most, chunk):
    monkeypatch.setattr(scans.scan, "__defaults__", (3,))
    monkeypatch.setattr(scans, "HELD", 1)
    rng = random.Random(least)
    times = sorted({round(rng.uniform(0, 100) + (40 if rng.random() < 0.2 else 0), 1) for _ in range(400)})
    rows = [(1, t) for t in times] + [(2, 1.0), (None, 1.0), (None, 70.0), (1, None)]
    got = picks.greedy_spacing(spark.createDataFrame(rows, "key long, t double"), ["key"], ["t"], least, most, chunk).collect()
    want = [(1, t) for t in plain_picks(times, least, most)] + [(2, 1.0), *[(None, t) for t in plain_picks([1.0, 70.0], least, most)]]
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))


def test_functions_of_chunks_are_what_picking_gives():
    rng = np.random.default_rng(3)
    for _ in range(300):
        times = np.sort(rng.integers(0, 60, rng.integers(1, 30)) / 10)
        least = rng.integers(1, 30) / 10
        last = times[0] - rng.integers(0, 40) / 10
        first, second = times[: len(times) // 2], times[len(times) // 2 :]
        plain = picks.kept(times, last, 0, least, None)
        both = np.frombuffer(picks.composed(least)(picks.picked_from(first, least).tobytes(), picks.picked_from(second, least).tobytes())).reshape(3, -1)
        end, count = picks.after(both, np.array([last]), np.zeros(1), least)
        assert count[0] == len(plain) and end[0] == (times[plain[-1]] if len(plain) else last)


def test_evidence_is_used_once_nearest_first(spark):
    events = spark.createDataFrame([(1, 20.0, 26.0, 0.7), (1, 40.0, 45.0, 0.8)], "key long, t double, end double, confidence double")
    evidence = spark.createDataFrame([(1, 21.0, 25.0, 0.9), (1, 25.0, 27.0, 0.6), (1, 80.0, 84.0, 0.75), (2, 5.0, 9.0, 0.5)], "key long, t double, end double, confidence double")
    got = [tuple(r) for r in matching.match_evidence(events, evidence, ["key"]).orderBy("key", "nth").collect()]
    assert got == [
        (1, 1, 18.5, 26.0, 0.9, 21.0, "evidence"),
        (1, 2, 22.5, 27.0, 0.6, 25.0, "evidence"),
        (1, 3, 40.0, 45.0, 0.8, None, "event"),
        (1, 4, 77.5, 84.0, 0.75, 80.0, "evidence"),
        (2, 1, 2.5, 9.0, 0.5, 5.0, "evidence"),
    ]


def plain_matching(events, readings):
    """Each event looks at all readings, in order of time."""
    free, out = sorted(readings), []
    for t, end, sure in sorted(events):
        near = [(abs(r[0] - t), i) for i, r in enumerate(free) if r and t - 10 <= r[0] <= end + 7]
        if not near:
            out.append((t, end, sure, None, "event"))
            continue
        i = min(near)[1]
        seen, free[i] = free[i], None
        start = min(t, round(max(0.0, seen[0] - 2.5), 2))
        out.append((start, end, max(sure, seen[2]), seen[0], "evidence" if start < t else "event"))
    return sorted(map(str, out + [(round(max(0.0, r[0] - 2.5), 2), r[1], r[2], r[0], "evidence") for r in free if r]))


@pytest.mark.parametrize("chunk", [None, 15.0, 1000.0])
def test_matching_equals_looking_at_all_readings(spark, chunk):
    rng = random.Random(7)
    for span in (60, 600, 5000):
        draw = lambda n, sure: [(float(rng.randint(0, span * 2)) / 2, 0.0, sure) for _ in range(n)]  # noqa: E731, B023
        events = [(t, t + rng.randint(0, 12), c) for t, _, c in draw(60, 0.7)]
        readings = [(t, t + 3.0, c) for t, _, c in draw(70, 0.8)]
        schema = "key long, t double, end double, confidence double"
        df = lambda rows: spark.createDataFrame([(k, *r) for k in (1, None) for r in rows], schema)  # noqa: E731, B023
        got = matching.match_evidence(df(events), df(readings), ["key"], chunk).collect()
        for key in (1, None):
            own = [r for r in got if r["key"] == key]
            assert sorted(str((r["t"], r["end"], r["confidence"], r["evidence_t"], r["source"])) for r in own) == plain_matching(events, readings)
            assert [r["t"] for r in sorted(own, key=lambda r: r["nth"])] == sorted(r["t"] for r in own)


def test_clusters_tracks_chains_and_peaks(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 1.0), (1, 1.0, 5.0, 0.0, 3.0), (1, 2.0, 100.0, 0.0, 2.0), (1, 3.0, 7.0, 1.0, 2.5)], "key long, t double, x double, y double, score double")
    assert [r["cluster"] for r in folds.cluster_points(points, ["key"], ["t"], 18.0).orderBy("t").collect()] == [1, 1, 2, 1]
    assert [r["track"] for r in folds.track_objects(points, ["key"], "t", 50.0).orderBy("t").collect()] == [1, 1, 2, 1]
    assert tuple(folds.longest_chain(points, ["key"], "t", 10.0, 2.5).first()) == (1, 3, 0.0, 3.0)
    assert sorted(r["score"] for r in folds.suppress_peaks(points, ["key"], 32.0, 6).collect()) == [2.0, 3.0]


def test_long_intervals_stand_in_two_buckets(spark):
    rng = random.Random(2)
    spans = lambda n: [(1, i, float(s), float(s + rng.choice([0, 1, 5, 40, 300, 5000]))) for i in range(n) for s in [rng.randint(0, 6000)]]
    left, right = spans(120) + [(1, 900, 0.0, 1e9)], spans(120) + [(1, 901, -1e8, 7000.0)]
    df = lambda rows: spark.createDataFrame(rows, "key long, id long, start double, end double")
    got = sorted((r["id"], r["right_id"], r["shared"]) for r in joins.interval_overlap(df(left), df(right), ["key"], 2.0).collect())
    want = sorted((a[1], b[1], min(a[3], b[3]) - max(a[2], b[2])) for a in left for b in right if a[3] > b[2] and a[2] < b[3])
    assert got == want
    s, e = F.col("start"), F.col("end")
    stood = joins._at_levels(df(left), s, e, 2.0, F.array(joins._level(s, e, 2.0))).groupBy("id").count()
    assert stood.agg(F.max("count")).first()[0] <= 2
    points = spark.createDataFrame([(1, float(t)) for t in range(0, 9000, 37)], "key long, t double")
    held = sorted((r["t"], r["id"]) for r in joins.within_intervals(points, df(left), ["key"], "t", 2.0).collect())
    assert held == sorted((float(t), a[1]) for t in range(0, 9000, 37) for a in left if a[2] <= t <= a[3])
    assert joins.interval_overlap(df(left).limit(0), df(right), ["key"], 2.0).count() == joins.within_intervals(points, df(left).limit(0), ["key"], "t", 2.0).count() == 0


def sample(t, down=0.05, up=0.05, gray=0.1, saturated=0.5):
    return (1, t, down, up, gray, saturated)


def test_self_deaths_from_crosses(spark):
    rows = [sample(i * 0.25, 0.4, 0.35, 0.4, 0.1) if 20 <= i * 0.25 <= 25 else sample(i * 0.25) for i in range(200)]
    df = spark.createDataFrame(rows, "key long, t double, diagonal_down double, diagonal_up double, gray_ratio double, saturated_ratio double")
    got = battle.self_deaths(df, ["key"], 10.0, 49.0).collect()
    assert len(got) == 1 and (got[0]["t"], got[0]["end"]) == (20.0, 25.25)
    assert got[0]["confidence"] == pytest.approx(0.62 + 0.35 * 0.75)


def test_player_counts_hold_and_describe(spark):
    icon = "struct<saturated_ratio: double, gray_ratio: double, diagonal_down: double, diagonal_up: double, cross_neutral_ratio: double, cross_down: double, cross_up: double>"
    up, down = (0.5, 0.1, 0.0, 0.0, None, None, None), (0.1, 0.4, 0.35, 0.2, None, None, None)
    timer = (0.3, 0.05, 0.05)
    rows = [(1, s + q * 0.25, timer, [up, up, up, down if s >= 12 else up], [up] * 4) for s in (10, 11, 12, 14) for q in range(4)]
    df = spark.createDataFrame(rows, f"key long, t double, timer struct<dark_ratio: double, white_ratio: double, edge_ratio: double>, team array<{icon}>, enemy array<{icon}>")
    counts = battle.player_counts(df, ["key"])
    got = {r["t"]: (r["team_alive"], r["enemy_alive"], r["source"]) for r in counts.collect()}
    assert got[10.5] == (4, 4, "observed") and got[12.5] == (3, 4, "observed") and got[13.5] == (3, 4, "held") and got[19.5] == (3, 4, "held") and 20.5 not in got
    told = battle.describe(spark.createDataFrame([(1, 13.0), (1, 40.0)], "key long, t double"), counts, ["key"]).orderBy("t").collect()
    assert told[0]["situation"] == "デス直前は自軍3人・相手4人（1枚不利）。" and "判定できません" in told[1]["situation"]
    assert battle.gameplay_start(df, ["key"], 10.0, 30.0).first()["first"] == 10.0


def test_two_matches_are_cut_at_their_cards(spark):
    rows = []
    for i in range(300):
        t = i * 2.0
        card = t in (20.0, 22.0, 320.0)
        active = 30 <= t <= 250 or 335 <= t <= 560
        rows.append((1, t, 60.0, 0.3, 10.0 if active else 1.0, 0.03 if active else 0.0, 0.06, 0.25 if card else 0.9, 0.05, 0.12))
    df = spark.createDataFrame(rows, "key long, time double, brightness double, saturation double, difference double, hud_white_ratio double, hud_edge_ratio double, center_dark_ratio double, center_white_ratio double, center_edge_ratio double")
    classified = segments.classify(df, "key")
    starts = sorted(r["start"] for r in segments.intro_starts(classified, "key", 2.0).collect())
    assert starts == [20.0, 320.0]
    durations = spark.createDataFrame([(1, 600.0)], "key long, duration double")
    got = segments.segments(classified, durations, "key", 2.0).orderBy("start").collect()
    assert [(r["start"], r["detection"]) for r in got] == [(20.0, "rule-intro"), (320.0, "rule-intro")]
    assert got[0]["end"] == 317.0 and got[1]["end"] == 600.0
    bare = segments.segments(classified.withColumn("rule_intro", F.lit(False)), durations, "key", 2.0).orderBy("start").collect()
    assert [r["detection"] for r in bare] == ["activity", "activity"] and bare[0]["end"] <= bare[1]["start"]


def test_chunked_windows_equal_plain_ones(spark):
    rng = random.Random(9)
    rows = [(rng.randint(1, 3), rng.uniform(0, 1000), i, rng.choice([None, rng.random()])) for i in range(400)]
    df = spark.createDataFrame(rows, "key long, t double, id long, v double")
    from pyspark.sql import Window

    from tidemark.operators import chunks

    w = Window.partitionBy("key").orderBy("t", "id")
    plain = {r["id"]: r for r in df.select("id", F.lag("id").over(w).alias("b"), F.lead("id").over(w).alias("a"), F.round(F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)), 6).alias("s"), F.last("v", True).over(w).alias("l")).collect()}
    for size in (7.0, 90.0, None):
        out = chunks.neighbours(df, ["key"], ["t", "id"], ["id"], size, before="b", after="a")
        out = chunks.running_sum(out, ["key"], ["t", "id"], F.coalesce("v", F.lit(0.0)), "s", size)
        out = chunks.last_known(out, ["key"], ["t", "id"], F.col("v"), size, before="l")
        for r in out.collect():
            p = plain[r["id"]]
            assert (r["b"]["id"] if r["b"] else None) == p["b"] and (r["a"]["id"] if r["a"] else None) == p["a"]
            assert r["l"] == p["l"] and r["s"] == pytest.approx(p["s"] or 0.0, abs=1e-5)
    runs = [sorted((r["id"], r["n"]) for r in chunks.run_numbers(df, ["key"], ["t", "id"], ["t"], lambda b, n: b.isNull() | (n["t"] - b["t"] > 9.0), "n", size).collect()) for size in (7.0, 90.0, None)]
    assert runs[0] == runs[1] == runs[2]


def test_framed_windows_equal_plain_ones(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(rng.randint(1, 2), rng.uniform(0, 100), i, rng.random() < 0.5) for i in range(300)], "key long, t double, id long, f boolean")
    from pyspark.sql import Window

    from tidemark.operators import chunks

    w = Window.partitionBy("key").orderBy("t", "id")
    cols = lambda w: {"n": F.sum(F.col("f").cast("int")).over(w.rowsBetween(-3, 5)), "b": F.sum(F.col("f").cast("int")).over(w.rowsBetween(2, 7))}
    want = sorted(map(str, df.withColumns(cols(w)).collect()))
    for block in (8, 50, 1000):
        assert sorted(map(str, chunks.framed(df, ["key"], ["t", "id"], 3, 7, cols, 10.0, block).select("key", "t", "id", "f", "n", "b").collect())) == want


def test_interpolated_angles_take_the_shorter_arc(spark):
    got = spark.range(1).select(windows.angle_between(F.lit(350.0), F.lit(20.0), F.lit(0.5)).alias("a"), windows.angle_between(F.lit(20.0), F.lit(350.0), F.lit(0.5)).alias("b")).first()
    assert (got["a"], got["b"]) == (5.0, 5.0)


def test_votes_and_records(spark):
    votes = spark.createDataFrame([(1, "win", 0.8), (1, "win", 0.9), (1, "win", 0.7), (1, "lose", 0.9), (2, "win", 0.9), (2, "lose", 0.9)], "key long, v string, c double")
    got = choices.vote_margin(votes, ["key"], "v", "c").collect()
    assert [(r["key"], r["v"], r["votes"], r["runner_up"]) for r in got] == [(1, "win", 3, 1)] and got[0]["confidence"] == pytest.approx(0.815)
    spans = spark.createDataFrame([(0.0, 5.0), (-1.0, 5.0), (5.0, 5.0), (None, 1.0), (1.0, float("inf"))], "start double, end double")
    assert records.valid_spans(spans).count() == 1
    log = spark.createDataFrame([(1, "death_count", "120.4", 1), (1, "stage", "x", 1), (1, "stage", " ", 2), (2, "rule", "r", 1)], "id long, field string, value string, seq long")
    assert {r["id"]: r["overrides"] for r in records.write_overrides(log).collect()} == {1: {"death_count": "99"}, 2: {"rule": "r"}}


def test_range_joins_equal_nested_loops(spark):
    rng = np.random.default_rng(1)
    a = [(int(k), float(t), i) for i, (k, t) in enumerate(zip(rng.integers(0, 3, 80), rng.uniform(0, 50, 80), strict=True))]
    b = [(int(k), float(t), i) for i, (k, t) in enumerate(zip(rng.integers(0, 3, 80), rng.uniform(0, 50, 80), strict=True))]
    left, right = (spark.createDataFrame(x, "key long, t double, id long") for x in (a, b))
    want = sorted((i, j) for k, t, i in a for q, u, j in b if k == q and t - 2.0 <= u <= t + 0.5)
    assert sorted((r["id"], r["right_id"]) for r in joins.range_join(left, right, ["key"], "t", "t", 2.0, 0.5).collect()) == want
    assert sorted(r["id"] for r in joins.range_join(left, right, ["key"], "t", "t", 2.0, 0.5, "left_anti").collect()) == sorted({i for _, _, i in a} - {i for i, _ in want})


def many_keys(seed, ties=False):
    """Rows of 400 keys, most of one row, and where the keys start."""
    rng = random.Random(seed)
    sizes = [rng.choice([1, 1, 1, 1, 2, 3, 9]) for _ in range(400)]
    rows = [(k, float(rng.randint(0, 12)), float(rng.randint(0, 60)), float(rng.randint(0, 60)), rng.random()) for k, n in enumerate(sizes) for _ in range(n)]
    frame = pd.DataFrame(rows, columns=["key", "t", "x", "y", "score"])
    return frame, np.concatenate([[0], np.cumsum(sizes)])


def sorts_of(monkeypatch):
    """Counts the frames that are sorted: one for all keys, not one for each."""
    calls, real = [], pd.DataFrame.sort_values
    monkeypatch.setattr(pd.DataFrame, "sort_values", lambda self, *a, **k: calls.append(1) or real(self, *a, **k))
    return calls


def test_peaks_of_many_keys_at_once(monkeypatch):
    frame, starts = many_keys(1)
    calls = sorts_of(monkeypatch)
    got = folds.peaks_of(frame, starts, 32.0, 2)
    assert len(calls) == 1
    want = []
    for _, own in frame.groupby("key"):
        kept = []
        for r in sorted(own.itertuples(index=False), key=lambda r: (-r.score, r.x, r.y)):
            if len(kept) < 2 and all(np.hypot(r.x - k.x, r.y - k.y) > 32.0 for k in kept):
                kept.append(r)
        want += [tuple(k) for k in kept]
    assert list(got.itertuples(index=False, name=None)) == want


def test_tracks_of_many_keys_at_once(monkeypatch):
    frame, starts = many_keys(2)
    calls = sorts_of(monkeypatch)
    got = folds.tracks_of(frame, starts, "t", 25.0, 2)
    assert len(calls) == 1
    want = []
    for _, own in frame.groupby("key"):
        last = []
        for t in sorted(set(own.t)):
            free = list(range(len(last)))
            for r in sorted(own[own.t == t].itertuples(index=False), key=lambda r: (r.x, r.y))[:2]:
                near = min(((np.hypot(last[k][0] - r.x, last[k][1] - r.y), k) for k in [*free, *range(len(last))] if k in free), default=(np.inf, -1))
                # A track that was opened at this time isn't free.
                k = near[1] if near[0] <= 25.0 else len(last)
                last[k:k + 1] = [(r.x, r.y)]
                free = [f for f in free if f != k]
                want.append((*r, k + 1))
    assert list(got.itertuples(index=False, name=None)) == want
    empty = frame.assign(t=np.where(frame["key"] % 2 == 0, np.nan, frame["t"]))
    assert set(folds.tracks_of(empty, starts, "t", 25.0, 2)["key"]) == {k for k in range(400) if k % 2}


def test_chains_of_many_keys_at_once(monkeypatch):
    frame, starts = many_keys(3)
    calls = sorts_of(monkeypatch)
    got = folds.chains_of(frame, starts, ["key"], "t", 30.0, 4.0)
    assert len(calls) == 1
    want = []
    for key, own in frame.groupby("key"):
        rows, size = sorted(own.itertuples(index=False), key=lambda r: (r.t, r.x, r.y)), []
        for i, r in enumerate(rows):
            before = [(size[j][0], -j) for j in range(i) if r.t - 4.0 <= rows[j].t < r.t and np.hypot(rows[j].x - r.x, rows[j].y - r.y) <= 30.0]
            size.append((1, r.t) if not before else (max(before)[0] + 1, size[-max(before)[1]][1]))
        best = max(range(len(rows)), key=lambda i: (size[i][0], -i))
        want.append((key, size[best][0], size[best][1], rows[best].t))
    assert list(got.itertuples(index=False, name=None)) == want


def test_clusters_of_many_keys_at_once(monkeypatch):
    frame, starts = many_keys(4)
    calls = sorts_of(monkeypatch)
    got = folds.clusters_of(frame, starts, ["t", "score"], 18.0)
    assert len(calls) == 1
    want = []
    for _, own in frame.groupby("key"):
        means = []
        for r in sorted(own.itertuples(index=False), key=lambda r: (r.t, r.score)):
            near = min(((np.hypot(m[0] - r.x, m[1] - r.y), k) for k, m in enumerate(means)), default=(np.inf, -1))
            k = near[1] if near[0] <= 18.0 else len(means)
            if k == len(means):
                means.append([r.x, r.y, 1.0])
            else:
                m = means[k]
                m[2] += 1
                m[0], m[1] = m[0] + (r.x - m[0]) / m[2], m[1] + (r.y - m[1]) / m[2]
            want.append((*r, k + 1))
    assert list(got.itertuples(index=False, name=None)) == want


@pytest.mark.parametrize("most", [None, 0, 2])
def test_picks_of_many_keys_at_once(monkeypatch, most):
    frame, starts = many_keys(5)
    # One key of more than FEW rows, and rows without a time.
    more = pd.DataFrame({"key": 400, "t": np.arange(200.0), "x": 0.0, "y": 0.0, "score": 0.0})
    frame = pd.concat([frame, more], ignore_index=True).sort_values(["key", "t"], kind="stable", ignore_index=True)
    starts = np.append(starts, len(frame))
    frame.loc[::7, "t"] = np.nan
    frame["nth"] = np.arange(len(frame))
    made = []
    real = picks.kept
    monkeypatch.setattr(picks, "kept", lambda *a: made.append(1) or real(*a))
    got = picks.picked_of(frame, starts, "t", 3.0, most)
    assert len(made) == 1
    want = []
    for _, own in frame.groupby("key"):
        last, count = None, 0
        for r in own.itertuples():
            if r.t == r.t and (last is None or r.t - last >= 3.0) and (most is None or count < most):
                last, count = r.t, count + 1
                want.append(r.nth)
    assert got["nth"].tolist() == want


def test_flips_of_many_keys_at_once():
    rng = random.Random(6)
    frame, starts = many_keys(6)
    frame = frame.assign(v=[rng.choice("ab") for _ in range(len(frame))], _next=[rng.choice("ab") for _ in range(len(frame))])
    got = folds.flips_of(frame, starts, "v", "score", 0.5)
    want = []
    for _, own in frame.groupby("key"):
        before = None
        for r in own.itertuples(index=False):
            changes = before is not None and before == r[-1]
            before = before if changes else r.v
            want.append((before, min(r.score, 0.5) if changes else r.score))
    assert list(got[["v", "score"]].itertuples(index=False, name=None)) == want
    assert folds.flips_of(frame.drop_duplicates("key"), np.arange(401), "v", "score", 0.5)["v"].tolist() == frame.drop_duplicates("key")["v"].tolist()


def test_penalty_decoding_of_many_keys_at_once(monkeypatch):
    rng = random.Random(7)
    sizes = [rng.choice([1, 1, 1, 2, 3, 5, 30]) for _ in range(300)]
    starts, decoder = np.concatenate([[0], np.cumsum(sizes)]), penalty.Penalty()
    n, level = int(starts[-1]), 0
    times, candidates, visible, other = np.arange(n) * 0.5, np.empty(n, object), np.empty(n, object), np.empty(n, object)
    for i in range(n):
        level = rng.randint(0, 99) if level <= 0 or rng.random() < 0.1 else level - rng.choice([0, 1])
        candidates[i] = None if rng.random() < 0.05 else [reading(v, rng.uniform(0.0, 0.3)) for v in [level, rng.randint(0, 99)][: rng.randint(0, 2)]]
        visible[i], other[i] = rng.choice([True, True, False, None]), rng.choice([True, False, None])
    want = []
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        ticks = list(zip(penalty._readings(candidates[a:b]), penalty.kinds_of(penalty._seen(candidates[a:b], visible[a:b]), penalty._flag(other[a:b])), strict=True))
        # Steps over all moves, the first tick's included.
        costs, back = decoding.unreached(100, 0)[0], []
        for seen, kind in ticks:
            total = costs[None, :] + decoder.moves[kind] + decoder.emission(seen, kind)[:, None]
            costs = np.minimum(total.min(axis=1), decoding.FAR)
            back.append(total.argmin(axis=1))
        path, before = decoding.followed(np.array(back), int(costs.argmin()))
        want += list(zip(*(x.tolist() for x in penalty._told(path, before, times[a:b], candidates[a:b], visible[a:b], other[a:b])), strict=True))
    paths, real = [], penalty.cheapest_path
    monkeypatch.setattr(penalty, "cheapest_path", lambda *a: paths.append(1) or real(*a))
    got = list(zip(*(x.tolist() for x in penalty.told_many(starts, times, candidates, visible, other, decoder)), strict=True))
    assert got == want and any(v for v, _, _ in got)
    # A path is looked for only where a tick is visible; lone ticks never are.
    assert 0 < len(paths) <= sum(s > 1 for s in sizes)


def test_fixed_points_stand_in_one_cell(spark):
    rng = random.Random(8)
    draw = lambda n: [(rng.choice([1, 2, None]), i, rng.choice([float(rng.randint(-90, 90))] * 9 + [None, float("nan")]), float(rng.randint(-90, 90))) for i in range(n)]
    rows, fixed = draw(300) * 2, draw(120)
    df = lambda r: spark.createDataFrame(r, "key long, id long, x double, y double")
    got = joins.spatial_anti(df(rows), df(fixed), ["key"], 10.0)
    near = lambda a, b: a[0] is not None and a[0] == b[0] and a[2] is not None and b[2] is not None and np.hypot(a[2] - b[2], a[3] - b[3]) <= 10.0
    assert sorted(r["id"] for r in got.collect()) == sorted(a[1] for a in rows if not any(near(a, b) for b in fixed))
    # The rows' places are spread over cells, not the fixed points.
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("explode") == 2 and plan.index("LeftSemi") < plan.index("explode")
