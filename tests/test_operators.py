"""Operators on small frames with known results."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.operators import audits, containment, joins, mersenne, metrics, ordered, resample, splits


def states(spark, rows):
    return spark.createDataFrame(rows, "model string, question_id long, state_index long, score double, em int, f1 double, truth int, position long")


def test_running_totals_against_loops(spark, monkeypatch):
    monkeypatch.setattr(metrics, "POSITIONS", 7)
    rng = random.Random(5)
    odd = [float("inf"), float("-inf"), 0.0, 1e-12, -40.0, 1e9, 0.25, 0.25]
    rows = [(m, rng.choice(odd) if rng.random() < 0.6 else rng.uniform(-3, 3), rng.randrange(2), k) for k in range(400) for m in ("a", "b")]
    rows += [("none", 0.5, 0, 1), ("none", 0.5, 0, 2)]
    s = spark.createDataFrame(rows, "model string, score double, truth int, position long").repartition(5)
    got = {(r.model, r.score): (r.stops, r.tp, r.positives) for r in metrics.cumulative(s).collect()}
    for (model, score), found in got.items():
        mine = [r for r in rows if r[0] == model]
        over = [r for r in mine if r[1] >= score]
        assert found == (len(over), sum(r[2] for r in over), sum(r[2] for r in mine))
    assert len(got) == len({r[:2] for r in rows})
    ordered = {r.model: r.average_precision for r in metrics.average_precision_ordered(s).collect()}
    for model in ("a", "b", "none"):
        ranked = sorted((r for r in rows if r[0] == model), key=lambda r: (-r[1], r[3]))
        hits, at = 0, []
        for k, r in enumerate(ranked, 1):
            hits += r[2]
            if r[2]:
                at.append(hits / k)
        assert ordered[model] == pytest.approx(sum(at) / len(at) if at else 0.0)
    assert metrics.cumulative(s.limit(0)).count() == 0
    strange = spark.createDataFrame([("a", float("nan"), 1), ("a", 2.0, 0), ("a", None, 1)], "model string, score double, truth int")
    assert sorted((r.stops, r.tp) for r in metrics.cumulative(strange).collect()) == [(1, 1), (2, 1), (3, 2)]


def test_average_precisions(spark):
    s = states(spark, [("m", 1, 0, 0.9, 1, 1.0, 1, 0), ("m", 1, 1, 0.8, 0, 0.0, 0, 1), ("m", 2, 0, 0.7, 1, 1.0, 1, 2)])
    assert metrics.average_precision_ordered(s).first()["average_precision"] == pytest.approx((1 + 2 / 3) / 2)
    assert metrics.average_precision_tied(s).first()["average_precision"] == pytest.approx((1 + 2 / 3) / 2)
    tied = s.withColumn("score", F.lit(0.5))
    assert metrics.average_precision_tied(tied).first()["average_precision"] == pytest.approx(2 / 3)


def test_recall_and_threshold(spark):
    rows = [("m", i, 0, s, t, 0.0, t, i) for i, (s, t) in enumerate([(0.9, 1), (0.8, 1), (0.7, 0), (0.6, 1)])]
    got = metrics.recall_at_precision(states(spark, rows), 0.9).first()
    assert (got["recall"], got["threshold"]) == (pytest.approx(2 / 3), 0.8)
    chosen = metrics.select_threshold(states(spark, rows), 0.9, 2).first()
    assert (chosen["feasible"], chosen["threshold"]) == (True, 0.8)
    never = metrics.select_threshold(states(spark, rows), 0.9, 4).first()
    assert (never["feasible"], never["threshold"], never["stops"]) == (False, 1.9, 0)


def test_bin_edges(spark):
    p = spark.createDataFrame([(0.8999999999999999,), (0.9,), (1.0,), (0.0,)], "p double").select(metrics.bin_of(F.col("p")).alias("b"))
    assert [r.b for r in p.collect()] == [8, 9, 9, 0]


def test_first_crossing(spark):
    s = states(spark, [("m", 1, 0, 0.1, 0, 0.0, 0, 0), ("m", 1, 1, 0.9, 1, 1.0, 1, 1), ("m", 1, 2, 0.95, 0, 0.0, 0, 2), ("m", 2, 0, 0.2, 1, 1.0, 1, 3)])
    natives = spark.createDataFrame([(1, 0, 0.0, 3), (2, 0, 0.5, 2), (3, 1, 1.0, 0)], "question_id long, native_em int, native_f1 double, native_searches long")
    th = spark.createDataFrame([("m", 0.8)], "model string, threshold double")
    got = {r.question_id: (r.stopped_early, r.stop_index, r.em, r.searches) for r in ordered.first_crossing(s, natives, th).collect()}
    assert got == {1: (True, 1, 1, 1), 2: (False, None, 0, 2), 3: (False, None, 1, 0)}  # 3 has no states


def test_causal_labels(spark):
    s = spark.createDataFrame([(1, 0, "SEARCH", 0), (1, 1, "SEARCH", 1), (1, 2, "SEARCH", 0), (2, 0, "SEARCH", 0), (3, 0, "SEARCH", 0), (3, 1, "ANSWER", 1)], "question_id long, state_index long, next_action string, em int")
    got = sorted((r.question_id, r.state_index, r.label) for r in ordered.causal_labels(s).collect())
    assert got == [(1, 0, "CONTINUE"), (1, 1, "STOP"), (1, 2, "NO_REACHABLE_CORRECT"), (2, 0, "NO_REACHABLE_CORRECT"), (3, 0, "CONTINUE")]


def test_expand_states(spark):
    steps = spark.createDataFrame([(1, i, "SEARCH", i != 1, f"b{i}") for i in range(6)] + [(2, 0, "ANSWER", False, "x")], "question_id long, step long, action string, executed boolean, block string")
    got = sorted((r.question_id, r.state_index, r.native_next_action, r.context) for r in ordered.expand_states(steps).collect())
    assert [g[:3] for g in got] == [(1, 0, "SEARCH"), (1, 1, "SEARCH"), (1, 2, "SEARCH"), (1, 3, "SEARCH"), (2, 0, "ANSWER")]
    assert got[2][3] == "b0\n\nb2"


def test_ordinal_is_contiguous(spark):
    got = ordered.ordinal(spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x")), "x").collect()
    assert sorted((r.x, r.sequence_index) for r in got) == [(i, i) for i in range(1000)]


def test_splits(spark):
    rows = spark.createDataFrame([(str(i), f"q{i % 40}", i) for i in range(60)], "original_id string, normalized_question string, source_index long")
    got = splits.disjoint_splits(rows, [("a", "s1", 10), ("b", "s2", 10)]).collect()
    a, b = ({(r.original_id, r.normalized_question) for r in got if r.split == s} for s in "ab")
    assert len(a) == len(b) == 10
    assert not {x for x, _ in a} & {x for x, _ in b} and not {x for _, x in a} & {x for _, x in b}
    copies = splits.oversampled(spark.createDataFrame([(0, i) for i in range(7)] + [(1, i) for i in range(3)], "y int, i long"), "y", "i").groupBy("y").agg(F.sum("copies").alias("n")).collect()
    assert {r.n for r in copies} == {7}
    with pytest.raises(ValueError, match="remain"):
        splits.hash_rank_split(rows, "s1", 61, must_fill=True)
    with pytest.raises(Exception, match="repeat"):
        splits.core_reserve(spark.createDataFrame([(1, "a"), (1, "b")], "question_id int, data_source string"), "s", 1).collect()


@pytest.mark.parametrize("labels", [[True] * 7 + [False] * 3, [False, True, False, False, False, True]])
def test_epoch_order(labels):
    """Against the rule spelt out: false ones first, whole cycles shuffled, cut, joined, shuffled."""
    rng = random.Random("7:epoch:2")
    want, most = [], max(labels.count(True), labels.count(False))
    for c in (False, True):
        drawn = []
        while len(drawn) < most:
            members = [i for i, y in enumerate(labels) if y == c]
            rng.shuffle(members)
            drawn.extend(members)
        want += drawn[:most]
    rng.shuffle(want)
    assert splits.epoch_order(labels, 7, 2) == want
    with pytest.raises(ValueError):
        splits.epoch_order([True], 7, 2)


def test_exact_bootstrap_replays_the_generator():
    for n in (1, 2, 150, 512):
        rng, picks = random.Random(5), resample.Picks(n, 5)
        assert picks.take(n).tolist() + picks.take(2 * n).tolist() == [rng.randrange(n) for _ in range(3 * n)]
    deltas = [0.0, 1.0, 1.0, -1.0, 0.5]
    rng = random.Random(9)
    means = sorted(sum(deltas[rng.randrange(5)] for _ in deltas) / 5 for _ in range(400))
    got = resample.exact_bootstrap(np.array(deltas), 400, 9)
    assert got == pytest.approx((0.3, means[10], means[390]))


def test_exact_three_and_ap():
    rows = [(1, 2, 4), (0, 0, 0), (0, 1, 3), (1, 0, 2)]
    rng, drawn = random.Random(3), []
    for _ in range(300):
        s = [rows[rng.randrange(4)] for _ in range(4)]
        q, a, n = (sum(x[i] for x in s) for i in range(3))
        drawn.append((q / 4, a / n if n else 0.0, a / 4))
    got = resample.exact_three(np.array(rows, float), 300, 3)
    for k, (name, estimate, low, high) in enumerate(got):
        v = sorted(x[k] for x in drawn)
        assert (low, high) == pytest.approx((v[int(0.025 * 299)], v[int(0.975 * 299)])), name
    assert [g[1] for g in got] == pytest.approx([0.5, 3 / 9, 0.75])
    # average precision of resampled questions, spelt out
    question, truth = np.array([0, 0, 1, 2, 2]), np.array([1, 0, 0, 1, 1])
    a, b = np.array([0.9, 0.9, 0.5, 0.2, 0.1]), np.array([0.8, 0.1, 0.2, 0.9, 0.7])

    def precision(score, times):
        states = [(s, y) for s, y, q in zip(score, truth, question) for _ in range(times[q])]
        positives, total = sum(y for _, y in states), 0.0
        for level in {s for s, _ in states}:
            stops = [y for s, y in states if s >= level]
            total += sum(y for s, y in states if s == level) / positives * sum(stops) / len(stops) if positives else 0
        return total

    rng, gains = random.Random(4), []
    for _ in range(200):
        times = np.bincount([rng.randrange(3) for _ in range(3)], minlength=3)
        gains.append(precision(b, times) - precision(a, times))
    gains.sort()
    got = resample.exact_ap_difference(question, (a, truth), (b, truth), 200, 4)
    assert got == pytest.approx((precision(b, [1, 1, 1]) - precision(a, [1, 1, 1]), gains[5], gains[195]))


def test_resampled_sums(spark):
    values = [0.0] * 70 + [1.0] * 30
    df = spark.createDataFrame([(i, "m", v) for i, v in enumerate(values)], "question_id long, metric string, delta double")
    got = resample.paired_bootstrap(df, 4000, 1).first()
    _, low, high = resample.exact_bootstrap(np.array(values), 4000, 1)
    assert got.estimate == 0.3 and got.low == pytest.approx(low, abs=0.021) and got.high == pytest.approx(high, abs=0.021)
    sums = resample.resampled_sums(df, ["delta"], 1200, 1, "metric").toPandas()
    assert sorted(sums["replicate"]) == list(range(1200)) and set(sums["n"]) == {100}
    assert sums["delta"].mean() == pytest.approx(30, abs=0.6) and sums["delta"].std() == pytest.approx(21**0.5, abs=0.4)
    assert sums.sort_values("replicate")["delta"].tolist() == resample.resampled_sums(df.repartition(7), ["delta"], 1200, 1, "metric").orderBy("replicate").toPandas()["delta"].tolist()
    with pytest.raises(Exception, match="null value"):
        resample.paired_bootstrap(df.withColumn("delta", F.lit(None).cast("double")), 10, 1).collect()


def test_a_stream_is_entered_anywhere():
    raw = mersenne.Picks(1000, 77).bits.random_raw(1_300_000)
    for start in (1, 623, 624, 625, 100_003, 1_299_000):
        assert (mersenne.Picks(1000, 77, start).bits.random_raw(900) == raw[start : start + 900]).all()
    assert mersenne.characteristic().bit_length() == 19938


def test_exact_bootstraps_are_the_same_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(resample, "RAW_BLOCK", 1500)
    rng = random.Random(1)
    rows = [(g, i, rng.choice([-1.0, 0.0, 1.0]), float(rng.randrange(-3, 4))) for g, n in (("a", 37), ("b", 64), ("c", 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "comparison string, question_id long, em double, searches double").repartition(5)
    seeds = {(g, m): 7 + k for k, (g, m) in enumerate((g, m) for g in "abcx" for m in ("em", "searches"))}
    assert len(resample.places(spark, [(37, 7), (64, 8)], 400)) > 20
    got = {(r.comparison, r.metric): (r.estimate, r.low, r.high) for r in resample.exact_paired(df, seeds, replicates=400).collect()}
    assert len(got) == 6
    for (g, m), (estimate, low, high) in got.items():
        values, own = [r[2 if m == "em" else 3] for r in rows if r[0] == g], random.Random(seeds[g, m])
        means = sorted(sum(values[own.randrange(len(values))] for _ in values) / len(values) for _ in range(400))
        assert (estimate, low, high) == (pytest.approx(sum(values) / len(values)), means[10], means[390])
    monkeypatch.setattr(resample, "EXACT_QUESTIONS", 50)
    with pytest.raises(ValueError, match="the exact mode takes"):
        resample.exact_paired(df, seeds)


def test_exact_three_and_precision_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(resample, "RAW_BLOCK", 700)
    rng = random.Random(2)
    rows = [(i, rng.randrange(2), rng.randrange(3), rng.randrange(4)) for i in range(41)]
    df = spark.createDataFrame(rows, "question_id long, quality int, avoidable int, native int").repartition(4)
    want = {k: v for k, *v in resample.exact_three(np.array(rows, float)[:, 1:], 300, 5)}
    got = {r.metric: [r.estimate, r.low, r.high] for r in resample.exact_three_intervals(df, 300, 5).collect()}
    assert got == want
    states = [(q, k, rng.randrange(2), rng.randrange(6) / 4, rng.randrange(6) / 4) for q in range(29) for k in range(rng.randint(1, 4))]
    df = spark.createDataFrame(states, "question_id long, state_index long, truth int, a double, b double").repartition(4)
    v = np.array(states, float)
    want = resample.exact_ap_difference(v[:, 0].astype(int), (v[:, 4], v[:, 2].astype(int)), (v[:, 3], v[:, 2].astype(int)), 200, 3)
    r = resample.exact_ap_interval(df, "a", "b", 200, 3).first()
    assert (r.estimate, r.low, r.high) == want


@pytest.mark.parametrize("packed, kept, picked", [(16, 1, 50), (16, 1 << 20, 10), (1000, 1 << 20, 1000)])
def test_exact_bootstraps_in_blocks(spark, monkeypatch, packed, kept, picked):
    for name, value in (("RAW_BLOCK", 700), ("PACKED", packed), ("KEPT", kept), ("PICKED", picked)):
        monkeypatch.setattr(resample, name, value)
    rng = random.Random(2)
    rows = [(i, rng.randrange(2), rng.randrange(3), rng.randrange(4)) for i in range(41)]
    df = spark.createDataFrame(rows, "question_id long, quality int, avoidable int, native int").repartition(4)
    want = {k: v for k, *v in resample.exact_three(np.array(rows, float)[:, 1:], 60, 5)}
    assert {r.metric: [r.estimate, r.low, r.high] for r in resample.exact_three_intervals(df, 60, 5).collect()} == want
    many = [("a", i, rng.random()) for i in range(300)]  # too many values for a byte
    r = resample.exact_paired(spark.createDataFrame(many, "comparison string, question_id long, em double").repartition(4), {("a", "em"): 6, ("b", "em"): 7}, replicates=60).collect()
    assert len(r) == 1 and (r[0].estimate, r[0].low, r[0].high) == pytest.approx(resample.exact_bootstrap(np.array([x for *_, x in many]), 60, 6))
    states = [(q, k, rng.randrange(2), rng.randrange(6) / 4, rng.random()) for q in range(29) for k in range(rng.randint(1, 4))]
    df = spark.createDataFrame(states, "question_id long, state_index long, truth int, a double, b double").repartition(4)
    v = np.array(states, float)
    want = resample.exact_ap_difference(v[:, 0].astype(int), (v[:, 4], v[:, 2].astype(int)), (v[:, 3], v[:, 2].astype(int)), 60, 3)
    r = resample.exact_ap_interval(df, "a", "b", 60, 3).first()
    assert (r.estimate, r.low, r.high) == pytest.approx(want, abs=1e-12)


def test_exact_bootstraps_take_more_than_two_million_rows(spark):
    n = 2_000_003
    i = np.arange(n)
    df = spark.range(n).select(F.lit("a").alias("comparison"), F.col("id").alias("question_id"), (F.col("id") % 3 - 1).alias("quality"), (F.col("id") % 5).alias("avoidable"), (F.col("id") % 7).alias("native"))
    values = np.stack((i % 3 - 1, i % 5, i % 7), 1).astype(float)
    got = {r.metric: [r.estimate, r.low, r.high] for r in resample.exact_three_intervals(df, 4, 5).collect()}
    assert got == {k: v for k, *v in resample.exact_three(values, 4, 5)}
    r = resample.exact_paired(df, {("a", "avoidable"): 9}, replicates=4).first()
    assert (r.estimate, r.low, r.high) == resample.exact_bootstrap(values[:, 1], 4, 9)
    states = spark.range(n).selectExpr("id % 1000 AS question_id", "id AS state_index", "id % 2 AS truth", "id % 7919 / 7919D AS a", "id % 104729 / 104729D AS b")
    r = resample.exact_ap_interval(states, "a", "b", 4, 3).first()
    want = resample.exact_ap_difference(i % 1000, (i % 104729 / 104729, i % 2), (i % 7919 / 7919, i % 2), 4, 3)
    assert (r.estimate, r.low, r.high) == pytest.approx(want, abs=1e-12)


def test_lanes_are_places_of_one_stream():
    n, seed, stride = 1000, 77, 3 * 624
    raw = mersenne.Picks(n, seed).bits.random_raw(624 + 6 * stride).astype(np.uint32) >> np.uint32(22)
    lanes = mersenne.Lanes(n, seed, 624, stride, 5)
    got = np.concatenate([lanes.next().copy() for _ in range(3)])
    for k in range(5):
        assert (got[:, k] == raw[624 + k * stride : 624 + (k + 1) * stride]).all()


@pytest.mark.parametrize("n, kind", [(1, int), (64, int), (300, float), (5000, int)])
def test_lanes_sum_what_the_stream_draws(n, kind):
    """Replicates that end in a block, cross blocks, or hold several; whole numbers beyond a small range are added up as they are."""
    size, replicates, rng = 624 * 4, 30_000 // n + 1, np.random.default_rng(n)
    held = np.append(rng.integers(0, 251, n).astype(np.uint8), np.uint8(0)) if kind is int else np.append(rng.random(n), 0.0)
    counts = [mersenne.Picks(n, 5, k * size).counted(size) for k in range(40)]
    before = np.cumsum([0, *counts]).tolist()
    total = np.zeros(replicates)
    for a in range(0, 40, 8):
        found, sums = resample.lane_sums([(held, -3, 250) if kind is int else (held, 0, 0)], n, 5, size, a, before[a : a + 8])
        np.add.at(total, found[found < replicates], sums[found < replicates, 0])
    picks = mersenne.Picks(n, 5)
    want = [sum(float(held[p]) - (3 if kind is int else 0) for p in picks.take(n)) for _ in range(replicates)]
    assert before[-1] >= n * replicates and total == pytest.approx(want, abs=1e-9 if kind is float else 0)


def test_sums_of_small_numbers_do_not_overflow():
    x = np.full((624, 3), 255, np.uint8)
    assert resample.folded(x, 255).tolist() == [624 * 255] * 3


def test_replicates_side_by_side_have_the_precision_of_each(spark):
    rng = random.Random(4)
    states = [(q, k, rng.randrange(2), rng.randrange(3) / 4, rng.random()) for q in range(700) for k in range(3)]  # more than SHORT states a score
    df = spark.createDataFrame(states, "at long, state_index long, truth int, a double, b double").repartition(4)
    better, base = resample.by_score(df, "b"), resample.by_score(df, "a")
    times = next(resample.counted_picks(mersenne.Picks(700, 3), 700, 6))
    times[:, 5] = 0  # nothing drawn
    times[:300, 4] = 255
    v = np.array(states, float)
    question, truth = v[:, 0].astype(int), v[:, 2].astype(int)
    want = [resample.gains_of(question, (v[:, 3], truth), (v[:, 4], truth), times[:, k].astype(int)) for k in range(6)]
    assert times.shape == (700, 6) and resample.falling_gain(better, base, times) == pytest.approx(want, abs=1e-12)


def test_many_distinct_values(spark, monkeypatch):
    rng = np.random.default_rng(0)
    values = [(i, "m", float(x)) for i, x in enumerate(rng.normal(size=900))] + [(1000 + i, "n", 2.0) for i in range(50)]
    df = spark.createDataFrame(values, "question_id long, metric string, delta double")
    sums = {}
    for size in (40, 5000):
        monkeypatch.setattr(resample, "BLOCK_VALUES", size)
        sums[size] = resample.resampled_sums(df, ["delta"], 3000, 1, "metric").toPandas()
    x = np.array([v for _, m, v in values if m == "m"])
    for found in sums.values():
        m = found[found.metric == "m"]
        assert len(m) == 3000 and set(m.n) == {900} and set(found[found.metric == "n"].delta) == {100.0}
        assert m.delta.mean() == pytest.approx(x.sum(), abs=4 * x.std() * 30 / 3000**0.5) and m.delta.std() == pytest.approx(x.std() * 30, rel=0.06)
    assert resample.resampled_sums(df.limit(0), ["delta"], 10, 1, "metric").count() == 0


def test_weights_are_poisson():
    w = resample.weights(np.arange(3000) * 7919 - 5, 0, 400, 11)
    seen = np.bincount(w.ravel(), minlength=8) / w.size
    assert seen[:6] == pytest.approx([math.exp(-1) / math.factorial(k) for k in range(6)], abs=2e-3)
    assert (resample.weights(np.arange(3000) * 7919 - 5, 100, 50, 11) == w[:, 100:150]).all() and (resample.weights(np.arange(3000) * 7919 - 5, 0, 400, 12) != w).any()
    assert abs(np.corrcoef(w[0].astype(float), w[1].astype(float))[0, 1]) < 0.2 and abs(np.corrcoef(w[:, 0].astype(float), w[:, 1].astype(float))[0, 1]) < 0.08


def test_weights_of_four_replicates_share_a_hash(monkeypatch):
    keys, made = np.arange(500) * 104729, []
    mixed = resample._mixed
    monkeypatch.setattr(resample, "_mixed", lambda *a: made.append(out := mixed(*a)) or out)
    w = resample.weights(keys, 2, 397, 5)
    assert sum(x.size for x in made) < 0.3 * w.size
    same = np.abs(np.corrcoef(w.astype(float).T) - np.eye(397))
    assert same.max() < 0.25 and (resample.weights(keys[7:9], 3, 6, 5) == w[7:9, 1:7]).all()


@pytest.mark.parametrize("most", [7, 60, 20_000])
def test_precision_of_all_replicates_at_once(spark, monkeypatch, most):
    monkeypatch.setattr(resample, "SLICE_STATES", most)
    monkeypatch.setattr(resample, "WEIGHED", 16)
    rng = random.Random(3)
    states = [(m, q, rng.choice([-1e30, 0.5, 0.5, rng.random(), rng.random()]), rng.randrange(2)) for q in range(40) for _ in range(3) for m in ("a", "b")]
    states += [("none", q, 0.1 * q, 0) for q in range(5)]
    df = spark.createDataFrame(states, "model string, question_id long, score double, truth int").repartition(6)
    got = {(r.model, r.replicate): r.value for r in resample.weighed_precision(df, 50, 9).collect()}
    keys = {r.question_id: r.k for r in df.select("question_id", F.xxhash64("question_id").alias("k")).distinct().collect()}
    for m in ("a", "b", "none"):
        own = [s for s in states if s[0] == m]
        w = resample.weights(np.array([keys[s[1]] for s in own]), 0, 50, 9)
        for r in range(50):
            want = resample.tied_precision(np.array([s[2] for s in own]), np.array([s[3] for s in own]), w[:, r].astype(int))
            assert got[m, r] == pytest.approx(want, abs=1e-12)
    assert len(got) == 150


def test_precision_interval_is_near_the_exact_one(spark):
    rng = random.Random(8)
    states = [(q, k, rng.randrange(2)) for q in range(150) for k in range(3)]
    rows = [(q, k, y, y * 0.3 + rng.random(), y * 0.1 + rng.random()) for q, k, y in states]
    df = spark.createDataFrame(rows, "question_id long, state_index long, truth int, a double, b double")
    exact = resample.exact_ap_interval(df, "a", "b", 2000, 3).first()
    long = df.unpivot(["question_id", "state_index", "truth"], ["a", "b"], "model", "score")
    near = resample.ap_bootstrap(long, "a", "b", 2000, 3).first()
    width = exact.high - exact.low
    assert near.low == pytest.approx(exact.low, abs=0.12 * width) and near.high == pytest.approx(exact.high, abs=0.12 * width)
    assert resample.ap_bootstrap(long.where("model = 'a'"), "a", "b", 20, 3).first().low > 0


def test_seeds():
    got = resample.seed_schedule(["a", "structured_base", "c"], 1000)
    assert got["a_minus_native", "em"] == 1200 and got["c_minus_native", "searches"] == 1302
    assert got["a_minus_structured_base", "em"] == 1001 and got["c_minus_structured_base", "average_precision"] == 1402
    assert resample.comparison_pairs(["x", "y"]) == [("y", "x")]


def test_joins_that_fail(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "id int, x string")
    right = spark.createDataFrame([(1, "r", 5), (2, "s", 6), (9, "t", 7)], "id int, y string, p int")
    assert sorted(tuple(r) for r in joins.must_match(left, right.drop("p"), "id").collect()) == [(1, "a", "r"), (2, "b", "s"), (2, "c", "s")]
    for bad in (right.where("id = 1"), right.unionAll(right)):
        with pytest.raises(Exception, match="no single match"):
            joins.must_match(left, bad, "id").count()
    rows = spark.createDataFrame([(5, "r"), (6, "s")], "at int, want string")
    source = right.select("p", "y")
    assert joins.positional(rows, source, "at", "p", "want", "y").count() == 2
    with pytest.raises(Exception, match="another one"):
        joins.positional(rows.withColumn("want", F.lit("r")), source, "at", "p", "want", "y").count()
    names = lambda *m: spark.createDataFrame([(x,) for x in m], "model string")
    assert joins.same_names(names("a", "b", "a"), names("b", "a")).count() == 3
    for other in (names("a"), names("a", "b", "c")):
        with pytest.raises(Exception, match="differ"):
            joins.same_names(names("a", "b"), other).count()
    assert joins.set_equality(names("a", "a", "b"), names("b", "a"), "model").first()["equal"] and not joins.set_equality(names("a"), names("b", "a"), "model").first()["equal"]


def test_containment(spark, monkeypatch):
    texts = ["see the red fox ran", "credit, foxes", "xred foxy", None, "", "a fox", "Fox"]
    needles = ["red fox", "fox", "the red fox ran", "ed f", "none of it", "see the red fox ran", None]
    t = spark.createDataFrame(list(enumerate(texts)), "doc long, text string")
    s = spark.createDataFrame([(i // 2, i, x) for i, x in enumerate(needles)], "item int, k long, sentence string")
    want = {(i // 2, i, d) for i, x in enumerate(needles) for d, y in enumerate(texts) if x and y and x in y}
    for size in (1_000_000, 8):
        monkeypatch.setattr(containment, "CHUNK", size)
        assert {tuple(r) for r in containment.present(s, t, ["item", "k"], "sentence", "text").collect()} == {(i, k) for i, k, _ in want}
        assert {tuple(r) for r in containment.contained(s, t, ["item", "k"], "sentence", "doc", "text").collect()} == want
    assert containment.contained(s.limit(0), t, ["item"], "sentence", "doc", "text").count() == 0
    with pytest.raises(Exception, match="empty sentence"):
        containment.contained(spark.createDataFrame([(1, "")], "item int, sentence string"), t, ["item"], "sentence", "doc", "text").count()


@pytest.mark.parametrize("chunk, remembered", [(1_000_000, 200_000), (16, 1)])
def test_containment_against_every_pair(spark, monkeypatch, chunk, remembered):
    monkeypatch.setattr(containment, "CHUNK", chunk)
    monkeypatch.setattr(containment, "REMEMBERED", remembered)
    rng = random.Random(6)
    bits = ["a", "b", "ab", "é", "😀", " ", "aaaa", "xyz", "\x00", "漢字"]
    text = lambda n: "".join(rng.choice(bits) for _ in range(n))
    texts = [text(rng.randint(0, 60)) for _ in range(120)] + ["ab" * 400]
    needles = sorted({n for n in (x[a : a + rng.choice([1, 2, 3, 4, 7, 8, 9, 15, 16, 17, 33, 64])] for x in texts for a in (rng.randint(0, 40),)) if n} | {"ab" * 300, "ab" * 401, "zz"})
    t = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    s = spark.createDataFrame(list(enumerate(needles)), "k long, needle string")
    want = {(k, i) for k, n in enumerate(needles) for i, x in enumerate(texts) if n in x}
    got = [tuple(r) for r in containment.contained(s, t, ["k"], "needle", "id", "text").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert {r.k for r in containment.present(s, t, ["k"], "needle", "text").collect()} == {k for k, _ in want}


def test_conflict_audit_and_firewall(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "request_id int")
    failed = lambda *a: {r.check for r in audits.conflict_filter(*a).collect() if not r.passed}
    assert failed(ids(1, 2, 3), ids(1, 3), ids(2)) == set()
    assert failed(ids(1, 2, 3), ids(1), ids(2)) == {"counts_add_up", "every_id_once"}
    assert failed(ids(1, 2, 3), ids(1, 1), ids(2)) == {"retained_ids_unique", "every_id_once"}
    assert failed(ids(1), ids(1, 4), ids()) == {"counts_add_up", "every_id_once", "nothing_new"}
    raw = spark.createDataFrame([('{"x": 1}',), ("no json",), (None,)], "raw string")
    assert audits.firewall(raw, "raw", audits.DENIED["states"]).count() == 3
    with pytest.raises(Exception, match="forbidden"):
        audits.firewall(raw.unionAll(spark.createDataFrame([('{"gold": null}',)], "raw string")), "raw", audits.DENIED["teacher_inputs"]).count()
    assert [len(v) for v in audits.DENIED.values()] == [14, 13, 6] and audits.forbidden_columns(spark.range(1).withColumn("gold", F.lit(1)), audits.DENIED["states"]) == ["gold"]


def test_audit_fails_on_a_repeat(spark):
    rows = [("run_start", None, None, None, None, None, "x", False), ("judge_score", 0, 1, 1, 1, 0.5, "x", False), ("judge_score", 1, 1, 2, 2, 0.5, "x", False), ("run_end", None, None, None, None, None, "complete", False)]
    df = spark.createDataFrame(rows, "kind string, sequence_index long, request_id long, state_id long, expected_id long, score double, status string, labels_mounted boolean")
    got = {r.check: r.passed for r in audits.judge_run(df).collect()}
    assert [k for k, v in got.items() if not v] == ["ids_unique"]
