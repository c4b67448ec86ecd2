"""Alarms, scores, splits, correlations against hand-computed cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from runloom.dims import known_loops_table
from runloom.operators import alarms, attribution, correlate, scores, splits
from runloom.operators.attribution import attribution_long


def scored(spark, runs):
    """runs: run_id -> list of (off, proba)"""
    rows = [(r, i, i * 5 / 60, int(o), 0, float(p)) for r, s in runs.items() for i, (o, p) in enumerate(s)]
    return spark.createDataFrame(rows, "run_id long, sample_idx int, t_min double, currently_off_spec int, y_breach int, proba double")


@pytest.mark.parametrize("size", [3, 8192])
def test_on_delay(spark, size):
    rows = scored(spark, {1: [(0, p) for p in (0, 1, 0, 1, 1, 1, 0)], 2: [(0, p) for p in (0, 1, 1)], 3: [(0, p) for p in (1, 1, 0)]})
    out = alarms.confirm(rows, 0.5, 3, size=size).where("alarm").collect()
    assert [(r.run_id, r.sample_idx) for r in out] == [(1, 5)]
    assert alarms.confirm(rows, 0.5, 1).where("alarm").count() == 8


def test_early_warning(spark):
    early = [(i >= 20, 0.9 if i >= 8 else 0.1) for i in range(40)]
    late = [(i >= 20, 0.9 if i >= 20 else 0.1) for i in range(40)]
    clean = [(0, 0.9 if i >= 10 else 0.1) for i in range(40)]
    rows = scored(spark, {1: early, 2: late, 3: clean})
    out = {r.run_id: r for r in alarms.warning_outcomes(alarms.confirm(rows, 0.5, 1)).collect()}
    assert out[1].warned and out[1].warning_min == pytest.approx(12 * 5 / 60)
    assert not out[2].warned and out[2].warning_min is None
    assert out[3].false_alarm and not out[3].breached
    s = alarms.warning_summary(alarms.warning_outcomes(alarms.confirm(rows, 0.5, 1))).first()
    assert s.detection_rate == 0.5 and s.false_alarm_run_rate == 1.0 and s.median_warning_min == pytest.approx(1.0)


def test_sweep_equals_single_evaluations(spark):
    rng = random.Random(4)
    runs = {r: [(i > 30 and r % 3 > 0, rng.random()) for i in range(45)] for r in range(12)}
    rows = scored(spark, runs).withColumn("y_breach", (F.col("sample_idx") > 20).cast("int"))
    grid = alarms.sweep(rows, (0.3, 0.6, 0.85), (1, 2, 3), size=16)
    got = {(r.threshold, r.delay): r for r in grid.collect()}
    assert len(got) == 9
    for thr in (0.3, 0.85):
        for delay in (1, 3):
            want = alarms.evaluate(rows, thr, delay).first()
            point = got[thr, delay]
            for c in ("precision", "recall", "f1", "false_positive_rate", "detection_rate", "median_warning_min", "false_alarm_run_rate"):
                assert point[c] == (pytest.approx(want[c]) if want[c] is not None else None), (thr, delay, c)
    best = alarms.best_points(grid, 0.1).first()
    feasible = [r for r in got.values() if r.detection_rate >= 0.1 and r.median_warning_min is not None]
    low = min(feasible, key=lambda r: (r.false_alarm_run_rate, -r.median_warning_min, r.threshold, r.delay))
    assert (best.threshold, best.delay) == (low.threshold, low.delay)


def test_retune(spark):
    def points(*rows):
        return spark.createDataFrame(rows, "threshold double, detection_rate double, median_warning_min double, false_alarm_run_rate double")

    better = alarms.retune(points((0.5, 0.9, 3.0, 0.4), (0.6, 0.885, 3.0, 0.2), (0.7, 0.8, 5.0, 0.1)), 0.5).first()
    assert better.chosen_threshold == 0.6 and better.changed
    same = alarms.retune(points((0.5, 0.9, 3.0, 0.4), (0.6, 0.9, 3.0, 0.4)), 0.5).first()
    assert same.chosen_threshold == 0.5 and not same.changed
    before = spark.sql("SELECT 0.9D detection_rate, 3D median_warning_min, 0.4D false_alarm_run_rate")
    after = spark.sql("SELECT 0.89D detection_rate, 3D median_warning_min, 0.2D false_alarm_run_rate")
    assert alarms.confirm_retune(before, after).first().adopt and not alarms.confirm_retune(after, before).first().adopt


def test_scores_against_brute_force(spark):
    rng = random.Random(9)
    data = [(int(rng.random() < 0.3), round(rng.random(), 1)) for _ in range(300)]
    df = spark.createDataFrame(data, "y_breach int, proba double")
    got = scores.ranking_scores(df).first()
    pos, neg = [p for y, p in data if y], [p for y, p in data if not y]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    ap, last = 0.0, 0.0
    for t in sorted({p for _, p in data}, reverse=True):
        tp, fp = sum(p >= t for p in pos), sum(p >= t for p in neg)
        ap, last = ap + (tp / len(pos) - last) * tp / (tp + fp), tp / len(pos)
    assert got.roc_auc == pytest.approx(auc) and got.average_precision == pytest.approx(ap)
    best = scores.pick_threshold(df, "f1").first()
    f1 = {t: 2 * sum(p >= t for p in pos) / (sum(p >= t for _, p in data) + len(pos)) for t in {p for _, p in data}}
    top = max(f1.values())
    assert best.score == pytest.approx(top) and best.threshold == min(t for t, s in f1.items() if s == top)
    one = spark.createDataFrame([(1, 0.2), (1, 0.9)], "y_breach int, proba double")
    assert scores.pick_threshold(one).first().threshold == 0.5
    assert scores.ranking_scores(one).first().roc_auc is None
    with pytest.raises(ValueError):
        scores.pick_threshold(df, "best")


def test_three_way_split(spark):
    rng = random.Random(1)
    rows = [(r, i, r % 2, r % 2, float(rng.choice([0.2, 0.5, 0.9, r / 40]))) for r in range(40) for i in range(3)]
    df = spark.createDataFrame(rows, "run_id long, sample_idx int, currently_off_spec int, y_breach int, transition_magnitude double")
    strata = splits.run_strata(df)
    got = splits.three_way_split(strata).collect()
    assert len(got) == 40 and {r.split for r in got} == {"train", "val", "test"}
    again = splits.three_way_split(strata.repartition(5)).collect()
    assert {(r.run_id, r.split) for r in got} == {(r.run_id, r.split) for r in again}
    for s in {r.stratum for r in got}:
        n = [r.split for r in got if r.stratum == s]
        if len(n) >= 3:
            assert {"train", "val", "test"} <= set(n)
    with pytest.raises(ValueError):
        splits.three_way_split(strata, 0.6, 0.5)
    with pytest.raises(KeyError):
        splits.rows_of(df, strata, "other")


def test_disjoint_check(spark):
    bad = spark.createDataFrame([(1, "train"), (2, "train"), (2, "val")], "run_id long, split string")
    with pytest.raises(ValueError):
        splits.require_disjoint(bad)
    splits.require_disjoint(bad.where("split = 'train'"))


def test_lagged_pairs(spark):
    rows = [(1, i, c, e) for i, (c, e) in enumerate(zip((1.0, 2.0, 3.0, 4.0), (0.1, 0.2, 0.3, 0.4)))]
    rows += [(2, i, c, e) for i, (c, e) in enumerate(zip((10.0, 20.0, 30.0), (0.5, 0.6, 0.7)))]
    rows += [(3, i, 7.0, 8.0) for i in range(2)]  # one pair at lag 1: skipped
    df = spark.createDataFrame(rows, "run_id long, sample_idx int, c double, e double")
    got = correlate.lagged_pairs(df, "c", "e", 1).orderBy("run_id", "sample_idx").collect()
    assert [(r.x, r.y) for r in got] == [(1, 0.2), (2, 0.3), (3, 0.4), (10, 0.6), (20, 0.7)]


@pytest.mark.parametrize("size", [32, 4096])
def test_planted_lag(spark, size):
    rng = np.random.default_rng(0)
    rows = []
    for r in range(8):
        c = rng.normal(size=120).cumsum()
        e = np.concatenate([np.zeros(6), c[:-6]]) + rng.normal(scale=0.05, size=120)
        rows += [(r, i, float(c[i]), float(e[i]), 5.0) for i in range(120)]
    df = spark.createDataFrame(rows, "run_id long, sample_idx int, stock_flow double, caliper double, flat double")
    pairs = correlate.pair_correlations(df, ["stock_flow", "caliper", "flat"], 10, size=size)
    best = {(r.cause, r.effect): r for r in correlate.strongest_lags(pairs, 0.3).collect()}
    hit = best["stock_flow", "caliper"]
    assert hit.lag == 6 and hit.correlation > 0.9 and hit.n_samples == 8 * 114
    assert not any("flat" in k for k in best)
    table = correlate.discover(df, ["stock_flow", "caliper"], 10, 0.3, known_loops_table(spark), 5 / 60)
    top = table.where("cause = 'stock_flow'").first()
    assert top.best_lag_min == 0.5 and top.novel and top.mutual_information > 0.3


def test_linear_attribution_adds_up(spark):
    rng = random.Random(6)
    data = [tuple(rng.gauss(0, 1) for _ in range(6)) for _ in range(200)]
    names = [f"f{i}" for i in range(6)]
    df = spark.createDataFrame([(i, *d) for i, d in enumerate(data)], "id long, " + ", ".join(f"{n} double" for n in names))
    w = {n: 0.3 * i - 0.7 for i, n in enumerate(names)}
    out = attribution.linear_attribution(df, w, 0.25).withColumn("sum", F.aggregate("phi", F.lit(0.0), lambda a, p: a + p["phi"])).collect()
    for r in out:
        assert r.base + r["sum"] == pytest.approx(0.25 + sum(w[n] * r[n] for n in names), abs=1e-8)
    top = attribution.linear_attribution(df, w).select(attribution.top_drivers(F.col("phi"), 3).alias("t")).first().t
    assert len(top) == 3 and abs(top[0].phi) >= abs(top[1].phi) >= abs(top[2].phi)
    assert attribution_long(attribution.linear_attribution(df, w), ["id"]).count() == 1200


def test_permutation_ranks_the_used_feature(spark):
    rng = random.Random(8)
    data = [(str(i), rng.random(), rng.random()) for i in range(300)]
    df = spark.createDataFrame([(k, int(a > 0.6), a, b) for k, a, b in data], "key string, y_breach int, a double, b double")
    out = {r.feature: r.importance for r in attribution.permutation_importance(df, "key", ["a", "b"], attribution.by_columns(lambda x: x["a"] + F.lit(0.0) * x["b"], ["a", "b"]), 2).collect()}
    assert out["a"] > 0.2 and out["b"] == pytest.approx(0.0)


def test_permuted_rows_permute_one_feature_at_a_time(spark):
    n = 700
    df = spark.createDataFrame([(f"k{i}", float(i), float(-i), i % 2) for i in range(n)], "key string, a double, b double, y_breach int")
    out = attribution.permuted_rows(df, "key", ["a", "b"], 3, block_rows=64).toPandas()
    assert len(out) == n * (1 + 2 * 3)
    base = out[out.feature == ""]
    assert (base.a == -base.b).all() and set(base.repeat) == {0}
    donors = {}
    for (feature, repeat), part in out[out.feature != ""].groupby(["feature", "repeat"]):
        own, other = ("b", "a") if feature == "a" else ("a", "b")
        assert sorted(part[feature]) == sorted(base[feature])  # every row gives once
        assert sorted(part[own]) == sorted(base[own])
        moved = (part.a != -part.b).mean()
        assert moved > 0.98
        key = -part.b if feature == "a" else part.a  # the row itself
        given = part.a if feature == "a" else -part.b
        donors[feature, repeat] = dict(zip(key, given))
        assert abs(part[["a", "b"]].corr().iloc[0, 1]) < 0.15  # of strangers
        assert (part.y == (key % 2)).all()
    assert donors["a", 1] == donors["b", 1] and donors["a", 1] != donors["a", 2]


def test_permutation_shuffles_once(spark):
    """The permuted rows reach the score counts without an exchange of their own."""
    df = spark.range(5000).select(F.col("id").alias("key"), F.rand(1).alias("a"), F.rand(2).alias("b"), (F.col("id") % 2).cast("int").alias("y_breach"))
    rows = attribution.permuted_rows(df, "key", ["a", "b"], 5)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    ap = attribution.permutation_importance(df.withColumn("y_breach", (F.col("a") > 0.5).cast("int")), "key", ["a", "b"], attribution.by_columns(lambda x: x["a"], ["a", "b"]))
    out = {r.feature: r for r in ap.collect()}
    assert out["a"].importance == pytest.approx(0.5, abs=0.05) and out["a"].std < 0.03 and abs(out["b"].importance) < 1e-12


def test_permutation_of_few_rows(spark):
    one = spark.createDataFrame([("k", 1.0, 1)], "key string, a double, y_breach int")
    score = attribution.by_columns(lambda x: x["a"], ["a"])
    assert [r.importance for r in attribution.permutation_importance(one, "key", ["a"], score).collect()] == [0.0]
    assert attribution.permutation_importance(one.limit(0), "key", ["a"], score).count() == 0


def test_fourier_sums_equal_plain_ones(spark):
    """Many lags, runs shorter and longer than a segment."""
    rng = np.random.default_rng(3)
    tags = ["stock_flow", "caliper", "ash"]
    runs_ = {r: rng.normal(size=(n, 3)).cumsum(axis=0) + [500.0, 0.01, -30.0] for r, n in enumerate((1, 2, 3, 40, 41, 130, 300))}
    df = spark.createDataFrame([(r, i, *map(float, v)) for r, x in runs_.items() for i, v in enumerate(x)], "run_id long, sample_idx int, stock_flow double, caliper double, ash double")
    max_lag = 50
    got = {(r.cause, r.effect, r.lag): (r.n_samples, r.correlation) for r in correlate.pair_correlations(df, tags, max_lag, size=64).collect()}
    assert len(got) == 6 * (max_lag + 1)
    for (c, e, lag), (n, r) in got.items():
        i, j = tags.index(c), tags.index(e)
        parts = [(x[: len(x) - lag, i], x[lag:, j]) for x in runs_.values() if len(x) - lag > 1]
        x, y = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        assert n == len(x) and r == pytest.approx(np.corrcoef(x, y)[0, 1], abs=1e-9)
