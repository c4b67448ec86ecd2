"""Segmented windows, running totals and ranks against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from runloom.operators import features as feat
from runloom.operators import labels as lab
from runloom.operators.ordered import exact_percentiles, number_samples, running_totals, shuffled_rank
from runloom.operators.segments import over_runs
from runloom.settings import RunSpec
from tests.conftest import make_run

SPEC = RunSpec()


@pytest.mark.parametrize("size", [7, 50, 8192])
def test_breach_labels(spark, size):
    dev = [0.0] * 60
    dev[40] = 99.0
    spec = RunSpec(horizon_min=1.0)
    rows = make_run(spark, {"dev": dev})
    out = feat.breach_labels(rows, spec, F.abs("dev") > 2.5, size=size).orderBy("sample_idx").collect()
    y = [r.y_breach for r in out]
    assert len(out) == 60 and y[39] == 1 and y[40] == 0 and y[27] == 0 and y[28] == 1
    assert all((r.y_time_to_breach_min is None) == (r.y_breach == 0) for r in out)
    assert out[39].y_time_to_breach_min == pytest.approx(5 / 60)
    assert [r.horizon_complete for r in out] == [i + 12 < 60 for i in range(60)]


@pytest.mark.parametrize("size", [5, 33, 8192])
def test_segments_do_not_change_windows(spark, size):
    rng = random.Random(3)
    x = [rng.uniform(-5, 5) for _ in range(150)]
    rows = make_run(spark, {"x": x}).union(make_run(spark, {"x": x[:40]}, run_id=2))
    one = SPEC.steps(1.0)

    def build(part, w):
        t = feat.trailing(w, 1.0, SPEC)
        return part.select(
            "*", feat.lag_padded(F.col("x"), one, w).alias("before"), F.max("x").over(t).alias("hi"),
            F.coalesce(F.stddev_samp("x").over(t), F.lit(0.0)).alias("sd"),
        )

    for run, series in ((1, x), (2, x[:40])):
        out = over_runs(rows, build, back=one, size=size).where(F.col("run_id") == run).orderBy("sample_idx").collect()
        assert [r.sample_idx for r in out] == list(range(len(series)))
        for i, r in enumerate(out):
            window = series[max(0, i - one + 1) : i + 1]
            assert r.before == (series[i - one] if i >= one else series[0])
            assert r.hi == max(window)
            assert r.sd == pytest.approx(np.std(window, ddof=1) if len(window) > 1 else 0.0, abs=1e-9)


@pytest.mark.parametrize("size", [11, 8192])
def test_settle_time(spark, size):
    def settle(values):
        rows = make_run(spark, {"basis_weight": values}).withColumns(
            {"basis_weight_sp": F.lit(100.0), "final_target": F.lit(100.0), "plan_start_min": F.lit(5.0)}
        )
        return lab.run_labels(rows, SPEC, moisture=None, ash=None, size=size).first()

    late = [90.0] * 96 + [100.0] * 264
    assert settle(late).settle_min == pytest.approx(3.0, abs=0.2)
    wave = [100 + 20 * np.sin(i / 3) for i in range(360)]
    never = settle(wave)
    assert never.settle_min is None and never.settled == 0.0


def test_settle_matches_loop(spark):
    rng = random.Random(5)
    for seed in range(3):
        values = [100 + rng.choice([0.2, 0.4, 3.0 if rng.random() < 0.15 else 0.1]) for _ in range(200)]
        rows = make_run(spark, {"basis_weight": values}, seed).withColumns(
            {"basis_weight_sp": F.lit(100.0), "final_target": F.lit(100.0), "plan_start_min": F.lit(2.0)}
        )
        got = lab.run_labels(rows, SPEC, moisture=None, ash=None, size=17).first().settle_min
        streak, want = 0, None
        for k in range(24, 200):
            streak = streak + 1 if abs(values[k] - 100) <= 1.0 else 0
            if streak == SPEC.dwell:
                want = (k - SPEC.dwell + 1) * 5 / 60 - 2.0
                break
        assert got == (pytest.approx(want) if want is not None else None)


def test_run_labels(spark):
    flat = [100.0] * 200
    bump = flat[:50] + [110.0] * 20 + flat[70:]
    for values, off, high in ((flat, 0.0, 0.0), (bump, 1.0, 10.0)):
        rows = make_run(spark, {"basis_weight": values}).withColumns(
            {"basis_weight_sp": F.lit(100.0), "final_target": F.lit(100.0), "plan_start_min": F.lit(5.0)}
        )
        got = lab.run_labels(rows, SPEC, moisture=None, ash=None).first()
        assert got.off_spec == off and got.max_abs_dev_pct == pytest.approx(high)
        assert got.off_spec_minutes == pytest.approx(20 * 5 / 60 if off else 0.0)
        assert got.first_breach_min == (pytest.approx(50 * 5 / 60) if off else None)


@pytest.mark.parametrize("cells", [130, 10, 1, None])
def test_running_totals(spark, cells):
    rng = random.Random(1)
    # one group holds most rows, values crowd near zero with far outliers
    data = [(("a" if rng.random() < 0.8 else "b"), rng.random() ** 9 * 1000, rng.randint(1, 5)) for _ in range(400)]
    data += [("a", 1e9, 1), ("b", -1e9, 2)]
    df = spark.createDataFrame(data, "g string, v double, n long")
    got = running_totals(df, F.col("v"), ["n"], ["g"], cells=cells).collect()
    assert len(got) == len(data)
    for r in got:
        assert r.n_upto == sum(n for g, v, n in data if g == r.g and v <= r.v)
        assert r.n_total == sum(n for g, v, n in data if g == r.g)
    flat = running_totals(df, F.col("v"), ["n"], cells=cells).collect()
    for r in flat[:50]:
        assert r.n_upto == sum(n for _, v, n in data if v <= r.v)


@pytest.mark.parametrize("cells", [75, None])
def test_percentiles_match_numpy(spark, cells):
    rng = random.Random(2)
    data = [(i % 2, rng.choice([1.0, 2.0, rng.gauss(0, 50)])) for i in range(301)] + [(0, None)]
    df = spark.createDataFrame(data, "g int, v double")
    out = exact_percentiles(df, "v", {"p25": 0.25, "p50": 0.5, "p95": 0.95}, ["g"], {"rows": F.count(F.lit(1))}, cells)
    for r in out.collect():
        mine = [v for g, v in data if g == r.g and v is not None]
        assert r.p25 == pytest.approx(np.percentile(mine, 25))
        assert r.p50 == pytest.approx(np.median(mine))
        assert r.p95 == pytest.approx(np.percentile(mine, 95))
        assert r.rows == sum(1 for g, _ in data if g == r.g)


def test_shuffled_rank_is_a_stable_permutation(spark):
    df = spark.range(200).select(F.col("id").alias("run_id"))
    small = {r.run_id: r["rank"] for r in shuffled_rank(df, "run_id", 7, cells=22).collect()}
    plain = {r.run_id: r["rank"] for r in shuffled_rank(df.repartition(3), "run_id", 7).collect()}
    assert small == plain and sorted(plain.values()) == list(range(1, 201))
    other = {r.run_id: r["rank"] for r in shuffled_rank(df, "run_id", 8).collect()}
    assert other != plain


def test_number_samples(spark):
    df = spark.sql(
        "SELECT id % 3 AS run_id, timestamp_seconds(1700000000 + (id * 7919) % 5000) AS ts, id FROM range(600)"
    )
    got = number_samples(df, "run_id", "ts", ["id"], rows_per_slice=40).collect()
    for run in range(3):
        mine = sorted((r.ts, r.id, r.sample_idx) for r in got if r.run_id == run)
        assert [m[2] for m in mine] == list(range(len(mine)))


def test_window_plan_has_one_sort_for_all_features(spark):
    rows = make_run(spark, {"bw_dev_pct": [1.0] * 10})
    out = over_runs(
        rows, lambda p, w: p.select("*", F.lag("bw_dev_pct", 2).over(w), F.max("bw_dev_pct").over(w.rowsBetween(-3, 0))), back=3
    )
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(run_id") == 1 and plan.count("+- Window") + plan.count("Window [") >= 1
