"""Pinball boosting against small exact computations and on heteroscedastic data."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from runloom.operators import boosting, forecast, targets
from runloom.settings import ForecastSpec

HORIZONS = (2.0, 5.0, 10.0)


@pytest.fixture(scope="module")
def uneven(spark):
    """Spread that depends on an input, and grows with the horizon."""
    rng = np.random.default_rng(7)
    n_runs, n = 60, 100
    run, idx = np.repeat(np.arange(n_runs), n), np.tile(np.arange(n), n_runs)
    wide = rng.random(n_runs * n)
    level = rng.normal(size=n_runs * n) * 2
    ys = [level + (0.2 + 4 * (wide > 0.5)) * (1 + h / 10) * rng.normal(size=len(run)) for h in HORIZONS]
    rows = [(int(r), int(i), float(w), None if i % 17 == 0 else float(v), *(float(y[k]) if i < 95 else None for y in ys)) for k, (r, i, w, v) in enumerate(zip(run, idx, wide, level))]
    names = ", ".join(f"{targets.target_name(h)} double" for h in HORIZONS)
    df = spark.createDataFrame(rows, f"run_id long, sample_idx int, wide double, level double, {names}").repartition(4).cache()
    which = df.select("run_id").distinct().withColumn("split", F.when(F.col("run_id") % 5 == 0, "test").when(F.col("run_id") % 5 == 1, "val").otherwise("train"))
    return df, which


def test_cone_width_follows_the_inputs(spark, uneven):
    df, which = uneven
    cone = forecast.fit_cone(df, which, ["wide", "level"], ForecastSpec(HORIZONS), rounds=25, depth=3, rate=0.2, leaf=20, patience=8)
    test = df.join(which.where("split = 'test'").select("run_id"), "run_id")
    out = forecast.predict_cone(cone, test, ("run_id", "sample_idx", "wide")).cache()
    assert out.count() == 3 * test.count() and out.where("q10 > q50 OR q50 > q90").count() == 0
    for r in targets.forecast_scores(out).collect():
        assert r.n == test.where("sample_idx < 95").count() and 0.70 <= r.interval_coverage <= 0.90, r
    for r in targets.forecast_scores(out.withColumn("noisy", F.col("wide") > 0.5), by=["horizon_min", "noisy"]).collect():
        assert 0.65 <= r.interval_coverage <= 0.95, r
    width = {r.noisy: r.w for r in out.groupBy((F.col("wide") > 0.5).alias("noisy")).agg(F.avg(F.col("q90") - F.col("q10")).alias("w")).collect()}
    assert width[True] > 4 * width[False]
    losses = np.array(cone.model.losses)
    # the noise itself is most of the loss at the long horizon
    assert losses.shape[1] == 9 and (np.nanmin(losses, axis=0) < 0.9 * losses[0]).all()
    assert (cone.model.rounds <= len(cone.model.trees)).all()


def plain_round(x, y, f, q, depth, leaf, l2, bins):
    """Splits of one tree, by trying every cut of every feature."""
    g = np.where(y > f, q, q - 1.0)
    nodes, found = {0: np.arange(len(y))}, {}
    for level in range(depth):
        nxt = {}
        for node, rows in nodes.items():
            best = (0.0, None)
            for j in range(x.shape[1]):
                for b in range(bins):
                    left, right = rows[x[rows, j] <= b], rows[x[rows, j] > b]
                    if len(left) < leaf or len(right) < leaf:
                        continue
                    gain = sum(g[s].sum() ** 2 / (len(s) + l2) for s in (left, right)) - g[rows].sum() ** 2 / (len(rows) + l2)
                    if gain > best[0] + 1e-9:
                        best = (gain, (j, b, left, right))
            if best[1]:
                j, b, nxt[2 * node], nxt[2 * node + 1] = best[1]
                found[level, node] = (j, b)
            else:
                nxt[2 * node] = rows
        nodes = nxt
    return found, nodes


def test_first_tree_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(400, 3)).round(1)
    y = v[:, 0] * 2 + (v[:, 1] > 0.3) * 3 + rng.normal(size=400) * 0.1
    df = spark.createDataFrame([(*map(float, r), float(t), False) for r, t in zip(v, y)], "a double, b double, c double, y double, held boolean").repartition(3)
    model = boosting.fit_quantiles(df, ["a", "b", "c"], ["y"], [0.3], "held", rounds=1, depth=3, rate=1.0, leaf=10, bins=12)
    base, tree = model.trees
    x = np.stack([1 + np.searchsorted(e, v[:, j], side="left") for j, e in enumerate(model.edges)], axis=1).astype(np.uint8)
    assert abs(base.value[0, 0] - np.sort(y)[int(np.ceil(0.3 * 400)) - 1]) <= 0.02 * abs(base.value[0, 0])
    found, leaves = plain_round(x, y, np.full(400, base.value[0, 0]), 0.3, 3, 10, 1.0, 12)
    for (level, node), (j, b) in found.items():
        at = node + (1 << level) - 1
        assert (tree.feature[0, at], tree.cut[0, at]) == (j, b)
    for place, rows in leaves.items():
        assert (tree.leaf(x[rows], 0, 3) == place).all()
        r = np.sort(y[rows] - base.value[0, 0])
        want = r[int(np.ceil(0.3 * len(r) - 1e-9)) - 1]
        assert abs(tree.value[0, place] - want) <= 0.011 * abs(want) + 1e-9
    assert model.rounds.tolist() == [2]


def test_splits_do_not_depend_on_the_partitions(spark, uneven, monkeypatch):
    """Given the bin edges, which are approximate percentiles and may differ a little."""
    df, _ = uneven
    edges = boosting.bin_edges(df, ["wide", "level"], boosting.BINS)
    other = boosting.bin_edges(df.repartition(7), ["wide", "level"], boosting.BINS)
    assert all(len(a) == len(b) and np.abs(a - b).max() < 0.05 * np.ptp(a) for a, b in zip(edges, other))
    monkeypatch.setattr(boosting, "bin_edges", lambda *_: edges)
    rows = df.withColumn("held", F.col("run_id") % 7 == 0)
    fits = [
        boosting.fit_quantiles(rows.repartition(n), ["wide", "level"], ["y_fwd_2min"], [0.1, 0.9], "held", rounds=3, depth=3, leaf=20) for n in (1, 5)
    ]
    for a, b in zip(fits[0].trees, fits[1].trees):
        assert (a.feature == b.feature).all() and (a.cut == b.cut).all() and (a.value == b.value).all()


def test_buckets_are_close_and_ordered():
    r = np.r_[0.0, 1e-12, -1e-12, np.geomspace(1e-8, 1e9, 500), -np.geomspace(1e-8, 1e9, 500)]
    back = boosting.bucket_value(boosting.bucket(r))
    assert (np.abs(back - r) <= 0.0101 * np.abs(r) + 2e-9).all()
    order = np.argsort(r)
    assert (np.diff(boosting.bucket(r)[order]) >= 0).all()


def test_constant_and_missing_inputs(spark):
    df = spark.createDataFrame([(1.0, None, float(i), i % 4 == 0) for i in range(80)], "a double, b double, y double, held boolean")
    model = boosting.fit_quantiles(df, ["a", "b"], ["y"], [0.5], "held", rounds=2, depth=2, leaf=5)
    out = boosting.predict_quantiles(model, df, ["y"], lambda t, q: "p")
    assert out.count() == 80 and out.agg(F.max(F.abs(F.col("p") - 40))).first()[0] < 4


def test_a_pass_shuffles_a_row_a_node(spark, monkeypatch):
    """Not one a node and feature; more rows than a chunk, one target with gaps."""
    names = [f"x{i}" for i in range(12)]
    rows = spark.range(0, 9000, 1, 2).select(*[F.rand(i).alias(n) for i, n in enumerate(names)], F.rand(40).alias("a"), F.when(F.rand(41) > 0.3, F.rand(42)).alias("b"), F.lit(False).alias("held"))
    model = boosting.QuantileModel(names, boosting.bin_edges(rows, names, 8), [("a", 0.5), ("b", 0.5)])
    data = boosting.staged(boosting.binned(rows, model, ["a", "b"], "held"))
    sent = []
    plain = type(rows).repartition
    monkeypatch.setattr(type(rows), "repartition", lambda self, *a: sent.append(self) or plain(self, *a))
    found, _ = boosting.splits(data, model, np.array([0, 1]), [], boosting.Tree.empty(2, 2), 0, [0, 1], 8, 5, 1.0)
    assert len(found) == 2 and sent[0].count() <= data.rdd.getNumPartitions() * 2 * 2
    totals = sent[0].where("node >= 0").select("model", F.aggregate("counts", F.lit(0), lambda x, y: x + y).alias("n")).groupBy("model").agg(F.sum("n")).collect()
    assert dict(map(tuple, totals)) == {0: 12 * 9000, 1: 12 * rows.where("b IS NOT NULL").count()}


def test_only_the_smaller_child_is_counted(spark, monkeypatch):
    """The other is its parent less that one, and splits as if it were counted."""
    names = [f"x{i}" for i in range(4)]
    made = F.randn(9) + 2 * F.col("x0") + F.col("x1") - F.col("x2") - 1  # around the prediction, 0
    rows = spark.range(0, 9000, 1, 3).select(*[F.rand(i).alias(n) for i, n in enumerate(names)], F.lit(False).alias("held")).withColumn("y", F.when(F.col("x3") < 0.9, made))
    model = boosting.QuantileModel(names, boosting.bin_edges(rows, names, 8), [("y", q) for q in (0.2, 0.5, 0.7, 0.9)])
    data, of, everyone = boosting.staged(boosting.binned(rows, model, ["y"], "held")), np.zeros(4, int), [0, 1, 2, 3]
    tree, seen, sent = boosting.Tree.empty(4, 3), {}, []
    plain = type(rows).repartition
    monkeypatch.setattr(type(rows), "repartition", lambda self, *a: sent.append(self) or plain(self, *a))
    for level in range(3):
        whole = sorted(boosting.splits(data, model, of, [], tree, level, everyone, 8, 20, 1.0)[0])
        every = sent[-1]
        found = sorted(boosting.splits(data, model, of, [], tree, level, everyone, 8, 20, 1.0, seen)[0])
        assert found == whole and len(found) == 4 << level
        n = lambda sent: sent.where("node >= 0").agg(F.sum(F.aggregate("counts", F.lit(0), lambda x, y: x + y))).first()[0]
        assert n(every) == 4 * 4 * rows.where("y IS NOT NULL").count() and (level == 0 or n(sent[-1]) <= n(every) / 2)
        for m, node, feature, cut, _ in found:
            tree.feature[m, node + (1 << level) - 1], tree.cut[m, node + (1 << level) - 1] = feature, cut


def test_a_leaf_travels_as_a_row(spark, monkeypatch):
    rows = spark.range(0, 6000, 1, 3).select(F.rand(1).alias("x"), F.randn(2).alias("y"), F.lit(False).alias("held"))
    model = boosting.QuantileModel(["x"], boosting.bin_edges(rows, ["x"], 8), [("y", 0.2), ("y", 0.8)])
    data = boosting.staged(boosting.binned(rows, model, ["y"], "held"))
    sent = []
    plain = type(rows).repartition
    monkeypatch.setattr(type(rows), "repartition", lambda self, *a: sent.append(self) or plain(self, *a))
    found = boosting.leaf_quantiles(data, model, np.zeros(2, int), [], boosting.Tree.empty(2, 0), [0, 1])
    assert sent[0].count() <= 2 * data.rdd.getNumPartitions()
    want = rows.agg(F.percentile("y", 0.2), F.percentile("y", 0.8)).first()
    assert [m for m, _, _ in sorted(found)] == [0, 1] and all(abs(v - w) < 0.03 for (_, _, v), w in zip(sorted(found), want))
