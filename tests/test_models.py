"""Fitted models end to end on a small planted data set."""

import random

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from runloom.operators import attribution, forecast, models, splits, targets
from runloom.operators.stage import staging_path
from runloom.plans import live, queries_models
from runloom.settings import ForecastSpec


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(0)
    rows = []
    for r in range(40):
        level = rng.random()
        for i in range(30):
            risk = level + rng.gauss(0, 0.15)
            y = int(level > 0.5)
            off = int(y and i > 22)
            rows.append((r, i, i * 5 / 60, risk, rng.random(), off, y, level, float(level * 10 + rng.gauss(0, 1)), "A", "B"))
    df = spark.createDataFrame(rows, "run_id long, sample_idx int, t_min double, risk double, noise double, currently_off_spec int, "
                                     "y_breach int, transition_magnitude double, bw_dev_pct double, from_grade string, to_grade string")
    df = df.withColumn("y_fwd_2min", F.col("bw_dev_pct") + 1.0).cache()
    return df, splits.three_way_split(splits.run_strata(df)).cache()


def test_registry_skips_with_reason(spark):
    models.register(models.ModelSpec("ghost", "Ghost", "trees", models.random_forest, requires=("no_such_package",)))
    try:
        usable, skipped = models.available()
        assert "ghost" not in usable and "no_such_package" in skipped["ghost"] and set(usable) >= {"random_forest", "boosted_trees", "logistic"}
    finally:
        models.REGISTRY.pop("ghost")


def test_fit_compare_choose(spark, data):
    df, which = data
    small = {"random_forest": {"trees": 5, "depth": 4, "leaf": 2}, "logistic": {}}
    fitted, points, result = models.fit_all(df, which, ["risk", "noise"], ["random_forest", "logistic"], 0.5, settings=small)
    row = result.first()
    assert row.model in fitted and row.pr_auc > 0.7 and 0 <= row.false_positive_rate <= 1
    imp = models.native_importance(fitted["random_forest"], ["risk", "noise"], spark).collect()
    assert imp[0].feature == "risk" and sum(r.importance for r in imp) == pytest.approx(1.0)
    assert models.native_importance(fitted["logistic"], ["risk", "noise"], spark) is None
    weights, b = attribution.logistic_weights(fitted["logistic"], ["risk", "noise"])
    scored = models.score(fitted["logistic"], df)
    r = scored.first()
    z = b + weights["risk"] * r.risk + weights["noise"] * r.noise
    assert r.proba == pytest.approx(1 / (1 + 2.718281828459045 ** -z), abs=1e-9)
    gated = live.recommend(live.risk_advice(scored.where("sample_idx = 5"), weights, b))
    assert gated.where("confidence < 0.35").count() == 0 and "drivers: " in gated.first().explanation
    path = staging_path(spark, "model")
    models.save_model(fitted["logistic"], path)
    assert models.score(models.load_model(path), df).first().proba == r.proba
    near = attribution.surrogate_attribution(scored.select("run_id", "sample_idx", "risk", "noise", "proba"), ["risk", "noise"]).first()
    assert near.exact is False and abs(near.base - 0.5) < 0.3


def test_fits_read_their_rows_twice(spark, data):
    """Medians, then the staged vectors; passes of a fit and further models read those."""
    df, which = data
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    train = splits.rows_of(df, which, "train")
    n = train.count()
    watched = train.mapInArrow(seen, train.schema)
    ready = models.filled_inputs(watched, ["risk", "noise"])
    for name, small in (("random_forest", {"trees": 3, "depth": 3}), ("boosted_trees", {"rounds": 2, "depth": 2})):
        model = models.fit(watched, ["risk", "noise"], models.REGISTRY[name], ready, **small)
        assert models.score(model, df).where("proba between 0 and 1").count() == df.count()
    assert read.value == 2 * n
    assert ready[1].count() == n and "_filled_risk" not in ready[1].columns
    models.fit(watched, ["risk", "noise"], models.REGISTRY["random_forest"], trees=3, depth=3)
    assert read.value == 4 * n


def test_vectors_equal_those_of_the_input_stages(spark):
    rows = spark.createDataFrame([(1, 1.0, 4, None), (2, None, 5, 0.5), (3, float("nan"), 6, 2.5), (4, 7.0, 9, float("inf"))], "run_id long, a double, b int, c double")
    done, table = models.filled_inputs(rows.withColumn("y_breach", F.lit(0)), ["a", "b", "c"])
    want = PipelineModel(stages=done).transform(rows)
    assert table.columns == ["run_id", "y_breach", "early_stop", "raw"]
    got = {r.run_id: r.raw.toArray().tolist() for r in table.collect()}
    assert got == {r.run_id: r.raw.toArray().tolist() for r in want.collect()}
    again = models.with_vectors(rows, done).collect()
    assert {r.run_id: r.raw.toArray().tolist() for r in again} == got


def test_models_score_a_row_once(spark, data):
    """Models behind one set of input stages share a pass over the rows they score."""
    df, which = data
    inputs = ["risk", "noise"]
    train = splits.rows_of(df, which, "train")
    ready = models.filled_inputs(train, inputs)
    small = {"random_forest": {"trees": 3, "depth": 3}, "boosted_trees": {"rounds": 2, "depth": 2}, "logistic": {}}
    fitted = {n: models.fit(train, inputs, models.REGISTRY[n], ready, **kw) for n, kw in small.items()}
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    together = models.score_each(fitted, df.mapInArrow(seen, df.schema)).collect()
    assert read.value == len(together) == df.count()
    for n, model in fitted.items():
        alone = {(r.run_id, r.sample_idx): r.proba for r in models.score(model, df).collect()}
        assert {(r.run_id, r.sample_idx): r[f"proba_{n}"] for r in together} == alone
        plain = model.transform(df).select("run_id", "sample_idx", vector_to_array("probability")[1].alias("p")).collect()
        assert {(r.run_id, r.sample_idx): r.p for r in plain} == alone
    other = models.fit(train, inputs, models.REGISTRY["logistic"])
    with pytest.raises(ValueError, match="share"):
        models.score_each({"logistic": fitted["logistic"], "other": other}, df)


def test_points_of_a_batch_are_its_even_ranks():
    x = np.random.default_rng(3).normal(size=5001)
    for n in (256, 5001, 6000):
        for fast, slow in zip(models._batch_points(x, n), models._points(x, np.ones(len(x)), n)):
            assert np.array_equal(fast, slow)


def test_forest_keeps_the_node_of_a_row():
    assert models.random_forest(["a"])[-1].getCacheNodeIds()


def test_medians_of_many_tasks(spark):
    n = 60_000
    x = F.pmod(F.col("id") * 7919, F.lit(n)).cast("double")
    rows = spark.range(0, n, 1, 5).select(F.when(F.col("id") % 3 != 0, x).alias("a"), F.when(F.col("id") == 7, float("nan")).otherwise(x * x).alias("b"), F.lit(4).alias("c"))
    got = models.medians(rows, ["a", "b", "c"]).first()
    for value, (column, of) in zip(got, (("a", "a"), ("b", "nanvl(b, null)"))):
        share = rows.selectExpr(f"avg(IF({of} <= {value}, 1, 0)) / avg(IF({of} IS NULL, 0, 1))").first()[0]
        assert abs(share - 0.5) < 0.01, column
    assert got.c == 4.0
    few = spark.createDataFrame([(1.0,), (None,), (3.0,), (9.0,), (5.0,)], "a double")
    assert models.medians(few, ["a"]).first().a == 3.0


def test_boosted_trees_stop_on_held_out_runs(spark, data):
    df, which = data
    train = splits.rows_of(df, which, "train")
    marked = models.training_rows(train).groupBy("run_id").agg(F.count_distinct("early_stop").alias("n"), F.first("early_stop").alias("e")).collect()
    assert all(r.n == 1 for r in marked) and 0 < sum(r.e for r in marked) < len(marked)
    model = models.fit(train, ["risk", "noise"], models.REGISTRY["boosted_trees"], rounds=3, depth=2, leaf=2)
    assert models.score(model, df).where("proba < 0 OR proba > 1 OR proba IS NULL").count() == 0


def test_boosting_waits_for_a_better_round():
    falling = [1.0 - 0.001 * i for i in range(20)]
    assert models.rounds_kept(falling, 5) == (20, False)
    assert models.rounds_kept([1.0, 0.9, 0.95, 0.94, 0.89, *[0.9] * 5], 5) == (5, True)
    assert models.rounds_kept([1.0, 0.9, 0.95, 0.94, 0.89, *[0.9] * 4], 5) == (5, False)
    assert models.rounds_kept([1.0], 5) == (1, False)


def test_boosted_trees_go_on_while_held_out_runs_gain(spark):
    """Gains under 1 % a round are gains; the ensemble ends at the best round."""
    rng = random.Random(1)
    rows = [(r, i, a := rng.random(), b := rng.random(), int(a + 0.5 * b + rng.gauss(0, 0.25) > 0.75)) for r in range(60) for i in range(20)]
    df = spark.createDataFrame(rows, "run_id long, sample_idx int, a double, b double, y_breach int")
    ready = models.filled_inputs(df, ["a", "b"])
    booster = models.boosted_trees(["a", "b"], rounds=24, depth=2, leaf=5)[-1]
    booster.patience = 6
    model = booster.fit(ready[1])
    whole = booster.booster.fit(ready[1].where("NOT early_stop"))
    losses = whole.evaluateEachIteration(ready[1].where("early_stop"))
    kept, _ = models.rounds_kept(losses, 6)
    assert whole.getNumTrees == 24 and model.getNumTrees == kept > 6
    shape = lambda m: [t.toDebugString.split("\n", 1)[1] for t in m.trees]
    assert shape(model) == shape(whole)[:kept]


@pytest.mark.parametrize("name", ["random_forest", "boosted_trees"])
def test_risk_queries_fit_the_registrys_sizes(spark, data, monkeypatch, name):
    df, which = data
    asked = []

    def fit(rows, features, spec, ready=None, **settings):
        asked.append((spec.name, spec.stages(features, **{**spec.settings, **settings})[-1]))
        raise StopIteration

    monkeypatch.setattr(models, "fit", fit)
    monkeypatch.setattr(queries_models, "model_data", lambda spark, sf: (df, which, ["risk", "noise"]))
    with pytest.raises(StopIteration):
        queries_models.risk(name)(spark, "")
    (found, stage), = asked
    assert found == name
    if name == "random_forest":
        assert (stage.getNumTrees(), stage.getMaxDepth(), stage.getMinInstancesPerNode()) == (300, 14, 20)
    else:
        b = stage.booster
        assert (b.getMaxIter(), b.getMaxDepth(), b.getMinInstancesPerNode(), b.getStepSize(), stage.patience) == (400, 7, 40, 0.06, 30)


def test_cone_covers(spark, data):
    df, which = data
    spec = ForecastSpec(horizons_min=(2.0,))
    cone = forecast.fit_cone(df, which, ["bw_dev_pct", "noise"], spec, rounds=25, depth=3, rate=0.3, leaf=5)
    out = forecast.predict_cone(cone, df)
    assert out.where("q10 > q50 OR q50 > q90").count() == 0
    r = targets.forecast_scores(out).first()
    assert r.n == df.count() and 0.6 <= r.interval_coverage <= 0.99
    cursors = df.select("run_id").distinct().withColumn("cursor", F.lit(1.0))
    model = models.fit(df, ["risk", "noise"], models.REGISTRY["logistic"])
    state = live.live_state(df, cursors, model, cone, 0.5, 2).collect()
    assert len(state) == 40 and all(s.t_min <= 1.0 and "2.0min:" in s.forecast_cone for s in state)
