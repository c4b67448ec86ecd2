"""Alarm models: a registry of ML pipelines, scoring, and fit-and-compare."""

from __future__ import annotations

import importlib.util
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, ImputerModel, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runloom.operators import alarms, scores
from runloom.operators.ordered import hash_position
from runloom.operators.splits import rows_of
from runloom.operators.stage import staged

SEED = 42
EARLY_STOP_SHARE = 0.15


@dataclass(frozen=True)
class ModelSpec:
    """A named factory of pipeline stages.  ``requires`` lists packages that may
    be missing; such a model is skipped with the reason, never an error."""

    name: str
    label: str
    family: str
    stages: Callable[[Sequence[str]], list]
    requires: tuple[str, ...] = ()
    settings: dict = field(default_factory=dict)

    def missing(self) -> str | None:
        lacking = [p for p in self.requires if importlib.util.find_spec(p) is None]
        return f"needs {', '.join(lacking)}" if lacking else None


def input_stages(features: Sequence[str], output: str = "raw") -> list:
    """Missing inputs become the training median, so every row is scored."""
    filled = [f"_filled_{f}" for f in features]
    return [
        Imputer(inputCols=list(features), outputCols=filled, strategy="median", relativeError=0.01),
        VectorAssembler(inputCols=filled, outputCol=output, handleInvalid="keep"),
    ]


def rounds_kept(losses: Sequence[float], patience: int) -> tuple[int, bool]:
    """Rounds up to the best held-out loss, and whether ``patience`` rounds without a
    better one ended the search."""
    best = 0
    for number, loss in enumerate(losses):
        if loss < losses[best]:
            best = number
        elif number - best >= patience:
            return best + 1, True
    return best + 1, False


class EarlyStopped(Estimator):
    """Boosting that ends with the round before ``patience`` rounds without a better loss
    on the rows marked ``early_stop``, at most after the booster's own ``maxIter``.  The
    booster's validation column would end it at the first round that gains under 1 %, with
    small steps the second.  Rounds are grown in doubling numbers; more rounds begin with the
    same trees, so a fit with the number found is the ensemble up to the best round."""

    def __init__(self, booster: GBTClassifier, patience: int = 30):
        super().__init__()
        self.booster, self.patience = booster, patience

    def _fit(self, rows: DataFrame):
        learn, held = rows.where(~F.col("early_stop")), rows.where("early_stop")
        most = self.booster.getMaxIter()
        grown = lambda n: self.booster.copy({self.booster.maxIter: n}).fit(learn)
        if held.isEmpty():
            return grown(most)
        n = min(self.patience * 4 // 3, most)
        while True:
            model = grown(n)
            best, ended = rounds_kept(model.evaluateEachIteration(held), self.patience)
            if ended or n == most:
                return model if best == n else grown(best)
            n = min(2 * n, most)


def random_forest(features: Sequence[str], trees: int = 300, depth: int = 14, leaf: int = 20) -> list:
    # fixed values: tree count, depth and leaf size of the bagged baseline
    return [
        *input_stages(features),
        RandomForestClassifier(
            featuresCol="raw", labelCol="y_breach", numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf,
            featureSubsetStrategy="sqrt", seed=SEED, cacheNodeIds=True,  # else a row descends from the root in every pass
        ),
    ]


def boosted_trees(features: Sequence[str], rounds: int = 400, depth: int = 7, leaf: int = 40, rate: float = 0.06) -> list:
    # fixed values: rounds, depth, leaf size and rate; stops early on held-out runs
    return [
        *input_stages(features),
        EarlyStopped(GBTClassifier(
            featuresCol="raw", labelCol="y_breach", maxIter=rounds, maxDepth=depth, minInstancesPerNode=leaf, stepSize=rate, seed=SEED,
        )),
    ]


def logistic(features: Sequence[str], c: float = 0.5) -> list:
    # the scaler is part of the pipeline, so it only ever sees training rows
    return [
        *input_stages(features),
        StandardScaler(inputCol="raw", outputCol="scaled", withMean=True, withStd=True),
        LogisticRegression(
            featuresCol="scaled", labelCol="y_breach", regParam=c, elasticNetParam=0.0, standardization=False, maxIter=100,
        ),
    ]


REGISTRY: dict[str, ModelSpec] = {}


def register(spec: ModelSpec) -> None:
    REGISTRY[spec.name] = spec


register(ModelSpec("random_forest", "Random forest", "trees", random_forest))
register(ModelSpec("boosted_trees", "Boosted trees", "trees", boosted_trees))
register(ModelSpec("logistic", "Logistic regression", "linear", logistic))


def available() -> tuple[dict[str, ModelSpec], dict[str, str]]:
    """Usable models, and the reason each other one is skipped."""
    skipped = {n: s.missing() for n, s in REGISTRY.items() if s.missing()}
    return {n: s for n, s in REGISTRY.items() if n not in skipped}, skipped


def training_rows(rows: DataFrame) -> DataFrame:
    """Mark a seeded share of whole runs for early stopping."""
    # another seed than the splits use, or no training run would fall below the cut
    md5 = hash_position(F.col("run_id"), F.lit("early stop"))
    u = F.conv(F.substring(md5, 1, 8), 16, 10).cast("double") / float(2**32)
    return rows.withColumn("early_stop", u < EARLY_STOP_SHARE)


POINTS = 256  # of a batch's or a task's sorted values; a median is off by 1 / POINTS of the ranks at most


def _batch_points(x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """:func:`_points` of values that weigh one each: they are sorted as they are."""
    if len(x) <= n:
        return x, np.ones(len(x))
    at = np.ceil((np.arange(n) + 0.5) * len(x) / n).astype(np.int64) - 1
    return np.sort(x)[at], np.full(n, len(x) / n)


def _points(values: np.ndarray, weights: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``n`` values at even ranks that stand for all of them (all, if fewer)."""
    if len(values) <= n:
        return values, weights
    order = np.argsort(values)
    upto = np.cumsum(weights[order])
    at = np.searchsorted(upto, (np.arange(n) + 0.5) * upto[-1] / n)
    return values[order][np.minimum(at, len(order) - 1)], np.full(n, upto[-1] / n)


def medians(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """One row of approximate medians, missing values left out: each task sends some
    points of its sorted values, whatever its rows."""
    features = list(features)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [([], []) for _ in features]
        for batch in batches:
            for (values, weights), column in zip(held, batch.columns):
                x = column.to_numpy(zero_copy_only=False)
                x = x[~np.isnan(x)]
                v, w = _batch_points(x, POINTS)
                values.append(v)
                weights.append(w)
        for i, (values, weights) in enumerate(held):
            if values:
                v, w = _points(np.concatenate(values), np.concatenate(weights), POINTS)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), i, np.int32)), pa.array(v), pa.array(w)], ["i", "value", "weight"])

    def middle(points: pd.DataFrame) -> pd.DataFrame:
        points = points.sort_values("value")
        upto = points["weight"].cumsum().to_numpy()
        return pd.DataFrame({"i": points["i"].iloc[:1], "value": points["value"].iloc[[np.searchsorted(upto, upto[-1] / 2)]].to_numpy()})

    points = rows.select(*[F.col(f).cast("double") for f in features]).mapInArrow(sketch, "i int, value double, weight double")
    found = {r.i: r.value for r in points.groupBy("i").applyInPandas(middle, "i int, value double").collect()}  # one row a feature
    return rows.sparkSession.createDataFrame([tuple(found.get(i) for i in range(len(features)))], ", ".join(f"`{f}` double" for f in features))


def _input_pair(stages: Sequence) -> bool:
    """Whether the first two are the fitted :func:`input_stages`."""
    return len(stages) > 1 and isinstance(stages[0], ImputerModel) and isinstance(stages[1], VectorAssembler)


def with_vectors(rows: DataFrame, stages: Sequence) -> DataFrame:
    """What two fitted input stages add as their vector, made in one expression: no
    column is filled on its own and no row is built of the filled ones."""
    imputer, assembler = stages
    median = imputer.surrogateDF.first().asDict()
    values = [F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(None)), F.lit(median[f])) for f in imputer.getInputCols()]
    return rows.withColumn(assembler.getOutputCol(), array_to_vector(F.array(*values)))


def filled_inputs(rows: DataFrame, features: Sequence[str]) -> tuple[list, DataFrame]:
    """The fitted input stages and the training rows behind them, staged: the passes of
    a fit, and other models of the same rows, read vectors and fill nothing again."""
    imputer, assembler = input_stages(features)
    done = [imputer.fit(medians(rows, features)), assembler]
    return done, staged(with_vectors(training_rows(rows), done).drop(*features))


def fit(rows: DataFrame, features: Sequence[str], spec: ModelSpec, ready: tuple[list, DataFrame] | None = None, **settings) -> PipelineModel:
    """Fit one registered model on training rows; ``ready`` are their :func:`filled_inputs`,
    if there are some already."""
    stages = spec.stages(features, **{**spec.settings, **settings})
    shared = [type(s) for s in stages[:2]] == [Imputer, VectorAssembler]
    done, table = (ready or filled_inputs(rows, features)) if shared else ([], training_rows(rows))
    if spec.family == "linear":
        # the penalty is given per data set, the solver wants it per row
        n = table.count()
        stages[-1].setRegParam(1.0 / (stages[-1].getRegParam() * max(n, 1)))
    if not shared:
        return Pipeline(stages=stages).fit(table)
    return PipelineModel(stages=[*done, *Pipeline(stages=stages[2:]).fit(table).stages])


def _proba(out: DataFrame) -> Column:
    if "probability" in out.columns:
        return vector_to_array("probability")[1]
    if "rawPrediction" in out.columns:
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-vector_to_array("rawPrediction")[1]))
    return F.col("prediction").cast("double")


def score(model, rows: DataFrame, name: str = "proba") -> DataFrame:
    """Add the positive-class probability."""
    stages = getattr(model, "stages", [])
    if _input_pair(stages):
        out = PipelineModel(stages=stages[2:]).transform(with_vectors(rows, stages[:2]))
    else:
        out = model.transform(rows)
    return out.select(*rows.columns, _proba(out).alias(name))


def score_each(fitted: dict[str, PipelineModel], rows: DataFrame) -> DataFrame:
    """Add ``proba_<name>`` of models that share their input stages (one ``ready``): the
    rows are read and their vectors made once."""
    first = next(iter(fitted.values())).stages[:2]
    if not _input_pair(first) or any([s.uid for s in m.stages[:2]] != [s.uid for s in first] for m in fitted.values()):
        raise ValueError("the models do not share their input stages")
    vector, out = first[1].getOutputCol(), with_vectors(rows, first)
    for name, model in fitted.items():
        part = PipelineModel(stages=model.stages[2:]).transform(out)
        out = part.select(*out.columns, _proba(part).alias(f"proba_{name}"))
    return out.drop(vector)


def fit_all(
    rows: DataFrame, splits: DataFrame, features: Sequence[str], names: Sequence[str] | None = None,
    min_detection: float = 0.80, settings: dict[str, dict] | None = None,
) -> tuple[dict[str, PipelineModel], DataFrame, DataFrame]:
    """Train each model on train runs, tune its operating point on validation,
    choose the model by that point, and score test once for the winner.

    Returns the models, the best validation point of each, and the winner's row
    of test scores.  Only those few points reach the driver."""
    usable, _ = available()
    names = list(names or usable)
    train, val, test = (rows_of(rows, splits, s) for s in ("train", "val", "test"))
    ready = filled_inputs(train, features)
    fitted = {n: fit(train, features, usable[n], ready, **(settings or {}).get(n, {})) for n in names}
    kept = ["run_id", "sample_idx", "t_min", "currently_off_spec", "y_breach", "proba"]
    scored = None
    for n, model in fitted.items():
        part = score(model, val).select(*kept).withColumn("model", F.lit(n))
        scored = part if scored is None else scored.unionByName(part)
    scored = staged(scored)
    points = staged(
        alarms.best_points(alarms.sweep(scored, alarms.COARSE_THRESHOLDS, by=["model"]), min_detection, ["model"])
    )
    choice = alarms.choose_model(points, min_detection).first()
    if choice is None:
        # nobody detects enough: best average precision, F1 threshold
        clean = scored.where(F.col("currently_off_spec") == 0)
        winner = scores.ranking_scores(clean, by=["model"]).orderBy(F.desc("average_precision"), "model").first().model
        threshold, delay = scores.pick_threshold(clean.where(F.col("model") == winner)).first().threshold, 1
    else:
        winner, threshold, delay = choice.model, choice.threshold, choice.delay
    result = alarms.evaluate(staged(score(fitted[winner], test).select(*kept)), threshold, delay)
    return fitted, points, result.select(
        F.lit(winner).alias("model"), F.lit(float(threshold)).alias("threshold"), F.lit(int(delay)).alias("delay"), "*"
    )


def native_importance(model: PipelineModel, features: Sequence[str], spark) -> DataFrame | None:
    """The model's own importance per feature (bounded by the feature list), or
    None if it has none."""
    values = getattr(model.stages[-1], "featureImportances", None)
    if values is None:
        return None
    rows = [(f, float(values[i])) for i, f in enumerate(features)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
