"""Quantile cone of the future deviation: boosted trees under the pinball loss.

One model per horizon and quantile, all grown together (``boosting``), so the width of
the cone follows the inputs.  Early stopping looks at a seeded share of whole training
runs, because samples of a run are not exchangeable."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.operators.boosting import QuantileModel, fit_quantiles, predict_quantiles
from runloom.operators.models import training_rows
from runloom.operators.splits import rows_of
from runloom.operators.targets import sorted_quantiles, target_name
from runloom.settings import ForecastSpec


def column(q: float) -> str:
    return f"q{int(round(q * 100))}"


@dataclass
class Cone:
    spec: ForecastSpec
    model: QuantileModel


def fit_cone(rows: DataFrame, splits: DataFrame, features: Sequence[str], spec: ForecastSpec = ForecastSpec(), **settings) -> Cone:
    """Models of every horizon and quantile from the training runs.  Rows without a
    horizon's target are left out of that horizon; ``settings`` go to ``fit_quantiles``."""
    train = training_rows(rows_of(rows, splits, "train"))
    names = [target_name(h) for h in spec.horizons_min]
    seen = train.agg(*[F.count(y).alias(y) for y in names]).first()
    for h, y in zip(spec.horizons_min, names):
        if not seen[y]:
            raise ValueError(f"no training rows with a target {h} min ahead")
    return Cone(spec, fit_quantiles(train, features, names, sorted(spec.quantiles), "early_stop", **settings))


def predict_cone(cone: Cone, rows: DataFrame, keys: Sequence[str] = ("run_id", "sample_idx")) -> DataFrame:
    """Long cone: one row per sample and horizon, quantiles in order, with the
    actual where the rows carry it.  Every row is predicted once for all horizons."""
    names = [column(q) for q in sorted(cone.spec.quantiles)]
    targets = {h: target_name(h) for h in cone.spec.horizons_min}
    rows = rows.withColumns({y: F.lit(None).cast("double") for y in targets.values() if y not in rows.columns})
    wide = predict_quantiles(cone.model, rows, [*keys, *targets.values()], lambda t, q: f"_{t}_{column(q)}")
    each = [
        F.struct(F.lit(float(h)).alias("horizon_min"), F.col(y).cast("double").alias("actual"), *[F.col(f"_{y}_{c}").alias(c) for c in names])
        for h, y in targets.items()
    ]
    long = wide.select(*keys, F.explode(F.array(*each)).alias("_c")).select(*keys, "_c.*")
    return long.select(*keys, "horizon_min", "actual", *sorted_quantiles(names))
