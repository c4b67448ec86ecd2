"""Forecast targets, scores of a quantile forecast, and its rearrangement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runloom.operators.segments import SEGMENT_ROWS, over_runs
from runloom.settings import ForecastSpec, RunSpec


def target_name(horizon_min: float) -> str:
    return f"y_fwd_{horizon_min:g}min".replace(".", "_")


def forward_targets(
    samples: DataFrame, spec: RunSpec, horizons_min: Sequence[float] = ForecastSpec().horizons_min,
    deviation: str = "bw_dev_pct", size: int = SEGMENT_ROWS,
) -> DataFrame:
    """Signed deviation ``h`` minutes later in the same run; NULL past its end."""
    steps = {h: spec.steps(h, at_least=0) for h in horizons_min}

    def build(rows, w):
        return rows.select(
            "*", *[F.lead(deviation, n).over(w).alias(target_name(h)) for h, n in steps.items()]
        )

    return over_runs(samples, build, ahead=max(steps.values()), size=size)


def forward_lookup(
    rows: DataFrame, series: DataFrame, spec: RunSpec, horizons_min: Sequence[float] = ForecastSpec().horizons_min,
    deviation: str = "bw_dev_pct",
) -> DataFrame:
    """The same targets when rows or samples have gaps: an equi-join on
    (run, position + h), which spreads a long run over all tasks."""
    out = rows
    for h in horizons_min:
        ahead = series.select(
            "run_id",
            (F.col("sample_idx") - spec.steps(h, at_least=0)).alias("sample_idx"),
            F.col(deviation).alias(target_name(h)),
        )
        out = out.join(ahead, ["run_id", "sample_idx"], "left")
    return out


def pinball(actual: Column, predicted: Column, q: float) -> Column:
    gap = actual - predicted
    return F.greatest(gap * q, gap * (q - 1.0))


def sorted_quantiles(columns: Sequence[str]) -> list[Column]:
    """Predictions of one row re-ordered so that they never cross."""
    ordered = F.array_sort(F.array(*[F.col(c) for c in columns]))
    return [ordered[i].alias(c) for i, c in enumerate(columns)]


def forecast_scores(
    cone: DataFrame, quantiles: Sequence[float] = ForecastSpec().quantiles, by: Sequence[str] = ("horizon_min",)
) -> DataFrame:
    """``cone``: one row per sample and horizon with ``actual`` and one column
    ``q<percent>`` per quantile; rows without an actual are left out."""
    qs = sorted(quantiles)
    names = {q: f"q{int(round(q * 100))}" for q in qs}
    lo, mid, hi = (F.col(names[q]) for q in (qs[0], qs[len(qs) // 2], qs[-1]))
    actual = F.col("actual")
    return (
        cone.where(actual.isNotNull())
        .groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(F.abs(actual - mid)).alias("mae_median"),
            F.sqrt(F.avg((actual - mid) * (actual - mid))).alias("rmse_median"),
            F.avg(((actual >= lo) & (actual <= hi)).cast("double")).alias("interval_coverage"),
            F.lit(qs[-1] - qs[0]).alias("nominal_coverage"),
            F.avg(hi - lo).alias("mean_interval_width"),
            *[F.avg(pinball(actual, F.col(names[q]), q)).alias(f"pinball_{names[q]}") for q in qs],
        )
    )
