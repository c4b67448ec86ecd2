"""Outcome labels of whole runs and the health report of a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runloom.functions.numeric import flag
from runloom.functions.series import deviation_pct, out_of_band
from runloom.operators.ordered import exact_percentiles
from runloom.operators.segments import SEG, SEGMENT_ROWS, over_runs, per_segment
from runloom.settings import RunSpec


def mark_settled(
    samples: DataFrame, spec: RunSpec, value: str, target: Column, size: int = SEGMENT_ROWS, constants: DataFrame | None = None
) -> DataFrame:
    """Add ``settled_here``: the last ``dwell`` samples all lay inside the
    settle tolerance of the final target.  ``constants`` (run_id, n_samples and more)
    joins per-run values on (run, segment), where the samples already are."""
    inside = (F.abs(F.col(value) - target) <= target * spec.settle_tol_pct / 100.0).cast("int")

    def build(rows, w):
        if constants is not None:
            rows = rows.join(per_segment(constants, size), ["run_id", SEG], "left")
        rows = rows.withColumn("_inside", inside)
        frame = w.rowsBetween(-(spec.dwell - 1), 0)
        held = (F.min("_inside").over(frame) == 1) & (F.count(F.lit(1)).over(frame) == spec.dwell)
        return rows.withColumn("settled_here", F.coalesce(held, F.lit(False))).drop("_inside")

    return over_runs(samples, build, back=spec.dwell - 1, size=size)


def settle_minutes(spec: RunSpec, start_min: Column) -> Column:
    """Aggregate: minutes from ramp start to the first settled streak that began
    at or after it; NULL if there is none."""
    begin = F.col("sample_idx") - (spec.dwell - 1)
    start_idx = F.bround(start_min * 60.0 / spec.dt_s).cast("int")
    first = F.min(F.when(F.col("settled_here") & (begin >= start_idx), begin))
    return first * spec.dt_s / 60.0 - F.first(start_min)


def run_labels(
    samples: DataFrame,
    spec: RunSpec,
    value: str = "basis_weight",
    setpoint: str = "basis_weight_sp",
    target: str = "final_target",
    start_min: str = "plan_start_min",
    moisture: tuple[str, str] | None = ("moisture", "moisture_sp"),
    ash: tuple[str, str] | None = ("ash", "ash_sp"),
    size: int = SEGMENT_ROWS,
    constants: DataFrame | None = None,
) -> DataFrame:
    """One row of outcome labels per run.  ``target`` and ``start_min`` are per-run
    constants, in the samples or in ``constants`` (run_id, n_samples and these)."""
    dev = deviation_pct(F.col(value), F.col(setpoint))
    off = out_of_band(dev, spec.band_pct)
    step = F.lit(spec.dt_s) / 60.0

    def minutes(condition: Column) -> Column:
        return F.sum(condition.cast("int")) * step

    aggs = [
        flag(F.max(off.cast("int")) == 1).alias("off_spec"),
        minutes(off).alias("off_spec_minutes"),
        F.max(F.abs(dev)).alias("max_abs_dev_pct"),
        F.avg(F.abs(dev)).alias("mean_abs_dev_pct"),
        (F.min(F.when(off, F.col("sample_idx"))) * spec.dt_s / 60.0).alias("first_breach_min"),
        settle_minutes(spec, F.col(start_min)).alias("settle_min"),
        F.max_by(F.col(value) - F.col(target), F.col("sample_idx")).alias("final_bw_error"),
        F.count(F.lit(1)).alias("n_samples"),
    ]
    for name, pair, band in (("moisture", moisture, spec.moisture_band), ("ash", ash, spec.ash_band)):
        if pair:
            wide = F.abs(F.col(pair[0]) - F.col(pair[1])) > band
            aggs.append(minutes(wide).alias(f"{name}_off_spec_min"))
    marked = mark_settled(samples, spec, value, F.col(target), size, constants)
    return marked.groupBy("run_id").agg(*aggs).withColumn("settled", flag(F.col("settle_min").isNotNull()))


# Plausible range of each measured series and of the corpus rates.
SERIES_RANGES = {"basis_weight": (5.0, 400.0), "moisture": (0.5, 30.0), "ash": (-0.1, 60.0)}
OFF_SPEC_RATE = (0.15, 0.75)
MIN_SETTLED_RATE = 0.70


def run_violations(
    samples: DataFrame, labels: DataFrame, spec: RunSpec, ranges: dict[str, tuple[float, float]] | None = None
) -> DataFrame:
    """First broken rule of each bad run: non-finite values, a series outside
    its range, or an off-spec label that disagrees with the series."""
    ranges = ranges or SERIES_RANGES
    dev = deviation_pct(F.col("basis_weight"), F.col("basis_weight_sp"))

    def bad(c: Column) -> Column:
        return c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))

    main = F.col("basis_weight")
    aggs = [
        F.max(bad(main).cast("int")).alias("n_bad"),
        flag(F.max(out_of_band(dev, spec.band_pct).cast("int")) == 1).alias("recomputed"),
    ]
    for tag in ranges:
        aggs += [F.min(tag).alias(f"{tag}_lo"), F.max(tag).alias(f"{tag}_hi")]
    seen = samples.groupBy("run_id").agg(*aggs).join(labels.select("run_id", "off_spec"), "run_id")
    rule = F.when(F.col("n_bad") == 1, "non_finite")
    for tag, (lo, hi) in ranges.items():
        rule = rule.when((F.col(f"{tag}_lo") < lo) | (F.col(f"{tag}_hi") > hi), f"{tag}_range")
    rule = rule.when(F.col("recomputed") != F.col("off_spec"), "label_mismatch")
    return seen.select("run_id", rule.alias("rule")).where(F.col("rule").isNotNull())


def health_report(labels: DataFrame, meta: DataFrame, violations: DataFrame) -> DataFrame:
    """One row: rates, median settle time, distinct transitions and the first
    violation found."""
    rates = labels.agg(
        F.count(F.lit(1)).alias("n_runs"),
        F.avg("off_spec").alias("off_spec_rate"),
        F.avg("settled").alias("settled_rate"),
        F.avg("off_spec_minutes").alias("mean_off_spec_minutes"),
    )
    median = exact_percentiles(labels, "settle_min", {"median_settle_min": 0.5})
    pairs = meta.select("from_grade", "to_grade").distinct().agg(F.count(F.lit(1)))
    first = violations.agg(F.min(F.struct("run_id", "rule")))
    lo, hi = OFF_SPEC_RATE
    corpus_bad = (~F.col("off_spec_rate").between(lo, hi)).cast("int") + (
        F.col("settled_rate") < MIN_SETTLED_RATE
    ).cast("int")
    return (
        rates.withColumn("median_settle_min", median.select("median_settle_min").scalar())
        .withColumn("distinct_grade_pairs", pairs.scalar())
        .withColumn("_first", first.scalar())
        .withColumn("first_bad_run", F.col("_first.run_id").cast("double"))
        .withColumn("first_bad_rule", F.col("_first.rule"))
        .withColumn("n_issues", corpus_bad + F.col("_first").isNotNull().cast("int"))
        .withColumn("ok", F.col("n_issues") == 0)
        .drop("_first")
    )


def cause_counts(meta: DataFrame, cause: str = "primary_cause") -> DataFrame:
    return meta.groupBy(cause).agg(F.count(F.lit(1)).alias("n_runs")).orderBy(F.desc("n_runs"), cause)
