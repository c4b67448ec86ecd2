"""Backward-looking features and forward labels of every sample.

All frames share one window over (run, segment), so the whole table costs one
shuffle and one sort; per-run context joins on that same partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runloom.dims import DV_NOMINAL, DV_TAGS, ENVELOPE, MV_TAGS, PEAK_TO_MEAN_RATE, SLEW_LIMITS, with_limits
from runloom.functions.numeric import flag
from runloom.functions.series import deviation_pct, out_of_band, ramp_phase, transition_context
from runloom.functions.sheet import grade_setpoints
from runloom.operators.segments import OWN, SEG, SEGMENT_ROWS, cut, over_runs
from runloom.settings import RunSpec

REMAINING_TAGS = ("stock_flow", "filler_flow", "steam_pressure", "machine_speed")
STEAM_SHARE, STEAM_RESERVE_KPA, SPEED_LIMIT_SHARE = 0.95, 15.0, 0.95


# ---- window primitives ----------------------------------------------------

def lag_padded(x: Column, n: int, w: WindowSpec, order: str = "sample_idx") -> Column:
    """Value ``n`` samples ago; before the run's start its first value."""
    return F.when(F.col(order) >= n, F.lag(x, n).over(w)).otherwise(F.first(x).over(w))


def rate_per_min(x: Column, minutes: float, spec: RunSpec, w: WindowSpec) -> Column:
    return (x - lag_padded(x, spec.steps(minutes), w)) / minutes


def trailing(w: WindowSpec, minutes: float, spec: RunSpec) -> WindowSpec:
    return w.rowsBetween(-(spec.steps(minutes) - 1), 0)


def next_breach(breach: Column, w: WindowSpec, horizon: int, order: str = "sample_idx") -> Column:
    """Position of the first breach within the next ``horizon`` samples."""
    return F.min(F.when(breach, F.col(order))).over(w.rowsBetween(1, horizon))


def breach_labels(
    samples: DataFrame, spec: RunSpec, breach: Column, size: int = SEGMENT_ROWS
) -> DataFrame:
    """``y_breach``: a breach lies ahead within the horizon (0 near the end);
    ``y_time_to_breach_min``: minutes to it; ``horizon_complete``: the whole
    horizon lies inside the run."""

    def build(rows, w):
        gap = next_breach(F.col("_b"), w, spec.horizon) - F.col("sample_idx")
        return (
            rows.withColumn("_gap", gap)
            .withColumn("horizon_complete", F.lead("sample_idx", spec.horizon).over(w).isNotNull())
            .withColumn("y_breach", F.col("_gap").isNotNull().cast("int"))
            .withColumn("y_time_to_breach_min", F.col("_gap") * spec.dt_s / 60.0)
            .drop("_gap", "_b")
        )

    return over_runs(samples.withColumn("_b", breach), build, ahead=spec.horizon, size=size)


# ---- per-run context ------------------------------------------------------

def grade_rejects(meta: DataFrame, grades: DataFrame) -> DataFrame:
    """Runs whose grades are missing from the grade table, one row per run and end
    (``from_grade``, ``to_grade``): the check to run before building features."""
    ends = meta.select("run_id", F.explode(F.array(*[F.struct(F.lit(c).alias("end"), F.col(c).alias("code")) for c in ("from_grade", "to_grade")])).alias("_e"))
    return ends.select("run_id", "_e.*").join(grades.select("code"), "code", "left_anti").select("run_id", "end", "code")


def _or_error(found: str, kind: str, key: str) -> Column:
    """The joined value; a missing one stops the job and names the key."""
    told = F.concat(F.lit(f"unknown {kind}: "), F.coalesce(F.col(key).cast("string"), F.lit("NULL")))
    return F.coalesce(F.col(found), F.raise_error(told))


def feasible_ramp(meta: DataFrame, grades: DataFrame) -> DataFrame:
    """Shortest ramp the actuator limits of the destination grade permit, the
    actuator that sets it (first listed wins a tie, '' if nothing has to move) and
    how far the planned ramp falls short."""
    grades = with_limits(grades)
    mv = F.struct(*[v.alias(k) for k, v in grade_setpoints().items()])
    a = grades.select(F.col("code").alias("from_grade"), mv.alias("_mv_from"))
    b = grades.select(
        F.col("code").alias("to_grade"), mv.alias("_mv_to"),
        F.struct(*[F.col(f"max_{tag}_rate").alias(tag) for tag in SLEW_LIMITS]).alias("_rate"),
    )
    needs = F.array(
        *[
            F.expr(
                f"named_struct('minutes', if(_rate.{tag} > 0, abs(_mv_to.{tag} - _mv_from.{tag}) / _rate.{tag} * {PEAK_TO_MEAN_RATE}D, 0D), "
                f"'place', {-i}, 'tag', '{tag}')"
            )
            for i, tag in enumerate(SLEW_LIMITS)
        ]
    )
    floor = F.col("_worst")["minutes"]
    return (
        meta.join(a, "from_grade", "left")
        .join(b, "to_grade", "left")
        .withColumns({"_mv_from": _or_error("_mv_from", "grade", "from_grade"), "_mv_to": _or_error("_mv_to", "grade", "to_grade")})
        .withColumn("_worst", F.array_max(needs))
        .withColumn("min_ramp_min", floor)
        .withColumn("binding_actuator", F.when(floor > 0, F.col("_worst")["tag"]).otherwise(""))
        .withColumn("ramp_is_feasible", flag(F.col("plan_ramp_min") >= floor - 1e-9))
        .withColumn("ramp_deficit_min", F.greatest(floor - F.col("plan_ramp_min"), F.lit(0.0)))
        .drop("_worst", "_mv_from", "_mv_to", "_rate")
    )


def run_context(meta: DataFrame, grades: DataFrame) -> DataFrame:
    """Everything constant within a run: transition size, plan, feasibility, the
    destination setpoints (``goal_*``) and limits (``rate_*``, ``stock_hi``)."""
    grades = with_limits(grades)
    targets = ["basis_weight", "moisture", "ash", "machine_speed"]
    limits = [*[f"{tag}_limits" for tag in ENVELOPE], *[f"max_{tag}_rate" for tag in SLEW_LIMITS]]
    a = grades.select(F.col("code").alias("from_grade"), *[F.col(c).alias(f"a_{c}") for c in targets])
    b = grades.select(F.col("code").alias("to_grade"), *[F.col(c).alias(f"b_{c}") for c in [*targets, *limits]])
    goal = grade_setpoints("b_")
    return (
        feasible_ramp(meta, grades)  # stops at an unknown grade
        .join(a, "from_grade", "left")
        .join(b, "to_grade", "left")
        .select(
            "run_id", "from_grade", "to_grade", "primary_cause", "plan_ramp_min", "plan_lead_scale",
            "plan_tau_c_scale", flag(F.col("plan_trim_enabled")).alias("plan_trim_enabled"),
            "plan_start_min", "min_ramp_min", "ramp_deficit_min", "ramp_is_feasible",
            *[c.alias(n) for n, c in transition_context("a_", "b_").items()],
            *[goal[tag].alias(f"goal_{tag}") for tag in REMAINING_TAGS],
            *[F.col(f"b_max_{tag}_rate").alias(f"rate_{tag}") for tag in SLEW_LIMITS],
            F.col("b_stock_flow_limits.hi").alias("stock_hi"),
        )
    )


# ---- the wide table -------------------------------------------------------

# look-backs of the wide table: name, minutes and the series that use it
STATE_SERIES = ["basis_weight", "basis_weight_sp", "moisture", "ash"]
TRACKED = ["bw_dev_pct", *STATE_SERIES, *MV_TAGS, *DV_TAGS]
LOOKBACKS: dict[str, tuple[float, list[str]]] = {
    "half": (0.5, ["bw_dev_pct", *MV_TAGS]),
    "one": (1.0, ["bw_dev_pct", *STATE_SERIES, *MV_TAGS]),
    "two": (2.0, ["bw_dev_pct", *DV_TAGS]),
}
RATES = [f"_{which}_{tag}" for which, (_, tags) in LOOKBACKS.items() for tag in tags]
TRAILING = ["bw_dev_max_2min", "bw_dev_std_2min", "bw_dev_mean_2min"]


def with_deviation(samples: DataFrame) -> DataFrame:
    dev = deviation_pct(F.col("basis_weight"), F.col("basis_weight_sp"))
    return samples.withColumn("bw_dev_pct", dev).withColumn("bw_abs_dev_pct", F.abs(F.col("bw_dev_pct")))


def windowed_state(samples: DataFrame, spec: RunSpec, size: int = SEGMENT_ROWS) -> DataFrame:
    """Samples past the warm-up with their rates, trailing statistics and the
    gap to the next breach; still carries the segment they were computed in."""
    two = spec.steps(2.0)
    rows = cut(with_deviation(samples), back=two, ahead=spec.horizon, size=size)
    w = W.partitionBy("run_id", SEG).orderBy("sample_idx")
    # one struct of its series per look-back instead of one window expression per series
    last_two = trailing(w, 2.0, spec)
    breach = out_of_band(F.col("bw_dev_pct"), spec.band_pct)
    rows = rows.select(
        "*",
        F.first(F.struct(*TRACKED)).over(w).alias("_start"),
        *[F.lag(F.struct(*tags), spec.steps(m)).over(w).alias(f"_{which}") for which, (m, tags) in LOOKBACKS.items()],
        F.max("bw_abs_dev_pct").over(last_two).alias("bw_dev_max_2min"),
        F.coalesce(F.stddev_samp("bw_dev_pct").over(last_two), F.lit(0.0)).alias("bw_dev_std_2min"),
        F.avg("bw_dev_pct").over(last_two).alias("bw_dev_mean_2min"),
        (next_breach(breach, w, spec.horizon) - F.col("sample_idx")).alias("_gap"),
    ).where(F.col(OWN) & (F.col("sample_idx") >= spec.warmup))
    rates = [
        f"({tag} - if(sample_idx >= {spec.steps(m)}, _{which}.{tag}, _start.{tag})) / {m}D AS _{which}_{tag}"
        for which, (m, tags) in LOOKBACKS.items()
        for tag in tags
    ]
    return rows.selectExpr(*samples.columns, "bw_dev_pct", "bw_abs_dev_pct", *TRAILING, "_gap", SEG, *rates)


def feature_expressions(spec: RunSpec) -> dict[str, str | Column]:
    """The 104 features over samples that carry rates and run context.  Stateless,
    so batch and stream share it."""
    band = f"{spec.band_pct}D"
    c = F.col
    f: dict[str, str | Column] = dict(ramp_phase(c("t_min"), c("plan_start_min"), c("plan_ramp_min")))
    for name in ("bw_from", "bw_to", "bw_change_pct", "ash_change", "moisture_change", "speed_change_pct",
                 "transition_magnitude", "plan_ramp_min", "plan_lead_scale", "plan_tau_c_scale",
                 "plan_trim_enabled", "min_ramp_min", "ramp_deficit_min", "ramp_is_feasible",
                 "bw_dev_pct", "bw_abs_dev_pct", "caliper", *TRAILING):
        f[name] = name
    f |= {
        "currently_off_spec": f"double(bw_abs_dev_pct > {band})",
        "bw_dev_headroom_pct": f"{band} - bw_abs_dev_pct",
        "moisture_dev": "moisture - moisture_sp",
        "ash_dev": "ash - ash_sp",
        "bw_dev_roc_0_5min": "_half_bw_dev_pct",
        "bw_dev_roc_1min": "_one_bw_dev_pct",
        "bw_dev_roc_2min": "_two_bw_dev_pct",
        "bw_roc_1min": "_one_basis_weight",
        "bw_sp_roc_1min": "_one_basis_weight_sp",
        "moisture_roc_1min": "_one_moisture",
        "ash_roc_1min": "_one_ash",
    }
    projected = f"bw_dev_pct + _one_bw_dev_pct * {spec.horizon_min}D"
    f |= {
        "bw_dev_projected": projected,
        "bw_dev_projected_abs": f"abs({projected})",
        "projected_breach": f"double(abs({projected}) > {band})",
    }
    for tag in MV_TAGS:
        f[f"mv_{tag}"] = tag
        f[f"mv_{tag}_roc_1min"] = f"_one_{tag}"
        f[f"mv_{tag}_slew_util"] = f"abs(_half_{tag}) / greatest(rate_{tag}, 1e-9D)"
    for tag in REMAINING_TAGS:
        f[f"mv_{tag}_remaining"] = f"goal_{tag} - {tag}"
        f[f"mv_{tag}_remaining_frac"] = f"(goal_{tag} - {tag}) / greatest(abs(goal_{tag}), 1e-9D)"
    room = f"steam_header_kpa * {STEAM_SHARE}D - steam_pressure"
    f |= {
        "steam_headroom_kpa": room,
        "steam_saturated": f"double({room} < {STEAM_RESERVE_KPA}D)",
        "stock_headroom": "stock_hi - stock_flow",
        "speed_at_limit": f"double(abs(_half_machine_speed) > {SPEED_LIMIT_SHARE}D * rate_machine_speed)",
    }
    for tag in DV_TAGS:
        nominal = DV_NOMINAL[tag]
        f[f"dv_{tag}"] = tag
        f[f"dv_{tag}_dev"] = f"{tag} - {nominal}D"
        f[f"dv_{tag}_dev_norm"] = f"({tag} - {nominal}D) / {max(abs(nominal), 1e-9)}D"
        f[f"dv_{tag}_roc_2min"] = f"_two_{tag}"
    return f


def as_columns(expressions: dict[str, str | Column]) -> list[Column]:
    return [(F.expr(e) if isinstance(e, str) else e).alias(name) for name, e in expressions.items()]


IDENTIFIERS = ("run_id", "sample_idx", "t_min", "from_grade", "to_grade", "primary_cause")


def wide_features(
    samples: DataFrame, meta: DataFrame, grades: DataFrame, spec: RunSpec, size: int = SEGMENT_ROWS,
) -> DataFrame:
    """104 features, two labels and the identifiers of every sample past the
    warm-up."""
    rows = windowed_state(samples, spec, size)
    # Context joins on (run, segment): the samples are not shuffled again.
    if "n_samples" in meta.columns:
        spans = meta.select("run_id", (F.col("n_samples") - 1).alias("_last"))
    else:
        spans = samples.groupBy("run_id").agg(F.max("sample_idx").alias("_last"))
    context = (
        run_context(meta, grades)
        .join(spans, "run_id")
        .withColumn(SEG, F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("_last") / F.lit(size)))))
        .drop("_last")
    )
    joined = rows.join(context.withColumn("_known", F.lit(True)), ["run_id", SEG], "left")
    told = F.raise_error(F.concat(F.lit("unknown run: "), F.col("run_id").cast("string")))
    run = F.when(F.col("_known"), F.col("run_id")).otherwise(told.cast(samples.schema["run_id"].dataType))
    return joined.withColumn("run_id", run).select(
        *IDENTIFIERS,
        *as_columns(feature_expressions(spec)),
        F.col("_gap").isNotNull().cast("int").alias("y_breach"),
        (F.col("_gap") * spec.dt_s / 60.0).alias("y_time_to_breach_min"),
    )
