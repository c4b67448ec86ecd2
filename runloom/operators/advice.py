"""Pricing, gating and ranking advice; best plan and knob sensitivity from tables
of tried outcomes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runloom.dims import SOURCE_LABELS
from runloom.functions.numeric import clip
from runloom.functions.sheet import WIRE_WIDTH_M
from runloom.operators.ordered import exact_percentiles
from runloom.settings import ECONOMICS_BOUNDS, Economics, PlanBounds, SurfacePolicy

TWIN_CONFIDENCE = 0.75  # fixed value: trust in simulated improvements


def tonnes_per_min(speed: Column, weight: Column) -> Column:
    return speed * WIRE_WIDTH_M * weight / 1.0e6


def price(
    rows: DataFrame, economics: Economics = Economics(), minutes: str = "avoided_min",
    speed: str = "machine_speed", weight: str = "basis_weight", confidence: str = "confidence", cost: str = "cost_usd",
) -> tuple[DataFrame, DataFrame]:
    """Priced rows, and the rejects whose confidence is outside [0, 1].

    Minutes below zero are worth nothing but are reported as given; the band is
    ordered even when the cost turns the estimate negative."""
    sure = F.coalesce(F.col(confidence).between(0.0, 1.0), F.lit(False))
    tonnes = F.greatest(F.col(minutes), F.lit(0.0)) * tonnes_per_min(F.col(speed), F.col(weight))
    point = F.col(confidence) * (tonnes * economics.per_tonne) - F.coalesce(F.col(cost), F.lit(0.0))
    low, high = point * economics.low_multiplier, point * economics.high_multiplier
    priced = rows.where(sure).select(
        "*",
        tonnes.alias("avoided_tonnes"),
        point.alias("value_usd"),
        F.least(low, high).alias("low_usd"),
        F.greatest(low, high).alias("high_usd"),
        (point * economics.annual_changes).alias("annual_usd"),
    )
    return priced, rows.where(~sure)


def price_comparison(rows: DataFrame, base: str, improved: str, economics: Economics = Economics(), **columns) -> tuple[DataFrame, DataFrame]:
    """Price the off-spec minutes an improved plan saves; a worse plan saves 0."""
    saved = F.greatest(F.col(base) - F.col(improved), F.lit(0.0))
    return price(rows.withColumn("avoided_min", saved), economics, **columns)


def surfaced_only(priced: DataFrame, policy: SurfacePolicy = SurfacePolicy()) -> DataFrame:
    return priced.where(
        (F.col("value_usd") >= policy.min_value_usd) & (F.col("confidence") >= policy.min_confidence)
    )


def rank_and_gate(
    advice: DataFrame, context: Sequence[str], policy: SurfacePolicy = SurfacePolicy(), ident: str = "id"
) -> DataFrame:
    """At most ``max_shown`` rows per operator context: priced advice first by
    value, then by confidence; unpriced advice is judged on confidence alone."""
    passed = advice.where(
        (F.col("confidence") >= policy.min_confidence)
        & (F.col("value_usd").isNull() | (F.col("value_usd") >= policy.min_value_usd))
    )
    order = W.partitionBy(*context).orderBy(F.desc_nulls_last("value_usd"), F.desc("confidence"), ident)
    # row_number <= k is applied before the shuffle as well, so a context with
    # very many candidates sends only its best few
    return passed.withColumn("place", F.row_number().over(order)).where(F.col("place") <= policy.max_shown)


def source_label(source: Column) -> Column:
    label = F.lit(None).cast("string")
    for code, text in SOURCE_LABELS.items():
        label = F.when(source == code, text).otherwise(label)
    return F.coalesce(label, source)


ADVICE_COLUMNS = ("run_id", "id", "title", "source", "source_label", "confidence", "explanation", "value_usd", "detail")


def advisory(
    rows: DataFrame, ident: Column, title: Column, source: Column, confidence: Column, explanation: Column,
    value: Column | None = None, detail: Sequence[str] = (),
) -> DataFrame:
    """Any kind of advice in the one common shape."""
    pairs = [x for name in detail for x in (F.lit(name), F.col(name).cast("string"))]
    return rows.select(
        "run_id", ident.alias("id"), title.alias("title"), source.alias("source"),
        source_label(source).alias("source_label"), confidence.alias("confidence"), explanation.alias("explanation"),
        (value if value is not None else F.lit(None).cast("double")).alias("value_usd"),
        (F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")).alias("detail"),
    )


def union_advice(first: DataFrame, *others: DataFrame) -> DataFrame:
    for other in others:
        first = first.unionByName(other, allowMissingColumns=True)
    return first


def portfolio_value(values: DataFrame, value: str = "value_usd", economics: Economics = Economics()) -> DataFrame:
    """Mean value per run times the yearly number of changes; 0 without runs."""
    return values.agg(
        (F.coalesce(F.avg(value), F.lit(0.0)) * economics.annual_changes).alias("annual_value_usd")
    )


# ---- tried plans ----------------------------------------------------------

def _plans(
    outcomes: DataFrame, run: str, order: Sequence[str], objective: str, feasible: Column, measures: Sequence[str], baseline: str
) -> DataFrame:
    kept = F.struct(*order, *measures)
    is_base = F.col(baseline)
    best_key = F.when(feasible, F.struct(F.col(objective).alias("_o"), *order))
    return outcomes.groupBy(run).agg(
        F.max_by(kept, F.when(is_base, F.lit(1))).alias("_base"),
        F.max(F.when(is_base, feasible.cast("int"))).alias("_base_ok"),
        F.min_by(F.when(feasible, kept), best_key).alias("_best"),
        F.count(F.lit(1)).alias("n_evaluations"),
    )


def best_plan(
    outcomes: DataFrame, run: str, order: Sequence[str], objective: str, feasible: Column, measures: Sequence[str],
    baseline: str = "is_baseline",
) -> DataFrame:
    """Per run: the feasible outcome with the lowest objective (the earlier one
    wins a tie) against the baseline; ``source`` tells whether the baseline itself
    broke the recipe limit.  Runs without one of the two are in :func:`best_plan_rejects`."""
    out = _plans(outcomes, run, order, objective, feasible, measures, baseline)
    return out.where(F.col("_best").isNotNull() & F.col("_base").isNotNull()).select(
        run,
        *[F.col("_base")[m].alias(f"base_{m}") for m in measures],
        *[F.col("_best")[m].alias(f"best_{m}") for m in measures],
        *[(F.col("_base")[m] - F.col("_best")[m]).alias(f"saved_{m}") for m in measures],
        "n_evaluations",
        F.when(F.col("_base_ok") == 1, "PHYSICS_MODEL").otherwise("RECIPE_LIMIT").alias("source"),
    )


def best_plan_rejects(
    outcomes: DataFrame, run: str, order: Sequence[str], objective: str, feasible: Column, measures: Sequence[str],
    baseline: str = "is_baseline",
) -> DataFrame:
    """Runs that :func:`best_plan` can't judge: without a baseline to compare with, or
    without a feasible plan."""
    base, best = F.col("_base").isNotNull(), F.col("_best").isNotNull()
    out = _plans(outcomes, run, order, objective, feasible, measures, baseline).where(~(base & best))
    reason = F.when(base, "no feasible plan").when(best, "no baseline").otherwise("no baseline and no feasible plan")
    return out.select(run, "n_evaluations", reason.alias("reason"))


def _tries(knob: str, lo: Column, hi: Column, n: int) -> Column:
    """``n`` evenly spaced values of one knob; just ``lo`` for an empty range."""
    step = (hi - lo) / float(max(n - 1, 1))
    spaced = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: lo + i * step)
    values = F.when(hi <= lo, F.array(lo)).otherwise(spaced)
    return F.transform(values, lambda v: F.struct(F.lit(knob).alias("knob"), v.alias("value")))


def candidate_grid(
    plans: DataFrame, knobs: Sequence[str], bounds: PlanBounds = PlanBounds(), per_knob: int = 7, round_no: int = 0,
    floor_min: str | None = None,
) -> DataFrame:
    """One search round around each baseline: ``per_knob`` evenly spaced values
    of one knob at a time, bounds narrowed around the baseline from round 1 on.
    ``floor_min`` names a column that lifts the lower ramp bound."""
    tries = []
    for knob in knobs:
        lo, hi = (F.lit(v) for v in bounds.search[knob])
        if knob == "ramp_min" and floor_min:
            lo = F.greatest(lo, F.col(floor_min))
            hi = F.greatest(hi, lo + 1e-6)
        for _ in range(round_no):
            half = (hi - lo) * bounds.shrink / 2.0
            lo, hi = F.greatest(lo, F.col(knob) - half), F.least(hi, F.col(knob) + half)
        tries.append(_tries(knob, lo, hi, per_knob))
    grid = plans.select("*", F.explode(F.concat(*tries)).alias("_t")).select("*", "_t.knob", "_t.value").drop("_t")
    return grid.select(
        *[F.when(F.col("knob") == k, F.col("value")).otherwise(F.col(k)).alias(f"try_{k}") for k in knobs],
        *plans.columns, "knob", "value",
    )


def clip_plan(plans: DataFrame, bounds: PlanBounds = PlanBounds()) -> DataFrame:
    return plans.withColumns({k: clip(F.col(k), lo, hi) for k, (lo, hi) in bounds.recipe.items() if k in plans.columns})


def sensitivity(
    rows: DataFrame, window_min: float, unit: Sequence[str] = ("run_id", "parameter"), order: str = "place"
) -> DataFrame:
    """Per run and parameter, from tried changes (``delta``, ``settle_min``,
    NULL = never settled; the baseline has delta 0): the steepest slope, the best
    of all tries and the baseline, and the minutes it gains.  The earlier try wins
    a tie, the baseline loses it."""
    rows = rows.withColumn("_s", F.coalesce("settle_min", F.lit(float(window_min))))
    base = rows.where(F.col("delta") == 0).groupBy(*unit).agg(
        F.max("_s").alias("baseline_settle_min"), F.max("base_value").alias("baseline_value")
    )
    b, slope = F.col("baseline_settle_min"), F.col("_slope")
    tried = (
        rows.where(F.col("delta") != 0)
        .join(base, list(unit))
        .withColumn("_slope", (F.col("_s") - b) / F.col("delta"))
        .groupBy(*unit, "baseline_value", "baseline_settle_min")
        .agg(
            F.max_by(slope, F.struct(F.abs(slope), -F.col(order))).alias("sensitivity_min_per_unit"),
            F.min(F.struct(F.col("_s").alias("s"), F.col(order).alias("o"), F.col("delta").alias("d"))).alias("_best"),
        )
    )
    better = F.col("_best.s") <= b
    delta = F.when(better, F.col("_best.d")).otherwise(0.0)
    settle = F.least(F.col("_best.s"), b)
    return tried.select(
        *unit, "baseline_value", "baseline_settle_min", "sensitivity_min_per_unit",
        F.when(delta > 0, "increase").when(delta < 0, "decrease").otherwise("none").alias("best_direction"),
        delta.alias("best_delta"), settle.alias("best_settle_min"), (b - settle).alias("improvement_min"),
    )


def sensitivity_rejects(rows: DataFrame, unit: Sequence[str] = ("run_id", "parameter")) -> DataFrame:
    """Units that :func:`sensitivity` can't rank: without a baseline or a probe."""
    baseline, probe = F.bool_or(F.col("delta") == 0), F.bool_or(F.col("delta") != 0)
    return (
        rows.groupBy(*unit)
        .agg(F.count(F.lit(1)).alias("n_tries"), baseline.alias("_b"), probe.alias("_p"))
        .where(~(F.col("_b") & F.col("_p")))
        .select(*unit, "n_tries", F.when(F.col("_b"), "no probe").otherwise("no baseline").alias("reason"))
    )


def improvement_summary(rows: DataFrame, saved: str, value: str, source: str = "source", least: float = 1e-6) -> DataFrame:
    """Success rate, spread of the minutes saved, value totals, counts by source;
    rows without an outcome count as skipped."""
    kept = rows.where(F.col(saved).isNotNull())
    spread = exact_percentiles(
        kept, saved, {"median_saved": 0.5, "p95_saved": 0.95, "max_saved": 1.0},
        totals={
            "n_evaluated": F.count(F.lit(1)), "n_success": F.count_if(F.col(saved) > least),
            "n_recipe_limit": F.count_if(F.col(source) == "RECIPE_LIMIT"), "sum_saved": F.sum(saved),
            "total_value_usd": F.sum(value),
        },
    )
    money = exact_percentiles(kept, value, {"median_value_usd": 0.5, "p95_value_usd": 0.95})
    n = F.col("n_evaluated")
    skipped = rows.agg(F.count_if(F.col(saved).isNull())).scalar()
    return (
        spread.withColumn("_m", money.select(F.struct("median_value_usd", "p95_value_usd")).scalar())
        .select(
            "n_evaluated", skipped.alias("n_skipped"), "n_success", F.try_divide(F.col("n_success"), n).alias("success_rate"),
            F.try_divide(F.col("sum_saved"), n).alias("mean_saved"), "median_saved", "p95_saved", "max_saved",
            F.try_divide(F.col("total_value_usd"), n).alias("mean_value_usd"), F.col("_m.median_value_usd").alias("median_value_usd"),
            F.col("_m.p95_value_usd").alias("p95_value_usd"), "total_value_usd", "n_recipe_limit",
            (n - F.col("n_recipe_limit")).alias("n_physics_model"),
        )
    )


# ---- editable economics ---------------------------------------------------

def in_bounds(name: str, value: Column) -> Column:
    lo, closed, hi = ECONOMICS_BOUNDS[name]
    ok = (value >= lo) if closed else (value > lo)
    if hi is not None:
        ok = ok & (value <= hi)
    return ok & ~F.isnan(value)


def overlay_economics(updates: DataFrame, economics: Economics = Economics()) -> tuple[DataFrame, DataFrame]:
    """Apply rows of proposed fields: NULL keeps the current value, unknown
    columns are ignored, and a row with any value out of range is rejected whole."""
    known = [n for n in ECONOMICS_BOUNDS if n in updates.columns]
    ok = F.lit(True)
    for n in known:
        ok = ok & (F.col(n).isNull() | F.coalesce(in_bounds(n, F.col(n).cast("double")), F.lit(False)))
    rest = [c for c in updates.columns if c not in ECONOMICS_BOUNDS]
    applied = updates.where(ok).select(
        *rest,
        *[
            (F.coalesce(F.col(n).cast("double"), F.lit(getattr(economics, n))) if n in known else F.lit(getattr(economics, n))).alias(n)
            for n in ECONOMICS_BOUNDS
        ],
    )
    return applied, updates.where(~ok)
