"""State and advice of many runs at many cursors, as one batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runloom.functions import text
from runloom.operators import advice, attribution, forecast, models
from runloom.operators.stage import staged
from runloom.settings import Economics, SurfacePolicy
from runloom.sources.slices import Frame, Slices


def live_risk(
    features: DataFrame | Slices, cursors: DataFrame, score: Callable[[DataFrame], DataFrame], threshold: float, delay: int = 1,
    fallback_first: bool = True,
) -> DataFrame:
    """As-of row of each (run, cursor) with ``proba`` and ``alarm``.  ``score`` sees only
    the as-of rows and the ``delay - 1`` before each, at most cursors x delay rows.

    The alarm honours the on-delay: the scores at the last ``delay`` positions reach the
    threshold; ``delay=1`` turns that off.  Given stored slices, only the folders that
    hold those rows are opened."""
    store = features if isinstance(features, Slices) else Frame(features)
    now = staged(store.at_cursor(cursors, fallback_first).select("run_id", "cursor", "sample_idx"))
    back = F.sequence(F.greatest(F.col("sample_idx") - (delay - 1), F.lit(0)), F.col("sample_idx"))
    asked = now.select("run_id", "cursor", F.col("sample_idx").alias("_now"), F.explode(back).alias("sample_idx"))
    scored = staged(score(store.at_positions(asked.select("run_id", "sample_idx"))))
    held = (
        asked.join(scored.select("run_id", "sample_idx", "proba"), ["run_id", "sample_idx"])
        .groupBy("run_id", "cursor", F.col("_now").alias("sample_idx"))
        .agg(((F.count("proba") == delay) & (F.min("proba") >= threshold)).alias("alarm"))
    )
    return held.join(scored, ["run_id", "sample_idx"])


def live_state(
    features: DataFrame | Slices, cursors: DataFrame, model, cone: forecast.Cone, threshold: float, delay: int = 1,
    fallback_first: bool = True,
) -> DataFrame:
    """As-of row of each (run, cursor) with probability, alarm and cone."""
    now = staged(live_risk(features, cursors, lambda rows: models.score(model, rows), threshold, delay, fallback_first))
    long = forecast.predict_cone(cone, now, keys=("run_id", "cursor"))
    qs = [c for c in long.columns if c.startswith("q")]
    # one entry per horizon: bounded by the forecast spec
    packed = long.groupBy("run_id", "cursor").agg(
        F.array_sort(F.collect_list(F.struct("horizon_min", *qs))).alias("_cone")
    )
    cone_text = F.array_join(
        F.transform("_cone", lambda c: F.concat(text.fixed(c["horizon_min"], 1), F.lit("min:"), F.concat_ws("/", *[text.fixed(c[q], 3) for q in qs]))), "; "
    )
    return now.join(packed, ["run_id", "cursor"], "left").select(
        "run_id", "cursor", "from_grade", "to_grade", "sample_idx", "t_min", "bw_dev_pct",
        (F.col("currently_off_spec") == 1).alias("currently_off_spec"), F.col("proba").alias("risk_probability"),
        F.lit(threshold).alias("risk_threshold"), F.col("alarm").alias("risk_alarm"), cone_text.alias("forecast_cone"),
    )


def risk_advice(scored: DataFrame, weights: dict[str, float], intercept: float, top: int = 8) -> DataFrame:
    """One advisory per scored row, its strongest drivers in the text."""
    rows = attribution.linear_attribution(scored, weights, intercept).withColumn(
        "_top", attribution.top_drivers(F.col("phi"), top)
    )
    ident = F.concat_ws("-", F.lit("risk"), F.col("run_id").cast("string"), F.col("sample_idx").cast("string"))
    drivers = F.transform("_top", lambda p: F.struct(p["feature"].alias("feature"), p["phi"].alias("phi")))
    return advice.advisory(
        rows, ident, F.lit("Breach risk"), F.lit("RISK_MODEL"), F.col("proba"),
        text.explain_risk(F.col("proba"), drivers), detail=["proba"],
    )


def plan_advice(best: DataFrame, economics: Economics = Economics()) -> DataFrame:
    """Advisories of plans that save off-spec time, priced.  ``best`` carries the
    plan columns, speed and weight of the destination grade and the saved minutes."""
    c = F.col
    useful = best.where(c("saved_off_spec_minutes") > 1e-6).withColumns(
        {"confidence": F.lit(advice.TWIN_CONFIDENCE), "cost_usd": F.lit(0.0)}
    )
    priced, _ = advice.price_comparison(useful, "base_off_spec_minutes", "best_off_spec_minutes", economics)
    words: Column = text.explain_plan(
        c("base_ramp_min"), c("best_ramp_min"), c("best_lead_scale"), c("best_tau_c_scale"), c("saved_off_spec_minutes"),
        c("source"), c("min_ramp_min"), c("binding_actuator"),
    )
    title = F.concat(F.lit("Plan instead of a ramp of "), text.fixed(c("base_ramp_min"), 1), F.lit(" min"))
    ident = F.concat_ws("-", F.lit("opt"), c("run_id").cast("string"))
    return advice.advisory(priced, ident, title, c("source"), c("confidence"), words, c("value_usd"), ["n_evaluations"])


def recommend(*kinds: DataFrame, policy: SurfacePolicy = SurfacePolicy()) -> DataFrame:
    """All kinds of advice ranked and gated per run."""
    return advice.rank_and_gate(advice.union_advice(*kinds), ["run_id"], policy)
