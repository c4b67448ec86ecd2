"""Alarm on-delay, early warning per run, and the sweep of operating points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runloom.functions.numeric import ratio
from runloom.operators import scores
from runloom.operators.ordered import exact_percentiles
from runloom.operators.stage import staged
from runloom.operators.segments import OWN, SEG, SEGMENT_ROWS, over_runs

# The default grids of thresholds and on-delays.
FINE_THRESHOLDS = tuple(round(0.20 + 0.025 * i, 4) for i in range(27))
COARSE_THRESHOLDS = tuple(round(0.20 + 0.05 * i, 4) for i in range(14))
RETUNE_THRESHOLDS = tuple(round(0.05 + 0.05 * i, 4) for i in range(19))
DELAYS = (1, 2, 3, 4, 6)
UNCONFIRMED_GAP = 1e-9


def held_score(proba: Column, delay: int, w) -> Column:
    """Lowest score of the last ``delay`` rows of the run, NULL while there are
    fewer, wherever the run's rows begin.  An alarm at any threshold is confirmed
    exactly when this reaches it; a missing score never confirms one."""
    if delay <= 1:
        return proba
    frame = w.rowsBetween(-(delay - 1), 0)
    return F.when(F.count(proba).over(frame) == delay, F.min(proba).over(frame))


def confirm(
    rows: DataFrame, threshold: float, delay: int, proba: str = "proba", size: int = SEGMENT_ROWS
) -> DataFrame:
    """Add ``alarm``: the score has reached the threshold on ``delay`` samples in
    a row."""

    def build(part, w):
        held = held_score(F.col(proba), delay, w)
        return part.withColumn("alarm", F.coalesce(held >= threshold, F.lit(False)))

    return over_runs(rows, build, back=max(delay - 1, 0), size=size)


def warning_outcomes(rows: DataFrame, time: str = "t_min") -> DataFrame:
    """Per run: first breach, first in-spec alarm before it and the gap.  A run
    without a breach that raised one is a false alarm.

    The first in-spec alarm of the run precedes the breach or no alarm does, so
    one aggregate with map-side combine is enough."""
    off = F.col("currently_off_spec") == 1
    seen = rows.groupBy("run_id").agg(
        F.min(F.when(off, F.col(time))).alias("breach_min"),
        F.min(F.when(F.col("alarm") & ~off, F.col(time))).alias("_alarm"),
        F.min_by(off, F.col(time)).alias("off_at_start"),
    )
    breached, warned = F.col("breach_min").isNotNull(), F.coalesce(F.col("_alarm") < F.col("breach_min"), F.lit(False))
    return seen.select(
        "run_id",
        breached.alias("breached"),
        warned.alias("warned"),
        F.when(warned, F.col("breach_min") - F.col("_alarm")).alias("warning_min"),
        "breach_min",
        F.when(warned | ~breached, F.col("_alarm")).alias("alarm_min"),
        (~breached & F.col("_alarm").isNotNull()).alias("false_alarm"),
        "off_at_start",
    )


def _outcome_totals() -> dict[str, Column]:
    breached = F.col("breached")
    return {
        "n_runs": F.count(F.lit(1)),
        "n_breaching": F.count_if(breached),
        "n_clean": F.count_if(~breached),
        "n_warned": F.count_if(F.col("warned")),
        "n_false": F.count_if(F.col("false_alarm")),
        "sum_warning": F.coalesce(F.sum("warning_min"), F.lit(0.0)),
    }


def _outcome_rates() -> dict[str, Column]:
    c = F.col
    return {
        "detection_rate": ratio(c("n_warned"), c("n_breaching")),
        "mean_warning_min": ratio(c("sum_warning"), c("n_warned")),
        "false_alarm_run_rate": ratio(c("n_false"), c("n_clean")),
    }


def warning_summary(outcomes: DataFrame) -> DataFrame:
    """One row over all runs; statistics of the warning time cover warned runs
    only and are NULL without one."""
    probs = {"median_warning_min": 0.5, "p25_warning_min": 0.25, "p75_warning_min": 0.75, "max_warning_min": 1.0}
    totals = _outcome_totals() | {"n_off_at_start": F.count_if(F.col("off_at_start"))}
    table = exact_percentiles(outcomes, "warning_min", probs, totals=totals)
    rest = _outcome_rates()
    return table.select("*", *[v.alias(k) for k, v in rest.items()]).drop("sum_warning", "n_false")


def evaluate(
    rows: DataFrame, threshold: float, delay: int = 1, in_spec_only: bool = True,
) -> DataFrame:
    """One row: classification on in-spec rows with the on-delay applied first,
    ranking scores on raw scores, early warning on all rows.  Brier and ROC-AUC of
    the delayed scores are given next to the raw ones.

    The samples are counted once by (score, alarm, label, in spec); every score
    below is computed from those counts."""
    judged = confirm(rows, threshold, delay)
    clean = (F.col("currently_off_spec") == 0) if in_spec_only else F.lit(True)
    counts = staged(
        judged.groupBy("proba", "alarm", "y_breach", clean.alias("kept")).agg(F.count(F.lit(1)).alias("n"))
    )
    delayed = F.when(F.col("alarm"), F.greatest("proba", F.lit(threshold))).otherwise(
        F.least("proba", F.lit(threshold - UNCONFIRMED_GAP))
    )
    kept = counts.where("kept").withColumn("delayed", delayed)
    n, y, alarm, keep = F.col("n"), F.col("y_breach"), F.col("alarm"), F.col("kept")

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, n)), F.lit(0))

    def squared(score: Column) -> Column:
        gap = score - y
        return ratio(F.sum(F.when(keep, n * gap * gap)), total(keep))

    table = counts.agg(
        total(keep & alarm & (y == 1)).alias("tp"), total(keep & alarm & (y == 0)).alias("fp"),
        total(keep & ~alarm & (y == 1)).alias("fn"), total(keep & ~alarm & (y == 0)).alias("tn"),
        total(keep).alias("n_samples"), total(~keep).alias("n_rows_excluded"),
        ratio(total(keep & (y == 1)), total(keep)).alias("positive_rate"),
        squared(delayed).alias("brier_score"), squared(F.col("proba")).alias("brier_raw"),
    )
    raw = scores.ranking_scores(kept, n=n).select(F.struct("average_precision", "roc_auc")).scalar()
    late = scores.ranking_scores(kept, proba="delayed", n=n).select("roc_auc").scalar()
    shown = ["detection_rate", "median_warning_min", "mean_warning_min", "false_alarm_run_rate"]
    warning = warning_summary(warning_outcomes(judged)).select(F.struct(*shown)).scalar()
    return (
        table.select("*", *[c.alias(k) for k, c in scores.rates().items()])
        .withColumn("_raw", raw)
        .withColumn("_w", warning)
        .withColumn("pr_auc", F.col("_raw.average_precision"))
        .withColumn("roc_auc_raw", F.col("_raw.roc_auc"))
        .withColumn("roc_auc", late)
        .select("*", *[F.col("_w")[k].alias(k) for k in shown])
        .drop("_raw", "_w")
    )


def _level(held: str, thresholds: Sequence[float]) -> str:
    """SQL text: how many of the sorted thresholds ``held`` reaches, by binary
    search (0 for NULL)."""

    def search(lo: int, hi: int) -> str:
        if lo == hi:
            return str(lo)
        mid = (lo + hi) // 2
        return f"if({held} >= {thresholds[mid]}D, {search(mid + 1, hi)}, {search(lo, mid)})"

    return search(0, len(thresholds))


def sweep(
    rows: DataFrame,
    thresholds: Sequence[float] = FINE_THRESHOLDS,
    delays: Sequence[int] = DELAYS,
    by: Sequence[str] = (),
    size: int = SEGMENT_ROWS,
) -> DataFrame:
    """All operating points at once.

    Each sample is tagged, per delay, with the number of thresholds its held score
    reaches.  Counting by that level serves every threshold, so rows grow by the
    number of delays only and are combined before the shuffle; from then on there
    are at most (levels x delays) rows per run."""
    levels = [float(t) for t in sorted(thresholds)]
    by = list(by)
    unit = [*by, "run_id", "delay"]

    def build(part, w):
        w = W.partitionBy(*by, "run_id", SEG).orderBy("sample_idx")
        helds = [
            F.struct(F.lit(d).alias("delay"), held_score(F.col("proba"), d, w).alias("held")) for d in delays
        ]
        return part.select(*by, "run_id", "t_min", "currently_off_spec", "y_breach", OWN, SEG, F.array(*helds).alias("_h"))

    off, y = F.col("currently_off_spec") == 1, F.col("y_breach") == 1
    per_run = staged(
        over_runs(rows, build, back=max(delays) - 1, size=size)
        .select("*", F.inline("_h"))
        .withColumn("level", F.expr(_level("held", levels)))
        .groupBy(*unit, "level")
        .agg(
            F.min(F.when(off, F.col("t_min"))).alias("off_at"),
            F.min(F.when(~off, F.col("t_min"))).alias("on_at"),
            F.count_if(~off & y).alias("pos"),
            F.count_if(~off & ~y).alias("neg"),
        )
    )

    def at_or_above(table: DataFrame, within: list[str], **folds: Column) -> DataFrame:
        """One row per threshold index ``i`` that some row of ``within`` reaches,
        with its folds over the levels above i."""
        w = W.partitionBy(*within).orderBy(F.desc("level"))
        upto = w.rowsBetween(W.unboundedPreceding, 0)
        below = F.coalesce(F.lead("level").over(w), F.lit(0))
        found = table.select("*", below.alias("_below"), *[f.over(upto).alias(n) for n, f in folds.items()])
        reached = F.explode(F.sequence(F.col("_below"), F.col("level") - 1))
        kept = [c for c in ("breach_min",) if c in table.columns]
        return found.where(F.col("level") > F.col("_below")).select(*within, *kept, *folds, reached.alias("i"))

    whole = W.partitionBy(*unit)
    alarms_ = at_or_above(
        per_run.withColumn("breach_min", F.min("off_at").over(whole)), unit, alarm_min=F.min("on_at")
    ).where(F.col("alarm_min").isNotNull())
    breached = F.col("breach_min").isNotNull()
    warned = F.coalesce(F.col("alarm_min") < F.col("breach_min"), F.lit(False))
    outcomes = alarms_.withColumn("warning_min", F.when(warned, F.col("breach_min") - F.col("alarm_min")))
    point = [*by, "delay", "i"]
    warnings = exact_percentiles(
        outcomes, "warning_min", {"median_warning_min": 0.5}, point,
        totals={"n_warned": F.count("warning_min"), "n_false": F.count_if(~breached)},
    )

    counts = per_run.groupBy(*by, "delay", "level").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    hits = at_or_above(counts, [*by, "delay"], tp=F.sum("pos"), fp=F.sum("neg"))
    runs = (
        per_run.groupBy(*unit)
        .agg(F.min("off_at").alias("breach_min"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        .groupBy(*by, "delay")
        .agg(
            F.count_if(breached).alias("n_breaching"), F.count_if(~breached).alias("n_clean"),
            F.sum("pos").alias("_p"), F.sum("neg").alias("_n"),
        )
    )
    grid = runs.select("*", F.posexplode(F.array(*[F.lit(t) for t in levels])).alias("i", "threshold"))
    table = (
        grid.join(hits, point, "left")
        .join(warnings, point, "left")
        .na.fill(0, ["tp", "fp", "n_warned", "n_false"])
        .withColumns({"fn": F.col("_p") - F.col("tp"), "tn": F.col("_n") - F.col("fp")})
    )
    rate = scores.rates()
    return table.select(
        *by, "threshold", "delay", *[rate[k].alias(k) for k in ("precision", "recall", "f1", "false_positive_rate")],
        ratio(F.col("n_warned"), F.col("n_breaching")).alias("detection_rate"), "median_warning_min",
        ratio(F.col("n_false"), F.col("n_clean")).alias("false_alarm_run_rate"),
    )


def best_points(points: DataFrame, min_detection: float = 0.80, by: Sequence[str] = ()) -> DataFrame:
    """Fewest false alarms among the points that detect enough and have a
    warning time; longer warning, then the smaller threshold and delay break ties."""
    ok = points.where((F.col("detection_rate") >= min_detection) & F.col("median_warning_min").isNotNull())
    key = F.struct(
        F.coalesce("false_alarm_run_rate", F.lit(float("inf"))), -F.col("median_warning_min"), "threshold", "delay"
    )
    rest = [c for c in points.columns if c not in by]
    best = ok.groupBy(*by).agg(F.min_by(F.struct(*rest), key).alias("_best"))
    return best.where(F.col("_best").isNotNull()).select(*by, "_best.*")


def choose_model(points: DataFrame, min_detection: float = 0.80, model: str = "model") -> DataFrame:
    """Best point of every model, then the model with the best of those."""
    per_model = best_points(points, min_detection, [model])
    return per_model.orderBy(
        F.asc_nulls_last("false_alarm_run_rate"), F.desc("median_warning_min"), model
    ).limit(1)


DETECTION_SLACK = 0.02


def retune(points: DataFrame, current: float) -> DataFrame:
    """The threshold to use next, at one fixed delay: the candidate with fewest
    false alarms among those that keep detection (less a small slack) and warning
    time, if it beats the current one; otherwise the current one."""
    # the grid of points is a fixed parameter, so it fits one row
    grid = points.agg(
        F.collect_list(
            F.struct(
                F.coalesce("false_alarm_run_rate", F.lit(float("inf"))).alias("far"), "threshold",
                F.col("detection_rate").alias("det"), F.col("median_warning_min").alias("warn"),
            )
        ).alias("_g")
    )
    # the current threshold need not be on the grid: its nearest point stands for it
    gap = F.transform("_g", lambda p: F.struct(F.round(F.abs(p["threshold"] - F.lit(float(current))), 9).alias("gap"), p["threshold"].alias("at"), p.alias("point")))
    now = F.array_min(gap)["point"]
    ok = F.filter(
        "_g",
        lambda p: (p["threshold"] != F.col("_now.threshold"))
        & (p["det"] >= F.col("_now.det") - DETECTION_SLACK)
        & (p["warn"] >= F.col("_now.warn")),
    )
    best = F.col("_best")
    changed = F.coalesce(best["far"] < F.col("_now.far"), F.lit(False))

    def known(rate: Column) -> Column:
        return F.when(rate < F.lit(float("inf")), rate)

    return (
        grid.withColumn("_now", now)
        .withColumn("_best", F.array_min(ok))
        .select(
            F.col("_now.threshold").alias("current_threshold"),
            known(F.col("_now.far")).alias("current_false_alarm_rate"),
            F.when(changed, best["threshold"]).otherwise(F.col("_now.threshold")).alias("chosen_threshold"),
            known(F.when(changed, best["far"]).otherwise(F.col("_now.far"))).alias("chosen_false_alarm_rate"),
            changed.alias("changed"),
        )
    )


def confirm_retune(before: DataFrame, after: DataFrame) -> DataFrame:
    """One held-out check of a re-tuned threshold: both inputs are one-row
    results of :func:`evaluate`; ``adopt`` says whether the change holds."""
    cols = ["detection_rate", "median_warning_min", "false_alarm_run_rate"]
    b = before.select(*[F.col(c).alias(f"before_{c}") for c in cols])
    a = after.select(F.struct(*cols)).scalar()
    adopt = (
        (F.col("after_false_alarm_run_rate") < F.col("before_false_alarm_run_rate"))
        & (F.col("after_detection_rate") >= F.col("before_detection_rate") - DETECTION_SLACK)
        & (F.col("after_median_warning_min") >= F.col("before_median_warning_min"))
    )
    return (
        b.withColumn("_a", a)
        .select("*", *[F.col("_a")[c].alias(f"after_{c}") for c in cols])
        .drop("_a")
        .withColumn("adopt", F.coalesce(adopt, F.lit(False)))
    )


def comparison(per_model: DataFrame) -> DataFrame:
    """Evaluated models side by side, best PR-AUC first."""
    return per_model.select(
        "model", "pr_auc", "precision", "recall", "f1", "false_positive_rate", "median_warning_min",
        "mean_warning_min", "detection_rate", "false_alarm_run_rate",
    ).orderBy(F.desc("pr_auc"), "model")
