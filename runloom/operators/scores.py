"""Classification scores.  Ranking metrics first collapse equal scores, then use
running totals that never put the whole table into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runloom.functions.numeric import ratio
from runloom.operators.ordered import running_totals


def confusion(y: Column, alarm: Column) -> list[Column]:
    """Aggregates tp, fp, fn, tn of a 0/1 label and a boolean prediction."""
    pos = y == 1
    cells = {"tp": alarm & pos, "fp": alarm & ~pos, "fn": ~alarm & pos, "tn": ~alarm & ~pos}
    return [F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in cells.items()]


def rates() -> dict[str, Column]:
    """Rates from tp, fp, fn, tn columns; 0 where a denominator is 0."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return {
        "precision": ratio(tp, tp + fp, 0.0),
        "recall": ratio(tp, tp + fn, 0.0),
        "f1": ratio(2 * tp, 2 * tp + fp + fn, 0.0),
        "false_positive_rate": ratio(fp, fp + tn, 0.0),
        "specificity": ratio(tn, tn + fp, 0.0),
        "accuracy": ratio(tp + tn, tp + fp + fn + tn, 0.0),
    }


def classification(
    rows: DataFrame, threshold: float, y: str = "y_breach", proba: str = "proba", by: Sequence[str] = ()
) -> DataFrame:
    """Confusion counts, rates, Brier score and positive rate in one pass."""
    label = F.col(y)
    counted = rows.groupBy(*by).agg(
        *confusion(label, F.col(proba) >= threshold),
        F.count(F.lit(1)).alias("n_samples"),
        F.avg(label.cast("double")).alias("positive_rate"),
        brier(y, proba).alias("brier_score"),
    )
    return counted.select("*", *[c.alias(n) for n, c in rates().items()])


def brier(y: str = "y_breach", proba: str = "proba") -> Column:
    gap = F.col(proba) - F.col(y)
    return F.avg(gap * gap)


def score_steps(
    rows: DataFrame, y: str = "y_breach", proba: str = "proba", by: Sequence[str] = (), n: Column | None = None
) -> DataFrame:
    """One row per distinct score: positives and negatives there (``pos``,
    ``neg``), at or above it (``tp``, ``fp``) and in all (``p``, ``n``).  ``n`` is
    the number of samples a row stands for."""
    n = F.lit(1).cast("long") if n is None else n
    counts = rows.groupBy(*by, F.col(proba).alias("threshold")).agg(
        F.sum(F.when(F.col(y) == 1, n).otherwise(0)).alias("pos"),
        F.sum(F.when(F.col(y) == 0, n).otherwise(0)).alias("neg"),
    )
    steps = running_totals(counts, -F.col("threshold"), ["pos", "neg"], by)
    return steps.withColumnsRenamed({"pos_upto": "tp", "neg_upto": "fp", "pos_total": "p", "neg_total": "n"})


def ranking_scores(
    rows: DataFrame, y: str = "y_breach", proba: str = "proba", by: Sequence[str] = (), n: Column | None = None
) -> DataFrame:
    """Average precision (a step sum, 0 without positives) and ROC-AUC (rank
    statistic, ties count half; NULL unless both classes occur)."""
    tp, fp, pos, neg = (F.col(c) for c in ("tp", "fp", "pos", "neg"))
    steps = score_steps(rows, y, proba, by, n)
    sums = (steps.groupBy(*by) if by else steps).agg(
        F.sum(pos * tp / (tp + fp)).alias("_ap"),
        F.sum(neg * (tp - pos / 2.0)).alias("_u"),
        F.sum("pos").alias("_p"),
        F.sum("neg").alias("_n"),
    )
    return sums.select(
        *by,
        ratio(F.col("_ap"), F.col("_p"), 0.0).alias("average_precision"),
        F.try_divide(F.col("_u"), (F.col("_p") * F.col("_n")).cast("double")).alias("roc_auc"),
    )


def pick_threshold(
    rows: DataFrame, criterion: str = "f1", beta: float = 0.5, max_fpr: float = 0.10,
    y: str = "y_breach", proba: str = "proba",
) -> DataFrame:
    """Best threshold by ``f1``, ``fbeta`` or ``max_fpr`` (highest recall with
    the false positive rate under a cap); the lowest wins a tie, and data of one
    class gives 0.5."""
    steps = score_steps(rows, y, proba)
    tp, fp, p, n = (F.col(c) for c in ("tp", "fp", "p", "n"))
    if criterion == "f1":
        score = ratio(2.0 * tp, tp + fp + p, 0.0)
    elif criterion == "fbeta":
        b2 = beta * beta
        score = ratio((1.0 + b2) * tp, tp + fp + b2 * p, 0.0)
    elif criterion == "max_fpr":
        score = F.when(ratio(fp, F.greatest(n, F.lit(1))) <= max_fpr, ratio(tp, p, 0.0)).otherwise(-1.0)
    else:
        raise ValueError(f"unknown criterion {criterion!r}")
    best = steps.withColumn("score", score).orderBy(F.desc("score"), F.asc("threshold")).limit(1)
    both = (p > 0) & (n > 0)
    return best.select(
        F.lit(criterion).alias("criterion"),
        F.when(both, F.col("threshold")).otherwise(0.5).alias("threshold"),
        F.when(both, F.col("score")).alias("score"),
        F.when(both, ratio(tp, tp + fp)).alias("precision_at_threshold"),
        F.when(both, ratio(tp, p)).alias("recall_at_threshold"),
    )
