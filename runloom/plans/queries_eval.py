"""Splits, classification scores, alarms and forecast scores on the shared tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom.functions import series
from runloom.functions.numeric import rounded
from runloom.operators import alarms, labels as lab, scores, splits, targets
from runloom.operators.features import next_breach, trailing
from runloom.operators.segments import over_runs
from runloom.operators.stage import staged
from runloom.plans import queries_runs as qr
from runloom.plans.oracle_base import BASE, EV, GRADES, PLANS, SCORED, W, d, with_
from runloom.plans.registry import Registry
from runloom.sources import driver_tables as dt
from runloom.sources.driver_tables import SPEC

R = Registry()
WARM = SPEC.warmup
CUT = 0.5  # threshold of the fixed scorer


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Samples past the warm-up with label, off-spec flag and two fixed scores."""
    rows = qr.deviations(spark, sf).select("run_id", "sample_idx", "t_min", "bw_dev_pct")

    def build(part, w):
        breach = series.out_of_band(F.col("bw_dev_pct"), SPEC.band_pct)
        return part.select(
            "*",
            F.abs("bw_dev_pct").alias("bw_abs_dev_pct"),
            F.max(F.abs("bw_dev_pct")).over(trailing(w, 2.0, SPEC)).alias("bw_dev_max_2min"),
            next_breach(breach, w, SPEC.horizon).isNotNull().cast("int").alias("y_breach"),
            breach.cast("int").alias("currently_off_spec"),
        )

    out = over_runs(rows, build, back=SPEC.steps(2.0), ahead=SPEC.horizon).where(F.col("sample_idx") >= WARM)
    peak = F.round(F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col("bw_dev_max_2min") / 50.0 - 3.0))), 4)
    return dt.scores(spark, sf, out).withColumn("proba_peak", peak)


PEAK = "round(1e0 / (1e0 + exp(-(max2 / 50e0 - 3e0))), 4)"
IN = "inspec AS (SELECT * FROM scored WHERE off = 0)"
CONF = f"""conf AS (SELECT sum(CAST(proba >= {d(CUT)} AND y = 1 AS BIGINT))::BIGINT AS tp, sum(CAST(proba >= {d(CUT)} AND y = 0 AS BIGINT))::BIGINT AS fp,
  sum(CAST(proba < {d(CUT)} AND y = 1 AS BIGINT))::BIGINT AS fn, sum(CAST(proba < {d(CUT)} AND y = 0 AS BIGINT))::BIGINT AS tn, count(*) AS n_samples,
  avg(y) AS positive_rate, avg((proba - y) * (proba - y)) AS brier_score FROM inspec)"""


def rates_sql() -> str:
    def z(num: str, den: str) -> str:
        return f"coalesce(round(CAST({num} AS DOUBLE) / nullif({den}, 0), 6), 0)"

    return ", ".join(
        [
            z("tp", "tp + fp") + " AS precision", z("tp", "tp + fn") + " AS recall", z("2 * tp", "2 * tp + fp + fn") + " AS f1",
            z("fp", "fp + tn") + " AS false_positive_rate", z("tn", "tn + fp") + " AS specificity",
            z("tp + tn", "tp + fp + fn + tn") + " AS accuracy",
        ]
    )


def in_spec(spark: SparkSession, sf: str) -> DataFrame:
    return scored(spark, sf).where(F.col("currently_off_spec") == 0)


R.add(
    "classification",
    lambda spark, sf: rounded(scores.classification(in_spec(spark, sf), CUT)),
    with_(BASE, SCORED, IN, CONF, body=f"SELECT tp, fp, fn, tn, n_samples, round(positive_rate, 6) AS positive_rate, round(brier_score, 6) AS brier_score, {rates_sql()} FROM conf"),
)
STEPS = """steps AS (SELECT proba, sum(y) AS pos, sum(1 - y) AS neg FROM {src} GROUP BY proba),
cum AS (SELECT proba, pos, neg, sum(pos) OVER (ORDER BY proba DESC) AS tp, sum(neg) OVER (ORDER BY proba DESC) AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM steps)"""
AP = "CAST(sum(pos * CAST(tp AS DOUBLE) / (tp + fp)) / max(p) AS DOUBLE)"
AUC = "CAST(sum(neg * (tp - pos / 2e0)) / (max(p) * max(n)) AS DOUBLE)"
R.add(
    "average_precision",
    lambda spark, sf: rounded(scores.ranking_scores(in_spec(spark, sf)).select("average_precision")),
    with_(BASE, SCORED, IN, STEPS.format(src="inspec"), body=f"SELECT round({AP}, 6) AS average_precision FROM cum"),
)
R.add(
    "roc_auc",
    lambda spark, sf: rounded(scores.ranking_scores(in_spec(spark, sf)).select("roc_auc")),
    with_(BASE, SCORED, IN, STEPS.format(src="inspec"), body=f"SELECT round({AUC}, 6) AS roc_auc FROM cum"),
)
R.add(
    "brier",
    lambda spark, sf: rounded(in_spec(spark, sf).agg(scores.brier().alias("brier_score"))),
    with_(BASE, SCORED, IN, body="SELECT round(avg((proba - y) * (proba - y)), 6) AS brier_score FROM inspec"),
)
_PICK = {
    "f1": "2e0 * tp / (tp + fp + p)",
    "fbeta": "1.25e0 * tp / (tp + fp + 0.25e0 * p)",
    "maxfpr": "CASE WHEN CAST(fp AS DOUBLE) / n <= 0.1e0 THEN CAST(tp AS DOUBLE) / p ELSE -1e0 END",
}
for _key, _expr in _PICK.items():
    R.add(
        f"pick_threshold_{_key}",
        lambda spark, sf, c={"maxfpr": "max_fpr"}.get(_key, _key): rounded(scores.pick_threshold(in_spec(spark, sf), c)),
        with_(BASE, SCORED, IN, STEPS.format(src="inspec"), body=f"""SELECT '{ {"maxfpr": "max_fpr"}.get(_key, _key) }' AS criterion, proba AS threshold, round(sc, 6) AS score,
  round(CAST(tp AS DOUBLE) / (tp + fp), 6) AS precision_at_threshold, round(CAST(tp AS DOUBLE) / p, 6) AS recall_at_threshold
FROM (SELECT *, CAST({_expr} AS DOUBLE) AS sc FROM cum) q ORDER BY sc DESC, proba LIMIT 1"""),
    )

# static classification: document quality against a length score
R.add(
    "label_scores",
    lambda spark, sf: rounded(
        scores.ranking_scores(
            dt.read(spark, sf, "labels").join(dt.read(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
            .withColumn("proba", F.round(F.col("n_chars") / (F.col("n_chars") + 1000.0), 3)).withColumnRenamed("quality", "y"),
            y="y",
        )
    ),
    with_("inspec AS (SELECT quality AS y, round(n_chars / (n_chars + 1000e0), 3) AS proba FROM labels JOIN documents USING (doc_id))",
          STEPS.format(src="inspec"), body=f"SELECT round({AP}, 6) AS average_precision, round({AUC}, 6) AS roc_auc FROM cum"),
)

# ---- alarms ---------------------------------------------------------------
DELAY = 3


def held_sql(delay: int, proba: str = "proba") -> str:
    if delay <= 1:
        return proba
    return f"CASE WHEN sample_idx >= {WARM + delay - 1} THEN min({proba}) OVER ({W} ROWS BETWEEN {delay - 1} PRECEDING AND CURRENT ROW) END"


ALARM = f"judged AS (SELECT *, coalesce({held_sql(DELAY)} >= {d(CUT)}, false) AS alarm FROM scored)"
OUTCOME = """outcome AS (SELECT *, breach_min IS NOT NULL AS breached, coalesce(al < breach_min, false) AS warned,
   CASE WHEN al < breach_min THEN breach_min - al END AS warning_min, breach_min IS NULL AND al IS NOT NULL AS false_alarm
 FROM (SELECT run_id, min(CASE WHEN off = 1 THEN t_min END) AS breach_min, min(CASE WHEN alarm AND off = 0 THEN t_min END) AS al,
       arg_min(off, t_min) = 1 AS off_at_start FROM judged GROUP BY run_id) q)"""
R.add(
    "alarm_on_delay",
    lambda spark, sf: alarms.confirm(scored(spark, sf), CUT, DELAY).select("run_id", "sample_idx", "alarm"),
    with_(BASE, SCORED, ALARM, body="SELECT run_id, sample_idx, alarm FROM judged"),
)
R.add(
    "early_warning",
    lambda spark, sf: rounded(alarms.warning_outcomes(alarms.confirm(scored(spark, sf), CUT, DELAY))),
    with_(BASE, SCORED, ALARM, OUTCOME, body="""SELECT run_id, breached, warned, round(warning_min, 6) AS warning_min, round(breach_min, 6) AS breach_min,
  round(CASE WHEN warned OR NOT breached THEN al END, 6) AS alarm_min, false_alarm, off_at_start FROM outcome"""),
)
SUMMARY = """count(*) AS n_runs, count(*) FILTER (WHERE breached) AS n_breaching, count(*) FILTER (WHERE NOT breached) AS n_clean,
  count(*) FILTER (WHERE warned) AS n_warned, round(count(*) FILTER (WHERE warned) / nullif(count(*) FILTER (WHERE breached), 0)::DOUBLE, 6) AS detection_rate,
  round(avg(warning_min), 6) AS mean_warning_min, round(max(warning_min), 6) AS max_warning_min,
  round(count(*) FILTER (WHERE false_alarm) / nullif(count(*) FILTER (WHERE NOT breached), 0)::DOUBLE, 6) AS false_alarm_run_rate"""
R.add(
    "early_warning_summary",
    lambda spark, sf: rounded(
        alarms.warning_summary(alarms.warning_outcomes(alarms.confirm(scored(spark, sf), CUT, DELAY)))
    ),
    with_(BASE, SCORED, ALARM, OUTCOME, body=f"""SELECT {SUMMARY}, count(*) FILTER (WHERE off_at_start) AS n_off_at_start,
  round(quantile_cont(warning_min, 0.5), 6) AS median_warning_min, round(quantile_cont(warning_min, 0.25), 6) AS p25_warning_min,
  round(quantile_cont(warning_min, 0.75), 6) AS p75_warning_min FROM outcome"""),
)


def eval_sql(proba: str, thr: float, delay: int, tag: str = "") -> tuple[str, str]:
    """CTEs and select list of one evaluated model."""
    ctes = f"""judged{tag} AS (SELECT *, CASE WHEN alarm THEN greatest(pr, {d(thr)}) ELSE least(pr, {d(thr)} - 1e-9) END AS delayed
    FROM (SELECT *, {proba} AS pr, coalesce({held_sql(delay, proba)} >= {d(thr)}, false) AS alarm FROM scored) q),
  kept{tag} AS (SELECT * FROM judged{tag} WHERE off = 0),
  conf{tag} AS (SELECT sum(CAST(alarm AND y = 1 AS BIGINT))::BIGINT AS tp, sum(CAST(alarm AND y = 0 AS BIGINT))::BIGINT AS fp,
    sum(CAST(NOT alarm AND y = 1 AS BIGINT))::BIGINT AS fn, sum(CAST(NOT alarm AND y = 0 AS BIGINT))::BIGINT AS tn, count(*) AS n_samples,
    avg(y) AS positive_rate, avg((delayed - y) * (delayed - y)) AS brier_score, avg((pr - y) * (pr - y)) AS brier_raw FROM kept{tag}),
  {STEPS.format(src=f"(SELECT pr AS proba, y FROM kept{tag})").replace("steps", f"steps_raw{tag}").replace("cum AS", f"cum_raw{tag} AS")},
  {STEPS.format(src=f"(SELECT delayed AS proba, y FROM kept{tag})").replace("steps", f"steps_del{tag}").replace("cum AS", f"cum_del{tag} AS")},
  {OUTCOME.replace("outcome", f"outcome{tag}").replace("judged", f"judged{tag}")}"""
    body = f"""SELECT tp, fp, fn, tn, n_samples, round(positive_rate, 6) AS positive_rate, round(brier_score, 6) AS brier_score, {rates_sql()},
    (SELECT round({AP}, 6) FROM cum_raw{tag}) AS pr_auc, (SELECT round({AUC}, 6) FROM cum_raw{tag}) AS roc_auc_raw,
    (SELECT round({AUC}, 6) FROM cum_del{tag}) AS roc_auc, round(brier_raw, 6) AS brier_raw,
    (SELECT count(*) FROM judged{tag}) - n_samples AS n_rows_excluded,
    (SELECT round(count(*) FILTER (WHERE warned) / nullif(count(*) FILTER (WHERE breached), 0)::DOUBLE, 6) FROM outcome{tag}) AS detection_rate,
    (SELECT round(quantile_cont(warning_min, 0.5), 6) FROM outcome{tag}) AS median_warning_min,
    (SELECT round(avg(warning_min), 6) FROM outcome{tag}) AS mean_warning_min,
    (SELECT round(count(*) FILTER (WHERE false_alarm) / nullif(count(*) FILTER (WHERE NOT breached), 0)::DOUBLE, 6) FROM outcome{tag}) AS false_alarm_run_rate
  FROM conf{tag}"""
    return ctes, body


_C, _B = eval_sql("proba", CUT, DELAY)
R.add(
    "evaluate_model",
    lambda spark, sf: rounded(alarms.evaluate(staged(scored(spark, sf)), CUT, DELAY)),
    with_(BASE, SCORED, _C, body=_B),
)


def compared(spark: SparkSession, sf: str) -> DataFrame:
    rows = staged(scored(spark, sf))
    level = alarms.evaluate(rows, CUT, DELAY).withColumn("model", F.lit("level"))
    peak = alarms.evaluate(rows.withColumn("proba", F.col("proba_peak")), CUT, 1).withColumn("model", F.lit("peak"))
    return rounded(alarms.comparison(level.unionByName(peak)))


_CA, _BA = eval_sql("proba", CUT, DELAY, "_a")
_CB, _BB = eval_sql(PEAK, CUT, 1, "_b")
_CMP = "model, pr_auc, precision, recall, f1, false_positive_rate, median_warning_min, mean_warning_min, detection_rate, false_alarm_run_rate"
R.add(
    "model_comparison",
    compared,
    with_(BASE, SCORED, _CA, _CB, body=f"SELECT {_CMP} FROM (SELECT 'level' AS model, * FROM ({_BA}) qa UNION ALL SELECT 'peak', * FROM ({_BB}) qb) u"),
)

# ---- operating points -----------------------------------------------------


def sweep_sql(thresholds, sources: dict[str, str]) -> str:
    grid = ", ".join(f"({d(t)})" for t in thresholds)
    delays = ", ".join(f"({k})" for k in alarms.DELAYS)
    held = " UNION ALL ".join(
        f"SELECT '{m}' AS model, {k} AS delay, run_id, t_min, off, y, {held_sql(k, p)} AS held FROM scored"
        for m, p in sources.items() for k in alarms.DELAYS
    )
    return f"""held AS ({held}),
pts AS (SELECT model, CAST(delay AS INTEGER) AS delay, threshold, run_id, min(CASE WHEN off = 1 THEN t_min END) AS breach_min,
    min(CASE WHEN held >= threshold AND off = 0 THEN t_min END) AS al,
    sum(CAST(coalesce(held >= threshold, false) AND off = 0 AND y = 1 AS BIGINT)) AS tp, sum(CAST(coalesce(held >= threshold, false) AND off = 0 AND y = 0 AS BIGINT)) AS fp,
    sum(CAST(off = 0 AND y = 1 AS BIGINT)) AS pp, sum(CAST(off = 0 AND y = 0 AS BIGINT)) AS nn
  FROM held, (VALUES {grid}) g(threshold) GROUP BY ALL),
points AS (SELECT model, threshold, delay,
    coalesce(CAST(sum(tp) AS DOUBLE) / nullif(sum(tp) + sum(fp), 0), 0) AS precision, coalesce(CAST(sum(tp) AS DOUBLE) / nullif(sum(pp), 0), 0) AS recall,
    coalesce(CAST(2 * sum(tp) AS DOUBLE) / nullif(sum(tp) + sum(fp) + sum(pp), 0), 0) AS f1, coalesce(CAST(sum(fp) AS DOUBLE) / nullif(sum(nn), 0), 0) AS false_positive_rate,
    CAST(count(*) FILTER (WHERE al < breach_min) AS DOUBLE) / nullif(count(*) FILTER (WHERE breach_min IS NOT NULL), 0) AS detection_rate,
    quantile_cont(CASE WHEN al < breach_min THEN breach_min - al END, 0.5) AS median_warning_min,
    CAST(count(*) FILTER (WHERE breach_min IS NULL AND al IS NOT NULL) AS DOUBLE) / nullif(count(*) FILTER (WHERE breach_min IS NULL), 0) AS false_alarm_run_rate
  FROM pts GROUP BY ALL)"""


_PCOLS = ("precision", "recall", "f1", "false_positive_rate", "detection_rate", "median_warning_min", "false_alarm_run_rate")
_PR = ", ".join(f"round({c}, 6) AS {c}" for c in _PCOLS)
FLOOR = 0.5  # detection floor that the fixed scorers can reach


def sweep_points(spark: SparkSession, sf: str) -> DataFrame:
    return alarms.sweep(scored(spark, sf))


def model_points(spark: SparkSession, sf: str) -> DataFrame:
    rows = staged(scored(spark, sf))
    both = rows.withColumn("model", F.lit("level")).unionByName(
        rows.withColumn("proba", F.col("proba_peak")).withColumn("model", F.lit("peak"))
    )
    return alarms.sweep(both, alarms.COARSE_THRESHOLDS, by=["model"])


SWEEP = sweep_sql(alarms.FINE_THRESHOLDS, {"level": "proba"})
R.add(
    "operating_sweep",
    lambda spark, sf: rounded(sweep_points(spark, sf)),
    with_(BASE, SCORED, SWEEP, body=f"SELECT threshold, delay, {_PR} FROM points"),
)
_KEY = "coalesce(false_alarm_run_rate, 'inf'::DOUBLE), -median_warning_min, threshold, delay"
R.add(
    "operating_point",
    lambda spark, sf: rounded(alarms.best_points(rounded(sweep_points(spark, sf)), FLOOR)),
    with_(BASE, SCORED, SWEEP, f"rp AS (SELECT model, threshold, delay, {_PR} FROM points)", body=f"SELECT threshold, delay, {', '.join(_PCOLS)} FROM rp WHERE detection_rate >= {FLOOR} AND median_warning_min IS NOT NULL ORDER BY {_KEY} LIMIT 1"),
)
SWEEP2 = sweep_sql(alarms.COARSE_THRESHOLDS, {"level": "proba", "peak": PEAK})
R.add(
    "model_choice",
    lambda spark, sf: rounded(alarms.choose_model(rounded(model_points(spark, sf)), FLOOR)),
    with_(BASE, SCORED, SWEEP2, f"rp AS (SELECT model, threshold, delay, {_PR} FROM points)",
          f"per AS (SELECT * FROM rp WHERE detection_rate >= {FLOOR} AND median_warning_min IS NOT NULL QUALIFY row_number() OVER (PARTITION BY model ORDER BY {_KEY}) = 1)",
          body=f"SELECT model, threshold, delay, {', '.join(_PCOLS)} FROM per ORDER BY false_alarm_run_rate NULLS LAST, median_warning_min DESC, model LIMIT 1"),
)
CURRENT = 0.26  # between two points of the grid


def retune_points(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(alarms.sweep(scored(spark, sf), alarms.RETUNE_THRESHOLDS, delays=(1,)))


SWEEP3 = sweep_sql(alarms.RETUNE_THRESHOLDS, {"level": "proba"})
R.add(
    "retune_threshold",
    lambda spark, sf: rounded(alarms.retune(retune_points(spark, sf), CURRENT)),
    with_(BASE, SCORED, SWEEP3, f"rp AS (SELECT threshold, {_PR} FROM points WHERE delay = 1)", f"cur AS (SELECT * FROM rp ORDER BY round(abs(threshold - {d(CURRENT)}), 9), threshold LIMIT 1)",
          f"""cand AS (SELECT rp.* FROM rp, cur WHERE rp.threshold <> cur.threshold AND rp.detection_rate >= cur.detection_rate - {d(alarms.DETECTION_SLACK)}
   AND rp.median_warning_min >= cur.median_warning_min ORDER BY rp.false_alarm_run_rate NULLS LAST, rp.threshold LIMIT 1)""",
          body="""SELECT cur.threshold AS current_threshold, cur.false_alarm_run_rate AS current_false_alarm_rate,
  coalesce(b.threshold, cur.threshold) AS chosen_threshold, coalesce(b.false_alarm_run_rate, cur.false_alarm_run_rate) AS chosen_false_alarm_rate,
  b.threshold IS NOT NULL AS changed FROM cur LEFT JOIN cand b ON b.false_alarm_run_rate < cur.false_alarm_run_rate"""),
)

# ---- splits ---------------------------------------------------------------


def split_rows_base(spark: SparkSession, sf: str) -> DataFrame:
    names = ("basis_weight", "moisture", "ash", "machine_speed")
    g = dt.grades(spark, sf)
    a = g.select(F.col("code").alias("from_grade"), *[F.col(n).alias(f"a_{n}") for n in names])
    b = g.select(F.col("code").alias("to_grade"), *[F.col(n).alias(f"b_{n}") for n in names])
    size = series.transition_context("a_", "b_")["transition_magnitude"].alias("transition_magnitude")
    meta = dt.run_plans(spark, sf).join(a, "from_grade").join(b, "to_grade").select("run_id", size)
    return scored(spark, sf).join(meta, "run_id")


STRATA = f"""mags AS (SELECT run_id, transition_magnitude AS m FROM (SELECT run_id, {qr.TRANSITION_SQL} FROM plans JOIN grades a ON a.code = from_grade JOIN grades b ON b.code = to_grade) q),
per AS (SELECT run_id, CAST(max(off) AS INTEGER) AS ever_off_spec, CAST(max(y) AS INTEGER) AS any_positive, max(m) AS magnitude FROM scored JOIN mags USING (run_id) GROUP BY run_id),
edge AS (SELECT min(magnitude) AS e0, quantile_cont(magnitude, 1e0 / 3e0) AS e1, quantile_cont(magnitude, 2e0 / 3e0) AS e2, max(magnitude) AS e3 FROM per),
strata AS (SELECT *, ever_off_spec || '|' || mag_band AS stratum FROM (SELECT per.*, CASE WHEN NOT (e0 < e1 AND e1 < e2 AND e2 < e3) THEN 'all' WHEN magnitude <= e1 THEN 'low' WHEN magnitude <= e2 THEN 'mid' ELSE 'high' END AS mag_band FROM per, edge) q)"""
SPLIT3 = """split3 AS (SELECT run_id, stratum, CASE WHEN rk <= n_test THEN 'test' WHEN rk <= n_test + n_val THEN 'val' ELSE 'train' END AS split FROM (
  SELECT *, CASE WHEN t + v >= n THEN least(t, greatest(n - 2, 0)) ELSE t END AS n_test,
    CASE WHEN t + v >= n THEN least(v, greatest(n - 1 - least(t, greatest(n - 2, 0)), 0)) ELSE v END AS n_val FROM (
    SELECT run_id, stratum, row_number() OVER (PARTITION BY stratum ORDER BY md5(run_id || '|42'), run_id) AS rk, count(*) OVER (PARTITION BY stratum) AS n,
      greatest(floor(count(*) OVER (PARTITION BY stratum) * 0.2e0), CASE WHEN count(*) OVER (PARTITION BY stratum) >= 3 THEN 1 ELSE 0 END) AS t,
      greatest(floor(count(*) OVER (PARTITION BY stratum) * 0.2e0), CASE WHEN count(*) OVER (PARTITION BY stratum) >= 3 THEN 1 ELSE 0 END) AS v
    FROM strata) a) b)"""
STRATA_CTES = (BASE, SCORED, GRADES, PLANS, STRATA)
R.add(
    "strata",
    lambda spark, sf: rounded(splits.run_strata(split_rows_base(spark, sf))),
    with_(*STRATA_CTES, body="SELECT run_id, ever_off_spec, any_positive, round(magnitude, 6) AS magnitude, mag_band, stratum FROM strata"),
)
R.add(
    "split_2way",
    lambda spark, sf: splits.two_way_split(dt.read(spark, sf, "events").select(F.col("user_id").alias("run_id"))),
    """SELECT run_id, CASE WHEN rk <= greatest(round_even(n * 0.25e0, 0), 1) THEN 'test' ELSE 'train' END AS split
FROM (SELECT run_id, row_number() OVER (ORDER BY md5(run_id || '|42'), run_id) AS rk, count(*) OVER () AS n FROM (SELECT DISTINCT user_id AS run_id FROM events) a) b""",
)
R.add(
    "split_3way",
    lambda spark, sf: splits.three_way_split(splits.run_strata(split_rows_base(spark, sf))),
    with_(*STRATA_CTES, SPLIT3, body="SELECT run_id, stratum, split FROM split3"),
)


def split_and_rows(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = staged(split_rows_base(spark, sf))
    return rows, splits.three_way_split(splits.run_strata(rows))


def split_table(spark: SparkSession, sf: str) -> DataFrame:
    rows, which = split_and_rows(spark, sf)
    return rounded(splits.split_summary(rows, which.select("run_id", "split")))


def split_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows, which = split_and_rows(spark, sf)
    return splits.rows_of(rows, which, "val").select("run_id", "sample_idx", "y_breach")


R.add(
    "split_rows",
    split_rows,
    with_(*STRATA_CTES, SPLIT3, body="SELECT run_id, sample_idx, y AS y_breach FROM scored WHERE run_id IN (SELECT run_id FROM split3 WHERE split = 'val')"),
)
R.add(
    "split_summary",
    split_table,
    with_(*STRATA_CTES, SPLIT3, body="""SELECT split, count(DISTINCT run_id) AS n_runs, count(*) AS n_rows, round(avg(y), 6) AS positive_rate,
  count(*) FILTER (WHERE off = 0) AS in_spec_rows, round(avg(CASE WHEN off = 0 THEN y END), 6) AS in_spec_positive_rate FROM scored JOIN split3 USING (run_id) GROUP BY split"""),
)


def overlap(spark: SparkSession, sf: str) -> DataFrame:
    """The three-way split against a second one with another seed: runs whose
    side differs show up, as a shared run would."""
    strata = staged(splits.run_strata(split_rows_base(spark, sf)))
    both = splits.three_way_split(strata).select("run_id", "split").unionByName(
        splits.two_way_split(strata.select("run_id")).select("run_id", "split")
    )
    return splits.split_overlap(both)


R.add(
    "split_overlap",
    overlap,
    with_(*STRATA_CTES, SPLIT3, """two AS (SELECT run_id, CASE WHEN rk <= greatest(round_even(n * 0.25e0, 0), 1) THEN 'test' ELSE 'train' END AS split
  FROM (SELECT run_id, row_number() OVER (ORDER BY md5(run_id || '|42'), run_id) AS rk, count(*) OVER () AS n FROM (SELECT DISTINCT user_id AS run_id FROM events) a) b)""",
          body="SELECT run_id, count(DISTINCT split) AS n_splits FROM (SELECT run_id, split FROM split3 UNION ALL SELECT run_id, split FROM two) u GROUP BY run_id HAVING count(DISTINCT split) > 1"),
)
R.add(
    "run_sample",
    lambda spark, sf: splits.sample_runs(dt.read(spark, sf, "events").select(F.col("user_id").alias("run_id"), "event_id"), 40, 1),
    "SELECT user_id AS run_id, event_id FROM events WHERE user_id IN (SELECT run_id FROM (SELECT DISTINCT user_id AS run_id FROM events) a ORDER BY md5(run_id || '|1'), run_id LIMIT 40)",
)
R.add(
    "explain_sample",
    lambda spark, sf: splits.seeded_sample(dt.read(spark, sf, "lineitem").select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string"), F.col("l_linenumber").cast("string")).alias("row_key")), "row_key", 3000, 0),
    "SELECT k AS row_key FROM (SELECT l_orderkey || '-' || l_partkey || '-' || l_linenumber AS k FROM lineitem) q ORDER BY md5(k || '|0'), k LIMIT 3000",
)

# ---- corpus health --------------------------------------------------------
RANGES = {"basis_weight": (0.05, 400.0), "moisture": (0.5, 30.0), "ash": (-0.1, 60.0)}


def health(spark: SparkSession, sf: str) -> DataFrame:
    labels = staged(qr.run_labels(spark, sf))
    bad = lab.run_violations(dt.wide_samples(spark, sf), labels, SPEC, RANGES)
    return rounded(lab.health_report(labels, qr.meta_rows(spark, sf), bad))


_BAD = " ".join(f"WHEN {t}_lo < {d(lo)} OR {t}_hi > {d(hi)} THEN '{t}_range'" for t, (lo, hi) in RANGES.items())
R.add(
    "health_report",
    health,
    with_(*qr.LABEL_CTES, f"""viol AS (SELECT run_id, CASE {_BAD} END AS rule FROM (SELECT run_id, {", ".join(f"min({t}) AS {t}_lo, max({t}) AS {t}_hi" for t in RANGES)} FROM wide GROUP BY run_id) q)""",
          "fv AS (SELECT arg_min(rule, run_id) AS rule, CAST(min(run_id) AS DOUBLE) AS run_id FROM viol WHERE rule IS NOT NULL)",
          "rep AS (SELECT count(*) AS n_runs, avg(off_spec) AS a, avg(CAST(settle_min IS NOT NULL AS DOUBLE)) AS b, avg(off_spec_minutes) AS c, quantile_cont(settle_min, 0.5) AS m FROM labels)",
          body="""SELECT n_runs, round(a, 6) AS off_spec_rate, round(b, 6) AS settled_rate, round(c, 6) AS mean_off_spec_minutes, round(m, 6) AS median_settle_min,
  (SELECT count(*) FROM (SELECT DISTINCT from_grade, to_grade FROM meta) q) AS distinct_grade_pairs, fv.run_id AS first_bad_run, fv.rule AS first_bad_rule,
  CAST(CAST(NOT (a BETWEEN 0.15e0 AND 0.75e0) AS INTEGER) + CAST(b < 0.7e0 AS INTEGER) + CAST(fv.rule IS NOT NULL AS INTEGER) AS INTEGER) AS n_issues,
  (a BETWEEN 0.15e0 AND 0.75e0) AND b >= 0.7e0 AND fv.rule IS NULL AS ok FROM rep, fv"""),
)
R.add(
    "cause_counts",
    lambda spark, sf: lab.cause_counts(qr.meta_rows(spark, sf)),
    with_(EV, PLANS, qr.META, body="SELECT primary_cause, count(*) AS n_runs FROM meta GROUP BY primary_cause"),
)
R.add(
    "fault_codes",
    lambda spark, sf: qr.meta_rows(spark, sf).select(
        "run_id", F.array_join("fault_codes", "|").alias("fault_codes"), F.size("fault_codes").alias("n_faults"), "primary_cause"
    ),
    with_(EV, PLANS, qr.META, body="SELECT run_id, fault_text AS fault_codes, CAST(CASE WHEN fault_text = '' THEN 0 ELSE len(string_split(fault_text, '|')) END AS INTEGER) AS n_faults, primary_cause FROM meta"),
)
R.add(
    "distinct_pairs",
    lambda spark, sf: dt.run_plans(spark, sf).select("from_grade", "to_grade").distinct(),
    with_(EV, PLANS, body="SELECT DISTINCT from_grade, to_grade FROM plans"),
)

# ---- one held-out look at the re-tuned threshold ---------------------------


def retune_check(spark: SparkSession, sf: str) -> DataFrame:
    """The threshold chosen on validation runs, once against test runs: it is adopted if
    it holds there, else the current one stays."""
    rows = staged(scored(spark, sf))
    which = staged(splits.three_way_split(splits.run_strata(split_rows_base(spark, sf))))
    points = rounded(alarms.sweep(splits.rows_of(rows, which, "val"), alarms.RETUNE_THRESHOLDS, delays=(1,)))
    choice = alarms.retune(points, CURRENT).first()
    candidate = choice.chosen_threshold if choice.changed else CURRENT
    test = staged(rounded(alarms.sweep(splits.rows_of(rows, which, "test"), sorted({CURRENT, candidate}), delays=(1,))))
    at = lambda t: test.where(F.col("threshold") == F.lit(t))
    out = alarms.confirm_retune(at(CURRENT), at(candidate))
    return out.select(
        F.lit(CURRENT).alias("current_threshold"), F.lit(candidate).alias("candidate_threshold"), F.lit(bool(choice.changed)).alias("changed"), "*",
        F.when(F.col("adopt"), F.lit(candidate)).otherwise(F.lit(CURRENT)).alias("next_threshold"),
    )


def _of_split(which: str) -> str:
    """The sweep of one split's runs, its parts named after the split."""
    names = re.sub(r"\b(held|pts|points)\b(?= AS \(|,|\n|$)", rf"\1_{which}", sweep_sql((*alarms.RETUNE_THRESHOLDS, CURRENT), {"level": "proba"}))
    names = names.replace("FROM held,", f"FROM held_{which},").replace("FROM pts ", f"FROM pts_{which} ").replace("FROM scored", f"FROM scored_{which}")
    return f"scored_{which} AS (SELECT * FROM scored WHERE run_id IN (SELECT run_id FROM split3 WHERE split = '{which}')),\n{names}"


_SEEN = ("detection_rate", "median_warning_min", "false_alarm_run_rate")
R.add(
    "retune_check",
    lambda spark, sf: rounded(retune_check(spark, sf)),
    with_(*STRATA_CTES, SPLIT3, _of_split("val"), _of_split("test"),
          f"rp AS (SELECT threshold, {_PR} FROM points_val WHERE delay = 1 AND threshold <> {d(CURRENT)})", f"tp AS (SELECT threshold, {_PR} FROM points_test WHERE delay = 1)",
          f"cur AS (SELECT * FROM rp ORDER BY round(abs(threshold - {d(CURRENT)}), 9), threshold LIMIT 1)",
          f"""cand AS (SELECT rp.* FROM rp, cur WHERE rp.threshold <> cur.threshold AND rp.detection_rate >= cur.detection_rate - {d(alarms.DETECTION_SLACK)}
   AND rp.median_warning_min >= cur.median_warning_min ORDER BY rp.false_alarm_run_rate NULLS LAST, rp.threshold LIMIT 1)""",
          f"ch AS (SELECT coalesce(b.threshold, {d(CURRENT)}) AS t, b.threshold IS NOT NULL AS changed FROM cur LEFT JOIN cand b ON b.false_alarm_run_rate < cur.false_alarm_run_rate)",
          f"""j AS (SELECT ch.t, ch.changed, {", ".join(f"b.{c} AS before_{c}, a.{c} AS after_{c}" for c in _SEEN)},
   coalesce(a.false_alarm_run_rate < b.false_alarm_run_rate AND a.detection_rate >= b.detection_rate - {d(alarms.DETECTION_SLACK)} AND a.median_warning_min >= b.median_warning_min, false) AS adopt
   FROM ch, tp a, tp b WHERE a.threshold = ch.t AND b.threshold = {d(CURRENT)})""",
          body=f"""SELECT {d(CURRENT)} AS current_threshold, t AS candidate_threshold, changed, {", ".join(f"before_{c}, after_{c}" for c in _SEEN)}, adopt,
  CASE WHEN adopt THEN t ELSE {d(CURRENT)} END AS next_threshold FROM j"""),
)

# ---- forecast scores ------------------------------------------------------
HZ = (0.5, 1.0, 2.0)


def naive_cone(spark: SparkSession, sf: str) -> DataFrame:
    """A fixed band around the last deviation, crossing on purpose so that the
    rearrangement has work to do."""
    rows = qr.deviations(spark, sf).select("run_id", "sample_idx", "bw_dev_pct")
    wide = targets.forward_targets(rows, SPEC, HZ)
    points = F.array(*[
        F.struct(F.lit(h).alias("horizon_min"), F.col(targets.target_name(h)).alias("actual"),
                 (F.col("bw_dev_pct") * 0.4 - 60.0).alias("q10"), (F.col("bw_dev_pct") * 0.1).alias("q50"),
                 (F.col("bw_dev_pct") * -0.2 + 55.0 + 5.0 * h).alias("q90"))
        for h in HZ
    ])
    long = wide.select("run_id", "sample_idx", F.explode(points).alias("_p")).select("run_id", "sample_idx", "_p.*")
    return long.select("run_id", "sample_idx", "horizon_min", "actual", *targets.sorted_quantiles(["q10", "q50", "q90"]))


CONE = (
    "cone AS (SELECT run_id, sample_idx, horizon_min, actual, list_sort([a, b, c])[1] AS q10, list_sort([a, b, c])[2] AS q50, list_sort([a, b, c])[3] AS q90 FROM ("
    + " UNION ALL ".join(
        f"SELECT run_id, sample_idx, {d(h)} AS horizon_min, lead(dev, {SPEC.steps(h)}) OVER ({W}) AS actual, dev * 0.4e0 - 60e0 AS a, dev * 0.1e0 AS b, dev * -0.2e0 + 55e0 + {d(5.0 * h)} AS c FROM s"
        for h in HZ
    )
    + ") q)"
)
R.add(
    "quantile_rearrange",
    lambda spark, sf: rounded(naive_cone(spark, sf)),
    with_(BASE, CONE, body="SELECT run_id, sample_idx, horizon_min, round(actual, 6) AS actual, round(q10, 6) AS q10, round(q50, 6) AS q50, round(q90, 6) AS q90 FROM cone"),
)
R.add(
    "forecast_scores",
    lambda spark, sf: rounded(targets.forecast_scores(naive_cone(spark, sf))),
    with_(BASE, CONE, body="SELECT horizon_min, count(*) AS n, round(avg(abs(actual - q50)), 6) AS mae_median, round(sqrt(avg((actual - q50) * (actual - q50))), 6) AS rmse_median, "
          "round(avg(CAST(actual >= q10 AND actual <= q90 AS DOUBLE)), 6) AS interval_coverage, 0.8e0 AS nominal_coverage, round(avg(q90 - q10), 6) AS mean_interval_width, "
          + ", ".join(f"round(avg(greatest((actual - {c}) * {d(q)}, (actual - {c}) * {d(q - 1)})), 6) AS pinball_{c}" for c, q in (("q10", 0.1), ("q50", 0.5), ("q90", 0.9)))
          + " FROM cone WHERE actual IS NOT NULL GROUP BY horizon_min"),
)
