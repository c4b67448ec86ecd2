"""Correlations, models, forecasts and attribution on the shared tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom.dims import ALL_TAGS, KNOWN_LOOPS, known_loops_table
from runloom.functions.numeric import NOT_INPUTS, model_inputs, narrow_doubles, rounded
from runloom.operators import advice, attribution, correlate, forecast, models, splits, targets
from runloom.operators import ledger as led
from runloom.operators.stage import staged, staging_path
from runloom.plans import live
from runloom.plans import queries_advice as qa
from runloom.plans import queries_eval as qe
from runloom.plans import queries_runs as qr
from runloom.plans.oracle_base import BASE, DAY_TAGS, EV, PLANS, SCORED, TYPES, WIDE, d, with_
from runloom.plans.registry import Registry
from runloom.settings import Economics, ForecastSpec, SurfacePolicy
from runloom.sources import driver_tables as dt
from runloom.sources import buckets, files, runs, slices
from runloom.sources.driver_tables import SPEC

R = Registry()
WARM = SPEC.warmup
MAX_LAG, MIN_R, BINS = 4, 0.02, 8

# ---- correlations ---------------------------------------------------------
LONG = "series AS (" + " UNION ALL ".join(f"SELECT run_id, sample_idx, '{t}' AS tag, {t} AS value FROM day_tags" for t in TYPES) + ")"
PAIRS = f"""pairs AS (SELECT c.tag AS cause, e.tag AS effect, l.lag, c.value AS x, e.value AS y FROM series c, range(0, {MAX_LAG + 1}) l(lag), series e
   WHERE e.run_id = c.run_id AND e.sample_idx = c.sample_idx + l.lag AND e.tag <> c.tag),
corrs AS (SELECT cause, effect, CAST(lag AS INTEGER) AS lag, corr(x, y) AS r, count(*) AS n FROM pairs GROUP BY ALL),
best AS (SELECT * FROM corrs WHERE r <> 0 QUALIFY row_number() OVER (PARTITION BY cause, effect ORDER BY round(abs(r), 12) DESC, lag) = 1)"""
R.add("series_long", lambda spark, sf: correlate.series_long(dt.day_tags(spark, sf), TYPES),
      with_(DAY_TAGS, LONG, body="SELECT run_id, sample_idx, tag, value FROM series"))
R.add("lagged_pairs", lambda spark, sf: correlate.lagged_pairs(dt.day_tags(spark, sf), "click", "view", 3),
      with_(DAY_TAGS, body="SELECT run_id, sample_idx, x, y FROM (SELECT run_id, sample_idx, click AS x, lead(view, 3) OVER (PARTITION BY run_id ORDER BY sample_idx) AS y FROM day_tags) q WHERE y IS NOT NULL"))


def links(spark: SparkSession, sf: str) -> DataFrame:
    return correlate.strongest_lags(correlate.pair_correlations(dt.day_tags(spark, sf), TYPES, MAX_LAG), MIN_R)


def loops(spark: SparkSession, sf: str) -> DataFrame:
    """Known links of the event types: those that follow each other at least a
    fixed number of times in the whole log."""
    seq = dt.samples(spark, sf).select("run_id", "sample_idx", "event_type")
    nxt = qr.over_runs(seq, lambda r, w: r.withColumn("effect", F.lead("event_type").over(w)), ahead=1)
    counts = nxt.where(F.col("effect").isNotNull() & (F.col("effect") != F.col("event_type"))).groupBy(
        F.col("event_type").alias("cause"), "effect").agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") % 3 == 0).select("cause", "effect")


LOOPS = """loops AS (SELECT cause, effect FROM (SELECT event_type AS cause, lead(event_type) OVER (PARTITION BY run_id ORDER BY sample_idx) AS effect FROM s) q
  WHERE effect <> cause GROUP BY 1, 2 HAVING count(*) % 3 = 0),
both_ways AS (SELECT cause, effect FROM loops UNION SELECT effect, cause FROM loops)"""
R.add("lag_sweep", lambda spark, sf: rounded(links(spark, sf)),
      with_(DAY_TAGS, LONG, PAIRS, body=f"SELECT cause, effect, lag, round(r, 6) AS correlation, n AS n_samples FROM best WHERE abs(r) >= {MIN_R}"))
R.add("novel_pairs", lambda spark, sf: rounded(correlate.novel(links(spark, sf), loops(spark, sf)).select("cause", "effect", "lag", "correlation")),
      with_(BASE, DAY_TAGS, LONG, PAIRS, LOOPS, body=f"SELECT cause, effect, lag, round(r, 6) AS correlation FROM best WHERE abs(r) >= {MIN_R} AND (cause, effect) NOT IN (SELECT (cause, effect) FROM both_ways)"))
MI = f"""ends AS (SELECT tag, min(value) AS lo, max(value) AS hi FROM series GROUP BY tag),
kept AS (SELECT p.cause, p.effect, p.lag, least(floor((x - c.lo) / (c.hi - c.lo) * {BINS}), {BINS - 1}) AS bx, least(floor((y - e.lo) / (e.hi - e.lo) * {BINS}), {BINS - 1}) AS byy
  FROM pairs p JOIN best b ON b.cause = p.cause AND b.effect = p.effect AND b.lag = p.lag AND abs(b.r) >= {MIN_R} JOIN ends c ON c.tag = p.cause JOIN ends e ON e.tag = p.effect),
jt AS (SELECT cause, effect, lag, bx, byy, count(*) AS c FROM kept GROUP BY ALL),
mi AS (SELECT cause, effect, CAST(lag AS INTEGER) AS lag, sum(c / n::DOUBLE * ln(c * n / (cx * cy)::DOUBLE)) AS v FROM (
   SELECT *, sum(c) OVER (PARTITION BY cause, effect) AS n, sum(c) OVER (PARTITION BY cause, effect, bx) AS cx, sum(c) OVER (PARTITION BY cause, effect, byy) AS cy FROM jt) q GROUP BY ALL)"""
R.add("mutual_information",
      lambda spark, sf: rounded(correlate.mutual_information(dt.day_tags(spark, sf), TYPES, staged(links(spark, sf)), BINS)),
      with_(DAY_TAGS, LONG, PAIRS, MI, body="SELECT cause, effect, lag, round(v, 6) AS mutual_information FROM mi"))

# ---- discovered links of all tags at all lags ------------------------------
WIDE_LAGS, WIDE_MIN_R, WIDE_BINS = 36, 0.35, 12
WIDE_LONG = "series AS (" + " UNION ALL ".join(f"SELECT run_id, sample_idx, '{t}' AS tag, {t} AS value FROM wide" for t in ALL_TAGS) + ")"
R.add("discovered_links",
      lambda spark, sf: correlate.discover(dt.wide_samples(spark, sf), ALL_TAGS, WIDE_LAGS, WIDE_MIN_R, known_loops_table(spark), SPEC.step_min),
      with_(BASE, WIDE, WIDE_LONG,
            "ends AS (SELECT tag, min(value) AS lo, max(value) AS hi, avg(value) AS mid FROM series GROUP BY tag)",
            f"""corrs AS (SELECT c.tag AS cause, e.tag AS effect, l.lag, corr(c.value - cm.mid, e.value - em.mid) AS r, count(*) AS n
  FROM series c JOIN ends cm ON cm.tag = c.tag, range(0, {WIDE_LAGS + 1}) l(lag), series e JOIN ends em ON em.tag = e.tag
  WHERE e.run_id = c.run_id AND e.sample_idx = c.sample_idx + l.lag AND e.tag <> c.tag GROUP BY ALL)""",
            f"best AS (SELECT * FROM (SELECT * FROM corrs WHERE r <> 0 QUALIFY row_number() OVER (PARTITION BY cause, effect ORDER BY round(abs(r), 12) DESC, lag) = 1) q WHERE abs(r) >= {WIDE_MIN_R})",
            f"""cells AS (SELECT b.cause, b.effect, b.lag, least(floor((x.value - c.lo) / (c.hi - c.lo) * {WIDE_BINS}), {WIDE_BINS - 1}) AS bx, least(floor((y.value - e.lo) / (e.hi - e.lo) * {WIDE_BINS}), {WIDE_BINS - 1}) AS byy, count(*) AS c
  FROM best b JOIN series x ON x.tag = b.cause JOIN series y ON y.tag = b.effect AND y.run_id = x.run_id AND y.sample_idx = x.sample_idx + b.lag
  JOIN ends c ON c.tag = b.cause JOIN ends e ON e.tag = b.effect GROUP BY ALL)""",
            """mi AS (SELECT cause, effect, sum(c / n::DOUBLE * ln(c * n / (cx * cy)::DOUBLE)) AS v FROM (
  SELECT *, sum(c) OVER (PARTITION BY cause, effect) AS n, sum(c) OVER (PARTITION BY cause, effect, bx) AS cx, sum(c) OVER (PARTITION BY cause, effect, byy) AS cy FROM cells) q GROUP BY ALL)""",
            f"known AS (SELECT * FROM (VALUES {', '.join(repr(x) for x in sorted({*KNOWN_LOOPS, *((e, c) for c, e in KNOWN_LOOPS)}))}) v(cause, effect))",
            body=f"""SELECT cause, effect, round(lag * {d(SPEC.step_min)}, 3) AS best_lag_min, round_even(r, 4) AS correlation, round_even(v, 4) AS mutual_information, n AS n_samples,
  (cause, effect) IN (SELECT (cause, effect) FROM known) AS is_known, (cause, effect) NOT IN (SELECT (cause, effect) FROM known) AS novel, 'CORRELATION_DISCOVERY' AS source FROM best JOIN mi USING (cause, effect)"""))

# ---- attribution of a fixed linear scorer ---------------------------------
WEIGHTS = {"bw_abs_dev_pct": 0.0171, "bw_dev_max_2min": 0.0063, "t_min": -0.0513}
INTERCEPT = -1.9
KEYS = ["run_id", "sample_idx"]


def linear_score(x: dict):
    z = F.lit(INTERCEPT)
    for f, w in WEIGHTS.items():
        z = z + F.lit(w) * x[f]
    return F.round(F.lit(1.0) / (F.lit(1.0) + F.exp(-z)), 4)


XS = "xs AS (SELECT run_id, sample_idx, abs(dev) AS bw_abs_dev_pct, max2 AS bw_dev_max_2min, t_min, y, off FROM scored)"
_SUMS = " + ".join(f"{d(w)} * avg({f})" for f, w in WEIGHTS.items())
PHI = "phi AS (" + " UNION ALL ".join(f"SELECT run_id, sample_idx, '{f}' AS feature, {d(w)} * ({f} - (SELECT avg({f}) FROM xs)) AS phi FROM xs" for f, w in WEIGHTS.items()) + ")"


def attributed(spark: SparkSession, sf: str) -> DataFrame:
    return attribution.linear_attribution(qe.scored(spark, sf).select(*KEYS, *WEIGHTS), WEIGHTS, INTERCEPT)


R.add("linear_attribution",
      lambda spark, sf: rounded(attribution.attribution_long(attributed(spark, sf), [*KEYS, "base"])),
      with_(BASE, SCORED, XS, PHI, body=f"SELECT run_id, sample_idx, (SELECT round({d(INTERCEPT)} + {_SUMS}, 6) FROM xs) AS base, feature, round(phi, 6) AS phi FROM phi"))
R.add("mean_abs_attribution", lambda spark, sf: rounded(attribution.mean_abs(attributed(spark, sf))),
      with_(BASE, SCORED, XS, PHI, body="SELECT feature, round(avg(abs(phi)), 6) AS mean_abs_phi FROM phi GROUP BY feature"))


def drivers(spark: SparkSession, sf: str) -> DataFrame:
    top = attributed(spark, sf).select(*KEYS, F.posexplode(attribution.top_drivers(F.col("phi"), 2)).alias("place", "_d"))
    return rounded(top.select(*KEYS, "place", "_d.*"))


R.add("top_drivers", drivers,
      with_(BASE, SCORED, XS, PHI, body="""SELECT run_id, sample_idx, CAST(rk - 1 AS INTEGER) AS place, feature, round(phi, 6) AS phi, CASE WHEN phi > 0 THEN 'increases risk' ELSE 'reduces risk' END AS direction
FROM (SELECT *, row_number() OVER (PARTITION BY run_id, sample_idx ORDER BY abs(phi) DESC, feature) AS rk FROM phi) q WHERE rk <= 2"""))


def permutation(spark: SparkSession, sf: str) -> DataFrame:
    rows = qe.in_spec(spark, sf).select(F.concat_ws("-", "run_id", "sample_idx").alias("key"), "y_breach", *WEIGHTS)
    return attribution.permutation_importance(staged(rows), "key", list(WEIGHTS), attribution.by_columns(linear_score, list(WEIGHTS)))


_LS = "round(1e0 / (1e0 + exp(-({z}))), 4)"


def _z(swap: str | None) -> str:
    return d(INTERCEPT) + "".join(f" + {d(w)} * {'t' if f == swap else 'o'}.{f}" for f, w in WEIGHTS.items())


PERM = f"""k AS (SELECT *, CAST('0x' || substr(h, 1, 15) AS BIGINT) % (SELECT greatest(CAST(ceil(count(*) / {attribution.BLOCK_ROWS}e0) AS BIGINT), 1) FROM xs WHERE off = 0) AS blk
  FROM (SELECT *, run_id || '-' || sample_idx AS key, md5(run_id || '-' || sample_idx || '|0') AS h FROM xs WHERE off = 0) q),
b AS (SELECT *, row_number() OVER (PARTITION BY blk ORDER BY h, key) - 1 AS i, count(*) OVER (PARTITION BY blk) AS m FROM k),
variants AS (SELECT '' AS feature, 0 AS rep, y, {_LS.format(z=_z(None))} AS p FROM b o""" + "".join(
    f" UNION ALL SELECT '{f}', r.r, o.y, {_LS.format(z=_z(f))} FROM b o, range(1, 6) r(r), b t WHERE t.blk = o.blk AND t.i = (o.i + 1 + r.r * {attribution.STEP} % greatest(o.m - 1, 1)) % o.m" for f in WEIGHTS
) + """),
st AS (SELECT feature, rep, p, sum(y) AS pos, count(*) AS c FROM variants GROUP BY ALL),
cu AS (SELECT *, sum(pos) OVER w AS tp, sum(c) OVER w AS al FROM st WINDOW w AS (PARTITION BY feature, rep ORDER BY p DESC)),
ap AS (SELECT feature, rep, sum(pos * CAST(tp AS DOUBLE) / al) / sum(pos) AS ap FROM cu GROUP BY ALL)"""
R.add("permutation_importance", lambda spark, sf: rounded(permutation(spark, sf)),
      with_(BASE, SCORED, XS, PERM, body="SELECT feature, round(avg((SELECT ap FROM ap WHERE rep = 0) - ap), 6) AS importance, round(stddev_pop((SELECT ap FROM ap WHERE rep = 0) - ap), 6) AS std FROM ap WHERE rep > 0 GROUP BY feature"))


def merged_importance(spark: SparkSession, sf: str) -> DataFrame:
    e = dt.read(spark, sf, "events").groupBy(F.col("event_type").alias("feature"))
    a = e.agg(F.round(F.avg("value"), 3).alias("importance"))
    b = e.agg(F.round(F.avg("value") - 49.5, 3).alias("importance")).where(F.col("feature") != "click")
    c = e.agg(F.round(F.stddev_samp("value"), 3).alias("importance")).where(F.col("feature") != "view")
    return rounded(attribution.consensus(native=a, permutation=b, shap=c))


R.add("importance_consensus", merged_importance,
      with_("e AS (SELECT event_type AS feature, round(avg(value), 3) AS a, CASE WHEN event_type <> 'click' THEN round(avg(value) - 49.5e0, 3) END AS b, CASE WHEN event_type <> 'view' THEN round(stddev_samp(value), 3) END AS c FROM events GROUP BY 1)",
            "n AS (SELECT feature, coalesce(a / sum(abs(a)) OVER (), 0) AS na, coalesce(b / sum(abs(b)) OVER (), 0) AS nb, coalesce(c / sum(abs(c)) OVER (), 0) AS nc FROM e)",
            body="SELECT feature, round(na, 6) AS native_norm, round(nb, 6) AS permutation_norm, round(nc, 6) AS shap_norm, round((na + nb + nc) / 3, 6) AS consensus FROM n"))

# ---- fitted models (rows only) --------------------------------------------


def model_data(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """Feature table and three-way split of the mapped runs."""
    rows = staged(qr.feature_table(spark, sf))
    which = staged(splits.three_way_split(splits.run_strata(rows)))
    return rows, which, model_inputs(rows)


# ensemble sizes of native_importance and model_checks, small enough for the shared tables
QUERY_SETTINGS = {"random_forest": {"trees": 40, "depth": 8}, "boosted_trees": {"rounds": 15, "depth": 4}, "logistic": {}}


def risk(name: str):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        rows, which, inputs = model_data(spark, sf)
        _, _, result = models.fit_all(rows, which, inputs, [name], 0.5)  # the registry's full sizes
        return rounded(result)

    return query


R.add("risk_rf", risk("random_forest"))
R.add("risk_gbt", risk("boosted_trees"))
R.add("risk_logit", risk("logistic"))


def inputs_table(rows: DataFrame) -> DataFrame:
    """Names of the columns that may feed a model."""
    names = model_inputs(rows)
    return rows.limit(1).select(F.explode(F.array(*[F.lit(n) for n in names])).alias("feature"))


def importance(spark: SparkSession, sf: str) -> DataFrame:
    rows, which, inputs = model_data(spark, sf)
    model = models.fit(splits.rows_of(rows, which, "train"), inputs, models.REGISTRY["random_forest"], **QUERY_SETTINGS["random_forest"])
    return rounded(models.native_importance(model, inputs, spark))


R.add("native_importance", importance)


def model_checks(spark: SparkSession, sf: str) -> DataFrame:
    """What must hold of any fitted alarm model: rows and positives it saw and scored,
    probabilities in [0, 1], importances (where it has them) that add up to one."""
    rows, which, inputs = model_data(spark, sf)
    train, val = (splits.rows_of(rows, which, s) for s in ("train", "val"))
    ready = models.filled_inputs(train, inputs)
    seen = ready[1].agg(F.count(F.lit(1)).alias("n_train"), F.sum("y_breach").alias("pos_train"))
    usable, _ = models.available()
    fitted = {name: models.fit(train, inputs, spec, ready, **QUERY_SETTINGS[name]) for name, spec in usable.items()}
    found = []
    for name, model in fitted.items():
        weight = models.native_importance(model, inputs, spark)
        total = weight.agg(F.sum("importance")).first()[0] if weight is not None else None
        p = F.col(f"proba_{name}")
        found.append(F.struct(
            F.lit(name).alias("model"), F.lit(usable[name].family).alias("family"), F.count(p).alias("n_scored"), F.bool_and(p.between(0.0, 1.0)).alias("in_range"),
            F.lit(total is None or abs(total - 1.0) < 1e-9).alias("importance_is_whole"),
            (F.avg(F.when(F.col("y_breach") == 1, p)) > F.avg(F.when(F.col("y_breach") == 0, p))).alias("parts_classes"),
        ))
    # all models score a row while it is there
    out = models.score_each(fitted, val).agg(F.array(*found).alias("_found")).select(F.inline("_found"))
    return out.crossJoin(seen)  # one row a model, one row


R.add("model_checks", model_checks,
      with_(*qe.STRATA_CTES, qe.SPLIT3, "r AS (SELECT y, split FROM scored JOIN split3 USING (run_id))", body="""SELECT model, family, (SELECT count(*) FROM r WHERE split = 'val') AS n_scored, true AS in_range, true AS importance_is_whole, true AS parts_classes,
  (SELECT count(*) FROM r WHERE split = 'train') AS n_train, (SELECT CAST(sum(y) AS BIGINT) FROM r WHERE split = 'train') AS pos_train
FROM (VALUES ('random_forest', 'trees'), ('boosted_trees', 'trees'), ('logistic', 'linear')) m(model, family)"""))
R.add("model_inputs", lambda spark, sf: inputs_table(qr.feature_table(spark, sf)),
      f"""SELECT column_name AS feature FROM (DESCRIBE {qr.R.oracles["features_wide"]}) WHERE column_type IN ('TINYINT', 'SMALLINT', 'INTEGER', 'BIGINT', 'FLOAT', 'DOUBLE')
  AND column_name NOT IN ({", ".join(repr(c) for c in NOT_INPUTS)})""")


def surrogate(spark: SparkSession, sf: str) -> DataFrame:
    scored = qe.scored(spark, sf).select(*KEYS, *WEIGHTS, "proba")
    out = attribution.surrogate_attribution(staged(scored), list(WEIGHTS))
    return rounded(attribution.attribution_long(out, [*KEYS, "base", "exact"]))


def _ridge_sql() -> str:
    """The ridge fit in closed form, for three standardised features: Cramer's rule."""
    names = list(WEIGHTS)
    z = [f"({f} - (SELECT avg({f}) FROM xs)) / (SELECT stddev_samp({f}) FROM xs)" for f in names]
    a = lambda i, j: f"m{min(i, j)}{max(i, j)}"
    cell = lambda i, j, col: f"v{i}" if j == col else a(i, j)

    def det(col: int | None) -> str:
        m = [[cell(i, j, col) for j in range(3)] for i in range(3)]
        return " + ".join(f"{m[0][j]} * ({m[1][(j + 1) % 3]} * {m[2][(j + 2) % 3]} - {m[1][(j + 2) % 3]} * {m[2][(j + 1) % 3]})" for j in range(3))

    sums = [f"sum(z{i} * z{j}) + {d(attribution.RIDGE_ALPHA) if i == j else '0e0'} AS m{i}{j}" for i in range(3) for j in range(i, 3)]
    sums += [f"sum(z{i} * (proba - (SELECT avg(proba) FROM zs))) AS v{i}" for i in range(3)]
    return ",\n".join([
        "xs AS (SELECT run_id, sample_idx, abs(dev) AS bw_abs_dev_pct, max2 AS bw_dev_max_2min, t_min, proba FROM scored)",
        f"zs AS (SELECT run_id, sample_idx, proba, {', '.join(f'{e} AS z{i}' for i, e in enumerate(z))} FROM xs)",
        f"ms AS (SELECT avg(proba) AS base, {', '.join(sums)} FROM zs)",
        f"beta AS (SELECT base, {', '.join(f'({det(i)}) / ({det(None)}) AS b{i}' for i in range(3))} FROM ms)",
    ])


R.add("surrogate_attribution", surrogate,
      with_(BASE, SCORED, _ridge_sql(), body=" UNION ALL ".join(
          f"SELECT run_id, sample_idx, round(base, 6) AS base, false AS exact, '{f}' AS feature, round(b{i} * z{i}, 6) AS phi FROM zs, beta" for i, f in enumerate(WEIGHTS))))
CONE = ForecastSpec()  # 3 horizons x 3 quantiles
#: a steeper rate and an earlier stop than the library's, for the shared tables' few rows
CONE_SETTINGS = {"rounds": 40, "rate": 0.2, "patience": 4}


def cone_rows(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, list[str], forecast.Cone]:
    dev = qr.deviations(spark, sf).select(*KEYS, "bw_dev_pct")
    ahead = targets.forward_targets(dev, SPEC, CONE.horizons_min).drop("bw_dev_pct")
    rows = staged(qr.feature_table(spark, sf).join(ahead, KEYS))
    which = staged(splits.three_way_split(splits.run_strata(rows)))
    inputs = model_inputs(rows)
    return rows, which, inputs, forecast.fit_cone(rows, which, inputs, CONE, **CONE_SETTINGS)


def forecast_cone(spark: SparkSession, sf: str) -> DataFrame:
    rows, which, _, cone = cone_rows(spark, sf)
    return rounded(targets.forecast_scores(forecast.predict_cone(cone, splits.rows_of(rows, which, "test"))))


R.add("forecast_cone", forecast_cone)


def forecast_cone_checks(spark: SparkSession, sf: str) -> DataFrame:
    """What must hold of any fit: scored rows, order of the quantiles, coverage in reach."""
    rows, which, _, cone = cone_rows(spark, sf)
    out = staged(forecast.predict_cone(cone, splits.rows_of(rows, which, "test")).where(F.col("actual").isNotNull()))
    ordered = F.bool_and((F.col("q10") <= F.col("q50")) & (F.col("q50") <= F.col("q90")))
    covered = F.avg(((F.col("actual") >= F.col("q10")) & (F.col("actual") <= F.col("q90"))).cast("double"))
    return out.groupBy("horizon_min").agg(F.count(F.lit(1)).alias("n"), ordered.alias("ordered"), covered.between(0.6, 0.95).alias("covers"))


_AHEAD = "ahead AS (" + " UNION ALL ".join(
    f"SELECT run_id, sample_idx, {d(h)} AS horizon_min, lead(dev, {SPEC.steps(h, at_least=0)}) OVER (PARTITION BY run_id ORDER BY sample_idx) AS actual FROM s" for h in CONE.horizons_min
) + ")"
R.add("forecast_cone_checks", forecast_cone_checks,
      with_(*qe.STRATA_CTES, qe.SPLIT3, _AHEAD, body=f"""SELECT horizon_min, count(*) AS n, true AS ordered, true AS covers FROM ahead
WHERE actual IS NOT NULL AND sample_idx >= {WARM} AND run_id IN (SELECT run_id FROM split3 WHERE split = 'test') GROUP BY 1"""))


CURSORS = (3.0, 7.0)


def live_cursors(rows: DataFrame) -> DataFrame:
    return rows.select("run_id").distinct().select("run_id", F.explode(F.array(*[F.lit(c) for c in CURSORS])).alias("cursor"))


def live_state(spark: SparkSession, sf: str) -> DataFrame:
    rows, which, inputs, cone = cone_rows(spark, sf)
    model = models.fit(splits.rows_of(rows, which, "train"), inputs, models.REGISTRY["logistic"])
    return rounded(live.live_state(rows, live_cursors(rows), model, cone, threshold=0.5, delay=2))


def live_risk(spark: SparkSession, sf: str) -> DataFrame:
    """The live state under the fixed scorer, read from stored slices."""
    path = staging_path(spark, "slices")
    rows = qe.scored(spark, sf).drop("proba", "proba_peak")
    slices.write_slices(rows, path, slice_min=2.0, buckets=8)
    stored = slices.Slices(spark, path)
    found = live.live_risk(stored, live_cursors(stored.ends), lambda r: dt.scores(spark, sf, r), qe.CUT, 3)
    return rounded(found.select("run_id", "cursor", "sample_idx", "bw_dev_pct", "proba", "alarm"))


R.add("live_risk", live_risk,
      with_(BASE, SCORED, body=f"""SELECT a.run_id, a.cursor, a.sample_idx, round(n.dev, 6) AS bw_dev_pct, n.proba,
  (SELECT count(*) FROM scored p WHERE p.run_id = a.run_id AND p.sample_idx BETWEEN a.sample_idx - 2 AND a.sample_idx AND p.proba >= {d(qe.CUT)}) = 3 AS alarm
FROM (SELECT run_id, cursor, coalesce(max(CASE WHEN t_min <= cursor THEN sample_idx END), min(sample_idx)) AS sample_idx
      FROM scored, (VALUES {", ".join(f"({d(c)})" for c in CURSORS)}) v(cursor) GROUP BY ALL) a JOIN scored n ON n.run_id = a.run_id AND n.sample_idx = a.sample_idx"""))
R.add("live_state", live_state)

# ---- the chain from live state to recorded advice --------------------------
ASK_AT = 7.0


def recommendations(spark: SparkSession, sf: str) -> DataFrame:
    """Risk at the cursor and the best tried plan of every run, ranked and gated
    together, recorded in a ledger and read back from it."""
    rows = qe.scored(spark, sf).drop("proba", "proba_peak")
    cursors = dt.read(spark, sf, "events").select(F.col("user_id").alias("run_id"), F.lit(ASK_AT).alias("cursor")).distinct()
    now = live.live_risk(rows, cursors, lambda r: dt.scores(spark, sf, r), qe.CUT)
    risk = live.risk_advice(staged(now.select(*KEYS, *WEIGHTS, "proba")), WEIGHTS, INTERCEPT)
    part = dt.read(spark, sf, "part").select(F.col("p_partkey").alias("run_id"), (F.lit(40.0) + F.col("p_partkey") % 120).alias("basis_weight"), (F.lit(400.0) + F.col("p_size")).alias("machine_speed"))
    best = qa.best_plans(spark, sf).join(part, "run_id").withColumns({
        "base_ramp_min": F.col("base_max_abs_dev_pct") / 1e4, "best_ramp_min": F.col("best_max_abs_dev_pct") / 1e4, "best_lead_scale": F.lit(1.0) + F.col("best_mean_abs_dev_pct"),
        "best_tau_c_scale": F.lit(1.0) - F.col("best_mean_abs_dev_pct"), "min_ramp_min": F.lit(4.0), "binding_actuator": F.lit("machine_speed"),
    })
    shown = live.recommend(risk, live.plan_advice(best))
    path = staging_path(spark, "ledger")
    led.append_ledger(led.record_surfaced(shown, F.lit(ASK_AT), F.col("place").cast("long")), path, "asked-once")
    back = led.read_ledger(spark, path)
    return rounded(back.select("run_id", F.col("advisory_id").alias("id"), F.col("seq").alias("place"), "source", "confidence", "value_usd"), 4)


R.add("recommendations", recommendations,
      with_(BASE, SCORED, qa.OUT, f"""risk AS (SELECT run_id, 'risk-' || run_id || '-' || sample_idx AS id, 'RISK_MODEL' AS source, proba AS confidence, CAST(NULL AS DOUBLE) AS value_usd
  FROM scored JOIN (SELECT run_id, coalesce(max(CASE WHEN t_min <= {d(ASK_AT)} THEN sample_idx END), min(sample_idx)) AS sample_idx FROM scored GROUP BY run_id) a USING (run_id, sample_idx)),
plan AS (SELECT run_id, 'opt-' || run_id AS id, source, {d(advice.TWIN_CONFIDENCE)} AS confidence,
   {d(advice.TWIN_CONFIDENCE)} * (greatest(base_off_spec_minutes - best_off_spec_minutes, 0e0) * ((400e0 + p_size) * 6e0 * (40e0 + p_partkey % 120) / 1e6) * {d(Economics().per_tonne)}) AS value_usd
  FROM bp JOIN part ON p_partkey = run_id WHERE saved_off_spec_minutes > 1e-6),
ranked AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY value_usd DESC NULLS LAST, confidence DESC, id) AS place FROM (SELECT * FROM risk UNION ALL SELECT * FROM plan) u
  WHERE confidence >= {d(SurfacePolicy().min_confidence)} AND (value_usd IS NULL OR value_usd >= {d(SurfacePolicy().min_value_usd)}))""",
            body=f"SELECT run_id, id, place, source, round(confidence, 4) AS confidence, round(value_usd, 4) AS value_usd FROM ranked WHERE place <= {SurfacePolicy().max_shown}"))
R.add("fingerprint", lambda spark, sf: files.fingerprint(dt.samples(spark, sf).select("run_id", "sample_idx", "value"), config="driver tables"),
      """WITH ids AS (SELECT user_id AS run_id, count(*) AS n FROM events GROUP BY 1),
p AS (SELECT CAST(sum(CAST('0x' || substr(md5(run_id || '|' || n), 1, 8) AS BIGINT)) AS BIGINT) AS ids, count(*) AS n_ids, CAST(sum(n) AS BIGINT) AS n_rows FROM ids)
SELECT n_ids, n_rows, sha256(ids || '|' || n_ids || '|' || n_rows || '|run_id:bigint,sample_idx:bigint,value:double|driver tables') AS fingerprint FROM p""")

# ---- what is written comes back -------------------------------------------


def corpus_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    path, meta = staging_path(spark, "corpus"), qr.meta_rows(spark, sf)
    files.write_corpus(dt.samples(spark, sf), meta, path, buckets=8)
    samples, plans = files.read_corpus(spark, path, meta.schema)
    per_run = samples.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("value"), 3).alias("total"), F.max("sample_idx").alias("last_idx"))
    return per_run.join(plans.select("run_id", "from_grade", "to_grade", "n_samples"), "run_id")


R.add("corpus_round_trip", corpus_round_trip,
      with_(EV, PLANS, body="""SELECT ev.run_id, count(*) AS n_rows, round(sum(value), 3) AS total, max(sample_idx) AS last_idx, any_value(from_grade) AS from_grade,
  any_value(to_grade) AS to_grade, any_value(n_samples) AS n_samples FROM ev JOIN plans USING (run_id) GROUP BY ev.run_id"""))


def bucketed_corpus(spark: SparkSession, sf: str) -> DataFrame:
    """Splits and strata meet the samples of a bucketed corpus; per split what they hold."""
    name = f"corpus_{uuid.uuid4().hex}"
    buckets.write_bucketed(dt.samples(spark, sf).select(*KEYS, "value", "event_type"), name, staging_path(spark, "bucketed"), BUCKETS)
    strata = staged(splits.run_strata(qe.split_rows_base(spark, sf)))
    n = dt.run_plans(spark, sf).select("run_id", "n_samples")
    of_runs = staged(splits.three_way_split(strata).join(strata.select("run_id", "ever_off_spec"), "run_id").join(n, "run_id"))
    joined = buckets.with_runs(spark.table(name), of_runs)
    per_run = joined.groupBy("run_id", "split", "ever_off_spec").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("v"))
    return per_run.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_runs"), F.sum("n").alias("n_rows"), F.sum(F.col("ever_off_spec").cast("long")).alias("n_off_spec"), F.round(F.sum("v"), 2).alias("total"))


BUCKETS = 16
R.add("bucketed_corpus", bucketed_corpus,
      with_(*qe.STRATA_CTES, qe.SPLIT3, body="""SELECT split, count(*) AS n_runs, CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(ever_off_spec) AS BIGINT) AS n_off_spec, round(sum(v), 2) AS total
FROM (SELECT run_id, count(*) AS n, sum(value) AS v FROM ev GROUP BY run_id) r JOIN split3 USING (run_id) JOIN strata USING (run_id) GROUP BY split"""))


def source_interface(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of each run through the batch and the streamed source of one corpus."""
    path, out, check = (staging_path(spark, n) for n in ("runs", "sink", "progress"))
    dt.samples(spark, sf).select(*KEYS, "t_min", "value").repartition(4, "run_id").write.parquet(f"{path}/samples")
    qr.meta_rows(spark, sf).write.parquet(f"{path}/run_meta")
    batch, stream = runs.ParquetRuns(path), runs.StreamedRuns(path)
    query = stream.samples(spark).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True)
    query.start().awaitTermination()
    count = lambda rows, name: rows.groupBy("run_id").agg(F.count(F.lit(1)).alias(f"n_{name}"), F.round(F.sum("value"), 3).alias(f"total_{name}"))
    streamed = spark.read.schema(batch.samples(spark).schema).parquet(out)
    both = count(batch.samples(spark), "batch").join(count(streamed, "stream"), "run_id", "full_outer")
    return both.join(stream.meta(spark).select("run_id", "from_grade"), "run_id")


R.add("source_interface", source_interface,
      with_(EV, PLANS, body="SELECT ev.run_id, count(*) AS n_batch, round(sum(value), 3) AS total_batch, count(*) AS n_stream, round(sum(value), 3) AS total_stream, any_value(from_grade) AS from_grade FROM ev JOIN plans USING (run_id) GROUP BY ev.run_id"))


def run_fetch(spark: SparkSession, sf: str) -> DataFrame:
    """Samples of the run with the smallest id, from its folder of a written corpus."""
    path = staging_path(spark, "corpus")
    files.write_corpus(dt.samples(spark, sf), qr.meta_rows(spark, sf), path, buckets=8)
    first = spark.read.parquet(f"{path}/samples").agg(F.min("run_id")).first()[0]
    return files.read_run(spark, path, first, buckets=8).select("run_id", "sample_idx", "value", "event_type")


R.add("run_fetch", run_fetch, with_(EV, body="SELECT run_id, sample_idx, value, event_type FROM ev WHERE run_id = (SELECT min(run_id) FROM ev)"))


def feature_cache(text: bool):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        path, rows = staging_path(spark, "cache"), qr.feature_table(spark, sf)
        files.write_features(rows, path, text)
        back = files.read_features(spark, path, narrow_doubles(rows).schema if text else None)
        return back.groupBy("run_id").agg(
            F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("y_breach").cast("long")).alias("n_positive"), F.sum(F.col("currently_off_spec").cast("long")).alias("n_off")
        )

    return query


CACHED = with_(BASE, SCORED, body="SELECT run_id, count(*) AS n_rows, CAST(sum(y) AS BIGINT) AS n_positive, CAST(sum(off) AS BIGINT) AS n_off FROM scored GROUP BY run_id")
R.add("feature_cache", feature_cache(False), CACHED)
R.add("feature_cache_text", feature_cache(True), CACHED)


def report_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    path = staging_path(spark, "report")
    table = dt.read(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    files.write_report(table, path, ["event_type", "n"])
    return spark.read.schema("event_type string, n long").option("header", True).csv(path)


R.add("report_round_trip", report_round_trip, "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
