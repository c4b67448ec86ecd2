"""Pricing, gating, plans, ledger and text on the shared tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom.dims import DV_BOUNDS, SOURCE_LABELS
from runloom.functions import text
from runloom.functions.numeric import clip, finite_or_null, rounded
from runloom.operators import advice, ledger as led
from runloom.operators.stage import staged, staging_path
from runloom.plans.oracle_base import LATEST, LEDGER, d, with_
from runloom.plans.registry import Registry
from runloom.settings import Economics
from runloom.sources import driver_tables as dt

R = Registry()
ECON = Economics()
KEY = ["l_orderkey", "l_partkey", "l_linenumber", "l_suppkey"]
KEYS = ", ".join(KEY)


def offers(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as recommendations: quantity gives minutes, discount and tax
    give confidence and cost."""
    return dt.read(spark, sf, "lineitem").select(
        *KEY, "l_shipdate",
        (F.col("l_quantity") * 1.0123456789 - 10.3).alias("avoided_min"),
        (F.col("l_discount") * 9.7 + F.col("l_linenumber") / 10.0 - 0.11).alias("confidence"),
        (F.col("l_tax") * 1234.567).alias("cost_usd"),
        (F.lit(400.0) + F.col("l_suppkey") % 500).alias("machine_speed"),
        (F.lit(40.0) + F.col("l_partkey") % 120).alias("basis_weight"),
        F.when(F.col("l_returnflag") == "A", "PHYSICS_MODEL").otherwise("RISK_MODEL").alias("source"),
    )


OFFER = f"""offer AS (SELECT {KEYS}, l_quantity * 1.0123456789e0 - 10.3e0 AS avoided_min, l_discount * 9.7e0 + l_linenumber / 10e0 - 0.11e0 AS confidence,
  l_tax * 1234.567e0 AS cost_usd, 400e0 + l_suppkey % 500 AS machine_speed, 40e0 + l_partkey % 120 AS basis_weight,
  CASE WHEN l_returnflag = 'A' THEN 'PHYSICS_MODEL' ELSE 'RISK_MODEL' END AS source FROM lineitem)"""


def priced_sql(minutes: str, src: str, name: str = "priced") -> str:
    return f"""{name} AS (SELECT *, least(pt * 0.7e0, pt * 1.35e0) AS low_usd, greatest(pt * 0.7e0, pt * 1.35e0) AS high_usd, pt * (3.2e0 * 340e0) AS annual_usd
   FROM (SELECT *, confidence * (avoided_tonnes * 137e0) - coalesce(cost_usd, 0) AS pt FROM (
     SELECT *, greatest({minutes}, 0e0) * (machine_speed * 6e0 * basis_weight / 1e6) AS avoided_tonnes FROM {src} WHERE confidence BETWEEN 0 AND 1) a) b)"""


PRICED = priced_sql("avoided_min", "offer")
_V = "round(avoided_tonnes, 4) AS avoided_tonnes, round(pt, 4) AS value_usd, round(low_usd, 4) AS low_usd, round(high_usd, 4) AS high_usd, round(annual_usd, 3) AS annual_usd"


def shown_price(df: DataFrame) -> DataFrame:
    return df.select(
        *KEY, F.round("avoided_tonnes", 4).alias("avoided_tonnes"), F.round("value_usd", 4).alias("value_usd"),
        F.round("low_usd", 4).alias("low_usd"), F.round("high_usd", 4).alias("high_usd"), F.round("annual_usd", 3).alias("annual_usd"),
    )


R.add("price_advice", lambda spark, sf: shown_price(advice.price(offers(spark, sf), ECON)[0]),
      with_(OFFER, PRICED, body=f"SELECT {KEYS}, {_V} FROM priced"))
R.add("price_rejects", lambda spark, sf: rounded(advice.price(offers(spark, sf), ECON)[1].select(*KEY, "confidence")),
      with_(OFFER, body=f"SELECT {KEYS}, round(confidence, 6) AS confidence FROM offer WHERE NOT (confidence BETWEEN 0 AND 1)"))
R.add(
    "price_comparison",
    lambda spark, sf: shown_price(advice.price_comparison(
        offers(spark, sf).withColumn("base_min", F.col("avoided_min") + 20.1).withColumn("new_min", F.col("basis_weight") / 3.3),
        "base_min", "new_min", ECON)[0]),
    with_(OFFER, priced_sql("(avoided_min + 20.1e0 - basis_weight / 3.3e0)", "offer"), body=f"SELECT {KEYS}, {_V} FROM priced"),
)
R.add("surface_filter", lambda spark, sf: shown_price(advice.surfaced_only(advice.price(offers(spark, sf), ECON)[0])),
      with_(OFFER, PRICED, body=f"SELECT {KEYS}, {_V} FROM priced WHERE pt >= 150 AND confidence >= 0.35e0"))


def shown_advice(spark: SparkSession, sf: str) -> DataFrame:
    priced = advice.price(offers(spark, sf), ECON)[0]
    rows = priced.withColumn("id", F.concat_ws("-", *[F.col(k).cast("string") for k in KEY]))
    # advice of the risk model carries no price
    rows = rows.withColumn("value_usd", F.when(F.col("source") == "PHYSICS_MODEL", F.col("value_usd"))).withColumn("run_id", F.col("l_suppkey"))
    return advice.rank_and_gate(rows, ["run_id"])


SHOWN = f"""cand AS (SELECT l_suppkey AS run_id, l_orderkey || '-' || l_partkey || '-' || l_linenumber || '-' || l_suppkey AS id, source, confidence, CASE WHEN source = 'PHYSICS_MODEL' THEN pt END AS value_usd FROM priced),
shown AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY value_usd DESC NULLS LAST, confidence DESC, id) AS place FROM cand WHERE confidence >= 0.35e0 AND (value_usd IS NULL OR value_usd >= 150) QUALIFY place <= 4)"""
R.add("rank_and_gate", lambda spark, sf: shown_advice(spark, sf).select("run_id", "id", "place", F.round("value_usd", 4).alias("value_usd"), F.round("confidence", 6).alias("confidence")),
      with_(OFFER, PRICED, SHOWN, body="SELECT run_id, id, CAST(place AS INTEGER) AS place, round(value_usd, 4) AS value_usd, round(confidence, 6) AS confidence FROM shown"))
R.add(
    "ledger_record",
    lambda spark, sf: led.record_surfaced(shown_advice(spark, sf), F.lit(1.7e9) + F.col("place"), F.col("run_id") * 10 + F.col("place")).select(
        "kind", "advisory_id", "timestamp", "source", F.round("confidence", 6).alias("confidence"), F.round("value_usd", 4).alias("value_usd"), "decision", "run_id", "seq"),
    with_(OFFER, PRICED, SHOWN, body="SELECT 'surfaced' AS kind, id AS advisory_id, 1.7e9 + place AS timestamp, source, round(confidence, 6) AS confidence, round(value_usd, 4) AS value_usd, CAST(NULL AS VARCHAR) AS decision, run_id, run_id * 10 + place AS seq FROM shown"),
)
R.add("portfolio_value", lambda spark, sf: rounded(advice.portfolio_value(advice.price(offers(spark, sf), ECON)[0]), 2),
      with_(OFFER, PRICED, body="SELECT round(coalesce(avg(pt), 0) * (3.2e0 * 340e0), 2) AS annual_value_usd FROM priced"))

# ---- advice in one shape, with its sentences ------------------------------
_LBL = "CASE source " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SOURCE_LABELS.items()) + " ELSE source END"


def knob_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as findings of all four kinds."""
    p = F.col("l_extendedprice")
    return dt.read(spark, sf, "lineitem").select(
        *KEY, F.col("l_suppkey").alias("run_id"), (p / 106999.7713).alias("prob"), (p / 53017.3331 - 1.0).alias("r"),
        (F.col("l_quantity") / 7.0001).alias("lag_min"), (p / 91003.1717).alias("mi"), (F.col("l_linenumber") % 2 == 0).alias("known"),
        (F.col("l_quantity") / 3.0001).alias("ramp"), (p / 9101.7773).alias("new_ramp"), (p / 70100.9991).alias("lead_x"), (p / 50300.1117).alias("tau_x"),
        (p / 8700.3331).alias("saved"), F.when(F.col("l_linenumber") > 3, "RECIPE_LIMIT").otherwise("PHYSICS_MODEL").alias("plan_source"),
        F.when(F.col("l_linenumber") == 1, "none").when(F.col("l_linenumber") < 4, "increase").otherwise("decrease").alias("direction"),
    )


TEXT_BASE = f"""k AS (SELECT {KEYS}, l_suppkey AS run_id, l_extendedprice / 106999.7713e0 AS prob, l_extendedprice / 53017.3331e0 - 1e0 AS r, l_quantity / 7.0001e0 AS lag_min, l_extendedprice / 91003.1717e0 AS mi,
  l_linenumber % 2 = 0 AS known, l_quantity / 3.0001e0 AS ramp, l_extendedprice / 9101.7773e0 AS new_ramp, l_extendedprice / 70100.9991e0 AS lead_x, l_extendedprice / 50300.1117e0 AS tau_x, l_extendedprice / 8700.3331e0 AS saved,
  CASE WHEN l_linenumber > 3 THEN 'RECIPE_LIMIT' ELSE 'PHYSICS_MODEL' END AS plan_source, CASE WHEN l_linenumber = 1 THEN 'none' WHEN l_linenumber < 4 THEN 'increase' ELSE 'decrease' END AS direction FROM lineitem)"""
SENT = {
    "risk": """'Breach risk ' || CAST(round_even(prob * 100e0, 0) AS BIGINT) || '%' ||
  CASE WHEN l_linenumber = 1 THEN '' ELSE '; drivers: r ' || CASE WHEN r >= 0 THEN '+' ELSE '' END || printf('%.3f', r) || ', mi +' || printf('%.3f', mi) END""",
    "link": """CASE WHEN known THEN 'Known link: ' ELSE 'New link: ' END || 'basis_weight follows tag' || l_linenumber || ' after ' || printf('%.2f', lag_min) || ' min; correlation ' || CASE WHEN r >= 0 THEN '+' ELSE '' END || printf('%.2f', r) || ', mutual information ' || printf('%.2f', mi)""",
    "plan": """'Ramp ' || printf('%.1f', ramp) || ' -> ' || printf('%.1f', new_ramp) || ' min, lead x ' || printf('%.2f', lead_x) || ', trim x ' || printf('%.2f', tau_x) ||
  CASE WHEN plan_source = 'RECIPE_LIMIT' THEN '; machine_speed needs ' || printf('%.1f', new_ramp) || ' min' ELSE '' END || '; off-spec time saved: ' || printf('%.2f', saved) || ' min'""",
    "knob": """'ramp_min' || CASE WHEN direction = 'none' THEN ': leave as it is, no probe settles sooner' ELSE ': ' || direction || ' by ' || printf('%.2f', abs(r)) || ', settling gains ' || printf('%.2f', saved) || ' min' END""",
}


def sentences() -> dict:
    c = F.col
    drivers = F.when(c("l_linenumber") == 1, F.array().cast("array<struct<feature:string,phi:double>>")).otherwise(
        F.array(F.struct(F.lit("r").alias("feature"), c("r").alias("phi")), F.struct(F.lit("mi").alias("feature"), c("mi").alias("phi")))
    )
    cause = F.concat(F.lit("tag"), c("l_linenumber").cast("string"))
    return {
        "risk": text.explain_risk(c("prob"), drivers),
        "link": text.explain_link(cause, F.lit("basis_weight"), c("lag_min"), c("r"), c("mi"), c("known")),
        "plan": text.explain_plan(c("ramp"), c("new_ramp"), c("lead_x"), c("tau_x"), c("saved"), c("plan_source"), c("new_ramp"), F.lit("machine_speed")),
        "knob": text.explain_knob(F.lit("ramp_min"), c("direction"), c("r"), c("saved")),
    }


R.add("explanations", lambda spark, sf: knob_rows(spark, sf).select(*KEY, *[v.alias(f"{k}_text") for k, v in sentences().items()]),
      with_(TEXT_BASE, body=f"SELECT {KEYS}, " + ", ".join(f"{v} AS {k}_text" for k, v in SENT.items()) + " FROM k"))


def advisories(spark: SparkSession, sf: str) -> DataFrame:
    rows, s, c = knob_rows(spark, sf), sentences(), F.col
    key = F.concat_ws("-", *[c(k).cast("string") for k in KEY])

    def ident(kind: str):
        return F.concat(F.lit(f"{kind}-"), key)

    risk = advice.advisory(rows, ident("risk"), F.lit("Breach risk"), F.lit("RISK_MODEL"), c("prob"), s["risk"], detail=["known"])
    link = advice.advisory(rows, ident("corr"), F.concat(F.lit("tag"), c("l_linenumber").cast("string"), F.lit(" -> basis_weight")), F.lit("CORRELATION_DISCOVERY"), F.least(F.abs("r"), F.lit(1.0)), s["link"], detail=["known"])
    plan = advice.advisory(rows, ident("opt"), F.concat(F.lit("Plan instead of a ramp of "), text.fixed(c("ramp"), 1), F.lit(" min")), c("plan_source"), F.lit(advice.TWIN_CONFIDENCE), s["plan"], c("saved") * 100.0, ["direction"])
    knob = advice.advisory(rows, ident("stab"), F.lit("Settle sooner: ramp_min"), F.lit("PHYSICS_MODEL"), F.lit(0.5), s["knob"], detail=["direction"])
    # advice without a price column of its own still fits the common schema
    return advice.union_advice(risk.drop("value_usd").select("*", F.lit(None).cast("double").alias("value_usd")), link, plan, knob)


def advisories_query(spark: SparkSession, sf: str) -> DataFrame:
    return advisories(spark, sf).select(
        "run_id", "id", "title", "source", "source_label", F.round("confidence", 6).alias("confidence"), "explanation", F.round("value_usd", 4).alias("value_usd"),
        F.concat_ws("=", F.element_at(F.map_keys("detail"), 1), F.element_at(F.map_values("detail"), 1)).alias("detail_text"),
    )


_ID = "l_orderkey || '-' || l_partkey || '-' || l_linenumber || '-' || l_suppkey"
R.add(
    "advisories",
    advisories_query,
    with_(TEXT_BASE, f"""adv AS (
  SELECT run_id, 'risk-' || {_ID} AS id, 'Breach risk' AS title, 'RISK_MODEL' AS source, prob AS confidence, {SENT['risk']} AS explanation, CAST(NULL AS DOUBLE) AS value_usd, 'known=' || known AS detail_text FROM k
  UNION ALL SELECT run_id, 'corr-' || {_ID}, 'tag' || l_linenumber || ' -> basis_weight', 'CORRELATION_DISCOVERY', least(abs(r), 1e0), {SENT['link']}, NULL, 'known=' || known FROM k
  UNION ALL SELECT run_id, 'opt-' || {_ID}, 'Plan instead of a ramp of ' || printf('%.1f', ramp) || ' min', plan_source, 0.75e0, {SENT['plan']}, saved * 100e0, 'direction=' || direction FROM k
  UNION ALL SELECT run_id, 'stab-' || {_ID}, 'Settle sooner: ramp_min', 'PHYSICS_MODEL', 0.5e0, {SENT['knob']}, NULL, 'direction=' || direction FROM k)""",
          body=f"SELECT run_id, id, title, source, {_LBL} AS source_label, round(confidence, 6) AS confidence, explanation, round(value_usd, 4) AS value_usd, detail_text FROM adv"),
)

# ---- tried plans: order lines of a part -----------------------------------


def outcomes(spark: SparkSession, sf: str, whole: bool = False) -> DataFrame:
    """Lines of a part as tried plans; the first line is the baseline, unless its order
    was returned, which leaves the part without one (``whole``: returned or not)."""
    rows = dt.read(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("run_id"), "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice",
        (F.col("l_extendedprice") / F.col("l_quantity") / 99.7).alias("off_spec_minutes"), F.col("l_extendedprice").alias("max_abs_dev_pct"),
        F.col("l_tax").alias("mean_abs_dev_pct"), (F.col("l_returnflag") == "R").alias("returned"),
    )
    first = rows.groupBy("run_id").agg(F.min(F.struct(*ORDER)).alias("_f"))
    return rows.join(first, "run_id").withColumn("is_baseline", (F.struct(*ORDER) == F.col("_f")) & (F.lit(whole) | ~F.col("returned"))).drop("_f")


ORDER = ["l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice"]
MEAS = ["off_spec_minutes", "max_abs_dev_pct", "mean_abs_dev_pct"]


def best_plans(spark: SparkSession, sf: str) -> DataFrame:
    return advice.best_plan(outcomes(spark, sf), "run_id", ORDER, "off_spec_minutes", F.col("l_quantity") >= LEAST, MEAS)


def plan_rejects(spark: SparkSession, sf: str) -> DataFrame:
    return advice.best_plan_rejects(outcomes(spark, sf), "run_id", ORDER, "off_spec_minutes", F.col("l_quantity") >= LEAST, MEAS)


LEAST = 20  # quantity of a feasible plan
OUT = f"""o AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY {', '.join(ORDER)}) = 1 AND l_returnflag <> 'R' AS is_baseline FROM (
  SELECT l_partkey AS run_id, l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice, l_returnflag, l_extendedprice / l_quantity / 99.7e0 AS off_spec_minutes, l_extendedprice AS max_abs_dev_pct, l_tax AS mean_abs_dev_pct FROM lineitem) q),
tried AS (SELECT n.run_id, n.n_evaluations, b.l_quantity AS base_q, c.run_id IS NOT NULL AS has_best, b.run_id IS NOT NULL AS has_base,
    {", ".join(f"b.{m} AS base_{m}, c.{m} AS best_{m}, b.{m} - c.{m} AS saved_{m}" for m in MEAS)}
  FROM (SELECT run_id, count(*) AS n_evaluations FROM o GROUP BY run_id) n LEFT JOIN (SELECT * FROM o WHERE is_baseline) b USING (run_id)
  LEFT JOIN (SELECT * FROM o WHERE l_quantity >= {LEAST} QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY off_spec_minutes, {', '.join(ORDER)}) = 1) c USING (run_id)),
bp AS (SELECT * EXCLUDE (base_q, has_best, has_base), CASE WHEN base_q >= {LEAST} THEN 'PHYSICS_MODEL' ELSE 'RECIPE_LIMIT' END AS source FROM tried WHERE has_best AND has_base)"""
R.add("best_plan_rejects", plan_rejects,
      with_(OUT, body="""SELECT run_id, n_evaluations, CASE WHEN has_base THEN 'no feasible plan' WHEN has_best THEN 'no baseline' ELSE 'no baseline and no feasible plan' END AS reason
  FROM tried WHERE NOT (has_best AND has_base)"""))
R.add("best_plan", lambda spark, sf: rounded(best_plans(spark, sf)),
      with_(OUT, body="SELECT run_id, " + ", ".join(f"round({p}_{m}, 6) AS {p}_{m}" for m in MEAS for p in ("base", "best", "saved")) + ", n_evaluations, source FROM bp"))


LEAST_ANY = 5  # quantity of a feasible plan of the summary, which judges every part it can
ALL_OUT = f"""o AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY {', '.join(ORDER)}) = 1 AS is_baseline FROM (
  SELECT l_partkey AS run_id, l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice, l_extendedprice / l_quantity / 99.7e0 AS off_spec_minutes, l_extendedprice AS max_abs_dev_pct, l_tax AS mean_abs_dev_pct FROM lineitem) q),
bp AS (SELECT b.run_id, {", ".join(f"b.{m} AS base_{m}, c.{m} AS best_{m}, b.{m} - c.{m} AS saved_{m}" for m in MEAS)},
  (SELECT count(*) FROM o x WHERE x.run_id = b.run_id) AS n_evaluations, CASE WHEN b.l_quantity >= {LEAST_ANY} THEN 'PHYSICS_MODEL' ELSE 'RECIPE_LIMIT' END AS source
  FROM (SELECT * FROM o WHERE is_baseline) b JOIN (SELECT * FROM o WHERE l_quantity >= {LEAST_ANY} QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY off_spec_minutes, {', '.join(ORDER)}) = 1) c USING (run_id))"""


def improvements(spark: SparkSession, sf: str) -> DataFrame:
    plans = advice.best_plan(outcomes(spark, sf, whole=True), "run_id", ORDER, "off_spec_minutes", F.col("l_quantity") >= LEAST_ANY, MEAS)
    rows = dt.read(spark, sf, "part").select(F.col("p_partkey").alias("run_id"), (F.lit(40.0) + F.col("p_partkey") % 120).alias("basis_weight"), (F.lit(400.0) + F.col("p_size")).alias("machine_speed")).join(plans, "run_id", "left")
    rows = rows.withColumn("confidence", F.lit(advice.TWIN_CONFIDENCE)).withColumn("cost_usd", F.lit(0.0))
    priced, _ = advice.price_comparison(rows, "base_off_spec_minutes", "best_off_spec_minutes", ECON)
    return staged(priced)


R.add(
    "improvement_summary",
    lambda spark, sf: rounded(advice.improvement_summary(improvements(spark, sf), "saved_off_spec_minutes", "value_usd"), 5),
    with_(ALL_OUT, """v AS (SELECT saved_off_spec_minutes AS s, source, CASE WHEN saved_off_spec_minutes IS NOT NULL THEN 0.75e0 END * (greatest(base_off_spec_minutes - best_off_spec_minutes, 0e0) * ((400e0 + p_size) * 6e0 * (40e0 + p_partkey % 120) / 1e6) * 137e0) AS value FROM part LEFT JOIN bp ON run_id = p_partkey)""",
          body="""SELECT count(s) AS n_evaluated, count(*) - count(s) AS n_skipped, count(*) FILTER (WHERE s > 1e-6) AS n_success, round(count(*) FILTER (WHERE s > 1e-6) / count(s)::DOUBLE, 5) AS success_rate,
  round(avg(s), 5) AS mean_saved, round(quantile_cont(s, 0.5), 5) AS median_saved, round(quantile_cont(s, 0.95), 5) AS p95_saved, round(max(s), 5) AS max_saved,
  round(avg(value), 5) AS mean_value_usd, round(quantile_cont(value, 0.5), 5) AS median_value_usd, round(quantile_cont(value, 0.95), 5) AS p95_value_usd, round(sum(value), 5) AS total_value_usd,
  count(*) FILTER (WHERE source = 'RECIPE_LIMIT') AS n_recipe_limit, count(s) - count(*) FILTER (WHERE source = 'RECIPE_LIMIT') AS n_physics_model FROM v WHERE s IS NOT NULL OR true"""),
)
KNOBS = ["ramp_min", "lead_scale", "tau_c_scale"]


def grid_plans(spark: SparkSession, sf: str) -> DataFrame:
    return dt.read(spark, sf, "part").select(
        F.col("p_partkey").alias("plan_id"), (F.col("p_size") / 2.3).alias("ramp_min"), (F.col("p_retailprice") / 1713.0).alias("lead_scale"),
        (F.col("p_size") / 19.0).alias("tau_c_scale"), (F.col("p_partkey") % 23 / 1.7).alias("floor_min"),
    )


R.add(
    "candidate_grid",
    lambda spark, sf: rounded(advice.candidate_grid(grid_plans(spark, sf), KNOBS, per_knob=5, round_no=1, floor_min="floor_min").select("plan_id", "knob", "value", *[f"try_{k}" for k in KNOBS])),
    with_("g AS (SELECT p_partkey AS plan_id, p_size / 2.3e0 AS ramp_min, p_retailprice / 1713e0 AS lead_scale, p_size / 19e0 AS tau_c_scale, p_partkey % 23 / 1.7e0 AS floor_min FROM part)",
          "b0 AS (SELECT *, 'ramp_min' AS knob, ramp_min AS cur, greatest(2e0, floor_min) AS lo0, greatest(25e0, greatest(2e0, floor_min) + 1e-6) AS hi0 FROM g UNION ALL SELECT *, 'lead_scale', lead_scale, 0.5e0, 1.6e0 FROM g UNION ALL SELECT *, 'tau_c_scale', tau_c_scale, 0.5e0, 2.2e0 FROM g)",
          "b1 AS (SELECT *, greatest(lo0, cur - (hi0 - lo0) * 0.45e0 / 2e0) AS lo, least(hi0, cur + (hi0 - lo0) * 0.45e0 / 2e0) AS hi FROM b0)",
          "b2 AS (SELECT *, lo + i * ((hi - lo) / 4e0) AS value FROM b1, range(0, 5) r(i) WHERE hi > lo OR i = 0)",
          "b3 AS (SELECT plan_id, knob, CASE WHEN hi <= lo THEN lo ELSE value END AS value, ramp_min, lead_scale, tau_c_scale FROM b2)",
          body="SELECT plan_id, knob, round(value, 6) AS value, " + ", ".join(f"round(CASE WHEN knob = '{k}' THEN value ELSE {k} END, 6) AS try_{k}" for k in KNOBS) + " FROM b3"),
)


DELTAS = (0.0, -2.0, 2.0, 0.5, -1.0, 1.0, 3.0)


def probes(spark: SparkSession, sf: str) -> DataFrame:
    """Per part and return flag: line 1 is the baseline, the others are probed
    changes (delta by line number), the mean quantity is the settle time."""
    delta = F.element_at(F.array(*[F.lit(x) for x in DELTAS]), F.pmod(F.col("l_linenumber") - 1, F.lit(len(DELTAS))).cast("int") + 1)
    return (
        dt.read(spark, sf, "lineitem")
        .groupBy(F.col("l_partkey").alias("run_id"), F.col("l_returnflag").alias("parameter"), F.col("l_linenumber").alias("place"), delta.alias("delta"))
        .agg(F.avg("l_quantity").alias("_q"))
        .select("run_id", "parameter", "place", "delta", F.when(F.col("_q") < 40, F.col("_q") / 1.3).alias("settle_min"), (F.col("run_id") / 7.0).alias("base_value"))
    )


def sensitivities(spark: SparkSession, sf: str) -> DataFrame:
    return advice.sensitivity(probes(spark, sf), 30.0)


PROBES = f"p AS (SELECT l_partkey AS run_id, l_returnflag AS parameter, l_linenumber AS place, [{', '.join(d(x) for x in DELTAS)}][(l_linenumber - 1) % {len(DELTAS)} + 1] AS delta, avg(l_quantity) AS q FROM lineitem GROUP BY ALL)"
R.add(
    "sensitivity_rejects",
    lambda spark, sf: advice.sensitivity_rejects(probes(spark, sf)),
    with_(PROBES, body="""SELECT run_id, parameter, count(*) AS n_tries, CASE WHEN bool_or(delta = 0) THEN 'no probe' ELSE 'no baseline' END AS reason
  FROM p GROUP BY ALL HAVING NOT (bool_or(delta = 0) AND bool_or(delta <> 0))"""),
)
R.add(
    "sensitivity_rank",
    lambda spark, sf: rounded(sensitivities(spark, sf)),
    with_(PROBES,
          "s AS (SELECT *, coalesce(CASE WHEN q < 40 THEN q / 1.3e0 END, 30e0) AS st FROM p)",
          "b AS (SELECT run_id, parameter, st AS bs FROM s WHERE delta = 0)",
          "x AS (SELECT s.*, bs, (st - bs) / nullif(delta, 0) AS slope FROM s JOIN b USING (run_id, parameter))",
          "steep AS (SELECT run_id, parameter, slope FROM x WHERE delta <> 0 QUALIFY row_number() OVER (PARTITION BY run_id, parameter ORDER BY abs(slope) DESC, place) = 1)",
          "best AS (SELECT run_id, parameter, delta, st, bs FROM x QUALIFY row_number() OVER (PARTITION BY run_id, parameter ORDER BY st, CASE WHEN delta = 0 THEN 1 ELSE 0 END, place) = 1)",
          body="""SELECT run_id, parameter, round(run_id / 7e0, 6) AS baseline_value, round(bs, 6) AS baseline_settle_min, round(slope, 6) AS sensitivity_min_per_unit,
  CASE WHEN delta > 0 THEN 'increase' WHEN delta < 0 THEN 'decrease' ELSE 'none' END AS best_direction, delta AS best_delta, round(st, 6) AS best_settle_min, round(bs - st, 6) AS improvement_min FROM best JOIN steep USING (run_id, parameter)"""),
)

# ---- economics, cleaning, clipping ----------------------------------------


def economics_updates(spark: SparkSession, sf: str) -> DataFrame:
    return dt.read(spark, sf, "customer").select(
        "c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal")).alias("net_margin_per_tonne"),
        (F.col("c_custkey") % 450).cast("double").alias("operating_days_per_year"),
        F.when(F.col("c_custkey") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("c_nationkey") / 10.0).alias("low_multiplier"),
        F.lit("x").alias("unknown_field"),
    )


R.add(
    "economics_overlay",
    lambda spark, sf: rounded(advice.overlay_economics(economics_updates(spark, sf))[0].drop("unknown_field")),
    """SELECT c_custkey, round(coalesce(CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal END, 95e0), 6) AS net_margin_per_tonne, 42e0 AS rework_cost_per_tonne, 9e0 AS steam_cost_per_gj, 2.4e0 AS steam_gj_per_tonne,
  3.2e0 AS grade_changes_per_day, CAST(c_custkey % 450 AS DOUBLE) AS operating_days_per_year, round(c_nationkey / 10e0, 6) AS low_multiplier, 1.35e0 AS high_multiplier
FROM customer WHERE (c_custkey % 3 = 0 OR c_acctbal >= 0) AND c_custkey % 450 > 0 AND c_custkey % 450 <= 366 AND c_custkey % 7 <> 0 AND c_nationkey > 0""",
)


R.add(
    "economics_rejects",
    lambda spark, sf: advice.overlay_economics(economics_updates(spark, sf))[1].select("c_custkey", "operating_days_per_year"),
    """SELECT c_custkey, CAST(c_custkey % 450 AS DOUBLE) AS operating_days_per_year FROM customer
WHERE NOT ((c_custkey % 3 = 0 OR c_acctbal >= 0) AND c_custkey % 450 > 0 AND c_custkey % 450 <= 366 AND c_custkey % 7 <> 0 AND c_nationkey > 0)""",
)


def broken_values(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("value")
    return dt.read(spark, sf, "events").select(
        "event_id", "event_type",
        F.when(v > 150, F.lit(float("inf"))).when(v < 5, F.lit(float("nan"))).when(v < 10, F.lit(float("-inf"))).otherwise(v).alias("value"),
        F.when(v < 20, F.lit(float("nan")).cast("float")).otherwise(F.lit(1.5).cast("float")).alias("weight"),
    )


R.add("nan_to_null", lambda spark, sf: rounded(finite_or_null(broken_values(spark, sf)), 2),
      "SELECT event_id, event_type, CASE WHEN value >= 10 AND value <= 150 THEN round(value, 2) END AS value, CASE WHEN value >= 20 THEN 1.5e0 END AS weight FROM events")


def clipped_tags(spark: SparkSession, sf: str) -> DataFrame:
    """Long tag values held inside the bounds of their tag (a joined table)."""
    bounds = spark.createDataFrame([(t, lo, hi) for t, (lo, hi) in DV_BOUNDS.items()], "tag string, lo double, hi double")
    tags = list(DV_BOUNDS)
    long = dt.read(spark, sf, "events").select("event_id", *[dt_tag(t).alias(t) for t in tags]).unpivot(["event_id"], tags, "tag", "value")
    return long.join(bounds, "tag").select("event_id", "tag", clip(F.col("value"), F.col("lo"), F.col("hi")).alias("value"))


def dt_tag(tag: str):
    a, b = dt.PULL[tag]
    return dt.NOMINAL[tag] * (1.0 + a * (F.col("value") - 50.0) + b * (dt.counter() - 50))


R.add(
    "clip_to_bounds",
    lambda spark, sf: rounded(clipped_tags(spark, sf)),
    "SELECT event_id, tag, round(v, 6) AS value FROM (" + " UNION ALL ".join(
        f"SELECT event_id, '{t}' AS tag, least(greatest({d(dt.NOMINAL[t])} * (1e0 + {d(dt.PULL[t][0])} * (value - 50e0) + {d(dt.PULL[t][1])} * (k - 50)), {d(lo)}), {d(hi)}) AS v FROM ev"
        for t, (lo, hi) in DV_BOUNDS.items()) + ") q",
)
R.oracles["clip_to_bounds"] = "WITH ev AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) " + R.oracles["clip_to_bounds"]

# ---- ledger ---------------------------------------------------------------
R.add("latest_response", lambda spark, sf: led.paired(dt.ledger(spark, sf)).select("advisory_id", "source", "decision", F.round("confidence", 6).alias("confidence")),
      with_(LEDGER, LATEST, body="SELECT advisory_id, source, decision, round(confidence, 6) AS confidence FROM latest"))
R.add("ledger_orphans", lambda spark, sf: led.orphans(dt.ledger(spark, sf)).select("entry_id", "advisory_id", "decision", "seq"),
      with_(LEDGER, body="SELECT entry_id, advisory_id, decision, seq FROM ledger WHERE kind = 'response' AND advisory_id NOT IN (SELECT advisory_id FROM ledger WHERE kind = 'surfaced')"))


def answers(spark: SparkSession, sf: str) -> DataFrame:
    return dt.ledger(spark, sf).where(F.col("kind") == "response").select(
        "advisory_id", F.when(F.col("seq") % 11 == 0, "maybe").otherwise(F.col("decision")).alias("decision"), "note", "timestamp", "seq")


R.add("response_rejects", lambda spark, sf: led.record_responses(answers(spark, sf), dt.ledger(spark, sf))[1].select("advisory_id", "seq", "reason"),
      with_(LEDGER, body="SELECT advisory_id, seq, CASE WHEN seq % 11 = 0 THEN 'unknown decision' ELSE 'never surfaced' END AS reason FROM ledger WHERE kind = 'response' AND (seq % 11 = 0 OR advisory_id NOT IN (SELECT advisory_id FROM ledger WHERE kind = 'surfaced'))"))
R.add("response_accepts", lambda spark, sf: led.record_responses(answers(spark, sf), dt.ledger(spark, sf))[0].select("advisory_id", "seq", "kind", "decision"),
      with_(LEDGER, body="SELECT advisory_id, seq, kind, decision FROM ledger WHERE kind = 'response' AND seq % 11 <> 0 AND advisory_id IN (SELECT advisory_id FROM ledger WHERE kind = 'surfaced')"))
TRUST = """SELECT (SELECT count(DISTINCT advisory_id) FROM ledger WHERE kind = 'surfaced') AS n_surfaced, count(*) AS n_responded, round(count(*) FILTER (WHERE decision = 'accepted') / count(*)::DOUBLE, 6) AS acceptance_rate,
  round(avg(CASE WHEN decision = 'accepted' THEN confidence END), 6) AS mean_confidence_accepted, round(avg(CASE WHEN decision = 'rejected' THEN confidence END), 6) AS mean_confidence_rejected,
  round(coalesce(sum(CASE WHEN decision = 'accepted' THEN value_usd END), 0), 3) AS realized_value_usd FROM latest"""


def trust(log: DataFrame) -> DataFrame:
    out = led.trust_summary(log)
    return rounded(out.withColumn("realized_value_usd", F.round("realized_value_usd", 3)))


R.add("trust_summary", lambda spark, sf: trust(dt.ledger(spark, sf)), with_(LEDGER, LATEST, body=TRUST))
R.add("trust_by_source", lambda spark, sf: rounded(led.trust_by_source(dt.ledger(spark, sf))),
      with_(LEDGER, LATEST, body="SELECT source, count(*) AS n_responded, round(count(*) FILTER (WHERE decision = 'accepted') / count(*)::DOUBLE, 6) AS acceptance_rate FROM latest GROUP BY source"))


def ledger_view(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    return dt.ledger(spark, sf).select(
        "seq", text.utc_text(c("timestamp")).alias("at"), text.one_line(c("advisory_id"), 8).alias("advisory"),
        F.coalesce("decision", F.lit("-")).alias("decision"), F.coalesce("source", F.lit("-")).alias("source"), text.one_line(c("note"), 24).alias("note"),
    ).orderBy(F.desc("seq")).limit(500)


R.add(
    "ledger_view",
    ledger_view,
    with_(LEDGER, "n AS (SELECT *, trim(regexp_replace(regexp_replace(coalesce(note, ''), '[[:cntrl:]]', ' ', 'g'), '\\s+', ' ', 'g')) AS c FROM ledger)",
          body="""SELECT seq, strftime(make_timestamp(CAST(floor("timestamp") AS BIGINT) * 1000000), '%Y-%m-%d %H:%M:%S') AS at, CASE WHEN length(advisory_id) <= 8 THEN advisory_id ELSE left(advisory_id, 7) || '…' END AS advisory,
  coalesce(decision, '-') AS decision, coalesce(source, '-') AS source, CASE WHEN length(c) <= 24 THEN c ELSE left(c, 23) || '…' END AS note FROM n ORDER BY seq DESC LIMIT 500"""),
)


def ledger_append(spark: SparkSession, sf: str) -> DataFrame:
    """Append surfaced entries, then answers, each twice as a retried job would, and read
    the ledger back."""
    path = staging_path(spark, "ledger")
    log = dt.ledger(spark, sf)
    for kind in ("surfaced", "surfaced", "response", "response"):
        led.append_ledger(log.where(F.col("kind") == kind), path, kind)
    return led.read_ledger(spark, path).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("last_seq"), F.round(F.sum("confidence"), 4).alias("confidence_sum"))


R.add("ledger_append", ledger_append, with_(LEDGER, body="SELECT kind, count(*) AS n, max(seq) AS last_seq, round(sum(confidence), 4) AS confidence_sum FROM ledger GROUP BY kind"))


def ledger_read(spark: SparkSession, sf: str) -> DataFrame:
    path = staging_path(spark, "ledger")
    led.append_ledger(dt.ledger(spark, sf), path)
    return trust(led.read_ledger(spark, path))


R.add("ledger_read", ledger_read, with_(LEDGER, LATEST, body=TRUST))
