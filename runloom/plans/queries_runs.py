"""Sources, per-sample expressions, labels and windows on the shared tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom.dims import DV_NOMINAL, DV_TAGS, ENVELOPE, MV_TAGS, SLEW_LIMITS
from runloom.functions import series, sheet
from runloom.functions.numeric import clip, flag, rounded
from runloom.operators import features as feat
from runloom.operators import labels as lab
from runloom.operators import targets
from runloom.operators.segments import over_runs
from runloom.plans import oracle_base as ob
from runloom.plans.oracle_base import BAND, BASE, EV, GRADES, PLANS, WIDE, d, with_
from runloom.plans.registry import Registry
from runloom.sources import driver_tables as dt
from runloom.sources import runs
from runloom.sources.driver_tables import SPEC

R = Registry()
OW = ob.W
H, WARM, DWELL = SPEC.horizon, SPEC.warmup, SPEC.dwell
HALF, ONE, TWO = SPEC.steps(0.5), SPEC.steps(1.0), SPEC.steps(2.0)


def deviations(spark: SparkSession, sf: str) -> DataFrame:
    return dt.samples(spark, sf).withColumn("bw_dev_pct", series.deviation_pct(F.col("value"), F.col("sp")))


def meta_rows(spark: SparkSession, sf: str) -> DataFrame:
    return dt.run_plans(spark, sf).withColumn(
        "primary_cause", F.coalesce(F.get("fault_codes", F.lit(0)), F.lit("NONE"))
    )


def run_labels(spark: SparkSession, sf: str) -> DataFrame:
    goals = dt.grades(spark, sf).select(F.col("code").alias("to_grade"), F.col("basis_weight").alias("final_target"))
    constants = meta_rows(spark, sf).join(goals, "to_grade", "left").select("run_id", "n_samples", "final_target", "plan_start_min")
    return lab.run_labels(dt.wide_samples(spark, sf), SPEC, constants=constants)


def feature_table(spark: SparkSession, sf: str) -> DataFrame:
    return feat.wide_features(dt.wide_samples(spark, sf), meta_rows(spark, sf), dt.grades(spark, sf), SPEC)


# ---- sources --------------------------------------------------------------
R.add(
    "load_samples",
    lambda spark, sf: rounded(
        dt.samples(spark, sf).select("run_id", "sample_idx", "t_min", "event_type", "value", "sp")
    ),
    with_(BASE, body="SELECT run_id, sample_idx, round(t_min, 6) AS t_min, event_type, round(value, 6) AS value, round(sp, 6) AS sp FROM s"),
)

META = """meta AS (
  SELECT *, CASE WHEN fault_text = '' THEN 'NONE' ELSE split_part(fault_text, '|', 1) END AS primary_cause FROM plans)"""
LABELS = f"""marked AS (
  SELECT w.*, g.basis_weight AS final_target, p.plan_start_min,
         (min(CAST(abs(w.basis_weight - g.basis_weight) <= g.basis_weight * {d(SPEC.settle_tol_pct)} / 100e0 AS INTEGER))
            OVER (PARTITION BY w.run_id ORDER BY w.sample_idx ROWS BETWEEN {DWELL - 1} PRECEDING AND CURRENT ROW) = 1
          AND w.sample_idx >= {DWELL - 1}) AS held
  FROM wide w JOIN plans p USING (run_id) JOIN grades g ON g.code = p.to_grade),
labels AS (
  SELECT run_id,
    CAST(max(CAST(abs(dev) > {BAND} AS INTEGER)) AS DOUBLE) AS off_spec,
    sum(CAST(abs(dev) > {BAND} AS INTEGER)) * ({d(SPEC.dt_s)} / 60e0) AS off_spec_minutes,
    max(abs(dev)) AS max_abs_dev_pct, avg(abs(dev)) AS mean_abs_dev_pct,
    min(CASE WHEN abs(dev) > {BAND} THEN sample_idx END) * {d(SPEC.dt_s)} / 60e0 AS first_breach_min,
    min(CASE WHEN held AND sample_idx - {DWELL - 1} >= plan_start_min * 60e0 / {d(SPEC.dt_s)} THEN sample_idx - {DWELL - 1} END)
      * {d(SPEC.dt_s)} / 60e0 - any_value(plan_start_min) AS settle_min,
    arg_max(basis_weight - final_target, sample_idx) AS final_bw_error,
    sum(CAST(abs(moisture - moisture_sp) > {d(SPEC.moisture_band)} AS INTEGER)) * ({d(SPEC.dt_s)} / 60e0) AS moisture_off_spec_min,
    sum(CAST(abs(ash - ash_sp) > {d(SPEC.ash_band)} AS INTEGER)) * ({d(SPEC.dt_s)} / 60e0) AS ash_off_spec_min,
    count(*) AS n_samples
  FROM marked GROUP BY run_id)"""
LABEL_CTES = (BASE, WIDE, GRADES, PLANS, META, LABELS)
LABEL_COLS = ("off_spec", "off_spec_minutes", "max_abs_dev_pct", "mean_abs_dev_pct", "first_breach_min",
              "settle_min", "final_bw_error", "moisture_off_spec_min", "ash_off_spec_min")


def _r(*cols: str, digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in cols)


R.add(
    "run_labels",
    lambda spark, sf: rounded(run_labels(spark, sf)),
    with_(*LABEL_CTES, body=f"SELECT run_id, {_r(*LABEL_COLS)}, n_samples, CAST(settle_min IS NOT NULL AS DOUBLE) AS settled FROM labels"),
)
R.add(
    "settle_time",
    lambda spark, sf: rounded(run_labels(spark, sf).select("run_id", "settle_min", "settled")),
    with_(*LABEL_CTES, body="SELECT run_id, round(settle_min, 6) AS settle_min, CAST(settle_min IS NOT NULL AS DOUBLE) AS settled FROM labels"),
)
R.add(
    "run_list",
    lambda spark, sf: rounded(runs.list_runs(run_labels(spark, sf), meta_rows(spark, sf))),
    with_(*LABEL_CTES, body=f"SELECT run_id, from_grade, to_grade, primary_cause, {_r('off_spec', 'off_spec_minutes', 'max_abs_dev_pct', 'settle_min')} FROM labels JOIN meta USING (run_id)"),
)
R.add(
    "worst_run",
    lambda spark, sf: rounded(runs.worst_run(run_labels(spark, sf)).select("run_id", "max_abs_dev_pct")),
    with_(*LABEL_CTES, body="SELECT run_id, round(max_abs_dev_pct, 6) AS max_abs_dev_pct FROM labels ORDER BY labels.max_abs_dev_pct DESC, run_id LIMIT 1"),
)


def run_detail(spark: SparkSession, sf: str) -> DataFrame:
    packed = runs.run_arrays(dt.samples(spark, sf), ["t_min", "event_type", "value"])
    return packed.select(
        "run_id", "part", F.size("value").alias("n"), F.array_join("event_type", ",").alias("event_types"),
        F.array_join(F.transform("value", lambda v: F.format_string("%.2f", v)), ",").alias("values_text"),
    )


R.add(
    "run_detail",
    run_detail,
    with_(BASE, body="""SELECT run_id, CAST(0 AS INTEGER) AS part, CAST(count(*) AS INTEGER) AS n,
  string_agg(event_type, ',' ORDER BY sample_idx) AS event_types,
  string_agg(printf('%.2f', value), ',' ORDER BY sample_idx) AS values_text FROM s GROUP BY run_id"""),
)


def asof_cursor(spark: SparkSession, sf: str) -> DataFrame:
    rows = dt.samples(spark, sf).where(F.col("sample_idx") >= WARM).select(
        "run_id", "sample_idx", "t_min", "value"
    )
    cursors = dt.read(spark, sf, "events").select(F.col("user_id").alias("run_id")).distinct().select(
        "run_id", F.explode(F.array(*[F.lit(x) for x in (0.2, 3.3, 7.7)])).alias("cursor")
    )
    strict = runs.at_cursor(rows, cursors).select(
        "run_id", "cursor", F.col("sample_idx").cast("double").alias("strict_idx"), F.col("value").alias("strict_value")
    )
    relaxed = runs.at_cursor(rows, cursors, fallback_first=True).select(
        "run_id", "cursor", F.col("sample_idx").alias("idx"), "value"
    )
    return strict.join(relaxed, ["run_id", "cursor"])


R.add(
    "asof_cursor",
    asof_cursor,
    with_(BASE, f"rows_ AS (SELECT run_id, sample_idx, t_min, value FROM s WHERE sample_idx >= {WARM})",
          "cur AS (SELECT DISTINCT user_id AS run_id, c AS cursor FROM events, (VALUES (0.2e0), (3.3e0), (7.7e0)) v(c))",
          body="""SELECT run_id, cursor,
  CAST(arg_max(CASE WHEN t_min <= cursor THEN sample_idx END, CASE WHEN t_min <= cursor THEN t_min END) AS DOUBLE) AS strict_idx,
  arg_max(CASE WHEN t_min <= cursor THEN value END, CASE WHEN t_min <= cursor THEN t_min END) AS strict_value,
  coalesce(arg_max(CASE WHEN t_min <= cursor THEN sample_idx END, CASE WHEN t_min <= cursor THEN t_min END), arg_min(sample_idx, t_min)) AS idx,
  coalesce(arg_max(CASE WHEN t_min <= cursor THEN value END, CASE WHEN t_min <= cursor THEN t_min END), arg_min(value, t_min)) AS value
FROM cur JOIN rows_ USING (run_id) GROUP BY run_id, cursor"""),
)

# ---- per-sample expressions -----------------------------------------------
R.add(
    "deviation_pct",
    lambda spark, sf: rounded(deviations(spark, sf).select("run_id", "sample_idx", "bw_dev_pct")),
    with_(BASE, body="SELECT run_id, sample_idx, round(dev, 6) AS bw_dev_pct FROM s"),
)
R.add(
    "off_spec_flags",
    lambda spark, sf: rounded(
        deviations(spark, sf).select(
            "run_id", "sample_idx",
            flag(series.out_of_band(F.col("bw_dev_pct"), SPEC.band_pct)).alias("currently_off_spec"),
            series.headroom(F.col("bw_dev_pct"), SPEC.band_pct).alias("headroom_pct"),
        )
    ),
    with_(BASE, body=f"SELECT run_id, sample_idx, CAST(abs(dev) > {BAND} AS DOUBLE) AS currently_off_spec, round({BAND} - abs(dev), 6) AS headroom_pct FROM s"),
)


def with_plans(spark: SparkSession, sf: str) -> DataFrame:
    return dt.samples(spark, sf).join(meta_rows(spark, sf), "run_id")


R.add(
    "ramp_phase",
    lambda spark, sf: rounded(
        with_plans(spark, sf).select(
            "run_id", "sample_idx",
            *[c.alias(n) for n, c in series.ramp_phase(F.col("t_min"), F.col("plan_start_min"), F.col("plan_ramp_min")).items()],
        )
    ),
    with_(BASE, PLANS, body="""SELECT run_id, sample_idx, round(t_min - plan_start_min, 6) AS t_since_ramp_min,
  round(least(greatest((t_min - plan_start_min) / greatest(plan_ramp_min, 1e-6), 0e0), 1e0), 6) AS ramp_progress,
  CAST(t_min >= plan_start_min AND t_min <= plan_start_min + plan_ramp_min AS DOUBLE) AS in_ramp,
  CAST(t_min > plan_start_min + plan_ramp_min AS DOUBLE) AS post_ramp
FROM s JOIN plans USING (run_id)"""),
)


def listed_grades(spark: SparkSession, sf: str) -> DataFrame:
    """A grade table that lacks one of the codes in use."""
    return dt.grades(spark, sf).where(F.col("code") != "signup")


R.add(
    "grade_rejects",
    lambda spark, sf: feat.grade_rejects(meta_rows(spark, sf), listed_grades(spark, sf)),
    with_(EV, PLANS, body="""SELECT run_id, 'from_grade' AS "end", from_grade AS code FROM plans WHERE from_grade = 'signup'
UNION ALL SELECT run_id, 'to_grade', to_grade FROM plans WHERE to_grade = 'signup'"""),
)


def setpoint_curve(spark: SparkSession, sf: str) -> DataFrame:
    g = dt.grades(spark, sf)
    names = ("basis_weight", "moisture", "ash")
    a = g.select(F.col("code").alias("from_grade"), *[F.col(n).alias(f"a_{n}") for n in names])
    b = g.select(F.col("code").alias("to_grade"), *[F.col(n).alias(f"b_{n}") for n in names])
    # every third run is a step, the others ramp
    ramp = F.when(F.col("run_id") % 3 == 0, F.lit(0.0)).otherwise(F.col("plan_ramp_min"))
    rows = with_plans(spark, sf).join(a, "from_grade").join(b, "to_grade")
    rows = rows.withColumn("fraction", series.ramp_fraction(F.col("t_min"), F.col("plan_start_min"), ramp))
    return rows.select(
        "run_id", "sample_idx", "fraction",
        *[series.blend(F.col(f"a_{n}"), F.col(f"b_{n}"), F.col("fraction")).alias(f"{n}_sp") for n in names],
    )


R.add(
    "setpoint_curve",
    lambda spark, sf: rounded(setpoint_curve(spark, sf)),
    with_(BASE, GRADES, PLANS, """u AS (SELECT s.run_id, sample_idx, from_grade, to_grade, t_min, plan_start_min,
   CASE WHEN s.run_id % 3 = 0 THEN 0e0 ELSE plan_ramp_min END AS ramp FROM s JOIN plans USING (run_id))""",
   """f AS (SELECT *, CASE WHEN ramp <= 0 THEN CAST(t_min >= plan_start_min AS DOUBLE) ELSE x * x * (3e0 - 2e0 * x) END AS fraction
   FROM (SELECT *, least(greatest((t_min - plan_start_min) / nullif(ramp, 0), 0e0), 1e0) AS x FROM u) q)""",
   body="""SELECT run_id, sample_idx, round(fraction, 6) AS fraction,
  round(a.basis_weight + (b.basis_weight - a.basis_weight) * fraction, 6) AS basis_weight_sp,
  round(a.moisture + (b.moisture - a.moisture) * fraction, 6) AS moisture_sp,
  round(a.ash + (b.ash - a.ash) * fraction, 6) AS ash_sp
FROM f JOIN grades a ON a.code = from_grade JOIN grades b ON b.code = to_grade"""),
)


def transition_context(spark: SparkSession, sf: str) -> DataFrame:
    names = ("basis_weight", "moisture", "ash", "machine_speed")
    g = dt.grades(spark, sf)
    a = g.select(F.col("code").alias("from_grade"), *[F.col(n).alias(f"a_{n}") for n in names])
    b = g.select(F.col("code").alias("to_grade"), *[F.col(n).alias(f"b_{n}") for n in names])
    # the grade of the previous sample against the grade of this one
    w_rows = over_runs(
        dt.samples(spark, sf).select("run_id", "sample_idx", "event_type"),
        lambda rows, w: rows.withColumn("from_grade", F.lag("event_type").over(w)),
        back=1,
    ).withColumnRenamed("event_type", "to_grade")
    # the first sample of a run has no grade before it
    return w_rows.join(a, "from_grade", "left").join(b, "to_grade").select(
        "run_id", "sample_idx", "from_grade", "to_grade",
        *[c.alias(n) for n, c in series.transition_context("a_", "b_").items()],
    )


TRANSITION_SQL = """a.basis_weight AS bw_from, b.basis_weight AS bw_to,
  (b.basis_weight - a.basis_weight) / a.basis_weight * 100e0 AS bw_change_pct,
  b.ash - a.ash AS ash_change, b.moisture - a.moisture AS moisture_change,
  (b.machine_speed - a.machine_speed) / a.machine_speed * 100e0 AS speed_change_pct,
  abs(b.basis_weight - a.basis_weight) / greatest(a.basis_weight, 1e-6) + abs(b.ash - a.ash) / 30e0 * 5e-1
    + abs(b.machine_speed - a.machine_speed) / greatest(a.machine_speed, 1e-6) * 5e-1 AS transition_magnitude"""
TRANSITION_COLS = ("bw_from", "bw_to", "bw_change_pct", "ash_change", "moisture_change", "speed_change_pct", "transition_magnitude")
R.add(
    "transition_context",
    lambda spark, sf: rounded(transition_context(spark, sf)),
    with_(EV, GRADES, f"x AS (SELECT run_id, sample_idx, lag(event_type) OVER ({OW}) AS from_grade, event_type AS to_grade FROM ev)",
          f"y AS (SELECT run_id, sample_idx, from_grade, to_grade, {TRANSITION_SQL} FROM x LEFT JOIN grades a ON a.code = from_grade JOIN grades b ON b.code = to_grade)",
          body=f"SELECT run_id, sample_idx, from_grade, to_grade, {_r(*TRANSITION_COLS)} FROM y"),
)
R.add(
    "spec_bands",
    lambda spark, sf: rounded(
        dt.read(spark, sf, "part").select(
            F.col("p_partkey").alias("code"),
            *[c.alias(n) for n, c in series.spec_band(F.col("p_retailprice"), 2.5).items()],
        )
    ),
    "SELECT p_partkey AS code, round(p_retailprice * 25e-1 / 100e0, 6) AS tolerance, round(p_retailprice - p_retailprice * 25e-1 / 100e0, 6) AS band_lo, round(p_retailprice + p_retailprice * 25e-1 / 100e0, 6) AS band_hi FROM part",
)

SENSOR_FROM_LINEITEM = {
    "stock_flow": "5.0D + l_quantity", "filler_flow": "l_discount * 10.0D", "steam_pressure": "120.0D + l_extendedprice / 100.0D",
    "machine_speed": "300.0D + l_suppkey % 900", "retention_aid": "100.0D + l_tax * 1000.0D", "headbox_consistency": "0.007D + l_tax / 20.0D",
    "broke_ratio": "l_tax * 2.0D", "wire_drainage_index": "0.9D + l_discount", "white_water_freeness": "300.0D + l_quantity * 2.0D",
    "press_load": "280.0D + l_linenumber * 10.0D", "ambient_humidity": "30.0D + l_quantity",
}


def soft_sensor(spark: SparkSession, sf: str) -> DataFrame:
    inputs = {k: F.expr(v) for k, v in SENSOR_FROM_LINEITEM.items()}
    return dt.read(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", *[c.alias(n) for n, c in sheet.soft_sensor(inputs).items()]
    )


def _duck(expr: str) -> str:
    import re

    return re.sub(r"([0-9.]+)D", r"\1e0", expr)


SENSOR_SQL = f"""x AS (SELECT l_orderkey, l_partkey, l_linenumber, {", ".join(f"{_duck(v)} AS {k}" for k, v in SENSOR_FROM_LINEITEM.items())} FROM lineitem),
gain AS (SELECT *, 1e0 + 0.045e0 * ln(1e0 + greatest(retention_aid, 1e-9) / 250e0) AS ag FROM x),
ret AS (SELECT *, least(greatest(0.95e0 * ag * (0.94e0 + 0.06e0 * wire_drainage_index) * (1e0 + 0.00018e0 * (white_water_freeness - 340e0)), 0.7e0), 0.995e0) AS fr,
  least(greatest(0.6e0 * ag * (1e0 + 0.35e0 * broke_ratio), 0.2e0), 0.92e0) AS lr FROM gain),
mass AS (SELECT *, stock_flow * 1000e0 * headbox_consistency * fr AS fiber, filler_flow * 1000e0 * 0.3e0 * lr AS filler FROM ret),
bal AS (SELECT *, (fiber + filler) / greatest(machine_speed * 6e0, 1e-9) * 1000e0 AS basis_weight, filler / greatest(fiber + filler, 1e-9) * 100e0 AS ash FROM mass),
moist AS (SELECT *, least(greatest(1.5e0 + 0.02512e0 * basis_weight * machine_speed / pow(greatest(steam_pressure, 1e0), 0.85e0) * (1e0 + 0.0035e0 * (ambient_humidity - 52e0)), 1.5e0), 25e0) AS moisture FROM bal),
cal AS (SELECT *, basis_weight / least(greatest(700e0 * (1e0 + 0.004e0 * (ash - 10e0)) * (1e0 + 0.01e0 * (moisture - 6e0)) * (1e0 + 0.00035e0 * (press_load - 320e0)), 450e0), 1100e0) * 1000e0 AS caliper FROM moist)"""
R.add(
    "soft_sensor",
    lambda spark, sf: rounded(soft_sensor(spark, sf), 5),
    with_(SENSOR_SQL, body=f"SELECT l_orderkey, l_partkey, l_linenumber, {_r('basis_weight', 'ash', 'moisture', 'caliper', digits=5)} FROM cal"),
)


def _setpoint_sql(weight: str, moisture: str, ash: str, speed: str) -> dict[str, str]:
    ag = "(1e0 + 0.045e0 * ln(2e0))"
    fr = f"(0.95e0 * {ag})"
    lr = f"(0.6e0 * {ag} * (1e0 + 0.35e0 * 0.14e0))"
    solids = f"({weight} * ({speed} * 6e0) / 1000e0)"
    filler = f"({ash} / 100e0 * {solids})"
    lim = {k: (d(lo), d(hi)) for k, (lo, hi) in ENVELOPE.items()}

    def held(tag: str, x: str) -> str:
        return f"least(greatest({x}, {lim[tag][0]}), {lim[tag][1]})"

    return {
        "stock_flow": held("stock_flow", f"({solids} - {filler}) / (1000e0 * 0.009e0 * {fr})"),
        "filler_flow": held("filler_flow", f"{filler} / (1000e0 * 0.3e0 * {lr})"),
        "steam_pressure": held("steam_pressure", f"pow(0.02512e0 * {weight} * {speed} / greatest({moisture} - 1.5e0, 0.2e0), 1e0 / 0.85e0)"),
        "machine_speed": speed,
        "retention_aid": "250e0",
        "jet_wire_ratio": "0.995e0",
    }


def recipe_setpoints(spark: SparkSession, sf: str) -> DataFrame:
    parts = dt.read(spark, sf, "part").select(
        F.col("p_partkey").alias("code"), (F.lit(40.0) + F.col("p_retailprice") / 20.0).alias("w"),
        (F.lit(5.0) + F.col("p_size") / 20.0).alias("m"), (F.col("p_size") / 2.0).alias("a"),
        (F.lit(400.0) + F.col("p_partkey") % 500).alias("v"),
    )
    points = sheet.recipe_setpoints(F.col("w"), F.col("m"), F.col("a"), F.col("v"))
    return parts.select("code", *[c.alias(n) for n, c in points.items()])


R.add(
    "recipe_setpoints",
    lambda spark, sf: rounded(recipe_setpoints(spark, sf), 5),
    with_("p AS (SELECT p_partkey AS code, 40e0 + p_retailprice / 20e0 AS w, 5e0 + p_size / 20e0 AS m, p_size / 2e0 AS a, 400e0 + p_partkey % 500 AS v FROM part)",
          body="SELECT code, " + ", ".join(f"round({x}, 5) AS {n}" for n, x in _setpoint_sql("w", "m", "a", "v").items()) + " FROM p"),
)

# feasibility of the planned ramp
_PT = _setpoint_sql("basis_weight", "moisture", "ash", "machine_speed")
POINTS = "points AS (SELECT code, " + ", ".join(f"{x} AS mv_{n}" for n, x in _PT.items()) + " FROM grades)"
_NEED = [f"abs(b.mv_{t} - a.mv_{t}) / {d(r)} * 15e-1" for t, r in SLEW_LIMITS.items()]
FEASIBLE = (
    "feas AS (SELECT *, CASE WHEN min_ramp_min > 0 THEN "
    + "CASE " + " ".join(f"WHEN need_{i} = min_ramp_min THEN '{t}'" for i, t in enumerate(SLEW_LIMITS)) + " END ELSE '' END AS binding_actuator, "
    + "CAST(plan_ramp_min >= min_ramp_min - 1e-9 AS DOUBLE) AS ramp_is_feasible, greatest(min_ramp_min - plan_ramp_min, 0e0) AS ramp_deficit_min "
    + "FROM (SELECT *, greatest(" + ", ".join(f"need_{i}" for i in range(len(_NEED))) + ") AS min_ramp_min FROM (SELECT meta.*, "
    + ", ".join(f"{x} AS need_{i}" for i, x in enumerate(_NEED))
    + " FROM meta JOIN points a ON a.code = from_grade JOIN points b ON b.code = to_grade) q) q2)"
)
R.add(
    "feasible_ramp",
    lambda spark, sf: rounded(
        feat.feasible_ramp(meta_rows(spark, sf), dt.grades(spark, sf)).select(
            "run_id", "from_grade", "to_grade", "plan_ramp_min", "min_ramp_min", "binding_actuator", "ramp_is_feasible", "ramp_deficit_min"
        )
    ),
    with_(EV, GRADES, PLANS, META, POINTS, FEASIBLE, body=f"SELECT run_id, from_grade, to_grade, binding_actuator, {_r('plan_ramp_min', 'min_ramp_min', 'ramp_is_feasible', 'ramp_deficit_min')} FROM feas"),
)


def plan_clip(spark: SparkSession, sf: str) -> DataFrame:
    from runloom.settings import PlanBounds

    raw = dt.read(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber",
        (F.col("l_quantity") - 5.0).alias("ramp_min"),
        (F.col("l_linenumber") / 2.0 - 0.7).alias("lead_scale"),
        (F.col("l_tax") * 60.0).alias("tau_c_scale"),
    )
    bounds = PlanBounds().recipe
    return raw.select(
        "l_orderkey", "l_partkey", "l_linenumber", *[clip(F.col(k), lo, hi).alias(k) for k, (lo, hi) in bounds.items()]
    )


R.add(
    "plan_clip",
    lambda spark, sf: rounded(plan_clip(spark, sf)),
    """SELECT l_orderkey, l_partkey, l_linenumber, round(least(greatest(l_quantity - 5e0, 2e0), 25e0), 6) AS ramp_min,
  round(least(greatest(l_linenumber / 2e0 - 0.7e0, 0e0), 2.5e0), 6) AS lead_scale,
  round(least(greatest(l_tax * 60e0, 0.3e0), 4e0), 6) AS tau_c_scale FROM lineitem""",
)

# ---- windows --------------------------------------------------------------


def windowed(build, back=0, ahead=0):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        rows = deviations(spark, sf).select("run_id", "sample_idx", "t_min", "value", "bw_dev_pct")
        return rounded(over_runs(rows, build, back=back, ahead=ahead))

    return query


R.add(
    "lag_padded",
    windowed(lambda rows, w: rows.select("run_id", "sample_idx", feat.lag_padded(F.col("value"), ONE, w).alias("value_before"), "_own"), back=ONE),
    with_(EV, body=f"SELECT run_id, sample_idx, round(coalesce(lag(value, {ONE}) OVER ({OW}), first_value(value) OVER ({OW})), 6) AS value_before FROM ev"),
)
_ROC = ((0.5, HALF, "roc_0_5min"), (1.0, ONE, "roc_1min"), (2.0, TWO, "roc_2min"))
R.add(
    "rate_of_change",
    windowed(lambda rows, w: rows.select("run_id", "sample_idx", *[feat.rate_per_min(F.col("bw_dev_pct"), m, SPEC, w).alias(n) for m, _, n in _ROC], "_own"), back=TWO),
    with_(BASE, body="SELECT run_id, sample_idx, " + ", ".join(f"round((dev - coalesce(lag(dev, {k}) OVER ({OW}), first_value(dev) OVER ({OW}))) / {d(m)}, 6) AS {n}" for m, k, n in _ROC) + " FROM s"),
)


def _rolls(rows, w):
    t = feat.trailing(w, 2.0, SPEC)
    return rows.select(
        "run_id", "sample_idx", F.max(F.abs("bw_dev_pct")).over(t).alias("max_2min"), F.avg("bw_dev_pct").over(t).alias("mean_2min"),
        F.coalesce(F.stddev_samp("bw_dev_pct").over(t), F.lit(0.0)).alias("std_2min"), "_own",
    )


_F2 = f"({OW} ROWS BETWEEN {TWO - 1} PRECEDING AND CURRENT ROW)"
R.add(
    "rolling_stats",
    windowed(_rolls, back=TWO),
    with_(BASE, body=f"SELECT run_id, sample_idx, round(max(abs(dev)) OVER {_F2}, 6) AS max_2min, round(avg(dev) OVER {_F2}, 6) AS mean_2min, round(coalesce(stddev_samp(dev) OVER {_F2}, 0), 6) AS std_2min FROM s"),
)
R.add(
    "slew_utilisation",
    lambda spark, sf: rounded(
        over_runs(
            dt.wide_samples(spark, sf),
            lambda rows, w: rows.select("run_id", "sample_idx", *[(F.abs(feat.rate_per_min(F.col(t), 0.5, SPEC, w)) / SLEW_LIMITS[t]).alias(f"{t}_slew_util") for t in MV_TAGS], "_own"),
            back=HALF,
        )
    ),
    with_(BASE, WIDE, body="SELECT run_id, sample_idx, " + ", ".join(f"round(abs(({t} - coalesce(lag({t}, {HALF}) OVER ({OW}), first_value({t}) OVER ({OW}))) / 5e-1) / {d(SLEW_LIMITS[t])}, 6) AS {t}_slew_util" for t in MV_TAGS) + " FROM wide"),
)


def breach_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = deviations(spark, sf).select("run_id", "sample_idx", "bw_dev_pct")
    return feat.breach_labels(rows, SPEC, series.out_of_band(F.col("bw_dev_pct"), SPEC.band_pct))


_FH = f"({OW} ROWS BETWEEN 1 FOLLOWING AND {H} FOLLOWING)"
AHEAD = f"""ahead AS (SELECT run_id, sample_idx, dev,
  CAST(coalesce(max(CAST(abs(dev) > {BAND} AS INTEGER)) OVER {_FH}, 0) AS INTEGER) AS y_breach,
  (min(CASE WHEN abs(dev) > {BAND} THEN sample_idx END) OVER {_FH} - sample_idx) * {d(SPEC.dt_s)} / 60e0 AS ttb,
  lead(sample_idx, {H}) OVER ({OW}) IS NOT NULL AS horizon_complete FROM s)"""
R.add(
    "breach_ahead",
    lambda spark, sf: breach_rows(spark, sf).select("run_id", "sample_idx", "y_breach", "horizon_complete"),
    with_(BASE, AHEAD, body="SELECT run_id, sample_idx, y_breach, horizon_complete FROM ahead"),
)
R.add(
    "time_to_breach",
    lambda spark, sf: rounded(breach_rows(spark, sf).select("run_id", "sample_idx", "y_time_to_breach_min")),
    with_(BASE, AHEAD, body="SELECT run_id, sample_idx, round(ttb, 6) AS y_time_to_breach_min FROM ahead"),
)
R.add(
    "trend_projection",
    windowed(
        lambda rows, w: rows.withColumn("bw_dev_projected", F.col("bw_dev_pct") + feat.rate_per_min(F.col("bw_dev_pct"), 1.0, SPEC, w) * SPEC.horizon_min).select(
            "run_id", "sample_idx", "bw_dev_projected", F.abs("bw_dev_projected").alias("bw_dev_projected_abs"),
            flag(F.abs("bw_dev_projected") > SPEC.band_pct).alias("projected_breach"), "_own"),
        back=ONE),
    with_(BASE, f"p AS (SELECT run_id, sample_idx, dev + (dev - coalesce(lag(dev, {ONE}) OVER ({OW}), first_value(dev) OVER ({OW}))) / 1e0 * {d(SPEC.horizon_min)} AS pr FROM s)",
          body=f"SELECT run_id, sample_idx, round(pr, 6) AS bw_dev_projected, round(abs(pr), 6) AS bw_dev_projected_abs, CAST(abs(pr) > {BAND} AS DOUBLE) AS projected_breach FROM p"),
)
_HZ = (0.5, 1.0, 2.0)
R.add(
    "forecast_targets",
    lambda spark, sf: rounded(targets.forward_targets(deviations(spark, sf).select("run_id", "sample_idx", "bw_dev_pct"), SPEC, _HZ)),
    with_(BASE, body="SELECT run_id, sample_idx, round(dev, 6) AS bw_dev_pct, " + ", ".join(f"round(lead(dev, {SPEC.steps(h)}) OVER ({OW}), 6) AS {targets.target_name(h)}" for h in _HZ) + " FROM s"),
)

# ---- feature slices and the wide table ------------------------------------
_GOALS = {t: _PT[t] for t in feat.REMAINING_TAGS}


def feature_sql() -> dict[str, str]:
    """SQL text of each feature over `wide`, `feas` and the grade rows a, b."""
    def roc(x: str, n: int, m: float) -> str:
        return f"({x} - coalesce(lag({x}, {n}) OVER w, first_value({x}) OVER w)) / {d(m)}"

    sql = {
        "t_since_ramp_min": "t_min - plan_start_min",
        "ramp_progress": "least(greatest((t_min - plan_start_min) / greatest(plan_ramp_min, 1e-6), 0e0), 1e0)",
        "in_ramp": "CAST(t_min >= plan_start_min AND t_min <= plan_start_min + plan_ramp_min AS DOUBLE)",
        "post_ramp": "CAST(t_min > plan_start_min + plan_ramp_min AS DOUBLE)",
        **{c: c for c in TRANSITION_COLS},
        "plan_ramp_min": "plan_ramp_min", "plan_lead_scale": "plan_lead_scale", "plan_tau_c_scale": "plan_tau_c_scale",
        "plan_trim_enabled": "CAST(plan_trim_enabled AS DOUBLE)", "min_ramp_min": "min_ramp_min",
        "ramp_deficit_min": "ramp_deficit_min", "ramp_is_feasible": "ramp_is_feasible",
        "bw_dev_pct": "dev", "bw_abs_dev_pct": "abs(dev)", "currently_off_spec": f"CAST(abs(dev) > {BAND} AS DOUBLE)",
        "bw_dev_headroom_pct": f"{BAND} - abs(dev)", "moisture_dev": "moisture - moisture_sp", "ash_dev": "ash - ash_sp", "caliper": "caliper",
        "bw_dev_roc_0_5min": roc("dev", HALF, 0.5), "bw_dev_roc_1min": roc("dev", ONE, 1.0), "bw_dev_roc_2min": roc("dev", TWO, 2.0),
        "bw_roc_1min": roc("basis_weight", ONE, 1.0), "bw_sp_roc_1min": roc("basis_weight_sp", ONE, 1.0),
        "moisture_roc_1min": roc("moisture", ONE, 1.0), "ash_roc_1min": roc("ash", ONE, 1.0),
        "bw_dev_max_2min": "max(abs(dev)) OVER w2", "bw_dev_std_2min": "coalesce(stddev_samp(dev) OVER w2, 0)", "bw_dev_mean_2min": "avg(dev) OVER w2",
    }
    pr = f"dev + {roc('dev', ONE, 1.0)} * {d(SPEC.horizon_min)}"
    sql |= {"bw_dev_projected": pr, "bw_dev_projected_abs": f"abs({pr})", "projected_breach": f"CAST(abs({pr}) > {BAND} AS DOUBLE)"}
    for t in MV_TAGS:
        sql |= {f"mv_{t}": t, f"mv_{t}_roc_1min": roc(t, ONE, 1.0), f"mv_{t}_slew_util": f"abs({roc(t, HALF, 0.5)}) / {d(SLEW_LIMITS[t])}"}
    for t in feat.REMAINING_TAGS:
        sql |= {f"mv_{t}_remaining": f"goal_{t} - {t}", f"mv_{t}_remaining_frac": f"(goal_{t} - {t}) / greatest(abs(goal_{t}), 1e-9)"}
    sql |= {
        "steam_headroom_kpa": "steam_header_kpa * 95e-2 - steam_pressure",
        "steam_saturated": "CAST(steam_header_kpa * 95e-2 - steam_pressure < 15 AS DOUBLE)",
        "stock_headroom": "80e0 - stock_flow",
        "speed_at_limit": f"CAST(abs({roc('machine_speed', HALF, 0.5)}) > 95e-2 * 45e0 AS DOUBLE)",
    }
    for t in DV_TAGS:
        n = d(DV_NOMINAL[t])
        sql |= {f"dv_{t}": t, f"dv_{t}_dev": f"{t} - {n}", f"dv_{t}_dev_norm": f"({t} - {n}) / {n}", f"dv_{t}_roc_2min": roc(t, TWO, 2.0)}
    return sql


FEATURE_CTES = (
    BASE, WIDE, GRADES, PLANS, META, POINTS, FEASIBLE,
    "ctx AS (SELECT feas.*, " + TRANSITION_SQL + ", " + ", ".join(f"pb.mv_{t} AS goal_{t}" for t in feat.REMAINING_TAGS)
    + " FROM feas JOIN grades a ON a.code = from_grade JOIN grades b ON b.code = to_grade JOIN points pb ON pb.code = to_grade)",
    "joined AS (SELECT wide.*, ctx.* EXCLUDE (run_id) FROM wide JOIN ctx USING (run_id))",
    "feats AS (SELECT run_id, sample_idx, t_min, from_grade, to_grade, primary_cause, "
    + ", ".join(f"{x} AS f_{n}" for n, x in feature_sql().items())
    + f", CAST(coalesce(max(CAST(abs(dev) > {BAND} AS INTEGER)) OVER wh, 0) AS INTEGER) AS y_breach"
    + f", (min(CASE WHEN abs(dev) > {BAND} THEN sample_idx END) OVER wh - sample_idx) * {d(SPEC.dt_s)} / 60e0 AS ttb FROM joined"
    + f" WINDOW w AS ({OW}), w2 AS {_F2}, wh AS {_FH})",
)


def feature_slice(names: list[str] | None) -> tuple:
    names = names or list(feature_sql())

    def query(spark: SparkSession, sf: str) -> DataFrame:
        return rounded(feature_table(spark, sf).select("run_id", "sample_idx", *names), 5)

    sql = with_(*FEATURE_CTES, body="SELECT run_id, sample_idx, " + ", ".join(f"round(f_{n}, 5) AS {n}" for n in names) + f" FROM feats WHERE sample_idx >= {WARM}")
    return query, sql


R.add("remaining_to_target", *feature_slice([f"mv_{t}_{s}" for t in feat.REMAINING_TAGS for s in ("remaining", "remaining_frac")]))
R.add("saturation_flags", *feature_slice(["steam_headroom_kpa", "steam_saturated", "stock_headroom", "speed_at_limit"]))
R.add("nominal_deviation", *feature_slice([f"dv_{t}_{s}" for t in DV_TAGS for s in ("dev", "dev_norm", "roc_2min")]))
R.add(
    "features_wide",
    lambda spark, sf: rounded(feature_table(spark, sf), 5),
    with_(*FEATURE_CTES, body="SELECT run_id, sample_idx, round(t_min, 5) AS t_min, from_grade, to_grade, primary_cause, y_breach, round(ttb, 5) AS y_time_to_breach_min, "
          + ", ".join(f"round(f_{n}, 5) AS {n}" for n in feature_sql()) + f" FROM feats WHERE sample_idx >= {WARM}"),
)
