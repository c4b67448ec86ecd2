"""Reads the shared test tables as runs, grades, plans and ledgers.

A user of `events` is a run, its events in time order are the samples, and the five
event types stand for grades.  All operators take the frames built here exactly as
they would take plant data; nothing below is needed outside the shared tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom.dims import ALL_TAGS, DV_NOMINAL
from runloom.operators.ordered import number_samples
from runloom.settings import RunSpec

SPEC = RunSpec(dt_s=10.0, band_pct=150.0, moisture_band=1.0, ash_band=4.0, horizon_min=1.0,
               settle_tol_pct=60.0, settle_dwell_min=0.5, warmup_min=0.5, window_min=20.0)
TYPES = ("click", "error", "purchase", "signup", "view")

# level of each derived tag, and its pull by the event value (v) and counter (k)
NOMINAL = {"stock_flow": 30.0, "filler_flow": 0.5, "steam_pressure": 500.0, "machine_speed": 700.0,
           "retention_aid": 250.0, "jet_wire_ratio": 1.0, "moisture": 6.0, "ash": 12.0, "caliper": 90.0,
           **DV_NOMINAL}
# (long fractions, so that no derived value sits on a rounding edge)
PULL = {tag: ((i % 5 + 1) * 1.0123456789e-3, (i % 7 - 3) * 2.0987654321e-3) for i, tag in enumerate(ALL_TAGS)}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def counter() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def numbered_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select(
        F.col("user_id").alias("run_id"), "ts", "event_id", "event_type", "value", counter().alias("k")
    )
    return number_samples(rows, "run_id", "ts", ["event_id"]).withColumn(
        "t_min", F.col("sample_idx") * SPEC.dt_s / 60.0
    )


def setpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean value per event type, the stand-in for a recipe target."""
    return (
        read(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.avg("value"), 2).alias("sp"))
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, sample_idx, t_min, value, sp and the raw event columns."""
    return numbered_events(spark, sf_dir).join(setpoints(spark, sf_dir), "event_type")


def tag_expr(tag: str) -> Column:
    if tag == "basis_weight":
        return F.col("value")
    a, b = PULL[tag]
    return F.expr(f"{NOMINAL[tag]}D * (1D + {a!r}D * (value - 50D) + {b!r}D * (k - 50))")


def wide_samples(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    """The 22-series sample table, with the event columns to ``keep``."""
    return widened(samples(spark, sf_dir), *keep)


RAW = ("run_id", "sample_idx", "t_min", "value", "k", "sp")


def widened(rows: DataFrame, *keep: str) -> DataFrame:
    """The 22 series of samples with the columns ``RAW``, batch or stream."""
    return rows.select(
        "run_id", "sample_idx", "t_min", *[tag_expr(t).alias(t) for t in ALL_TAGS],
        F.col("sp").alias("basis_weight_sp"), F.lit(6.0).alias("moisture_sp"), F.lit(12.0).alias("ash_sp"), *keep,
    )


def grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One grade per event type, targets taken from its rows."""
    n = F.count(F.lit(1))
    return read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("code")).agg(
        F.round(F.avg("value"), 2).alias("basis_weight"),
        (F.lit(5.0) + (n % 7) / 2.0).alias("moisture"),
        (F.lit(8.0) + (n % 20)).alias("ash"),
        (F.lit(400.0) + (n % 500)).alias("machine_speed"),
        (F.lit(5.0) + (n % 5)).alias("nominal_ramp_min"),
    )


def run_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per run: first and last event type as grades, and a plan."""
    n, r = F.col("n_samples"), F.col("run_id")
    order = F.struct("ts", "event_id")
    return (
        read(spark, sf_dir, "events")
        .withColumnRenamed("user_id", "run_id")
        .groupBy("run_id")
        .agg(
            F.count(F.lit(1)).alias("n_samples"),
            F.min_by("event_type", order).alias("from_grade"),
            F.max_by("event_type", order).alias("to_grade"),
            F.array_sort(F.collect_set(F.when(F.col("value") > 200.0, F.col("event_type")))).alias("fault_codes"),
        )
        .select(
            "run_id", "n_samples", "from_grade", "to_grade", "fault_codes",
            (F.lit(2.0) + r % 9).alias("plan_ramp_min"),
            (F.lit(0.5) + (n % 10) / 10.0).alias("plan_lead_scale"),
            (F.lit(0.4) + (n % 20) / 10.0).alias("plan_tau_c_scale"),
            (n % 2 == 0).alias("plan_trim_enabled"),
            F.lit(1.0).alias("plan_start_min"),
        )
    )


def day_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user and day, the summed value of each event type: five tags on a
    dense grid from the first to the last day of the log (days without an event
    are 0)."""
    events = read(spark, sf_dir, "events")
    date = F.col("ts").cast("date")
    ends = events.agg(F.min(date).alias("first"), F.max(date).alias("last")).first()
    first, last = F.lit(ends["first"]), F.lit(ends["last"])
    day = F.datediff(date, first)
    rows = events.select(
        F.col("user_id").alias("run_id"), day.alias("sample_idx"), "event_type", "value"
    )
    per_day = rows.groupBy("run_id", "sample_idx").agg(
        *[F.round(F.sum(F.when(F.col("event_type") == t, F.col("value")).otherwise(0.0)), 2).alias(t) for t in TYPES]
    )
    grid = rows.select("run_id").distinct().select(
        "run_id", F.explode(F.sequence(F.lit(0), F.datediff(last, first))).alias("sample_idx")
    )
    return grid.join(per_day, ["run_id", "sample_idx"], "left").na.fill(0.0, list(TYPES))


def scores(spark: SparkSession, sf_dir: str, features: DataFrame) -> DataFrame:
    """A fixed logistic score of two backward-looking features."""
    z = F.col("bw_abs_dev_pct") / 60.0 + F.col("bw_dev_max_2min") / 150.0 - 2.0
    return features.withColumn("proba", F.round(F.lit(1.0) / (F.lit(1.0) + F.exp(-z)), 4))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as ledger entries: a view surfaces advice, any other event answers
    it; one advisory per user and day."""
    k, kind = counter(), F.col("event_type")
    surfaced = kind == "view"
    sources = F.array(*[F.lit(s) for s in ("RISK_MODEL", "PHYSICS_MODEL", "CORRELATION_DISCOVERY", "RECIPE_LIMIT")])
    return (
        read(spark, sf_dir, "events")
        .select(
            F.col("event_id").cast("string").alias("entry_id"),
            F.when(surfaced, "surfaced").otherwise("response").alias("kind"),
            F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "yyyyMMdd")).alias("advisory_id"),
            (F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)") / 1000000.0).alias("timestamp"),
            F.when(surfaced, F.element_at(sources, k % 4 + 1)).alias("source"),
            F.when(surfaced, k / 100.0).alias("confidence"),
            F.when(surfaced & (k % 5 != 0), F.col("value") * 10.0).alias("value_usd"),
            F.when(kind.isin("purchase", "signup"), "accepted").when(kind == "error", "rejected").when(kind == "click", "ignored").alias("decision"),
            F.when(~surfaced, F.concat(F.lit("answer\t of  "), kind, F.lit(" "), F.col("props"))).alias("note"),
            F.col("user_id").alias("run_id"),
            F.col("event_id").alias("seq"),
        )
    )
