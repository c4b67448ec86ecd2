"""Tables and reports on disk."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runloom.functions.numeric import finite_or_null, narrow_doubles

FAULT = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("code", "label", "target_tag", "shape")]
    + [T.StructField(n, T.DoubleType()) for n in ("magnitude", "onset_min", "duration_min", "period_min")]
    + [T.StructField("description", T.StringType())]
)
META = T.StructType(
    [T.StructField("run_id", T.LongType()), T.StructField("seed", T.LongType())]
    + [T.StructField(n, T.StringType()) for n in ("from_grade", "to_grade", "primary_cause", "binding_actuator")]
    + [T.StructField("fault_codes", T.StringType()), T.StructField("faults", T.ArrayType(FAULT))]
    + [T.StructField(n, T.DoubleType()) for n in ("plan_ramp_min", "plan_lead_scale", "plan_tau_c_scale", "plan_start_min")]
    + [T.StructField("plan_trim_enabled", T.BooleanType())]
    + [T.StructField(n, T.DoubleType()) for n in ("min_ramp_min", "ramp_deficit_min", "ramp_is_feasible", "transition_magnitude")]
    + [
        T.StructField(n, T.DoubleType())
        for n in ("off_spec", "off_spec_minutes", "max_abs_dev_pct", "mean_abs_dev_pct", "first_breach_min", "settle_min",
                  "settled", "moisture_off_spec_min", "ash_off_spec_min", "final_bw_error")
    ]
)
# run id -> faults: the schema must be given, inference would make every id a field
FAULTS_BY_RUN = T.MapType(T.StringType(), T.ArrayType(FAULT))


def bucket_of(run: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(run.cast("long")), F.lit(buckets)).cast("int")


def read_run(spark: SparkSession, path: str, run_id: int, buckets: int = 64) -> DataFrame:
    """Samples of one run of a corpus: only the folder of its bucket is opened.
    ``buckets`` is the number the corpus was written with; an unknown id is an error."""
    here = spark.read.parquet(f"{path}/samples").where(
        (F.col("bucket") == bucket_of(F.lit(run_id), buckets)) & (F.col("run_id") == run_id)
    )
    if here.isEmpty():
        raise KeyError(run_id)
    return finite_or_null(here.drop("bucket"))


def write_corpus(samples: DataFrame, meta: DataFrame, path: str, buckets: int = 64, mode: str = "errorifexists") -> None:
    """Samples as Parquet in folders by a hash of the run, so that one run is
    found without reading the rest; metadata as JSON lines."""
    part = bucket_of(F.col("run_id"), buckets)
    # a long run is spread over several files of its folder
    spread = F.floor(F.col("sample_idx") / F.lit(1_000_000))
    (
        samples.withColumn("bucket", part)
        .repartition(F.col("bucket"), F.col("run_id"), spread)
        .sortWithinPartitions("bucket", "run_id", "sample_idx")
        .write.mode(mode).partitionBy("bucket").parquet(f"{path}/samples")
    )
    meta.write.mode(mode).json(f"{path}/run_meta")


def read_corpus(spark: SparkSession, path: str, meta_schema: T.StructType = META) -> tuple[DataFrame, DataFrame]:
    """Samples and metadata; NaN literals become NULL."""
    samples = spark.read.parquet(f"{path}/samples").drop("bucket")
    meta = finite_or_null(spark.read.schema(meta_schema).json(f"{path}/run_meta"))
    return finite_or_null(samples), meta


def read_faults(spark: SparkSession, path: str) -> DataFrame:
    """One row per run and fault from JSON objects keyed by run id."""
    whole = spark.read.text(path, wholetext=False).select(F.from_json("value", FAULTS_BY_RUN).alias("m"))
    return (
        whole.select(F.explode("m").alias("run_id", "faults"))
        .select(F.col("run_id").cast("long").alias("run_id"), F.posexplode("faults").alias("place", "f"))
        .select("run_id", "place", "f.*")
    )


def write_features(features: DataFrame, path: str, text: bool = False, mode: str = "errorifexists") -> None:
    """Feature cache: narrowed Parquet, or gzip CSV with a header."""
    narrow = narrow_doubles(features)
    if text:
        narrow.write.mode(mode).option("header", True).option("compression", "gzip").csv(path)
    else:
        narrow.write.mode(mode).parquet(path)


def read_features(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Feature cache written by :func:`write_features`; a schema means CSV."""
    if schema is not None:
        return spark.read.schema(schema).option("header", True).csv(path)
    return spark.read.parquet(path)


def write_report(table: DataFrame, path: str, columns: Sequence[str] | None = None, fmt: str = "csv", mode: str = "overwrite") -> None:
    """A small result table as CSV with a header, or as JSON lines."""
    out = table.select(*columns) if columns else table
    if fmt == "csv":
        out.write.mode(mode).option("header", True).csv(path)
    else:
        out.write.mode(mode).json(path)


def fingerprint(df: DataFrame, ident: str = "run_id", config: str = "") -> DataFrame:
    """SHA-256 over ids, row count, columns and configuration, independent of row
    order and partitioning."""
    names = ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in df.schema.fields)
    ids = df.groupBy(ident).agg(F.count(F.lit(1)).alias("n"))
    mark = F.conv(F.substring(F.md5(F.concat_ws("|", F.col(ident).cast("string"), F.col("n").cast("string"))), 1, 8), 16, 10).cast("long")
    parts = ids.agg(
        F.coalesce(F.sum(mark), F.lit(0).cast("long")).alias("ids"),
        F.count(F.lit(1)).alias("n_ids"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
    )
    text = F.concat_ws("|", F.col("ids").cast("string"), F.col("n_ids").cast("string"), F.col("n_rows").cast("string"), F.lit(names), F.lit(config))
    return parts.select("n_ids", "n_rows", F.sha2(text, 256).alias("fingerprint"))
