"""Streaming twins of batch queries: same rows, same SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom.functions.numeric import rounded
from runloom.operators import features as feat
from runloom.operators import ledger as led
from runloom.operators.stage import delete, staged, staging_path
from runloom.plans import queries_advice as qa
from runloom.plans import queries_eval as qe
from runloom.plans import queries_runs as qr
from runloom.plans.registry import Registry
from runloom.sources import driver_tables as dt
from runloom.sources.driver_tables import SPEC
from runloom.streaming import features as sfeat
from runloom.streaming import ledger as sled

R = Registry()


def as_stream(df: DataFrame, files: int = 4, per_trigger: int = 2) -> DataFrame:
    """Replay a table as a stream of files; its rows come in several batches and
    in no particular order."""
    path = staging_path(df.sparkSession, "source")
    df.repartition(files, F.xxhash64("sample_idx")).write.parquet(path)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def drain(stream: DataFrame) -> DataFrame:
    """Run a stream over what is there and read its output table."""
    spark = stream.sparkSession
    out, check = staging_path(spark, "sink"), staging_path(spark, "progress")
    query = (
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", check)
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    delete(spark, check)  # nothing goes on from there
    return spark.read.schema(stream.schema).parquet(out)


def stream_features(spark: SparkSession, sf: str) -> DataFrame:
    # raw columns are replayed and made wide in the stream; its sink holds what needs a run's
    # past, and the stateless features of these rows are made as they are read
    live = dt.widened(as_stream(dt.samples(spark, sf).select(*dt.RAW)))
    context = staged(feat.run_context(qr.meta_rows(spark, sf), dt.grades(spark, sf)))  # its size is known then
    derived = ("bw_dev_pct", "bw_abs_dev_pct")
    windowed = drain(sfeat.windowed_stream(live, SPEC).drop(*derived))
    return rounded(sfeat.with_context(feat.with_deviation(windowed), context, SPEC), 5)


def _without_labels(sql: str) -> str:
    return f"SELECT * EXCLUDE (y_breach, y_time_to_breach_min) FROM ({sql}) q"


R.add("stream_features", stream_features, _without_labels(qr.R.oracles["features_wide"]))


SPAN, LOST = "400 days", 7  # metadata of every LOST-th run never comes


def late_metadata(spark: SparkSession, sf: str, what: str) -> DataFrame:
    """Samples first, then metadata, as streams; two heartbeats at the end, a batch each,
    move the watermark past the wait."""
    live = dt.wide_samples(spark, sf, "ts").withColumn("ts", F.col("ts").cast("timestamp"))
    paths = {n: staging_path(spark, n) for n in ("sink", "beats", "meta", "tracked", "check")}
    query = sfeat.windowed_stream(as_stream(live), SPEC, stamp="ts").writeStream.format("parquet").option("path", paths["sink"])
    query.option("checkpointLocation", f"{paths['check']}-1").trigger(availableNow=True).start().awaitTermination()
    windowed = spark.read.parquet(paths["sink"])
    pending = windowed.select("run_id", "sample_idx", "ts")
    meta = qr.meta_rows(spark, sf).select("run_id", *sfeat.META_COLUMNS).withColumn("recorded", F.to_timestamp(F.lit("2024-06-01")))
    meta = staged(meta)

    def run(files: int = 1000) -> None:
        def read(schema, path):
            return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)

        rows = read(pending.schema, paths["sink"]).unionByName(read(pending.schema, paths["beats"]))
        matched = sfeat.match_stretches(rows, read(meta.schema, paths["meta"]), "ts", "recorded", span=SPAN)
        sfeat.track_features(matched, dt.grades(spark, sf), SPEC, paths["tracked"], f"{paths['check']}-2", stored=windowed).awaitTermination()

    pending.limit(0).write.parquet(paths["beats"])
    meta.limit(0).write.parquet(paths["meta"])
    run()  # nothing matches yet
    meta.where(F.col("run_id") % LOST != 0).write.mode("append").parquet(paths["meta"])
    run()
    for day in ("2040-01-01", "2050-01-01"):
        at = F.to_timestamp(F.lit(day))
        no_run = F.lit(None).cast("long")
        pending.limit(1).withColumns({"run_id": no_run, "ts": at}).write.mode("append").parquet(paths["beats"])
        meta.limit(1).withColumns({"run_id": no_run, "recorded": at}).write.mode("append").parquet(paths["meta"])
    run(1)
    return sfeat.read_tracked(spark, paths["tracked"], what)


R.add("stream_late_features", lambda spark, sf: rounded(late_metadata(spark, sf, "features"), 5),
      f"SELECT * FROM ({_without_labels(qr.R.oracles['features_wide'])}) q WHERE run_id % {LOST} <> 0")
R.add("stream_late_rejects", lambda spark, sf: late_metadata(spark, sf, "rejects").groupBy("run_id", "reason").agg(F.sum("n_rows").alias("n_rows")),
      f"SELECT run_id, 'no metadata' AS reason, count(*) AS n_rows FROM ({qr.R.oracles['features_wide']}) q WHERE run_id % {LOST} = 0 GROUP BY run_id")


def stream_alarms(spark: SparkSession, sf: str) -> DataFrame:
    scored = qe.scored(spark, sf).select("run_id", "sample_idx", "proba")
    out = sfeat.stream_alarms(as_stream(scored), qe.CUT, qe.DELAY, start=SPEC.warmup)
    return drain(out).select("run_id", "sample_idx", "alarm")


R.add("stream_alarms", stream_alarms, qe.R.oracles["alarm_on_delay"])


def stream_trust(spark: SparkSession, sf: str) -> DataFrame:
    path = staging_path(spark, "ledger")
    log = dt.ledger(spark, sf)
    led.append_ledger(log.where(F.col("kind") == "surfaced"), path)
    led.append_ledger(log.where(F.col("kind") == "response").repartition(3), path)
    changes, check = staging_path(spark, "changes"), staging_path(spark, "progress")
    sled.track_latest(sled.read_ledger_stream(spark, path, 2), changes, check).awaitTermination()
    return qa.trust(sled.live_log(spark, changes))


R.add("stream_trust", stream_trust, qa.R.oracles["trust_summary"])
