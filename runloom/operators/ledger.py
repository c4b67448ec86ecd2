"""Append-only ledger of shown advice and the answers to it."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runloom.dims import DECISIONS
from runloom.functions.numeric import ratio
from runloom.sources.commits import Folder

LEDGER = T.StructType(
    [
        T.StructField("entry_id", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("advisory_id", T.StringType()),
        T.StructField("timestamp", T.DoubleType()),
        T.StructField("source", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("value_usd", T.DoubleType()),
        T.StructField("decision", T.StringType()),
        T.StructField("note", T.StringType()),
        T.StructField("run_id", T.LongType()),
        T.StructField("seq", T.LongType()),
    ]
)
NOTE_LENGTH = 2000


def _blank(names: list[str]) -> list[Column]:
    return [F.lit(None).cast(LEDGER[n].dataType).alias(n) for n in names]


def record_surfaced(shown: DataFrame, timestamp: Column, seq: Column) -> DataFrame:
    """Log rows of shown advice (columns id, source, confidence, value_usd,
    run_id)."""
    entry = F.concat_ws(":", F.lit("surfaced"), F.col("id"), seq.cast("string"))
    return shown.select(
        F.sha2(entry, 256).alias("entry_id"), F.lit("surfaced").alias("kind"), F.col("id").alias("advisory_id"),
        timestamp.alias("timestamp"), "source", "confidence", "value_usd", *_blank(["decision", "note"]),
        "run_id", seq.alias("seq"),
    ).select(LEDGER.fieldNames())


def record_responses(answers: DataFrame, log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split answers (advisory_id, decision, note, timestamp, seq) into log rows
    and rejects: an unknown decision, an over-long note, or advice that was never
    shown."""
    shown = log.where(F.col("kind") == "surfaced").select("advisory_id").distinct()
    checked = answers.join(shown.withColumn("_shown", F.lit(True)), "advisory_id", "left").withColumn(
        "reason",
        F.when(~F.coalesce(F.col("decision").isin(*DECISIONS), F.lit(False)), "unknown decision")
        .when(F.length("note") > NOTE_LENGTH, "note too long")
        .when(F.col("_shown").isNull(), "never surfaced"),
    )
    entry = F.concat_ws(":", F.lit("response"), F.col("advisory_id"), F.col("seq").cast("string"))
    good = checked.where(F.col("reason").isNull()).select(
        F.sha2(entry, 256).alias("entry_id"), F.lit("response").alias("kind"), "advisory_id", "timestamp",
        *_blank(["source", "confidence", "value_usd"]), "decision", "note", *_blank(["run_id"]), "seq",
    )
    bad = checked.where(F.col("reason").isNotNull()).select(*answers.columns, "reason")
    return good.select(LEDGER.fieldNames()), bad


def append_ledger(entries: DataFrame, path: str, batch: str | None = None) -> bool:
    """Add entries to the JSON Lines ledger, all or none of them.

    They are written aside and appear by one rename.  ``batch`` names the append: a
    retried job, or a second writer of the same batch, adds nothing and gets False.
    Without it every call is an append of its own."""
    name = batch if batch is not None else uuid.uuid4().hex
    if not re.fullmatch(r"[\w.-]+", name):
        raise ValueError(f"a batch is named by letters, digits, _ . and -, not {name!r}")
    folder = Folder(entries.sparkSession, path)
    if folder.exists(f"commit-{name}"):
        return False
    hidden = folder.fresh()
    entries.write.json(folder.at(hidden))
    return folder.publish(hidden, f"commit-{name}")


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """All entries; blank lines are skipped, a ledger that does not exist yet is
    empty."""
    if not Folder(spark, path).exists():
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).option("recursiveFileLookup", True).json(path)


def _last(log: DataFrame, kind: str, columns: list[str]) -> DataFrame:
    """Entry with the highest seq per advisory; combines map-side, so an advisory
    with very many entries is no hot spot."""
    pick = F.max_by(F.struct(*columns), F.col("seq")).alias("_e")
    return log.where(F.col("kind") == kind).groupBy("advisory_id").agg(pick).select("advisory_id", "_e.*")


def latest_surfaced(log: DataFrame) -> DataFrame:
    return _last(log, "surfaced", ["source", "confidence", "value_usd"])


def latest_responses(log: DataFrame) -> DataFrame:
    return _last(log, "response", ["decision", "note", "timestamp"])


def paired(log: DataFrame) -> DataFrame:
    """Latest answer of each advisory next to what was shown."""
    return latest_surfaced(log).join(latest_responses(log).select("advisory_id", "decision"), "advisory_id")


def orphans(log: DataFrame) -> DataFrame:
    """Answers to advice that was never shown."""
    shown = log.where(F.col("kind") == "surfaced").select("advisory_id").distinct()
    return log.where(F.col("kind") == "response").join(shown, "advisory_id", "left_anti")


def trust_summary(log: DataFrame) -> DataFrame:
    """One row: counts, acceptance, mean confidence by decision, realised value.
    ``ignored`` stays in the denominator; rates are NULL before any answer."""
    decided = latest_surfaced(log).join(
        latest_responses(log).select("advisory_id", "decision"), "advisory_id", "left"
    )
    yes, no = F.col("decision") == "accepted", F.col("decision") == "rejected"
    return decided.agg(
        F.count(F.lit(1)).alias("n_surfaced"),
        F.count("decision").alias("n_responded"),
        ratio(F.count_if(yes), F.count("decision")).alias("acceptance_rate"),
        F.avg(F.when(yes, F.col("confidence"))).alias("mean_confidence_accepted"),
        F.avg(F.when(no, F.col("confidence"))).alias("mean_confidence_rejected"),
        F.coalesce(F.sum(F.when(yes, F.col("value_usd"))), F.lit(0.0)).alias("realized_value_usd"),
    )


def trust_by_source(log: DataFrame) -> DataFrame:
    yes = F.col("decision") == "accepted"
    return paired(log).groupBy("source").agg(
        F.count(F.lit(1)).alias("n_responded"), ratio(F.count_if(yes), F.count(F.lit(1))).alias("acceptance_rate")
    )
