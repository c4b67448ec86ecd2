"""Live ledger: the latest entries per advisory, kept by the stream's own state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from runloom.operators import ledger as led
from runloom.sources.commits import Folder


def read_ledger_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(led.LEDGER).option("recursiveFileLookup", True)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(path)


def append_stream(entries: DataFrame, path: str, checkpoint: str, name: str = "stream", **trigger) -> StreamingQuery:
    """Append a stream of ledger entries to the JSON Lines ledger, batch by batch under
    ``name`` and the batch's number, so a repeated batch adds nothing."""

    def write(batch: DataFrame, number: int) -> None:
        led.append_ledger(batch, path, f"{name}-{number}")

    return (
        entries.select(led.LEDGER.fieldNames()).writeStream.outputMode("append").foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    )


def _latest(kind: str, *columns: str):
    here = F.col("kind") == kind
    return F.max_by(F.when(here, F.struct("seq", *columns)), F.when(here, F.col("seq"))).alias(kind)


#: batches of changes before they are merged into one table, and versions kept for readers
COMPACT, KEEP = 10, 3


def _manifests(folder: Folder) -> list[str]:
    return [n for n in folder.names() if n.startswith("version-")]


def _version(folder: Folder) -> dict:
    """The newest version: a merged table (or none) and the changes since."""
    names = _manifests(folder)
    return folder.read_json(names[-1]) if names else {"number": -1, "base": None, "changes": []}


def _tables(spark: SparkSession, folder: Folder, version: dict) -> DataFrame | None:
    """Latest entries of every advisory, as of a version."""
    parts = [*([version["base"]] if version["base"] else []), *version["changes"]]
    rows = None
    for place, name in enumerate(parts):
        part = spark.read.parquet(folder.at(name)).withColumn("_place", F.lit(place))
        rows = part if rows is None else rows.unionByName(part)
    if rows is None:
        return None
    whole = F.struct("surfaced", "response")
    return rows.groupBy("advisory_id").agg(F.max_by(whole, F.col("_place")).alias("_l")).select("advisory_id", "_l.*")


def track_latest(log: DataFrame, changes: str, checkpoint: str, compact: int = COMPACT, **trigger) -> StreamingQuery:
    """Keep the last shown and last answered entry of each advisory in the state store,
    and a versioned table of them for readers.

    A batch writes what it changed; after ``compact`` batches the changes are merged with
    the table before.  A version is a small file that names its tables and appears last,
    by rename: a batch killed before leaves the version before it, a repeated batch finds
    its version and changes nothing.  Tables that the last KEEP versions don't name are
    removed, so there are at most about compact + KEEP folders, however many batches."""
    state = log.groupBy("advisory_id").agg(
        _latest("surfaced", "source", "confidence", "value_usd"), _latest("response", "decision")
    )

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        folder = Folder(spark, changes)
        version = _version(folder)
        if version["number"] >= number:
            return
        name = f"changes-{number:012d}"
        batch.write.mode("overwrite").parquet(folder.at(name))
        version = {"number": number, "base": version["base"], "changes": [*version["changes"], name]}
        if len(version["changes"]) >= compact:
            base = f"base-{number:012d}"
            _tables(spark, folder, version).write.mode("overwrite").parquet(folder.at(base))
            version = {"number": number, "base": base, "changes": []}
        folder.write_json(f"version-{number:012d}", version)
        _clean(folder)

    return (
        state.writeStream.outputMode("update").foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    )


def _clean(folder: Folder) -> None:
    names = _manifests(folder)
    kept = [folder.read_json(n) for n in names[-KEEP:]]
    named = {t for v in kept for t in [v["base"], *v["changes"]]}
    for n in folder.names():
        if (n.startswith(("changes-", "base-")) and n not in named) or n in names[:-KEEP]:
            folder.remove(n)


def live_log(spark: SparkSession, changes: str) -> DataFrame:
    """The tracked entries of the newest version as ledger rows, for the same trust
    summaries as batch."""
    folder = Folder(spark, changes)
    last = _tables(spark, folder, _version(folder))
    if last is None:
        return spark.createDataFrame([], led.LEDGER).drop("entry_id", "run_id")
    blank = F.lit(None)
    shown = last.where(F.col("surfaced").isNotNull()).select(
        "advisory_id", F.lit("surfaced").alias("kind"), "surfaced.seq", "surfaced.source", "surfaced.confidence", "surfaced.value_usd",
        blank.cast("string").alias("decision"), blank.cast("string").alias("note"), blank.cast("double").alias("timestamp"),
    )
    answered = last.where(F.col("response").isNotNull()).select(
        "advisory_id", F.lit("response").alias("kind"), "response.seq", blank.cast("string").alias("source"),
        blank.cast("double").alias("confidence"), blank.cast("double").alias("value_usd"), "response.decision",
        blank.cast("string").alias("note"), blank.cast("double").alias("timestamp"),
    )
    return shown.unionByName(answered)


def live_trust(spark: SparkSession, changes: str) -> DataFrame:
    return led.trust_summary(live_log(spark, changes))
