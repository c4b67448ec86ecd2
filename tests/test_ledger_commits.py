"""Appends that a retry doesn't repeat, and versions that a killed batch doesn't break."""

import pytest
from pyspark.sql import functions as F

from runloom.operators import ledger as led
from runloom.operators.stage import staging_path
from runloom.sources.commits import Folder
from runloom.streaming import ledger as sled


def entries(spark, start: int, n: int, kind: str = "surfaced"):
    answered = kind == "response"
    decision = F.when(F.col("id") % 3 == 0, "accepted").otherwise("rejected") if answered else F.lit(None).cast("string")
    return spark.range(start, start + n).select(
        F.concat(F.lit(f"{kind}-"), F.col("id")).alias("entry_id"), F.lit(kind).alias("kind"), F.concat(F.lit("a"), F.col("id") % 17).alias("advisory_id"),
        F.col("id").cast("double").alias("timestamp"), F.lit("RISK_MODEL").alias("source"), (F.col("id") % 10 / 10).alias("confidence"),
        (F.col("id") % 5 * 10.0).alias("value_usd"), decision.alias("decision"), F.lit(None).cast("string").alias("note"),
        F.col("id").alias("run_id"), F.col("id").alias("seq"),
    )


def test_the_same_batch_twice_is_one_set_of_rows(spark):
    path = staging_path(spark, "ledger")
    assert led.append_ledger(entries(spark, 0, 10), path, "job-7")
    assert not led.append_ledger(entries(spark, 0, 10), path, "job-7")
    assert led.append_ledger(entries(spark, 10, 5, "response"), path, "job-8")
    assert led.append_ledger(entries(spark, 15, 2), path) and led.append_ledger(entries(spark, 17, 2), path)
    log = led.read_ledger(spark, path)
    assert log.count() == log.select("entry_id").distinct().count() == 19 and log.columns == led.LEDGER.fieldNames()
    with pytest.raises(ValueError):
        led.append_ledger(entries(spark, 0, 1), path, "a/b")


def test_a_killed_append_adds_nothing(spark):
    path = staging_path(spark, "ledger")
    led.append_ledger(entries(spark, 0, 4), path, "one")
    broken = entries(spark, 4, 4).withColumn("note", F.raise_error(F.lit("killed")).cast("string"))
    with pytest.raises(Exception, match="killed"):
        led.append_ledger(broken, path, "two")
    assert led.read_ledger(spark, path).count() == 4
    assert led.append_ledger(entries(spark, 4, 4), path, "two") and led.read_ledger(spark, path).count() == 8


def test_publish_never_replaces(spark):
    folder = Folder(spark, staging_path(spark, "folder"))
    assert folder.write_json("x", {"a": 1}) and not folder.write_json("x", {"a": 2})
    assert folder.read_json("x") == {"a": 1} and folder.names() == ["x"]


def test_versions_stay_few_and_equal_the_log(spark):
    path, changes = staging_path(spark, "ledger"), staging_path(spark, "changes")
    folder, most = Folder(spark, changes), 0
    for k in range(14):
        led.append_ledger(entries(spark, 20 * k, 12), path, f"s{k}")
        led.append_ledger(entries(spark, 20 * k + 12, 8, "response").coalesce(1), path, f"r{k}")
        if k % 7 == 6:  # many batches of one file
            sled.track_latest(sled.read_ledger_stream(spark, path, 2), changes, f"{changes}-check", compact=3).awaitTermination()
            most = max(most, len(folder.names()))
            assert sled.live_trust(spark, changes).first() == led.trust_summary(led.read_ledger(spark, path)).first()
    version = sled._version(folder)
    assert version["number"] >= 13 and len(version["changes"]) < 3 and most <= 3 + 2 * sled.KEEP + 3
    assert len([n for n in folder.names() if n.startswith("version-")]) == sled.KEEP


def test_a_killed_batch_leaves_the_version_before(spark, monkeypatch):
    path, changes = staging_path(spark, "ledger"), staging_path(spark, "changes")

    def track():
        sled.track_latest(sled.read_ledger_stream(spark, path), changes, f"{changes}-check", compact=2).awaitTermination()

    led.append_ledger(entries(spark, 0, 30), path, "one")
    track()
    before = sled.live_trust(spark, changes).first()
    assert before.n_surfaced == 17
    led.append_ledger(entries(spark, 30, 30, "response"), path, "two")
    real = Folder.write_json

    def killed(self, name, value):
        raise RuntimeError("killed before its version")

    monkeypatch.setattr(Folder, "write_json", killed)
    with pytest.raises(Exception, match="killed before"):
        track()
    assert sled.live_trust(spark, changes).first() == before
    monkeypatch.setattr(Folder, "write_json", real)
    track()
    assert sled.live_trust(spark, changes).first() == led.trust_summary(led.read_ledger(spark, path)).first() != before


def test_live_log_of_nothing(spark):
    assert sled.live_trust(spark, staging_path(spark, "changes")).first().n_surfaced == 0
