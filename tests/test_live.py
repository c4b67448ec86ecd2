"""Live state: what is read and scored, and equality with the plain way."""

import random

from pyspark.sql import functions as F

from runloom.operators import alarms
from runloom.operators.stage import staging_path
from runloom.plans import live
from runloom.sources import runs, slices


def frames(spark):
    rng = random.Random(6)
    rows = []
    for run in range(12):
        n = 2000 if run == 3 else rng.randint(1, 200)  # one long run
        gap = rng.randint(50, 90)
        rows += [(run, i, (i + (40 if i > gap else 0)) / 4.0, rng.random(), "x") for i in range(5, 5 + n)]
    df = spark.createDataFrame(rows, "run_id long, sample_idx long, t_min double, risk double, text string").repartition(4)
    cursors = [(run, c) for run in range(0, 14, 2) for c in (0.0, 1.25, 13.0, 26.1, 1e6)] + [(3, float(c)) for c in range(0, 520, 7)]
    return df, spark.createDataFrame(cursors, "run_id long, cursor double")


def test_live_risk_equals_the_plain_way(spark):
    df, cursors = frames(spark)
    path = staging_path(spark, "slices")
    slices.write_slices(df, path, slice_min=5.0, buckets=4)
    plain = alarms.confirm(df.withColumn("proba", F.col("risk")), 0.4, 3)
    for first in (True, False):
        want = runs.at_cursor(plain, cursors, first).where("sample_idx IS NOT NULL").select("run_id", "cursor", "sample_idx", "risk", "alarm").collect()
        for features in (df, slices.Slices(spark, path)):
            got = live.live_risk(features, cursors, lambda r: r.withColumn("proba", F.col("risk")), 0.4, 3, first)
            assert sorted(got.select("run_id", "cursor", "sample_idx", "risk", "alarm").collect()) == sorted(want)
    assert len(want) > 60


def test_only_the_rows_of_cursors_are_scored(spark):
    df, cursors = frames(spark)
    seen = []

    def score(rows):
        seen.append(rows.count())
        return rows.withColumn("proba", F.col("risk"))

    live.live_risk(df, cursors, score, 0.5, 4).count()
    assert seen[0] <= 4 * cursors.count() < df.count()


def test_other_folders_stay_shut(spark):
    df, _ = frames(spark)
    path = staging_path(spark, "slices")
    slices.write_slices(df, path, slice_min=5.0, buckets=4)
    store = slices.Slices(spark, path)
    asked = spark.createDataFrame([(3, 251.0)], "run_id long, cursor double")
    wanted = store._holding(asked, "first_min", False)
    assert wanted.count() == 1
    all_files = len(store.rows.inputFiles())
    store.rows = store.rows.withColumn("f", F.col("_metadata.file_path"))
    near = store._opened(wanted, ["run_id"])
    assert near.select("f").distinct().count() == 1 and all_files > 50
    assert "dynamicpruningexpression" in near._jdf.queryExecution().executedPlan().toString()


def test_live_risk_of_nothing(spark):
    df, cursors = frames(spark)
    assert live.live_risk(df, cursors.limit(0), lambda r: r.withColumn("proba", F.col("risk")), 0.5).count() == 0
    assert live.live_risk(df.limit(0), cursors, lambda r: r.withColumn("proba", F.col("risk")), 0.5).count() == 0
