"""Nothing gets lost or stays local: missing inputs, unknown keys, heavy tails, staging."""

import types

import numpy as np
import pytest
from pyspark.sql import functions as F

from runloom.operators import alarms, features, models, ordered, stage
from runloom.operators.advice import sensitivity_rejects
from runloom.sources import driver_tables, files
from runloom.streaming.ordered import ordered_stream


def test_staging_needs_a_shared_folder_on_a_cluster(monkeypatch):
    conf = types.SimpleNamespace(get=lambda *a: None)
    context = types.SimpleNamespace(applicationId="app", master="spark://somewhere:7077", getConf=lambda: conf)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        stage._root(types.SimpleNamespace(conf=conf, sparkContext=context))


def test_rows_with_missing_inputs_are_scored(spark):
    rng = np.random.default_rng(0)
    rows = [(i % 20, i, None if i % 4 == 0 else float(x), float(i % 7), int(x > 0)) for i, x in enumerate(rng.normal(size=200))]
    frame = spark.createDataFrame(rows, "run_id long, sample_idx long, a double, b double, y_breach int")
    for name in ("logistic", "random_forest"):
        settings = {} if name == "logistic" else {"trees": 3, "depth": 3}
        model = models.fit(frame, ["a", "b"], models.REGISTRY[name], **settings)
        assert models.score(model, frame).where("proba between 0 and 1").count() == 200


def test_unknown_grades_are_an_error_and_listed(spark):
    from runloom.plans import queries_runs as qr

    small = "/root/testdata/sf0.001"
    meta, grades = qr.meta_rows(spark, small), driver_tables.grades(spark, small)
    assert features.grade_rejects(meta, grades).isEmpty()
    code = meta.first().to_grade
    fewer = grades.where(F.col("code") != code)
    bad = features.grade_rejects(meta, fewer)
    assert {r.code for r in bad.collect()} == {code}
    with pytest.raises(Exception, match=f"unknown grade: {code}"):
        features.run_context(meta, fewer).collect()
    samples = driver_tables.wide_samples(spark, small)
    gone = meta.first().run_id
    with pytest.raises(Exception, match=f"unknown run: {gone}"):
        features.wide_features(samples, meta.where(F.col("run_id") != gone), grades, driver_tables.SPEC).collect()


def test_day_grid_follows_the_log(spark, tmp_path):
    rows = spark.sql("SELECT id AS event_id, id % 3 AS user_id, 'click' AS event_type, 1.0D AS value, '{\"k\": 1}' AS props, timestamp_ntz'2024-03-09 10:00:00' + make_dt_interval(CAST(id AS INT) * 9) AS ts FROM range(10)")
    rows.write.parquet(f"{tmp_path}/events.parquet")
    grid = driver_tables.day_tags(spark, str(tmp_path))
    assert grid.count() == 3 * 82 and grid.agg(F.sum("click")).first()[0] == 10.0


def test_cells_follow_heavy_tails(spark):
    values = [10.0 ** (12 * i / 5000) for i in range(5000)] + [0.0] * 50
    frame = spark.createDataFrame([(v, 1) for v in values], "v double, n long").groupBy("v").agg(F.sum("n").alias("n"))
    out = ordered.running_totals(frame, F.col("v"), ["n"], cells=50)
    got = {r.v: r.n_upto for r in out.collect()}
    total = 0
    for v, n in sorted((r.v, r.n) for r in frame.collect()):
        total += n
        assert got[v] == total
    for cells in (10, 50):
        sizes = [r["count"] for r in ordered.in_cells(frame, F.col("v"), cells=cells).groupBy("_rt_cell").count().collect()]
        assert len(sizes) > cells * 0.9 and max(sizes) <= 2 * 5001 / cells


def test_hot_group_is_many_cells(spark):
    frame = spark.range(20_000).select(F.when(F.col("id") % 100 == 0, F.col("id") % 7).otherwise(3).alias("g"), (F.hash("id") % 1000).cast("double").alias("v"), "id")
    frame = frame.withColumn("one", F.lit(1).cast("long"))
    sizes = [r["count"] for r in ordered.in_cells(frame, F.col("v"), ["g"], [F.col("id")], 16).groupBy("_rt_cell").count().collect()]
    assert max(sizes) <= 2 * 20_000 / 16
    ranks = ordered.running_totals(frame, F.col("v"), ["one"], ["g"], [F.col("id")], 16)
    per = ranks.groupBy("g").agg(F.count_distinct("one_upto").alias("d"), F.max("one_upto").alias("top"), F.max("one_total").alias("n")).collect()
    assert len(per) == 7 and all(r.d == r.top == r.n for r in per)


def test_bottom_k_equals_sort_and_limit(spark):
    frame = spark.range(3000).select(F.concat(F.lit("k"), F.col("id") % 2500).alias("key"), "id")  # some keys repeat
    for n, cells in ((1, 1 << 16), (700, 1 << 16), (700, 2), (700, 1 << 24), (2999, 64), (3000, 64), (5000, 64), (0, 64)):
        got = sorted(r.key for r in ordered.first_by_hash(frame, "key", n, 4, cells).collect())
        want = frame.withColumn("h", F.md5(F.concat_ws("|", "key", F.lit("4")))).orderBy("h", "key").limit(n)
        assert got == sorted(r.key for r in want.collect()), (n, cells)


def test_on_delay_counts_rows_of_the_run(spark):
    rows = spark.createDataFrame([(1, i, 0.9) for i in range(10, 15)], "run_id long, sample_idx long, proba double")
    got = [r.alarm for r in alarms.confirm(rows, 0.5, 3).orderBy("sample_idx").collect()]
    assert got == [False, False, True, True, True]


def test_retune_from_between_two_points(spark):
    points = spark.createDataFrame(
        [(0.2, 0.9, 4.0, 0.3), (0.3, 0.9, 4.0, 0.2), (0.4, 0.9, 4.0, 0.1)], "threshold double, detection_rate double, median_warning_min double, false_alarm_run_rate double"
    )
    row = alarms.retune(points, 0.26).first()
    assert (row.current_threshold, row.chosen_threshold, row.changed) == (0.3, 0.4, True)


def test_units_without_a_baseline_are_listed(spark):
    rows = spark.createDataFrame([(1, "a", 0.0), (1, "a", 1.0), (2, "a", 1.0), (3, "a", 0.0)], "run_id long, parameter string, delta double")
    assert {(r.run_id, r.reason) for r in sensitivity_rejects(rows).collect()} == {(2, "no baseline"), (3, "no probe")}


def test_one_run_opens_one_folder(spark, tmp_path):
    samples = spark.range(400).select((F.col("id") % 20).alias("run_id"), F.col("id").alias("sample_idx"), F.lit(1.0).alias("value"))
    files.write_corpus(samples, samples.select("run_id").distinct(), f"{tmp_path}/c", buckets=4)
    found = files.read_run(spark, f"{tmp_path}/c", 7, buckets=4)
    assert found.count() == 20
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan
    with pytest.raises(KeyError):
        files.read_run(spark, f"{tmp_path}/c", 99, buckets=4)


def test_streams_forget_finished_runs_and_repeated_samples(spark, tmp_path):
    source, out, check = (f"{tmp_path}/{n}" for n in ("source", "out", "check"))

    def part(lo, hi, run, minute):
        start = F.lit("2024-01-01 00:00:00").cast("timestamp")
        spark.range(lo, hi).select(
            F.lit(run).cast("long").alias("run_id"), F.col("id").alias("sample_idx"), F.col("id").cast("double").alias("v"), (start + F.expr(f"make_dt_interval(0, 0, {minute})")).alias("ts")
        ).coalesce(1).write.mode("append").parquet(source)

    def block(positions, table):
        return {"w": table[:, 0] * 2}

    states = []
    for lo, hi, run, minute in ((0, 5, 1, 0), (3, 8, 1, 0), (0, 3, 2, 30), (0, 3, 3, 60), (0, 3, 4, 90)):
        part(lo, hi, run, minute)
        stream = ordered_stream(spark.readStream.schema("run_id long, sample_idx long, v double, ts timestamp").parquet(source), ["v"], 1, block, "w double", time="ts", wait="5 minutes")
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start()
        query.awaitTermination()
        states.append([s["numRowsTotal"] for s in query.lastProgress["stateOperators"] if "applyInPandas" in s["operatorName"] or s["operatorName"] == "flatMapGroupsWithState" or "Pandas" in s["operatorName"]])
    rows = spark.read.parquet(out)
    assert rows.where("run_id = 1").count() == 8 and rows.count() == rows.distinct().count()
    assert all(n <= 2 for n in states[-1])
