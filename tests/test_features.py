"""The wide table: shape, no leakage, stream = batch, stateless pieces."""

import random

import pytest
from pyspark.sql import functions as F

from runloom.dims import ALL_TAGS, DV_NOMINAL, GRADES, SETPOINT_TAGS, grades_table, known_loops_table, tags_table
from runloom.functions import sheet
from runloom.functions.numeric import model_inputs, narrow_doubles, rounded
from runloom.functions.series import s_curve, transition_context
from runloom.operators import advice, targets
from runloom.operators import features as feat
from runloom.operators.stage import staging_path
from runloom.plans import queries_runs, queries_stream
from runloom.settings import PlanBounds, RunSpec
from runloom.sources import driver_tables
from runloom.streaming.features import match_metadata, match_stretches, read_tracked, stream_alarms, stream_features, track_features, windowed_stream

SPEC = RunSpec()
LEVEL = {"stock_flow": 40.0, "filler_flow": 0.5, "steam_pressure": 500.0, "machine_speed": 700.0, "retention_aid": 250.0,
         "jet_wire_ratio": 1.0, "basis_weight": 70.0, "moisture": 6.0, "ash": 12.0, "caliper": 90.0, **DV_NOMINAL,
         "basis_weight_sp": 70.0, "moisture_sp": 6.0, "ash_sp": 12.0}


def wide_run(spark, n=220, run_id=1, seed=0, corrupt_after=None):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        values = [LEVEL[t] * (1 + rng.gauss(0, 0.01)) for t in [*ALL_TAGS, *SETPOINT_TAGS]]
        if corrupt_after is not None and i > corrupt_after:
            values = [v * 3.0 for v in values]
        rows.append((run_id, i, i * 5 / 60.0, *values))
    schema = "run_id long, sample_idx int, t_min double" + "".join(f", {t} double" for t in [*ALL_TAGS, *SETPOINT_TAGS])
    return spark.createDataFrame(rows, schema)


def meta(spark, runs=(1,)):
    return spark.createDataFrame(
        [(r, "NP-45", "WFU-70", "NONE", 6.0, 1.0, 1.0, True, 5.0) for r in runs],
        "run_id long, from_grade string, to_grade string, primary_cause string, plan_ramp_min double, plan_lead_scale double, "
        "plan_tau_c_scale double, plan_trim_enabled boolean, plan_start_min double",
    )


def table(spark, samples, **kw):
    return feat.wide_features(samples, meta(spark), grades_table(spark), SPEC, **kw)


def test_feature_count_and_warmup(spark):
    out = table(spark, wide_run(spark))
    assert len(model_inputs(out)) == 104
    assert out.agg(F.min("sample_idx")).first()[0] == SPEC.warmup
    assert out.count() == 220 - SPEC.warmup
    assert out.where(F.col("mv_stock_flow_roc_1min").isNull()).count() == 0


def test_no_leakage(spark):
    cols = model_inputs(table(spark, wide_run(spark)))
    clean = table(spark, wide_run(spark), size=40).where("sample_idx <= 110").orderBy("sample_idx").collect()
    dirty = table(spark, wide_run(spark, corrupt_after=110)).where("sample_idx <= 110").orderBy("sample_idx").collect()
    assert len(clean) == len(dirty) == 111 - SPEC.warmup
    for a, b in zip(clean, dirty):
        for c in cols:
            assert a[c] == pytest.approx(b[c], abs=1e-9), c


def test_stream_equals_batch(spark):
    samples = wide_run(spark, 130, 1, 1).union(wide_run(spark, 90, 2, 2))
    both = feat.wide_features(samples, meta(spark, (1, 2)), grades_table(spark), SPEC).drop("y_breach", "y_time_to_breach_min")
    path = staging_path(spark, "src")
    samples.repartition(3, F.xxhash64("sample_idx")).write.parquet(path)
    stream = spark.readStream.schema(samples.schema).option("maxFilesPerTrigger", 1).parquet(path)
    live = stream_features(stream, meta(spark, (1, 2)), grades_table(spark), SPEC, size=50)
    out, check = staging_path(spark, "out"), staging_path(spark, "check")
    live.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.schema(live.schema).parquet(out).orderBy("run_id", "sample_idx").collect()
    want = both.orderBy("run_id", "sample_idx").collect()
    assert len(got) == len(want)
    for a, b in zip(got, want):
        for c in both.columns:
            assert a[c] == (pytest.approx(b[c], rel=1e-9, abs=1e-9) if isinstance(b[c], float) else b[c]), c


def test_stream_stops_at_a_run_without_static_metadata(spark):
    samples = wide_run(spark, 40, 7, 1)
    path = staging_path(spark, "src")
    samples.write.parquet(path)
    live = stream_features(spark.readStream.schema(samples.schema).parquet(path), meta(spark, (1,)), grades_table(spark), SPEC)
    out, check = staging_path(spark, "out"), staging_path(spark, "check")
    with pytest.raises(Exception, match="unknown run: 7"):
        live.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()


def test_late_metadata_and_rejects(spark):
    """Metadata after the samples, metadata of an unknown grade, and none at all."""
    samples = wide_run(spark, 60, 1, 1).union(wide_run(spark, 50, 2, 2)).union(wide_run(spark, 40, 3, 3))
    samples = samples.withColumn("ts", F.timestamp_seconds(F.col("t_min") * 60 + 1_000_000))
    source, sink, rows, told, out, check = (staging_path(spark, n) for n in ("src", "sink", "rows", "told", "out", "check"))
    samples.write.parquet(source)
    window = windowed_stream(spark.readStream.schema(samples.schema).parquet(source), SPEC, stamp="ts")
    window.writeStream.format("parquet").option("path", sink).option("checkpointLocation", f"{check}-1").trigger(availableNow=True).start().awaitTermination()
    spark.read.parquet(sink).write.parquet(rows)
    known = meta(spark, (1,)).union(meta(spark, (2,)).withColumn("to_grade", F.lit("nobody's"))).withColumn("recorded", F.timestamp_seconds(F.lit(1_000_500)))
    ahead = spark.read.parquet(rows)

    def run(files=100):
        matched = match_metadata(
            spark.readStream.schema(ahead.schema).option("maxFilesPerTrigger", files).parquet(rows),
            spark.readStream.schema(known.schema).option("maxFilesPerTrigger", files).parquet(told), "ts", "recorded",
        )
        track_features(matched, grades_table(spark), SPEC, out, f"{check}-2").awaitTermination()

    known.limit(0).write.parquet(told)
    run()
    assert read_tracked(spark, out, "features").count() == 0 == read_tracked(spark, out, "rejects").count()
    known.union(known).write.mode("append").parquet(told)  # told twice
    run()
    for s in (2_000_000, 3_000_000):
        late = {"run_id": F.lit(None).cast("long")}
        ahead.limit(1).withColumns(late | {"ts": F.timestamp_seconds(F.lit(s))}).write.mode("append").parquet(rows)
        known.limit(1).withColumns(late | {"recorded": F.timestamp_seconds(F.lit(s))}).write.mode("append").parquet(told)
    run(1)
    got = read_tracked(spark, out, "features")
    want = feat.wide_features(samples.where("run_id = 1"), meta(spark, (1,)), grades_table(spark), SPEC).drop("y_breach", "y_time_to_breach_min")
    assert got.count() == want.count() == 60 - SPEC.warmup and got.select("run_id").distinct().count() == 1
    for a, b in zip(got.orderBy("sample_idx").collect(), want.orderBy("sample_idx").collect()):
        assert all(a[c] == (pytest.approx(b[c], rel=1e-9, abs=1e-9) if isinstance(b[c], float) else b[c]) for c in want.columns)
    rejects = {r.run_id: (r.reason, r.n) for r in read_tracked(spark, out, "rejects").groupBy("run_id", "reason").agg(F.sum("n_rows").alias("n")).collect()}
    assert rejects == {2: ("unknown grade", 50 - SPEC.warmup), 3: ("no metadata", 40 - SPEC.warmup)}


def test_stored_rows_wait_as_stretches(spark):
    """Late metadata of some rows of a run only, of an unknown grade, and none; the state
    of the join holds an entry per run, not its rows."""
    samples = wide_run(spark, 60, 1, 1).union(wide_run(spark, 50, 2, 2)).union(wide_run(spark, 40, 3, 3)).union(wide_run(spark, 30, 4, 4))
    samples = samples.withColumn("ts", F.timestamp_seconds(F.col("t_min") * 60 + 1_000_000))
    source, sink, beats, told, out, check = (staging_path(spark, n) for n in ("src", "sink", "beats", "told", "out", "check"))
    samples.write.parquet(source)
    window = windowed_stream(spark.readStream.schema(samples.schema).parquet(source), SPEC, stamp="ts")
    window.writeStream.format("parquet").option("path", sink).option("checkpointLocation", f"{check}-1").trigger(availableNow=True).start().awaitTermination()
    # stamped 98 s after the first sample: within 60 s of those from 38 s on, sample 8 is the first
    known = meta(spark, (1,)).union(meta(spark, (2,)).withColumn("to_grade", F.lit("nobody's"))).withColumn("recorded", F.timestamp_seconds(F.lit(1_000_098)))
    known = known.union(meta(spark, (4,)).withColumn("recorded", F.timestamp_seconds(F.lit(1_000_030))))
    stored = spark.read.parquet(sink)
    pending = stored.select("run_id", "sample_idx", "ts")

    def run(files=100):
        read = lambda schema, path: spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
        rows = read(pending.schema, sink).unionByName(read(pending.schema, beats))
        matched = match_stretches(rows, read(known.schema, told), "ts", "recorded", span="60 seconds")
        query = track_features(matched, grades_table(spark), SPEC, out, f"{check}-2", stored=stored)
        query.awaitTermination()
        return max(s["numRowsTotal"] for p in query.recentProgress for s in p["stateOperators"])

    pending.limit(0).write.parquet(beats)
    known.limit(0).write.parquet(told)
    assert run() < 30  # of 180 rows
    assert read_tracked(spark, out, "features").count() == 0 == read_tracked(spark, out, "rejects").count()
    known.union(known).write.mode("append").parquet(told)  # told twice
    run()
    for s in (2_000_000, 3_000_000):
        late = {"run_id": F.lit(None).cast("long")}
        pending.limit(1).withColumns(late | {"ts": F.timestamp_seconds(F.lit(s))}).write.mode("append").parquet(beats)
        known.limit(1).withColumns(late | {"recorded": F.timestamp_seconds(F.lit(s))}).write.mode("append").parquet(told)
    run(1)
    step = samples.where("run_id = 1 AND sample_idx = 1").first().ts.timestamp() - 1_000_000
    near = {r: [i for i in range(SPEC.warmup, n) if abs(i * step - at) <= 60 + 1e-6] for r, n, at in ((1, 60, 98), (2, 50, 98), (4, 30, 30))}
    got = read_tracked(spark, out, "features").orderBy("run_id", "sample_idx").collect()
    assert [(r.run_id, r.sample_idx) for r in got] == [(r, i) for r in (1, 4) for i in near[r]]
    want = feat.wide_features(samples.where("run_id = 1"), meta(spark, (1,)), grades_table(spark), SPEC).drop("y_breach", "y_time_to_breach_min")
    want = {r.sample_idx: r for r in want.collect()}
    for a in got:
        if a.run_id == 1:
            b = want[a.sample_idx]
            assert all(a[c] == (pytest.approx(b[c], rel=1e-9, abs=1e-9) if isinstance(b[c], float) else b[c]) for c in want[SPEC.warmup].__fields__)
    lost = {(r.run_id, r.reason): r.n for r in read_tracked(spark, out, "rejects").groupBy("run_id", "reason").agg(F.sum("n_rows").alias("n")).collect()}
    expect = {(r, "no metadata"): n - SPEC.warmup - len(near.get(r, [])) for r, n in ((1, 60), (2, 50), (3, 40), (4, 30))}
    expect[2, "unknown grade"] = len(near[2])
    assert lost == {k: n for k, n in expect.items() if n}


def test_stream_gap_is_given_up_after_the_watermark(spark):
    rows = [(1, i, 0.9, i * 60) for i in (0, 1, 3, 4)] + [(2, i, 0.1, 90_000 + i) for i in range(2)] + [(2, 2, 0.1, 200_000)]
    df = spark.createDataFrame(rows, "run_id long, sample_idx int, proba double, s long").withColumn("ts", F.timestamp_seconds(F.col("s") + 1_000_000)).drop("s")
    path = staging_path(spark, "gap")
    for part in (df.where("run_id = 1"), df.where("run_id = 2 AND sample_idx < 2"), df.where("run_id = 2 AND sample_idx = 2")):
        part.coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    live = stream_alarms(stream, 0.5, 2, time="ts", wait="1 minute")
    out, check = staging_path(spark, "out"), staging_path(spark, "check")
    live.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.schema(live.schema).parquet(out).where("run_id = 1").orderBy("sample_idx").collect()
    assert [r.sample_idx for r in got] == [0, 1, 3, 4]
    assert [r.alarm for r in got][:2] == [False, True]


def test_runs_share_buckets_in_a_stream(spark):
    """Python is called per bucket: 30 open runs leave two rows of state, not 30."""
    df = spark.range(30 * 25).select((F.col("id") % 30).alias("run_id"), F.floor(F.col("id") / 30).alias("sample_idx"))
    df = df.withColumn("proba", F.when(F.col("sample_idx") % 7 >= F.col("run_id") % 5, 0.9).when(F.col("run_id") % 3 != 0, 0.1))
    path, out, check = (staging_path(spark, n) for n in ("src", "out", "check"))
    df.repartition(3, F.xxhash64("sample_idx")).write.parquet(path)
    live = stream_alarms(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path), 0.5, 3, buckets=2)
    query = live.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {(r.run_id, r.sample_idx): r.alarm for r in spark.read.schema(live.schema).parquet(out).collect()}
    assert got == {(r, i): all(j >= 0 and j % 7 >= r % 5 for j in range(i - 2, i + 1)) for r in range(30) for i in range(25)}
    assert sum(s["numRowsTotal"] for s in query.lastProgress["stateOperators"]) <= 2


def test_forward_targets(spark):
    x = spark.createDataFrame([(1, i, float(i * i)) for i in range(40)], "run_id long, sample_idx int, bw_dev_pct double")
    for size in (6, 8192):
        out = targets.forward_targets(x, SPEC, (1.0, 2.0), size=size).orderBy("sample_idx").collect()
        for r in out:
            k = r.sample_idx
            assert r.y_fwd_1min == ((k + 12.0) ** 2 if k + 12 < 40 else None)
            assert r.y_fwd_2min == ((k + 24.0) ** 2 if k + 24 < 40 else None)
    looked = targets.forward_lookup(x, x.where("sample_idx != 20"), SPEC, (1.0,)).orderBy("sample_idx").collect()
    assert looked[8].y_fwd_1min is None and looked[9].y_fwd_1min == 21.0**2


def test_pinball(spark):
    row = spark.range(1).select(
        targets.pinball(F.lit(0.0), F.lit(1.0), 0.9).alias("hi"), targets.pinball(F.lit(0.0), F.lit(1.0), 0.1).alias("lo")
    ).first()
    assert row.hi < row.lo


def test_recipe_round_trip(spark):
    g = grades_table(spark)
    points = sheet.recipe_setpoints(*[F.col(c) for c in ("basis_weight", "moisture", "ash", "machine_speed")])
    state = {k: F.lit(v) for k, v in DV_NOMINAL.items() if k in sheet.SENSOR_INPUTS}
    back = sheet.soft_sensor({k: v for k, v in points.items() if k != "jet_wire_ratio"} | state)
    rows = g.select("code", "basis_weight", "moisture", "ash", *[v.alias(f"b_{k}") for k, v in back.items()]).collect()
    assert len(rows) == len(GRADES) == 7
    for r in rows:
        assert r.b_basis_weight == pytest.approx(r.basis_weight, abs=0.05), r.code
        assert r.b_ash == pytest.approx(r.ash, abs=0.05)
        assert r.b_moisture == pytest.approx(r.moisture, abs=0.20)


def test_soft_sensor_mass_balance(spark):
    base = {k: LEVEL[k] for k in sheet.SENSOR_INPUTS} | {"filler_flow": 0.0}

    def weight(**change):
        cols = {k: F.lit(float(v)) for k, v in (base | change).items()}
        return spark.range(1).select(sheet.soft_sensor(cols)["basis_weight"]).first()[0]

    one = weight()
    assert weight(stock_flow=80.0) == pytest.approx(2 * one)
    assert weight(machine_speed=1400.0) == pytest.approx(one / 2)


def test_s_curve_and_clip(spark):
    us = [0.0, 0.5, 1.0, -3.0, 7.0]
    got = [spark.range(1).select(s_curve(F.lit(u))).first()[0] for u in us]
    assert got == [0.0, 0.5, 1.0, 0.0, 1.0]
    plan = spark.createDataFrame([(999.0, -5.0, 99.0)], "ramp_min double, lead_scale double, tau_c_scale double")
    assert tuple(advice.clip_plan(plan, PlanBounds()).first()) == (25.0, 0.0, 4.0)


def test_feasible_ramp(spark):
    rows = meta(spark).unionByName(meta(spark, (2,)).withColumn("to_grade", F.lit("NP-45")))
    out = {r.run_id: r for r in feat.feasible_ramp(rows, grades_table(spark)).collect()}
    assert out[2].min_ramp_min == 0.0 and out[2].binding_actuator == ""
    # 950 -> 720 m/min at 45 per minute and peak factor 1.5
    assert out[1].min_ramp_min >= 230 / 45 * 1.5 - 1e-9 and out[1].binding_actuator != ""
    assert out[1].ramp_deficit_min == pytest.approx(max(out[1].min_ramp_min - 6.0, 0.0))


def test_grade_library(spark):
    g = grades_table(spark)
    a = g.select(*[F.col(c).alias(f"a_{c}") for c in ("code", "basis_weight", "moisture", "ash", "machine_speed")])
    b = g.select(*[F.col(c).alias(f"b_{c}") for c in ("code", "basis_weight", "moisture", "ash", "machine_speed")])
    pairs = a.join(b, F.col("a_code") != F.col("b_code")).select("a_code", "b_code", transition_context("a_", "b_")["transition_magnitude"].alias("m")).collect()
    assert len(pairs) == 42
    by = {(r.a_code, r.b_code): r.m for r in pairs}
    assert by["NP-45", "BRD-150"] == pytest.approx(105 / 45 + 0.5 * 4 / 30 + 0.5 * 500 / 950)
    assert tags_table(spark).count() == 19 and known_loops_table(spark).count() == 18


def test_narrowing_keeps_ids(spark):
    types = dict(narrow_doubles(spark.sql("SELECT 1L AS run_id, 1 AS y_breach, 2D AS x, 'a' AS s")).dtypes)
    assert types == {"run_id": "bigint", "y_breach": "int", "x": "float", "s": "string"}


def test_a_stream_query_stores_what_needs_the_past(spark, monkeypatch):
    """Raw columns are replayed, the sink has no stateless feature, no checkpoint stays."""
    sf = "/root/testdata/sf0.001"
    replayed, kept, gone = [], [], []
    plain, drain, delete = queries_stream.as_stream, queries_stream.drain, queries_stream.delete
    monkeypatch.setattr(queries_stream, "as_stream", lambda rows: replayed.append(rows.columns) or plain(rows))
    monkeypatch.setattr(queries_stream, "drain", lambda stream: kept.append(drain(stream)) or kept[0])
    monkeypatch.setattr(queries_stream, "delete", lambda spark, path: gone.append(path) or delete(spark, path))
    got = queries_stream.stream_features(spark, sf)
    assert replayed == [list(driver_tables.RAW)] and len(gone) == 1 and "progress" in gone[0]
    assert len(kept[0].columns) < 60 and not {"bw_dev_pct", "mv_stock_flow_slew_util", "plan_ramp_min", "from_grade"} & set(kept[0].columns)
    want = rounded(queries_runs.feature_table(spark, sf), 5).select(got.columns)
    assert got.count() == want.count() > 0 and got.exceptAll(want).count() == 0
