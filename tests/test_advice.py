"""Pricing, gating, plans, ledger and files."""

import pytest
from pyspark.sql import functions as F

from runloom.dims import grades_table
from runloom.functions import text
from runloom.operators import advice, ledger as led
from runloom.operators.features import feasible_ramp
from runloom.operators.stage import staging_path
from runloom.plans.catalog import QUERIES
from runloom.settings import Economics, SurfacePolicy
from runloom.sources import files, runs
from runloom.streaming import ledger as sled

ECON = Economics()


def offers(spark, *rows):
    """(minutes, confidence, cost)"""
    return spark.createDataFrame(
        [(i, float(m), float(c), float(k), 700.0, 70.0) for i, (m, c, k) in enumerate(rows)],
        "n int, avoided_min double, confidence double, cost_usd double, machine_speed double, basis_weight double",
    )


def test_price(spark):
    good, bad = advice.price(offers(spark, (-5, 0.9, 0), (0, 0.9, 500), (6, 0.5, 0), (1, 1.2, 0)), ECON)
    r = {x.n: x for x in good.collect()}
    assert bad.select("n").first().n == 3
    assert r[0].avoided_tonnes == 0 and r[0].value_usd == 0 and r[0].avoided_min == -5
    assert r[1].value_usd < 0 and r[1].low_usd <= r[1].value_usd <= r[1].high_usd
    tonnes = 6 * 700 * 6.0 * 70 / 1e6
    assert r[2].value_usd == pytest.approx(0.5 * tonnes * 137)
    yearly = advice.price(offers(spark, (6, 0.5, 0)), Economics(grade_changes_per_day=2, operating_days_per_year=300))[0].first()
    assert yearly.annual_usd == pytest.approx(yearly.value_usd * 600)


def test_comparison_and_portfolio(spark):
    rows = offers(spark, (0, 0.8, 0), (0, 0.8, 0)).withColumn("base", F.when(F.col("n") == 0, 8.0).otherwise(2.0)).withColumn("new", F.lit(10.0) - F.col("base"))
    r = {x.n: x for x in advice.price_comparison(rows, "base", "new")[0].collect()}
    assert r[0].avoided_min == 6.0 and r[0].value_usd > 0 and r[1].value_usd == 0
    values = spark.createDataFrame([(100.0,), (200.0,), (300.0,)], "value_usd double")
    econ = Economics(grade_changes_per_day=1, operating_days_per_year=100)
    assert advice.portfolio_value(values, economics=econ).first()[0] == 20_000
    assert advice.portfolio_value(values.limit(0), economics=econ).first()[0] == 0


def test_gate(spark):
    schema = "run_id long, id string, confidence double, value_usd double"
    rows = [(1, "cheap", 0.9, 10.0), (1, "free", 0.5, None), (1, "unsure", 0.1, 900.0), (2, "a", 0.5, 500.0), (2, "b", 0.99, None)]
    rows += [(3, f"u{i}", 0.5 + i / 100, None) for i in range(5)]
    out = advice.rank_and_gate(spark.createDataFrame(rows, schema), ["run_id"], SurfacePolicy(max_shown=2)).orderBy("run_id", "place").collect()
    assert [(r.run_id, r.id) for r in out] == [(1, "free"), (2, "a"), (2, "b"), (3, "u4"), (3, "u3")]


def test_sensitivity(spark):
    rows = [(1, "ramp_min", 0, 0.0, 10.0, 6.0), (1, "ramp_min", 1, -2.0, None, 6.0), (1, "ramp_min", 2, 2.0, 8.0, 6.0),
            (2, "ramp_min", 0, 0.0, 5.0, 6.0), (2, "ramp_min", 1, -2.0, 7.0, 6.0), (2, "ramp_min", 2, 2.0, 9.0, 6.0), (3, "ramp_min", 0, 0.0, 5.0, 6.0)]
    df = spark.createDataFrame(rows, "run_id long, parameter string, place int, delta double, settle_min double, base_value double")
    out = {r.run_id: r for r in advice.sensitivity(df, 30.0).collect()}
    assert set(out) == {1, 2}  # nothing was probed for run 3
    assert out[1].sensitivity_min_per_unit == pytest.approx((30 - 10) / -2) and out[1].best_direction == "increase" and out[1].improvement_min == 2.0
    assert out[2].best_direction == "none" and out[2].best_delta == 0.0 and out[2].improvement_min == 0.0


def test_best_plan(spark):
    rows = [(1, 0, True, 8.0, 3.0), (1, 1, False, 2.0, 9.0), (1, 2, False, 2.0, 9.0), (1, 3, False, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "run_id long, n int, is_baseline boolean, off_spec_minutes double, ramp double")
    r = advice.best_plan(df, "run_id", ["n"], "off_spec_minutes", F.col("ramp") >= 5, ["off_spec_minutes", "ramp"]).first()
    assert r.best_off_spec_minutes == 2.0 and r.saved_off_spec_minutes == 6.0 and r.n_evaluations == 4 and r.source == "RECIPE_LIMIT"


def test_every_run_is_planned_or_rejected(spark):
    rows = [(1, 0, True, 8.0, 3.0), (1, 1, False, 2.0, 9.0), (2, 0, True, 5.0, 1.0), (2, 1, False, 1.0, 2.0), (3, 0, False, 5.0, 9.0), (4, 0, False, 5.0, 1.0), (5, 0, None, 5.0, 9.0)]
    df = spark.createDataFrame(rows, "run_id long, n int, is_baseline boolean, off_spec_minutes double, ramp double")
    rule = ("run_id", ["n"], "off_spec_minutes", F.col("ramp") >= 5, ["off_spec_minutes", "ramp"])
    plans, rejects = advice.best_plan(df, *rule).collect(), advice.best_plan_rejects(df, *rule).collect()
    assert [r.run_id for r in plans] == [1] and plans[0].base_off_spec_minutes == 8.0
    assert {r.run_id: r.reason for r in rejects} == {2: "no feasible plan", 3: "no baseline", 4: "no baseline and no feasible plan", 5: "no baseline"}
    assert {r.run_id: r.n_evaluations for r in rejects}[2] == 2


def test_summary_judges_parts_whose_first_line_was_returned(spark, tmp_path):
    spark.createDataFrame([(k, k) for k in (1, 2, 3)], "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    lines = [(1, 1, "R", 30.0), (1, 2, "N", 8.0), (2, 1, "N", 3.0), (2, 2, "A", 6.0), (3, 1, "N", 4.0)]
    rows = [(p, p * 10 + n, n, 1, q, 1000.0 * n, 0.1, flag) for p, n, flag, q in lines]
    schema = "l_partkey long, l_orderkey long, l_linenumber int, l_suppkey long, l_quantity double, l_extendedprice double, l_tax double, l_returnflag string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/lineitem.parquet")
    out = QUERIES["improvement_summary"](spark, str(tmp_path)).first()
    # part 1 has a returned baseline, part 2 no line of 20 or more, part 3 none of 5 or more
    assert (out.n_evaluated, out.n_skipped, out.n_recipe_limit) == (2, 1, 1)


def test_economics(spark):
    rows = [(1, -50000.0, None), (2, None, 400.0), (3, 10.0, 300.0), (4, float("nan"), None), (5, None, None)]
    df = spark.createDataFrame(rows, "id int, net_margin_per_tonne double, operating_days_per_year double")
    ok, bad = advice.overlay_economics(df)
    assert {r.id for r in bad.collect()} == {1, 2, 4}
    kept = {r.id: r for r in ok.collect()}
    assert kept[3].net_margin_per_tonne == 10.0 and kept[5].net_margin_per_tonne == 95.0 and kept[5].operating_days_per_year == 340.0


def log(spark, rows):
    """(kind, advisory, source, confidence, value, decision)"""
    full = [(f"e{i}", k, a, float(i), s, c, v, d, None, 1, i) for i, (k, a, s, c, v, d) in enumerate(rows)]
    return spark.createDataFrame(full, led.LEDGER)


def test_trust(spark):
    entries = log(spark, [("surfaced", "a1", "RISK_MODEL", 0.8, 100.0, None), ("surfaced", "a2", "RISK_MODEL", 0.4, 50.0, None),
                          ("surfaced", "a1", "RISK_MODEL", 0.8, 100.0, None),
                          ("response", "a1", None, None, None, "rejected"), ("response", "a1", None, None, None, "accepted"),
                          ("response", "a2", None, None, None, "rejected"), ("response", "zz", None, None, None, "accepted")])
    t = led.trust_summary(entries).first()
    assert (t.n_surfaced, t.n_responded, t.acceptance_rate) == (2, 2, 0.5)
    assert t.mean_confidence_accepted == 0.8 and t.mean_confidence_rejected == 0.4 and t.realized_value_usd == 100.0
    assert [r.advisory_id for r in led.orphans(entries).collect()] == ["zz"]
    none = led.trust_summary(entries.where("kind = 'surfaced'")).first()
    assert none.acceptance_rate is None and none.n_responded == 0
    assert led.trust_by_source(entries).first().acceptance_rate == 0.5


def test_responses_and_files(spark):
    shown = log(spark, [("surfaced", "a1", "RISK_MODEL", 0.8, 100.0, None)])
    answers = spark.createDataFrame([("a1", "accepted", "ok", 1.0, 10), ("a1", "maybe", None, 2.0, 11), ("a9", "accepted", None, 3.0, 12), ("a1", "ignored", "x" * 2001, 4.0, 13)],
                                    "advisory_id string, decision string, note string, timestamp double, seq long")
    good, bad = led.record_responses(answers, shown)
    assert good.count() == 1 and {r.seq: r.reason for r in bad.collect()} == {11: "unknown decision", 12: "never surfaced", 13: "note too long"}
    path = staging_path(spark, "ledger")
    assert led.read_ledger(spark, path).count() == 0
    led.append_ledger(shown, path)
    led.append_ledger(good, path)
    back = led.read_ledger(spark, path)
    assert back.count() == 2 and led.trust_summary(back).first().acceptance_rate == 1.0


def test_streamed_ledger(spark):
    rows = [("surfaced", f"a{i}", "RISK_MODEL", 0.5, 10.0, None) for i in range(6)] + [("response", f"a{i}", None, None, None, "accepted" if i < 2 else "rejected") for i in range(4)]
    log_ = log(spark, [*rows, ("response", "a3", None, None, None, "accepted")])
    source, path, changes = (staging_path(spark, n) for n in ("source", "ledger", "changes"))
    led.append_ledger(log_.repartition(3), source)
    for _ in range(2):  # the second run finds nothing new
        sled.append_stream(sled.read_ledger_stream(spark, source, 1), path, f"{changes}-append").awaitTermination()
    assert led.read_ledger(spark, path).count() == 11
    sled.track_latest(sled.read_ledger_stream(spark, path, 1), changes, f"{changes}-track").awaitTermination()
    assert sled.live_trust(spark, changes).first() == led.trust_summary(log_).first()


def test_text(spark):
    r = spark.range(1).select(
        text.one_line(F.lit("a\tb \x00 c   d"), 24).alias("a"), text.one_line(F.lit("abcdefgh"), 5).alias("b"),
        text.utc_text(F.lit(1700000000.7)).alias("c"), text.one_line(F.lit(None).cast("string"), 5).alias("d"),
        text.explain_knob(F.lit("ramp_min"), F.lit("none"), F.lit(0.0), F.lit(0.0)).alias("e"),
    ).first()
    assert (r.a, r.b, r.c, r.d) == ("a b c d", "abcd…", "2023-11-14 22:13:20", "")
    assert r.e == "ramp_min: leave as it is, no probe settles sooner"


def test_corpus_round_trip(spark):
    samples = spark.createDataFrame([(r, i, i / 12, float(i) if i else float("nan")) for r in (1, 2) for i in range(5)], "run_id long, sample_idx int, t_min double, basis_weight double")
    meta = spark.createDataFrame([(1, "A", float("nan"))], "run_id long, from_grade string, settle_min double")
    path = staging_path(spark, "corpus")
    files.write_corpus(samples, meta, path, buckets=4)
    s, m = files.read_corpus(spark, path)
    assert s.count() == 10 and s.where("basis_weight IS NULL").count() == 2 and m.first().settle_min is None
    assert runs.ParquetRuns(path).samples(spark).count() == 10 and runs.StreamedRuns(path).samples(spark).isStreaming
    one = files.fingerprint(s).first().fingerprint
    assert one == files.fingerprint(s.repartition(3)).first().fingerprint != files.fingerprint(s.where("run_id = 1")).first().fingerprint
    with pytest.raises(KeyError):
        runs.get_run(s, 99)
    assert runs.get_run(s, 2).count() == 5
    chunks = runs.run_arrays(s, ["t_min"], chunk=2).where("run_id = 1").orderBy("part").collect()
    assert [len(c.t_min) for c in chunks] == [2, 2, 1]
    cursors = spark.createDataFrame([(1, 0.2), (1, -1.0)], "run_id long, cursor double")
    strict = {r.cursor: r.sample_idx for r in runs.at_cursor(s, cursors).collect()}
    relaxed = {r.cursor: r.sample_idx for r in runs.at_cursor(s, cursors, fallback_first=True).collect()}
    assert strict == {0.2: 2, -1.0: None} and relaxed == {0.2: 2, -1.0: 0}


def test_cursor_slices(spark):
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate((0.5, 0.9, 3.2, 3.3, 9.0))], "run_id long, sample_idx int, t_min double")
    asked = [0.1, 0.5, 2.9, 3.25, 5.0, 8.99, 9.0, 40.0]
    cursors = spark.createDataFrame([(1, c) for c in asked], "run_id long, cursor double")
    for width in (1.0, 60.0):
        got = {r.cursor: r.sample_idx for r in runs.at_cursor(rows, cursors, slice_min=width).collect()}
        assert [got[c] for c in asked] == [None, 0, 1, 2, 3, 3, 4, 4]


def test_own_limits_of_a_grade(spark):
    grades = grades_table(spark).withColumn("max_machine_speed_rate", F.when(F.col("code") == "WFU-70", 4.5).otherwise(45.0))
    meta = spark.sql("SELECT 1L AS run_id, 'NP-45' AS from_grade, 'WFU-70' AS to_grade, 6D AS plan_ramp_min")
    r = feasible_ramp(meta, grades).first()
    assert r.binding_actuator == "machine_speed" and r.min_ramp_min == pytest.approx(230 / 4.5 * 1.5)


def test_feature_cache_and_reports(spark):
    df = spark.sql("SELECT 1L AS run_id, 0 AS sample_idx, 0.1D AS x, 'g' AS from_grade")
    p, c, r = (staging_path(spark, n) for n in ("p", "c", "r"))
    files.write_features(df, p)
    files.write_features(df, c, text=True)
    back = files.read_features(spark, p)
    assert dict(back.dtypes)["x"] == "float" and files.read_features(spark, c, back.schema).first().x == pytest.approx(0.1)
    files.write_report(df, r, ["run_id", "x"])
    assert spark.read.option("header", True).csv(r).columns == ["run_id", "x"]


def test_faults_by_run(spark):
    path = staging_path(spark, "faults")
    spark.createDataFrame([('{"3": [{"code": "PUMP", "magnitude": 1.5, "period_min": 2.0}], "4": []}',)], "value string").write.text(path)
    got = files.read_faults(spark, path).collect()
    assert [(r.run_id, r.code, r.period_min) for r in got] == [(3, "PUMP", 2.0)]
