"""The bucketed corpus: no sample moves when runs' values join it."""

from pyspark.sql import functions as F

from runloom.operators.stage import staging_path
from runloom.sources import buckets


def corpus(spark):
    rows = [(r, i, float(r * 1000 + i)) for r, n in ((1, 250), (2, 3), (3, 70), (9, 1)) for i in range(n)]
    samples = spark.createDataFrame(rows, "run_id long, sample_idx int, value double")
    runs = samples.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_samples"), F.max("value").alias("top"))
    return samples, runs


def exchanges_over(plan, table):
    """Exchanges between the root and the scan of ``table``."""
    found, stack = [], []
    for line in plan.splitlines():
        depth = len(line) - len(line.lstrip(" :+-"))
        stack = [s for s in stack if s[0] < depth] + [(depth, line)]
        if f"{table}" in line and "Scan parquet" in line:
            found.append(sum("Exchange" in s for _, s in stack))
    return found


def test_samples_stay_where_they_are(spark):
    samples, runs = corpus(spark)
    path = staging_path(spark, "bucketed")
    buckets.write_bucketed(samples, "corpus_test", path, buckets=8, size=40)
    table = buckets.open_bucketed(spark, "corpus_test", path, samples.schema, 8)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        labels = runs.select("run_id", "n_samples", "top")
        splits = runs.select("run_id", "n_samples", (F.col("run_id") % 2).alias("side"))
        out = buckets.with_runs(buckets.with_runs(table, labels, 40), splits, 40)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert exchanges_over(plan, "corpus_test") == [0], plan
        got = out.select("run_id", "sample_idx", "value", "top", "side").collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    want = samples.join(runs, "run_id").select("run_id", "sample_idx", "value", "top", (F.col("run_id") % 2).alias("side")).collect()
    assert sorted(got) == sorted(want)
    spread = table.where("run_id = 1").select(F.expr("pmod(hash(run_id, _seg), 8)").alias("b")).distinct().count()
    assert spread > 3  # a long run is in many buckets


def test_another_session_opens_the_table(spark):
    samples, runs = corpus(spark)
    path = staging_path(spark, "bucketed")
    buckets.write_bucketed(samples, "corpus_first", path, buckets=8, size=40)
    again = buckets.open_bucketed(spark, "corpus_again", path, samples.schema, 8)
    assert again.count() == samples.count() and buckets.with_runs(again, runs, 40).count() == samples.count()
    for name in ("corpus_first", "corpus_again"):
        spark.sql(f"DROP TABLE {name}")
