"""Splitting whole runs: strata, two- and three-way splits, their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runloom.operators.stage import staged
from runloom.operators.ordered import exact_percentiles, first_by_hash, shuffled_rank

SPLITS = ("train", "val", "test")


def run_strata(rows: DataFrame, magnitude: str = "transition_magnitude") -> DataFrame:
    """Per run: ever off-spec, any positive label, first magnitude, its tertile
    band and the stratum ``flag|band``.  Coinciding tertile edges put every run in
    band "all"."""
    per_run = rows.groupBy("run_id").agg(
        F.max("currently_off_spec").cast("int").alias("ever_off_spec"),
        F.max("y_breach").cast("int").alias("any_positive"),
        F.min_by(magnitude, "sample_idx").alias("magnitude"),
    )
    per_run = staged(per_run)
    edges = exact_percentiles(per_run, "magnitude", {"e0": 0.0, "e1": 1 / 3, "e2": 2 / 3, "e3": 1.0})
    e = edges.select(F.struct("e0", "e1", "e2", "e3")).scalar()
    m = F.col("magnitude")
    distinct = (F.col("_e.e0") < F.col("_e.e1")) & (F.col("_e.e1") < F.col("_e.e2")) & (F.col("_e.e2") < F.col("_e.e3"))
    band = (
        F.when(~distinct, "all")
        .when(m <= F.col("_e.e1"), "low")
        .when(m <= F.col("_e.e2"), "mid")
        .otherwise("high")
    )
    return (
        per_run.withColumn("_e", e)
        .withColumn("mag_band", band)
        .withColumn("stratum", F.concat_ws("|", F.col("ever_off_spec").cast("string"), "mag_band"))
        .drop("_e")
    )


def two_way_split(run_ids: DataFrame, test_frac: float = 0.25, seed: int = 42) -> DataFrame:
    """Seeded shuffle of the runs; ``round(n * test_frac)`` of them, one at
    least, go to test."""
    ids = run_ids.select("run_id").distinct()
    n = ids.agg(F.count(F.lit(1))).scalar()
    n_test = F.greatest(F.bround(n * F.lit(test_frac)), F.lit(1))
    ranked = shuffled_rank(ids, "run_id", seed)
    return ranked.select(
        "run_id", F.when(F.col("rank") <= n_test, "test").otherwise("train").alias("split")
    )


def split_sizes(n: Column, val_frac: float, test_frac: float) -> tuple[Column, Column]:
    """Runs of a stratum of ``n`` that go to test and to val: the floor of the
    share, one each from three runs on, and less where train would be left empty."""
    spare = F.when(n >= 3, F.lit(1)).otherwise(F.lit(0))
    test = F.greatest(F.floor(n * F.lit(test_frac)), spare)
    val = F.greatest(F.floor(n * F.lit(val_frac)), spare)
    full = test + val >= n
    test_cut = F.when(full, F.least(test, F.greatest(n - 2, F.lit(0)))).otherwise(test)
    val_cut = F.when(full, F.least(val, F.greatest(n - 1 - test_cut, F.lit(0)))).otherwise(val)
    return test_cut, val_cut


def three_way_split(
    strata: DataFrame, val_frac: float = 0.20, test_frac: float = 0.20, seed: int = 42
) -> DataFrame:
    """Stratified split of whole runs into train, val and test."""
    if not (0 < val_frac < 1 and 0 < test_frac < 1 and val_frac + test_frac < 1):
        raise ValueError("fractions must be in (0, 1) and leave room for train")
    base = strata.select("run_id", "stratum")
    sizes = base.groupBy("stratum").agg(F.count(F.lit(1)).alias("_n"))
    ranked = shuffled_rank(base, "run_id", seed, keys=["stratum"]).join(sizes, "stratum")
    n_test, n_val = split_sizes(F.col("_n"), val_frac, test_frac)
    place = F.col("rank")
    which = F.when(place <= n_test, "test").when(place <= n_test + n_val, "val").otherwise("train")
    return ranked.select("run_id", "stratum", which.alias("split"))


def rows_of(rows: DataFrame, splits: DataFrame, which: str) -> DataFrame:
    """Rows whose run is in the split."""
    if which not in SPLITS:
        raise KeyError(which)
    return rows.join(splits.where(F.col("split") == which).select("run_id"), "run_id", "left_semi")


def split_overlap(splits: DataFrame) -> DataFrame:
    """Runs that sit in more than one split; must be empty."""
    n = F.count_distinct("split")
    return splits.groupBy("run_id").agg(n.alias("n_splits")).where(F.col("n_splits") > 1)


def require_disjoint(splits: DataFrame) -> DataFrame:
    """The splits unchanged, or an error naming some of the shared runs."""
    shared = [r.run_id for r in split_overlap(splits).orderBy("run_id").limit(5).collect()]
    if shared:
        raise ValueError(f"runs in more than one split: {shared}")
    return splits


def split_summary(rows: DataFrame, splits: DataFrame) -> DataFrame:
    """Runs, rows and positive rates of each split, overall and in spec."""
    clean = F.col("currently_off_spec") == 0
    per_run = rows.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("y_breach").alias("pos"),
        F.sum(clean.cast("long")).alias("n_in"), F.sum(F.when(clean, F.col("y_breach")).otherwise(0)).alias("pos_in"),
    )
    return (
        per_run.join(splits, "run_id")
        .groupBy("split")
        .agg(
            F.count(F.lit(1)).alias("n_runs"), F.sum("n").alias("n_rows"),
            F.try_divide(F.sum("pos"), F.sum("n")).alias("positive_rate"),
            F.sum("n_in").alias("in_spec_rows"),
            F.try_divide(F.sum("pos_in"), F.sum("n_in")).alias("in_spec_positive_rate"),
        )
    )


def seeded_sample(df: DataFrame, ident: str, n: int, seed: int) -> DataFrame:
    """``n`` rows without replacement: the first by md5 of id and seed."""
    return first_by_hash(df, ident, n, seed)


def sample_runs(df: DataFrame, n: int, seed: int) -> DataFrame:
    """All rows of ``n`` seeded runs."""
    chosen = seeded_sample(df.select("run_id").distinct(), "run_id", n, seed)
    return df.join(chosen, "run_id", "left_semi")
