"""Looking up runs: listing, one run, its arrays, the sample at a cursor."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


class RunSource(Protocol):
    """What the operators ask of a data source; batch and stream sources return
    the same columns (run_id, sample_idx, t_min and one column per tag)."""

    def samples(self, spark: SparkSession) -> DataFrame: ...

    def meta(self, spark: SparkSession) -> DataFrame: ...


class ParquetRuns:
    """Runs kept as two Parquet tables under one folder."""

    def __init__(self, path: str):
        self.path = path

    def samples(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/samples")

    def meta(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/run_meta")


class StreamedRuns(ParquetRuns):
    """The same tables, samples read as a stream of new files."""

    def samples(self, spark: SparkSession) -> DataFrame:
        schema = spark.read.parquet(f"{self.path}/samples").schema
        return spark.readStream.schema(schema).parquet(f"{self.path}/samples")


def list_runs(labels: DataFrame, meta: DataFrame) -> DataFrame:
    """Summary row of every run, in id order."""
    return (
        meta.join(labels, "run_id")
        .select(
            "run_id", "from_grade", "to_grade", "off_spec", "off_spec_minutes", "max_abs_dev_pct",
            "settle_min", "primary_cause",
        )
        .orderBy("run_id")
    )


def get_run(df: DataFrame, run_id: int) -> DataFrame:
    """Rows of one run; an unknown id is an error (checked with one row)."""
    rows = df.where(F.col("run_id") == run_id)
    if rows.isEmpty():
        raise KeyError(run_id)
    return rows


def run_arrays(samples: DataFrame, columns: list[str], chunk: int = 65_536) -> DataFrame:
    """Each run as arrays in sample order.  A run longer than ``chunk`` samples
    comes as several rows (``part`` 0, 1, ...), so no row grows without bound."""
    part = F.floor(F.col("sample_idx") / F.lit(chunk)).cast("int")
    packed = samples.groupBy("run_id", part.alias("part")).agg(
        F.array_sort(F.collect_list(F.struct("sample_idx", *columns))).alias("_rows")
    )
    return packed.select(
        "run_id", "part", *[F.col("_rows")[c].alias(c) for c in columns]
    )


def at_cursor(
    rows: DataFrame, cursors: DataFrame, fallback_first: bool = False, time: str = "t_min",
    order: str = "sample_idx", slice_min: float = 60.0,
) -> DataFrame:
    """For each (run_id, cursor) the last row at or before the cursor; NULLs if
    there is none, or the run's first row with ``fallback_first``.

    Rows and cursors meet in slices of ``slice_min`` minutes, so neither a long run
    nor many cursors of one run fill a task, and no row-cursor pairs are formed.
    The last row of the earlier slices comes from one summary row per slice."""
    names = [c for c in rows.columns if c != "run_id"]
    whole = F.struct(*names)

    def slice_of(c):
        return F.floor(c / F.lit(slice_min)).alias("_slice")

    points = rows.select("run_id", slice_of(F.col(time)), F.col(time).alias("_t"), F.col(order).alias("_o"), whole.alias("_row"))
    asked = cursors.select("run_id", slice_of(F.col("cursor")), F.col("cursor").alias("_t"), "cursor").distinct()
    merged = points.unionByName(asked, allowMissingColumns=True).repartition("run_id", "_slice")
    # at equal times rows come before the cursor
    upto = W.partitionBy("run_id", "_slice").orderBy("_t", F.asc_nulls_last("_o")).rowsBetween(W.unboundedPreceding, 0)
    inside = merged.withColumn("_row", F.last("_row", ignorenulls=True).over(upto)).where(F.col("cursor").isNotNull())

    key = F.struct("_t", "_o")
    ends = points.groupBy("run_id", "_slice").agg(F.max_by("_row", key).alias("_end"), F.min_by("_row", key).alias("_begin"))
    slices = ends.select("run_id", "_slice", "_end").unionByName(
        asked.select("run_id", "_slice").distinct(), allowMissingColumns=True
    ).groupBy("run_id", "_slice").agg(F.first("_end", ignorenulls=True).alias("_end"))
    earlier = W.partitionBy("run_id").orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    carried = slices.select("run_id", "_slice", F.last("_end", ignorenulls=True).over(earlier).alias("_before"))
    found = inside.join(carried, ["run_id", "_slice"], "left")
    pick = F.coalesce("_row", "_before")
    if fallback_first:
        first = ends.groupBy("run_id").agg(F.min_by("_begin", "_slice").alias("_first"))
        found = found.join(first, "run_id", "left")
        pick = F.coalesce(pick, F.col("_first"))
    return found.withColumn("_pick", pick).select("run_id", "cursor", *[F.col("_pick")[c].alias(c) for c in names])


def worst_run(labels: DataFrame) -> DataFrame:
    """The run with the largest excursion (smallest id wins a tie)."""
    return labels.orderBy(F.desc("max_abs_dev_pct"), "run_id").limit(1)
