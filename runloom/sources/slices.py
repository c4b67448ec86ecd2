"""Runs kept in time slices, so that a question about a few moments reads a few folders.

Rows lie in folders by (bucket of the run, slice of its time); a small table beside them
has one row per run and slice: its first and last position and time.  A cursor finds its
slice in the small table, and the rows are joined on the folders' columns, so that the
planner's dynamic partition pruning opens no other folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom.operators.stage import staged
from runloom.sources.files import bucket_of
from runloom.sources.runs import at_cursor

SLICE_MIN = 60.0


def write_slices(rows: DataFrame, path: str, slice_min: float = SLICE_MIN, buckets: int = 64, mode: str = "errorifexists") -> None:
    """``rows``: run_id, sample_idx, t_min (never falling with the position) and more."""
    cut = rows.withColumns({"bucket": bucket_of(F.col("run_id"), buckets), "slice": F.floor(F.col("t_min") / F.lit(slice_min)).cast("int")})
    (
        cut.repartition("bucket", "slice", "run_id").sortWithinPartitions("bucket", "slice", "run_id", "sample_idx")
        .write.mode(mode).partitionBy("bucket", "slice").parquet(f"{path}/rows")
    )
    written = rows.sparkSession.read.parquet(f"{path}/rows")
    ends = written.groupBy("run_id", "bucket", "slice").agg(
        F.min("sample_idx").alias("first_idx"), F.max("sample_idx").alias("last_idx"), F.min("t_min").alias("first_min"), F.max("t_min").alias("last_min")
    )
    ends.write.mode(mode).parquet(f"{path}/ends")


class Slices:
    def __init__(self, spark: SparkSession, path: str):
        self.rows = spark.read.parquet(f"{path}/rows")
        self.ends = spark.read.parquet(f"{path}/ends")

    def _holding(self, asked: DataFrame, start: str, fallback_first: bool) -> DataFrame:
        """run_id, cursor, bucket, slice: the last slice that begins at or before."""
        begins = self.ends.select("run_id", "bucket", "slice", F.col(start).cast("double").alias("_begin"))
        found = at_cursor(begins, asked, fallback_first, time="_begin", order="slice", slice_min=float(1 << 20))
        return found.where(F.col("slice").isNotNull()).select("run_id", "cursor", "bucket", "slice")

    def _opened(self, wanted: DataFrame, on: list[str]) -> DataFrame:
        """Rows that ``wanted`` (with bucket and slice) names; other folders stay shut."""
        # staged, so that the planner knows how few they are; the comparison tells it that
        # they are a selection
        few = staged(wanted.select("bucket", "slice", *on).distinct()).where(F.col("bucket") >= 0)
        return self.rows.join(few, ["bucket", "slice", *on], "left_semi")

    def at_cursor(self, cursors: DataFrame, fallback_first: bool = False) -> DataFrame:
        """run_id, cursor and the row there, as ``runs.at_cursor`` of all rows; cursors
        without a row are left out."""
        near = self._opened(self._holding(cursors, "first_min", fallback_first), ["run_id"]).drop("bucket", "slice")
        return at_cursor(near, cursors, fallback_first).where(F.col("sample_idx").isNotNull())

    def at_positions(self, positions: DataFrame) -> DataFrame:
        """Rows at (run_id, sample_idx)."""
        asked = positions.select("run_id", F.col("sample_idx").cast("double").alias("cursor")).distinct()
        found = self._holding(asked, "first_idx", False).withColumn("sample_idx", F.col("cursor").cast("long"))
        return self._opened(found, ["run_id", "sample_idx"]).drop("bucket", "slice")


class Frame:
    """The same two questions to a plain table of rows."""

    def __init__(self, rows: DataFrame):
        self.rows = rows

    def at_cursor(self, cursors: DataFrame, fallback_first: bool = False) -> DataFrame:
        # only positions and times travel
        found = at_cursor(self.rows.select("run_id", "sample_idx", "t_min"), cursors, fallback_first)
        return found.where(F.col("sample_idx").isNotNull())

    def at_positions(self, positions: DataFrame) -> DataFrame:
        return self.rows.join(positions.distinct(), ["run_id", "sample_idx"], "left_semi")
