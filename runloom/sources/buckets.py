"""A corpus kept in buckets of (run, segment), so that what is known of runs joins it
without moving a sample.

The bucket columns are those of ``segments``: a long run is spread over many buckets,
and values of a run are repeated for its segments before they meet the samples.  Choose
at least as many buckets as the cluster's shuffle partitions, or the planner may prefer
to spread the samples anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runloom.operators.segments import SEG, SEGMENT_ROWS, per_segment

KEYS = ("run_id", SEG)


def write_bucketed(samples: DataFrame, table: str, path: str, buckets: int = 1024, size: int = SEGMENT_ROWS, mode: str = "errorifexists") -> None:
    """Samples as a bucketed Parquet table at ``path``, known to this session's catalog
    as ``table``; one sorted file a bucket."""
    rows = samples.withColumn(SEG, F.floor(F.col("sample_idx") / F.lit(size)))
    rows = rows.repartition(buckets, *KEYS)
    rows.write.mode(mode).format("parquet").bucketBy(buckets, *KEYS).sortBy(*KEYS, "sample_idx").option("path", path).saveAsTable(table)


def open_bucketed(spark: SparkSession, table: str, path: str, schema: T.StructType | str, buckets: int = 1024) -> DataFrame:
    """The table of :func:`write_bucketed`; a catalog that doesn't know it (another
    session) is told, with the schema of the samples and the buckets it was written with."""
    if not spark.catalog.tableExists(table):
        schema = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in [*schema.fields, T.StructField(SEG, T.LongType())])
        by = ", ".join(f"`{k}`" for k in KEYS)
        spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}, `sample_idx`) INTO {int(buckets)} BUCKETS LOCATION '{path}'")
    return spark.table(table)


def with_runs(bucketed: DataFrame, constants: DataFrame, size: int = SEGMENT_ROWS, how: str = "inner") -> DataFrame:
    """Samples next to what is known of their run; ``constants`` has run_id, n_samples
    and more.  Only the constants are shuffled."""
    return bucketed.join(per_segment(constants, size), list(KEYS), how)
