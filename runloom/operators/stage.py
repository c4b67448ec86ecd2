"""Intermediate tables that several passes read.

A multi-pass operator would otherwise recompute its input once per pass.  The table
is written to the folder the cluster names in ``spark.checkpoint.dir`` (shared
storage, so a lost executor costs nothing), and reading it back gives the planner
its true size.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

CONF = "spark.checkpoint.dir"
_unset: dict[str, str] = {}


def _root(spark: SparkSession) -> str:
    app = spark.sparkContext.applicationId
    folder = spark.conf.get(CONF, None) or spark.sparkContext.getConf().get(CONF, None)
    if not folder:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"{CONF} must name a folder that all executors of {master} share")
        # one machine, such as a test: driver and tasks see the same folder
        folder = _unset.setdefault(app, "") or tempfile.mkdtemp(prefix="spark-")
        _unset[app] = folder
    return f"{folder.rstrip('/')}/staged-{app}"


def staged(df: DataFrame) -> DataFrame:
    """Write ``df`` once and continue from the written table."""
    spark = df.sparkSession
    path = f"{_root(spark)}/{uuid.uuid4().hex}"
    # measurements hardly repeat: a dictionary of them is built in vain, then given up
    measured = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    measured += [f"{f.name}.values.list.element" for f in df.schema.fields if isinstance(f.dataType, VectorUDT)]
    df.write.options(**{f"parquet.enable.dictionary#{name}": "false" for name in measured}).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder of this session that nothing reads any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def discard(table: DataFrame) -> None:
    """Remove a staged table that nothing reads any more."""
    delete(table.sparkSession, table._staged_at)


def staging_path(spark: SparkSession, name: str) -> str:
    """A fresh folder for a sink or a stream checkpoint of this session."""
    return f"{_root(spark)}/{name}-{uuid.uuid4().hex}"


def drop_staged(spark: SparkSession) -> None:
    """Remove every table this session staged."""
    delete(spark, _root(spark))
