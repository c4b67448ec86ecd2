import pytest
from pyspark.sql import SparkSession

from runloom.operators.stage import drop_staged


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("runloom-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    drop_staged(session)
    session.stop()


def make_run(spark, columns: dict[str, list], run_id: int = 1):
    """One run as a sample table; columns of equal length."""
    n = len(next(iter(columns.values())))
    rows = [(run_id, i, i * 5 / 60.0, *[float(columns[c][i]) for c in columns]) for i in range(n)]
    schema = "run_id long, sample_idx int, t_min double" + "".join(f", {c} double" for c in columns)
    return spark.createDataFrame(rows, schema)
