"""The driver contract."""

import __spark_entry__ as entry


def test_names_line_up():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) >= 90


def test_flagship_runs(spark):
    out = entry.entry(spark)
    assert out.count() == 15 and "settle_min" in out.columns
