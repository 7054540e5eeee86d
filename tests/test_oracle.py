"""Spark queries vs independent DuckDB oracle on sf0.001 (the driver runs the
full set at sf0.01; ``python tests/oracle_check.py`` does it locally)."""

import pytest

from tests.oracle_check import compare, duck

SF = "/root/testdata/sf0.001"
NAMES = ["x_columns", "x_part_columns", "x_definition", "col_diff", "def_diff",
         "change_flags", "table_status", "version_intervals", "change_report",
         "deleted_alert", "alert_outbox", "drift_report"]


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle(spark, con, name):
    import __spark_entry__ as entry
    ok, msg, _ = compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert ok, msg


def test_entry_runs(spark):
    import __spark_entry__ as entry
    df = entry.entry(spark)
    assert df.columns == ["db", "tbl", "v", "n_added", "n_deleted", "n_changed", "n_attr"]
    assert df.count() > 0
