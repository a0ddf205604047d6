"""Every query with a SQL statement must match DuckDB on the same tables."""

import pytest

import __spark_entry__ as E
from paths import SF_SMALL
from oracle_check import check

ORACLE_NAMES = sorted(E.oracle_sql())


@pytest.mark.parametrize("name", ORACLE_NAMES)
def test_matches_duckdb(spark, name):
    res = check(spark, SF_SMALL, [name], verbose=False)[name]
    assert res[0] == "OK", res


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["split", "row", "precision", "recall", "f1", "support"]
