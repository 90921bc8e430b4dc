"""Every registered query vs its DuckDB oracle at sf0.001 (the driver's gate, locally)."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import __spark_entry__ as E  # noqa: E402
from oracle_check import compare, duck  # noqa: E402

SF = "/root/testdata/sf0.001"
SQL = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("key", sorted(SQL))
def test_query_matches_oracle(spark, con, key):
    r = compare(spark, con, key, E.queries()[key], SQL[key], SF)
    assert r["cols_equal"], r
    assert r["spark_rows"] == r["oracle_rows"], r
    assert r["match"], r


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "role" in df.columns
