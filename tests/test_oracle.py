"""Every registered query against its DuckDB oracle on the smallest test data."""

import pytest

import __spark_entry__ as E
from bridgelens import catalog
from tools.check_oracle import compare, duck_connect

SF = "/root/testdata/sf0.001"
KEYS = sorted(catalog.queries())


@pytest.fixture(scope="module")
def con():
    return duck_connect(SF)


def test_every_query_has_an_oracle():
    assert set(KEYS) <= set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", KEYS)
def test_query_matches_oracle(spark, con, name):
    ok, n, _, detail = compare(spark, con, name, E.queries()[name], E.oracle_sql()[name], SF)
    assert ok, detail


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns[0] == "date"
