"""Every query with SQL against DuckDB on the smallest tables; the others must at least return rows."""

import pytest

import __spark_entry__ as entry
from tools.compare import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_matches_sql(spark, con, name):
    ok, rows, message, _ = compare(spark, con, name, SF)
    assert ok, message
    assert rows >= 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    out = entry.entry(spark)
    assert out.columns == ["metacell", "bin1", "bin2", "value"]
    assert out.count() == 400
