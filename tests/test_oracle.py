"""Every registered query against its DuckDB SQL, on the smallest tables."""

import pytest

import __spark_entry__ as spark_entry
from check import difference, tables, type_difference
from lexiframe.plans import catalog

QUERIES, ORACLE = catalog.QUERIES, catalog.ORACLE


@pytest.fixture(scope="module")
def con(small):
    return tables(small)


def test_names_agree():
    assert set(ORACLE) == set(QUERIES)
    assert set(QUERIES) <= set(spark_entry.queries())
    assert set(spark_entry.oracle_sql()) <= set(spark_entry.queries())


def test_entry(spark):
    assert spark_entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, small, name):
    got = QUERIES[name](spark, small)
    rows = got.toPandas()
    want = con.sql(ORACLE[name])
    assert type_difference(got, want) is None
    assert difference(rows, want.df()) is None
