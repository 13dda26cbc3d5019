import pytest
from oracle import connect, duck_rows, spark_rows

import __spark_entry__ as entry

QUERIES, SQL = entry.core_queries(), entry.core_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equals_sql(spark, con, sf_dir, name):
    got = spark_rows(QUERIES[name](spark, sf_dir))
    assert got == duck_rows(con, SQL[name])
    assert got[1]


def test_entry(spark):
    assert entry.entry(spark).columns == ["domain_id", "n"]
