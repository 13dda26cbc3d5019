import pytest
from oracle import connect, duck_rows, spark_rows

from gleaner.llm import queries as llm

QUERIES, SQL = llm.queries(), llm.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, sf_dir, name):
    got = spark_rows(QUERIES[name](spark, sf_dir))
    assert got == duck_rows(connect(sf_dir), SQL[name])


def test_one_query_per_operator():
    assert sorted(int(n.split("_")[0][2:]) for n in QUERIES) == list(range(1, 14))
