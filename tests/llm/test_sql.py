import pytest
from sqlcheck import SMALL, assert_same

from loam.llm.queries import oracle_sql, queries


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_gives_what_its_sql_gives(spark, name):
    assert_same(queries()[name](spark, SMALL), oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_query_without_sql_runs_alike_twice(spark, name):
    first, again = queries()[name](spark, SMALL), queries()[name](spark, SMALL)
    rows = sorted(map(str, first.collect()))
    assert rows == sorted(map(str, again.collect()))


def test_ten_operators_have_one_query_each():
    assert sorted(int(n[2:].split("_")[0]) for n in queries() if n.startswith("op")) == list(range(1, 11))
