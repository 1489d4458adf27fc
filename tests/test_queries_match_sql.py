import pytest

from passagework.plans import registry

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(name, same_as_sql):
    same_as_sql(registry.queries()[name], SQL[name])


def test_every_sql_has_its_query():
    assert set(SQL) <= set(registry.queries())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_rows_only(name, spark):
    assert registry.queries()[name](spark, "/root/testdata/sf0.001").count() > 0
