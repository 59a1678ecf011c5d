"""Every registered query against its SQL, or at least that it runs and keeps its schema."""

import pytest
from factweir.plans import registry

from tests.oracle import connection, same

Q, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con(data):
    return connection(data)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, data, con, name):
    same(Q[name](spark, data), con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(Q) - set(SQL)))
def test_runs(spark, data, name):
    assert Q[name](spark, data).count() > 0


def test_entry_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
