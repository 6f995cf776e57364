"""Every query of the engine against its SQL on the smallest tables."""

import pytest
from compare import connection, differences

from quillon import queries as engine

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connection(FOLDER)


@pytest.mark.parametrize("name", sorted(engine.oracle_sql()))
def test_query_equals_its_sql(spark, con, name):
    assert differences(engine.queries()[name](spark, FOLDER), con, engine.oracle_sql()[name]) == []


@pytest.mark.parametrize("name", sorted(set(engine.queries()) - set(engine.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    engine.queries()[name](spark, FOLDER).count()


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["t", "day", "ic", "n"]
    assert set(engine.oracle_sql()) <= set(entry.oracle_sql()) <= set(entry.queries())
