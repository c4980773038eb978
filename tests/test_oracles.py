import pytest

import check
from askframe.plans import oracles, workloads

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return check.database(SF)


def test_every_query_has_sql():
    assert set(oracles.SQL) == set(workloads.QUERIES)


@pytest.mark.parametrize("name", list(workloads.QUERIES))
def test_query_matches_sql(spark, db, name):
    problem, _, _ = check.compare(spark, db, SF, name, workloads.QUERIES[name], oracles.SQL.get(name))
    assert problem is None, problem


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
