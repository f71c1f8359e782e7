"""Every registered query against its SQL on the smallest tables."""

import pytest

from rxnframe.plans import registry
from tests.compare import assert_same, connect

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, small, con, name):
    assert_same(QUERIES[name](spark, small), con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert {r.r_class for r in entry.entry(spark).collect()} == {"T1", "T2", "T3", "T4", "T5"}
    assert set(entry.oracle_sql()) <= set(entry.queries())
