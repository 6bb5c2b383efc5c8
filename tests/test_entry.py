"""Every core query against its SQL, and over empty tables."""

import os

import pytest
from oracle import connect, empty_copies, rows

from waymark.plans import data_problems, reference_queries

SF = "/root/testdata/sf0.001"
QUERIES = data_problems.QUERIES | reference_queries.QUERIES
SQL = data_problems.SQL | reference_queries.SQL

NAMES = sorted(QUERIES)

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return empty_copies(spark, SF, tmp_path_factory.mktemp("empty"))


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in SQL:
        want = duck.execute(SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got)


@pytest.mark.parametrize("name", NAMES)
def test_empty(spark, empty, name):
    QUERIES[name](spark, empty).collect()


def test_entry_has_all():
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(SQL) <= set(__spark_entry__.oracle_sql())
