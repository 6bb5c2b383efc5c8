"""The training-data queries over the small tables, over empty ones, and against SQL or plain Python."""

import os

import pytest
from oracle import connect, empty_copies, rows

from waymark.llm import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return empty_copies(spark, SF, tmp_path_factory.mktemp("empty"))


NAMES = sorted(catalog.QUERIES)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    if name in catalog.SQL:
        assert rows(got) == rows(connect(SF).execute(catalog.SQL[name]).df())
    else:
        assert got.columns.is_unique and not got.duplicated(subset=[c for c in got if got[c].dtype != object or got[c].map(type).ne(list).all()]).any()


@pytest.mark.parametrize("name", NAMES)
def test_empty(spark, empty, name):
    catalog.QUERIES[name](spark, empty).collect()
