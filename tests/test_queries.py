"""Every core query with a SQL twin gives the same rows as DuckDB; every other one runs."""

import os

import pytest
from oracle import compare, connect

from thicket.plans import catalog

FOLDER = "/root/testdata/sf0.001"
#: Queries that these small tables give no row for; their operators are tested on made-up rows.
EMPTY = {"q_kmeans", "q_soft_entries"}
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_as_sql(spark, con, name):
    compare(catalog.QUERIES[name](spark, FOLDER), con, catalog.SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, name):
    rows = catalog.QUERIES[name](spark, FOLDER).count()
    assert (rows == 0) == (name in EMPTY)


def test_every_sql_has_a_query():
    assert set(catalog.SQL) <= set(catalog.QUERIES)
