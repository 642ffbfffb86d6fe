"""Every registered query against its SQL on DuckDB, over the smallest tables."""

from __future__ import annotations

import os

import pytest
from check import compare, connect

from tidegrid.catalog import all_queries

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not present")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query(spark, con, name):
    query = all_queries()[name]
    df = query.run(spark, SF_DIR)
    if query.sql is None:
        assert df.count() > 0
    else:
        assert compare(df, query.sql, con) is None
