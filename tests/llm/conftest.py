from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from llm_helpers import DOCS, edge_rows  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(edge_rows(), DOCS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def given(spark):
    if not os.path.isdir(SF_DIR):
        pytest.skip("test tables not present")
    return spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text", "source")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame(
        [(4, 1, 0), (4, 0, 0), (7, 1, 0), (12, 0, 0), (None, 1, 0), (99, 1, 0)],
        "doc_id long, quality int, toxic int",
    )
