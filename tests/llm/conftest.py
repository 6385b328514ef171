import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from conftest_llm import DOCS  # noqa: E402


@pytest.fixture
def make_docs(spark):
    """Documents from (doc_id, text) pairs, with columns whose names clash with results."""

    def make(rows):
        data = [(i, t, None, "s", len(t or ""), 7.5, "x") for i, t in rows]
        return spark.createDataFrame(data, DOCS + ", score double, spans string").repartition(3)

    return make
