from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def make(spark):
    """Documents with an extra column and clashing names, from (doc_id, text) pairs."""

    def docs(rows, extra=True):
        schema = "doc_id long, text string" + ", sig long, starts string, label string, head string" * extra
        return spark.createDataFrame([(*r, *([1, "x", "y", "z"] if extra else [])) for r in rows], schema)

    return docs
