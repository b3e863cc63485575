import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from brute import DOCUMENTS


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls, blanks, a very long text, repeated rows, and columns named like results."""
    rows = [(i, t, None, "src", 0.5, True, i, "x") for i, t in DOCUMENTS]
    return spark.createDataFrame(
        rows,
        "doc_id long, text string, lang string, source string, score double, kept boolean, component_id long, token string",
    )


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.limit(0)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}
