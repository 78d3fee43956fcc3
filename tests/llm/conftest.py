"""Small tables with the hard cases: nulls, empty and long texts, ties, repeated rows, clashing names."""

import os

import pytest

DATA = os.environ.get("TRIALMILL_DATA", "/root/testdata/sf0.001")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def data():
    if not os.path.isdir(DATA):
        pytest.skip("needs the given tables")
    return DATA


@pytest.fixture
def docs(spark):
    """Makes documents from (doc_id, text, source) rows, with columns whose names operators use themselves."""

    def make(rows):
        full = [(i, t, "en", s, None, 1.5, "x", [1], "y") for i, t, s in rows]
        return spark.createDataFrame(full, DOCS + ", score double, template string, ids array<int>, bucket string")

    return make
