import os

import pytest

DATA = os.environ.get("RASTERLOOM_TESTDATA", "/root/testdata/sf0.001")
LARGEST = os.environ.get("RASTERLOOM_TESTDATA_LARGEST", "/root/testdata/sf0.1")
LARGER = os.environ.get("RASTERLOOM_TESTDATA_LARGER", "/root/testdata/sf0.01")


@pytest.fixture(scope="session")
def sf_dir():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    return DATA


@pytest.fixture(scope="session")
def larger_dir():
    if not os.path.isdir(LARGER):
        pytest.skip("no test tables")
    return LARGER


@pytest.fixture(scope="session")
def docs_of(spark):
    """Rows of (doc_id, text) to a table like ``documents``, with more columns whose names could clash."""

    def make(rows, **more):
        full = [(d, t, None, "web", None if t is None else len(t), 1, "x", None, 0.5) for d, t in rows]
        names = "doc_id bigint, text string, lang string, source string, n_chars bigint, n bigint, bucket string, fp bigint, score double"
        return spark.createDataFrame(full, names)

    return make


#: Nulls in any column, empty and blank texts, ties, repeated rows, one very long text.
ODD = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "one two"), (6, "one two three"), (6, "one two three"), (None, "a row without id"),
    (None, None), (7, "ÄÖ ß ﬁ 漢字 é é \U0001f600 mail a@b.co"), (8, "word " * 50_000), (9, "one two three"), (-3, "negative id."), (10, "x" * 30_000),
]


@pytest.fixture
def odd(docs_of):
    return docs_of(ODD)


@pytest.fixture
def empty(docs_of):
    return docs_of([])


@pytest.fixture(scope="session")
def largest_dir():
    if not os.path.isdir(LARGEST):
        pytest.skip("no test tables")
    return LARGEST
