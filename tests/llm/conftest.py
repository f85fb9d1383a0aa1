from __future__ import annotations

import pytest
from llm_samples import edited, prose

@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, gaps only, one word, repeated rows, control characters, a long text without a break."""
    long = prose(1, 400)
    return [None, "", " \t\n ", "one", long, long, "a b   c", "\U0001f600 end", "x" * 3000, "12345 !!! ???", "Ünï cödé Wörds"]


DOCS = "doc_id long, text string, lang string, source string, n_chars long, value string, `set` int, region int"


@pytest.fixture(scope="session")
def documents(spark, odd_texts):
    """Documents with extra columns whose names operators might use themselves."""
    texts = [*odd_texts, *(prose(k, 60 + 7 * k) for k in range(10, 30))]
    texts += [edited(texts[20], k, 0.01) for k in range(5)]
    rows = [(k, t, ("en", "de", None)[k % 3], (None, "a", "b", "a")[k % 4], None if t is None else len(t), "v", 1, 2) for k, t in enumerate(texts)]
    rows.append(rows[25])
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module", autouse=True)
def nothing_kept(spark):
    """Frames that the tests of a module keep in the cache go with it; others look whether an operator has left one."""
    yield
    spark.catalog.clearCache()
