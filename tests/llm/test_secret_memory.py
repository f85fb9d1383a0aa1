"""What the secrets stage hands to Python, how often it searches texts, and candidates far apart or side by side."""

from __future__ import annotations

import random

import pytest
from llm_samples import prose

pytest.importorskip("quarrylens.llm")

from pyspark.sql import functions as F  # noqa: E402

from quarrylens.llm import common, secrets  # noqa: E402

LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture(scope="module")
def texts():
    """Long texts, most without a candidate; ends of 47 to 97 code points between two candidates, and neighbours."""
    draw = random.Random(8)
    key = lambda: draw.randbytes(20).hex()
    made = [(k, "é word " * 3000, "p") for k in range(20)]
    made += [(20 + k, f"{'é wo ' * 2000}{key()}{' word' * 2000} token = \"{key()}\" {key()} end", "p") for k in range(5)]
    made += [(30 + n, f"{key()} {'ü ' * (n // 2)}{'.' * (n % 2)} {key()}", None) for n in (0, 1, 45, 46, 47, 48, 93, 94, 95, 96, 97, 98)]
    return [*made, (150, None, "p"), (151, "", "p"), (152, "é" * 10_000, "p"), (30, made[25][1], None)]


@pytest.fixture
def handed(spark, monkeypatch):
    """Every frame that goes to Python, and the session's limit of bytes at that time."""
    seen, kind = [], type(spark.range(1))
    old = kind.mapInArrow

    def told(self, *args, **named):
        seen.append((self, self.sparkSession.conf.get(LIMIT)))
        return old(self, *args, **named)

    monkeypatch.setattr(kind, "mapInArrow", told)
    return seen


def test_python_gets_no_whole_text(spark, texts, handed):
    docs = spark.createDataFrame(texts, "doc_id long, text string, source string")
    found = secrets.candidates(docs, secrets.dictionary(docs)).collect()
    said = {(k, t) for k, t, _ in texts}
    for r in found:
        assert any(t[r.begin:r.begin + len(r.value)] == r.value and t[max(0, r.begin - secrets.AROUND):r.begin] == r.before
                   for k, t in said if k == r.doc_id and t)
    assert len(found) == 5 * 3 + 13 * 2
    sent = handed[-1][0]
    assert sent.count() == 18 and sent.agg(F.max(F.length(F.to_json(F.struct("gaps", "values"))))).first()[0] < 1000


def test_features_are_those_of_the_whole_text(spark, texts):
    docs = spark.createDataFrame(texts, "doc_id long, text string, source string")
    known = secrets.dictionary(docs)
    for r in secrets.candidates(docs.where("doc_id <> 30"), known).collect():
        text, path = next((t, p or "") for k, t, p in texts if k == r.doc_id)
        end = r.begin + len(r.value)
        assert r.features == secrets.features(r.value, r.before, text[end:end + secrets.AROUND], path, known)


def test_texts_go_to_python_in_small_batches(spark, texts, handed):
    docs = spark.createDataFrame(texts, "doc_id long, text string, source string")
    before = spark.conf.get(LIMIT)
    secrets.scan(docs).count()
    assert len(handed) == 2 and {limit for _, limit in handed} == {str(common.BATCH)}
    with pytest.raises(KeyError), common.small_batches(spark, 5):
        raise KeyError
    assert spark.conf.get(LIMIT) == before


def test_texts_without_secrets_are_not_searched_again(spark, texts):
    docs = spark.createDataFrame([*texts, texts[20]], "doc_id long, text string, source string")
    findings = spark.createDataFrame([("x" * 16, True), (texts[20][1][10000:10040], True), ("y" * 16, False)], "value string, secret boolean")
    masked = secrets.redacted(docs, findings)
    want = [(k, t.replace(texts[20][1][10000:10040], secrets.MASK) if k == 20 else t, p) for k, t, p in [*texts, texts[20]]]
    assert sorted(map(repr, map(tuple, masked.collect()))) == sorted(map(repr, want))
    plain = masked._jdf.queryExecution().optimizedPlan().children().head().toString()
    assert "BEGIN" not in plain
