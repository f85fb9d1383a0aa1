"""Quality rules: counts of plain faults, and a calibrated logistic regression on hashed word and character n-grams.

Every document is a bag of hashed n-grams (words, word pairs, and byte 4-grams inside words), each kind scaled to sum to
one. A logistic regression learns from labelled rows; its margin is turned into a probability by a second regression on
labelled rows it has not seen. Documents are scored in Arrow batches: the mean weight of their n-grams, no per-document
dictionary.

Edge cases: a null or empty text has no words, fails the base rules and is scored like a bag without n-grams. Repeated rows
are answered alike, each once. Labels that are null or whose document is missing are not used; labels of one class only, or
none, leave the method without a verdict (probability null), and the base rules alone decide. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.llm.kernels import IS_GAP, Block, apart, blocks, shingles
from quarrylens.llm.languages import _arrow

#: Buckets of each kind of n-gram.
BUCKETS = 1 << 13
KINDS = 3
#: Labelled rows used at most (chosen by a hash of their key), and the share of them kept for calibration.
TRAIN_ROWS, CALIBRATION_SHARE = 8_000, 0.25
REGULAR, STEPS = 2e-4, 60
#: A document is kept from this probability of good quality on.
THRESHOLD = 0.5
MIN_WORDS, MOST_REPEATED_PERCENT = 50, 50

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


@dataclass(frozen=True)
class Scorer:
    """Weights by kind and bucket, the intercept, and slope and intercept of the calibration."""

    weights: np.ndarray
    intercept: float
    slope: float
    shift: float


def _ngrams(block: Block) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each kind: the buckets of a block's n-grams and their documents, in order of document."""
    starts, ends, doc = block.words()
    h = block.hashes(starts, ends)
    pair, pair_doc = shingles(h, doc, 2)
    b = block.data.astype(np.uint32)
    gram = (b[:-3] | b[1:-2] << 8 | b[2:-1] << 16 | b[3:] << 24) * np.uint32(2654435761) if len(b) > 3 else b[:0]
    byte_doc = np.repeat(np.arange(block.n), np.diff(block.offsets))
    gap = IS_GAP[block.data]
    same = byte_doc[:-3] == byte_doc[3:] if len(b) > 3 else np.zeros(0, bool)
    same &= ~gap[1:len(gram) + 1]
    top = np.uint64(64 - 13)
    return [((h >> top).astype(np.int64), doc), ((pair >> top).astype(np.int64), pair_doc),
            ((gram[same] >> np.uint32(32 - 13)).astype(np.int64), byte_doc[:-3][same] if len(b) > 3 else byte_doc[:0])]


def base_counts(block: Block) -> dict[str, np.ndarray]:
    starts, ends, doc = block.words()
    n_words = np.bincount(doc, minlength=block.n)
    inside = ~IS_GAP[block.data]
    h = block.hashes(starts, ends)
    # words in 3-word windows that occur twice or more
    repeated = np.zeros(len(starts), bool)
    if len(h) > 2:
        at = np.flatnonzero(doc[:-2] == doc[2:])
        window, _ = shingles(h, doc, 3)
        window = apart(window, doc[at])
        order = np.argsort(window)
        equal = window[order][1:] == window[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][equal]] = True
        twice[order[:-1][equal]] = True
        for k in range(3):
            repeated[at[twice] + k] = True
    # lines with a word that equal an earlier one
    begin, end, line_doc = block.runs(block.data != 0x0A)
    words_before = np.concatenate([[0], np.cumsum(inside, dtype=np.int64)])
    full = words_before[end] > words_before[begin]
    mine = apart(block.hashes(begin[full], end[full]), line_doc[full])
    n_lines = np.bincount(line_doc[full], minlength=block.n)
    _, kept = np.unique(mine, return_index=True)
    distinct = np.bincount(line_doc[full][kept], minlength=block.n)
    return {"n_words": n_words, "word_chars": block.total(inside & (block.data & 0xC0 != 0x80)),
            "n_symbols": block.total(_SYMBOL[block.data]), "n_dup_lines": n_lines - distinct,
            "n_repeat_words": np.bincount(doc[repeated], minlength=block.n)}


def _bag(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Features of each text as a sparse vector."""
    from pyspark.ml.linalg import Vectors, VectorUDT

    rows = docs.select(F.col(key).alias(key), F.col(text).cast("string").alias("text"), "__label", "__part")
    kinds = rows.schema[key].dataType.simpleString()
    schema = pa.schema([(key, _arrow(rows, key)), ("label", pa.float64()), ("part", pa.string()),
                        ("at", pa.list_(pa.int32())), ("value", pa.list_(pa.float64()))])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                found = _ngrams(block)
                ends = [np.searchsorted(doc, np.arange(block.n + 1)) for _, doc in found]
                at, value = [], []
                for d in range(block.n):
                    places, weights = [], []
                    for kind, (bucket, _) in enumerate(found):
                        own, times = np.unique(bucket[ends[kind][d]:ends[kind][d + 1]], return_counts=True)
                        places.append(own + kind * BUCKETS)
                        weights.append(times / max(1, times.sum()))
                    at.append(np.concatenate(places).astype(np.int32))
                    value.append(np.concatenate(weights))
                part = batch.slice(block.row, block.n)
                yield pa.record_batch([part.column(0), part.column(2), part.column(3), pa.array(at, pa.list_(pa.int32())),
                                       pa.array(value, pa.list_(pa.float64()))], schema=schema)

    bags = rows.mapInArrow(count, f"`{key}` {kinds}, label double, part string, at array<int>, value array<double>")
    vector = F.udf(lambda at, value: Vectors.sparse(KINDS * BUCKETS, at, value), VectorUDT())
    return bags.select("label", "part", vector("at", "value").alias("features"))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
          most_rows: int = TRAIN_ROWS) -> Scorer | None:
    """Fit on at most ``most_rows`` labelled rows, chosen by a hash of their key; None where a class is missing."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import DenseVector

    chosen = (labels.where(F.col(label).isin(0, 1)).select(F.col(key).alias("__key"), F.col(label).cast("double").alias("__label"))
              .where("__key is not null").orderBy(F.xxhash64("__key"), "__key", "__label").limit(most_rows))
    share = int(CALIBRATION_SHARE * 1000)
    chosen = chosen.withColumn("__part", F.when(F.pmod(F.xxhash64("__key", F.lit(7)), F.lit(1000)) < share, "calibrate").otherwise("fit"))
    bags = _bag(docs.join(F.broadcast(chosen), docs[key] == F.col("__key")), key, text).persist()
    seen = {(r.part, r.label) for r in bags.select("part", "label").distinct().collect()}
    if len({y for part, y in seen if part == "fit"}) < 2:
        bags.unpersist()
        return None
    fit = LogisticRegression(regParam=REGULAR, maxIter=STEPS, standardization=True, probabilityCol="p").fit(bags.where("part = 'fit'"))
    slope, shift = 1.0, 0.0
    if len(seen) == 4:
        from pyspark.ml.functions import vector_to_array

        margins = fit.transform(bags.where("part = 'calibrate'")).select("label", vector_to_array("rawPrediction")[1].alias("m"))
        vector = F.udf(lambda m: DenseVector([m]), bags.schema["features"].dataType)
        second = LogisticRegression(regParam=1e-3, maxIter=50).fit(margins.select("label", vector("m").alias("features")))
        if second.coefficients[0] > 0:
            slope, shift = float(second.coefficients[0]), float(second.intercept)
    bags.unpersist()
    return Scorer(fit.coefficients.toArray().reshape(KINDS, BUCKETS), float(fit.intercept), slope, shift)


def score(docs: DataFrame, scorer: Scorer | None, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``(key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, probability, kept)`` for every row."""
    sent = docs.sparkSession.sparkContext.broadcast(scorer)  # KINDS * BUCKETS numbers
    rows = docs.select(F.col(key).alias(key), F.col(text).cast("string").alias("text"))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    schema = pa.schema([(key, _arrow(rows, key)), *[(c, pa.int64()) for c in counts], ("probability", pa.float64())])

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            for block in blocks(batch.column(1)):
                found = base_counts(block)
                if model is None:
                    p = pa.nulls(block.n, pa.float64())
                else:
                    margin = np.full(block.n, model.intercept)
                    for kind, (bucket, doc) in enumerate(_ngrams(block)):
                        n = np.bincount(doc, minlength=block.n)
                        margin += np.bincount(doc, model.weights[kind][bucket], block.n) / np.maximum(n, 1)
                    p = pa.array(1 / (1 + np.exp(-np.clip(model.slope * margin + model.shift, -500, 500))))
                yield pa.record_batch([batch.column(0).slice(block.row, block.n),
                                       *[pa.array(found[c].astype(np.int64)) for c in counts], p], schema=schema)

    rated = rows.mapInArrow(rate, f"`{key}` {rows.schema[key].dataType.simpleString()}, "
                            + ", ".join(f"{c} long" for c in counts) + ", probability double")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    return rated.select(key, *counts, failed.alias("base_failed"), "probability",
                        (~failed & F.coalesce(F.col("probability") >= threshold, F.lit(True))).alias("kept"))
