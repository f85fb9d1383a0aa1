"""Exact stratified parts: sizes whatever the keys, the smallest order numbers, equal rows by weight."""

from __future__ import annotations

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from quarrylens.operators import models
from quarrylens.scale import parts


def _rows(df, order):
    return df.select("*", F.col("c").alias(parts.STRATUM), order.alias(parts.FIRST), parts.row_order([df[c] for c in df.columns], 7).alias(parts.SECOND))


def _sizes(df):
    return {r[0]: (r[1], r[2]) for r in df.groupBy("c").agg(F.sum(parts.TRAIN), F.sum(parts.TEST)).collect()}


@pytest.fixture(scope="module")
def classes(spark):
    return spark.range(2003).selectExpr("id", "id % 17 AS few", "element_at(array('a', 'b', 'c'), int(if(id % 10 < 6, 1, if(id % 10 < 9, 2, 3)))) AS c")


@pytest.mark.parametrize("key", ["id", "few", "c"])
def test_every_stratum_holds_out_exactly_its_share(classes, key):
    counts = {r[0]: r[1] for r in classes.groupBy("c").count().collect()}
    wanted = {c: math.ceil(n / 4) for c, n in counts.items()}
    got, weighted = parts.exact_parts(_rows(classes, parts.key_order([F.col(key)])), wanted)
    assert _sizes(got) == {c: (n - wanted[c], wanted[c]) for c, n in counts.items()}
    assert not weighted and got.count() == classes.count()


def test_held_rows_are_those_of_the_smallest_digest(classes):
    counts = {r[0]: r[1] for r in classes.groupBy("c").count().collect()}
    got, _ = parts.exact_parts(_rows(classes, parts.key_order([F.col("id")])), {c: n // 3 for c, n in counts.items()})
    held = {(r.c, r.id) for r in got.where(F.col(parts.TEST) == 1).collect()}
    order = sorted((int(hashlib.md5(str(r.id).encode()).hexdigest()[:15], 16), r.c, r.id) for r in classes.collect())
    want, left = set(), {c: n // 3 for c, n in counts.items()}
    for _, c, i in order:
        if left[c]:
            left[c] -= 1
            want.add((c, i))
    assert held == want


def test_equal_rows_are_parted_by_weight(spark):
    rows = spark.createDataFrame([("a", 1)] * 41 + [("b", 2)] * 7 + [("b", 3)] * 2, "c string, x int")
    got, weighted = parts.exact_parts(_rows(rows, F.lit(5).cast("bigint")), {"a": 11, "b": 3})
    assert weighted and _sizes(got) == {"a": (30, 11), "b": (6, 3)}
    nothing, weighted = parts.exact_parts(_rows(rows, F.lit(5).cast("bigint")), {"a": 0, "b": 0})
    assert not weighted and _sizes(nothing) == {"a": (41, 0), "b": (9, 0)}
    assert parts.exact_parts(_rows(rows.where("false"), F.lit(5).cast("bigint")), {})[0].count() == 0
    with pytest.raises(ValueError, match="strata"):
        parts.exact_parts(_rows(rows, F.lit(5).cast("bigint")), {str(k): 1 for k in range(1001)})


def test_models_hold_out_a_quarter(spark):
    df = spark.range(203).selectExpr("id", "double(id % 29) AS x", "if(id % 29 < 14, 'low', 'high') AS c", "3.0 * (id % 29) + 5 AS y")
    counts = {r[0]: r[1] for r in df.groupBy("c").count().collect()}
    held = sum(math.ceil(n / 4) for n in counts.values())
    row = models.train_classifier(df.drop("id"), ["x"], "c").first()  # 29 different rows, each seven times
    assert (row["rows"], row["test_rows"], row["train_rows"]) == (203, held, 203 - held) and row["accuracy"] > 0.9
    line = models.train_regression(df.drop("id"), ["x"], "y").first()
    assert (line["rows"], line["test_rows"]) == (203, 51)
    assert line["r2"] == pytest.approx(1.0) and line["coefficients"]["x"] == pytest.approx(3.0)
    one = models.train_regression(df.selectExpr("1.0 AS x", "if(id < 100, 1.0, 2.0) AS y"), ["x"], "y").first()
    assert one["test_rows"] == 51 and one["rows"] == 203


def test_three_classes_have_scores_of_the_confusion_table():
    scores = models._scores({(0, 0): 5, (0, 1): 1, (1, 1): 2, (1, 0): 2, (2, 0): 1}, 3)
    assert scores["accuracy"] == pytest.approx(7 / 11) and scores["recall"] == pytest.approx(7 / 11)
    assert scores["precision"] == pytest.approx(6 / 11 * 5 / 8 + 4 / 11 * 2 / 3)
    assert scores["f1"] == pytest.approx(6 / 11 * (10 / 14) + 4 / 11 * (4 / 7))
