from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarrylens import AnalysisError
from quarrylens.operators import features


def column(df, name):
    return [row[name] for row in df.select(name).collect()]


@pytest.fixture(scope="module")
def numbers(spark):
    return spark.createDataFrame([(7, -3.0, 2), (-7, 3.0, 0), (5, None, 1)], "a int, b double, c int")


@pytest.mark.parametrize("formula, want", [
    ("a + c * 2 - 1", [10, -8, 6]), ("a / c", [3.5, None, 5.0]), ("a % b", [-2.0, 2.0, None]), ("a % c", [1, None, 0]),
    ("-(a) ** 2", [-49.0, -49.0, -25.0]), ("+a", [7, -7, 5]), ("c ** -1", [0.5, math.inf, 1.0]), ("(a + 0.5) * 2", [15.0, -13.0, 11.0])])
def test_formulas(numbers, formula, want):
    assert column(features.calculated_column(numbers, "new", formula), "new") == want


@pytest.mark.parametrize("formula", ["abs(a)", "a.b", "a[0]", "__import__('os')", "a if b else c", "a and b", "a > b", "'x'",
                                     "True", "a +", "lambda: a", "nope + 1", "a // b", "~a", ""])
def test_refused_formulas(numbers, formula):
    with pytest.raises(AnalysisError):
        features.calculated_column(numbers, "new", formula)


def test_names(numbers):
    with pytest.raises(AnalysisError, match="already exists"):
        features.calculated_column(numbers, "a", "b + 1")
    with pytest.raises(AnalysisError, match="usable"):
        features.calculated_column(numbers, "two words", "b + 1")
    with pytest.raises(AnalysisError, match="already exists"):
        features.standardize(numbers, "a", "b")


def test_scaling(rich, rich_pandas, spark):
    p = rich_pandas["price"]
    np.testing.assert_allclose(column(features.standardize(rich, "price"), "price_z"), (p - p.mean()) / p.std(), atol=1e-9)
    np.testing.assert_allclose(column(features.min_max_scale(rich, "price"), "price_scaled"),
                               (p - p.min()) / (p.max() - p.min()), atol=1e-12)
    same = spark.createDataFrame([(4.0,), (4.0,), (None,)], "x double")
    assert column(features.standardize(same, "x"), "x_z") == [0.0, 0.0, None]
    assert column(features.min_max_scale(same, "x"), "x_scaled") == [0.0, 0.0, None]


def test_log(numbers, rich):
    np.testing.assert_allclose(column(features.log_transform(rich, "price"), "price_log"), np.log(column(rich, "price")))
    with pytest.raises(AnalysisError, match="logarithm"):
        features.log_transform(numbers, "a")


@pytest.mark.parametrize("values, bins", [([1, 2, 3, 4, 5.5], 4), ([1, 1, 1, 2, 3, 9], 3), ([0.001, 0.002, 0.0035, 0.7], 2),
                                          ([901.82, 1000, 26881.1525, 104997.88], 3), ([-5, 0, 5, 100, 1e6], 20)])
def test_bins_have_the_labels_of_pandas(spark, values, bins):
    df = features.quantile_bins(spark.createDataFrame([(float(v),) for v in [*values]] + [(None,)], "x double"), "x", bins)
    got = {row["x"]: row["x_bin"] for row in df.collect()}
    want = pd.qcut(pd.Series(values, dtype=float), bins, duplicates="drop").astype(str)
    assert got.pop(None) is None
    assert got == dict(zip(map(float, values), want))


def test_bin_errors(numbers, spark):
    with pytest.raises(AnalysisError, match="between"):
        features.quantile_bins(numbers, "a", 21)
    with pytest.raises(AnalysisError, match="too few"):
        features.quantile_bins(spark.createDataFrame([(1,), (1,)], "x int"), "x")


def test_frequency(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "t string")
    got = sorted(features.frequency_encode(df, "t").collect(), key=str)
    assert [tuple(r) for r in got] == [("a", 2 / 3), ("a", 2 / 3), ("b", 1 / 3), (None, None)]


def test_one_hot(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,)], "t string")
    out = features.transform_feature(df, "t", "one_hot")
    assert out.columns == ["t", "t_a", "t_b"] and [tuple(r)[1:] for r in out.collect()] == [(0, 1), (1, 0), (0, 0)]
    with pytest.raises(AnalysisError, match="40"):
        features.one_hot_encode(spark.range(41).select(F.col("id").cast("string").alias("t")), "t")


def test_date_parts(spark):
    df = spark.createDataFrame([("2024-02-29",), ("03/01/2024",), ("soon",)], "d string")
    out = features.datetime_parts(df, "d")
    assert [tuple(r)[1:] for r in out.collect()] == [(2024, 2, 29, "Thursday"), (2024, 3, 1, "Friday"), (None,) * 4]
    with pytest.raises(AnalysisError, match="parsed"):
        features.datetime_parts(spark.createDataFrame([("soon",)], "d string"), "d")


def test_dispatch_errors(numbers):
    with pytest.raises(AnalysisError, match="Unsupported"):
        features.transform_feature(numbers, "a", "cube")
    with pytest.raises(AnalysisError, match="Unknown column"):
        features.transform_feature(numbers, "z", "log")
