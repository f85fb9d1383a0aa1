from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from quarrylens import AnalysisError
from quarrylens.operators import correlation


def tau_b(x, y):
    keep = ~(np.isnan(x) | np.isnan(y))
    x, y = x[keep], y[keep]
    a, b = np.sign(x[:, None] - x), np.sign(y[:, None] - y)
    return (a * b).sum() / np.sqrt((a * a).sum() * (b * b).sum())


@pytest.fixture(scope="module")
def gaps():
    rng = np.random.default_rng(6)
    n = 700
    x = rng.integers(0, 12, n).astype(float)
    frame = pd.DataFrame({"x": x, "y": x + rng.normal(0, 4, n), "z": np.where(rng.random(n) < 0.5, 2.0, rng.normal(0, 1, n))})
    frame.loc[rng.random(n) < 0.1, "x"] = np.nan
    frame.loc[rng.random(n) < 0.2, "y"] = np.nan
    return frame


@pytest.mark.parametrize("method", ["pearson", "spearman", "kendall"])
def test_pairs_with_gaps_and_ties(spark, gaps, method):
    got = {(r["left"], r["right"]): r["r"] for r in
           correlation.pair_table(spark.createDataFrame(gaps), None, method).collect()}
    for (left, right), r in got.items():
        both = gaps[[left, right]].dropna()
        want = (tau_b(gaps[left].to_numpy(), gaps[right].to_numpy()) if method == "kendall"
                else (both.rank() if method == "spearman" else both).corr().iloc[0, 1])
        assert r == pytest.approx(want, abs=1e-10)
    assert len(got) == 3


def test_hot_values_in_ranks(spark, monkeypatch):
    from quarrylens.scale import lookups

    monkeypatch.setattr(lookups, "HOT_SHARE", 3)
    rng = np.random.default_rng(8)
    frame = pd.DataFrame({"a": np.where(rng.random(500) < 0.5, 1.0, rng.random(500)),
                          "b": np.where(rng.random(500) < 0.6, 2.0, rng.random(500))})
    df = spark.createDataFrame(frame)
    assert correlation.pair_table(df, None, "spearman").first()["r"] == pytest.approx(frame.rank().corr().iloc[0, 1], abs=1e-10)
    assert correlation.pair_table(df, None, "kendall").first()["r"] == pytest.approx(
        tau_b(frame["a"].to_numpy(), frame["b"].to_numpy()), abs=1e-10)


@pytest.mark.parametrize("method", ["pearson", "spearman", "kendall"])
def test_constant_column_is_undefined(spark, method):
    df = spark.createDataFrame([(1.0, 0.1), (2.0, 0.1), (4.0, 0.1)], "a double, b double")
    assert correlation.pair_table(df, None, method).first()["r"] is None
    matrix = {(r["left"], r["right"]): r["r"] for r in correlation.correlation_matrix(df, None, method).collect()}
    assert matrix[("a", "a")] == 1.0 and matrix[("b", "b")] is None and len(matrix) == 4


def test_errors(spark, sample):
    with pytest.raises(AnalysisError, match="Unsupported"):
        correlation.pair_table(sample, None, "voodoo")
    with pytest.raises(AnalysisError, match="one and the same"):
        correlation.pair_correlation(sample, "units", "units")
    with pytest.raises(AnalysisError, match="too few"):
        correlation.pair_correlation(sample.limit(2), "units", "revenue")
    with pytest.raises(AnalysisError, match="constant"):
        correlation.pair_correlation(spark.createDataFrame([(1, 2), (1, 3), (1, 4)], "a int, b int"), "a", "b")
    with pytest.raises(AnalysisError, match="at least two"):
        correlation.correlation_survey(sample.select("units"))


def test_infinities_are_left_out(wild):
    row = correlation.pair_table(wild).first()
    assert row["n"] == 2 and row["r"] == pytest.approx(1.0)


def test_leakage(rich):
    found = {r["feature"]: r["leaked"] for r in
             correlation.leakage_screen(rich.withColumn("revenue_usd", rich["revenue"] * 1.09), "revenue").collect()}
    assert found == {"units": False, "price": False, "revenue_usd": True}


def test_wide_matrix(rich):
    wide = rich.select("*", *[(rich["units"] * (i + 1)).alias(f"extra_{i}") for i in range(15)])
    assert correlation.correlation_matrix(wide).count() == 18 * 18
