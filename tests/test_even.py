"""Even cells, running sums over them, and counts of opposite pairs."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarrylens import AnalysisError
from quarrylens.operators import correlation, timeseries
from quarrylens.scale import even, inversions


def _cell_sizes(df, cuts):
    return [r["n"] for r in even.with_even_cell(df, "k", "v", cuts).groupBy("k", even.CELL).agg(F.count("*").alias("n")).collect()]


def test_a_far_value_crowds_no_cell(spark):
    far = spark.range(200_000).selectExpr("0 AS k", "double(xxhash64(id)) / 9e18 AS v").union(spark.sql("SELECT 0, 1e12D"))
    sizes = _cell_sizes(far, even.even_cuts(far, "k", "v"))
    assert sum(sizes) == 200_001 and len(sizes) > 400 and max(sizes) <= 2 * 200_001 / even.CELLS


def test_full_cells_are_cut_again(spark):
    rows = spark.range(30_000).selectExpr("int(id % 2) AS k", "if(id % 3 = 0, 7D, exp(double(xxhash64(id)) / 1e18)) AS v")
    cuts = even.even_cuts(rows, "k", "v", cells=8, most_rows=100)
    celled = even.with_even_cell(rows, "k", "v", cuts)
    full = celled.groupBy("k", even.CELL).agg(F.count("*").alias("n"), F.countDistinct("v").alias("values")).where("n > 100 and values > 1")
    assert full.isEmpty()
    order = celled.groupBy("k", even.CELL).agg(F.min("v").alias("a"), F.max("v").alias("b")).toPandas().sort_values(["k", even.CELL])
    for _, cells in order.groupby("k"):
        assert (cells["a"].to_numpy()[1:] > cells["b"].to_numpy()[:-1]).all()


def test_running_sums_with_equal_orders(spark):
    rows = spark.createDataFrame([(0, float(v), v, w) for v, w in [(1, 5), (2, 1), (2**53, 2), (2**53 + 1, 3), (9, 4), (9, 4)]], "k int, near double, v long, w long")
    got = even.running_before(rows, "k", "near", {"w": "before"}, order="v", equal="same").collect()
    assert sorted((r["v"], r["before"], r["same"]) for r in got if r["v"] != 9) == [
        (1, 0, False), (2, 5, False), (2**53, 14, False), (2**53 + 1, 16, False)]
    assert sorted((r["before"], r["same"]) for r in got if r["v"] == 9) == [(6, False), (10, True)]
    assert even.running_before(rows.where("false"), "k", "near", {"w": "before"}).count() == 0


def test_equal_positions_are_refused(spark):
    rows = spark.createDataFrame([(k if k < 9 else 5, float(k)) for k in range(10)], "at long, y double")
    with pytest.raises(AnalysisError, match="equal values"):
        timeseries.positional_forecast(rows, "y", "at")


@pytest.mark.parametrize("seed", range(6))
def test_inversions_equal_brute_force(seed):
    rng = np.random.default_rng(seed)
    n = [0, 1, 2, 50, 200, 333][seed]
    x, y = rng.integers(0, 12, n).astype(float), np.round(rng.normal(0, 3, n), seed % 3)
    opposed = int(((x[:, None] < x) & (y[:, None] > y)).sum())
    assert inversions.inversions(x, y) == opposed
    assert inversions.equal_pairs(x, y) == (((x[:, None] == x) & (y[:, None] == y)).sum() - n) / 2
    grid = np.zeros((12, 200), np.int64)
    np.add.at(grid, (x.astype(int), (y + 100).astype(int)), 1)
    small = (y + 100).astype(int)
    assert inversions.opposed_cells(grid) == ((x[:, None] < x) & (small[:, None] > small)).sum()


def _tau(x, y):
    keep = ~(np.isnan(x) | np.isnan(y))
    x, y = x[keep], y[keep]
    a, b = np.sign(x[:, None] - x), np.sign(y[:, None] - y)
    with np.errstate(invalid="ignore"):
        return (a * b).sum() / np.sqrt((a * a).sum() * (b * b).sum())


@pytest.fixture(scope="module")
def columns():
    rng = np.random.default_rng(4)
    n = 900
    base = rng.normal(0, 1, n)
    frame = pd.DataFrame({"a": base, "b": np.where(rng.random(n) < 0.4, 2.0, base + rng.normal(0, 1, n)), "c": rng.integers(0, 3, n).astype(float),
                          "d": np.round(base * 3), "e": np.where(rng.random(n) < 0.9, 0.0, rng.random(n)), "f": rng.normal(0, 1, n)})
    gap = rng.random(n) < 0.2
    frame.loc[gap, ["a", "d"]] = np.nan  # equal gaps
    frame.loc[gap | (rng.random(n) < 0.3), "b"] = np.nan  # gaps that hold those of a
    frame.loc[rng.random(n) < 0.1, "c"] = np.nan
    return pd.concat([frame, frame.iloc[:40]])  # repeated rows


@pytest.mark.parametrize("rows_of_cell", [1 << 16, 3])
def test_rank_correlations_of_many_columns(spark, columns, monkeypatch, rows_of_cell):
    monkeypatch.setattr(correlation, "CELL_ROWS", rows_of_cell)
    df = spark.createDataFrame(columns)
    for method in ("spearman", "kendall"):
        got = {(r["left"], r["right"]): (r["n"], r["r"]) for r in correlation.pair_table(df, None, method).collect()}
        assert len(got) == 15
        for (left, right), (n, r) in got.items():
            both = columns[[left, right]].dropna()
            want = _tau(columns[left].to_numpy(), columns[right].to_numpy()) if method == "kendall" else both.rank().corr().iloc[0, 1]
            assert n == len(both) and r == pytest.approx(want, abs=1e-10), (method, left, right)


def test_columns_without_gaps_share_one_context(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0), (2.0, 1.0, 5.0), (4.0, 4.0, 4.0)], "a double, b double, c double")
    pairs = [(0, 1), (0, 2), (1, 2)]
    contexts = correlation._Contexts(correlation._views(df, ["a", "b", "c"]), pairs)
    assert contexts.pairs == [pairs] and contexts.columns == [[0, 1, 2]] and contexts.rows == [3]


def test_an_empty_column_has_no_rank_correlation(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None)], "a double, b double")
    assert all(r["r"] is None for m in ("spearman", "kendall") for r in correlation.pair_table(df, None, m).collect())
