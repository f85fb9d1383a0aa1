from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarrylens.scale import cells, even
from quarrylens.scale.lookups import attach

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]


def _shapes():
    rng = np.random.default_rng(1)
    n = 3000
    return pd.DataFrame({
        "plain": rng.normal(0, 1, n), "tail": rng.pareto(0.5, n), "ties": rng.integers(0, 4, n).astype(float),
        "one": np.full(n, 7.0), "huge": np.where(rng.random(n) < 0.4, 1e300, -1e300) * rng.random(n),
        "hot": np.where(rng.random(n) < 0.6, 3.0, rng.normal(0, 1, n))})


def test_quantiles_of_many_shapes(spark, large_path):
    frame = _shapes()
    got = cells.quantile_values(spark.createDataFrame(frame), list(frame.columns), PROBS)
    for column in frame.columns:
        assert got[column].count == len(frame)
        np.testing.assert_allclose(got[column].q, frame[column].quantile(PROBS), rtol=1e-12)


def test_gaps(spark, wild):
    small = cells.quantile_values(wild, ["x", "y"], [0.25, 0.5])
    assert small["x"].q == [2.0, 3.0] and small["x"].count == 2


def test_no_usable_value(spark, large_path):
    empty = spark.createDataFrame([(None, 1.0)], "a double, b double")
    got = cells.quantile_values(empty, ["a", "b"], [0.5])
    assert got["a"].q == [None] and got["b"].q == [1.0]
    assert cells.quantile_values(empty.select("a"), ["a"], [0.5])["a"].q == [None]


def test_grouped_quantiles_with_a_hot_and_a_null_group(spark, large_path):
    rng = np.random.default_rng(2)
    frame = pd.DataFrame({"g": rng.choice(["hot"] * 8 + ["a", "b", None], 4000), "v": rng.exponential(5, 4000)})
    table = cells.grouped_quantiles(spark.createDataFrame(frame), ["v"], [0.25, 0.5], ["g"])
    got = {row["g"]: row["q"] for row in table.collect()}
    for group, values in frame.groupby("g", dropna=False)["v"]:
        key = None if pd.isna(group) else group
        np.testing.assert_allclose(got[key], values.quantile([0.25, 0.5]), rtol=1e-12)
    assert len(got) == 4


def test_running_before(spark):
    rng = np.random.default_rng(3)
    frame = pd.DataFrame({"k": 0, "v": np.unique(rng.normal(0, 1, 2000)), }).assign(w=lambda d: rng.integers(1, 9, len(d)))
    df = spark.createDataFrame(frame).withColumn("k", F.col("k").cast("int"))
    got = even.running_before(df, "k", "v", {"w": "before"}).toPandas().sort_values("v")
    want = frame["w"].cumsum() - frame["w"]
    assert got["before"].tolist() == want.tolist()


@pytest.mark.parametrize("hot", [0.0, 0.7])
def test_attach_keeps_every_row(spark, hot):
    rng = np.random.default_rng(4)
    keys = np.where(rng.random(5000) < hot, 0, rng.integers(0, 3000, 5000))
    rows = spark.createDataFrame(pd.DataFrame({"key": keys, "i": range(5000)}))
    table = rows.groupBy("key").agg(F.count("*").alias("n"), F.sum("i").alias("s")).where("key % 5 <> 1")
    got = attach(rows, table, ["key"], "n", 5000, ["s"]).toPandas()
    sums = pd.DataFrame({"key": keys, "i": range(5000)}).groupby("key")["i"].sum()
    assert sorted(got["i"]) == list(range(5000))
    for key, s in got[["key", "s"]].drop_duplicates().itertuples(index=False):
        assert pd.isna(s) if key % 5 == 1 else s == sums[key]
