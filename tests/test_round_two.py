"""Values that are easily merged or lost: long keys, long identifiers, overflow, edges, kinds of a variant, null keys."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylens.errors import AnalysisError
from quarrylens.operators import charts, distribution, features, models, quality, timeseries
from quarrylens.scale.lookups import attach
from quarrylens.sources.typing import infer_types

BEYOND = 2**53


def test_order_keys_beyond_doubles(spark):
    df = spark.range(50).select((F.col("id") + BEYOND).alias("at"), F.col("id").cast("double").alias("y"))
    assert timeseries.last_value_forecast(df, "y", "at").first()["forecast"] == 49
    row = timeseries.positional_forecast(df, "y", "at", 1).first()
    assert row["slope"] == pytest.approx(1) and row["forecast"] == pytest.approx(50)


@pytest.mark.parametrize("values, kind", [
    (["1234567890123456789", "1234567890123456788"], "bigint"),
    (["12345678901234567890", "12345678901234567891"], "decimal(38,0)"), (["1" * 40, "1" * 39 + "2"], "string")])
def test_long_identifiers_stay_apart(spark, values, kind):
    got = infer_types(spark.createDataFrame([(v,) for v in values], "a string"))
    assert got.dtypes == [("a", kind)] and got.distinct().count() == 2


def test_overflow_is_null(spark):
    df = spark.createDataFrame([(2,), (2**40,), (None,)], "a long")
    got = [r["c"] for r in features.calculated_column(df, "c", "a * a * a + 1 - 1").collect()]
    assert got == [8, None, None]


@pytest.mark.parametrize("top", [10, 100])
def test_values_on_bin_edges(spark, monkeypatch, top):
    values = [i / 100 for i in range(top + 1)]
    monkeypatch.setattr(distribution, "automatic_bins", lambda s, whole: (s.low, s.high, top))
    df = spark.createDataFrame([(v,) for v in values], "x double")
    table = sorted(distribution.histogram(df, ["x"]).collect(), key=lambda r: r["bin"])
    edges = [0.0 + i * (values[-1] / top) for i in range(top)] + [values[-1]]
    assert [r["count"] for r in table] == np.histogram(values, bins=edges)[0].tolist()


@pytest.mark.parametrize("values, issues", [
    (['{"a": 1}', '{"b": 2}'], []), (["3.5", "12.25"], []), (['"x"', "1"], ["mixed_types"]), (["[1]", '{"a": 1}', None], ["mixed_types"])])
def test_kinds_of_a_variant(spark, values, issues):
    df = spark.createDataFrame([(v,) for v in values], "t string").select(F.parse_json("t").alias("v"))
    assert [r["issue"] for r in quality.datatype_issues(df).collect()] == issues


def test_null_keys_are_kept_without_payload(spark):
    rows = spark.range(1000).select(F.when(F.col("id") % 10 == 0, F.col("id")).alias("k"), "id")
    table = rows.where("k is not null").groupBy("k").agg(F.count("*").alias("n"))
    got = attach(rows, table, ["k"], "n", 1000, ["n"])
    assert got.count() == 1000 and got.where("n is null").count() == 900


def test_points_are_not_summed(spark):
    df = spark.createDataFrame([(1, 10.0, 5), (1, 20.0, 6)], "x int, y double, z int")
    assert sorted(r["value"] for r in charts.chart_table(df, "line", "x", "y").collect()) == [10.0, 20.0]
    assert charts.chart_table(df, "scatter", "x", "y").count() == 2
    assert {r["series"] for r in charts.chart_table(df, "pie", "x", ["y", "z"]).collect()} == {"y", "z"}


def test_split_of_equal_rows(spark):
    df = spark.range(400).select("id", (F.col("id") % 2).cast("double").alias("x"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("c"))
    row = models.train_classifier(df, ["x"], "c").first()
    assert row["train_rows"] > 200 and 50 < row["test_rows"] < 150 and row["accuracy"] == 1
    few = df.drop("id").withColumn("x", F.lit(1.0))  # two different rows, parted by weight
    row = models.train_classifier(few, ["x"], "c").first()
    assert (row["train_rows"], row["test_rows"], row["accuracy"]) == (300, 100, 0.5)


def test_histogram_of_a_far_value(spark):
    from quarrylens.operators import distribution

    df = spark.range(1000).selectExpr("if(id = 0, 1e9, double(id) / 1000) AS x", "id % 2 AS c")
    rows = sorted(distribution.histogram(df, ["x"], runs=True).collect(), key=lambda r: r["bin"])
    assert sum(r["count"] for r in rows) == 1000 and sum(r["bins"] for r in rows) > 10**9 and len(rows) < 100
    assert all(a["bin"] + a["bins"] == b["bin"] and a["upper"] == pytest.approx(b["lower"]) for a, b in zip(rows, rows[1:]))
    plain = distribution.histogram(df, ["x"]).collect()
    assert sum(r["count"] for r in plain) == 1000 and len(plain) < 10_100
    assert sum(r["count"] for r in distribution.histogram(df, ["x"], "c").collect()) == 1000


def test_a_report_runs_one_quantile_pass(rich, monkeypatch):
    from quarrylens.operators import profile, quality, reports

    passes = []
    whole = profile.quantile_values
    for module in (profile, quality):
        monkeypatch.setattr(module, "quantile_values", lambda df, columns, probs: passes.append(tuple(columns)) or whole(df, columns, probs))
    sections = reports.report(rich, reports.SECTIONS)
    assert list(sections) == list(reports.SECTIONS) and len(passes) == 1
    apart = reports.report(rich, ["quality"])["quality"]["score"].collect()
    assert sections["quality"]["score"].collect() == apart
    reports.report(rich, ["overview", "correlation"])
    assert len(passes) == 2
