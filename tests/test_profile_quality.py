from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarrylens import AnalysisError
from quarrylens.functions import kinds
from quarrylens.functions.values import json_safe
from quarrylens.operators import distribution, groups, profile, quality


def rows(df):
    return [row.asDict() for row in df.collect()]


def test_group_sum(sample):
    table = {r["region"]: r["revenue"] for r in rows(groups.aggregate(sample, "revenue", "sum", "region"))}
    assert table["North"] == 250


def test_unknown_operation_and_column(sample):
    with pytest.raises(AnalysisError, match="Unsupported"):
        groups.aggregate(sample, "revenue", "mode", "region")
    with pytest.raises(AnalysisError, match="Unknown column"):
        groups.aggregate(sample, "nope", "sum", "region")
    with pytest.raises(AnalysisError, match="needs numeric"):
        groups.aggregate(sample, "region", "sum", "region")


def test_scalar_aggregate_uses_finite_values(wild, spark):
    assert rows(groups.scalar_aggregate(wild, "x", "sum")) == [{"metric": "x", "operation": "sum", "value": 6.0, "count": 2}]
    with pytest.raises(AnalysisError, match="in every row"):
        groups.scalar_aggregate(spark.createDataFrame([(None,)], "a double"), "a", "mean")


def test_ranking_without_a_meaningful_share(spark):
    df = spark.createDataFrame([("a", -5.0), ("b", 10.0)], "g string, v double")
    assert rows(groups.ranking(df, "g", "v"))[0] == {"g": "b", "v": 10.0, "combined_share_percent": None}


def test_group_means_equal_pandas(rich, rich_pandas):
    got = {r["product"]: r["revenue"] for r in rows(groups.aggregate(rich, "revenue", "mean", "product"))}
    want = rich_pandas.groupby("product")["revenue"].mean().to_dict()
    assert got == pytest.approx(want)


def test_segmentation_survives_a_column_named_rows(rich):
    table = rows(groups.segmentation(rich.withColumn("rows", F.lit(1)), "region", "revenue"))
    assert sum(r["rows"] for r in table) == 96 and {r["segments"] for r in table} == {3}


def test_small_segments(spark):
    df = spark.createDataFrame([("a",)] * 6 + [("b",)] * 2, "g string")
    assert rows(groups.small_segments(df, "g")) == [{"segment": "b", "rows": 2}]


def test_welch_p_value(spark):
    # t = -2.0 with 8 degrees of freedom gives p = 0.0805 in any table of the distribution.
    df = spark.createDataFrame([("l", float(x)) for x in (1, 2, 3, 4, 5)] + [("r", float(x)) for x in (3, 4, 5, 6, 7)],
                               "side string, x double")
    row = groups.welch_t_test(df, "x", "side", "l", "r").first()
    assert row["statistic"] == pytest.approx(-2.0) and row["degrees"] == pytest.approx(8.0)
    assert row["p_value"] == pytest.approx(0.08051623795726257, rel=1e-9)


def test_majority(spark):
    row = groups.majority_baseline(spark.createDataFrame([("a",), ("a",), ("a",), ("b",), (None,)], "t string"), "t").first()
    assert row["predicted_class"] == "a" and row["accuracy"] == 0.75 and row["rows"] == 4


def test_kinds(spark):
    df = spark.createDataFrame([(True, 1, "x", [1])], "active boolean, score long, t string, nested array<int>")
    assert kinds.kinds(df) == {"active": "boolean", "score": "numeric", "t": "categorical", "nested": "categorical"}


def test_numeric_statistics_equal_pandas(rich, rich_pandas):
    for r in rows(profile.numeric_statistics(rich)):
        s = rich_pandas[r["column"]]
        want = {"count": s.count(), "mean": s.mean(), "median": s.median(), "std": s.std(), "min": s.min(),
                "q25": s.quantile(.25), "q75": s.quantile(.75), "max": s.max(), "skewness": s.skew(), "kurtosis": s.kurt()}
        for key, value in want.items():
            assert r[key] == pytest.approx(value, abs=2e-6), key


def test_statistics_of_short_constant_and_shifted_columns(spark):
    df = spark.createDataFrame([(3.0, 1e9 + 1, None), (3.0, 1e9 + 2, 1.0), (3.0, 1e9 + 4, None), (3.0, 1e9 + 9, None)],
                               "same double, far double, once double")
    same, far, once = rows(profile.numeric_statistics(df))
    assert (same["std"], same["skewness"], same["kurtosis"]) == (0.0, 0.0, 0.0)
    assert far["std"] == pytest.approx(np.std([1, 2, 4, 9], ddof=1), abs=1e-6)
    assert far["skewness"] == pytest.approx(pd.Series([1, 2, 4, 9]).skew(), abs=1e-6)
    assert once["count"] == 1 and once["std"] is None and once["skewness"] is None


def test_no_output_holds_nan_or_infinity(wild):
    tables = [profile.numeric_statistics(wild), quality.iqr_outliers(wild), quality.quality_score(wild),
              distribution.histogram(wild), json_safe(wild)]
    for table in tables:
        for row in table.collect():
            assert all(v is None or not isinstance(v, float) or math.isfinite(v) for v in row)


def test_outliers_and_duplicates(sample):
    found = {r["column"]: r["count"] for r in rows(quality.iqr_outliers(sample))}
    assert found["revenue"] == 1
    assert rows(profile.duplicate_summary(sample)) == [{"count": 0, "percent": 0.0}]
    assert rows(profile.duplicate_summary(sample.union(sample)))[0]["count"] == 4


def test_duplicates_with_nulls_long_texts_and_maps(spark):
    long = "x" * 100
    data = [(None, long, {"a": 1}), (None, long, {"a": 1}), (None, long + "y", {"a": 1}), (1.0, None, None)]
    assert rows(profile.duplicate_summary(spark.createDataFrame(data, "a double, b string, c map<string,int>")))[0]["count"] == 1


def test_datatype_rules(spark):
    df = spark.createDataFrame(
        [(str(i), float(i), None, i % 2 == 0, i % 2, f"2024-01-{i + 1:02d}", f"id{i}") for i in range(25)],
        "amount string, real double, blank string, flag boolean, bit int, made_date string, code string")
    found = {(r["column"], r["issue"]) for r in rows(quality.datatype_issues(df))}
    assert found == {("amount", "numeric_stored_as_text"), ("blank", "empty_column"), ("bit", "numeric_flag"),
                     ("made_date", "date_stored_as_text"), ("amount", "high_cardinality"),
                     ("made_date", "high_cardinality"), ("code", "high_cardinality")}


def test_mixed_types_in_a_variant(spark):
    df = spark.createDataFrame([("1",), ('"two"',), ("3.0",), (None,), ('"five"',)], "t string").select(
        F.parse_json("t").alias("value"))
    assert [r["issue"] for r in rows(quality.datatype_issues(df))] == ["mixed_types"]
    assert len(profile.datatype_summary(df).first()["value_types"]) > 1


def test_score_of_an_empty_column(spark):
    df = spark.createDataFrame([(None, 1), (None, 2)], "blank string, n long")
    row = quality.quality_score(df).first()
    assert row["score"] == round(100 * (0.55 * 0.5 + 0.25 * 1.0 + 0.2 * 1.0)) and row["missing_cells"] == 2


def test_overview_of_nested_and_empty(spark):
    df = spark.createDataFrame([([1.0], {"k": 1}, -0.0), ([1.0], None, 0.0)], "a array<double>, m map<string,int>, z double")
    found = {r["column"]: (r["unique"], r["missing"]) for r in rows(profile.column_overview(df))}
    assert found == {"a": (1, 0), "m": (1, 1), "z": (1, 0)}
    assert rows(profile.column_overview(df.limit(0))) == []


def test_distinct_counts_of_large_integers(spark):
    df = spark.createDataFrame([(2 ** 53, "(missing)"), (2 ** 53 + 1, None)], "a long, t string")
    found = {r["column"]: (r["unique"], r["missing"]) for r in rows(profile.column_overview(df))}
    assert found == {"a": (2, 0), "t": (1, 1)}


def test_histogram_equals_numpy(rich, rich_pandas):
    for column in ("price", "revenue"):
        s = rich_pandas[column].to_numpy()
        table = sorted(rows(distribution.histogram(rich, [column])), key=lambda r: r["bin"])
        assert sum(r["count"] for r in table) == len(s)
        edges = [r["lower"] for r in table] + [table[-1]["upper"]]
        # The bin counts must be those of the edges; numpy versions differ in how many bins they choose.
        np.testing.assert_array_equal([r["count"] for r in table], np.histogram(s, bins=np.linspace(edges[0], edges[-1], len(edges)))[0])


def test_histogram_of_a_constant(spark):
    df = spark.createDataFrame([(4,), (4,)], "n int")
    assert rows(distribution.histogram(df)) == [{"column": "n", "bin": 0, "lower": 3.5, "upper": 4.5, "count": 2}]


def test_distribution_dispatch(rich):
    numeric = distribution.distribution(rich, "revenue")
    row = numeric["summary"].first()
    assert row["min"] <= row["q1"] <= row["median"] <= row["q3"] <= row["max"]
    values = distribution.distribution(rich, "region")["values"].collect()
    assert sum(v["proportion"] for v in values) == pytest.approx(1, abs=0.01)
    with pytest.raises(AnalysisError):
        distribution.distribution(rich, "not_a_column")


def test_top_with_other_merges_a_real_other(spark):
    df = spark.createDataFrame([("Other",)] * 5 + [("a",)] * 4 + [("b",)] * 3, "c string")
    assert {(r["value"], r["is_rest"]): r["count"] for r in rows(distribution.top_with_other(df, "c", 2))} == {
        ("Other", False): 5, ("a", False): 4, ("Other", True): 3}


def test_counts_of_every_type_read_like_the_values(spark):
    df = spark.sql("""SELECT * FROM VALUES
        (1, true, 1.5D, float(0.1), date'2020-02-03', timestamp'2020-02-03 04:05:06.7', 2.50BD, 'a', binary('x')),
        (1, false, double('NaN'), float(0.1), null, timestamp'2020-02-03 04:05:06.7', null, '(missing)', null),
        (null, null, -0.0D, null, date'2020-02-03', null, 2.50BD, null, binary('x')) AS t(i, b, d, f, day, at, c, s, raw)""")
    from quarrylens.scale.longform import value_counts

    got = {(r["column"], r["value"]): (r["n"], r["n_missing"]) for r in rows(value_counts(df, df.columns))}
    assert got == {("i", "1"): (2, 0), ("i", "(missing)"): (1, 1), ("b", "true"): (1, 0), ("b", "false"): (1, 0), ("b", "(missing)"): (1, 1),
                   ("d", "1.5"): (1, 0), ("d", "0.0"): (1, 0), ("d", "(missing)"): (1, 1), ("f", "0.1"): (2, 0), ("f", "(missing)"): (1, 1),
                   ("day", "2020-02-03"): (2, 0), ("day", "(missing)"): (1, 1), ("at", "2020-02-03 04:05:06.7"): (2, 0), ("at", "(missing)"): (1, 1),
                   ("c", "2.50"): (2, 0), ("c", "(missing)"): (1, 1), ("s", "a"): (1, 0), ("s", "(missing)"): (2, 1),
                   ("raw", "eA=="): (2, 0), ("raw", "(missing)"): (1, 1)}


def test_long_texts_are_told_apart_and_counted_approximately(spark):
    df = spark.range(3000).selectExpr("concat(repeat('x', 100), id % 700) AS t", "id % 41 AS k")
    exact = {r["column"]: r for r in rows(profile.column_overview(df))}
    assert (exact["t"]["unique"], exact["k"]["unique"]) == (700, 41) and exact["t"]["sample"] == "x" * 100 + "0"
    near = {r["column"]: r["unique"] for r in rows(profile.column_overview(df, approximate=True))}
    assert abs(near["t"] - 700) < 70 and abs(near["k"] - 41) < 5
    plan = profile.column_overview(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(position") == 1  # the values, once
