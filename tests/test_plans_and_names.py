"""Whole plans, their check, and names from a table."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quarrylens import AnalysisError
from quarrylens.operators import dictionary, text


@pytest.fixture(scope="module")
def sales(spark):
    return spark.createDataFrame([(1.0, 2, "a", True)], "revenue double, units long, region string, active boolean").withColumn("day", F.current_date())


def _plan(spark, sales, question):
    asked = spark.createDataFrame([(question, 1)], "question string, intent int")
    return text.intent_plan(asked.drop("intent"), "question", sales).first()["plan"].asDict()


@pytest.mark.parametrize("question, slots", [
    ("Predict revenue from units", {"intent": "regression", "target": "revenue", "features": ["units"], "metric": None, "group": None}),
    ("Classify region by units and revenue", {"intent": "classification", "target": "region", "features": ["units", "revenue"], "group": None}),
    ("forecast revenue", {"intent": "forecast", "metric": "revenue", "x": "day"}),
    ("trend of units", {"intent": "trend", "metric": "units", "x": "day", "y": None}),
    ("correlation of units and revenue", {"intent": "correlation", "x": "units", "y": "revenue", "chart": None}),
    ("correlation please", {"intent": "correlation", "x": None, "y": None, "chart": "heatmap"}),
    ("top 7 region by revenue", {"intent": "ranking", "group": "region", "metric": "revenue", "row_limit": 7, "features": []}),
    (None, {"intent": "summary", "metric": None, "features": []})])
def test_plans(spark, sales, question, slots):
    plan = _plan(spark, sales, question)
    assert {k: plan[k] for k in slots} == slots and list(plan) == list(text.PLAN_FIELDS)


def test_unusable_slots_are_emptied_and_told(spark, sales):
    shape = ("plan struct<intent: string, operation: string, row_limit: long, `group`: string, metric: string, x: string, y: string, target: string, "
             "features: array<string>, chart: string>")
    plans = spark.createDataFrame([
        (("ranking", "sum", 5, "region", "region", None, None, None, None, "bar"),),
        (("ranking", "sum", 5, "nowhere", "units", None, None, None, ["region"], None),),
        (("regression", "sum", 5, "units", "units", None, None, "region", ["units", "gone", "region"], None),),
        (("of its own", "sum", 5, "units", None, "units", None, "region", [], None),)], shape)
    got = [(r["checked"], r["rejected"]) for r in text.checked_plan(plans, "plan", sales).collect()]
    assert (got[0][0]["group"], got[0][0]["metric"], got[0][1]) == ("region", None, ["metric: region is categorical, wanted numeric"])
    assert (got[1][0]["group"], got[1][0]["features"], got[1][1]) == (None, ["region"], ["group: no column nowhere"])
    assert (got[2][0]["group"], got[2][0]["target"], got[2][0]["features"]) == (None, None, ["units"])
    assert got[2][1] == ["target: region is categorical, wanted numeric", "features: no column gone", "features: region is categorical, wanted numeric"]
    assert got[3][1] == [] and got[3][0]["x"] == "units"
    with pytest.raises(AnalysisError):
        text.checked_plan(plans, "nothing", sales)


def test_names_of_a_table(spark):
    texts = spark.createDataFrame([(1, "The net_revenue and NET REVENUE of Süd-West."), (2, "unit price, unit  cost; unit_cost"), (3, "mynet revenue"), (4, None),
                                   (5, "a+b is not a b"), (6, "")], "id long, text string")
    names = spark.createDataFrame([("net_revenue",), ("revenue",), ("Süd",), ("süd-west",), ("unit_price",), ("unit_cost",), ("unit",), ("a+b",), ("a_b",), (None,),
                                   ("...",), ("unit",)], "name string")
    got = {r["id"]: (r["mentioned"], r["resolved"]) for r in dictionary.dictionary_mentions(texts, "id", "text", names, "name").collect()}
    assert got == {1: (["net_revenue", "revenue", "Süd", "süd-west"], "net_revenue"), 2: (["unit", "unit_price", "unit_cost"], "unit_price"),
                   3: (["revenue"], "revenue"), 5: (["a+b", "a_b"], "a+b")}
    for rows in (texts.where("false"), texts):
        assert dictionary.dictionary_mentions(rows, "id", "text", names.where("false" if rows is texts else "true"), "name").count() == 0


def test_names_of_a_table_equal_the_search_by_pattern(spark):
    texts = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    names = ["the", "is", "des", "of_the", "and", "le", "en", "in_the"]
    table = spark.createDataFrame([(n,) for n in names], "name string")
    want = {r["doc_id"]: r["mentioned"] for r in text.name_mentions(texts, "text", names).where("size(mentioned) > 0").collect()}
    got = {r["doc_id"]: r["mentioned"] for r in dictionary.dictionary_mentions(texts, "doc_id", "text", table, "name").collect()}
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
