from __future__ import annotations

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from quarrylens import AnalysisError
from quarrylens.operators import charts, reports, text
from quarrylens.sources import catalog, database, files, sinks


def test_chart_requests(sample):
    assert charts.chart_table(sample, "bar", "region", "revenue", aggregation="sum").count() == 3
    two = charts.chart_table(sample, "line", "region", ["revenue", "units"], aggregation="sum")
    assert {r["series"] for r in two.collect()} == {"revenue", "units"}
    assert charts.chart_table(sample, "heatmap", columns=["revenue", "units"]).count() == 4
    assert charts.chart_table(sample, "scatter", "units", "revenue").count() == 4
    pie = charts.chart_table(sample, "pie", "region", aggregation="count").collect()
    assert sum(r["share"] for r in pie) == pytest.approx(1)


@pytest.mark.parametrize("request_", [
    dict(chart_type="bar", x="nope"), dict(chart_type="bar"), dict(chart_type="scatter", x="units"),
    dict(chart_type="pie", x="region"), dict(chart_type="radar", x="units"), dict(chart_type="bar", x="region", aggregation="sum"),
    dict(chart_type="bar", x="region", y="revenue", aggregation="median"), dict(chart_type="bar", x="units", color="nope")])
def test_chart_errors(sample, request_):
    with pytest.raises(AnalysisError):
        charts.chart_table(sample, **request_)


def test_report_sections(rich):
    assert list(reports.report(rich, ["correlation", "quality", "nonsense"])) == ["quality", "correlation"]
    with pytest.raises(AnalysisError):
        reports.report(rich, ["nonsense"])
    row = reports.executive_summary(rich).first()
    assert (row["rows"], row["columns"], row["numeric"]) == (96, 7, 3)
    assert reports.data_summary(rich).first()["rows"] == 96


def test_report_of_text_only(spark):
    df = spark.createDataFrame([("a",), ("b",)], "t string")
    for section, tables in reports.report(df, list(reports.SECTIONS)).items():
        for name, table in tables.items():
            table.collect()


QUESTIONS = [
    ("What are the top 5 products by revenue?", "ranking"), ("What's the average revenue by region?", "aggregation"),
    ("Identify outliers in price", "outlier"), ("Show me the correlation between units and price", "correlation"),
    ("What's the revenue trend over time?", "trend"), ("Generate a summary of region segments", "segmentation"),
    ("Predict revenue from units and price", "regression"), ("Classify grade from units", "classification"),
    ("Forecast revenue for the next 3 periods", "forecast"), ("Give me an overview", "summary"),
    ("Describe the distribution of price", "descriptive"), ("Which country sells best?", "ranking"),
    ("Tell me the discounted country", "summary"), ("Top 500 products by revenue", "ranking")]


def test_intents(spark, rich):
    asked = spark.createDataFrame([(q, i) for q, i in QUESTIONS], "question string, expected string")
    tagged = text.intent_tags(asked, "question", rich).collect()
    assert [(r["question"], r["intent"]) for r in tagged] == QUESTIONS
    limits = {r["question"]: r["row_limit"] for r in tagged}
    assert limits["Top 500 products by revenue"] == 50 and limits["Which country sells best?"] == 5
    assert tagged[1]["operation"] == "mean" and tagged[1]["group"] == "region"


def test_name_mentions(spark):
    names = ["id", "unit_price", "price", "order_id"]
    df = spark.createDataFrame([("Identify the unit price, then ORDER_ID",), ("nothing",), ("price-id",), (None,)], "t string")
    got = [(r["mentioned"], r["resolved"]) for r in text.name_mentions(df, "t", names, ["price"]).collect()]
    # A longer name that holds a shorter one counts as a mention of both.
    assert got[0] == (["unit_price", "price", "order_id"], "unit_price")
    assert got[1] == ([], "unit_price") and got[2] == (["price", "id"], "price")


REPLIES = [
    ('{"a": 1}', {"a": 1}), ('Sure:\n```json\n{"a": {"b": "}"}}\n```\nbye {', {"a": {"b": "}"}}),
    ('text {"a": "q \\" } {"} {"b": 2}', {"a": 'q " } {'}), ("```\n{}\n```", {}), ('{"a": "\\\\"} tail "', {"a": "\\"}),
    ('{"open": 1', None), ("none", None), ("{bad}", None), ("", None), (None, None)]


def test_json_extraction(spark):
    df = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(REPLIES)], "i int, reply string")
    got = {r["i"]: r["json"] for r in text.extract_json(df, "reply").collect()}
    assert [None if got[i] is None else json.loads(got[i]) for i in range(len(REPLIES))] == [want for _, want in REPLIES]


def test_grounding(spark):
    cases = [("The total is 9999.99 today.", "total 250.0", False), ("The total is 250.0 today.", "total 250.0", True),
             ("Roughly 1,002 rows.", "1000 rows", True), ("Roughly 1,020 rows.", "1000 rows", False),
             ("short", "1", False), ("No figures in here.", "", True), (None, "1", False)]
    df = spark.createDataFrame(cases, "said string, known string, want boolean")
    assert all(r["grounded"] == r["want"] for r in text.number_grounding(df, "said", "known").collect())


def test_last_turns(spark):
    df = spark.createDataFrame([("c", t) for t in range(9)] + [("d", 1)], "conv string, turn int")
    got = [tuple(r) for r in text.last_turns(df, "conv", "turn").collect()]
    assert got == [("c", t) for t in range(3, 9)] + [("d", 1)]
    said = spark.createDataFrame([("c", t, "user" if t % 3 == 0 else "assistant") for t in range(9)] + [("d", 1, "assistant")],
                                 "conv string, turn int, role string")
    got = [tuple(r)[:2] for r in text.last_turns(said, "conv", "turn", 2, role="role").collect()]
    assert got == [("c", t) for t in range(3, 9)] + [("d", 1)]


def test_csv(spark, tmp_path):
    path = tmp_path / "sales.csv"
    path.write_text(' name ,value,ratio,ok,created_at,note\na,1,1.5,True,2024-01-05,"two\nlines, ""q"""\n'
                    "b,NA,inf,False,01/06/2024,N/A\n")
    df = files.load(spark, str(path))
    assert df.dtypes == [("name", "string"), ("value", "bigint"), ("ratio", "double"), ("ok", "boolean"),
                         ("created_at", "timestamp"), ("note", "string")]
    first, second = df.orderBy("name").collect()
    assert first["note"] == 'two\nlines, "q"' and second["value"] is None and second["note"] is None


def test_load_errors(spark, tmp_path):
    (tmp_path / "empty.csv").write_text("a,b\n")
    with pytest.raises(AnalysisError, match="empty"):
        files.load(spark, str(tmp_path / "empty.csv"))
    with pytest.raises(AnalysisError, match="known formats"):
        files.load(spark, "table.txt")
    with pytest.raises(AnalysisError, match="does not read"):
        files.load(spark, str(tmp_path / "missing.parquet"))


def _workbook(path, rows):
    """A minimal workbook: shared strings for the header, inline cells, one date style."""
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    header = "".join(f'<c r="{chr(65 + i)}1" t="s"><v>{i}</v></c>' for i in range(3))
    body = "".join(f'<row r="{n}"><c r="A{n}" t="inlineStr"><is><t>{name}</t></is></c>'
                   + (f'<c r="B{n}"><v>{value}</v></c>' if value is not None else "")
                   + f'<c r="C{n}" s="1"><v>{day}</v></c></row>' for n, (name, value, day) in enumerate(rows, 2))
    with zipfile.ZipFile(path, "w") as book:
        book.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/'
                      'relationships"><sheets><sheet name="s" sheetId="1" r:id="rId1"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/'
                      'relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        book.writestr("xl/styles.xml", f'<styleSheet {main}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        book.writestr("xl/sharedStrings.xml", f'<sst {main}>' + "".join(
            f"<si><t>{t}</t></si>" for t in ("name", "value", "made_date")) + "</sst>")
        book.writestr("xl/worksheets/sheet1.xml", f'<worksheet {main}><sheetData><row r="1">{header}</row>{body}</sheetData></worksheet>')


def test_excel_folder(spark, tmp_path):
    _workbook(tmp_path / "one.xlsx", [("a", 1, 45292), ("b", None, 45293)])
    _workbook(tmp_path / "two.xlsx", [("c", 2.5, 45294)])
    df = files.load(spark, str(tmp_path), format="xlsx")
    assert df.dtypes == [("name", "string"), ("value", "double"), ("made_date", "timestamp")]
    got = [(r["name"], r["value"], str(r["made_date"].date())) for r in df.orderBy("name").collect()]
    assert got == [("a", 1.0, "2024-01-01"), ("b", None, "2024-01-02"), ("c", 2.5, "2024-01-03")]


@pytest.mark.parametrize("query", ["delete from t", "select 1; drop table t", "with t as (select 1) select * from t", ""])
def test_only_one_select(query):
    with pytest.raises(AnalysisError):
        database.read_only(query)


def test_select_is_kept():
    assert database.read_only("  SELECT * FROM t ;") == "SELECT * FROM t"


def test_catalog(spark, sample):
    catalog.register(sample, "sample_table")
    assert "sample_table" in catalog.names(spark) and catalog.get(spark, "sample_table").count() == 4
    with pytest.raises(AnalysisError):
        catalog.get(spark, "absent_table")
    with pytest.raises(AnalysisError):
        catalog.preview(sample, ["units"], 101)
    assert [r["units"] for r in catalog.preview(sample, ["units", "region"], 2).collect()] == [1, 2]


def test_export(spark, wild, tmp_path):
    sinks.write_json(wild, str(tmp_path / "wild"))
    lines = [json.loads(line) for part in (tmp_path / "wild").glob("part*.json") for line in part.read_text().splitlines()]
    assert len(lines) == 5 and sum("x" in line for line in lines) == 2
    written = sinks.export_report({"s": {"t": wild}}, str(tmp_path / "report"))
    assert spark.read.parquet(written[0]).where(F.col("x").isNull()).count() == 3
    with pytest.raises(AnalysisError):
        sinks.export_report({}, "x", "pdf")
