"""Steps whose work must not grow faster than their input."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylens.operators import correlation, dictionary, models
from quarrylens.plans import outputs
from quarrylens.sources import typing


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_names_are_found_without_a_search_for_each(spark):
    texts = spark.createDataFrame([(1, "See _net_revenue, net  revenue; +A net_revenue x+a ab+ New York"), (2, "new_york ab+x ab+ C__x"), (2, "net revenue"),
                                   (2, "net revenue"), (None, "net revenue"), (3, "..."), (4, "+a"), (5, None)], "id long, text string")
    names = spark.createDataFrame([("net_revenue",), ("net",), ("+a",), ("a",), ("ab+",), ("New York",), ("c_",), ("revenue",)], "name string")
    found = dictionary.dictionary_mentions(texts, "id", "text", names, "name")
    assert "regexp_instr" not in _plan(found)
    got = sorted((r["id"], r["mentioned"], r["resolved"]) for r in found.collect())
    assert got == [(1, ["net", "revenue", "+a", "a", "net_revenue", "ab+", "New York"], "net_revenue"), (2, ["ab+"], "ab+"),
                   (2, ["net", "net", "net_revenue", "net_revenue", "revenue", "revenue"], "net_revenue"),
                   (2, ["net", "net", "net_revenue", "net_revenue", "revenue", "revenue"], "net_revenue"), (4, ["+a", "a"], "+a")]


def test_types_are_not_tested_against_forms_ruled_out(spark, monkeypatch):
    n = typing.HEAD * 3
    last = F.col("id") == n - 1
    df = spark.range(n, numPartitions=1).select(
        F.col("id").cast("string").alias("whole"), F.when(last, "1.5").otherwise(F.col("id").cast("string")).alias("late_real"),
        F.when(last, "x").otherwise(F.col("id").cast("string")).alias("late_text"), F.when(last, "1" * 25).otherwise(" 7 ").alias("long"),
        F.when(last, "1" * 39).otherwise("+7").alias("too_long"), F.when(last, "true").otherwise("False").alias("flag"),
        F.when(last, "7").otherwise("True").alias("late_flag"), F.lit("words").alias("words"), F.lit(None).cast("string").alias("none"),
        F.when(last, "-inf").otherwise("2.5").alias("real"), F.when(last, "5").alias("only_late"))
    asked, agg = [], type(df).agg

    def counted(self, *exprs):
        asked.append(len(exprs))
        return agg(self, *exprs)

    monkeypatch.setattr(type(df), "agg", counted)
    typed = typing.infer_types(df)
    monkeypatch.undo()
    assert {f.name: f.dataType.simpleString() for f in typed.schema} == {
        "whole": "bigint", "late_real": "double", "late_text": "string", "long": "decimal(38,0)", "too_long": "string", "flag": "boolean",
        "late_flag": "string", "words": "string", "none": "string", "real": "double", "only_late": "bigint"}
    assert asked == [11, 10]  # one figure for a column, and none of the column of words from all rows
    assert typed.where("late_real = 1.5").count() == 1


def test_delimited_text_is_written_in_files_that_many_tasks_can_read(spark, tmp_path, monkeypatch):
    spark.sql("SELECT id AS o_orderkey, id % 7 AS o_custkey, if(id % 2 = 0, 'O', 'F') AS o_orderstatus, id / 4D AS o_totalprice, "
              "timestamp'1995-03-04 00:00:00' AS o_orderdate, '1-URGENT' AS o_orderpriority FROM range(0, 1000, 1, 1)").write.parquet(f"{tmp_path}/orders.parquet")
    monkeypatch.setattr(outputs, "FILE_ROWS", 100)
    found = outputs.QUERIES["csv_scan"].run(spark, str(tmp_path))
    assert len(found.inputFiles()) == 10
    assert sorted((r["o_orderstatus"], r["rows"], r["priced"], r["last_year"], r["flagged"]) for r in found.collect()) == [
        ("F", 500, 357, 1995, 0), ("O", 500, 357, 1995, 500)]


def test_training_reads_rows_that_were_kept(spark, monkeypatch):
    df = spark.range(400).select(F.col("id").alias("k"), (F.col("id") % 17).alias("x"), (F.col("id") * 7 % 13).alias("y"),
                                 F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("c"))
    plans = []
    for kind in (models.LogisticRegression, models.LinearRegression):
        monkeypatch.setattr(kind, "fit", lambda self, data, fit=kind.fit: plans.append(_plan(data)) or fit(self, data))
    sizes = models.train_classifier(df, ["x", "y"], "c", keys=["k"]).select("rows", "train_rows", "test_rows").first()
    assert tuple(sizes) == (400, 299, 101)  # 134 and 266 rows, of which 34 and 67 are held out
    assert models.train_regression(df, ["x"], "y", keys=["k"]).first()["train_rows"] == 300
    assert len(plans) == 2 and all("InMemoryTableScan" in plan for plan in plans)
    assert spark._jsparkSession.sharedState().cacheManager().isEmpty()


def test_ranks_travel_once_for_each_column_of_many_values(spark):
    n = 3000
    df = spark.range(n, numPartitions=4).select(
        F.col("id").cast("double").alias("a"), F.when(F.col("id") % 5 == 0, 7.0).otherwise((F.col("id") * 7919 % 1009).cast("double")).alias("b"),
        F.when(F.col("id") % 2 == 0, -0.0).otherwise(F.when(F.col("id") % 3 == 0, 0.0).otherwise(1.0)).alias("few"),
        F.when(F.col("id") % 11 != 0, (F.col("id") * 31 % 997).cast("double")).alias("gaps"), F.lit(2.0).alias("one"))
    found = correlation.pair_table(df, ["a", "b", "few"], "spearman")
    assert _plan(found).count("Window [rank(") == 2 and "xxhash64" not in _plan(found)
    rows = df.toPandas()
    for row in correlation.pair_table(df, None, "spearman").collect():
        some = rows[[row["left"], row["right"]]].dropna()
        want = some.rank().corr().iloc[0, 1]
        assert row["n"] == len(some) and (row["r"] is None if want != want else abs(row["r"] - want) < 1e-9)
    assert [tuple(r)[2:] for r in correlation.pair_table(df.where("a < 0"), ["a", "b"], "spearman").collect()] == [(0, None)]
