"""Queries for charts, report tables, text jobs and loading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.operators import charts, dictionary, profile, reports, text
from quarrylens.plans.registry import LINEITEM_NUMBERS, Query, on, read, rounded, shared_folder, union_all
from quarrylens.plans.shapes import RELATED_SQL, _RELATED, _related, histogram_sql, matrix_sql, pearson_sql
from quarrylens.plans.tables import GAPS_SQL, QUERIES as TABLES, _typed_orders, _with_gaps, iqr_sql, score_sql, stats_sql, top_sql
from quarrylens.sources import catalog, files, sinks, typing

QUERIES: dict[str, Query] = {}

ORDER_COLUMNS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
ORDER_NUMBERS = ("o_orderkey", "o_custkey", "o_totalprice")

QUERIES["chart_bar"] = Query(
    on("orders", lambda df: rounded(charts.chart_table(
        df, "bar", "o_orderpriority", "o_totalprice", aggregation="mean", color="o_orderstatus"), 4)),
    "SELECT o_orderpriority AS x, o_orderstatus AS color, 'o_totalprice' AS series, round(avg(o_totalprice), 4) AS value "
    "FROM orders GROUP BY 1, 2")

QUERIES["chart_bar_count"] = Query(
    on("events", lambda df: charts.chart_table(_with_gaps(df), "bar", "event_type", aggregation="count")),
    f"SELECT event_type AS x, 'count' AS series, count(*)::DOUBLE AS value FROM {GAPS_SQL} GROUP BY 1")

QUERIES["chart_line"] = Query(
    on("orders", lambda df: rounded(charts.chart_table(
        df.withColumn("day", F.to_date("o_orderdate").cast("string")), "line", "day", ["o_totalprice", "o_custkey"],
        aggregation="max"), 4)),
    union_all(f"SELECT (o_orderdate::DATE)::VARCHAR AS x, '{m}' AS series, round(max({m})::DOUBLE, 4) AS value "
              "FROM orders GROUP BY 1" for m in ("o_totalprice", "o_custkey")))

QUERIES["chart_scatter"] = Query(
    on("orders", lambda df: charts.chart_table(df, "scatter", "o_custkey", "o_totalprice")),
    "SELECT o_custkey AS x, o_totalprice::DOUBLE AS o_totalprice FROM orders")

QUERIES["chart_line_raw"] = Query(
    on("orders", lambda df: charts.chart_table(df, "line", "o_custkey", ["o_totalprice", "o_orderkey"])),
    union_all(f"SELECT o_custkey AS x, '{m}' AS series, {m}::DOUBLE AS value FROM orders" for m in ("o_totalprice", "o_orderkey")))

QUERIES["chart_histogram"] = Query(
    on("orders", lambda df: rounded(charts.chart_table(df, "histogram", "o_totalprice"), 6)),
    histogram_sql("orders", "o_totalprice", False))

QUERIES["chart_box"] = Query(
    on("orders", lambda df: rounded(charts.chart_table(df, "box", "o_orderpriority", "o_totalprice").select(
        "group", "min", "q1", "median", "q3", "max"), 4)),
    """SELECT o_orderpriority AS "group", round(min(o_totalprice), 4) AS min, round(quantile_cont(o_totalprice, 0.25), 4) AS q1,
  round(quantile_cont(o_totalprice, 0.5), 4) AS median, round(quantile_cont(o_totalprice, 0.75), 4) AS q3,
  round(max(o_totalprice), 4) AS max FROM orders GROUP BY 1""")

QUERIES["chart_pie"] = Query(
    on("orders", lambda df: charts.chart_table(df, "pie", "o_orderpriority", ["o_totalprice", "o_custkey"]).select(
        "x", "series", F.round("value", 2).alias("value"), F.round("share", 6).alias("share"))),
    union_all(f"""SELECT o_orderpriority AS x, '{m}' AS series, round(sum({m})::DOUBLE, 2) AS value,
  round(sum({m}) / (SELECT sum({m}) FROM orders), 6) AS share FROM orders GROUP BY 1""" for m in ("o_totalprice", "o_custkey")))

QUERIES["chart_heatmap"] = Query(
    on("lineitem", lambda df: rounded(charts.chart_table(df, "heatmap", columns=["l_quantity", "l_tax", "l_discount"]))),
    matrix_sql("lineitem", ("l_quantity", "l_tax", "l_discount")))

QUERIES["report_executive"] = Query(
    on("orders", reports.executive_summary),
    f"""WITH s AS ({score_sql("orders", ORDER_COLUMNS, ORDER_NUMBERS)}), p AS ({pearson_sql("orders", ORDER_NUMBERS)}),
b AS (SELECT "left", "right", round(r, 4) AS r FROM p WHERE abs(r) >= 0.7 ORDER BY abs(r) DESC LIMIT 1)
SELECT rows, 6::BIGINT AS columns, score, duplicate_rows, 0::BIGINT AS columns_with_gaps, 3::BIGINT AS "numeric",
  2::BIGINT AS categorical, (SELECT "left" FROM b) AS strongest_left, (SELECT "right" FROM b) AS strongest_right,
  (SELECT r FROM b) AS strongest_r FROM s""")

QUERIES["report_executive_related"] = Query(
    on("lineitem", lambda df: reports.executive_summary(_related(df)).select(
        "rows", "columns", "duplicate_rows", "strongest_r")),
    f"""SELECT count(*) AS rows, 6::BIGINT AS columns,
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT {", ".join(_RELATED)} FROM {RELATED_SQL})) AS duplicate_rows,
  (SELECT round(arg_max(r, abs(r)), 4) FROM ({pearson_sql(RELATED_SQL, _RELATED)})) AS strongest_r FROM lineitem""")

QUERIES["report_profile"] = Query(
    on("orders", reports.column_profile),
    union_all(f"SELECT '{c}' AS \"column\", '{k}' AS kind, count({c}) AS non_null, count(*) - count({c}) AS missing, "
              f"count(DISTINCT {c}) AS \"unique\" FROM orders"
              for c, k in zip(ORDER_COLUMNS, ("numeric", "numeric", "categorical", "numeric", "datetime", "categorical"))))

QUERIES["report_quality"] = Query(
    on("events", lambda df: reports.report(_with_gaps(df), ["quality"])["quality"]["outliers"]),
    f"SELECT * FROM ({iqr_sql(GAPS_SQL, ['event_id', 'user_id', 'value'])}) WHERE count > 0")

QUERIES["report_quality_score"] = Query(
    on("events", lambda df: reports.report(_with_gaps(df), ["quality"])["quality"]["score"]), TABLES["quality_score"].sql)

QUERIES["report_quality_missing"] = Query(
    on("events", lambda df: reports.report(_with_gaps(df), ["quality"])["quality"]["missing"]), TABLES["missing_summary"].sql)

QUERIES["report_quality_types"] = Query(
    on("orders", lambda df: reports.report(_typed_orders(df), ["quality"])["quality"]["datatypes"]
       .select("column", "issue", "detail", "severity", "distinct")), TABLES["datatype_issues"].sql)

QUERIES["report_matrix"] = Query(
    on("lineitem", lambda df: rounded(reports.report(_related(df), ["correlation"])["correlation"]["matrix"])), matrix_sql(RELATED_SQL, _RELATED))

QUERIES["first_rows"] = Query(
    on("orders", lambda df: profile.first_rows(df.select("o_orderkey", "o_orderstatus"), ["o_orderkey"])),
    "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 8")

_REPORTED = ["count", "mean", "median", "std", "min", "max"]
QUERIES["report_statistics"] = Query(
    on("orders", lambda df: rounded(reports.statistics_tables(df)["numeric"], 4)),
    "SELECT \"column\", count, " + ", ".join(f"round({f}, 4) AS {f}" for f in _REPORTED[1:])
    + f" FROM ({stats_sql('orders', ORDER_NUMBERS, _REPORTED)})")

QUERIES["report_statistics_categorical"] = Query(
    on("orders", reports.most_frequent),
    f"""SELECT "column", "unique", missing, value || ' (' || count || ')' AS frequent
FROM ({top_sql("orders", ["o_orderstatus", "o_orderdate", "o_orderpriority"], 1)})""")

QUERIES["report_correlation"] = Query(
    on("lineitem", lambda df: reports.report(_related(df), ["correlation"])["correlation"]["strong"]),
    f"""SELECT "left", "right", round(r, 4) AS value, CASE WHEN r >= 0 THEN 'positive' ELSE 'negative' END AS direction
FROM ({pearson_sql(RELATED_SQL, _RELATED)}) WHERE abs(r) >= 0.7""")

QUERIES["report_distribution"] = Query(
    on("events", lambda df: rounded(reports.distribution_shapes(_with_gaps(df)), 4)),
    f"""SELECT "column", round(mean, 4) AS mean, round(median, 4) AS median, round(std, 4) AS std,
  round(skewness, 4) + 0.0 AS skewness, CASE WHEN abs(skewness) < 0.5 THEN 'symmetric'
    WHEN skewness > 0 THEN 'right-skewed' ELSE 'left-skewed' END AS shape
FROM ({stats_sql(GAPS_SQL, ["event_id", "user_id", "value"], ["mean", "median", "std", "skewness"])})""")

QUERIES["report_formatted"] = Query(
    on("nation", lambda df: reports.formatted(df.groupBy("n_regionkey").agg(
        F.count("*").alias("nations"), (F.sum("n_nationkey") * 1000.5).alias("figure"),
        F.max(F.expr("case when n_regionkey > 1 then n_name end")).alias("last_name")))),
    """SELECT n_regionkey::VARCHAR AS n_regionkey, count(*)::VARCHAR AS nations,
  format('{:,.2f}', sum(n_nationkey) * 1000.5::DOUBLE) AS figure,
  coalesce(max(CASE WHEN n_regionkey > 1 THEN n_name END), '—') AS last_name FROM nation GROUP BY nation.n_regionkey""")

QUERIES["data_summary"] = Query(
    on("lineitem", lambda df: reports.data_summary(_related(df)).select(
        "rows", "columns", F.array_join("numeric_columns", ",").alias("numeric_columns"),
        F.size("categorical_columns").alias("categorical_columns"), "duplicate_rows", "columns_with_missing",
        F.array_join(F.transform("strong_correlations", lambda x: F.concat_ws(
            ":", x["left"], x["right"], x["strength"], x["direction"])), ",").alias("links"))),
    f"""WITH p AS (SELECT * FROM ({pearson_sql(RELATED_SQL, _RELATED)}) WHERE abs(r) >= 0.7
  ORDER BY abs(r) DESC, "left", "right" LIMIT 3)
SELECT count(*) AS rows, 6::BIGINT AS columns, '{",".join(_RELATED)}' AS numeric_columns, 0::INTEGER AS categorical_columns,
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT {", ".join(_RELATED)} FROM {RELATED_SQL})) AS duplicate_rows,
  0::BIGINT AS columns_with_missing,
  (SELECT string_agg("left" || ':' || "right" || ':strong:' || CASE WHEN r >= 0 THEN 'positive' ELSE 'negative' END, ','
     ORDER BY abs(r) DESC, "left", "right") FROM p) AS links FROM lineitem""")

# Questions built from the rows of the part table: one phrase per row, with its type and a number.
_PHRASES = ("average retail price by", "show the top {n} types by retail price for", "trend of size over time for",
            "outliers in retail price of", "predict size from retail price for", "which country has discount",
            "give me an overview of", "forecast size for the future of", "correlation of size and retail price in",
            "describe the spread of retail price for", "breakdown of brand", "classify type from size of",
            "how many retail price", "median size by type", "discounted summary of countries with")


def _questions(df: DataFrame) -> DataFrame:
    phrase = F.array(*[F.lit(p) for p in _PHRASES])[(F.col("p_partkey") % len(_PHRASES)).cast("int")]
    return df.select("p_partkey", F.concat(
        F.replace(phrase, F.lit("{n}"), F.col("p_size").cast("string")), F.lit(" "), F.col("p_type")).alias("question"))


def _asked_table(df: DataFrame) -> DataFrame:
    return df.select(F.col("p_retailprice").alias("retail_price"), F.col("p_size").alias("size"),
                     F.col("p_brand").alias("brand"), F.col("p_type").alias("type"))


def _word_sql(*words: str) -> str:
    # RE2 has no look-around, so the neighbours are matched as non-word characters.
    return f"regexp_matches(q, '(^|[^\\p{{L}}\\p{{N}}_])(" + "|".join(words) + ")($|[^\\p{L}\\p{N}_])')"


_QUESTION_SQL = ("SELECT p_partkey, replace(['" + "', '".join(_PHRASES) + f"'][p_partkey % {len(_PHRASES)} + 1], "
                 "'{n}', p_size::VARCHAR) || ' ' || p_type AS question FROM part")
QUERIES["intent_tags"] = Query(
    on("part", lambda df: text.intent_tags(_questions(df), "question", _asked_table(df)).select(
        "p_partkey", "intent", "operation", "row_limit", "metric", "group")),
    f"""WITH s AS (SELECT p_partkey, lower(question) AS q FROM ({_QUESTION_SQL})),
w AS (SELECT *, {_word_sql(*text.OVERVIEW_WORDS)} AS overview, {_word_sql(*text.PREDICT_WORDS)} AS predict,
  {_word_sql(*text.CLASSIFY_WORDS)} AS classify, {_word_sql(*text.FORECAST_WORDS)} AS forecast,
  {_word_sql(*text.CORRELATION_WORDS)} AS correlation, {_word_sql(*text.OUTLIER_WORDS)} AS outlier,
  {_word_sql(*text.SEGMENT_WORDS)} AS segment, {_word_sql(*text.RANK_WORDS)} AS rank, {_word_sql(*text.SPREAD_WORDS)} AS spread,
  {_word_sql(*text.COUNT_PHRASES)} AS counts, {_word_sql(*text.MEAN_PHRASES)} AS means, {_word_sql(*text.SUM_PHRASES)} AS sums,
  {_word_sql("median")} AS medians, {_word_sql("brand")} AS brand, {_word_sql("type")} AS "type",
  CASE WHEN {_word_sql("retail price", "retail_price")} THEN 'retail_price' WHEN {_word_sql("size")} THEN 'size'
       ELSE 'retail_price' END AS m FROM s),
g AS (SELECT *, CASE WHEN brand THEN 'brand' ELSE 'type' END AS grp FROM w),
i AS (SELECT *, CASE WHEN overview AND NOT segment AND NOT rank THEN 'summary' WHEN predict AND NOT forecast THEN 'regression'
  WHEN classify THEN 'classification' WHEN forecast THEN 'forecast' WHEN correlation THEN 'correlation'
  WHEN outlier THEN 'outlier' WHEN segment THEN 'segmentation' WHEN rank THEN 'ranking'
  WHEN means OR sums OR counts OR medians THEN 'aggregation' WHEN spread THEN 'descriptive' ELSE 'summary' END AS intent FROM g)
SELECT p_partkey, intent,
  CASE WHEN intent = 'aggregation' THEN CASE WHEN means THEN 'mean' WHEN medians THEN 'median' WHEN counts THEN 'count'
       ELSE 'sum' END ELSE 'sum' END AS operation,
  CASE WHEN intent = 'ranking' AND regexp_matches(q, '(?:top|bottom|first|last)\\s+(\\d+)')
       THEN least(regexp_extract(q, '(?:top|bottom|first|last)\\s+(\\d+)', 1)::BIGINT, 50) ELSE 5 END AS row_limit,
  CASE WHEN intent NOT IN ('summary', 'classification', 'correlation') THEN m END AS metric,
  CASE WHEN intent IN ('segmentation', 'ranking', 'classification') THEN grp
       WHEN intent = 'aggregation' THEN CASE WHEN brand THEN 'brand' WHEN "type" THEN 'type' END END AS "group"
FROM i""")

def _dated_table(df: DataFrame) -> DataFrame:
    return _asked_table(df).withColumn("made", F.lit("2024-01-01").cast("date"))


_PLAN_SQL = QUERIES["intent_tags"].sql.rsplit("SELECT p_partkey, intent,", 1)[0]
_PLAN_SQL = _PLAN_SQL.replace("WHEN outlier THEN 'outlier'", f"WHEN outlier THEN 'outlier' WHEN {_word_sql(*text.TREND_WORDS)} THEN 'trend'")
QUERIES["intent_plan"] = Query(
    on("part", lambda df: text.intent_plan(_questions(df), "question", _dated_table(df)).select(
        "p_partkey", "plan.intent", "plan.operation", "plan.row_limit", "plan.group", "plan.metric", "plan.x", "plan.y", "plan.target",
        F.array_join("plan.features", ",").alias("features"), "plan.chart")),
    _PLAN_SQL + f""", n AS (SELECT *, [x.name FOR x IN list_sort(list_filter([
    {{'at': strpos(replace(q, 'retail_price', 'retail price'), 'retail price'), 'name': 'retail_price'}},
    {{'at': CASE WHEN {_word_sql("size")} THEN strpos(q, 'size') ELSE 0 END, 'name': 'size'}}], lambda x: x.at > 0))] AS named FROM i)
SELECT p_partkey, intent,
  CASE WHEN intent = 'aggregation' THEN CASE WHEN means THEN 'mean' WHEN medians THEN 'median' WHEN counts THEN 'count' ELSE 'sum' END ELSE 'sum' END AS operation,
  CASE WHEN intent = 'ranking' AND regexp_matches(q, '(?:top|bottom|first|last)\\s+(\\d+)')
       THEN least(regexp_extract(q, '(?:top|bottom|first|last)\\s+(\\d+)', 1)::BIGINT, 50) ELSE 5 END AS row_limit,
  CASE WHEN intent IN ('segmentation', 'ranking') THEN grp WHEN intent = 'aggregation' THEN CASE WHEN brand THEN 'brand' WHEN "type" THEN 'type' END END AS "group",
  CASE WHEN intent NOT IN ('summary', 'classification', 'correlation', 'regression') THEN m END AS metric,
  CASE WHEN intent IN ('forecast', 'trend') THEN 'made' WHEN intent = 'correlation' AND len(named) = 2 THEN named[1] END AS x,
  CASE WHEN intent = 'correlation' AND len(named) = 2 THEN named[2] END AS y,
  CASE intent WHEN 'regression' THEN m WHEN 'classification' THEN grp END AS target,
  CASE intent WHEN 'regression' THEN array_to_string(list_filter(named, lambda c: c <> m), ',') WHEN 'classification' THEN array_to_string(named, ',') ELSE '' END AS features,
  CASE WHEN intent = 'correlation' AND len(named) < 2 THEN 'heatmap' END AS chart FROM n""")


def _proposed(df: DataFrame) -> DataFrame:
    """Plans over the orders table as another source might propose them: some name missing columns or such of the wrong kind."""
    names = F.array(*[F.lit(n) for n in ("o_totalprice", "o_orderstatus", "o_orderdate", "o_nothing", None)])

    def pick(step: int) -> Column:
        return F.get(names, (F.col("p_partkey") * step % 5).cast("int"))

    intent = F.array(*[F.lit(i) for i in ("ranking", "trend", "regression")])[(F.col("p_partkey") % 3).cast("int")]
    return df.select("p_partkey", F.struct(
        intent.alias("intent"), F.lit("sum").alias("operation"), F.lit(5).cast("bigint").alias("row_limit"), pick(1).alias("group"), pick(2).alias("metric"),
        pick(3).alias("x"), F.lit(None).cast("string").alias("y"), pick(4).alias("target"),
        F.array(F.lit("o_custkey"), F.lit("o_orderstatus")).alias("features"), F.lit(None).cast("string").alias("chart")).alias("plan"))


def _slot_sql(slot: str, step: int) -> str:
    """SQL: the name in a slot of a proposed plan, its kind, and the kinds wanted."""
    wanted = {slot_kind[0]: kind for (intent, own), kind in text.SLOT_KINDS.items() if own == slot for slot_kind in [(intent,)]}
    cases = " ".join(f"WHEN '{i}' THEN {list(wanted[i])}" for i in ("ranking", "trend", "regression") if i in wanted)
    return (f"['o_totalprice', 'o_orderstatus', 'o_orderdate', 'o_nothing', NULL][p_partkey * {step} % 5 + 1] AS {slot}_name, "
            f"['numeric', 'categorical', 'datetime', NULL, NULL][p_partkey * {step} % 5 + 1] AS {slot}_kind, "
            + (f"CASE intent {cases} END" if cases else "NULL::VARCHAR[]") + f" AS {slot}_wanted")


_SLOTS = {"group": 1, "metric": 2, "x": 3, "target": 4}
_WHY = {slot: f"""CASE WHEN {slot}_name IS NULL THEN NULL WHEN {slot}_kind IS NULL THEN '{slot}: no column ' || {slot}_name
  WHEN {slot}_wanted IS NOT NULL AND NOT list_contains({slot}_wanted, {slot}_kind)
  THEN '{slot}: ' || {slot}_name || ' is ' || {slot}_kind || ', wanted ' || array_to_string({slot}_wanted, ' or ') END""" for slot in _SLOTS}
QUERIES["checked_plan"] = Query(
    lambda spark, folder: text.checked_plan(_proposed(read(spark, folder, "part")), "plan", read(spark, folder, "orders")).select(
        "p_partkey", "checked.group", "checked.metric", "checked.x", "checked.target", F.array_join("checked.features", ",").alias("features"),
        F.array_join("rejected", "; ").alias("rejected")),
    f"""WITH p AS (SELECT p_partkey, ['ranking', 'trend', 'regression'][p_partkey % 3 + 1] AS intent FROM part),
s AS (SELECT p_partkey, intent, {", ".join(_slot_sql(slot, step) for slot, step in _SLOTS.items())} FROM p),
w AS (SELECT *, {", ".join(f"{why} AS {slot}_why" for slot, why in _WHY.items())} FROM s),
k AS (SELECT *, {", ".join(f"CASE WHEN {slot}_why IS NULL THEN {slot}_name END AS {slot}_kept" for slot in _SLOTS)} FROM w)
SELECT p_partkey, CASE WHEN group_kept IS DISTINCT FROM metric_kept THEN group_kept END AS "group", metric_kept AS metric, x_kept AS x, target_kept AS target,
  CASE WHEN intent = 'regression' THEN 'o_custkey' ELSE 'o_custkey,o_orderstatus' END AS features,
  concat_ws('; ', group_why, metric_why, x_why, target_why,
    CASE WHEN intent = 'regression' THEN 'features: o_orderstatus is categorical, wanted numeric' END) AS rejected FROM k""")


def _benchmark_names(df: DataFrame) -> DataFrame:
    """Every word of the benchmark, and every two neighbours joined by an underscore."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    both = F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda at: F.array_join(F.slice("w", at, 2), "_"))
    rows = df.select(words.alias("w")).select("w", F.when(F.size("w") > 1, both).otherwise(F.array().cast("array<string>")).alias("b"))
    return rows.select(F.explode(F.concat("w", "b")).alias("name")).distinct()


QUERIES["dictionary_mentions"] = Query(
    lambda spark, folder: dictionary.dictionary_mentions(read(spark, folder, "documents"), "doc_id", "text",
                                                         _benchmark_names(read(spark, folder, "benchmark")), "name").select(
        "doc_id", F.size("mentioned").alias("mentioned"), F.get("mentioned", F.lit(0)).alias("first"), "resolved"),
    r"""WITH b AS (SELECT regexp_extract_all(lower(text), '[a-z]+') AS w FROM benchmark),
n AS (SELECT DISTINCT unnest(w) AS name FROM b UNION SELECT DISTINCT unnest([w[i] || '_' || w[i + 1] FOR i IN range(1, len(w))]) FROM b),
d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_]+') AS t FROM documents),
e AS (SELECT doc_id, i, t[i] AS a, CASE WHEN t[i + 1] = ' ' THEN t[i] || '_' || t[i + 2] END AS ab FROM (SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS i FROM d)),
m AS (SELECT doc_id, name, min(i) AS place FROM (SELECT doc_id, i, a AS name FROM e UNION ALL SELECT doc_id, i, ab FROM e WHERE ab IS NOT NULL) JOIN n USING (name) GROUP BY ALL)
SELECT doc_id, count(*)::INTEGER AS mentioned, arg_min(name, row(place, name)) AS first, arg_min(name, row(-length(name), name)) AS resolved FROM m GROUP BY doc_id""")

_NAMES = ("the", "is", "des", "of_the", "and", "le", "en")
QUERIES["name_mentions"] = Query(
    on("documents", lambda df: text.name_mentions(df, "text", _NAMES).select(
        "doc_id", "resolved", F.size("mentioned").alias("mentioned"), F.get("mentioned", F.lit(0)).alias("first"))),
    "WITH s AS (SELECT doc_id, lower(text) AS q FROM documents), p AS (SELECT doc_id, [" + ", ".join(
        f"CASE WHEN {_word_sql(n, n.replace('_', ' '))} THEN {{'at': length(regexp_extract(q, "
        f"'^((?s:.*?)(?:^|[^\\p{{L}}\\p{{N}}_]))(?:{n}|{n.replace('_', ' ')})(?:$|[^\\p{{L}}\\p{{N}}_])', 1)), 'name': '{n}'}} END"
        for n in _NAMES) + """] AS hits FROM s),
h AS (SELECT doc_id, list_sort(list_filter(hits, lambda x: x IS NOT NULL)) AS hits FROM p)
SELECT doc_id, CASE """ + " ".join(
        f"WHEN len(list_filter(hits, lambda x: x.name = '{n}')) > 0 THEN '{n}'" for n in sorted(_NAMES, key=len, reverse=True))
    + " END AS resolved, len(hits)::INTEGER AS mentioned, hits[1].name AS first FROM h")


def _wrapped(df: DataFrame) -> DataFrame:
    """Event properties inside the kinds of text a model returns."""
    kind = F.col("event_id") % 5
    return df.select("event_id", F.when(kind == 0, F.concat(F.lit("Sure, here it is:\n```json\n"), "props", F.lit("\n```\nDone {x}")))
                     .when(kind == 1, F.concat(F.lit("The answer is "), "props", F.lit(' and not {"k": 1}.')))
                     .when(kind == 2, F.concat(F.lit('{"note": "a } inside \\" quotes {", "p": '), "props", F.lit("} tail")))
                     .when(kind == 3, F.concat(F.lit('{"open": '), "props")).otherwise(F.col("event_type")).alias("reply"))


QUERIES["json_extract"] = Query(
    on("events", lambda df: text.extract_json(_wrapped(df), "reply").select("event_id", "json")),
    """SELECT event_id, CASE event_id % 5 WHEN 0 THEN props WHEN 1 THEN props
  WHEN 2 THEN '{"note": "a } inside \\" quotes {", "p": ' || props || '}' END AS json FROM events""")

QUERIES["number_grounding"] = Query(
    on("events", lambda df: text.number_grounding(df.select(
        "event_id", F.concat(F.lit("Event "), "event_id", F.lit(" was worth "), F.round(F.col("value") * 1.006, 2),
                             F.lit(" at key "), F.regexp_extract("props", r"(\d+)", 1), F.lit(".")).alias("said"),
        F.concat(F.lit("id "), F.format_number("event_id", 0), F.lit(", value "), "value", F.lit(", "), F.when(
            F.col("event_id") % 3 > 0, F.col("props")).otherwise(F.lit(""))).alias("known")), "said", "known").select(
                "event_id", "grounded")),
    r"""WITH t AS (SELECT event_id,
  'Event ' || event_id || ' was worth ' || round(value * 1.006, 2) || ' at key ' || regexp_extract(props, '(\d+)', 1) || '.' AS said,
  'id ' || format('{:,}', event_id) || ', value ' || value || ', ' || CASE WHEN event_id % 3 > 0 THEN props ELSE '' END AS known
  FROM events),
n AS (SELECT event_id,
  list_transform(regexp_extract_all(said, '-?\d[\d,]*\.?\d*'), lambda x: rtrim(replace(x, ',', ''), '.')::DOUBLE) AS a,
  list_transform(regexp_extract_all(known, '-?\d[\d,]*\.?\d*'), lambda x: rtrim(replace(x, ',', ''), '.')::DOUBLE) AS b FROM t)
SELECT event_id, len(list_filter(a, lambda x: len(list_filter(b, lambda y:
  abs(x - y) <= greatest(abs(x) * 0.01::DOUBLE, 0.01::DOUBLE))) = 0)) = 0 AS grounded FROM n""")

QUERIES["last_turns"] = Query(
    on("conversations", lambda df: text.last_turns(df, "conv_id", "turn", role="role")),
    """SELECT conv_id, turn, role, text FROM (SELECT *, count(*) FILTER (role = 'user') OVER (PARTITION BY conv_id
  ORDER BY turn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS later FROM conversations) WHERE later < 6""")


#: Rows of a delimited file: quoted line breaks keep a reader from splitting it.
FILE_ROWS = 1 << 18


def _csv_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Write orders with missing-value tokens as delimited text, load it back, profile the result."""
    target = f"{shared_folder(spark)}/orders.csv"
    orders = read(spark, folder, "orders")
    (orders.withColumn("o_totalprice", F.expr("case when o_custkey % 5 = 0 then 'N/A' else cast(o_totalprice as string) end"))
     .withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))
     .withColumn("flagged", F.expr("case when o_orderkey % 2 = 0 then 'True' else 'False' end"))
     .withColumn("remark", F.concat(F.lit('say "hi",\nsecond line '), "o_orderstatus"))
     .write.option("maxRecordsPerFile", FILE_ROWS).csv(target, header=True, escape='"'))
    df = files.load(spark, target)
    return df.groupBy("o_orderstatus").agg(
        F.count("*").alias("rows"), F.round(F.sum("o_totalprice"), 2).alias("total"),
        F.count("o_totalprice").alias("priced"), F.max(F.year("o_orderdate")).alias("last_year"),
        F.count_if("flagged").alias("flagged"), F.min("remark").alias("remark"))


QUERIES["csv_scan"] = Query(_csv_scan, """SELECT o_orderstatus, count(*) AS rows,
  round(sum(o_totalprice) FILTER (o_custkey % 5 <> 0), 2) AS total, count(*) FILTER (o_custkey % 5 <> 0) AS priced,
  max(year(o_orderdate))::INTEGER AS last_year, count(*) FILTER (o_orderkey % 2 = 0) AS flagged,
  'say "hi",' || chr(10) || 'second line ' || o_orderstatus AS remark FROM orders GROUP BY 1""")


def _report_export(spark: SparkSession, folder: str) -> DataFrame:
    """Export two report sections and read one of them back."""
    sections = reports.report(read(spark, folder, "orders"), ["statistics", "overview"])
    paths = sinks.export_report(sections, f"{shared_folder(spark)}/report", "json")
    numbers = next(p for p in paths if p.endswith("statistics/numeric"))
    return spark.read.json(numbers).select("column", "count", F.round("median", 4).alias("median"))


QUERIES["report_export"] = Query(_report_export, union_all(
    f"SELECT '{c}' AS \"column\", count({c}) AS count, round(quantile_cont({c}::DOUBLE, 0.5), 4) AS median FROM orders"
    for c in ORDER_NUMBERS))

QUERIES["typed_text"] = Query(
    on("lineitem", lambda df: typing.infer_types(typing.without_missing_tokens(df.select(
        *[F.col(c).cast("string").alias(c) for c in df.columns]))).groupBy("l_returnflag").agg(
            F.sum("l_orderkey").alias("keys"), F.round(F.sum("l_extendedprice"), 2).alias("price"))),
    "SELECT l_returnflag, sum(l_orderkey)::BIGINT AS keys, round(sum(l_extendedprice), 2) AS price FROM lineitem GROUP BY 1")

QUERIES["normalized_dates"] = Query(
    on("orders", lambda df: typing.normalize(df.select(
        F.col("o_orderkey").alias(" key "), F.expr("case when o_orderkey % 10 = 0 then 'soon' "
                                                   "else date_format(o_orderdate, 'M/d/yyyy') end").alias("order_date"),
        F.expr("case when o_orderkey % 4 = 0 then 'soon' else cast(o_orderdate as string) end").alias("mostly_time")))
       .groupBy(F.year("order_date").alias("year")).agg(F.count("*").alias("rows"), F.max("key").alias("last_key"),
                                                        F.count_if(F.col("mostly_time") == "soon").alias("texts"))),
    """SELECT CASE WHEN o_orderkey % 10 <> 0 THEN year(o_orderdate)::INTEGER END AS year, count(*) AS rows,
  max(o_orderkey) AS last_key, count(*) FILTER (o_orderkey % 4 = 0) AS texts FROM orders GROUP BY 1""")

QUERIES["preview"] = Query(
    on("customer", lambda df: catalog.preview(df, ["c_custkey"])), "SELECT * FROM customer ORDER BY c_custkey LIMIT 20")


def _registered(spark: SparkSession, folder: str) -> DataFrame:
    catalog.register(read(spark, folder, "customer"), "quarrylens_customers")
    return catalog.preview_info(catalog.get(spark, "quarrylens_customers"), "customers", "parquet").select(
        "name", "source", "rows", "columns", F.array_join("column_names", ",").alias("column_names"))


QUERIES["dataset_info"] = Query(_registered, """SELECT 'customers' AS name, 'parquet' AS source, count(*) AS rows, 5::BIGINT AS columns,
  'c_custkey,c_name,c_nationkey,c_acctbal,c_mktsegment' AS column_names FROM customer""")

QUERIES["json_safe_records"] = Query(
    on("lineitem", lambda df: _safe(df)),
    """SELECT l_orderkey, l_partkey, l_linenumber, CASE WHEN l_discount > 0 AND l_tax > 0 THEN round(l_extendedprice, 2) END AS price
FROM lineitem""")


def _safe(df: DataFrame) -> DataFrame:
    """Records with infinities and NaN put in where a discount or tax is zero."""
    from quarrylens.functions.values import json_safe

    wild = F.expr("case when l_discount = 0 then double('Infinity') when l_tax = 0 then double('NaN') else l_extendedprice end")
    return json_safe(df.select("l_orderkey", "l_partkey", "l_linenumber", wild.alias("price"))).withColumn(
        "price", F.round("price", 2))


__all__ = ["LINEITEM_NUMBERS", "QUERIES"]
