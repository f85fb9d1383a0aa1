"""Queries for grouped aggregates, profiles and quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.operators import groups, profile, quality
from quarrylens.plans.registry import LINEITEM_NUMBERS, Query, on, rounded, union_all

_SQL_OPERATION = {
    "sum": "sum({0})", "mean": "avg({0})", "median": "quantile_cont({0}, 0.5)", "min": "min({0})",
    "max": "max({0})", "count": "count({0})",
}


def _with_gaps(events: DataFrame) -> DataFrame:
    """Events with missing cells: the tables hold none, so some values are turned into null."""
    return (events.withColumn("event_type", F.expr("nullif(event_type, 'error')"))
            .withColumn("value", F.expr("case when user_id % 7 = 0 then null else value end")))


GAPS_SQL = """(SELECT event_id, ts, user_id, nullif(event_type, 'error') AS event_type,
       CASE WHEN user_id % 7 = 0 THEN NULL ELSE value END AS value, props FROM events)"""

QUERIES: dict[str, Query] = {}

for _operation, _form in _SQL_OPERATION.items():
    # A median of prices in cents has a third decimal, so it must not be rounded at the second.
    _digits = 6 if _operation == "median" else 2
    QUERIES[f"group_aggregate_{_operation}"] = Query(
        on("lineitem", lambda df, op=_operation, digits=_digits: rounded(
            groups.aggregate(df, "l_extendedprice", op, "l_returnflag").withColumnRenamed("l_extendedprice", "result"),
            digits)),
        f"SELECT l_returnflag, round({_form.format('l_extendedprice')}, {_digits}) AS result FROM lineitem GROUP BY 1")

QUERIES["group_aggregate_count"] = Query(
    QUERIES["group_aggregate_count"].run,
    "SELECT l_returnflag, count(l_extendedprice) AS result FROM lineitem GROUP BY 1")

QUERIES["group_aggregate_nullkey"] = Query(
    on("events", lambda df: rounded(groups.aggregate(_with_gaps(df), "value", "sum", "event_type"), 2)),
    f"SELECT event_type, round(coalesce(sum(value), 0), 2) AS value FROM {GAPS_SQL} GROUP BY 1")

QUERIES["group_median_nullkey"] = Query(
    on("events", lambda df: rounded(groups.aggregate(_with_gaps(df), "value", "median", "event_type"), 4)),
    f"SELECT event_type, round(quantile_cont(value, 0.5), 4) AS value FROM {GAPS_SQL} GROUP BY 1")

QUERIES["table_aggregate"] = Query(
    on("lineitem", lambda df: rounded(groups.aggregate(df, "l_extendedprice", "median"), 4)),
    "SELECT 'l_extendedprice' AS metric, 'median' AS operation, "
    "round(quantile_cont(l_extendedprice, 0.5), 4) AS value FROM lineitem")

QUERIES["scalar_aggregate"] = Query(
    on("events", lambda df: rounded(groups.scalar_aggregate(_with_gaps(df), "value", "mean"), 4)),
    f"SELECT 'value' AS metric, 'mean' AS operation, round(avg(value), 4) AS value, count(value) AS count FROM {GAPS_SQL}")

QUERIES["group_report"] = Query(
    on("orders", lambda df: rounded(groups.group_report(df, "o_totalprice", "sum", "o_custkey"), 2)),
    """WITH g AS (SELECT o_custkey, sum(o_totalprice) AS s FROM orders GROUP BY 1)
SELECT o_custkey, round(s, 2) AS o_totalprice, (SELECT count(*) FROM g) AS groups
FROM g ORDER BY s DESC, o_custkey LIMIT 50""")

QUERIES["row_counts"] = Query(
    on("events", lambda df: groups.row_counts(_with_gaps(df), "event_type")),
    f"SELECT event_type, count(*) AS count FROM {GAPS_SQL} GROUP BY 1")

QUERIES["aggregate_many"] = Query(
    on("orders", lambda df: rounded(groups.aggregate_many(df, "o_orderpriority", ["o_totalprice", "o_custkey"], "mean"), 4)),
    "SELECT o_orderpriority, round(avg(o_totalprice), 4) AS o_totalprice, round(avg(o_custkey), 4) AS o_custkey "
    "FROM orders GROUP BY 1")

QUERIES["ranking_share"] = Query(
    on("orders", lambda df: rounded(groups.ranking(df, "o_orderpriority", "o_totalprice", "sum", 3), 2)),
    """WITH g AS (SELECT o_orderpriority, sum(o_totalprice) AS s FROM orders GROUP BY 1
            ORDER BY 2 DESC, 1 LIMIT 3)
SELECT o_orderpriority, round(s, 2) AS o_totalprice,
       round((SELECT sum(s) FROM g) / (SELECT sum(o_totalprice) FROM orders) * 100, 2) AS combined_share_percent
FROM g""")

QUERIES["ranking_lowest"] = Query(
    on("customer", lambda df: rounded(groups.ranking(df, "c_nationkey", "c_acctbal", "sum", 5, ascending=True), 2)),
    """WITH t AS (SELECT sum(c_acctbal) AS s, min(c_acctbal) AS m FROM customer),
g AS (SELECT c_nationkey, sum(c_acctbal) AS s FROM customer GROUP BY 1 ORDER BY 2, 1 LIMIT 5)
SELECT c_nationkey, round(s, 2) AS c_acctbal,
       (SELECT CASE WHEN t.s > 0 AND t.m >= 0 THEN round((SELECT sum(s) FROM g) / t.s * 100, 2) END FROM t)
         AS combined_share_percent
FROM g""")

QUERIES["segmentation"] = Query(
    on("customer", lambda df: rounded(groups.segmentation(df, "c_mktsegment", "c_acctbal"), 4)),
    """WITH g AS (SELECT c_mktsegment AS segment, count(*) AS rows, avg(c_acctbal) AS m FROM customer GROUP BY 1)
SELECT segment, rows, round(m, 4) AS mean_metric, (SELECT count(*) FROM g) AS segments, rows < 5 AS small
FROM g ORDER BY rows DESC, segment LIMIT 30""")

QUERIES["welch_t"] = Query(
    on("lineitem", lambda df: rounded(
        groups.welch_t_test(df, "l_quantity", "l_returnflag", "R", "N").drop("p_value"), 5)),
    """WITH s AS (
  SELECT count(l_quantity) FILTER (l_returnflag = 'R') AS n1, count(l_quantity) FILTER (l_returnflag = 'N') AS n2,
         avg(l_quantity) FILTER (l_returnflag = 'R') AS m1, avg(l_quantity) FILTER (l_returnflag = 'N') AS m2,
         var_samp(l_quantity) FILTER (l_returnflag = 'R') AS v1, var_samp(l_quantity) FILTER (l_returnflag = 'N') AS v2
  FROM lineitem)
SELECT n1 AS n_left, n2 AS n_right, round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 5) AS statistic,
       round(pow(v1 / n1 + v2 / n2, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1)), 5) AS degrees
FROM s""")

#: The p-value by Simpson's rule over the density of Student's t.
QUERIES["welch_p_value"] = Query(
    on("lineitem", lambda df: rounded(groups.welch_t_test(df, "l_quantity", "l_returnflag", "R", "N").select("n_left", "n_right", "p_value"), 6)),
    f"""WITH w AS (SELECT n_left, n_right, abs(statistic) AS t, degrees AS d FROM ({QUERIES["welch_t"].sql.replace(", 5)", ", 12)")})),
f AS (SELECT n_left, n_right, t, t / 2000 AS h, i, exp(lgamma((d + 1) / 2) - lgamma(d / 2)) / sqrt(d * pi()) * pow(1 + pow(i * t / 2000, 2) / d, -(d + 1) / 2) AS y
  FROM w, range(2001) r(i))
SELECT n_left, n_right, round(1 - 2 * sum(y * CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * any_value(h) / 3, 6) AS p_value
FROM f GROUP BY n_left, n_right""")

QUERIES["majority_baseline"] = Query(
    on("orders", lambda df: rounded(groups.majority_baseline(df, "o_orderpriority"))),
    """SELECT o_orderpriority AS predicted_class,
       round(count(*) / (SELECT count(*) FROM orders), 6) AS accuracy, (SELECT count(*) FROM orders) AS rows
FROM orders GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1""")


def stats_sql(table: str, columns, fields=None) -> str:
    figures = {
        "count": "count({0})", "mean": "round(avg({0}), 6)", "median": "round(quantile_cont({0}::DOUBLE, 0.5), 6)",
        "std": "round(stddev_samp({0}), 6)", "min": "round(min({0})::DOUBLE, 6)",
        "q25": "round(quantile_cont({0}::DOUBLE, 0.25), 6)", "q75": "round(quantile_cont({0}::DOUBLE, 0.75), 6)",
        "max": "round(max({0})::DOUBLE, 6)", "skewness": "round(coalesce(skewness({0}), 0), 6) + 0.0",
        "kurtosis": "round(coalesce(kurtosis({0}), 0), 6) + 0.0",
    }
    chosen = fields or list(figures)
    return union_all(f"SELECT '{c}' AS \"column\", " + ", ".join(
        f"{figures[f].format(c)} AS {f}" for f in chosen) + f" FROM {table}" for c in columns)


_DESCRIBED = ["count", "mean", "std", "min", "q25", "median", "q75", "max"]
QUERIES["describe_numeric"] = Query(
    on("lineitem", lambda df: rounded(profile.describe_numeric(df))), stats_sql("lineitem", LINEITEM_NUMBERS, _DESCRIBED))

QUERIES["numeric_stats"] = Query(
    on("lineitem", lambda df: rounded(profile.numeric_statistics(df))), stats_sql("lineitem", LINEITEM_NUMBERS))


def top_sql(source: str, columns, limit: int) -> str:
    return union_all(f"""SELECT * FROM (
  SELECT '{c}' AS "column", (SELECT count(DISTINCT {c}) FROM {source}) AS "unique",
         (SELECT count(*) - count({c}) FROM {source}) AS missing,
         row_number() OVER (ORDER BY count(*) DESC, coalesce({c}::VARCHAR, '(missing)')) AS rank,
         coalesce({c}::VARCHAR, '(missing)') AS value, count(*) AS count,
         round(count(*) / (SELECT count(*) FROM {source}), 4) AS proportion
  FROM {source} GROUP BY {c}) WHERE rank <= {limit}""" for c in columns)


QUERIES["categorical_top"] = Query(
    on("orders", lambda df: profile.categorical_statistics(df).withColumn("rank", F.col("rank").cast("bigint"))),
    top_sql("orders", ["o_orderstatus", "o_orderdate", "o_orderpriority"], 10))

QUERIES["categorical_top_gaps"] = Query(
    on("events", lambda df: profile.categorical_statistics(_with_gaps(df), ["event_type", "props"])
       .withColumn("rank", F.col("rank").cast("bigint"))),
    top_sql(GAPS_SQL, ["event_type", "props"], 10))

_EVENT_COLUMNS = ("event_id", "ts", "user_id", "event_type", "value", "props")
QUERIES["missing_summary"] = Query(
    on("events", lambda df: profile.missing_summary(_with_gaps(df))),
    "SELECT * FROM (" + union_all(
        f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS count, "
        f"round((count(*) - count({c})) * 100.0 / count(*), 2) AS percent FROM {GAPS_SQL}"
        for c in _EVENT_COLUMNS) + ") WHERE count > 0")

QUERIES["duplicate_rows"] = Query(
    on("documents", lambda df: profile.duplicate_summary(df.select("text", "lang", "source", "n_chars"))),
    """WITH d AS (SELECT count(*) AS n FROM documents),
u AS (SELECT count(*) AS n FROM (SELECT DISTINCT text, lang, source, n_chars FROM documents))
SELECT d.n - u.n AS count, round((d.n - u.n) * 100.0 / d.n, 2) AS percent FROM d, u""")

QUERIES["duplicate_rows_narrow"] = Query(
    on("lineitem", lambda df: profile.duplicate_summary(df.select("l_quantity", "l_discount", "l_returnflag"))),
    """WITH d AS (SELECT count(*) AS n FROM lineitem),
u AS (SELECT count(*) AS n FROM (SELECT DISTINCT l_quantity, l_discount, l_returnflag FROM lineitem))
SELECT d.n - u.n AS count, round((d.n - u.n) * 100.0 / d.n, 2) AS percent FROM d, u""")

_LINEITEM_COLUMNS = {**dict.fromkeys(LINEITEM_NUMBERS, "numeric"), "l_returnflag": "categorical",
                     "l_linestatus": "categorical", "l_shipdate": "datetime"}


def _type_sql(column: str) -> str:
    return (f"CASE typeof(any_value({column})) WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' "
            "WHEN 'VARCHAR' THEN 'string' ELSE 'timestamp_ntz' END")


QUERIES["column_overview"] = Query(
    on("lineitem", lambda df: profile.column_overview(df).drop("position")),
    union_all(f"SELECT '{c}' AS \"column\", {_type_sql(c)} AS type, '{k}' AS kind, count({c}) AS non_null, count(*) - count({c}) AS missing, "
              f"count(DISTINCT {c}) AS \"unique\", min({c}::VARCHAR) AS sample FROM lineitem"
              for c, k in _LINEITEM_COLUMNS.items()))

QUERIES["nested_overview"] = Query(
    on("embeddings", lambda df: profile.column_overview(df).select("column", "kind", "non_null", "missing", "unique")),
    union_all(f"SELECT '{c}' AS \"column\", '{k}' AS kind, count({c}) AS non_null, count(*) - count({c}) AS missing, "
              f"count(DISTINCT {c}) AS \"unique\" FROM embeddings"
              for c, k in (("vec_id", "numeric"), ("embedding", "categorical"), ("label", "numeric"))))

QUERIES["table_overview"] = Query(
    on("lineitem", profile.table_overview),
    """SELECT count(*) AS rows, 11::BIGINT AS columns,
       (sum(strlen(l_returnflag) + strlen(l_linestatus)) + count(*) * (3 * 8 + 4 + 4 * 8 + 8))::BIGINT AS bytes,
       8::BIGINT AS "numeric", 2::BIGINT AS categorical, 1::BIGINT AS datetime, 0::BIGINT AS "boolean" FROM lineitem""")

QUERIES["data_bytes"] = Query(
    on("documents", profile.data_bytes),
    "SELECT (sum(strlen(text) + strlen(lang) + strlen(source)) + count(*) * 16)::BIGINT AS bytes FROM documents")

QUERIES["column_catalogue"] = Query(
    on("orders", profile.column_catalogue),
    """SELECT 'o_orderkey' AS name, 'numeric' AS kind, NULL::BIGINT AS "distinct", 6::BIGINT AS total, false AS truncated
UNION ALL SELECT 'o_custkey', 'numeric', NULL, 6, false
UNION ALL SELECT 'o_totalprice', 'numeric', NULL, 6, false
UNION ALL SELECT 'o_orderstatus', 'categorical', count(DISTINCT o_orderstatus), 6, false FROM orders
UNION ALL SELECT 'o_orderpriority', 'categorical', count(DISTINCT o_orderpriority), 6, false FROM orders
UNION ALL SELECT 'o_orderdate', 'datetime', NULL, 6, false""")

QUERIES["datatype_summary"] = Query(
    on("events", lambda df: profile.datatype_summary(df).select(
        "column", "dtype", F.array_join("value_types", ",").alias("value_types"))),
    union_all(f"SELECT '{c}' AS \"column\", '{t}' AS dtype, CASE WHEN count({c}) > 0 THEN '{t}' ELSE '' END "
              f"AS value_types FROM events"
              for c, t in zip(_EVENT_COLUMNS, ("bigint", "timestamp_ntz", "bigint", "string", "double", "string"))))


def iqr_sql(source: str, columns) -> str:
    return union_all(f"""SELECT '{c}' AS "column", count(*) FILTER ({c} < lo OR {c} > hi) AS count,
       round(count(*) FILTER ({c} < lo OR {c} > hi) * 100.0 / count({c}), 2) AS percent,
       round(any_value(lo), 6) AS lower_bound, round(any_value(hi), 6) AS upper_bound
FROM {source}, (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM (
  SELECT quantile_cont({c}::DOUBLE, 0.25) AS q1, quantile_cont({c}::DOUBLE, 0.75) AS q3 FROM {source}))"""
                     for c in columns)


QUERIES["iqr_outliers"] = Query(on("lineitem", quality.iqr_outliers), iqr_sql("lineitem", LINEITEM_NUMBERS))

QUERIES["iqr_outliers_gaps"] = Query(
    on("events", lambda df: quality.iqr_outliers(_with_gaps(df), ["value", "user_id"])),
    iqr_sql(GAPS_SQL, ["value", "user_id"]))

_FENCES = """(SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM (
  SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events))"""
QUERIES["outlier_rows"] = Query(
    on("events", lambda df: quality.outlier_rows(df, "value", ["event_id"], None).select(
        "event_id", "user_id", "event_type", "value")),
    f"SELECT event_id, user_id, event_type, value FROM events, {_FENCES} WHERE value < lo OR value > hi")

QUERIES["outlier_examples"] = Query(
    on("events", lambda df: quality.outlier_rows(df, "value", ["event_id"]).select("event_id", "value")),
    f"SELECT event_id, value FROM events, {_FENCES} WHERE value < lo OR value > hi ORDER BY event_id LIMIT 10")

QUERIES["outlier_report"] = Query(
    on("events", lambda df: quality.outlier_report(df, "value")), iqr_sql("events", ["value"]))


def _typed_orders(df: DataFrame) -> DataFrame:
    """Orders with numbers and dates kept as text, an empty column and a two-valued number."""
    return df.select(
        "o_orderkey", F.col("o_totalprice").cast("string").alias("price_text"),
        F.col("o_orderdate").cast("string").alias("date_text"), "o_orderpriority",
        F.lit(None).cast("string").alias("nothing"), F.expr("o_orderkey % 2").alias("flag"))


QUERIES["datatype_issues"] = Query(
    on("orders", lambda df: quality.datatype_issues(_typed_orders(df)).select("column", "issue", "detail", "severity", "distinct")),
    """WITH t AS (SELECT o_totalprice::VARCHAR AS price_text, o_orderdate::VARCHAR AS date_text,
                  o_orderkey % 2 AS flag, count(*) OVER () AS n FROM orders)
SELECT * FROM (
SELECT 'price_text' AS "column", CASE WHEN count(TRY_CAST(price_text AS DOUBLE)) >= 0.9 * count(price_text)
         THEN 'numeric_stored_as_text' END AS issue,
         count(TRY_CAST(price_text AS DOUBLE)) || ' of ' || count(price_text) || ' values read as numbers' AS detail,
         'high' AS severity, NULL::BIGINT AS "distinct" FROM t
UNION ALL SELECT 'date_text', CASE WHEN count(TRY_CAST(date_text AS TIMESTAMP)) >= 0.7 * count(date_text)
         THEN 'date_stored_as_text' END, count(TRY_CAST(date_text AS TIMESTAMP)) || ' of ' || count(date_text) || ' values read as dates', 'medium', NULL FROM t
UNION ALL SELECT 'nothing', 'empty_column', 'none of ' || count(*) || ' rows has a value', 'high', NULL FROM t
UNION ALL SELECT 'flag', CASE WHEN count(DISTINCT flag) <= 2 THEN 'numeric_flag' END, 'no value lies between the smallest and the largest', 'low', NULL FROM t
UNION ALL SELECT 'price_text', CASE WHEN count(DISTINCT price_text) >= 0.5 * count(*) AND count(DISTINCT price_text) > 20
         THEN 'high_cardinality' END, count(DISTINCT price_text) || ' different values in ' || count(*) || ' rows', 'low', count(DISTINCT price_text) FROM t
UNION ALL SELECT 'date_text', CASE WHEN count(DISTINCT date_text) >= 0.5 * count(*) AND count(DISTINCT date_text) > 20
         THEN 'high_cardinality' END, count(DISTINCT date_text) || ' different values in ' || count(*) || ' rows', 'low', count(DISTINCT date_text) FROM t)
WHERE issue IS NOT NULL""")


def _mixed_events(df: DataFrame) -> DataFrame:
    """Events whose value is JSON of two kinds, as text and as a variant, beside JSON of one kind."""
    mixed = F.expr("case when user_id % 3 = 0 then to_json(named_struct('of', event_type)) when user_id % 3 = 1 then cast(user_id as string) end")
    return df.select("event_id", mixed.alias("mixed_text"), F.parse_json(mixed).alias("mixed_variant"), F.parse_json("props").alias("plain"), "props")


_MIXED_SQL = """SELECT CASE WHEN count(*) FILTER (user_id % 3 = 0) > 0 AND count(*) FILTER (user_id % 3 = 1) > 0 THEN 'mixed_types' END AS issue FROM events"""
QUERIES["mixed_types"] = Query(
    on("events", lambda df: quality.datatype_issues(_mixed_events(df), ["mixed_text", "props"]).where("severity = 'high'")
       .select("column", "dtype", "issue", "detail")),
    f"""SELECT c AS "column", t AS dtype, issue, 'values of several kinds: bigint, object' AS detail
FROM ({_MIXED_SQL}), (VALUES ('mixed_text', 'string'), ('mixed_variant', 'variant')) v(c, t) WHERE issue IS NOT NULL""")

QUERIES["datatype_kinds"] = Query(
    on("events", lambda df: profile.datatype_summary(_mixed_events(df)).select("column", "dtype", F.array_join("value_types", ",").alias("value_types"))),
    """SELECT c AS "column", t AS dtype, v AS value_types FROM (VALUES ('event_id', 'bigint', 'bigint'), ('mixed_text', 'string', 'string'),
  ('mixed_variant', 'variant', 'bigint,object'), ('plain', 'variant', 'object'), ('props', 'string', 'string')) x(c, t, v), (SELECT count(*) AS n FROM events) WHERE n > 0""")


def score_sql(source: str, columns, numeric) -> str:
    gaps = " + ".join(f"(count(*) - count({c}))" for c in columns)
    outliers = " + ".join(
        f"(SELECT count(*) FROM {source}, (SELECT quantile_cont({c}::DOUBLE, 0.25) AS q1, "
        f"quantile_cont({c}::DOUBLE, 0.75) AS q3 FROM {source}) "
        f"WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1))" for c in numeric)
    names = ", ".join(columns)
    return f"""WITH p AS (SELECT count(*) AS rows, ({gaps})::BIGINT AS missing_cells,
  (count(*) - (SELECT count(*) FROM (SELECT DISTINCT {names} FROM {source})))::BIGINT AS duplicate_rows,
  ({outliers})::BIGINT AS outlier_cells FROM {source})
SELECT round_even(100 * (0.55 * (1 - missing_cells / (rows * {len(columns)})) + 0.25 * (1 - duplicate_rows / rows)
       + 0.2 * (1 - outlier_cells / (rows * {len(numeric)}))), 0)::BIGINT AS score,
       rows, missing_cells, duplicate_rows, round(duplicate_rows * 100.0 / rows, 2) AS duplicate_percent, outlier_cells
FROM p"""


QUERIES["quality_score"] = Query(
    on("events", lambda df: quality.quality_score(_with_gaps(df))),
    score_sql(GAPS_SQL, _EVENT_COLUMNS, ("event_id", "user_id", "value")))

QUERIES["quality_score_lineitem"] = Query(
    on("lineitem", quality.quality_score), score_sql("lineitem", tuple(_LINEITEM_COLUMNS), LINEITEM_NUMBERS))

QUERIES["quality_verdict"] = Query(
    on("events", lambda df: quality.quality_verdict(_with_gaps(df))),
    f"""WITH s AS ({score_sql(GAPS_SQL, _EVENT_COLUMNS, ("event_id", "user_id", "value"))}),
o AS ({iqr_sql(GAPS_SQL, ["event_id", "user_id", "value"])})
SELECT score, CASE WHEN score >= 90 THEN 'excellent' WHEN score >= 70 THEN 'good' ELSE 'review' END AS verdict,
  (SELECT count(*) FROM o WHERE count > 0) AS columns_with_outliers,
  (SELECT (count(*) > count(event_type))::BIGINT + (count(*) > count(value))::BIGINT FROM {GAPS_SQL}) AS columns_with_gaps,
  (SELECT (count(DISTINCT ts) >= 0.5 * count(*))::BIGINT + (count(DISTINCT props) >= 0.5 * count(*))::BIGINT
     FROM {GAPS_SQL}) AS type_issues
FROM s""")
