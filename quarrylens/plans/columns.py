"""Queries for engineered columns, time series and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.operators import features, models, timeseries
from quarrylens.plans.registry import Query, on, read, rounded, union_all

QUERIES: dict[str, Query] = {}

QUERIES["calculated_column"] = Query(
    on("lineitem", lambda df: rounded(features.calculated_column(
        df, "net", "l_extendedprice * (1 - l_discount) / (l_quantity - 1) * 0.7182818 + l_linenumber % -4 - l_tax ** 2").select(
            "l_orderkey", "l_linenumber", "l_partkey", "net"), 4)),
    """SELECT l_orderkey, l_linenumber, l_partkey,
  round(l_extendedprice * (1 - l_discount) / nullif(l_quantity - 1, 0) * 0.7182818::DOUBLE
    + (l_linenumber - -4 * floor(l_linenumber / -4)) - pow(l_tax, 2), 4) AS net FROM lineitem""")

QUERIES["standardize"] = Query(
    on("lineitem", lambda df: rounded(features.standardize(df, "l_extendedprice").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice_z"))),
    """SELECT l_orderkey, l_linenumber, l_partkey, round((l_extendedprice - m) / s, 6) + 0.0 AS l_extendedprice_z
FROM lineitem, (SELECT avg(l_extendedprice) AS m, stddev_samp(l_extendedprice) AS s FROM lineitem)""")

QUERIES["min_max"] = Query(
    on("lineitem", lambda df: rounded(features.transform_feature(df, "l_quantity", "min_max").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity_scaled"))),
    """SELECT l_orderkey, l_linenumber, l_partkey, round((l_quantity - lo) / (hi - lo), 6) + 0.0 AS l_quantity_scaled
FROM lineitem, (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem)""")

QUERIES["log"] = Query(
    on("lineitem", lambda df: rounded(features.transform_feature(df, "l_extendedprice", "log").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice_log"))),
    "SELECT l_orderkey, l_linenumber, l_partkey, round(ln(l_extendedprice), 6) AS l_extendedprice_log FROM lineitem")

QUERIES["quantile_bin"] = Query(
    on("lineitem", lambda df: rounded(features.quantile_bins(df, "l_extendedprice", 5).groupBy(
        "l_extendedprice_bin_index", "l_extendedprice_bin_low", "l_extendedprice_bin_high").agg(
            F.count("*").alias("rows")), 4)),
    """WITH q AS (SELECT quantile_cont(l_extendedprice, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS e FROM lineitem)
SELECT i::INTEGER AS l_extendedprice_bin_index, round(e[i + 1], 4) AS l_extendedprice_bin_low,
  round(e[i + 2], 4) AS l_extendedprice_bin_high, count(*) AS rows
FROM (SELECT (l_extendedprice > e[2])::INT + (l_extendedprice > e[3])::INT + (l_extendedprice > e[4])::INT
        + (l_extendedprice > e[5])::INT AS i, e FROM lineitem, q) GROUP BY i, e""")

QUERIES["quantile_bin_labels"] = Query(
    on("lineitem", lambda df: features.quantile_bins(df, "l_quantity", 4).groupBy("l_quantity_bin", "l_quantity_bin_index").agg(F.count("*").alias("rows"))),
    """WITH q AS (SELECT list_distinct(quantile_cont(l_quantity, [0.0, 0.25, 0.5, 0.75, 1.0])) AS e FROM lineitem),
s AS (SELECT list_sort(e) AS e FROM q)
SELECT '(' || CASE WHEN i = 0 THEN (e[1] - 0.001)::DECIMAL(9, 3)::VARCHAR ELSE e[i + 1]::VARCHAR END || ', ' || e[i + 2]::VARCHAR || ']' AS l_quantity_bin,
  i::INTEGER AS l_quantity_bin_index, count(*) AS rows
FROM (SELECT len(list_filter(e[2:len(e) - 1], lambda x: l_quantity > x)) AS i, e FROM lineitem, s) GROUP BY i, e""")

QUERIES["quantile_bin_ties"] = Query(
    on("lineitem", lambda df: features.transform_feature(df, "l_linenumber", "bin", bins=10).groupBy(
        "l_linenumber_bin", "l_linenumber_bin_index").agg(F.count("*").alias("rows"))),
    """SELECT ['(0.999, 2.0]', '(2.0, 3.0]', '(3.0, 4.0]', '(4.0, 5.0]', '(5.0, 6.0]', '(6.0, 7.0]'][i + 1] AS l_linenumber_bin,
  i::INTEGER AS l_linenumber_bin_index, count(*) AS rows
FROM (SELECT greatest(l_linenumber - 2, 0) AS i FROM lineitem) GROUP BY i""")

QUERIES["frequency_encode"] = Query(
    on("orders", lambda df: rounded(features.frequency_encode(df, "o_custkey").select("o_orderkey", "o_custkey_freq"), 8)),
    """SELECT o_orderkey, round(count(*) OVER (PARTITION BY o_custkey) / count(*) OVER (), 8) AS o_custkey_freq FROM orders""")

QUERIES["frequency_encode_gaps"] = Query(
    on("events", lambda df: rounded(features.frequency_encode(
        df.withColumn("event_type", F.expr("nullif(event_type, 'error')")), "event_type").select(
            "event_id", "event_type_freq"), 8)),
    """SELECT event_id, CASE WHEN event_type <> 'error' THEN round(count(*) OVER (PARTITION BY event_type)
  / count(*) FILTER (event_type <> 'error') OVER (), 8) END AS event_type_freq FROM events""")

QUERIES["one_hot"] = Query(
    on("events", lambda df: features.one_hot_encode(
        df.withColumn("event_type", F.expr("nullif(event_type, 'error')")), "event_type", "kind").drop(
            "ts", "user_id", "event_type", "value", "props")),
    "SELECT event_id, " + ", ".join(
        f"(event_type = '{v}')::INTEGER AS kind_{v}" for v in ("click", "purchase", "signup", "view")) + " FROM events")

QUERIES["date_parts"] = Query(
    on("orders", lambda df: features.datetime_parts(df, "o_orderdate").select(
        "o_orderkey", "o_orderdate_year", "o_orderdate_month", "o_orderdate_day", "o_orderdate_weekday")),
    """SELECT o_orderkey, year(o_orderdate)::INTEGER AS o_orderdate_year, month(o_orderdate)::INTEGER AS o_orderdate_month,
  day(o_orderdate)::INTEGER AS o_orderdate_day, dayname(o_orderdate) AS o_orderdate_weekday FROM orders""")

QUERIES["date_parts_text"] = Query(
    on("orders", lambda df: features.transform_feature(
        df.select("o_orderkey", F.date_format("o_orderdate", "MM/dd/yyyy").alias("day")), "day", "datetime_parts", "d").select(
            "o_orderkey", "d_year", "d_month", "d_day", "d_weekday")),
    """SELECT o_orderkey, year(o_orderdate)::INTEGER AS d_year, month(o_orderdate)::INTEGER AS d_month,
  day(o_orderdate)::INTEGER AS d_day, dayname(o_orderdate) AS d_weekday FROM orders""")

QUERIES["column_sample"] = Query(
    on("orders", lambda df: features.column_sample(
        features.calculated_column(df, "half", "o_totalprice / 2"), "half", "o_orderkey")),
    "SELECT 'double' AS type, o_totalprice / 2 AS value FROM orders ORDER BY o_orderkey LIMIT 10")

QUERIES["daily_mean"] = Query(
    on("events", lambda df: rounded(timeseries.daily_mean(df, "value").withColumn("date", F.col("date").cast("string")), 5)),
    "SELECT (ts::DATE)::VARCHAR AS date, round(avg(value), 5) AS value FROM events GROUP BY 1 ORDER BY 1 LIMIT 200")

_LINE = """SELECT regr_slope(value, x) AS slope, regr_intercept(value, x) AS at_zero, regr_r2(value, x) AS r2,
  count(*) AS n, min(x) AS first, max(x) AS last FROM (SELECT value, (ts::DATE - DATE '2024-01-01') AS x FROM events)"""
# Day number of 2024-01-01 counted from year 1.
_ORDINAL = 738886

QUERIES["trend"] = Query(
    on("events", lambda df: rounded(timeseries.trend(df, "value"), 5, "slope_per_day", "intercept")),
    f"""SELECT 'value' AS metric, 'ts' AS time_column, round(slope, 5) AS slope_per_day,
  round(at_zero - slope * {_ORDINAL}, 5) AS intercept,
  CASE WHEN slope > 0 THEN 'increasing' WHEN slope < 0 THEN 'decreasing' ELSE 'flat' END AS direction,
  (last - first)::BIGINT AS span_days, n AS observations, n < 20 AS few_observations FROM ({_LINE})""")


def forecast_sql(step: str) -> str:
    return f"""SELECT p::INTEGER AS period, ((DATE '2024-01-01' + (last + p * ({step}))::INTEGER)::DATE)::VARCHAR AS label,
  round(at_zero + slope * (last + p * ({step})), 5) AS forecast, round(slope, 5) AS slope,
  round(at_zero - slope * {_ORDINAL}, 5) AS intercept, round(r2, 5) AS fit_r2,
  CASE WHEN slope > 0 THEN 'increasing' WHEN slope < 0 THEN 'decreasing' ELSE 'flat' END AS direction, n AS observations
FROM ({_LINE}), range(1, 4) g(p)"""


_ROW_STEP = """SELECT quantile_cont(gap, 0.5) FROM (
  SELECT (ts::DATE - lag(ts::DATE) OVER (ORDER BY ts)) AS gap FROM events) WHERE gap IS NOT NULL"""
_DAY_STEP = """SELECT quantile_cont(gap, 0.5) FROM (
  SELECT d - lag(d) OVER (ORDER BY d) AS gap FROM (SELECT DISTINCT ts::DATE AS d FROM events)) WHERE gap IS NOT NULL"""
QUERIES["trend_forecast"] = Query(
    on("events", lambda df: rounded(timeseries.trend_forecast(df, "value"), 5)), forecast_sql(_ROW_STEP))
QUERIES["trend_forecast_days"] = Query(
    on("events", lambda df: rounded(timeseries.trend_forecast(df, "value", distinct_days=True), 5)), forecast_sql(_DAY_STEP))

QUERIES["forecast_report"] = Query(
    on("events", lambda df: rounded(timeseries.forecast_report(df, "value"), 5)),
    f"SELECT *, fit_r2 < 0.3 AS poor_fit, false AS evenly_spaced FROM ({forecast_sql(_ROW_STEP)})")

QUERIES["positional_forecast"] = Query(
    on("orders", lambda df: rounded(timeseries.positional_forecast(df, "o_totalprice", "o_orderkey"), 3)),
    """SELECT p::INTEGER AS period, (n - 1 + p)::VARCHAR AS label, round(at_zero + slope * (n - 1 + p), 3) AS forecast,
  round(slope, 3) AS slope, round(at_zero, 3) AS intercept, round(r2, 3) AS fit_r2,
  CASE WHEN slope > 0 THEN 'increasing' WHEN slope < 0 THEN 'decreasing' ELSE 'flat' END AS direction, n AS observations
FROM (SELECT regr_slope(y, x) AS slope, regr_intercept(y, x) AS at_zero, regr_r2(y, x) AS r2, count(*) AS n
  FROM (SELECT o_totalprice AS y, row_number() OVER (ORDER BY o_orderkey) - 1 AS x FROM orders)), range(1, 4) g(p)""")

QUERIES["last_value"] = Query(
    on("events", lambda df: timeseries.last_value_forecast(df, "value", "event_id", 2)),
    "SELECT p::INTEGER AS period, arg_max(value, event_id) AS forecast FROM events, range(1, 3) g(p) GROUP BY p")

_SPLIT = "l_orderkey % 4 = 0"


def _regression(df: DataFrame) -> DataFrame:
    table = models.train_regression(df, ["l_quantity"], "l_extendedprice", F.expr(_SPLIT))
    return rounded(table.select(
        "target", "rows", "train_rows", "test_rows", "intercept", F.col("coefficients")["l_quantity"].alias("coefficient"),
        "strongest_feature", "r2", "rmse", "mae"), 3)


_FIT = f"""SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a,
  count(*) AS n FROM lineitem WHERE NOT ({_SPLIT})"""
QUERIES["linear_regression"] = Query(on("lineitem", _regression), f"""SELECT 'l_extendedprice' AS target,
  (SELECT count(*) FROM lineitem) AS rows, any_value(n) AS train_rows, count(*) AS test_rows,
  round(any_value(a), 3) AS intercept, round(any_value(b), 3) AS coefficient, 'l_quantity' AS strongest_feature,
  round(1 - sum(pow(l_extendedprice - a - b * l_quantity, 2)) / (var_pop(l_extendedprice) * count(*)), 3) + 0.0 AS r2,
  round(sqrt(avg(pow(l_extendedprice - a - b * l_quantity, 2))), 3) AS rmse,
  round(avg(abs(l_extendedprice - a - b * l_quantity)), 3) AS mae
FROM lineitem, ({_FIT}) WHERE {_SPLIT}""")

QUERIES["regression_report"] = Query(
    on("lineitem", lambda df: rounded(models.regression_report(
        df.withColumn("price_usd", F.col("l_extendedprice") * 1.09), "l_extendedprice", (), F.expr(_SPLIT)).select(
            "target", "rows", "train_rows", "test_rows", "verdict", F.size("coefficients").alias("features"),
            F.array_contains(F.map_keys("coefficients"), "price_usd").alias("leak_used")))),
    f"""SELECT 'l_extendedprice' AS target, count(*) AS rows, count(*) FILTER (NOT ({_SPLIT})) AS train_rows,
  count(*) FILTER ({_SPLIT}) AS test_rows, 'explains little of the variance' AS verdict, 5 AS features,
  false AS leak_used FROM lineitem""")


def _labelled(spark: SparkSession, folder: str) -> DataFrame:
    return (read(spark, folder, "labels").join(read(spark, folder, "documents").select("doc_id", "n_chars"), "doc_id")
            .withColumn("quality", F.col("quality").cast("string")))


def _fit_sql(rows: str, features: int) -> str:
    """SQL: a logistic model of ``y`` on standardised ``f0`` (and ``f1``) of the training rows, by twelve Newton steps, and its scores.

    ``rows`` selects ``name`` (the class), ``y`` (0 or 1), the features and ``key``; of each class the quarter of the smallest
    keys is held out.
    """
    at = range(features)
    terms = ["1.0", *(f"x{i}" for i in at)]
    size = features + 1
    logit = " + ".join(f"b{i} * {t}" for i, t in enumerate(terms))
    sums = ", ".join([f"sum((p - y) * {t}) AS g{i}" for i, t in enumerate(terms)] + [
        f"sum(p * (1 - p) * {a} * {b}) AS h{i}{j}" for i, a in enumerate(terms) for j, b in enumerate(terms) if i <= j])

    def h(i: int, j: int) -> str:
        i, j = min(i, j), max(i, j)
        return f"(h{i}{j} + 1)" if i == j and i else f"h{i}{j}"

    def minor(rows_: list[int], columns: list[int]) -> str:
        if not rows_:
            return "1"
        first, rest = rows_[0], rows_[1:]
        parts = [f"{'-' if k % 2 else '+'} {h(first, c)} * ({minor(rest, [x for x in columns if x != c])})" for k, c in enumerate(columns)]
        return " ".join(parts)

    every = list(range(size))
    gradient = [f"(g{i} + b{i})" if i else "g0" for i in every]
    steps = ", ".join(f"b{i} - (" + " + ".join(
        f"({'-' if (i + j) % 2 else ''}1) * ({minor([x for x in every if x != j], [x for x in every if x != i])}) * {gradient[j]}" for j in every)
        + f") / ({minor(every, every)}) AS b{i}" for i in every)
    betas = ", ".join(f"b{i}" for i in every)
    return f"""WITH RECURSIVE r AS ({rows}),
d AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY ('0x' || substr(md5(key), 1, 15))::BIGINT) <= ceil(count(*) OVER (PARTITION BY name) / 4)
  AS held FROM r),
m AS (SELECT {", ".join(f"avg(f{i}) AS m{i}, stddev_pop(f{i}) AS s{i}" for i in at)} FROM d WHERE NOT held),
t AS (SELECT name, y, held, {", ".join(f"(f{i} - m{i}) / s{i} AS x{i}" for i in at)} FROM d, m),
b AS (SELECT 0 AS step, {", ".join(f"0.0::DOUBLE AS b{i}" for i in every)} UNION ALL SELECT step + 1, {steps}
  FROM (SELECT step, {betas}, {sums} FROM (SELECT b.*, t.*, 1 / (1 + exp(-({logit}))) AS p FROM b, t WHERE NOT held AND step < 12) GROUP BY step, {betas})),
v AS (SELECT name, y, held, ({logit} > 0)::INT AS said FROM t, (SELECT * FROM b WHERE step = 12)),
k AS (SELECT y, count(*) AS here, count(*) FILTER (said = y) AS hit, (SELECT count(*) FROM v AS o WHERE o.held AND o.said = v.y) AS told
  FROM v WHERE held GROUP BY y),
w AS (SELECT sum(here) AS test_rows, sum(hit) / sum(here) AS accuracy, sum(here * CASE WHEN told > 0 THEN hit / told ELSE 0 END) / sum(here) AS precision,
    sum(hit) / sum(here) AS recall, sum(here * CASE WHEN hit > 0 THEN 2.0 * hit / (told + here) ELSE 0 END) / sum(here) AS f1 FROM k),
c AS (SELECT count(*) AS rows, count(*) FILTER (NOT held) AS train_rows FROM d),
z AS (SELECT max(n) / sum(n) AS baseline FROM (SELECT count(*) AS n FROM d GROUP BY name))"""


_QUALITY_SQL = _fit_sql("""SELECT quality::VARCHAR AS name, quality AS y, n_chars::DOUBLE AS f0, doc_id::VARCHAR AS key
  FROM labels JOIN documents USING (doc_id)""", 1)
_STATUS_SQL = _fit_sql("""SELECT l_linestatus AS name, (l_linestatus = 'O')::INT AS y, l_quantity::DOUBLE AS f0, l_tax::DOUBLE AS f1,
  l_orderkey::VARCHAR || '|' || l_linenumber::VARCHAR AS key FROM lineitem""", 2)

QUERIES["logistic_classification"] = Query(
    lambda spark, folder: rounded(models.train_classifier(_labelled(spark, folder), ["n_chars"], "quality", keys=["doc_id"]).select(
        "model", "target", "classes", "rows", "train_rows", "test_rows", "accuracy", "precision", "recall", "f1",
        "strongest_feature", "baseline_accuracy", "beats_baseline", F.round(F.col("feature_importance")["n_chars"], 3).alias("importance"))),
    f"""{_QUALITY_SQL}
SELECT 'logistic_regression' AS model, 'quality' AS target, ['0', '1'] AS classes, rows, train_rows, test_rows::BIGINT AS test_rows,
  round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
  'n_chars' AS strongest_feature, round(baseline, 6) AS baseline_accuracy, accuracy > baseline AS beats_baseline,
  (SELECT round(abs(b1), 3) FROM b WHERE step = 12) AS importance FROM w, c, z""")

QUERIES["classifier_parts"] = Query(
    on("lineitem", lambda df: models.train_classifier(df, ["l_quantity", "l_tax"], "l_returnflag",
                                                      keys=["l_orderkey", "l_linenumber"]).select("classes", "rows", "train_rows", "test_rows")),
    """SELECT list(c ORDER BY c) AS classes, sum(n)::BIGINT AS rows, sum(n - ceil(n / 4))::BIGINT AS train_rows, sum(ceil(n / 4))::BIGINT AS test_rows
FROM (SELECT l_returnflag AS c, count(*) AS n FROM lineitem GROUP BY 1)""")

QUERIES["logistic_baseline"] = Query(
    lambda spark, folder: rounded(models.train_classifier(
        _labelled(spark, folder), ["n_chars"], "quality", F.expr("doc_id % 4 = 0")).select(
            "rows", "train_rows", "test_rows", "baseline_accuracy")),
    """SELECT count(*) AS rows, count(*) FILTER (doc_id % 4 <> 0) AS train_rows, count(*) FILTER (doc_id % 4 = 0) AS test_rows,
  round(greatest(avg(quality), 1 - avg(quality)), 6) AS baseline_accuracy
FROM labels JOIN documents USING (doc_id)""")

QUERIES["classification_report"] = Query(
    on("lineitem", lambda df: models.classification_report(df, "l_linestatus", ["l_quantity", "l_tax"], keys=["l_orderkey", "l_linenumber"]).select(
        "target", "rows", "train_rows", "test_rows", "accuracy", "baseline_accuracy", "verdict")),
    f"""{_STATUS_SQL}
SELECT 'l_linestatus' AS target, rows, train_rows, test_rows::BIGINT AS test_rows, round(accuracy, 4) AS accuracy,
  round(baseline, 4) AS baseline_accuracy, CASE WHEN accuracy > baseline THEN 'ahead of the majority-class baseline'
    ELSE 'at or below the majority-class baseline' END AS verdict FROM w, c, z""")

QUERIES["feature_choice"] = Query(
    on("lineitem", lambda df: df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(c) for c in models.choose_features(
        df.withColumn("price_usd", F.col("l_extendedprice") * 1.09), "l_extendedprice")[0]])).alias("feature"))),
    union_all(f"SELECT '{c}' AS feature" for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")))
