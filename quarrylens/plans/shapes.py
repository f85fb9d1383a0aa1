"""Queries for distributions and correlations."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.operators import correlation, distribution
from quarrylens.plans.registry import LINEITEM_NUMBERS, Query, on, read, rounded, union_all
from quarrylens.plans.tables import GAPS_SQL, _with_gaps

QUERIES: dict[str, Query] = {}


def _far(df: DataFrame) -> DataFrame:
    """All bins of a column with a far value, summed up: rows, bins, and whether they join without a gap."""
    latest = df.agg(F.max("l_orderkey")).scalar()
    far = df.select((F.col("l_extendedprice") + F.when(F.col("l_orderkey") == latest, F.lit(1e10)).otherwise(F.lit(0.0))).alias("far"))
    rows = distribution.histogram(far, ["far"], runs=True)
    follows = F.coalesce(F.lag(F.col("bin") + F.col("bins")).over(Window.orderBy("bin")) == F.col("bin"), F.col("bin") == 0)
    return rows.withColumn("follows", follows).agg(
        F.sum("count").alias("rows"), F.sum("bins").alias("bins"), (F.sum("bins") > 1_000_000).alias("many"), F.min("follows").alias("whole"))


def histogram_sql(source: str, column: str, whole: bool) -> str:
    """Automatic bins: the smaller of the two widths, half-open, the last bin closed; values are joined to the edges."""
    least = "greatest(w, 1.0)" if whole else "w"
    return f"""SELECT * FROM (WITH f AS (
  SELECT min({column})::DOUBLE AS lo, max({column})::DOUBLE AS hi, count({column}) AS n,
    quantile_cont({column}::DOUBLE, 0.25) AS q1, quantile_cont({column}::DOUBLE, 0.75) AS q3 FROM {source}),
p AS (SELECT *, greatest(ceil((hi - lo) / {least}), 1)::BIGINT AS k FROM (
  SELECT *, CASE WHEN q3 > q1 THEN least(2 * (q3 - q1) / pow(n, 1.0 / 3), (hi - lo) / (log2(n) + 1))
            ELSE (hi - lo) / (log2(n) + 1) END AS w FROM f)),
g AS (SELECT bin, k, lo + bin * ((hi - lo) / k) AS lower, CASE WHEN bin = k - 1 THEN hi ELSE lo + (bin + 1) * ((hi - lo) / k) END AS upper
  FROM (SELECT *, unnest(range(k)) AS bin FROM p)),
c AS (SELECT g.bin, count(*) AS n FROM {source} s JOIN g ON s.{column} >= g.lower
  AND s.{column} < CASE WHEN g.bin = g.k - 1 THEN 'inf'::DOUBLE ELSE g.upper END GROUP BY 1)
SELECT '{column}' AS "column", g.bin::INTEGER AS bin, round(lower, 6) AS lower, round(upper, 6) AS upper, coalesce(c.n, 0) AS count
FROM g LEFT JOIN c ON c.bin = g.bin)"""


QUERIES["histogram_auto"] = Query(
    on("lineitem", lambda df: rounded(distribution.histogram(df, ["l_extendedprice", "l_quantity", "l_linenumber"]))),
    union_all([histogram_sql("lineitem", "l_extendedprice", False), histogram_sql("lineitem", "l_quantity", False),
               histogram_sql("lineitem", "l_linenumber", True)]))

# Values that lie on edges: hundredths.
#: A far value and narrow quartiles: millions of bins, of which a few thousand are filled.
_FAR_SQL = "(SELECT l_extendedprice + CASE WHEN l_orderkey = (SELECT max(l_orderkey) FROM lineitem) THEN 1e10 ELSE 0 END AS far FROM lineitem)"
QUERIES["histogram_far_value"] = Query(
    lambda spark, folder: _far(read(spark, folder, "lineitem")),
    f"""WITH p AS (SELECT far, min(far) OVER () AS low, max(far) OVER () AS high FROM {_FAR_SQL}),
s AS (SELECT count(*) AS n, min(far) AS low, max(far) AS high, quantile_cont(far, 0.25) AS q1, quantile_cont(far, 0.75) AS q3 FROM {_FAR_SQL}),
b AS (SELECT *, ceil((high - low) / least((high - low) / (log2(n) + 1), 2 * (q3 - q1) / pow(n, 1 / 3.0)))::BIGINT AS bins FROM s)
SELECT n AS rows, bins, (bins > 1000000) AS many, true AS whole FROM b""")

QUERIES["histogram_edges"] = Query(
    on("lineitem", lambda df: rounded(distribution.histogram(df, ["l_discount", "l_tax"]))),
    union_all([histogram_sql("lineitem", "l_discount", False), histogram_sql("lineitem", "l_tax", False)]))

QUERIES["histogram_skewed"] = Query(
    on("events", lambda df: rounded(distribution.histogram(_with_gaps(df), ["value"]))),
    histogram_sql(GAPS_SQL, "value", False))

QUERIES["histogram_by_color"] = Query(
    on("lineitem", lambda df: distribution.histogram(df, ["l_linenumber"], "l_returnflag").select(
        "color", "bin", "count")),
    """SELECT l_returnflag AS color, least(floor((l_linenumber - lo) * k / (hi - lo)), k - 1)::INTEGER AS bin, count(*) AS count
FROM lineitem, (SELECT lo, hi, ceil((hi - lo) / greatest(least(2 * (q3 - q1) / pow(n, 1.0 / 3), (hi - lo) / (log2(n) + 1)), 1.0)) AS k
  FROM (SELECT min(l_linenumber)::DOUBLE AS lo, max(l_linenumber)::DOUBLE AS hi, count(*) AS n,
          quantile_cont(l_linenumber::DOUBLE, 0.25) AS q1, quantile_cont(l_linenumber::DOUBLE, 0.75) AS q3 FROM lineitem))
GROUP BY 1, 2""")

_BOX = ("round(min({0}), 6) AS min, round(quantile_cont({0}, 0.25), 6) AS q1, round(quantile_cont({0}, 0.5), 6) AS median, "
        "round(quantile_cont({0}, 0.75), 6) AS q3, round(max({0}), 6) AS max")
_FENCE = ("round(quantile_cont({0}, 0.25) - 1.5 * (quantile_cont({0}, 0.75) - quantile_cont({0}, 0.25)), 6) AS lower_fence, "
          "round(quantile_cont({0}, 0.75) + 1.5 * (quantile_cont({0}, 0.75) - quantile_cont({0}, 0.25)), 6) AS upper_fence")

QUERIES["box"] = Query(
    on("lineitem", lambda df: rounded(distribution.box(df, ["l_extendedprice", "l_tax"]), 6)),
    union_all(f"SELECT '{c}' AS \"column\", {_BOX.format(c)} FROM lineitem" for c in ("l_extendedprice", "l_tax")))

QUERIES["box_by_group"] = Query(
    on("lineitem", lambda df: rounded(distribution.box_by_group(df, "l_extendedprice", "l_returnflag"), 6)),
    f"SELECT l_returnflag AS \"group\", {_BOX.format('l_extendedprice')}, {_FENCE.format('l_extendedprice')} "
    "FROM lineitem GROUP BY 1")

QUERIES["box_by_many_groups"] = Query(
    on("lineitem", lambda df: rounded(distribution.box_by_group(df, "l_quantity", "l_suppkey"), 6)),
    f"SELECT l_suppkey::VARCHAR AS \"group\", {_BOX.format('l_quantity')}, {_FENCE.format('l_quantity')} "
    "FROM lineitem GROUP BY l_suppkey")

QUERIES["categorical_distribution"] = Query(
    on("events", lambda df: distribution.categorical_distribution(_with_gaps(df), "event_type")),
    f"""SELECT coalesce(event_type, '(missing)') AS value, count(*) AS count,
  round(count(*) / (SELECT count(*) FROM events), 4) AS proportion
FROM {GAPS_SQL} GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 30""")

QUERIES["topk_other"] = Query(
    on("customer", lambda df: distribution.top_with_other(df, "c_nationkey")),
    """SELECT CASE WHEN rank <= 12 THEN value ELSE 'Other' END AS value, sum(n)::BIGINT AS count, rank > 12 AS is_rest FROM (
  SELECT c_nationkey::VARCHAR AS value, count(*) AS n,
         row_number() OVER (ORDER BY count(*) DESC, c_nationkey::VARCHAR) AS rank FROM customer GROUP BY 1)
GROUP BY 1, 3""")

QUERIES["topk_other_small"] = Query(
    on("part", lambda df: distribution.top_with_other(df, "p_type")),
    """SELECT CASE WHEN rank <= 12 THEN value ELSE 'Other' END AS value, sum(n)::BIGINT AS count, rank > 12 AS is_rest FROM (
  SELECT p_type AS value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, p_type) AS rank FROM part GROUP BY 1)
GROUP BY 1, 3""")

QUERIES["column_distribution"] = Query(
    on("events", lambda df: rounded(distribution.numeric_distribution(_with_gaps(df), "value"), 5)),
    f"""SELECT 'value' AS "column", count(value) AS count, round(round(avg(value), 6), 5) AS mean,
  round(round(quantile_cont(value, 0.5), 6), 5) AS median, round(round(stddev_samp(value), 6), 5) AS std, round(round(skewness(value), 6), 5) AS skewness,
  round(min(value), 5) AS min, round(round(quantile_cont(value, 0.25), 6), 5) AS q1, round(round(quantile_cont(value, 0.75), 6), 5) AS q3,
  round(max(value), 5) AS max,
  CASE WHEN abs(skewness(value)) < 0.5 THEN 'approximately symmetric'
       WHEN skewness(value) > 0 THEN 'right-skewed (a tail of high values)'
       ELSE 'left-skewed (a tail of low values)' END AS shape,
  (SELECT count(*) FROM {GAPS_SQL}, (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM {GAPS_SQL})
     WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS outliers,
  0::BIGINT AS non_finite FROM {GAPS_SQL}""")

QUERIES["column_distribution_values"] = Query(
    on("events", lambda df: distribution.distribution(_with_gaps(df), "event_type")["summary"]),
    f"SELECT count(DISTINCT event_type) AS \"unique\", count(event_type) AS total FROM {GAPS_SQL}")

_FOUR = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _nan_safe(form: str) -> str:
    return f"CASE WHEN isnan({form}) THEN NULL ELSE {form} END"


def pearson_sql(source: str, columns) -> str:
    return union_all(f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", "
                     f"count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS n, "
                     f"{_nan_safe(f'corr({a}, {b})')} AS r FROM {source}" for a, b in combinations(columns, 2))


def matrix_sql(source: str, columns) -> str:
    return f"""WITH p AS ({pearson_sql(source, columns)})
SELECT "left", "right", round(r, 6) + 0.0 AS r FROM p UNION ALL SELECT "right", "left", round(r, 6) + 0.0 FROM p
UNION ALL {union_all(f"SELECT '{c}', '{c}', CASE WHEN min({c}) < max({c}) THEN 1.0 END FROM {source}" for c in columns)}"""


QUERIES["correlation_pearson"] = Query(
    on("lineitem", lambda df: rounded(correlation.correlation_matrix(df))), matrix_sql("lineitem", LINEITEM_NUMBERS))

QUERIES["correlation_gaps"] = Query(
    on("events", lambda df: rounded(correlation.pair_table(_with_gaps(df)))),
    f"SELECT \"left\", \"right\", n, round(r, 6) + 0.0 AS r FROM ({pearson_sql(GAPS_SQL, ('event_id', 'user_id', 'value'))})")


def _related(df: DataFrame) -> DataFrame:
    """Line items with columns that follow from others, so that strong pairs exist."""
    return df.select("l_quantity", "l_extendedprice", "l_tax",
                     (F.col("l_extendedprice") * 1.09).alias("price_usd"),
                     (F.col("l_quantity") * -3 + F.col("l_tax")).alias("load"), F.lit(1).alias("fixed"))


RELATED_SQL = """(SELECT l_quantity, l_extendedprice, l_tax, l_extendedprice * 1.09::DOUBLE AS price_usd,
  l_quantity * -3 + l_tax AS load, 1 AS fixed FROM lineitem)"""
_RELATED = ("l_quantity", "l_extendedprice", "l_tax", "price_usd", "load", "fixed")

QUERIES["correlation_constant"] = Query(
    on("lineitem", lambda df: rounded(correlation.correlation_matrix(_related(df)))), matrix_sql(RELATED_SQL, _RELATED))

QUERIES["strong_pairs"] = Query(
    on("lineitem", lambda df: correlation.strong_pairs(_related(df))),
    f"""SELECT "left", "right", round(r, 4) AS value, CASE WHEN r >= 0 THEN 'positive' ELSE 'negative' END AS direction
FROM ({pearson_sql(RELATED_SQL, _RELATED)}) WHERE abs(r) >= 0.7""")

_STRENGTH = ("CASE WHEN r IS NULL THEN 'undefined' WHEN abs(r) >= 0.7 THEN 'strong' "
             "WHEN abs(r) >= 0.4 THEN 'moderate' ELSE 'weak' END AS strength")
_DIRECTION = "CASE WHEN r IS NULL THEN 'undefined' WHEN r >= 0 THEN 'positive' ELSE 'negative' END AS direction"

QUERIES["pair_relationship"] = Query(
    on("lineitem", lambda df: rounded(correlation.pair_relationship(_related(df), "l_quantity", "load"))),
    f"SELECT \"left\", \"right\", round(r, 6) AS correlation, {_STRENGTH} "
    f"FROM ({pearson_sql(RELATED_SQL, ('l_quantity', 'load'))})")

QUERIES["pair_correlation"] = Query(
    on("lineitem", lambda df: rounded(correlation.pair_correlation(df, "l_quantity", "l_extendedprice"))),
    f"SELECT \"left\", \"right\", round(r, 6) AS correlation, {_STRENGTH}, {_DIRECTION}, n AS observations "
    f"FROM ({pearson_sql('lineitem', ('l_quantity', 'l_extendedprice'))})")

QUERIES["correlation_survey"] = Query(
    on("lineitem", lambda df: rounded(correlation.correlation_survey(_related(df)))),
    f"""WITH p AS ({pearson_sql(RELATED_SQL, _RELATED)})
SELECT "left", "right", round(r, 4) + 0.0 AS correlation, {_STRENGTH}, {_DIRECTION},
  (SELECT count(*) FROM p WHERE abs(r) >= 0.7) AS strong_count
FROM p WHERE r IS NOT NULL ORDER BY abs(r) DESC, "left", "right" LIMIT 20""")


def spearman_sql(source: str, columns) -> str:
    return union_all(f"""SELECT '{a}' AS "left", '{b}' AS "right", count(*) AS n, round(corr(x, y), 6) + 0.0 AS r FROM (
  SELECT rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2 AS x,
         rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2 AS y
  FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL)""" for a, b in combinations(columns, 2))


QUERIES["correlation_spearman"] = Query(
    on("lineitem", lambda df: rounded(correlation.pair_table(df, list(LINEITEM_NUMBERS), "spearman"))),
    spearman_sql("lineitem", LINEITEM_NUMBERS))

QUERIES["correlation_spearman_gaps"] = Query(
    on("events", lambda df: rounded(correlation.pair_table(
        df.select("user_id", F.expr("case when user_id % 7 = 0 then null else value end").alias("value"), "event_id"),
        None, "spearman"))),
    spearman_sql("(SELECT user_id, CASE WHEN user_id % 7 = 0 THEN NULL ELSE value END AS value, event_id FROM events)",
                 ("user_id", "value", "event_id")))

_KENDALL = """SELECT '{a}' AS "left", '{b}' AS "right", (SELECT count(*) FROM {t}) AS n,
  round(sum(sign(l.{a} - r.{a}) * sign(l.{b} - r.{b})) /
    sqrt(sum(abs(sign(l.{a} - r.{a}))) * sum(abs(sign(l.{b} - r.{b})))), 6) AS r FROM {t} l, {t} r"""
QUERIES["correlation_kendall_supplier"] = Query(
    on("supplier", lambda df: rounded(correlation.pair_table(df, ["s_nationkey", "s_acctbal"], "kendall"))),
    _KENDALL.format(a="s_nationkey", b="s_acctbal", t="supplier"))

_FEW = ("l_linenumber", "l_quantity", "l_discount", "l_tax")
#: Columns of few values: the pairs of values are compared, each with its count.
QUERIES["correlation_kendall"] = Query(
    on("lineitem", lambda df: rounded(correlation.pair_table(df, list(_FEW), "kendall"))),
    union_all(f"""SELECT '{a}' AS "left", '{b}' AS "right", (SELECT count(*) FROM lineitem) AS n,
  round(sum(1.0 * l.c * r.c * sign(l.x - r.x) * sign(l.y - r.y)) /
    sqrt(sum(1.0 * l.c * r.c * abs(sign(l.x - r.x))) * sum(1.0 * l.c * r.c * abs(sign(l.y - r.y)))), 6) + 0.0 AS r
FROM (SELECT {a} AS x, {b} AS y, count(*) AS c FROM lineitem GROUP BY 1, 2) l, (SELECT {a} AS x, {b} AS y, count(*) AS c FROM lineitem GROUP BY 1, 2) r"""
              for a, b in combinations(_FEW, 2)))

QUERIES["correlation_kendall_customer"] = Query(
    on("customer", lambda df: rounded(correlation.pair_table(df, ["c_acctbal", "c_nationkey"], "kendall"))),
    _KENDALL.format(a="c_acctbal", b="c_nationkey", t="customer"))

QUERIES["leakage_screen"] = Query(
    on("lineitem", lambda df: rounded(correlation.leakage_screen(_related(df), "l_extendedprice"))),
    union_all(f"SELECT '{c}' AS feature, count(*) AS n, round({_nan_safe(f'corr({c}, l_extendedprice)')}, 6) + 0.0 AS r, "
              f"coalesce({_nan_safe(f'abs(corr({c}, l_extendedprice))')} >= 0.98, false) AS leaked FROM {RELATED_SQL}"
              for c in _RELATED if c != "l_extendedprice"))
