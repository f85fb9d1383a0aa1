"""Histograms, box figures and value distributions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylens.errors import AnalysisError
from quarrylens.functions.bands import shape
from quarrylens.functions.kinds import NUMERIC, column_kind, numeric_columns, require_columns, require_numeric
from quarrylens.functions.values import as_text, finite_column, missing, present, tidy
from quarrylens.operators.profile import numeric_statistics, quartiles
from quarrylens.operators.quality import iqr_outliers
from quarrylens.scale.cells import COLUMN, VALUE, Summary, grouped_quantiles, name_of, numbers_long, quantile_values
from quarrylens.scale.longform import MISSING_LABEL

DISTRIBUTION_VALUES, TOP_CATEGORIES, OTHER = 30, 12, "Other"
BOX_PROBS = (0.0, 0.25, 0.5, 0.75, 1.0)
#: A longer run of empty bins is one row of a histogram, from the lower edge of its first to the upper edge of its last bin.
LONG_RUN = 10_000


def automatic_bins(s: Summary, whole_numbers: bool) -> tuple[float, float, int]:
    """``(low, high, bins)`` by the smaller of the Freedman-Diaconis and Sturges widths.

    ``s.q`` begins and ends with the outer quartiles. Whole-number columns get bins at least 1 wide; a
    constant column gets one bin around its value.
    """
    if s.low == s.high:
        return s.low - 0.5, s.high + 0.5, 1
    span = s.high - s.low
    width = span / (math.log2(s.count) + 1)
    spread = 2 * (s.q[-1] - s.q[0]) / s.count ** (1 / 3)
    if spread > 0:
        width = min(width, spread)
    if whole_numbers:
        width = max(width, 1.0)
    bins = max(math.ceil(span / width), 1)
    return s.low, s.high, bins


def _is_whole(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.IntegralType)


def histogram(df: DataFrame, columns: Sequence[str] | None = None, color: str | None = None, runs: bool = False,
              summaries: dict[str, Summary] | None = None) -> DataFrame:
    """``column[, color], bin, lower, upper, count`` for every automatic bin, empty ones included.

    Bins are half-open, the last one closed. Edges come from one pass of order statistics, the
    counts of all columns from one further grouped scan. With ``color`` the edges are shared and empty bins are left out.

    Only filled bins are ever counted and ordered, so far values may call for any number of bins: a run of more than LONG_RUN
    empty ones is one row. With ``runs`` every run of empty bins is one row, and ``bins`` says how many bins a row stands for.
    """
    columns = list(columns) if columns is not None else numeric_columns(df)
    require_columns(df, [*columns, color])
    summaries = summaries or quantile_values(df, columns, (0.25, 0.75))
    bins = {i: automatic_bins(summaries[c], _is_whole(df, c)) for i, c in enumerate(columns) if summaries[c].count}
    number = "bigint" if any(b[2] > 2**31 - 1 for b in bins.values()) else "int"
    if not bins:
        colors = "" if color is None else "color string, "
        return df.sparkSession.createDataFrame(
            [], f"column string, {colors}bin int, lower double, upper double, count bigint" + (", bins bigint" if runs else ""))
    plan = df.sparkSession.createDataFrame(
        [(i, *b) for i, b in bins.items()], f"{COLUMN} int, low double, high double, all_bins bigint")
    by = [] if color is None else ["__color"]
    source = df if color is None else df.withColumn("__color", as_text(df, color))
    # One row per column: bounded by the schema.
    placed = numbers_long(source, columns, by).join(F.broadcast(plan), COLUMN)
    step, last = (F.col("high") - F.col("low")) / F.col("all_bins"), F.col("all_bins") - 1
    guess = F.least(F.floor((F.col(VALUE) - F.col("low")) / step), last).cast("bigint")
    # The division may round across an edge: the edges shown decide.
    index = (guess + F.when(F.col(VALUE) < F.col("low") + guess * step, -1)
             .when((guess < last) & (F.col(VALUE) >= F.col("low") + (guess + 1) * step), 1).otherwise(0))
    counts = placed.groupBy(*by, COLUMN, index.alias("bin")).agg(F.count("*").alias("count")).join(F.broadcast(plan), COLUMN)
    if color is None:
        # The smallest value lies in the first bin and the greatest in the last, so gaps are between filled bins.
        gap = F.coalesce(F.lead("bin").over(Window.partitionBy(COLUMN).orderBy("bin")), F.col("all_bins")) - F.col("bin") - 1
        empty = F.struct((F.col("bin") + 1).alias("bin"), F.col("gap").alias("bins"), F.lit(0).cast("bigint").alias("count"))
        filled = F.struct("bin", F.lit(1).cast("bigint").alias("bins"), "count")
        counts = counts.withColumn("gap", gap).select(COLUMN, "low", "high", "all_bins", F.inline(
            F.when(F.col("gap") > 0, F.array(filled, empty)).otherwise(F.array(filled))))
        if not runs:
            apart = (F.col("bins") > 1) & (F.col("bins") <= LONG_RUN)
            each = F.when(apart, F.sequence(F.col("bin"), F.col("bin") + F.col("bins") - 1)).otherwise(F.array("bin"))
            counts = counts.select(COLUMN, "low", "high", "all_bins", "count", F.when(apart, 1).otherwise(F.col("bins")).alias("bins"), F.explode(each).alias("bin"))
    else:
        counts = counts.withColumn("bins", F.lit(1).cast("bigint"))
    after = F.col("bin") + F.col("bins")
    upper = F.when(after == F.col("all_bins"), F.col("high")).otherwise(F.col("low") + after * step)
    return counts.select(name_of(columns).alias("column"), *([] if color is None else [F.col("__color").alias("color")]), F.col("bin").cast(number).alias("bin"),
                         (F.col("low") + F.col("bin") * step).alias("lower"), upper.alias("upper"), "count", *(["bins"] if runs else []))


def box(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``column, min, q1, median, q3, max`` of the finite values."""
    columns = list(columns) if columns is not None else numeric_columns(df)
    rows = [(c, *s.q) for c, s in quantile_values(df, columns, BOX_PROBS).items()]
    return df.sparkSession.createDataFrame(
        rows, "column string, min double, q1 double, median double, q3 double, max double")


def box_by_group(df: DataFrame, value: str, by: str | None = None) -> DataFrame:
    """Box figures of a numeric column per value of another, with 1.5 x IQR fences."""
    require_numeric(df, [value])
    if by is None:
        table = box(df, [value]).withColumnRenamed("column", "group")
    else:
        require_columns(df, [by])
        keyed = df.select(as_text(df, by).alias("__g"), present(df, value).alias("__v"))
        q = grouped_quantiles(keyed, ["__v"], BOX_PROBS, ["__g"])
        table = q.select(F.col("__g").alias("group"), *[
            F.col("q")[i].alias(n) for i, n in enumerate(("min", "q1", "median", "q3", "max"))])
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    return table.select("*", (F.col("q1") - reach).alias("lower_fence"), (F.col("q3") + reach).alias("upper_fence"))


def _labelled_counts(df: DataFrame, column: str) -> DataFrame:
    label = F.coalesce(as_text(df, column), F.lit(MISSING_LABEL))
    return df.groupBy(label.alias("value")).agg(F.count("*").alias("count"))


def categorical_distribution(df: DataFrame, column: str, limit: int = DISTRIBUTION_VALUES) -> DataFrame:
    """``value, count, proportion`` of the most frequent values; missing cells count as a value."""
    require_columns(df, [column])
    counts = _labelled_counts(df, column)
    rows = counts.agg(F.sum("count")).scalar()
    return (counts.orderBy(F.desc("count"), F.asc("value")).limit(limit)
            .select("value", "count", F.round(F.col("count") / rows, 4).alias("proportion")))


def top_with_other(df: DataFrame, column: str, limit: int = TOP_CATEGORIES) -> DataFrame:
    """``value, count, is_rest``: the most frequent values, and one row ``Other`` for everything else.

    ``is_rest`` tells that row from a value that happens to be spelled the same.

    The top values are taken first (a bounded top-k), the rest is the difference to the row count.
    """
    require_columns(df, [column])
    counts = _labelled_counts(df, column)
    top = counts.orderBy(F.desc("count"), F.asc("value")).limit(limit).withColumn("is_rest", F.lit(False))
    shown = top.agg(F.sum("count")).scalar()
    rest = (df.agg(F.count("*").alias("rows"))
            .select(F.lit(OTHER).alias("value"), (F.col("rows") - F.coalesce(shown, F.lit(0))).alias("count"),
                    F.lit(True).alias("is_rest"))
            .where(F.col("count") > 0))
    return top.unionByName(rest)


def numeric_distribution(df: DataFrame, column: str, summaries: dict[str, Summary] | None = None) -> DataFrame:
    """One row about a numeric column: moments, box, shape words, outliers and non-finite cells."""
    require_numeric(df, [column])
    known = summaries or quartiles(df, [column])
    low, q1, q3, high = known[column].low, known[column].q[0], known[column].q[2], known[column].high
    if low is None:
        raise AnalysisError(f"column: {column} holds no finite number")
    stats = numeric_statistics(df, [column], known)
    outliers = iqr_outliers(df, [column], known).select("count").scalar()
    dropped = df.agg(F.count(present(df, column)) - F.count(finite_column(df, column))).scalar()
    return stats.select(
        "column", "count", "mean", "median", "std", "skewness", *[
            tidy(F.lit(v).cast("double")).alias(n)
            for n, v in (("min", low), ("q1", q1), ("q3", q3), ("max", high))],
        shape(F.col("skewness")).alias("shape"), outliers.alias("outliers"), dropped.alias("non_finite"))


def distribution(df: DataFrame, column: str) -> dict[str, DataFrame]:
    """The report on one column, by its kind.

    Numeric: ``summary`` and ``histogram``. Everything else: ``values`` and a ``summary`` with the
    distinct and non-missing counts.
    """
    if column_kind(df, column) == NUMERIC:
        known = quartiles(df, [column])
        return {"summary": numeric_distribution(df, column, known), "histogram": histogram(df, [column], summaries=known)}
    cells = df.select(as_text(df, column).alias("v"), missing(df, column).alias("gone"))
    summary = (cells.groupBy("v").agg(F.count_if(~F.col("gone")).alias("n"))
               .agg(F.count_if(F.col("n") > 0).alias("unique"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")))
    return {"summary": summary, "values": categorical_distribution(df, column)}
