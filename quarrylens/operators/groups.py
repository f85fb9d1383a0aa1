"""Grouped aggregates, rankings and segments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylens.errors import AnalysisError
from quarrylens.functions.kinds import NUMERIC, column_kind, numeric_columns, require_columns, require_numeric
from quarrylens.functions.values import as_key, finite_column, present
from quarrylens.scale.cells import grouped_quantiles, quantile_values

OPERATIONS = ("sum", "mean", "median", "min", "max", "count")
GROUP_ROWS, SEGMENT_ROWS, SMALL_SEGMENT, SMALL_LISTED, TOP = 50, 30, 5, 10, 5

_SIMPLE = {
    "sum": lambda c: F.coalesce(F.sum(c), F.lit(0)),
    "mean": F.avg,
    "min": F.min,
    "max": F.max,
    "count": F.count,
}


def _check(df: DataFrame, metric: str, operation: str) -> None:
    if operation not in OPERATIONS:
        raise AnalysisError(f"Unsupported aggregation: {operation}")
    require_columns(df, [metric])
    if operation in ("sum", "mean", "median"):
        require_numeric(df, [metric])


def aggregate(df: DataFrame, metric: str, operation: str, group_by: str | None = None) -> DataFrame:
    """One aggregate of one metric, per group (``group_by, metric``) or over the whole table.

    The null group is a group like any other. Over the whole table the result is one tidy row:
    ``metric, operation, value``.
    """
    _check(df, metric, operation)
    if group_by is None:
        return _whole_table(df, metric, operation)
    require_columns(df, [group_by])
    if operation == "median":
        return _group_median(df, metric, group_by)
    keyed = df.select(as_key(df, group_by).alias("__g"), present(df, metric).alias("__m"))
    return keyed.groupBy("__g").agg(_SIMPLE[operation](F.col("__m")).alias("__r")).select(
        F.col("__g").alias(group_by), F.col("__r").alias(metric))


def _whole_table(df: DataFrame, metric: str, operation: str) -> DataFrame:
    if operation == "median":
        value = F.lit(quantile_values(df, [metric], [0.5])[metric].q[0]).cast("double")
        return df.sparkSession.range(1).select(
            F.lit(metric).alias("metric"), F.lit(operation).alias("operation"), value.alias("value"))
    return df.agg(_SIMPLE[operation](present(df, metric)).alias("value")).select(
        F.lit(metric).alias("metric"), F.lit(operation).alias("operation"), "value")


def _group_median(df: DataFrame, metric: str, group_by: str) -> DataFrame:
    keyed = df.select(as_key(df, group_by).alias("__g"), present(df, metric).alias("__m"))
    medians = grouped_quantiles(keyed, ["__m"], [0.5], ["__g"]).select(
        F.col("__g").alias("__mg"), F.col("q")[0].alias("__r"))
    # Groups without a usable value have no median but stay in the result.
    groups = keyed.select("__g").distinct()
    return groups.join(medians, F.col("__g").eqNullSafe(F.col("__mg")), "left").select(
        F.col("__g").alias(group_by), F.col("__r").alias(metric))


def scalar_aggregate(df: DataFrame, metric: str, operation: str) -> DataFrame:
    """``metric, operation, value, count`` over finite values only."""
    _check(df, metric, operation)
    finite_view = df.select(finite_column(df, metric).alias("__m"))
    if operation == "median":
        summary = quantile_values(df, [metric], [0.5])[metric]
        count, row = summary.count, finite_view.agg(
            F.lit(summary.q[0]).cast("double").alias("value"), F.count("__m").alias("count"))
    else:
        row = finite_view.agg(_SIMPLE[operation](F.col("__m")).alias("value"), F.count("__m").alias("count"))
        count = finite_view.where(F.col("__m").isNotNull()).limit(1).count()
    if not count:
        raise AnalysisError(f"metric: {metric} is null or NaN in every row")
    return row.select(F.lit(metric).alias("metric"), F.lit(operation).alias("operation"), "value", "count")


def group_report(df: DataFrame, metric: str, operation: str, group_by: str, limit: int = GROUP_ROWS) -> DataFrame:
    """Groups by descending metric with the total number of groups beside them."""
    table = aggregate(df, metric, operation, group_by)
    groups = table.agg(F.count("*")).scalar()
    return (table.orderBy(F.desc_nulls_last(metric), F.asc(group_by)).limit(limit)
            .select(group_by, metric, groups.alias("groups")))


def row_counts(df: DataFrame, x: str | Sequence[str]) -> DataFrame:
    """Rows per value of one or more columns, nulls kept."""
    names = [x] if isinstance(x, str) else list(x)
    require_columns(df, names)
    return df.select(*[as_key(df, n).alias(n) for n in names]).groupBy(*names).agg(F.count("*").alias("count"))


def aggregate_many(df: DataFrame, x: str | Sequence[str], metrics: Sequence[str], operation: str) -> DataFrame:
    """One aggregate of several metrics per ``x``, one column per metric."""
    names = [x] if isinstance(x, str) else list(x)
    require_columns(df, names)
    if operation == "median" or operation not in OPERATIONS:
        raise AnalysisError(f"Unsupported aggregation: {operation}")
    for metric in metrics:
        _check(df, metric, operation)
    keyed = df.select(*[as_key(df, n).alias(f"__g{i}") for i, n in enumerate(names)],
                      *[present(df, m).alias(f"__m{i}") for i, m in enumerate(metrics)])
    return (keyed.groupBy(*[f"__g{i}" for i in range(len(names))])
            .agg(*[_SIMPLE[operation](F.col(f"__m{i}")).alias(f"__r{i}") for i in range(len(metrics))])
            .select(*[F.col(f"__g{i}").alias(n) for i, n in enumerate(names)],
                    *[F.col(f"__r{i}").alias(m) for i, m in enumerate(metrics)]))


def ranking(df: DataFrame, group: str, metric: str, operation: str = "sum", limit: int = TOP,
            ascending: bool = False) -> DataFrame:
    """The first ``limit`` groups by an aggregate, with their combined share of the total.

    ``combined_share_percent`` is given for sums of a non-negative metric whose total is above
    zero, else null: a share of anything else would mislead.
    """
    require_numeric(df, [metric])
    table = aggregate(df, metric, operation, group)
    order = F.asc_nulls_last(metric) if ascending else F.desc_nulls_last(metric)
    top = table.where(F.col(metric).isNotNull()).orderBy(order, F.asc(group)).limit(limit)
    if operation != "sum":
        return top.select(group, metric, F.lit(None).cast("double").alias("combined_share_percent"))
    value = finite_column(df, metric)
    meaningful = F.when((F.sum(value) > 0) & (F.min(value) >= 0), F.sum(value))
    total = df.agg(meaningful).scalar()
    picked = top.agg(F.sum(F.col(metric).cast("double"))).scalar()
    return top.select(group, metric, F.round(picked / total * 100, 2).alias("combined_share_percent"))


def segmentation(df: DataFrame, group: str, metric: str | None = None, limit: int | None = SEGMENT_ROWS) -> DataFrame:
    """Rows and mean metric per segment, largest first, with the number of segments; all of them if ``limit`` is None.

    The metric defaults to the first numeric column; there is none when it is the group itself.
    """
    require_columns(df, [group])
    metric = metric or next(iter(numeric_columns(df)), None)
    if metric is not None and metric != group:
        require_numeric(df, [metric])
        mean: Column = F.avg("__m")
        keyed = df.select(as_key(df, group).alias("__g"), present(df, metric).cast("double").alias("__m"))
    else:
        mean = F.lit(None).cast("double")
        keyed = df.select(as_key(df, group).alias("__g"))
    table = keyed.groupBy("__g").agg(F.count("*").alias("__rows"), mean.alias("__mean"))
    segments = table.agg(F.count("*")).scalar()
    ordered = table if limit is None else table.orderBy(F.desc("__rows"), F.asc("__g")).limit(limit)
    return (ordered
            .select(F.col("__g").cast("string").alias("segment"), F.col("__rows").alias("rows"),
                    F.col("__mean").alias("mean_metric"), segments.alias("segments"),
                    (F.col("__rows") < SMALL_SEGMENT).alias("small")))


def small_segments(df: DataFrame, group: str, limit: int = SMALL_LISTED) -> DataFrame:
    """The largest of all segments with fewer than five rows."""
    report = segmentation(df, group, limit=None)
    return report.where("small").orderBy(F.desc("rows"), "segment").limit(limit).select("segment", "rows")


def welch_t_test(df: DataFrame, metric: str, group: str, left, right) -> DataFrame:
    """Welch's unequal-variance t-test of a metric between two values of a column.

    ``n_left, n_right, statistic, degrees, p_value``; missing values are left out.
    """
    from quarrylens.functions.student import two_sided_p

    require_numeric(df, [metric])
    require_columns(df, [group])
    x = present(df, metric).cast("double")
    sides = {"left": df[group] == F.lit(left), "right": df[group] == F.lit(right)}
    row = df.where(df[group].isin(left, right)).agg(*[
        f(F.when(condition, x)).alias(f"{name}_{side}") for side, condition in sides.items()
        for name, f in (("n", F.count), ("mean", F.avg), ("var", F.var_samp))])
    a = F.try_divide(F.col("var_left"), F.col("n_left"))
    b = F.try_divide(F.col("var_right"), F.col("n_right"))
    statistic = F.try_divide(F.col("mean_left") - F.col("mean_right"), F.sqrt(a + b))
    degrees = F.try_divide((a + b) * (a + b), a * a / (F.col("n_left") - 1) + b * b / (F.col("n_right") - 1))
    return (row.select("n_left", "n_right", statistic.alias("statistic"), degrees.alias("degrees"))
            .withColumn("p_value", two_sided_p(F.col("statistic"), F.col("degrees"))))


def majority_baseline(df: DataFrame, target: str) -> DataFrame:
    """The most frequent class (smallest on ties) and its share of the non-null rows."""
    require_columns(df, [target])
    counts = (df.select(present(df, target).alias("__t")).where(F.col("__t").isNotNull())
              .groupBy("__t").agg(F.count("*").alias("__n")))
    total = counts.agg(F.sum("__n")).scalar()
    return (counts.orderBy(F.desc("__n"), F.asc("__t")).limit(1)
            .select(F.col("__t").cast("string").alias("predicted_class"),
                    (F.col("__n") / total).alias("accuracy"), total.alias("rows")))


__all__ = [
    "NUMERIC", "OPERATIONS", "aggregate", "aggregate_many", "column_kind", "group_report", "majority_baseline",
    "ranking", "row_counts", "scalar_aggregate", "segmentation", "small_segments", "welch_t_test",
]
