"""Chart-ready tables: figures per group, bin or pair, and the points themselves for scatter and raw line charts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.errors import AnalysisError
from quarrylens.functions.kinds import require_columns, require_numeric
from quarrylens.functions.values import as_key, as_text, finite_column
from quarrylens.operators.correlation import correlation_matrix
from quarrylens.operators.distribution import box_by_group, histogram
from quarrylens.operators.groups import aggregate_many, row_counts

# Chart types, aggregations, and which types need which axis.
CHART_TYPES = ("bar", "line", "scatter", "histogram", "box", "pie", "heatmap")
AGGREGATIONS = ("none", "sum", "mean", "count", "min", "max")
NEEDS_X = ("bar", "line", "scatter", "histogram", "pie")
NEEDS_Y = ("line", "scatter")


def check_request(df: DataFrame, chart_type: str, x: str | None, y: Sequence[str], columns: Sequence[str],
                  aggregation: str, color: str | None) -> None:
    """Raise for unknown columns, types and aggregations, and for a missing axis."""
    require_columns(df, [x, color, *y, *columns])
    if chart_type not in CHART_TYPES:
        raise AnalysisError(f"chart_type: {chart_type} is not a known one")
    if aggregation not in AGGREGATIONS:
        raise AnalysisError(f"aggregation: {aggregation} is not a known one")
    if chart_type == "heatmap":
        return
    if x is None and (chart_type in NEEDS_X or aggregation != "none"):
        raise AnalysisError(f"x: missing for {chart_type}")
    if not y and chart_type in NEEDS_Y and aggregation == "none":
        raise AnalysisError(f"y: missing for {chart_type}")
    if not y and aggregation not in ("none", "count"):
        raise AnalysisError(f"y: missing for {aggregation}")
    if chart_type == "pie" and not y and aggregation == "none":
        raise AnalysisError("y: a pie without one can only count")


def chart_table(df: DataFrame, chart_type: str, x: str | None = None, y: str | Sequence[str] | None = None,
                columns: Sequence[str] = (), aggregation: str = "none", color: str | None = None,
                keys: Sequence[str] = ()) -> DataFrame:
    """The rows behind one chart request. ``keys`` orders the points of a scatter chart that is given a limit."""
    series = [y] if isinstance(y, str) else list(y or ())
    check_request(df, chart_type, x, series, columns, aggregation, color)
    if chart_type == "heatmap":
        return heatmap_table(df, columns)
    if aggregation != "none":
        table = series_table(df, x, series, aggregation, color)
        return _shares(table) if chart_type == "pie" else table
    if chart_type == "pie":
        return _shares(series_table(df, x, series, "sum", None))
    if chart_type == "histogram":
        return histogram(df, [x], color)
    if chart_type == "box":
        return box_by_group(df, series[0] if series else x, x if series else None)
    if chart_type == "bar" and not series:
        return series_table(df, x, [], "count", color)
    if chart_type == "scatter":
        return scatter_table(df, x, series, keys, color)
    if chart_type == "line":
        return point_table(df, x, series, color)
    # Bars of one x stack: their height is the sum.
    return series_table(df, x, series, "sum", color)


def series_table(df: DataFrame, x: str, y: Sequence[str], aggregation: str, color: str | None = None) -> DataFrame:
    """``x[, color], series, value``: one row per x, color and metric."""
    names = [x] if color is None or color == x else [x, color]
    if aggregation == "count":
        metrics, table = ["count"], row_counts(df.select(*names), names)
    else:
        require_numeric(df, y)
        metrics, table = list(y), aggregate_many(df, names, y, aggregation)
    ids = ["x"] if len(names) == 1 else ["x", "color"]
    wide = table.toDF(*ids, *[f"__s{i}" for i in range(len(metrics))])
    label = F.array(*[F.lit(m) for m in metrics])[F.substring("__series", 4, 9).cast("int")]
    return (wide.select(*ids, *[F.col(f"__s{i}").cast("double").alias(f"__s{i}") for i in range(len(metrics))])
            .unpivot(ids, [f"__s{i}" for i in range(len(metrics))], "__series", "value")
            .select(*ids, label.alias("series"), "value"))


def point_table(df: DataFrame, x: str, y: Sequence[str], color: str | None = None) -> DataFrame:
    """``x[, color], series, value``: every row's point of every metric; equal points stay apart."""
    require_numeric(df, y)
    ids = [as_key(df, x).alias("x"), *([] if color is None or color == x else [as_text(df, color).alias("color")])]
    named = F.array(*[F.struct(F.lit(c).alias("series"), finite_column(df, c).alias("value")) for c in y])
    points = df.select(*ids, F.explode(named).alias("__point"))
    return points.select(*points.columns[:-1], "__point.series", "__point.value")


def _shares(table: DataFrame) -> DataFrame:
    """Shares within each metric; the table holds one row per slice and metric."""
    totals = table.groupBy("series").agg(F.sum("value").alias("__total"))
    return table.join(totals, "series").select("x", "series", "value", F.try_divide("value", "__total").alias("share"))


def scatter_table(df: DataFrame, x: str, y: Sequence[str], keys: Sequence[str] = (), color: str | None = None,
                  limit: int | None = None) -> DataFrame:
    """All points; with ``limit``, that many, chosen by a hash so that the choice does not depend on row order.

    ``keys`` names the columns that identify a row; without them the plotted values are hashed.
    """
    require_columns(df, [x, color, *y, *keys])
    chosen = F.xxhash64(*[df[k] for k in (keys or [x, *y])])
    ties = [as_key(df, k).alias(f"__k{i}") for i, k in enumerate(keys or [x, *y])]
    shown = [as_key(df, x).alias("x"), *[finite_column(df, c).alias(c if c != x else f"{c}_y") for c in y],
             *([] if color is None else [as_text(df, color).alias("color")])]
    if limit is None:
        return df.select(*shown)
    picked = df.select(*shown, chosen.alias("__order"), *ties).orderBy("__order", *[f"__k{i}" for i in range(len(ties))])
    return picked.limit(limit).drop("__order", *[f"__k{i}" for i in range(len(ties))])


def heatmap_table(df: DataFrame, columns: Sequence[str] = ()) -> DataFrame:
    """The Pearson matrix of the chosen, or all, numeric columns."""
    if columns:
        return correlation_matrix(df.select(*columns))
    return correlation_matrix(df)
