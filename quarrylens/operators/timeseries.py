"""Trend, daily means and simple forecasts over a date column or an explicit order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.errors import AnalysisError
from quarrylens.functions.bands import movement
from quarrylens.functions.kinds import DATETIME, column_kind, first_datetime, require_kind, require_numeric
from quarrylens.functions.values import finite_column
from quarrylens.scale.even import running_before

MIN_TREND_ROWS, MIN_FORECAST_ROWS, FEW_ROWS, PERIODS = 3, 4, 20, 3
# Fixed value: proleptic ordinal of 1970-01-01, so that slopes and intercepts count days from year 1.
EPOCH_ORDINAL = 719163


def _points(df: DataFrame, time: str, metric: str) -> DataFrame:
    """Complete rows as ``ts, day, x, y`` with ``x`` the day ordinal."""
    require_kind(df, time, DATETIME)
    require_numeric(df, [metric])
    day = F.to_date(df[time])
    return (df.select(df[time].alias("ts"), day.alias("day"), F.unix_date(day).alias("x"),
                      finite_column(df, metric).alias("y"))
            .where(F.col("ts").isNotNull() & F.col("y").isNotNull()))


def _time_column(df: DataFrame, time: str | None) -> str:
    time = time or first_datetime(df)
    if time is None:
        raise AnalysisError("time: the table has no date or timestamp column to take")
    return time


def daily_mean(df: DataFrame, metric: str, time: str | None = None, limit: int | None = None) -> DataFrame:
    """``date, value``: mean per day, or the raw points when the data spans at most 3 days; the first ``limit`` if given."""
    points = _points(df, _time_column(df, time), metric)
    ends = points.agg(F.min("x").alias("first"), F.max("x").alias("last")).first()
    if ends["first"] is not None and (ends["last"] - ends["first"] or 1) > MIN_TREND_ROWS:
        table = points.groupBy(F.col("day").alias("date")).agg(F.avg("y").alias("value"))
        table = table.orderBy("date")
        return table if limit is None else table.limit(limit)
    rows = points.orderBy("ts", "y")
    rows = rows if limit is None else rows.limit(limit)
    return rows.select(F.col("day").alias("date"), F.col("y").alias("value"))


def _fit(points: DataFrame, x: str, origin: float, *more: Column) -> DataFrame:
    """Least squares of y on ``x - origin`` in one aggregate, with ``more`` figures; constant x gives nulls, constant y r2 = 0."""
    shifted = F.col(x) - F.lit(origin)
    slope = F.try_divide(F.covar_pop("y", shifted), F.var_pop(shifted))
    r = F.try_divide(F.covar_pop("y", shifted), F.stddev_pop("y") * F.stddev_pop(shifted))
    row = points.agg(slope.alias("slope"), F.avg("y").alias("my"), F.avg(shifted).alias("mx"),
                     r.alias("r"), F.count("*").alias("observations"), F.var_pop("y").alias("spread"), *more)
    return row.select("slope", (F.col("my") - F.col("slope") * F.col("mx")).alias("at_origin"),
                      F.when(F.col("spread") == 0, F.lit(0.0)).otherwise(F.col("r") * F.col("r")).alias("fit_r2"),
                      "observations", *row.columns[6:])


def trend(df: DataFrame, metric: str, time: str | None = None) -> DataFrame:
    """One row: slope per day, intercept, direction, span in days, observations."""
    time = _time_column(df, time)
    points = _points(df, time, metric)
    ends = points.agg(F.count("*").alias("n"), F.min("x").alias("first"), F.max("x").alias("last")).first()
    if ends["n"] < MIN_TREND_ROWS:
        raise AnalysisError(f"metric: {metric} and {time} are both given in {ends['n']} rows, too few to fit a line")
    first, last = ends["first"], ends["last"]
    return _fit(points, "x", first).select(
        F.lit(metric).alias("metric"), F.lit(time).alias("time_column"), F.col("slope").alias("slope_per_day"),
        (F.col("at_origin") - F.col("slope") * F.lit(float(first + EPOCH_ORDINAL))).alias("intercept"),
        movement(F.col("slope")).alias("direction"), F.lit(last - first or 1).cast("bigint").alias("span_days"),
        "observations", (F.col("observations") < FEW_ROWS).alias("few_observations"))


def _median_step(points: DataFrame, distinct_days: bool) -> DataFrame:
    """Median difference of consecutive day ordinals, from counts per day.

    A day with c rows gives c - 1 zero gaps and one gap to the next day. The window runs over
    distinct days, a table bounded by the calendar (3.7 million rows for ten thousand years).
    """
    days = points.groupBy("x").agg(F.count("*").alias("n"))
    days = days.select("n", (F.lead("x").over(Window.orderBy("x")) - F.col("x")).alias("gap"))
    gaps = days.where("gap is not null").select("gap", F.lit(1).cast("bigint").alias("times"))
    if not distinct_days:
        gaps = gaps.unionByName(days.where("n > 1").select(
            F.lit(0).alias("gap"), (F.col("n") - 1).alias("times")))
    totals = gaps.groupBy("gap").agg(F.sum("times").alias("times"))
    return totals.agg(F.percentile("gap", F.lit(0.5), F.col("times")).alias("step"))


def trend_forecast(df: DataFrame, metric: str, time: str | None = None, periods: int = PERIODS,
                   distinct_days: bool = False) -> DataFrame:
    """Extend the least-squares line over a date column by ``periods`` median steps.

    With several rows per day the median step is 0 days; ``distinct_days`` measures the step
    between days instead.
    """
    time = _time_column(df, time)
    points = _points(df, time, metric)
    ends = points.agg(F.count("*").alias("n"), F.min("x").alias("first"), F.max("x").alias("last")).first()
    if ends["n"] < MIN_FORECAST_ROWS:
        raise AnalysisError(f"metric: {ends['n']} dated values, at least {MIN_FORECAST_ROWS} are needed")
    step = _median_step(points, distinct_days).scalar()
    row = _fit(points, "x", ends["first"]).withColumn("step", step)
    ahead = F.lit(ends["last"]) + F.col("step") * F.col("period")
    return (row.withColumn("period", F.explode(F.sequence(F.lit(1), F.lit(periods))))
            .select("period", F.date_from_unix_date(F.bround(ahead, 0).cast("int")).cast("string").alias("label"),
                    (F.col("at_origin") + F.col("slope") * (ahead - F.lit(ends["first"]))).alias("forecast"),
                    "slope",
                    (F.col("at_origin") - F.col("slope") * F.lit(float(ends["first"] + EPOCH_ORDINAL))).alias("intercept"),
                    "fit_r2", movement(F.col("slope")).alias("direction"), "observations"))


def _order_value(df: DataFrame, name: str) -> Column:
    """The order in the column's own type: as doubles, whole numbers above 2^53 would be equal."""
    if column_kind(df, name) == DATETIME:
        return F.unix_micros(df[name].cast("timestamp"))
    require_numeric(df, [name])
    return df[name]


def positional_forecast(df: DataFrame, metric: str, order_by: str, periods: int = PERIODS) -> DataFrame:
    """Extend the least-squares line over positions 0..n-1 in the order of a unique column.

    Positions come from cell totals and running counts inside cells, never from one global sort.
    """
    require_numeric(df, [metric])
    rows = (df.select(F.lit(0).alias("key"), _order_value(df, order_by).alias("at"), finite_column(df, metric).alias("y"),
                      F.lit(1).cast("bigint").alias("one"))
            .where(F.col("y").isNotNull() & F.col("at").isNotNull()).withColumn("near", F.col("at").cast("double")))
    # Equal values meet in one cell, where the rows are ordered anyway.
    placed = running_before(rows, "key", "near", {"one": "x"}, order="at", equal="equal")
    line = _fit(placed, "x", 0, F.count_if("equal").alias("repeated")).first()
    if line["repeated"]:
        raise AnalysisError(f"{order_by} has equal values, so it gives no order of rows")
    n = line["observations"]
    if n < MIN_FORECAST_ROWS:
        raise AnalysisError(f"metric: {n} ordered values, at least {MIN_FORECAST_ROWS} are needed")
    figures = df.sparkSession.createDataFrame([(line["slope"], line["at_origin"], line["fit_r2"], n)],
                                              "slope double, at_origin double, fit_r2 double, observations bigint")
    ahead = F.col("observations") - 1 + F.col("period")
    return (figures.withColumn("period", F.explode(F.sequence(F.lit(1), F.lit(periods))))
            .select("period", ahead.cast("string").alias("label"),
                    (F.col("at_origin") + F.col("slope") * ahead).alias("forecast"), "slope",
                    F.col("at_origin").alias("intercept"), "fit_r2", movement(F.col("slope")).alias("direction"),
                    "observations"))


def last_value_forecast(df: DataFrame, metric: str, order_by: str, periods: int = 1) -> DataFrame:
    """``period, forecast``: the last non-missing value, repeated."""
    require_numeric(df, [metric])
    y = finite_column(df, metric)
    if df.where(y.isNotNull()).isEmpty():
        raise AnalysisError("metric: no value to carry on from")
    last = df.agg(F.max_by(y, F.when(y.isNotNull(), _order_value(df, order_by))).alias("forecast"))
    return last.select(F.explode(F.sequence(F.lit(1), F.lit(periods))).alias("period"), "forecast")


def forecast_report(df: DataFrame, metric: str, time: str | None = None, order_by: str | None = None,
                    limit: int = PERIODS) -> DataFrame:
    """The dated forecast when there is a date column, else the positional one, with caveats."""
    time = time or first_datetime(df)
    periods = max(limit, PERIODS)
    if time is not None:
        table, dated = trend_forecast(df, metric, time, periods), True
    elif order_by is not None:
        table, dated = positional_forecast(df, metric, order_by, periods), False
    else:
        raise AnalysisError("A forecast needs a date column or a column that orders the rows")
    return table.withColumn("poor_fit", F.col("fit_r2") < 0.3).withColumn("evenly_spaced", F.lit(not dated))
