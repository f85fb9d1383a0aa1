"""Operators that add engineered columns to a table."""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylens.errors import AnalysisError
from quarrylens.functions.formulas import formula_column
from quarrylens.functions.kinds import DATETIME, kind_of, require_columns, require_numeric
from quarrylens.functions.values import as_text, present, to_timestamp
from quarrylens.scale.cells import quantile_values
from quarrylens.scale.lookups import attach

MAX_CATEGORIES, MIN_BINS, MAX_BINS, DEFAULT_BINS, SAMPLE_VALUES = 40, 2, 20, 4, 10
# Weekday names, Monday first, and the accepted form of a new column name.
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
NAME_FORM = r"^[A-Za-z_][A-Za-z0-9_]*$"


def _new_name(df: DataFrame, name: str) -> str:
    if name in df.columns:
        raise AnalysisError(f"name: {name} already exists in the table")
    return name


def calculated_column(df: DataFrame, name: str, formula: str) -> DataFrame:
    """Add a column computed from an arithmetic formula over existing columns."""
    if not re.match(NAME_FORM, name):
        raise AnalysisError(f"'{name}' is not a usable column name")
    _new_name(df, name)
    return df.withColumn(name, formula_column(df, formula))


def standardize(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    """Add ``(x - mean) / sample standard deviation``; a zero deviation gives 0."""
    require_numeric(df, [column])
    x = present(df, column).cast("double")
    stats = df.agg(F.struct(F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"))).scalar()
    return df.withColumn(_new_name(df, name or f"{column}_z"), _scaled(x, stats["mean"], stats["std"]))


def min_max_scale(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    """Add ``(x - min) / (max - min)``; a zero range gives 0."""
    require_numeric(df, [column])
    x = present(df, column).cast("double")
    stats = df.agg(F.struct(F.min(x).alias("low"), (F.max(x) - F.min(x)).alias("range"))).scalar()
    return df.withColumn(_new_name(df, name or f"{column}_scaled"), _scaled(x, stats["low"], stats["range"]))


def _scaled(x: Column, origin: Column, unit: Column) -> Column:
    return F.when(unit == 0, x * 0).otherwise(F.try_divide(x - origin, unit))


def log_transform(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    """Add the natural logarithm; an error when any value is zero or below."""
    require_numeric(df, [column])
    target = _new_name(df, name or f"{column}_log")
    if not df.where(df[column] <= 0).isEmpty():
        raise AnalysisError(f"column: the smallest value of {column} is not positive and has no logarithm")
    return df.withColumn(target, F.ln(present(df, column).cast("double")))


def _short(x: float, digits: int) -> float:
    """Rounded to ``digits`` decimals, or that many significant ones for a pure fraction."""
    if x == 0 or not math.isfinite(x):
        return x
    if abs(x) < 1:
        digits += -math.floor(math.log10(abs(x))) - 1
    return float(np.round(x, digits))


def bin_labels(edges: list[float]) -> list[str]:
    """``(low, high]`` texts: at least 3 decimals, more when edges would look alike."""
    digits = next((d for d in range(3, 20) if len({_short(e, d) for e in edges}) == len(edges)), 3)
    shown = [_short(e, digits) for e in edges]
    shown[0] -= 10.0 ** -digits
    return [f"({low}, {high}]" for low, high in zip(shown, shown[1:])]


def quantile_bins(df: DataFrame, column: str, bins: int = DEFAULT_BINS, name: str | None = None) -> DataFrame:
    """Add a quantile bin: label, index and both edges. Equal edges merge; missing stays missing."""
    require_numeric(df, [column])
    if not MIN_BINS <= bins <= MAX_BINS:
        raise AnalysisError(f"bins must lie between {MIN_BINS} and {MAX_BINS}")
    target = _new_name(df, name or f"{column}_bin")
    # As percentages and back: the last digit of an edge decides on which side a value equal to it falls.
    quantiles = quantile_values(df, [column], [i / bins * 100 / 100 for i in range(bins + 1)])[column].q
    edges = sorted({e for e in quantiles if e is not None})
    if len(edges) < 2:
        raise AnalysisError(f"bins: {column} has too few distinct values for {bins}")
    x = present(df, column).cast("double")
    index = F.when(x.between(edges[0], edges[-1]),
                   sum(((x > e).cast("int") for e in edges[1:-1]), F.lit(0)))
    place = F.col(f"{target}_index")
    return (df.withColumn(f"{target}_index", index)
            .withColumn(target, F.get(F.array(*[F.lit(t) for t in bin_labels(edges)]), place))
            .withColumn(f"{target}_low", F.get(F.array(*[F.lit(e) for e in edges[:-1]]), place))
            .withColumn(f"{target}_high", F.get(F.array(*[F.lit(e) for e in edges[1:]]), place)))


def frequency_encode(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    """Add each value's share of the non-missing rows; frequent values are joined by broadcast."""
    require_columns(df, [column])
    target = _new_name(df, name or f"{column}_freq")
    keyed = df.withColumn("__key", as_text(df, column))
    counts = keyed.where(F.col("__key").isNotNull()).groupBy("__key").agg(F.count("*").alias("__n"))
    total = counts.agg(F.sum("__n").alias("n")).first()["n"] or 0
    table = counts.withColumn(target, F.col("__n") / F.lit(max(total, 1)))
    return attach(keyed, table, ["__key"], "__n", total, [target]).drop("__key")


def one_hot_encode(df: DataFrame, column: str, prefix: str | None = None) -> DataFrame:
    """Add one 0/1 column per value, in value order; at most 40 values, missing is all zeros."""
    require_columns(df, [column])
    value = present(df, column)
    distinct = (df.select(value.alias("v")).where(F.col("v").isNotNull()).distinct()
                .orderBy("v").limit(MAX_CATEGORIES + 1).collect())
    if len(distinct) > MAX_CATEGORIES:
        raise AnalysisError(f"column: {column} would become over {MAX_CATEGORIES} indicator columns")
    names = [_new_name(df, f"{prefix or column}_{row['v']}") for row in distinct]
    return df.select("*", *[
        F.coalesce((value == F.lit(row["v"])).cast("int"), F.lit(0)).alias(n) for n, row in zip(names, distinct)])


def datetime_parts(df: DataFrame, column: str, prefix: str | None = None) -> DataFrame:
    """Add year, month, day and weekday name; an error when no value is a date."""
    require_columns(df, [column])
    data_type = df.schema[column].dataType
    if kind_of(data_type) == DATETIME:
        stamp = df[column]
    elif isinstance(data_type, T.StringType):
        stamp = to_timestamp(df[column])
    else:
        raise AnalysisError(f"column: no value of {column} can be parsed to a date")
    names = [_new_name(df, f"{prefix or column}_{part}") for part in ("year", "month", "day", "weekday")]
    if df.where(stamp.isNotNull()).isEmpty():
        raise AnalysisError(f"column: no value of {column} can be parsed to a date")
    parts = (F.year(stamp), F.month(stamp), F.dayofmonth(stamp),
             F.get(F.array(*[F.lit(d) for d in WEEKDAYS]), F.weekday(stamp)))
    return df.select("*", *[part.alias(n) for n, part in zip(names, parts)])


TRANSFORMS = {
    "standardize": standardize, "min_max": min_max_scale, "log": log_transform, "frequency": frequency_encode,
    "one_hot": one_hot_encode, "datetime_parts": datetime_parts,
}


def transform_feature(df: DataFrame, column: str, transform: str, name: str | None = None,
                      bins: int = DEFAULT_BINS) -> DataFrame:
    """Apply a transform by its name."""
    require_columns(df, [column])
    if name is not None and not re.match(NAME_FORM, name):
        raise AnalysisError(f"'{name}' is not a usable column name")
    if transform == "bin":
        return quantile_bins(df, column, bins, name)
    if transform not in TRANSFORMS:
        raise AnalysisError(f"Unsupported transform: {transform}")
    return TRANSFORMS[transform](df, column, name)


def new_columns(before: DataFrame, after: DataFrame) -> list[str]:
    return [c for c in after.columns if c not in before.columns]


def column_sample(df: DataFrame, column: str, order_by: str, limit: int = SAMPLE_VALUES) -> DataFrame:
    """The first values of a column in a given order, missing ones kept, beside its type."""
    require_columns(df, [column, order_by])
    return (df.orderBy(order_by).limit(limit)
            .select(F.lit(df.schema[column].dataType.simpleString()).alias("type"), F.col(column).alias("value")))
