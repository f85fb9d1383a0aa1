"""Cleaning of single values, written as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylens.functions.kinds import CATEGORICAL, DATETIME, NUMERIC, is_nested, kind_of

# Text forms that count as a missing cell in a delimited file.
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Parts of a column name that hint at dates, when loading and when checking types.
LOAD_DATE_TOKENS = ("date", "time", "created", "updated")
CHECK_DATE_TOKENS = ("date", "time", "created", "updated", "timestamp")

# The text forms accepted as a date or timestamp, ISO forms apart, each with its shape.
DATE_FORMATS = {
    "M/d/yyyy": r"^\d{1,2}/\d{1,2}/\d{4}$",
    "M/d/yyyy H:mm": r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}$",
    "M/d/yyyy H:mm:ss": r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2}$",
    "yyyy/M/d": r"^\d{4}/\d{1,2}/\d{1,2}$",
    "yyyy/M/d H:mm:ss": r"^\d{4}/\d{1,2}/\d{1,2} \d{1,2}:\d{2}:\d{2}$",
    "d-MMM-yyyy": r"^\d{1,2}-[A-Za-z]{3}-\d{4}$",
    "d MMM yyyy": r"^\d{1,2} [A-Za-z]{3} \d{4}$",
    "MMM d, yyyy": r"^[A-Za-z]{3} \d{1,2}, \d{4}$",
    "MMMM d, yyyy": r"^[A-Za-z]{4,9} \d{1,2}, \d{4}$",
    "yyyyMMdd": r"^\d{8}$",
}

_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def is_real(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.FloatType, T.DoubleType))


def missing(df: DataFrame, name: str) -> Column:
    """True where the cell is null, or NaN in a floating column."""
    column = df[name]
    if is_real(df.schema[name].dataType):
        return column.isNull() | F.isnan(column)
    return column.isNull()


def present(df: DataFrame, name: str) -> Column:
    """The cell, with NaN turned into null."""
    column = df[name]
    if is_real(df.schema[name].dataType):
        return F.when(~F.isnan(column), column)
    return column


def nan_to_null(df: DataFrame) -> DataFrame:
    return df.select(*[present(df, name).alias(name) for name in df.columns])


def finite(column: Column) -> Column:
    """A double with null, NaN and the infinities all turned into null."""
    number = column.cast("double")
    return F.when(F.abs(number) < F.lit(float("inf")), number)


def finite_column(df: DataFrame, name: str) -> Column:
    """Finite view of a column of any type; text is read as a number where it is one."""
    data_type = df.schema[name].dataType
    if isinstance(data_type, T.StringType):
        return finite(to_number(df[name]))
    if kind_of(data_type) == NUMERIC and not is_real(data_type):
        return df[name].cast("double")
    return finite(df[name])


def tidy(column: Column, digits: int = 6) -> Column:
    """A finite number rounded for output, else null."""
    return F.round(finite(column), digits)


def to_number(column: Column) -> Column:
    """Text to double; anything that is not wholly a number becomes null."""
    text = F.trim(column.cast("string"))
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def to_timestamp(column: Column) -> Column:
    """Text to timestamp; anything that is not wholly a date becomes null.

    A form is tried only where the text has its shape: a failed parse costs far more than a match.
    """
    text = F.trim(column.cast("string"))
    chosen = F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}"), F.try_to_timestamp(text))
    for form, outline in DATE_FORMATS.items():
        chosen = chosen.when(text.rlike(outline), F.try_to_timestamp(text, F.lit(form)))
    return chosen


def as_text(df: DataFrame, name: str) -> Column:
    """A groupable text form of any column; nested values become JSON."""
    data_type = df.schema[name].dataType
    if isinstance(data_type, T.BinaryType):
        return F.base64(df[name])
    if isinstance(data_type, T.VariantType):
        return F.to_json(df[name])
    if is_nested(data_type):
        return F.to_json(df[name])
    return present(df, name).cast("string")


def as_key(df: DataFrame, name: str) -> Column:
    """A column that can stand in a ``groupBy``: maps and other nested values become JSON."""
    return as_text(df, name) if is_nested(df.schema[name].dataType) else present(df, name)


def json_safe(df: DataFrame) -> DataFrame:
    """NaN and the infinities turned into null, so that every cell has a JSON form."""
    return df.select(*[
        F.when(F.abs(df[f.name]) < F.lit(float("inf")), df[f.name]).alias(f.name)
        if is_real(f.dataType) else df[f.name]
        for f in df.schema
    ])


__all__ = [
    "CATEGORICAL", "DATETIME", "NUMERIC", "MISSING_TOKENS", "LOAD_DATE_TOKENS", "CHECK_DATE_TOKENS",
    "DATE_FORMATS", "as_key", "as_text", "finite", "finite_column", "is_real", "json_safe", "missing",
    "nan_to_null", "present", "tidy", "to_number", "to_timestamp",
]
