"""Column kinds and argument checks. Schema only: nothing here reads data."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quarrylens.errors import AnalysisError

NUMERIC, CATEGORICAL, DATETIME, BOOLEAN = "numeric", "categorical", "datetime", "boolean"

_DATETIME_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)
_NESTED_TYPES = (T.ArrayType, T.MapType, T.StructType, T.VariantType, T.BinaryType)


def kind_of(data_type: T.DataType) -> str:
    if isinstance(data_type, _DATETIME_TYPES):
        return DATETIME
    if isinstance(data_type, T.BooleanType):
        return BOOLEAN
    if isinstance(data_type, T.NumericType):
        return NUMERIC
    return CATEGORICAL


def is_nested(data_type: T.DataType) -> bool:
    return isinstance(data_type, _NESTED_TYPES)


def column_kind(df: DataFrame, name: str) -> str:
    require_columns(df, [name])
    return kind_of(df.schema[name].dataType)


def kinds(df: DataFrame) -> dict[str, str]:
    """Kind of every column, in schema order."""
    return {field.name: kind_of(field.dataType) for field in df.schema}


def numeric_columns(df: DataFrame) -> list[str]:
    return [name for name, kind in kinds(df).items() if kind == NUMERIC]


def categorical_columns(df: DataFrame) -> list[str]:
    """Every column that is not numeric, dates and booleans included."""
    return [name for name, kind in kinds(df).items() if kind != NUMERIC]


def first_datetime(df: DataFrame) -> str | None:
    return next((name for name, kind in kinds(df).items() if kind == DATETIME), None)


def require_columns(df: DataFrame, names: Iterable[str | None]) -> None:
    for name in names:
        if name is not None and name not in df.columns:
            raise AnalysisError(f"Unknown column: {name}")


def require_kind(df: DataFrame, name: str, *allowed: str) -> None:
    """Raise unless ``name`` exists and has one of the ``allowed`` kinds."""
    kind = column_kind(df, name)
    if kind not in allowed:
        raise AnalysisError(f"{name} is {kind}, needs {'/'.join(sorted(allowed))}")


def require_numeric(df: DataFrame, names: Iterable[str]) -> None:
    for name in names:
        require_kind(df, name, NUMERIC)
