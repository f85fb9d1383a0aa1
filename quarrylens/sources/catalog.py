"""Named tables in the session catalog, and previews."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.errors import AnalysisError
from quarrylens.functions.values import json_safe

PREVIEW_ROWS, MAX_PREVIEW_ROWS = 20, 100


def register(df: DataFrame, name: str) -> DataFrame:
    df.createOrReplaceTempView(name)
    return df


def get(spark: SparkSession, name: str) -> DataFrame:
    if not spark.catalog.tableExists(name):
        raise AnalysisError(f"Unknown dataset: {name}")
    return spark.table(name)


def names(spark: SparkSession) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables())


def preview(df: DataFrame, order_by: Sequence[str], limit: int = PREVIEW_ROWS) -> DataFrame:
    """The first rows in an explicit order, safe for JSON."""
    if not 1 <= limit <= MAX_PREVIEW_ROWS:
        raise AnalysisError(f"A preview shows 1 to {MAX_PREVIEW_ROWS} rows")
    return json_safe(df).orderBy(*order_by).limit(limit)


def preview_info(df: DataFrame, name: str, source: str) -> DataFrame:
    """One row: name, source, row count, column count, column names."""
    return df.agg(F.count("*").alias("rows")).select(
        F.lit(name).alias("name"), F.lit(source).alias("source"), "rows",
        F.lit(len(df.columns)).cast("bigint").alias("columns"),
        F.array(*[F.lit(c) for c in df.columns]).alias("column_names"))
