"""Column profiles: descriptive statistics, value counts, gaps, duplicates, declared types."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylens.functions.kinds import (
    BOOLEAN, CATEGORICAL, DATETIME, NUMERIC, categorical_columns, is_nested, kinds, numeric_columns,
)
from quarrylens.functions.values import as_key, as_text, finite_column, missing, present, tidy
from quarrylens.scale.cells import Summary, quantile_values
from quarrylens.scale.longform import LONG_TEXT, distinct_counts, distinct_profile, one_row_per, value_counts

TOP_VALUES, CATALOGUE_COLUMNS, LOW_CARDINALITY = 10, 60, 50
QUARTILES = (0.25, 0.5, 0.75)
# Top-level types of a variant that count as one kind: values of two kinds in a column are mixed, two shapes of object are not.
VARIANT_KINDS = (("BIGINT",), ("DOUBLE", "FLOAT", "DECIMAL"), ("STRING",), ("BOOLEAN",), ("OBJECT",), ("ARRAY",),
                 ("DATE", "TIMESTAMP"), ("BINARY", "UUID"))


def _number(value) -> Column:
    return F.lit(value).cast("double")


def _moments(i: int, shift: float | None) -> list[Column]:
    """Sums of powers of the distance to ``shift``: plain sums, which merge in any order."""
    d = F.col(f"__x{i}") - F.lit(shift).cast("double")
    return [F.count(f"__x{i}").alias(f"n{i}"), F.sum(d).alias(f"s1_{i}"), F.sum(d * d).alias(f"s2_{i}"),
            F.sum(d * d * d).alias(f"s3_{i}"), F.sum(d * d * d * d).alias(f"s4_{i}")]


def _figures() -> dict[str, Column]:
    """Mean, sample deviation and bias-corrected shape from the power sums of a row.

    The sums are taken about a mean known from an earlier scan, so the remaining offset ``a`` is
    close to zero and nothing is lost in the differences. A constant column has skewness and
    kurtosis 0; below 3 and 4 values they are undefined.
    """
    n = F.col("n").cast("double")
    a, r2, r3, r4 = (F.try_divide(F.col(f"s{k}"), n) for k in (1, 2, 3, 4))
    m2 = r2 - a * a
    m3 = r3 - 3 * a * r2 + 2 * a * a * a
    m4 = r4 - 4 * a * r3 + 6 * a * a * r2 - 3 * a * a * a * a
    constant = F.col("low") == F.col("high")
    skew = F.try_divide(m3, m2 * F.sqrt(m2)) * F.sqrt(n * (n - 1)) / (n - 2)
    kurt = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * (F.try_divide(m4, m2 * m2) - 3) + 6)
    return {"mean": F.when(constant, F.col("low")).otherwise(F.col("shift") + a),
            "std": F.when(n >= 2, F.when(constant, 0.0).otherwise(F.sqrt(m2 * n / (n - 1)))),
            "skewness": F.when(n >= 3, F.when(constant, 0.0).otherwise(skew)),
            "kurtosis": F.when(n >= 4, F.when(constant, 0.0).otherwise(kurt))}


def describe_numeric(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``column, count, mean, std, min, q25, median, q75, max`` per numeric column."""
    return numeric_statistics(df, columns).select(
        "column", "count", "mean", "std", "min", "q25", "median", "q75", "max")


def quartiles(df: DataFrame, columns: Sequence[str]) -> dict[str, Summary]:
    """Count, range, mean and the three quartiles of columns: what reports share, from one pass of order statistics."""
    return quantile_values(df, list(columns), QUARTILES)


def numeric_statistics(df: DataFrame, columns: Sequence[str] | None = None,
                       summaries: dict[str, Summary] | None = None) -> DataFrame:
    """Statistics of the finite values of each numeric column, rounded to 6 decimals.

    One scan for all moments; range, mean and quartiles come in as literals from :func:`quartiles`.
    """
    columns = list(columns) if columns is not None else numeric_columns(df)
    if not columns:
        return df.sparkSession.createDataFrame([], (
            "column string, count bigint, mean double, median double, std double, min double, q25 double, "
            "q75 double, max double, skewness double, kurtosis double"))
    known = summaries or quartiles(df, columns)
    summaries = {c: known[c] for c in columns}
    views = df.select(*[finite_column(df, c).alias(f"__x{i}") for i, c in enumerate(columns)])
    row = views.agg(*[m for i, c in enumerate(columns) for m in _moments(i, summaries[c].mean)])
    sums = one_row_per(row, [{
        "column": F.lit(c), "n": F.col(f"n{i}"), **{f"s{k}": F.col(f"s{k}_{i}") for k in (1, 2, 3, 4)},
        "shift": _number(s.mean), "low": _number(s.low), "high": _number(s.high),
        "q25": _number(s.q[0]), "median": _number(s.q[1]), "q75": _number(s.q[2]),
    } for i, (c, s) in enumerate(summaries.items())])
    shape = _figures()
    return sums.select(
        "column", F.col("n").alias("count"), tidy(shape["mean"]).alias("mean"), tidy(F.col("median")).alias("median"),
        tidy(shape["std"]).alias("std"), tidy(F.col("low")).alias("min"), tidy(F.col("q25")).alias("q25"),
        tidy(F.col("q75")).alias("q75"), tidy(F.col("high")).alias("max"),
        tidy(shape["skewness"]).alias("skewness"), tidy(shape["kurtosis"]).alias("kurtosis"))


def top_values(counts: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` most frequent values per column, ties by value, from value counts."""
    order = Window.partitionBy("column", "position").orderBy(F.desc("n"), F.asc("value"))
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def categorical_statistics(df: DataFrame, columns: Sequence[str] | None = None,
                           limit: int = TOP_VALUES) -> DataFrame:
    """Top values of every non-numeric column with share of all rows, distinct and missing counts."""
    columns = list(columns) if columns is not None else categorical_columns(df)
    counts = value_counts(df, columns)
    # One row per column: bounded by the schema.
    totals = F.broadcast(distinct_counts(counts).select("position", "rows", "missing", "distinct"))
    return (top_values(counts, limit).join(totals, "position")
            .select("column", F.col("distinct").alias("unique"), "missing", "rank", "value",
                    F.col("n").alias("count"), F.round(F.col("n") / F.col("rows"), 4).alias("proportion")))


def missing_summary(df: DataFrame) -> DataFrame:
    """``column, count, percent`` for the columns that have gaps."""
    row = df.agg(F.count("*").alias("rows"),
                 *[F.count_if(missing(df, c)).alias(f"m{i}") for i, c in enumerate(df.columns)])
    return one_row_per(row, [
        {"column": F.lit(c), "count": F.col(f"m{i}"),
         "percent": F.round(F.try_divide(F.col(f"m{i}") * 100.0, F.col("rows")), 2)}
        for i, c in enumerate(df.columns)]).where(F.col("count") > 0)


def _row_key(df: DataFrame, name: str) -> Column:
    """A compact stand-in for a cell: long texts shuffle as their SHA-256 digest.

    A digest is 71 characters with its prefix, longer than any text kept as it is, so the two
    forms cannot be confused.
    """
    key = as_key(df, name)
    if isinstance(df.schema[name].dataType, T.StringType) or is_nested(df.schema[name].dataType):
        return F.when(F.octet_length(key) > LONG_TEXT, F.concat(F.lit("sha256:"), F.sha2(key, 256))).otherwise(key)
    return key


def duplicate_summary(df: DataFrame) -> DataFrame:
    """``count, percent`` of rows equal to an earlier row; nulls equal each other."""
    keys = df.select(*[_row_key(df, c).alias(f"__k{i}") for i, c in enumerate(df.columns)])
    copies = keys.groupBy(*keys.columns).agg(F.count("*").alias("n"))
    return copies.agg(
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("count"),
        F.round(F.coalesce(F.try_divide(F.sum(F.col("n") - 1) * 100.0, F.sum("n")), F.lit(0.0)), 2).alias("percent"))


_WIDTHS = {T.ByteType: 1, T.BooleanType: 1, T.ShortType: 2, T.IntegerType: 4, T.FloatType: 4, T.DateType: 4}


def _cell_bytes(df: DataFrame, name: str) -> Column:
    data_type = df.schema[name].dataType
    if isinstance(data_type, T.StringType) or is_nested(data_type):
        return F.coalesce(F.octet_length(as_text(df, name)), F.lit(0)).cast("bigint")
    return F.lit(_WIDTHS.get(type(data_type), 8)).cast("bigint")


def data_bytes(df: DataFrame) -> DataFrame:
    """Estimated size of the values: text by its bytes, everything else by its fixed width."""
    size = sum((_cell_bytes(df, c) for c in df.columns), F.lit(0).cast("bigint"))
    return df.agg(F.coalesce(F.sum(size), F.lit(0)).cast("bigint").alias("bytes"))


def column_overview(df: DataFrame, approximate: bool = False) -> DataFrame:
    """``column, type, kind, non_null, missing, unique, sample`` in schema order.

    The sample is the smallest value, so that it does not depend on how the table is read. ``approximate`` spares the shuffle
    of distinct values and is right to about 2 percent.
    """
    kind = F.array(*[F.lit(k) for k in kinds(df).values()])
    declared = F.array(*[F.lit(f.dataType.simpleString()) for f in df.schema])
    return (distinct_profile(df, df.columns, approximate)
            .select("column", declared[F.col("position")].alias("type"), kind[F.col("position")].alias("kind"),
                    (F.col("rows") - F.col("missing")).alias("non_null"), "missing",
                    F.col("distinct").alias("unique"), "sample", "position"))


def table_overview(df: DataFrame) -> DataFrame:
    """One row: rows, columns, estimated bytes and the number of columns of each kind."""
    found = list(kinds(df).values())
    size = sum((_cell_bytes(df, c) for c in df.columns), F.lit(0).cast("bigint"))
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(size), F.lit(0)).cast("bigint").alias("bytes")).select(
        "rows", F.lit(len(found)).cast("bigint").alias("columns"), "bytes",
        *[F.lit(found.count(k)).cast("bigint").alias(k) for k in (NUMERIC, CATEGORICAL, DATETIME, BOOLEAN)])


def first_rows(df: DataFrame, order_by: Sequence[str], limit: int = 8) -> DataFrame:
    """The first rows in an explicit order."""
    return df.orderBy(*order_by).limit(limit)


def column_catalogue(df: DataFrame, limit: int = CATALOGUE_COLUMNS) -> DataFrame:
    """``name, kind, distinct, total, truncated``: numeric columns first, then few-valued ones."""
    found = kinds(df)
    order = {NUMERIC: 0, CATEGORICAL: 1, DATETIME: 2, BOOLEAN: 3}
    counted = [c for c, k in found.items() if k in (CATEGORICAL, BOOLEAN)]
    schema = df.sparkSession.createDataFrame(
        [(c, k, order[k], i) for i, (c, k) in enumerate(found.items())],
        "name string, kind string, place int, position int")
    if counted:
        distinct = distinct_counts(value_counts(df, counted, texts=False)).select(F.col("column").alias("name"), "distinct")
        schema = schema.join(F.broadcast(distinct), "name", "left")
    else:
        schema = schema.withColumn("distinct", F.lit(None).cast("bigint"))
    crowded = F.coalesce((F.col("distinct") > LOW_CARDINALITY).cast("int"), F.lit(0))
    return (schema.orderBy("place", crowded, "position").limit(limit)
            .select("name", "kind", "distinct", F.lit(len(found)).cast("bigint").alias("total"),
                    F.lit(len(found) > limit).alias("truncated")))


def datatype_summary(df: DataFrame) -> DataFrame:
    """``column, dtype, value_types``: the declared type and the types the values really have.

    Variants and texts that are JSON are told by the kinds of their values at the top (``bigint``, ``string``, ``object``, ...),
    of which there are a fixed number, so that the state of the scan is bounded whatever the documents hold.
    """
    def types_of(field: T.StructField) -> Column:
        value = df[field.name]
        if isinstance(field.dataType, T.VariantType):
            return top_kinds(value, value.isNotNull())
        return F.when(F.count_if(present(df, field.name).isNotNull()) > 0, F.array(F.lit(field.dataType.simpleString()))).otherwise(
            F.array().cast("array<string>"))

    row = df.agg(*[types_of(f).alias(f"t{i}") for i, f in enumerate(df.schema)])
    return one_row_per(row, [
        {"column": F.lit(f.name), "dtype": F.lit(f.dataType.simpleString()), "value_types": F.col(f"t{i}")}
        for i, f in enumerate(df.schema)])


def top_kind(variant: Column) -> Column:
    """The kind of a variant's value: the name of its type without what is inside it."""
    return F.regexp_extract(F.schema_of_variant(variant), "^[A-Z]+", 0)


def top_kinds(variant: Column, where: Column) -> Column:
    """The sorted kinds of the values of a variant column, from one flag for each kind there is."""
    found = F.array(*[F.when(F.coalesce(F.max(where & top_kind(variant).isin(*names)), F.lit(False)), F.lit(names[0].lower())) for names in VARIANT_KINDS])
    return F.array_sort(F.array_compact(found))
