"""Between one row per table and one row per column, and value counts for many columns at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylens.functions.values import as_text, missing, present

MISSING_LABEL = "(missing)"


def one_row_per(row: DataFrame, records: Sequence[dict[str, Column]]) -> DataFrame:
    """Turn a one-row aggregate into one row per record, each a dict of named columns."""
    structs = [F.struct(*[column.alias(name) for name, column in record.items()]) for record in records]
    return row.select(F.inline(F.array(*structs)))


#: Bytes of a text above which a digest stands for it where only equality matters.
LONG_TEXT = 64


def _tagged(df: DataFrame, name: str, texts: bool) -> tuple[Column, Column, Column]:
    """A cell as a whole number, a real or a text, whichever its type fits best; the others are null."""
    data_type = df.schema[name].dataType
    whole, real, text = F.lit(None).cast("bigint"), F.lit(None).cast("double"), F.lit(None).cast("string")
    if isinstance(data_type, T.IntegralType):
        whole = df[name].cast("bigint")
    elif isinstance(data_type, T.BooleanType):
        whole = df[name].cast("int").cast("bigint")
    elif isinstance(data_type, T.DateType):
        whole = F.unix_date(df[name]).cast("bigint")
    elif isinstance(data_type, T.TimestampType):
        whole = F.unix_micros(df[name])
    elif isinstance(data_type, (T.FloatType, T.DoubleType)):
        real = present(df, name).cast("double") + F.lit(0.0)
    else:
        # A cell may spell the label of a missing one; both count under it.
        text = F.coalesce(as_text(df, name), F.lit(MISSING_LABEL))
        if not texts:
            text = F.when(F.octet_length(text) > LONG_TEXT, F.concat(F.lit("sha256:"), F.sha2(text, 256))).otherwise(text)
    return whole, real, text


def _as_written(df: DataFrame, columns: Sequence[str]) -> Column:
    """The text of a tagged value, by the type of the column at ``position``."""
    def at(kinds: tuple) -> list[int]:
        return [i for i, c in enumerate(columns) if isinstance(df.schema[c].dataType, kinds)]

    place, whole, real = F.col("position"), F.col("__whole"), F.col("__real")
    number = whole.cast("string")
    for kinds, form in ((T.BooleanType, (whole != 0).cast("string")), (T.DateType, F.date_from_unix_date(whole.cast("int")).cast("string")),
                        (T.TimestampType, F.timestamp_micros(whole).cast("string"))):
        if at(kinds):
            number = F.when(place.isin(at(kinds)), form).otherwise(number)
    decimal = real.cast("string")
    if at(T.FloatType):
        decimal = F.when(place.isin(at(T.FloatType)), real.cast("float").cast("string")).otherwise(decimal)
    return F.coalesce(F.col("__text"), number, decimal, F.lit(MISSING_LABEL))


def value_counts(df: DataFrame, columns: Sequence[str], texts: bool = True) -> DataFrame:
    """``column, position, value, n, n_missing``: every distinct value of every column, from one scan and one shuffle of values.

    The shuffle key is the position of the column and the value as a whole number, a real or a text, so a frequent value is
    merged before it, a column never lands in a single task, and only distinct numbers are turned into text. Missing cells count
    under ``(missing)``. Without ``texts`` a long text is told by its digest only.
    """
    names = F.array(*[F.lit(c) for c in columns])
    cells = []
    for i, c in enumerate(columns):
        whole, real, text = _tagged(df, c, texts)
        cells.append(F.struct(F.lit(i).alias("position"), whole.alias("__whole"), real.alias("__real"), text.alias("__text"),
                              missing(df, c).alias("__gone")))
    return (df.select(F.inline(F.array(*cells))).groupBy("position", "__whole", "__real", "__text")
            .agg(F.count("*").alias("n"), F.count_if("__gone").alias("n_missing"))
            .select(names[F.col("position")].alias("column"), "position", _as_written(df, columns).alias("value"), "n", "n_missing"))


def distinct_profile(df: DataFrame, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    """``column, position, rows, missing, distinct, sample``: long texts are shuffled as digests, or nothing with ``approximate``.

    The sample is the smallest value as text. ``approximate`` reads the number of distinct values
    from HyperLogLog sketches, which merge like sums and are right to about 2 percent.
    """
    words = [as_text(df, c) for c in columns]
    numbers = (T.IntegralType, T.BooleanType, T.DateType, T.TimestampType, T.FloatType, T.DoubleType)
    # The smallest text of numbers comes from their distinct values, so that not every cell is turned into text.
    texts = [i for i, c in enumerate(columns) if approximate or not isinstance(df.schema[c].dataType, numbers)]
    figures = [a for i, c in enumerate(columns) for a in (
        F.count_if(missing(df, c)).alias(f"m{i}"), (F.min(F.when(~missing(df, c), words[i])) if i in texts else F.lit(None).cast("string")).alias(f"s{i}"))]
    if approximate:
        figures += [F.approx_count_distinct(F.when(~missing(df, c), words[i]), 0.02).alias(f"d{i}") for i, c in enumerate(columns)]
    wide = one_row_per(df.agg(F.count("*").alias("rows"), *figures), [
        {"column": F.lit(c), "position": F.lit(i), "rows": F.col("rows"), "missing": F.col(f"m{i}"),
         **({"distinct": F.col(f"d{i}")} if approximate else {}), "sample": F.col(f"s{i}")} for i, c in enumerate(columns)]).where(F.col("rows") > 0)
    if approximate:
        return wide
    counts = distinct_counts(value_counts(df, columns, texts=False)).select("position", "distinct", F.col("sample").alias("least"))
    return (wide.join(F.broadcast(counts), "position", "left")  # one row for each column
            .select("column", "position", "rows", "missing", F.coalesce("distinct", F.lit(0).cast("bigint")).alias("distinct"),
                    F.when(F.col("position").isin(texts), F.col("sample")).otherwise(F.col("least")).alias("sample")))


def distinct_counts(counts: DataFrame) -> DataFrame:
    """``column, position, rows, missing, distinct, sample`` from :func:`value_counts`.

    The sample is the smallest value as text, so it does not depend on how the table is read.
    """
    filled = F.col("n") > F.col("n_missing")
    return counts.groupBy("column", "position").agg(
        F.sum("n").alias("rows"), F.sum("n_missing").alias("missing"), F.count_if(filled).alias("distinct"),
        F.min(F.when(filled, F.col("value"))).alias("sample"))
