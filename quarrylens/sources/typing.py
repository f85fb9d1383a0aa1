"""Column types for tables read as text: a look at a few rows and one scan decide, one projection casts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylens.functions.values import LOAD_DATE_TOKENS, MISSING_TOKENS, to_number, to_timestamp

DATE_SHARE = 0.8
_WHOLE = r"^[+-]?\d+$"
# Digits that a decimal holds.
MOST_DIGITS = 38
_BOOLEAN = r"^(True|False|TRUE|FALSE|true|false)$"


def without_missing_tokens(df: DataFrame) -> DataFrame:
    """Text cells that spell a missing value become null."""
    return df.select(*[
        F.when(~F.trim(df[f.name]).isin(*MISSING_TOKENS), df[f.name]).alias(f.name)
        if isinstance(f.dataType, T.StringType) else df[f.name] for f in df.schema])


#: Rows looked at first: a form that one of them does not have is not looked for in the whole column.
HEAD = 1000
# What the cells of a column are not, as bits, and that there is a cell at all.
FILLED, NOT_WHOLE, NOT_LONG, MANY_DIGITS, NOT_NUMBER, NOT_BOOLEAN = (1 << i for i in range(6))
_DECIDED = NOT_WHOLE | NOT_NUMBER | NOT_BOOLEAN


def _faults(column: Column, known: int) -> Column:
    """The bits of one cell, null for a null one; bits ``known`` of the column are left out, as are those of no consequence then."""
    text = F.trim(column)
    tests = {NOT_WHOLE: text.rlike(_WHOLE), NOT_LONG: text.try_cast("bigint").isNotNull(), MANY_DIGITS: F.length(text) <= MOST_DIGITS,
             NOT_NUMBER: _any_number(column).isNotNull(), NOT_BOOLEAN: text.rlike(_BOOLEAN)}
    idle = known | (NOT_LONG | MANY_DIGITS if known & NOT_WHOLE else 0)
    bits = F.lit(FILLED)
    for bit, met in tests.items():
        if not bit & idle:
            bits = bits.bitwiseOR(F.when(met, F.lit(0)).otherwise(F.lit(bit)))
    if not known & NOT_WHOLE:  # a whole number in its plain form needs no pattern
        bits = F.when(text.try_cast("bigint").cast("string") == text, F.lit(FILLED | NOT_BOOLEAN)).otherwise(bits)
    return F.when(column.isNotNull(), bits)


def _found(df: DataFrame, known: dict[str, int]) -> dict[str, int]:
    """The bits of the columns ``known``, from all rows of ``df``."""
    row = df.agg(*[F.bit_or(_faults(df[c], bits)).alias(f"b{i}") for i, (c, bits) in enumerate(known.items())]).first()
    return {c: bits | (row[f"b{i}"] or 0) for i, (c, bits) in enumerate(known.items())}


def infer_types(df: DataFrame) -> DataFrame:
    """Cast all-text columns: whole numbers, then decimals, then booleans; anything else stays text.

    Whole numbers become 64-bit integers where all of them fit, else exact decimals of up to 38 digits, else
    they stay text, so that two long identifiers never become one value.

    The decision depends on every row, not on which part of a file comes first: the few rows of ``HEAD`` only rule forms out, and
    the forms that are left are looked for in all rows.
    """
    text = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    if not text:
        return df
    head = df.limit(HEAD)
    seen = _found(head, dict.fromkeys(text, 0))
    left = {c: bits for c, bits in seen.items() if bits & _DECIDED != _DECIDED}
    if left:
        seen |= _found(df, left)
    casts = {}
    for c in text:
        bits = seen[c]
        if not bits & FILLED:
            continue
        if not bits & NOT_WHOLE:
            if not bits & NOT_LONG:
                casts[c] = F.trim(df[c]).cast("bigint")
            elif not bits & MANY_DIGITS:
                casts[c] = F.trim(df[c]).cast(f"decimal({MOST_DIGITS},0)")
        elif not bits & NOT_NUMBER:
            casts[c] = _any_number(df[c])
        elif not bits & NOT_BOOLEAN:
            casts[c] = F.lower(F.trim(df[c])).cast("boolean")
    return df.select(*[casts.get(c, df[c]).alias(c) for c in df.columns])


def _any_number(column: Column) -> Column:
    text = F.lower(F.trim(column))
    infinite = (F.when(text.isin("inf", "+inf", "infinity"), F.lit(float("inf")))
                .when(text.isin("-inf", "-infinity"), F.lit(float("-inf"))))
    return F.coalesce(to_number(column), infinite)


def normalize(df: DataFrame) -> DataFrame:
    """Strip column names; date-named text becomes a timestamp when at least 80 percent of all rows parse."""
    df = df.toDF(*[c.strip() for c in df.columns])
    candidates = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)
                  and any(token in f.name.lower() for token in LOAD_DATE_TOKENS)]
    if not candidates:
        return df
    parsed = df.agg(F.count("*").alias("rows"), *[
        F.count(to_timestamp(df[c])).alias(f"p{i}") for i, c in enumerate(candidates)]).first()
    dates = {c for i, c in enumerate(candidates) if parsed["rows"] and parsed[f"p{i}"] / parsed["rows"] >= DATE_SHARE}
    return df.select(*[to_timestamp(df[c]).alias(c) if c in dates else df[c] for c in df.columns])
