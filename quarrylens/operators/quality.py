"""Data quality: outliers, type problems, one score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylens.errors import AnalysisError
from quarrylens.functions.bands import verdict
from quarrylens.functions.kinds import BOOLEAN, NUMERIC, kinds, numeric_columns, require_columns, require_numeric
from quarrylens.functions.values import (
    CHECK_DATE_TOKENS, finite_column, missing, present, tidy, to_number, to_timestamp,
)
from quarrylens.operators.profile import duplicate_summary, missing_summary, quartiles, top_kinds
from quarrylens.scale.cells import Summary, quantile_values
from quarrylens.scale.longform import distinct_counts, one_row_per, value_counts

IQR_FACTOR, EXAMPLES = 1.5, 10
# Shares and counts the type rules and the score depend on.
LIKE_TYPE, LIKE_DATE_NAMED = 0.9, 0.7
MANY_DISTINCT_SHARE, MANY_DISTINCT, FLAG_VALUES = 0.5, 20, 2
WEIGHT_COMPLETE, WEIGHT_UNIQUE, WEIGHT_INLIER = 0.55, 0.25, 0.2


def _fences(s: Summary) -> tuple[float | None, float | None]:
    if not s.count:
        return None, None
    q1, q3 = s.q[0], s.q[-1]
    return q1 - IQR_FACTOR * (q3 - q1), q3 + IQR_FACTOR * (q3 - q1)


def outlier_bounds(df: DataFrame, columns: Sequence[str],
                   summaries: dict[str, Summary] | None = None) -> dict[str, tuple[float | None, float | None]]:
    """The two fences of every column, as numbers for use as literals; ``summaries`` are quartiles that are known already."""
    known = summaries or quantile_values(df, columns, (0.25, 0.75))
    return {c: _fences(known[c]) for c in columns}


def _beyond(x: Column, bounds: tuple[float | None, float | None]) -> Column:
    low, high = bounds
    return F.lit(False) if low is None else (x < low) | (x > high)


def iqr_outliers(df: DataFrame, columns: Sequence[str] | None = None, summaries: dict[str, Summary] | None = None) -> DataFrame:
    """``column, count, percent, lower_bound, upper_bound`` per numeric column, finite values only."""
    columns = list(columns) if columns is not None else numeric_columns(df)
    require_columns(df, columns)
    if not columns:
        return df.sparkSession.createDataFrame(
            [], "column string, count bigint, percent double, lower_bound double, upper_bound double")
    bounds = outlier_bounds(df, columns, summaries)
    row = df.agg(*[f for i, c in enumerate(columns) for f in (
        F.count(finite_column(df, c)).alias(f"n{i}"),
        F.count_if(_beyond(finite_column(df, c), bounds[c])).alias(f"o{i}"))])
    return one_row_per(row, [
        {"column": F.lit(c), "count": F.col(f"o{i}"),
         "percent": F.round(F.coalesce(F.try_divide(F.col(f"o{i}") * 100.0, F.col(f"n{i}")), F.lit(0.0)), 2),
         "lower_bound": tidy(F.lit(bounds[c][0]).cast("double")),
         "upper_bound": tidy(F.lit(bounds[c][1]).cast("double"))}
        for i, c in enumerate(columns)])


def outlier_rows(df: DataFrame, column: str, order_by: Sequence[str], limit: int | None = EXAMPLES) -> DataFrame:
    """Rows whose value lies beyond the fences; the filter holds literals, so it reaches the scan."""
    require_numeric(df, [column])
    low, high = outlier_bounds(df, [column])[column]
    if low is None:
        raise AnalysisError(f"column: {column} holds no finite number")
    infinity = float("inf")
    flagged = df.where(((df[column] < low) & (df[column] > -infinity)) | ((df[column] > high) & (df[column] < infinity)))
    return flagged if limit is None else flagged.orderBy(*order_by).limit(limit)


def outlier_report(df: DataFrame, column: str) -> DataFrame:
    """The outlier summary of a single column; an error when it has no usable value."""
    require_numeric(df, [column])
    report = iqr_outliers(df, [column])
    if df.where(finite_column(df, column).isNotNull()).isEmpty():
        raise AnalysisError(f"column: {column} holds no finite number")
    return report


def _text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def _variant_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.VariantType)]


def datatype_issues(df: DataFrame, json_text: Sequence[str] = ()) -> DataFrame:
    """``column, dtype, issue, detail, severity, distinct`` for columns whose type and values disagree.

    One scan reads the parse shares of all text columns, the kinds of variants and the value range of all numeric columns.
    Texts of the columns ``json_text`` are read as JSON, so that mixed kinds show; a text that is no JSON counts as a string.
    Exact distinct counts are shuffled only for the columns whose rule needs them, long texts as digests.
    """
    found = kinds(df)
    numeric = [c for c, k in found.items() if k == NUMERIC]
    others = [c for c, k in found.items() if k not in (NUMERIC, BOOLEAN)]
    text = [c for c in _text_columns(df) if c not in json_text]
    variants = {c: df[c] for c in _variant_columns(df)}
    variants |= {c: F.coalesce(F.try_parse_json(df[c]), df[c].cast("variant")) for c in json_text}
    require_columns(df, list(json_text))
    parse = [a for i, c in enumerate(df.columns) for a in _probes(df, c, i, text, variants)]
    row = df.agg(F.count("*").alias("rows"), *parse)
    if numeric:
        # A numeric column has at most two values when nothing lies strictly between its ends.
        ends = df.agg(*[f(present(df, c)) for c in numeric for f in (F.min, F.max)]).first()
        span = {c: (ends[2 * i], ends[2 * i + 1]) for i, c in enumerate(numeric)}
        between = df.agg(*[
            F.count_if((present(df, c) > F.lit(span[c][0])) & (present(df, c) < F.lit(span[c][1]))).alias(f"b{i}")
            for i, c in enumerate(numeric)])
        between = between.select(F.struct("*")).scalar()
    rules = []
    for i, c in enumerate(df.columns):
        filled = F.col(f"n{i}") > 0
        base = {"column": F.lit(c), "dtype": F.lit(df.schema[c].dataType.simpleString())}
        issue, seen = F.when(~filled, "empty_column"), F.lit(None).cast("string")
        if c in variants:
            issue = issue.when(F.size(f"t{i}") > 1, "mixed_types")
            seen = F.array_join(f"t{i}", ", ")
        if c in text:
            dates = F.col(f"date{i}") / F.col(f"n{i}")
            named = any(token in c.lower() for token in CHECK_DATE_TOKENS)
            issue = issue.when(F.col(f"num{i}") / F.col(f"n{i}") >= LIKE_TYPE, "numeric_stored_as_text").when(
                dates >= (LIKE_DATE_NAMED if named else LIKE_TYPE), "date_stored_as_text")
            seen = F.when(issue == "numeric_stored_as_text", F.col(f"num{i}")).otherwise(F.col(f"date{i}")).cast("string")
        rules.append({**base, "issue": issue, "seen": seen, "filled": F.col(f"n{i}"), "rows": F.col("rows"), "position": F.lit(i)})
        if c in numeric:
            inner = between[f"b{numeric.index(c)}"]
            rules.append({**base, "issue": F.when(filled & (inner == 0), "numeric_flag"), "seen": F.lit(None).cast("string"),
                          "filled": F.col(f"n{i}"), "rows": F.col("rows"), "position": F.lit(i)})
    plain = (one_row_per(row, rules).where(F.col("issue").isNotNull())
             .withColumn("distinct", F.lit(None).cast("bigint")))
    if others:
        crowded = (distinct_counts(value_counts(df, others, texts=False))
                   .where((F.col("distinct") / F.col("rows") >= MANY_DISTINCT_SHARE)
                          & (F.col("distinct") > MANY_DISTINCT)))
        dtype = F.create_map(*[x for c in others for x in (F.lit(c), F.lit(df.schema[c].dataType.simpleString()))])
        place = F.create_map(*[x for c in others for x in (F.lit(c), F.lit(df.columns.index(c)))])
        plain = plain.unionByName(crowded.select(
            "column", dtype[F.col("column")].alias("dtype"), F.lit("high_cardinality").alias("issue"),
            F.col("distinct").cast("string").alias("seen"), (F.col("rows") - F.col("missing")).alias("filled"), "rows",
            place[F.col("column")].alias("position"), "distinct"))
    severity = (F.when(F.col("issue").isin("empty_column", "mixed_types", "numeric_stored_as_text"), "high")
                .when(F.col("issue") == "date_stored_as_text", "medium").otherwise("low"))
    return plain.select("column", "dtype", "issue", _detail().alias("detail"), severity.alias("severity"), "distinct", "position")


def _detail() -> Column:
    """What was seen, in words with its figures."""
    of_filled = F.concat(F.col("seen"), F.lit(" of "), F.col("filled"), F.lit(" values read as "))
    return (F.when(F.col("issue") == "empty_column", F.concat(F.lit("none of "), F.col("rows"), F.lit(" rows has a value")))
            .when(F.col("issue") == "mixed_types", F.concat(F.lit("values of several kinds: "), F.col("seen")))
            .when(F.col("issue") == "numeric_stored_as_text", F.concat(of_filled, F.lit("numbers")))
            .when(F.col("issue") == "date_stored_as_text", F.concat(of_filled, F.lit("dates")))
            .when(F.col("issue") == "high_cardinality", F.concat(F.col("seen"), F.lit(" different values in "), F.col("rows"), F.lit(" rows")))
            .otherwise(F.lit("no value lies between the smallest and the largest")))


def _probes(df: DataFrame, c: str, i: int, text: list[str], variants: dict[str, Column]) -> list[Column]:
    probes = [F.count(present(df, c)).alias(f"n{i}")]
    if c in text:
        probes += [F.count(to_number(df[c])).alias(f"num{i}"), F.count(to_timestamp(df[c])).alias(f"date{i}")]
    if c in variants:
        probes.append(top_kinds(variants[c], df[c].isNotNull()).alias(f"t{i}"))
    return probes


def quality_score(df: DataFrame, summaries: dict[str, Summary] | None = None) -> DataFrame:
    """One row: score, its parts, and counts of duplicates, gap cells and outlier cells."""
    numeric = numeric_columns(df)
    bounds = outlier_bounds(df, numeric, summaries)
    gaps = sum((missing(df, c).cast("bigint") for c in df.columns), F.lit(0).cast("bigint"))
    beyond = sum((F.coalesce(_beyond(finite_column(df, c), bounds[c]).cast("bigint"), F.lit(0)) for c in numeric),
                 F.lit(0).cast("bigint"))
    row = df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(gaps), F.lit(0)).alias("missing_cells"),
                 F.coalesce(F.sum(beyond), F.lit(0)).alias("outlier_cells"))
    copies = duplicate_summary(df).select(F.struct("*")).scalar()
    rows = F.greatest(F.col("rows"), F.lit(1)).cast("double")
    complete = 1 - F.col("missing_cells") / F.greatest(F.col("rows") * len(df.columns), F.lit(1))
    unique = 1 - F.col("duplicate_rows") / rows
    inlier = 1 - F.col("outlier_cells") / F.greatest(F.col("rows") * len(numeric), F.lit(1))
    score = 100 * (WEIGHT_COMPLETE * complete + WEIGHT_UNIQUE * unique + WEIGHT_INLIER * inlier)
    return (row.withColumn("__copies", copies)
            .withColumn("duplicate_rows", F.col("__copies")["count"])
            .withColumn("duplicate_percent", F.col("__copies")["percent"])
            .select(F.bround(F.least(F.greatest(score, F.lit(0.0)), F.lit(100.0)), 0).cast("bigint").alias("score"),
                    "rows", F.col("missing_cells").cast("bigint").alias("missing_cells"), "duplicate_rows",
                    "duplicate_percent", F.col("outlier_cells").cast("bigint").alias("outlier_cells")))


def quality_verdict(df: DataFrame) -> DataFrame:
    """Score, its word, and how many columns have outliers, gaps and type problems."""
    known = quartiles(df, numeric_columns(df))
    outliers = iqr_outliers(df, summaries=known).where(F.col("count") > 0).agg(F.count("*")).scalar()
    gaps = missing_summary(df).agg(F.count("*")).scalar()
    issues = datatype_issues(df).agg(F.count("*")).scalar()
    return quality_score(df, known).select("score", verdict(F.col("score")).alias("verdict"),
                                    outliers.alias("columns_with_outliers"), gaps.alias("columns_with_gaps"),
                                    issues.alias("type_issues"))


def quality_tables(df: DataFrame) -> dict[str, DataFrame]:
    """The parts of a quality report as separate tables, each computed only when used."""
    known = quartiles(df, numeric_columns(df))
    return {"score": quality_score(df, known), "missing": missing_summary(df), "outliers": iqr_outliers(df, summaries=known),
            "datatype_issues": datatype_issues(df)}
