"""Report sections as tables; a section is computed only when it is requested and used."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.errors import AnalysisError
from quarrylens.functions.bands import STRONG, direction, number_text, shape_word, strength
from quarrylens.functions.kinds import categorical_columns, kinds, numeric_columns
from quarrylens.operators.correlation import TOP_LINKS, correlation_matrix, pair_table, strong_pairs
from quarrylens.operators.profile import (
    categorical_statistics, column_overview, duplicate_summary, missing_summary, numeric_statistics, quartiles, table_overview,
)
from quarrylens.operators.quality import datatype_issues, iqr_outliers, quality_score
from quarrylens.scale.cells import Summary

# The order in which sections appear.
SECTIONS = ("executive_summary", "overview", "quality", "statistics", "correlation", "distribution")


def executive_summary(df: DataFrame, summaries: dict[str, Summary] | None = None) -> DataFrame:
    """One row: rows, columns, score, duplicates, columns with gaps, kinds, strongest pair."""
    found = list(kinds(df).values())
    gaps = missing_summary(df).agg(F.count("*")).scalar()
    row = quality_score(df, summaries).select(
        "rows", F.lit(len(df.columns)).cast("bigint").alias("columns"), "score", "duplicate_rows",
        gaps.alias("columns_with_gaps"), F.lit(found.count("numeric")).cast("bigint").alias("numeric"),
        F.lit(found.count("categorical")).cast("bigint").alias("categorical"))
    if len(numeric_columns(df)) < 2:
        nothing = F.lit(None).cast("string")
        return row.select("*", nothing.alias("strongest_left"), nothing.alias("strongest_right"),
                          F.lit(None).cast("double").alias("strongest_r"))
    best = (pair_table(df).where(F.abs("r") >= STRONG)
            .agg(F.max_by(F.struct("left", "right", F.round("r", 4).alias("value")),
                          F.struct(F.abs("r"), F.lit(1)))).scalar())
    return row.withColumn("__best", best).select(
        *row.columns, F.col("__best")["left"].alias("strongest_left"), F.col("__best")["right"].alias("strongest_right"),
        F.col("__best")["value"].alias("strongest_r"))


def column_profile(df: DataFrame) -> DataFrame:
    return column_overview(df).select("column", "kind", "non_null", "missing", "unique")


def statistics_tables(df: DataFrame, summaries: dict[str, Summary] | None = None) -> dict[str, DataFrame]:
    """Numeric columns with their figures, other columns with their most frequent value."""
    tables = {}
    if numeric_columns(df):
        tables["numeric"] = numeric_statistics(df, summaries=summaries).select("column", "count", "mean", "median", "std", "min", "max")
    if categorical_columns(df):
        tables["categorical"] = most_frequent(df)
    return tables


def most_frequent(df: DataFrame) -> DataFrame:
    top = categorical_statistics(df, limit=1)
    return top.select("column", "unique", "missing", F.concat("value", F.lit(" ("), "count", F.lit(")")).alias("frequent"))


def distribution_shapes(df: DataFrame, summaries: dict[str, Summary] | None = None) -> DataFrame:
    """Centre, spread, skew and shape word of each numeric column."""
    return numeric_statistics(df, summaries=summaries).select("column", "mean", "median", "std", "skewness",
                                         shape_word(F.col("skewness")).alias("shape"))


def formatted(df: DataFrame, digits: int = 2, **special: int) -> DataFrame:
    """Numbers as text with thousands separators; counts without decimals, null as a dash."""
    cells = []
    for name, kind in kinds(df).items():
        if kind != "numeric":
            cells.append(F.coalesce(df[name].cast("string"), F.lit("—")).alias(name))
        else:
            whole = df.schema[name].dataType.typeName() in ("byte", "short", "integer", "long", "bigint")
            cells.append(number_text(df[name], 0 if whole else special.get(name, digits)).alias(name))
    return df.select(*cells)


def report(df: DataFrame, sections: Sequence[str]) -> dict[str, dict[str, DataFrame]]:
    """The requested sections in fixed order; unknown names are ignored, none left is an error.

    Sections that need quartiles share one pass of order statistics.
    """
    wanted = [s for s in SECTIONS if s in set(sections)]
    if not wanted:
        raise AnalysisError("Choose at least one known report section")
    numeric = numeric_columns(df)
    shared = set(wanted) & {"executive_summary", "quality", "statistics", "distribution"}
    known = quartiles(df, numeric) if numeric and shared else None
    build = {
        "executive_summary": lambda: {"summary": executive_summary(df, known)},
        "overview": lambda: {"table": table_overview(df), "columns": column_profile(df)},
        "quality": lambda: {"score": quality_score(df, known), "missing": missing_summary(df),
                            "outliers": iqr_outliers(df, summaries=known).where("count > 0"), "datatypes": datatype_issues(df)},
        "statistics": lambda: statistics_tables(df, known),
        "correlation": lambda: {"strong": strong_pairs(df), "matrix": correlation_matrix(df)},
        "distribution": lambda: {"shapes": distribution_shapes(df, known)} if numeric else {},
    }
    return {section: build[section]() for section in wanted}


def data_summary(df: DataFrame) -> DataFrame:
    """One row on the whole table: size, column lists, duplicates, gaps, the three strongest links."""
    numeric, other = numeric_columns(df), categorical_columns(df)
    gaps = missing_summary(df).agg(F.count("*")).scalar()
    copies = duplicate_summary(df).select("count").scalar()
    link_type = "array<struct<left:string,right:string,value:double,strength:string,direction:string>>"
    if len(numeric) >= 2:
        r = F.col("r")
        links = (pair_table(df).where(F.abs("r") >= STRONG).orderBy(F.desc(F.abs("r")), "left", "right").limit(TOP_LINKS)
                 .agg(F.sort_array(F.collect_list(F.struct(
                     F.abs("r").alias("size"), "left", "right", F.round("r", 6).alias("value"),
                     strength(r).alias("strength"), direction(r).alias("direction"))), asc=False).alias("links"))
                 .select(F.transform("links", lambda x: F.struct(
                     x["left"].alias("left"), x["right"].alias("right"), x["value"].alias("value"),
                     x["strength"].alias("strength"), x["direction"].alias("direction"))).cast(link_type)).scalar())
    else:
        links = F.array().cast(link_type)
    return df.agg(F.count("*").alias("rows")).select(
        "rows", F.lit(len(df.columns)).cast("bigint").alias("columns"),
        F.array(*[F.lit(c) for c in numeric]).cast("array<string>").alias("numeric_columns"),
        F.array(*[F.lit(c) for c in other]).cast("array<string>").alias("categorical_columns"),
        copies.alias("duplicate_rows"), gaps.alias("columns_with_missing"), links.alias("strong_correlations"))
