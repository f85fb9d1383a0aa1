"""Words for numbers: correlation bands, distribution shape, quality verdict, number text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Thresholds the wording depends on.
STRONG, MODERATE, LEAKAGE = 0.7, 0.4, 0.98
SYMMETRIC = 0.5
EXCELLENT, GOOD = 90, 70


def strength(r: Column) -> Column:
    size = F.abs(r)
    return (F.when(r.isNull(), "undefined").when(size >= STRONG, "strong")
            .when(size >= MODERATE, "moderate").otherwise("weak"))


def direction(r: Column) -> Column:
    return F.when(r.isNull(), "undefined").when(r >= 0, "positive").otherwise("negative")


def movement(slope: Column) -> Column:
    return F.when(slope > 0, "increasing").when(slope < 0, "decreasing").otherwise("flat")


def shape(skewness: Column) -> Column:
    return (F.when(skewness.isNull(), "not measurable")
            .when(F.abs(skewness) < SYMMETRIC, "approximately symmetric")
            .when(skewness > 0, "right-skewed (a tail of high values)")
            .otherwise("left-skewed (a tail of low values)"))


def shape_word(skewness: Column) -> Column:
    """The one-word form used in report tables."""
    return (F.when(skewness.isNull(), "not measurable")
            .when(F.abs(skewness) < SYMMETRIC, "symmetric")
            .when(skewness > 0, "right-skewed").otherwise("left-skewed"))


def verdict(score: Column) -> Column:
    return F.when(score >= EXCELLENT, "excellent").when(score >= GOOD, "good").otherwise("review")


def number_text(column: Column, digits: int = 2) -> Column:
    """Thousands separators and fixed decimals; a dash for null."""
    return F.coalesce(F.format_number(column, digits), F.lit("—"))
