"""Exploratory analysis of tables of any size on Spark."""

from quarrylens.errors import AnalysisError

__all__ = ["AnalysisError"]
