"""The one exception raised for requests an operator cannot serve."""

from __future__ import annotations


class AnalysisError(ValueError):
    """A column, argument or table does not meet what the operator needs."""
