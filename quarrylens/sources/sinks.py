"""Writing result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from quarrylens.errors import AnalysisError
from quarrylens.functions.values import json_safe

EXPORT_FORMATS = ("parquet", "json")


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines without NaN or infinity."""
    json_safe(df).write.mode("error").json(path)


def export_report(sections: dict[str, dict[str, DataFrame]], path: str, format: str = "parquet") -> list[str]:
    """Write every table of a report to ``path/section/table``; returns the folders written."""
    if format not in EXPORT_FORMATS:
        raise AnalysisError(f"Unsupported report format: {format}")
    written = []
    for section, tables in sections.items():
        for name, table in tables.items():
            target = f"{path.rstrip('/')}/{section}/{name}"
            json_safe(table).write.mode("error").format(format).save(target)
            written.append(target)
    return written
