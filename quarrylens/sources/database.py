"""Read-only queries against a database through JDBC."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from quarrylens.errors import AnalysisError
from quarrylens.sources.typing import normalize

_SELECT = re.compile(r"^\s*select\b", re.IGNORECASE)


def read_only(query: str) -> str:
    """The query, when it is a single SELECT; anything else is refused."""
    body = query.strip().rstrip(";").strip()
    if not _SELECT.match(body) or ";" in body:
        raise AnalysisError("query: one statement that begins with SELECT is asked for")
    return body


def load_query(spark: SparkSession, url: str, query: str, properties: dict[str, str] | None = None,
               partition_column: str | None = None, lower: int | None = None, upper: int | None = None,
               partitions: int = 1) -> DataFrame:
    """Run one SELECT in the database and read its result.

    With ``partition_column`` and its range the result is read in parallel slices; without, one
    connection reads it all, as the database has no other split to offer.
    """
    body = read_only(query)
    reader = spark.read.format("jdbc").option("url", url).options(**(properties or {}))
    if partition_column is None:
        reader = reader.option("query", body)
    else:
        if lower is None or upper is None:
            raise AnalysisError("A partitioned read needs the lower and upper end of the partition column")
        reader = (reader.option("dbtable", f"({body}) q").option("partitionColumn", partition_column)
                  .option("lowerBound", lower).option("upperBound", upper).option("numPartitions", partitions))
    try:
        return normalize(reader.load())
    except Exception as error:
        raise AnalysisError(f"query: the database refused it: {error}") from error
