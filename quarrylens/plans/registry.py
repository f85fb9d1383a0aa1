"""What a registered query is, and small helpers to write one."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LINEITEM_NUMBERS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                    "l_discount", "l_tax")


@dataclass(frozen=True)
class Query:
    """A query on the tables of a folder; ``sql`` is missing where SQL cannot say the same."""

    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def on(table: str, build: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """A query over one table."""
    return lambda spark, folder: build(read(spark, folder, table))


def rounded(df: DataFrame, digits: int = 6, *names: str) -> DataFrame:
    """Doubles rounded for comparison; ``-0.0`` becomes ``0.0``."""
    chosen = set(names) or {f.name for f in df.schema if f.dataType.typeName() in ("double", "float")}
    return df.select(*[(F.round(df[c], digits) + 0.0).alias(c) if c in chosen else df[c] for c in df.columns])


def text(column: Column | str) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("string")


def union_all(parts: Iterable[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def shared_folder(spark: SparkSession) -> str:
    """A new folder every executor can reach; a local one only where no shared one is named."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("a cluster must name a folder that all machines share in spark.checkpoint.dir")
        return tempfile.mkdtemp(prefix="quarrylens-")
    from uuid import uuid4

    return f"{named.rstrip('/')}/quarrylens-{uuid4().hex}"
