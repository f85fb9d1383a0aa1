"""Attach a per-value table to rows when single values may hold much of the data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_SHARE = 1000


def attach(rows: DataFrame, table: DataFrame, on: list[str], weight: str, total: int,
           payload: list[str]) -> DataFrame:
    """Left join of ``rows`` with a table of distinct keys whose ``weight`` counts the key's rows.

    A key is hot when it holds more than a quarter of an even shuffle partition, or more than
    1/1000 of ``total`` if that is less. Their number is bounded by arithmetic: they are broadcast, so their rows never meet in one task. Rows with a null key match nothing and are not
    shuffled at all. All other keys are joined by shuffle, where none of them can be hot.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    limit = max(total // max(HOT_SHARE, 4 * parts), 1)
    unkeyed = F.lit(False)
    for name in on:
        unkeyed = unkeyed | rows[name].isNull()
    types = {f.name: f.dataType for f in table.schema}
    unmatched = rows.where(unkeyed).select(*rows.columns, *[F.lit(None).cast(types[p]).alias(p) for p in payload])
    rows = rows.where(~unkeyed)
    hot = table.where(F.col(weight) > limit).select(*on, *[F.col(p).alias(f"__hot_{p}") for p in payload],
                                                    F.lit(True).alias("__is_hot"))
    tagged = rows.join(F.broadcast(hot), on, "left")
    plain = [c for c in rows.columns]
    done = tagged.where("__is_hot").select(*plain, *[F.col(f"__hot_{p}").alias(p) for p in payload])
    cold = table.where(F.col(weight) <= limit).select(*on, *payload)
    rest = tagged.where(F.col("__is_hot").isNull()).select(*plain).join(cold, on, "left").select(*plain, *payload)
    return done.unionByName(rest).unionByName(unmatched)
