"""What the operators of this subpackage share: tables in the shared folder, the words of a text, components of links."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that separate words.
GAP = r"[\x20\x09-\x0D]"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster names in ``spark.checkpoint.dir``; a folder of its own in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("a cluster must name a folder that all machines share in spark.checkpoint.dir")
        base = f"file://{tempfile.mkdtemp(prefix='quarrylens-llm-')}"
    return f"{base.rstrip('/')}/{name}-{uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """The frame written to the shared folder and read again: its lineage ends there, and any executor can read it."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of rows that a task hands to Python at once; a longer row goes alone.
BATCH = 2 << 20


@contextmanager
def small_batches(spark: SparkSession, size: int = BATCH) -> Iterator[None]:
    """What runs inside hands Arrow batches of about ``size`` bytes to Python, not ones of 10,000 rows.

    A batch of whole texts takes its size several times over outside the heap: in the columns that grow by doubling, in the buffer
    of the pipe and in Python. The session's own figure comes back at the end. Results must not depend on where batches end.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(size))
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside go as soon as its result is written, not when the driver next collects its garbage.

    For steps that ``cut`` ends: each has a plan of its own, so nothing reads its shuffles again.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def n_words(text: Column) -> Column:
    """The number of words of a text, 0 for null."""
    parts = F.size(F.split(text, f"{GAP}+", -1))
    edges = text.rlike(f"^{GAP}").cast("int") + text.rlike(f"{GAP}$").cast("int")
    return F.when(text.isNull() | (text == ""), F.lit(0)).otherwise(parts - edges).cast("long")


#: Words of a bitmap that tells which rows may be wanted: 4 MB of bits, whatever the data.
BITMAP = 1 << 19


def marked(rows: DataFrame, value: Column, wanted: DataFrame, flag: str) -> DataFrame:
    """``rows`` with a boolean ``flag``: true where ``value`` may be in the single column of ``wanted``, false where it is not.

    Wanted values set bits of a bitmap that is sent to the tasks, so no row is shuffled; equal types are asked for. Nulls
    count as a value. Rows marked by chance are left to an exact join behind this one.
    """
    def word(v: Column) -> Column:
        return F.shiftright(F.pmod(F.xxhash64(v), F.lit(BITMAP * 64)), 6)

    bitmap = (wanted.toDF("__wanted").select(word(F.col("__wanted")).alias("__word"),
                         F.expr("shiftleft(1L, cast(pmod(xxhash64(__wanted), 64) as int))").alias("__bit"))
              .groupBy("__word").agg(F.bit_or("__bit").alias("__bits")))
    bit = F.pmod(F.xxhash64(value), F.lit(64)).cast("int")
    seen = F.getbit(F.coalesce(F.col("__bits"), F.lit(0).cast("long")), bit) == 1
    return rows.join(F.broadcast(bitmap), word(value) == F.col("__word"), "left").withColumn(flag, seen).drop("__word", "__bits")


def components(links: DataFrame) -> DataFrame:
    """``(id, component)`` for every end of ``links(a, b)``: the smallest id that can be reached.

    Each round hooks every vertex to its smallest neighbour, jumps to the roots of the trees that come of it, and goes on with
    the links between different roots. In two rounds a root either ends below another one or takes in at least one, so the
    vertices left are halved at least, whatever the order of ids along a path; jumps are logarithmic in a tree's depth. A hub
    is summed up map-side before the shuffle. Every step is written to the shared folder. No links give no rows.
    """
    ends = cut(links.select("a", "b").where("a <> b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))
                                                            .where("a <> b")).distinct(), "links")
    rounds: list[DataFrame] = []
    while not rounds or not ends.isEmpty():
        trees = cut(ends.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "trees")
        while True:
            above = trees.select(F.col("id").alias("root"), F.col("root").alias("next"))
            jumped = cut(trees.join(above, "root").select("id", F.col("next").alias("root"), (F.col("next") < F.col("root")).alias("moved")), "trees")
            trees = jumped.select("id", "root")
            if jumped.where("moved").isEmpty():
                break
        rounds.append(trees)
        ends = cut(ends.join(trees.select(F.col("id").alias("a"), F.col("root").alias("x")), "a")
                   .join(trees.select(F.col("id").alias("b"), F.col("root").alias("y")), "b")
                   .where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "links")
    labels = rounds.pop()
    while rounds:  # a root of an earlier round that has no link left is its own label
        later = labels.select(F.col("id").alias("root"), F.col("root").alias("next"))
        labels = cut(rounds.pop().join(later, "root", "left").select("id", F.coalesce("next", "root").alias("root")), "labels")
    return labels.select("id", F.col("root").alias("component"))
