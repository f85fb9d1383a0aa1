"""Cells that hold about as many rows each, whatever the values.

A *cell* is an interval of the value range; cells are numbered in value order. Where they are cut comes from mergeable quantile
sketches (one aggregate for all keys); a cell that still holds too many rows is sketched by itself and cut again. The cuts reach
the driver as numbers: at most ``CELLS`` for a key, and two for every ``MOST_ROWS`` rows beyond that. They decide how even the
cells are, never what a result is. A far value moves no cut, as cuts are ranks and not distances.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELL = "__cell"
CELLS = 512
#: Items of a sketch: ranks are right to about 0.07 percent, a third of a cell.
ACCURACY = 8192
#: Rows of a cell above which it is cut again, and the pieces it is cut into.
MOST_ROWS, PIECES = 1 << 22, 64


def _quantiles(value: str, pieces: int) -> Column:
    return F.kll_sketch_get_quantile_double(F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(ACCURACY)),
                                            F.array(*[F.lit(i / pieces) for i in range(1, pieces)]))


def _cuts(found: list[float], apart: bool) -> list[float]:
    """Sorted cut points; with ``apart``, a value met twice gets a cell of its own."""
    cuts = set(found)
    if apart:
        cuts |= {math.nextafter(a, math.inf) for a, b in zip(found, found[1:]) if a == b}
    return sorted(cuts)


def even_cuts(long: DataFrame, key: str, value: str, cells: int = CELLS, apart: bool = False, most_rows: int = MOST_ROWS) -> dict[int, list[float]]:
    """For each whole-number ``key`` the points at which its finite values are cut; the number of keys is bounded by the schema."""
    rows = long.groupBy(key).agg(F.count(value).alias("n"), _quantiles(value, cells).alias("q")).collect()
    cuts = {r[key]: _cuts(r["q"] or [], apart) for r in rows}
    crowded = max((r["n"] for r in rows), default=0) * 2 > cells * most_rows
    while crowded:
        celled = with_even_cell(long, key, value, cuts)
        full = (celled.groupBy(key, CELL).agg(F.count(value).alias("n"), F.min(value).alias("low"), F.max(value).alias("high"))
                .where((F.col("n") > most_rows) & (F.col("low") < F.col("high"))).select(key, CELL))
        # Two cells at most for every ``most_rows`` rows are full.
        found = celled.join(full, [key, CELL]).groupBy(key, CELL).agg(_quantiles(value, PIECES).alias("q")).collect()
        before = sum(map(len, cuts.values()))
        for r in found:
            cuts[r[key]] = sorted({*cuts[r[key]], *_cuts(r["q"], True)})
        crowded = sum(map(len, cuts.values())) > before
    return cuts


def placed(value: Column | str, cuts: Column | str) -> Column:
    """The number of cut points that ``value`` reaches, where the sorted points are few."""
    return F.size(F.filter(cuts, lambda c: c <= (F.col(value) if isinstance(value, str) else value)))


def with_even_cell(long: DataFrame, key: str, value: str, cuts: dict[int, list[float]]) -> DataFrame:
    """Add the cell number of ``value``, monotone in ``value`` within one ``key``: a binary search in generated code."""
    depth = max(map(len, cuts.values()), default=0).bit_length()
    width = (1 << depth) - 1
    table = [(k, [*points, *[math.inf] * (width - len(points))]) for k, points in cuts.items()]
    sent = long.sparkSession.createDataFrame(table, f"{key} int, __cuts array<double>")
    out = long.join(F.broadcast(sent), key).withColumn(CELL, F.lit(0))
    for level in reversed(range(depth)):
        step = 1 << level
        # Never null, so that a later join infers no null check to push below these expressions.
        reached = F.coalesce(F.col(value) >= F.col("__cuts")[F.col(CELL) + (step - 1)], F.lit(False))
        out = out.withColumn(CELL, F.col(CELL) + F.when(reached, F.lit(step)).otherwise(F.lit(0)))
    return out.drop("__cuts")


def running_before(freq: DataFrame, key: str, value: str, weights: dict[str, str], order: str | None = None,
                   equal: str | None = None) -> DataFrame:
    """The sum of each weight over the rows of a key with smaller values, for rows that differ in value.

    ``weights`` maps a weight column to the name of its running column. ``order`` names a column of finer order that ``value``
    follows, such as long numbers beside their doubles; ``equal`` adds a flag of rows whose order is that of the row before.
    Cells are ordered each by itself; their totals, a small table, carry the offsets.
    """
    celled = with_even_cell(freq, key, value, even_cuts(freq, key, value))
    ahead = Window.partitionBy(key).orderBy(CELL).rowsBetween(Window.unboundedPreceding, -1)
    offsets = celled.groupBy(key, CELL).agg(*[F.sum(w).alias(f"__t_{w}") for w in weights]).select(
        key, CELL, *[F.coalesce(F.sum(f"__t_{w}").over(ahead), F.lit(0)).alias(f"__o_{w}") for w in weights])
    inside = Window.partitionBy(key, CELL).orderBy(order or value)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    for weight, out in weights.items():
        celled = celled.withColumn(out, F.coalesce(F.sum(weight).over(before), F.lit(0)))
    if equal:
        celled = celled.withColumn(equal, F.coalesce(F.lag(order or value).over(inside) == F.col(order or value), F.lit(False)))
    joined = celled.join(offsets, [key, CELL])
    for weight, out in weights.items():
        joined = joined.withColumn(out, F.col(out) + F.col(f"__o_{weight}"))
    return joined.drop(CELL, *[f"__o_{w}" for w in weights])
