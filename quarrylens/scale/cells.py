"""Order statistics without ordering a whole column, or a whole group, in one task.

A *cell* is an interval of the value range; cells are numbered in value order. Cell totals (a
small table) tell at which rank every cell starts, so only the rows of one cell are ever ordered
together, and a group that holds most of the table is still split over its cells. The cut points
come from a sample and reach the driver as a few numbers per column; they decide how even the
cells are, never what the result is.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.functions.values import finite_column

COLUMN, VALUE, CELL, COUNT = "__column", "__value", "__cell", "__n"
SAMPLE_ROWS = 100_000
MARGIN = 0.01
SLICES = 1024
EVEN_CUTS = tuple(i / 16 for i in range(1, 16))


@dataclass
class Summary:
    """Finite count, range, mean and quantiles of one column."""

    count: int
    low: float | None
    high: float | None
    mean: float | None = None
    q: list[float | None] = field(default_factory=list)


def _views(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """The finite view of each column under a private positional name."""
    return df.select(*keep, *[finite_column(df, c).alias(f"__x{i}") for i, c in enumerate(columns)])


def numbers_long(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """One row per finite cell: ``by`` columns, position of the column in ``columns``, value."""
    return (_views(df, columns, by)
            .unpivot(list(by), [f"__x{i}" for i in range(len(columns))], COLUMN, VALUE)
            .where(F.col(VALUE).isNotNull())
            .withColumn(COLUMN, F.substring(COLUMN, 4, 9).cast("int")))


def name_of(columns: Sequence[str]) -> Column:
    """The real name behind the position column of :func:`numbers_long`."""
    return F.array(*[F.lit(c) for c in columns])[F.col(COLUMN)]


def _ranges(views: DataFrame, width: int) -> list[Summary]:
    row = views.agg(*[f(f"__x{i}").alias(f"{tag}{i}") for i in range(width)
                      for tag, f in (("n", F.count), ("lo", F.min), ("hi", F.max), ("m", F.avg))]).first()
    return [Summary(row[f"n{i}"], row[f"lo{i}"], row[f"hi{i}"], row[f"m{i}"]) for i in range(width)]


def ranges(df: DataFrame, columns: Sequence[str]) -> dict[str, Summary]:
    """Finite count, range and mean of several columns from one scan."""
    columns = list(columns)
    return dict(zip(columns, _ranges(_views(df, columns), len(columns)))) if columns else {}


def cut_points(df: DataFrame, columns: Sequence[str], probs: Sequence[float] = EVEN_CUTS,
               summaries: list[Summary] | None = None) -> dict[int, list[float]]:
    """Range ends and sampled quantiles per column position, as cell boundaries."""
    views = _views(df, columns)
    summaries = summaries or _ranges(views, len(columns))
    rows = max((s.count for s in summaries), default=0)
    fraction = min(1.0, SAMPLE_ROWS / max(rows, 1))
    source = views if fraction == 1.0 else views.sample(fraction, seed=42)
    row = source.agg(*[
        F.percentile_approx(f"__x{i}", F.array(*[F.lit(p) for p in probs]), F.lit(1000)).alias(f"__x{i}")
        for i in range(len(columns))]).first()
    cuts = {i: [s.low, *(row[f"__x{i}"] or [s.low] * len(probs)), s.high]
            for i, s in enumerate(summaries) if s.count}
    return cuts or {0: [0.0] * (len(probs) + 2)}


def with_cell(long: DataFrame, key: str, value: str, cuts: dict) -> DataFrame:
    """Add the cell number of ``value``, monotone in ``value`` within one ``key``.

    ``cuts`` has one entry per schema column (or column pair), so the joined table is bounded by
    the schema however many rows the data has. Keys without cut points share one cell.
    """
    table = long.sparkSession.createDataFrame(list(cuts.items()), f"{key} int, __cuts array<double>")
    x, c = F.col(value), F.col("__cuts")
    bands = len(next(iter(cuts.values()))) - 1
    band = sum(((x >= c[i]).cast("int") for i in range(1, bands)), F.lit(0))
    low, width = F.col("__low"), F.col("__width")
    inside = F.when((width > 0) & (width < F.lit(float("inf"))), F.greatest(
        F.lit(0), F.least(F.floor((x - low) / width * SLICES), F.lit(SLICES - 1))).cast("int")).otherwise(0)
    return (long.join(F.broadcast(table), key)
            .withColumn("__band", band)
            .withColumn("__low", c[F.col("__band")])
            .withColumn("__width", c[F.col("__band") + 1] - F.col("__low"))
            # Never null, so that a later join infers no null check to push below this expression.
            .withColumn(CELL, F.coalesce(F.col("__band") * SLICES + inside, F.lit(0)))
            .drop("__cuts", "__band", "__low", "__width"))


def quantile_values(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> dict[str, Summary]:
    """Exact, linearly interpolated quantiles of whole columns, with finite count and range."""
    columns = list(columns)
    if not columns:
        return {}
    views = _views(df, columns)
    summaries = _ranges(views, len(columns))
    near = {min(max(p + d, 0.0), 1.0) for p in probs for d in (-MARGIN, MARGIN)} - {0.0, 1.0}
    cuts = cut_points(df, columns, sorted(near) or EVEN_CUTS, summaries)
    found = {r[COLUMN]: r["q"] for r in _from_cells(df, columns, probs, [], cuts).collect()}
    for i, s in enumerate(summaries):
        s.q = found.get(i) or [None] * len(probs)
    return dict(zip(columns, summaries))


def grouped_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float],
                      by: Sequence[str]) -> DataFrame:
    """Exact, linearly interpolated quantiles per group: ``by..., __column, __n, q array``.

    ``__column`` is the position in ``columns``; the null group is kept.
    """
    columns, by = list(columns), list(by)
    summaries = _ranges(_views(df, columns), len(columns))
    return _from_cells(df, columns, probs, by, cut_points(df, columns, EVEN_CUTS, summaries))


def _ranks(probs: Sequence[float]) -> list[tuple[Column, Column]]:
    """The two neighbouring ranks of every probability in a group of ``__total`` values."""
    last = F.col("__total") - 1
    return [(F.floor(F.lit(p) * last), F.ceil(F.lit(p) * last)) for p in probs]


def _pick(freq: DataFrame, keys: list[str], parts: list[str], probs: Sequence[float]) -> DataFrame:
    """Order distinct values inside ``parts``, read the wanted ranks of each group, interpolate.

    ``__start`` is the rank at which a part begins, ``__total`` the size of its group.
    """
    within = Window.partitionBy(*parts).orderBy(VALUE).rowsBetween(Window.unboundedPreceding, 0)
    freq = freq.withColumn("__upto", F.col("__start") + F.sum(COUNT).over(within))
    from_, upto, last = F.col("__upto") - F.col(COUNT), F.col("__upto"), F.col("__total") - 1
    ends, q = [], []
    for i, (p, pair) in enumerate(zip(probs, _ranks(probs))):
        ends += [F.max(F.when((rank >= from_) & (rank < upto), F.col(VALUE))).alias(f"__{end}{i}")
                 for end, rank in zip(("lo", "hi"), pair)]
        at = F.lit(p) * last
        q.append(F.col(f"__lo{i}") + (F.col(f"__hi{i}") - F.col(f"__lo{i}")) * (at - F.floor(at)))
    return (freq.groupBy(*keys, "__total").agg(*ends)
            .select(*keys, F.col("__total").alias(COUNT), F.array(*q).alias("q")))


def _from_cells(df: DataFrame, columns: list[str], probs: Sequence[float], by: list[str], cuts: dict) -> DataFrame:
    """Count cell totals, then group and order only the rows of the cells that hold a wanted rank."""
    keys = [*by, COLUMN]
    long = numbers_long(df, columns, by)
    if by:
        # The targets of many groups are joined by shuffle: a value that fills a group travels as one counted row.
        long = long.groupBy(*keys, VALUE).agg(F.count("*").alias("__rows"))
    else:
        long = long.withColumn("__rows", F.lit(1).cast("bigint"))
    celled = with_cell(long, COLUMN, VALUE, cuts)
    group = Window.partitionBy(*keys)
    totals = (celled.groupBy(*keys, CELL).agg(F.sum("__rows").alias(COUNT))
              .withColumn("__upto", F.sum(COUNT).over(group.orderBy(CELL)))
              .withColumn("__total", F.sum(COUNT).over(group)))
    start = F.col("__upto") - F.col(COUNT)
    wanted = F.lit(False)
    for rank in (r for pair in _ranks(probs) for r in pair):
        wanted = wanted | ((rank >= start) & (rank < F.col("__upto")))
    targets = totals.where(wanted).select(*keys, CELL, start.alias("__start"), "__total")
    if not by:
        # At most two cells per column and probability.
        targets = F.broadcast(targets)

    met = F.lit(True)
    for k in [*keys, CELL]:
        met = met & (F.col(f"c.{k}").eqNullSafe(F.col(f"t.{k}")) if k in by else F.col(f"c.{k}") == F.col(f"t.{k}"))
    freq = (celled.alias("c").join(targets.alias("t"), met)
            .select(*[F.col(f"c.{k}").alias(k) for k in [*keys, CELL, VALUE]], "c.__rows", "t.__start", "t.__total")
            .groupBy(*keys, CELL, "__start", "__total", VALUE).agg(F.sum("__rows").alias(COUNT)))
    return _pick(freq, keys, [*keys, CELL], probs)
