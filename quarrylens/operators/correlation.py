"""Pearson, Spearman and Kendall correlation over pairwise complete rows."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.errors import AnalysisError
from quarrylens.functions.bands import LEAKAGE, STRONG, direction, strength
from quarrylens.functions.kinds import numeric_columns, require_columns, require_numeric
from quarrylens.functions.values import finite_column
from quarrylens.scale.cells import COLUMN, VALUE, Summary, numbers_long, ranges
from quarrylens.scale.even import CELL, even_cuts, with_even_cell
from quarrylens.scale.inversions import equal_pairs, inversions, opposed_cells
from quarrylens.scale.longform import one_row_per

METHODS = ("pearson", "spearman", "kendall")
MIN_PAIR_ROWS, SURVEY_ROWS, TOP_LINKS = 3, 20, 3


def _views(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[finite_column(df, c).alias(f"__x{i}") for i, c in enumerate(columns)])


def safe_corr(a: Column, b: Column) -> Column:
    """Pearson correlation over rows where both are present; null when either side is constant."""
    both = a.isNotNull() & b.isNotNull()
    left, right = F.when(both, a), F.when(both, b)
    return F.try_divide(F.covar_pop(left, right), F.stddev_pop(left) * F.stddev_pop(right))


def _pearson(df: DataFrame, columns: list[str], pairs: list[tuple[int, int]]) -> DataFrame:
    views = _views(df, columns)
    summaries, rows = ranges(df, columns), df.count()
    if rows and all(s.count == rows for s in summaries.values()):
        return _complete_pearson(views, columns, pairs, [summaries[c] for c in columns])
    row = views.agg(*[a for i, j in pairs for a in (
        safe_corr(F.col(f"__x{i}"), F.col(f"__x{j}")).alias(f"r{i}_{j}"),
        F.count_if(F.col(f"__x{i}").isNotNull() & F.col(f"__x{j}").isNotNull()).alias(f"n{i}_{j}"))])
    return one_row_per(row, [
        {"left": F.lit(columns[i]), "right": F.lit(columns[j]), "n": F.col(f"n{i}_{j}"), "r": F.col(f"r{i}_{j}")}
        for i, j in pairs])


def _complete_pearson(views: DataFrame, columns: list[str], pairs: list[tuple[int, int]],
                      summaries: list[Summary]) -> DataFrame:
    """All pairs of columns without gaps: sums of products about means known from an earlier scan.

    Every pair has the same rows, so the sums of each column are shared between its pairs.
    """
    d = [F.col(c) - F.lit(s.mean) for c, s in zip(views.columns, summaries)]
    row = views.agg(F.count("*").alias("n"), *[a for i, x in enumerate(d) for a in (
        F.sum(x).alias(f"s{i}"), F.sum(x * x).alias(f"q{i}"))], *[
        F.sum(d[i] * d[j]).alias(f"p{i}_{j}") for i, j in pairs])

    sums = one_row_per(row, [{
        "left": F.lit(columns[i]), "right": F.lit(columns[j]), "n": F.col("n"), "p": F.col(f"p{i}_{j}"),
        "si": F.col(f"s{i}"), "sj": F.col(f"s{j}"), "qi": F.col(f"q{i}"), "qj": F.col(f"q{j}"),
        "constant": F.lit(any(summaries[k].low == summaries[k].high for k in (i, j)))} for i, j in pairs])

    def moment(product: str, a: str, b: str) -> Column:
        return F.col(product) - F.col(a) * F.col(b) / F.col("n")

    spread = F.sqrt(moment("qi", "si", "si")) * F.sqrt(moment("qj", "sj", "sj"))
    r = F.when(~F.col("constant"), F.try_divide(moment("p", "si", "sj"), spread))
    return sums.select("left", "right", "n", r.alias("r"))


class _Contexts:
    """Sets of complete rows that pairs of columns share, and the columns that are ranked in each.

    Columns with equal gaps have the same rows, and a pair whose one side has a value wherever the other has one has the rows of
    that other; so a table without gaps is one context, in which every column is ranked once for all its pairs.
    """

    def __init__(self, views: DataFrame, pairs: list[tuple[int, int]]) -> None:
        names = views.columns
        width = len(names)
        there = [F.col(c).isNotNull() for c in names]
        row = views.agg(*[F.count(c).alias(f"n{i}") for i, c in enumerate(names)], *[
            F.count_if(there[i] & there[j]).alias(f"n{i}_{j}") for i, j in pairs]).first()
        alone = [row[f"n{i}"] for i in range(width)]
        self.n = {(i, j): row[f"n{i}_{j}"] for i, j in pairs}

        def both(i: int, j: int) -> int:
            return alone[i] if i == j else self.n[min(i, j), max(i, j)]

        same = [next(a for a in range(width) if (a == i or (min(a, i), max(a, i)) in self.n) and both(a, i) == alone[a] == alone[i])
                for i in range(width)]
        held: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        for i, j in pairs:
            key = (same[i],) if both(i, j) == alone[i] else (same[j],) if both(i, j) == alone[j] else tuple(sorted((same[i], same[j])))
            held.setdefault(key, []).append((i, j))
        self.pairs = list(held.values())
        self.columns = [sorted({c for pair in some for c in pair}) for some in self.pairs]
        self.rows = [self.n[some[0]] for some in self.pairs]
        self.conditions = [F.lit(True) if not key else there[key[0]] & there[key[-1]] for key in held]


#: Spearman: lots into which rows that need no order are dealt.
LOTS = 1 << 12


def _spearman(df: DataFrame, columns: list[str], pairs: list[tuple[int, int]]) -> DataFrame:
    """Correlation of average ranks: every column of a context is ranked once, and the rows of a context keep together.

    Each place among the columns of a context is cut into even cells; a table of counts says at which rank a cell starts. Rows are
    dealt by the cells of one place after the other and ordered inside a cell. A cell of a single value has one rank and is not
    ordered: its rows, which may be most of the table, are dealt by lot, and a place that has only such cells is not dealt. So a row
    travels once for each column that has many values.
    """
    views = _views(df, columns)
    contexts = _Contexts(views, pairs)
    width = max(map(len, contexts.columns))

    def value(held: list[int], p: int) -> Column:
        # Zeros of either sign are equal.
        return F.col(f"__x{held[p]}") + F.lit(0.0) if p < len(held) else F.lit(None).cast("double")

    rows = views.withColumn("lot", F.pmod(F.monotonically_increasing_id(), F.lit(LOTS)).cast("int")).select("lot", F.inline(F.array(*[
        F.struct(F.when(contexts.conditions[k], F.lit(k)).alias("context"), *[value(held, p).alias(f"v{p}") for p in range(width)])
        for k, held in enumerate(contexts.columns)]))).where(F.col("context").isNotNull())

    def slot(p: int) -> Column:
        return (F.col("context") * width + p).alias("slot")

    long = rows.select(F.inline(F.array(*[F.struct(slot(p), F.col(f"v{p}").alias("value")) for p in range(width)]))).where(F.col("value").isNotNull())
    cuts = dict.fromkeys(range(len(contexts.columns) * width), []) | even_cuts(long, "slot", "value", apart=True)
    counts = with_even_cell(long, "slot", "value", cuts).groupBy("slot", CELL).agg(
        F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
    ahead = Window.partitionBy("slot").orderBy(CELL).rowsBetween(Window.unboundedPreceding, -1)
    cells = counts.withColumn("start", F.coalesce(F.sum("n").over(ahead), F.lit(0))).collect()  # one row for each cell
    middle = [(n + 1) / 2 for n in contexts.rows]
    # Ranks are counted from their mean; that of a single value is known at once.
    single = [(r["slot"], r["low"], r["start"] - middle[r["slot"] // width] + (r["n"] + 1) / 2) for r in cells if r["low"] == r["high"]]
    shared = [(r["slot"], r[CELL], r["start"] - middle[r["slot"] // width]) for r in cells if r["low"] < r["high"]]
    told = df.sparkSession.createDataFrame(single, "__slot int, __value double, __told double")
    begins = df.sparkSession.createDataFrame(shared, f"slot int, {CELL} int, __start double")
    many = {s % width for s, _, _ in shared}
    for p in sorted(range(width), key=lambda p: (p in many, p)):
        known = F.broadcast(told.where(F.pmod("__slot", F.lit(width)) == p))
        rows = rows.withColumn("slot", slot(p))
        rows = rows.join(known, (F.col("slot") == F.col("__slot")) & (F.col(f"v{p}") == F.col("__value")), "left").drop("__slot", "__value")
        if p not in many:
            rows = rows.withColumnRenamed("__told", f"r{p}").drop("slot", f"v{p}")
            continue
        rows = with_even_cell(rows, "slot", f"v{p}", cuts)
        # Lots are below zero, where no cell is.
        alone = F.col("__told").isNotNull() | F.col(f"v{p}").isNull()
        rows = rows.withColumn(CELL, F.when(alone, -1 - F.col("lot")).otherwise(F.col(CELL)))
        cell = Window.partitionBy("slot", CELL).orderBy(f"v{p}")
        upto = F.count(F.lit(1)).over(cell.rangeBetween(Window.unboundedPreceding, Window.currentRow))
        rows = rows.withColumn("__rank", (F.rank().over(cell) + upto) / 2).join(F.broadcast(begins), ["slot", CELL], "left")
        rows = rows.withColumn(f"r{p}", F.coalesce("__told", F.col("__start") + F.col("__rank"))).drop("slot", CELL, "__start", "__rank", "__told", f"v{p}")

    def total_of(k: int, i: int, j: int) -> Column:
        held = contexts.columns[k]
        return F.sum(F.when(F.col("context") == k, F.col(f"r{held.index(i)}") * F.col(f"r{held.index(j)}")))

    sums = rows.agg(*[total_of(k, i, j).alias(f"p{i}_{j}") for k, held in enumerate(contexts.pairs) for i, j in held], *[
        total_of(k, i, i).alias(f"q{k}_{i}") for k, held in enumerate(contexts.columns) for i in held])
    return one_row_per(sums, [
        {"left": F.lit(columns[i]), "right": F.lit(columns[j]), "n": F.lit(contexts.n[i, j]).cast("bigint"),
         "r": F.try_divide(F.col(f"p{i}_{j}"), F.sqrt(F.col(f"q{k}_{i}") * F.col(f"q{k}_{j}")))}
        for k, held in enumerate(contexts.pairs) for i, j in held])


#: Kendall: rows that a cell should hold, and how many cells a column has at most.
CELL_ROWS, MOST_CELLS = 1 << 16, 2048


def _kendall(df: DataFrame, columns: list[str], pairs: list[tuple[int, int]]) -> DataFrame:
    """Tau-b from exact discordant counts; every column is cut into cells once, for all its pairs.

    Two rows of a pair (x, y) are either in different cells of both columns, which a table of counts by two cells tells; or in
    one cell of x, or in one cell of y and different cells of x. So all rows are dealt once by the cells of each column, with
    their other columns, and opposite pairs are counted inside a cell by its task. A cell of a single value holds no opposite
    pair: it is told by the table of counts, and its rows, which may be most of the table, are not shuffled for that column.
    Ties are counted beside. A cell of n rows needs memory in proportion to n: that is ``CELL_ROWS`` up to ``MOST_CELLS`` cells,
    and a 2,048th of the rows beyond.
    """
    views = _views(df, columns)
    long = numbers_long(df, columns)
    summary = ranges(df, columns)
    wanted = min(max(max((s.count for s in summary.values()), default=0) // CELL_ROWS, 64), MOST_CELLS)
    cuts = even_cuts(long, COLUMN, VALUE, cells=wanted, apart=True, most_rows=1 << 62)
    points = [cuts.get(i, []) for i in range(len(columns))]
    depth = max(map(len, points)).bit_length()
    padded = [[*p, *[math.inf] * ((1 << depth) - 1 - len(p))] for p in points]
    single = [[False, *[b == math.nextafter(a, math.inf) for a, b in zip(p, [*p[1:], None]) if b is not None], False] for p in points]
    sent = df.sparkSession.createDataFrame([(0, padded, [s or [False] for s in single])],
                                           "__all int, cuts array<array<double>>, single array<array<boolean>>")
    wide = views.withColumn("__all", F.lit(0)).join(F.broadcast(sent), "__all")
    for i in range(len(columns)):
        wide = wide.withColumn(f"c{i}", F.lit(0))
        for level in reversed(range(depth)):
            step = 1 << level
            reached = F.coalesce(F.col(f"__x{i}") >= F.col("cuts")[i][F.col(f"c{i}") + (step - 1)], F.lit(False))
            wide = wide.withColumn(f"c{i}", F.col(f"c{i}") + F.when(reached, F.lit(step)).otherwise(F.lit(0)))
    wide = wide.select(*views.columns, *[f"c{i}" for i in range(len(columns))],
                       *[F.coalesce(F.get(F.col("single")[i], F.col(f"c{i}")), F.lit(False)).alias(f"s{i}") for i in range(len(columns))])

    def both(i: int, j: int) -> Column:
        return F.col(f"__x{i}").isNotNull() & F.col(f"__x{j}").isNotNull()

    tables = (wide.select(F.inline(F.array(*[F.struct(
        F.when(both(i, j), F.lit(p)).alias("pair"), F.col(f"c{i}").alias("x"), F.col(f"c{j}").alias("y"), F.col(f"s{i}").alias("sx"),
        F.col(f"s{j}").alias("sy")) for p, (i, j) in enumerate(pairs)])))
        .where(F.col("pair").isNotNull()).groupBy("pair", "x", "y", "sx", "sy").agg(F.count("*").alias("n")))
    found = "pair int, n bigint, opposed double, n1 double, n2 double, n3 double"

    def between(held: pd.DataFrame) -> pd.DataFrame:
        """Rows in different cells of both columns, and ties that single values make: one pair of columns."""
        grid = np.zeros((held["x"].max() + 1, held["y"].max() + 1), np.int64)
        n = held["n"].to_numpy()
        grid[held["x"], held["y"]] = n

        def ties(some: pd.Series) -> float:
            m = some.to_numpy(float)
            return float((m * (m - 1) / 2).sum())

        return pd.DataFrame([{"pair": held["pair"].iloc[0], "n": int(n.sum()), "opposed": opposed_cells(grid),
                              "n1": ties(held[held["sx"]].groupby("x")["n"].sum()), "n2": ties(held[held["sy"]].groupby("y")["n"].sum()),
                              "n3": ties(held[held["sx"] & held["sy"]]["n"])}])

    dealt = wide.select("*", F.inline(F.array(*[F.struct(
        F.when(F.col(f"__x{i}").isNotNull() & ~F.col(f"s{i}"), F.lit(i)).alias("column"), F.col(f"c{i}").alias("cell")) for i in range(len(columns))])))
    dealt = dealt.where(F.col("column").isNotNull())

    def within(held: pd.DataFrame) -> pd.DataFrame:
        """The rows of one cell of a column: its pairs with every other column."""
        c, rows = int(held["column"].iloc[0]), []
        for p, (i, j) in enumerate(pairs):
            if c not in (i, j):
                continue
            other = j if c == i else i
            some = held[held[f"__x{other}"].notna()]
            own, there = some[f"__x{c}"].to_numpy(), some[f"__x{other}"].to_numpy()
            if c == i:
                rows.append((p, 0, float(inversions(own, there)), equal_pairs(own), 0.0, equal_pairs(own, there)))
            else:
                alone = some[f"s{other}"].to_numpy()
                rows.append((p, 0, float(inversions(some[f"c{other}"].to_numpy(), own)), 0.0, equal_pairs(own), equal_pairs(own[alone], there[alone])))
        return pd.DataFrame(rows, columns=["pair", "n", "opposed", "n1", "n2", "n3"])

    parts = (tables.groupBy("pair").applyInPandas(between, found)
             .unionByName(dealt.groupBy("column", "cell").applyInPandas(within, found)))
    sums = parts.groupBy("pair").agg(*[F.sum(c).alias(c) for c in ("n", "opposed", "n1", "n2", "n3")])
    n0 = F.col("n").cast("double") * (F.col("n") - 1) / 2
    score = n0 - F.col("n1") - F.col("n2") + F.col("n3") - 2 * F.col("opposed")
    tau = F.try_divide(score, F.sqrt((n0 - F.col("n1")) * (n0 - F.col("n2"))))
    left, right = (F.array(*[F.lit(columns[pair[side]]) for pair in pairs])[F.col("pair")] for side in (0, 1))
    return sums.select(left.alias("left"), right.alias("right"), "n", tau.alias("r"))


_COMPUTE = {"pearson": _pearson, "spearman": _spearman, "kendall": _kendall}


def pair_table(df: DataFrame, columns: Sequence[str] | None = None, method: str = "pearson") -> DataFrame:
    """``left, right, n, r`` for every unordered pair of numeric columns, ``r`` not rounded."""
    if method not in METHODS:
        raise AnalysisError(f"Unsupported correlation method: {method}")
    columns = list(columns) if columns is not None else numeric_columns(df)
    require_columns(df, columns)
    pairs = list(combinations(range(len(columns)), 2))
    if not pairs:
        return df.sparkSession.createDataFrame([], "left string, right string, n bigint, r double")
    return _COMPUTE[method](df, columns, pairs)


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None, method: str = "pearson") -> DataFrame:
    """The whole matrix as ``left, right, r`` rows; the diagonal is 1, or null for a constant column."""
    columns = list(columns) if columns is not None else numeric_columns(df)
    half = pair_table(df, columns, method).select("left", "right", F.round("r", 6).alias("r"))
    if not columns:
        return half
    views = _views(df, columns)
    spread = views.agg(*[(F.min(c) < F.max(c)).alias(c) for c in views.columns])
    diagonal = one_row_per(spread, [
        {"left": F.lit(c), "right": F.lit(c), "r": F.when(F.col(f"__x{i}"), F.lit(1.0))}
        for i, c in enumerate(columns)])
    # Both halves from one computation of the pairs.
    both = half.select(F.inline(F.array(
        F.struct("left", "right", "r"),
        F.struct(F.col("right").alias("left"), F.col("left").alias("right"), F.col("r")))))
    return both.unionByName(diagonal)


def strong_pairs(df: DataFrame, columns: Sequence[str] | None = None, method: str = "pearson",
                 threshold: float = STRONG) -> DataFrame:
    """``left, right, value, direction`` for pairs at or above the threshold, strongest first."""
    return (pair_table(df, columns, method).where(F.abs("r") >= threshold)
            .orderBy(F.desc(F.abs("r")), "left", "right")
            .select("left", "right", F.round("r", 4).alias("value"), direction(F.col("r")).alias("direction")))


def pair_relationship(df: DataFrame, left: str, right: str, method: str = "pearson") -> DataFrame:
    """``left, right, correlation, strength`` of one pair."""
    require_numeric(df, [left, right])
    return pair_table(df, [left, right], method).select(
        "left", "right", F.round("r", 6).alias("correlation"), strength(F.col("r")).alias("strength"))


def pair_correlation(df: DataFrame, left: str, right: str) -> DataFrame:
    """Pearson correlation of one pair with the number of complete rows; errors when undefined."""
    require_numeric(df, [left, right])
    if left == right:
        raise AnalysisError("left and right name one and the same column")
    found = pair_table(df, [left, right])
    row = found.first()
    if row["n"] < MIN_PAIR_ROWS:
        raise AnalysisError(f"left, right: {row['n']} rows hold {left} and {right}, too few for a coefficient")
    if row["r"] is None:
        raise AnalysisError(f"left, right: no coefficient, as {left} or {right} is constant")
    return found.select("left", "right", F.round("r", 6).alias("correlation"), strength(F.col("r")).alias("strength"),
                        direction(F.col("r")).alias("direction"), F.col("n").alias("observations"))


def correlation_survey(df: DataFrame, columns: Sequence[str] | None = None, limit: int = SURVEY_ROWS) -> DataFrame:
    """The strongest pairs with bands, and how many pairs are strong in all."""
    columns = list(columns) if columns is not None else numeric_columns(df)
    if len(columns) < 2:
        raise AnalysisError("columns: at least two numeric ones are needed")
    pairs = pair_table(df, columns).where(F.col("r").isNotNull())
    strong = pairs.agg(F.count_if(F.abs("r") >= STRONG)).scalar()
    r = F.col("r")
    return (pairs.orderBy(F.desc(F.abs("r")), "left", "right").limit(limit)
            .select("left", "right", F.round("r", 4).alias("correlation"), strength(r).alias("strength"),
                    direction(r).alias("direction"), strong.alias("strong_count")))


def leakage_screen(df: DataFrame, target: str, candidates: Sequence[str] | None = None) -> DataFrame:
    """``feature, n, r, leaked``: numeric columns that all but repeat the target are flagged."""
    require_numeric(df, [target])
    candidates = [c for c in (candidates if candidates is not None else numeric_columns(df)) if c != target]
    require_numeric(df, candidates)
    y = finite_column(df, target)
    row = df.agg(*[a for i, c in enumerate(candidates) for a in (
        safe_corr(finite_column(df, c), y).alias(f"r{i}"),
        F.count_if(finite_column(df, c).isNotNull() & y.isNotNull()).alias(f"n{i}"))])
    return one_row_per(row, [
        {"feature": F.lit(c), "n": F.col(f"n{i}"), "r": F.round(f"r{i}", 6),
         "leaked": F.coalesce((F.abs(f"r{i}") >= LEAKAGE) & (F.col(f"n{i}") >= MIN_PAIR_ROWS), F.lit(False))}
        for i, c in enumerate(candidates)])
