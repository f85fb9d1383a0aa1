"""Parts of exact size: the rows of the smallest order numbers of every stratum, without ordering a stratum.

The order number of a row is a hash, so it does not depend on how the table is read. The place where a stratum is cut is found
digit by digit: the rows of every digit are counted, the digit that holds the wanted rank is kept, and only rows that begin with
the digits found are counted again. Each count is one aggregate of at most ``2 ** DIGIT`` rows for each stratum; four of them
reach any row of a thousand billion. Rows that are equal in all columns cannot be told apart: they stay one row with two weights.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIGIT, DIGITS = 12, 5
#: The greatest order word: 60 bits.
LAST = (1 << DIGIT * DIGITS) - 1
MOST_STRATA = 1000
STRATUM, FIRST, SECOND, TRAIN, TEST = "__stratum", "__first", "__second", "__train", "__held"


@dataclass
class Limit:
    """The last order number of the wanted rows of a stratum, and how many of the rows that have it are wanted."""

    first: int
    second: int
    wanted: int
    there: int


def key_order(keys: Sequence[Column]) -> Column:
    """An order word that SQL can repeat: the first 60 bits of the MD5 of the keys as text, joined by a bar."""
    said = F.concat_ws("|", *[F.coalesce(k.cast("string"), F.lit("")) for k in keys])
    return F.conv(F.substring(F.md5(said), 1, 15), 16, 10).cast("bigint")


def row_order(columns: Sequence[Column], seed: int) -> Column:
    """An order word from all columns."""
    return F.shiftrightunsigned(F.xxhash64(*columns, F.lit(seed)), 4)


def _limits(rows: DataFrame, wanted: dict[str, int]) -> dict[str, Limit]:
    """For each stratum the limit of its ``wanted`` smallest rows by (first, second)."""
    found: dict[str, Limit] = {}
    state = {s: (0, 0, k) for s, k in wanted.items() if k > 0}  # resolved bits of both words as whole numbers, rank left
    for level in range(2 * DIGITS):
        if not state:
            break
        word, depth = (FIRST, level) if level < DIGITS else (SECOND, level - DIGITS)
        shift = DIGIT * (DIGITS - 1 - depth)

        def held(place: int) -> Column:
            return F.create_map(*[F.lit(v) for s, at in state.items() for v in (s, at[place])])[F.col(STRATUM)]

        inside = held(0).isNotNull()
        if level >= DIGITS:
            inside = inside & (F.col(FIRST) == held(0))
        if depth:
            inside = inside & (F.shiftright(word, shift + DIGIT) == held(0 if word == FIRST else 1))
        digit = F.shiftright(word, shift).bitwiseAND((1 << DIGIT) - 1)
        counts = rows.where(inside).groupBy(STRATUM, digit.alias("digit")).agg(F.count(F.lit(1)).alias("n"))
        upto = F.sum("n").over(Window.partitionBy(STRATUM).orderBy("digit"))
        place = (counts.withColumn("upto", upto).withColumn("rank", held(2)).where("upto >= rank")
                 .groupBy(STRATUM).agg(F.min_by(F.struct("digit", "n", "upto", "rank"), "digit").alias("at")))
        for row in place.collect():  # one row for each stratum
            a, b, _ = state.pop(row[STRATUM])
            left = row["at"]["rank"] - (row["at"]["upto"] - row["at"]["n"])
            a, b = ((a << DIGIT) | row["at"]["digit"], b) if word == FIRST else (a, (b << DIGIT) | row["at"]["digit"])
            if left == row["at"]["n"] or level == 2 * DIGITS - 1:
                low = (1 << shift) - 1
                limit = ((a << shift) | low, LAST) if word == FIRST else (a, (b << shift) | low)
                found[row[STRATUM]] = Limit(*limit, left, row["at"]["n"])
            else:
                state[row[STRATUM]] = (a, b, left)
    return found


def exact_parts(rows: DataFrame, wanted: dict[str, int]) -> tuple[DataFrame, bool]:
    """``rows`` with ``__train`` and ``__held`` weights: exactly ``wanted`` rows of every stratum are held out.

    ``rows`` has ``__stratum`` (text, never null) and the order words ``__first`` and ``__second``, which are dropped. Weights
    are 0 and 1, but for equal rows on which a stratum is cut: these become one row whose weights count them, and the second
    result tells that there are such rows.
    """
    if len(wanted) > MOST_STRATA:
        raise ValueError(f"at most {MOST_STRATA} strata can be parted exactly, not {len(wanted)}")
    limits = _limits(rows, wanted)
    names = [c for c in rows.columns if c not in (FIRST, SECOND)]
    if not limits:
        return rows.select(*names, F.lit(1).cast("bigint").alias(TRAIN), F.lit(0).cast("bigint").alias(TEST)), False

    def of(attribute: str) -> Column:
        return F.create_map(*[F.lit(v) for s, at in limits.items() for v in (s, getattr(at, attribute))])[F.col(STRATUM)]

    inside = F.coalesce((F.col(FIRST) < of("first")) | ((F.col(FIRST) == of("first")) & (F.col(SECOND) <= of("second"))), F.lit(False))
    parted = [s for s, at in limits.items() if at.wanted < at.there]
    whole = inside.cast("bigint")
    if not parted:
        return rows.select(*names, (1 - whole).alias(TRAIN), whole.alias(TEST)), False
    on_limit = F.coalesce(F.col(STRATUM).isin(parted) & (F.col(FIRST) == of("first")) & (F.col(SECOND) == of("second")), F.lit(False))
    plain = rows.where(~on_limit).select(*names, (1 - whole).alias(TRAIN), whole.alias(TEST))
    equal = rows.where(on_limit).groupBy(*names).agg(F.count(F.lit(1)).alias("__n"))
    held = F.least(of("wanted").cast("bigint"), F.col("__n"))
    return plain.unionByName(equal.select(*names, (F.col("__n") - held).alias(TRAIN), held.alias(TEST))), True
