"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Every document gets a rate of at most CAP copies. Among all rates that meet a source's token target, those closest in
relative entropy to equal rates are exponentially tilted in the document's size: ``rate = min(CAP, exp(lambda * size /
mean))``. The multiplier of each source solves a convex dual by Newton steps, distributed over all sources at once; they
run over the number of documents by source and size, so an iteration never touches the documents. Rates are rounded into
whole copies along the sizes of a source, so that the rounding errors of neighbouring sizes cancel, and one more step per
source gives or takes copies of the sizes that fit the rest best.

Edge cases: a null or empty text has size 0 and takes no words; it gets one copy. Null is a source of its own and sorts
last. Repeated rows are documents of their own. An empty table gives an empty mix. A source without words has target 0.
Other columns are neither read nor returned; working columns have names of their own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.llm.common import cut, n_words

#: Copies that a document can have at most, and a source's target in multiples of its size.
CAP = 3
#: Newton steps at most; a source is done when its rates meet the target to this share.
STEPS, CLOSE = 40, 1e-9
#: Sizes in one band of the running sums, and documents of one size in one numbering task, about.
BAND, TOGETHER = 64, 256
#: Rounds that fit what rounding left over.
FITS = 4


def sizes(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``(key, source, size)``: the words of every document."""
    return docs.select(F.col(key).alias(key), F.col(source).cast("string").alias("source"), n_words(F.col(text)).alias("size"))


def targets(sized: DataFrame, weights: Sequence[float] = (1, 2, 3)) -> DataFrame:
    """``(source, source_size, docs, target)``: all words shared by weight, no source above CAP times its own words.

    Sources are numbered by code point, null last, and take the weights in turn. The excess of capped sources is shared
    again by weight: capped are those of the smallest size per weight, and how many is known from running sums over
    sources in that order. These windows run over one row per source.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    everyone = Window.orderBy(F.col("source").isNull(), F.col("source"))
    numbered = totals.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))),
                                                        (F.pmod(F.row_number().over(everyone) - 1, F.lit(len(weights))) + 1).cast("int")))
    ranked = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = ranked.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    full = (numbered.withColumn("capped_words", F.coalesce(F.sum(CAP * F.col("source_size")).over(before), F.lit(0)))
            .withColumn("weight_left", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
            .withColumn("left", F.sum("source_size").over(whole) - F.col("capped_words"))
            .withColumn("fits", CAP * F.col("source_size") * F.col("weight_left") >= F.col("left") * F.col("weight")))
    # From the first source that is not capped on, all share what is left in proportion to their weights.
    level = F.min(F.when(F.col("fits"), F.struct(F.col("source_size") / F.col("weight"), F.col("left") / F.col("weight_left")))).over(whole)
    return full.withColumn("level", level["col2"]).select(
        "source", "source_size", "docs", F.coalesce(F.least(CAP * F.col("source_size").cast("double"), F.col("level") * F.col("weight")),
                                                    F.lit(0.0)).alias("target"))


def _rate(multiplier: Column, u: Column) -> Column:
    return F.least(F.lit(float(CAP)), F.exp(F.least(multiplier * u, F.lit(50.0))))


def multipliers(cells: DataFrame, goals: DataFrame) -> DataFrame:
    """``(source, multiplier, done)``: the dual solution of every source, by Newton steps inside a shrinking bracket.

    ``cells(source, size, u, n)`` counts documents; a step is one aggregate over them. The dual's slope is the words that
    the rates give; where a Newton step leaves the bracket known to hold the solution, the step halves the bracket.
    """
    big = 1e6
    state = cut(goals.select("source", "target", F.lit(0.0).alias("multiplier"), F.lit(-big).alias("low"), F.lit(big).alias("high"),
                             (F.col("source_size") == 0).alias("done")), "multipliers")
    for _ in range(STEPS):
        rate = _rate(F.col("multiplier"), F.col("u"))
        sums = (cells.join(state.where(~F.col("done")), cells["source"].eqNullSafe(state["source"]))
                .groupBy(state["source"].alias("source")).agg(
                    F.sum(rate * F.col("n") * F.col("size")).alias("words"),
                    F.sum(F.when(rate < CAP, rate * F.col("n") * F.col("size") * F.col("u")).otherwise(0.0)).alias("slope")))
        old, new = state.alias("s"), sums.alias("n")
        gap = F.col("n.words") - F.col("s.target")
        low = F.when(gap < 0, F.col("s.multiplier")).otherwise(F.col("s.low"))
        high = F.when(gap > 0, F.col("s.multiplier")).otherwise(F.col("s.high"))
        step = F.col("s.multiplier") - gap / F.col("n.slope")
        # Far brackets are opened by doubling, near ones are halved.
        middle = F.when(high >= big, F.greatest(low, F.lit(0.5)) * 2).when(low <= -big, F.least(high, F.lit(-0.5)) * 2).otherwise((low + high) / 2)
        met = (F.abs(gap) <= CLOSE * F.col("s.target")) | (F.abs(F.col("s.multiplier")) > 1e4)
        inside = (F.col("n.slope") > 0) & (step > low) & (step < high) & (F.abs(step - F.col("s.multiplier")) < 8)
        state = cut(old.join(new, F.col("s.source").eqNullSafe(F.col("n.source")), "left").select(
            F.col("s.source").alias("source"), F.col("s.target").alias("target"),
            F.when(F.col("n.words").isNull() | met, F.col("s.multiplier")).when(inside, step).otherwise(middle).alias("multiplier"),
            F.coalesce(low, F.col("s.low")).alias("low"), F.coalesce(high, F.col("s.high")).alias("high"),
            (F.col("s.done") | F.coalesce(met, F.lit(True))).alias("done")), "multipliers")
        if state.where("not done").isEmpty():
            break
    return state.select("source", "multiplier")


def copies(sized: DataFrame, key: str = "doc_id", weights: Sequence[float] = (1, 2, 3)) -> DataFrame:
    """``(key, source, size, source_size, target, rate, copies)`` for every document of ``sizes``.

    Documents of one source and size have one rate; which of them get the odd copy is decided by a hash of the key.
    Only (key, source, size) is shuffled. Documents of a frequent size are numbered in parts of about TOGETHER.
    """
    sized = cut(sized, "sizes")
    goals = cut(targets(sized, weights), "targets")
    cells = cut(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")).alias("c").join(
        goals.alias("g"), F.col("c.source").eqNullSafe(F.col("g.source"))).select(
            F.col("c.source").alias("source"), "size", "n",
            (F.col("size") * F.col("docs") / F.greatest(F.col("source_size"), F.lit(1))).alias("u")), "cells")
    solved = multipliers(cells.where("size > 0"), goals)
    rated = (cells.alias("c").join(solved.alias("m"), F.col("c.source").eqNullSafe(F.col("m.source")))
             .select("c.*", F.when(F.col("size") == 0, F.lit(1.0)).otherwise(_rate(F.col("multiplier"), F.col("u"))).alias("rate")))
    rated = cut(rated.withColumn("band", F.floor(F.col("size") / BAND)).withColumn("exact", F.col("rate") * F.col("n")), "rated")
    # Running sums of exact copies along the sizes of a source: within bands, and over the bands' totals.
    along = Window.partitionBy("source").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    bands = rated.groupBy("source", "band").agg(F.sum("exact").alias("total")).withColumn("start", F.coalesce(F.sum("total").over(along), F.lit(0.0)))
    inside = Window.partitionBy("source", "band").orderBy("size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = (rated.withColumn("upto", F.sum("exact").over(inside)).alias("r").join(
        bands.alias("b"), F.col("r.source").eqNullSafe(F.col("b.source")) & (F.col("r.band") == F.col("b.band")))
        .select("r.source", "r.size", "r.n", "r.rate", (F.floor(F.col("start") + F.col("upto") + 0.5)
                - F.floor(F.col("start") + F.col("upto") - F.col("exact") + 0.5)).alias("given")))
    summed = cut(summed.withColumn("given", F.greatest(F.lit(0), F.least(F.col("given"), CAP * F.col("n")))), "given")
    # What is left of each source's target goes to the copies of the size that fits it best.
    for _ in range(FITS):
        left = (summed.alias("d").groupBy("source").agg(F.sum(F.col("given") * F.col("size")).alias("words")).alias("w")
                .join(goals.alias("g"), F.col("w.source").eqNullSafe(F.col("g.source")))
                .select(F.col("w.source").alias("source"), (F.col("target") - F.col("words")).alias("left")))
        fit = (summed.alias("d").join(left.alias("l"), F.col("d.source").eqNullSafe(F.col("l.source")))
               .where((F.col("size") > 0) & F.when(F.col("left") > 0, F.col("given") < CAP * F.col("n")).otherwise(F.col("given") > 0))
               .withColumn("times", F.least(F.floor(F.abs("left") / F.col("size") + 0.5), F.when(
                   F.col("left") > 0, CAP * F.col("n") - F.col("given")).otherwise(F.col("given"))))
               .where((F.col("times") > 0) & (F.abs(F.abs("left") - F.col("times") * F.col("size")) < F.abs("left")))
               .groupBy("d.source").agg(F.min_by(F.struct("size", (F.signum("left") * F.col("times")).cast("long").alias("more")),
                                                 F.struct(F.abs(F.abs("left") - F.col("times") * F.col("size")), F.col("size"))).alias("best")))
        summed = cut(summed.alias("d").join(fit.alias("f"), F.col("d.source").eqNullSafe(F.col("f.source"))
                                            & (F.col("d.size") == F.col("best.size")), "left")
                     .select("d.source", "size", "n", "rate", (F.col("given") + F.coalesce("best.more", F.lit(0))).alias("given")), "given")
    plan = (summed.alias("d").join(goals.alias("g"), F.col("d.source").eqNullSafe(F.col("g.source")))
            .select("d.source", "d.size", "d.n", "d.rate", "d.given", "g.source_size", "g.target",
                    F.greatest(F.lit(1), F.ceil(F.col("d.n") / TOGETHER)).alias("parts")))
    placed = (sized.alias("s").join(plan.alias("p"), F.col("s.source").eqNullSafe(F.col("p.source")) & (F.col("s.size") == F.col("p.size")))
              .select(F.col(f"s.{key}").alias(key), "p.source", "p.size", "n", "rate", "given", "source_size", "target",
                      F.xxhash64(F.col(f"s.{key}").cast("string")).alias("draw"), "parts")
              .withColumn("part", F.pmod("draw", F.col("parts"))))
    placed = cut(placed, "placed")
    # Odd copies of a size are dealt over its parts by running sums of the parts' documents, then by hash inside a part.
    before = Window.partitionBy("source", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (placed.groupBy("source", "size", "part").agg(F.count(F.lit(1)).alias("here"))
              .withColumn("before", F.coalesce(F.sum("here").over(before), F.lit(0))))
    number = Window.partitionBy("source", "size", "part").orderBy("draw", key)
    dealt = (placed.withColumn("row", F.row_number().over(number)).alias("d").join(
        starts.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")) & (F.col("d.size") == F.col("s.size")) & (F.col("d.part") == F.col("s.part")))
        .withColumn("place", F.col("before") + F.col("row") - 1))
    whole = F.floor(F.col("given") / F.col("n"))
    odd = (F.col("place") < F.col("given") - whole * F.col("n")).cast("long")
    return dealt.select(f"d.{key}", "d.source", "d.size", "source_size", "target", "rate", (whole + odd).alias("copies"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = (1, 2, 3)) -> DataFrame:
    """The documents themselves, each row as often as the mix takes it. Rows with equal keys get equal numbers of copies.

    Keys decide: where rows share a key, the largest number among them holds for each.
    """
    counts = copies(sizes(docs, key, text, source), key, weights)
    most = counts.groupBy(key).agg(F.max("copies").alias("__copies")).select(F.col(key).alias("__key"), "__copies")
    joined = docs.join(most, docs[key].eqNullSafe(F.col("__key")))
    times = F.explode(F.array_repeat(F.lit(1), F.col("__copies").cast("int"))).alias("__copy")
    return joined.select(*[docs[c] for c in docs.columns], times).drop("__copy")
