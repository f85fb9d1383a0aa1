"""Mentions of the names of a large table in texts: a join on runs of words with their places, then the longest match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.functions.kinds import require_columns

WORD, GAP = r"[\p{L}\p{M}\p{N}]+", r"[^\p{L}\p{M}\p{N}]+"


def _pattern(name: Column) -> Column:
    """Matches a lower-case name as a whole, with each underscore read as itself or as one space."""
    return F.concat(F.lit(r"\A"), F.replace(F.regexp_replace(name, r"([^\p{L}\p{M}\p{N}_])", r"\\$1"), F.lit("_"), F.lit("[_ ]")), F.lit(r"\z"))


def _spaced(text: Column | str) -> Column:
    return F.translate(text, "_", " ")


def _parts(names: DataFrame, name: str) -> DataFrame:
    """``name, low, n, lead, tail, plain, gram``: the lower-case name, its number of words, the lengths of what stands before the
    first word and behind the last one, and what lies between with spaces for underscores. Names without a word are left out.

    A ``plain`` name is found wherever its ``gram`` is; others have signs at an end, or spaces, that are still to be compared.
    """
    known = (names.select(F.col(name).alias("name")).where("name is not null").distinct().withColumn("low", F.lower("name"))
             .withColumn("n", F.size(F.regexp_extract_all("low", F.lit(WORD), F.lit(0)))).where("n > 0")
             .withColumn("lead", F.length(F.regexp_extract("low", rf"\A(?:{GAP})?", 0)))
             .withColumn("tail", F.length(F.regexp_extract("low", rf"(?:{GAP})?\z", 0))))
    plain = (F.col("lead") == 0) & (F.col("tail") == 0) & ~F.contains("low", F.lit(" "))
    core = F.substring(F.col("low"), F.col("lead") + 1, F.length("low") - F.col("lead") - F.col("tail"))
    return known.select("name", "low", "n", "lead", "tail", plain.alias("plain"), _spaced(core).alias("gram"))


def _places(rows: DataFrame, lengths: list[int], lead: int, tail: int) -> DataFrame:
    """``key, row, at, raw, gram, before, after``: every run of words of the ``lengths`` in the lower-case text of ``rows``.

    A text becomes its words and the gaps between them in turn, so ``at`` follows the order of the text; ``before`` and ``after``
    are as many neighbouring characters as a name may need, and one more.
    """
    pieces = rows.select("key", "row", F.regexp_extract_all(F.lower("text"), F.lit(f"{WORD}|{GAP}"), F.lit(0)).alias("p"))
    p, at, n = F.col("p"), F.col("at"), F.col("n")
    first = F.when(F.get(p, F.lit(0)).rlike(rf"\A{WORD}"), F.lit(1)).otherwise(F.lit(2))
    runs = (pieces.select("key", "row", "p", F.explode(F.when(F.size(p) >= first, F.sequence(first, F.size(p), F.lit(2)))).alias("at"))
            .select("key", "row", "p", "at", F.explode(F.array(*[F.lit(k) for k in lengths])).alias("n")).where(at + 2 * n - 2 <= F.size(p)))

    def near(place: Column) -> Column:
        return F.coalesce(F.get(p, place), F.lit(""))

    ahead, behind = near(at - 2), near(at + 2 * n - 2)
    if lead:
        ahead = F.concat(F.right(near(at - 3), F.lit(1)), ahead)
    if tail:
        behind = F.concat(behind, F.left(near(at + 2 * n - 1), F.lit(1)))
    return (runs.select("key", "row", "at", F.array_join(F.slice(p, at, 2 * n - 1), "").alias("raw"),
                        F.right(ahead, F.lit(lead + 1)).alias("before"), F.left(behind, F.lit(tail + 1)).alias("after"))
            .withColumn("gram", _spaced("raw")))


def _alone() -> Column:
    """Whether the name of a row stands at its place, apart from the words beside it."""
    lead, tail, before, after = (F.col(c) for c in ("lead", "tail", "before", "after"))
    said = F.concat(F.right(before, lead), F.col("raw"), F.left(after, tail))
    same = (_spaced(said) == _spaced("low")) & ((~F.contains("low", F.lit("_")) & (said == F.col("low"))) | F.rlike(said, _pattern(F.col("low"))))
    left = F.when(F.length(before) > lead, F.substring(before, F.length(before) - lead, F.lit(1))).otherwise(F.lit(""))
    right = F.substring(after, tail + 1, F.lit(1))
    # Most neighbours are a space or nothing.
    apart = [(sign == "") | (sign == " ") | ~sign.rlike(r"(?U)\A\w") for sign in (left, right)]
    return (F.col("plain") | same) & apart[0] & apart[1]


def dictionary_mentions(df: DataFrame, key: str, text: str, names: DataFrame, name: str) -> DataFrame:
    """``key, mentioned, resolved`` for every text that mentions a name: all names in the order of first mention, and the longest.

    A name is mentioned where it stands alone, letter case aside and each of its underscores read as itself or as one space; a
    numeral such as ² beside it makes it part of another word. Names of equal length are resolved to the smaller one. Texts are shuffled once, by their key; each is cut into the runs of words of
    the lengths that names have, with their places, which are joined with the names. A text is read once whatever the number of
    names it mentions, and no name is searched for. ``key`` tells texts apart: a name that several texts of a key mention is listed
    as often. Null texts, null keys and names without a word match nothing.
    """
    require_columns(df, [key, text])
    require_columns(names, [name])
    known = _parts(names, name)
    # The numbers of words that names have are few, whatever the number of names.
    found = known.agg(F.sort_array(F.collect_set("n")).alias("n"), F.max("lead").alias("lead"), F.max("tail").alias("tail")).first()
    if not found["n"]:
        return df.select(key, F.array().cast("array<string>").alias("mentioned"), F.lit(None).cast("string").alias("resolved")).limit(0)
    rows = (df.select(F.col(key).alias("key"), F.monotonically_increasing_id().alias("row"), df[text].cast("string").alias("text"))
            .where("key is not null and text is not null").repartition("key"))
    hits = _places(rows, found["n"], found["lead"], found["tail"]).join(known, "gram").where(_alone())
    # All that follows stays where the texts of a key are.
    place = F.shiftleft(F.col("at").cast("long"), 32) - F.col("lead")  # of two names at a word, what begins earlier is first
    firsts = hits.groupBy("key", "row", "name").agg(F.min(place).alias("place"))
    lists = firsts.groupBy("key", "row").agg(F.sort_array(F.collect_list(F.struct("place", "name"))).alias("found"))
    lists = lists.select("key", F.col("found")["name"].alias("found")).withColumn(
        "all", F.collect_list("found").over(Window.partitionBy("key")))
    every = F.flatten("all")
    repeated = F.flatten(F.transform("found", lambda n: F.array_repeat(n, F.size(F.filter(every, lambda other: other == n)))))
    lists = lists.select("key", F.when(F.size("all") == 1, F.col("found")).otherwise(repeated).alias("found"))
    longest = F.array_min(F.transform("found", lambda n: F.struct((-F.length(n)).alias("size"), n.alias("name"))))
    return lists.select(F.col("key").alias(key), F.col("found").alias("mentioned"), longest["name"].alias("resolved"))
