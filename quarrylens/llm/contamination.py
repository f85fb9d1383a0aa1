"""Benchmark passages in documents: a prefix-filtered join of word shingles, verified word by word.

Items are cut into windows of ``window`` consecutive words; an item of fewer words is one window. A document holds a window
where its words occur one after the other. Then all shingles of the window occur at consecutive positions, so:

1. A bitmap of the shingles of all windows, of a size bounded by ``MOST_BITS``, is sent to the tasks. One pass over the texts
   keeps the runs of consecutive shingles that are in it and are long enough for a window (length bound). Texts without such a
   run are not shuffled.
2. Shingles are ordered by the number of documents that hold them. As a window must be contained whole, its rarest shingle is
   its whole necessary prefix: one shingle joins for each window. A window with a shingle that no document holds is dropped.
3. A match says where the window would begin; it must lie within the run (positional bound).
4. The words there are compared with the words of the window, so chance in the bitmap or in hashes changes nothing.

Shingles that many documents hold, and windows that many items share, are few by their counts: they are broadcast, all others
are joined by shuffle (``scale.lookups``), so that a passage in a third of all documents meets in no single task.

Null, empty and wordless texts hold nothing, and such items ask for nothing. Documents are rows: repeated ids and rows each give
a row. Rows of one item id are one item; a null id is an item of its own, written as an empty text. Very long texts are read
whole, as are repeated words and windows that overlap. Empty tables give no rows, or documents without hits. Other columns do
not matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.llm.common import cut
from quarrylens.llm.kernels import LOWER, blocks, shingles
from quarrylens.scale.lookups import attach

#: Words of a shingle; a window of fewer words is one shingle.
WIDTH = 5
#: Bits of the bitmap: 16 for each shingle, between these powers of two (128 kB and 64 MB).
LEAST_BITS, MOST_BITS = 20, 29

IS_WORD = np.zeros(256, bool)
IS_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _words(block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes of a block; begin, end, document and hash of its words."""
    data = LOWER[block.data]
    begin, end, doc = block.runs(IS_WORD[data])
    return data, begin, end, doc, block.hashes(begin, end, data)


def _windows(items: DataFrame, item: str, text: str, window: int) -> DataFrame:
    """``(item, words, size, shingles)``: every window of every item, its words joined by one space."""
    def slide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                data, begin, end, doc, h = _words(block)
                held = data.tobytes()
                rows, words, sizes, found = [], [], [], []
                first = np.searchsorted(doc, np.arange(block.n + 1))
                for d in range(block.n):
                    here = [held[b:e].decode() for b, e in zip(begin[first[d]:first[d + 1]], end[first[d]:first[d + 1]])]
                    size = min(len(here), window)
                    if size:
                        width = min(size, WIDTH)
                        own = shingles(h[first[d]:first[d + 1]], doc[first[d]:first[d + 1]], width)[0].view(np.int64)
                        for k in range(len(here) - size + 1):
                            rows.append(block.row + d)
                            words.append(" ".join(here[k:k + size]))
                            sizes.append(size)
                            found.append(own[k:k + size - width + 1])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(words, pa.string()),
                                                  pa.array(sizes, pa.int32()), pa.array(found, pa.list_(pa.int64()))],
                                                 ["item", "words", "size", "shingles"])

    asked = items.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), F.col(text).cast("string").alias("text"))
    return asked.mapInArrow(slide, "item string, words string, size int, shingles array<long>")


def _bitmap(windows: DataFrame) -> tuple[np.ndarray, dict[int, int]]:
    """Bits of all shingles, and for each width of shingle how many consecutive ones the shortest window needs."""
    sizes = [r["size"] for r in windows.select("size").distinct().collect()]  # at most one for each number of words
    needed: dict[int, int] = {}
    for size in sizes:
        width = min(size, WIDTH)
        needed[width] = min(needed.get(width, size), size - width + 1)
    values = windows.select(F.explode("shingles").alias("s"))
    many = values.count()
    power = min(max(LEAST_BITS, (16 * many).bit_length()), MOST_BITS)
    places = values.selectExpr(f"shiftrightunsigned(s, {64 - power}) AS at")
    words = places.selectExpr("shiftright(at, 6) AS word", "shiftleft(1L, cast(at & 63 AS int)) AS bit")
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()  # 2^23 numbers at most
    bits = np.zeros(1 << (power - 6), np.int64)
    bits[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return bits, needed


def _spots(docs: DataFrame, sent, key: str, text: str) -> DataFrame:
    """``(doc, n_words, runs, spots)`` for each row: runs of words whose shingles may be asked for, and these shingles."""
    kind = docs.schema[key].dataType.simpleString()

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, needed = sent.value
        shift, six, low = np.uint64(64 - (len(bits) * 64).bit_length() + 1), np.uint64(6), np.uint64(63)
        for batch in batches:
            for block in blocks(batch.column(1)):
                data, begin, end, doc, h = _words(block)
                first = np.searchsorted(doc, np.arange(block.n + 1))
                runs: list[list[dict]] = [[] for _ in range(block.n)]
                spots: list[list[dict]] = [[] for _ in range(block.n)]
                for width, least in sorted(needed.items()):
                    if len(h) < width:
                        continue
                    found = shingles(h, doc, width)[0]
                    at = np.flatnonzero(doc[:len(doc) - width + 1] == doc[width - 1:])  # the first word of each shingle
                    place = found >> shift
                    hit = (bits.view(np.uint64)[(place >> six).astype(np.int64)] >> (place & low)) & np.uint64(1) != 0
                    at, found = at[hit], found[hit].view(np.int64)
                    if not len(at):
                        continue
                    edge = np.flatnonzero((np.diff(at) != 1) | (np.diff(doc[at]) != 0)) + 1
                    for a, b in zip(np.concatenate([[0], edge]), np.concatenate([edge, [len(at)]])):
                        if b - a < least:
                            continue
                        d, to = int(doc[at[a]]), at[b - 1] + width
                        words = b" ".join(data[x:y].tobytes() for x, y in zip(begin[at[a]:to], end[at[a]:to])).decode()
                        start = int(at[a] - first[d])
                        spots[d] += [{"shingle": int(s), "at": start + k, "run": len(runs[d])} for k, s in enumerate(found[a:b])]
                        runs[d].append({"first": start, "words": words})
                here = batch.slice(block.row, block.n)
                yield pa.RecordBatch.from_arrays(
                    [here.column(0), pa.array(np.diff(first), pa.int64()),
                     pa.array(runs, pa.list_(pa.struct([("first", pa.int32()), ("words", pa.string())]))),
                     pa.array(spots, pa.list_(pa.struct([("shingle", pa.int64()), ("at", pa.int32()), ("run", pa.int32())])))],
                    ["doc", "n_words", "runs", "spots"])

    rows = docs.select(F.col(key).alias("doc"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(look, f"doc {kind}, n_words long, runs array<struct<first: int, words: string>>, "
                                 "spots array<struct<shingle: long, at: int, run: int>>")


def occurrences(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
                item_text: str = "text", window: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The documents as ``(row, doc, n_words, some)``; where windows occur, ``(row, start, size, window)``; ``(window, items)``."""
    spark = docs.sparkSession
    every = cut(_windows(items, item, item_text, window), "windows")
    own = cut(every.groupBy("words").agg(F.first("size").alias("size"), F.first("shingles").alias("shingles"), F.collect_set("item").alias("items"))
              .withColumn("window", F.monotonically_increasing_id()), "distinct-windows")
    read = cut(_spots(docs, spark.sparkContext.broadcast(_bitmap(own)), key, text)
               .withColumn("row", F.monotonically_increasing_id()), "spots")
    rows = read.select("row", "doc", "n_words", (F.size("spots") > 0).alias("some"))
    spots = cut(read.where("size(spots) > 0").select("row", F.explode("spots").alias("s")).select("row", "s.*"), "spots-flat")
    frequency = (spots.groupBy("row", "shingle").agg(F.count(F.lit(1)).alias("times"))
                 .groupBy("shingle").agg(F.count(F.lit(1)).alias("held_by"), F.sum("times").alias("times")))
    rare = F.struct("held_by", "shingle", "offset")
    prefix = (own.select("window", F.size("shingles").alias("many"), F.posexplode("shingles").alias("offset", "shingle"))
              .join(frequency, "shingle").groupBy("window", "many")
              .agg(F.count(F.lit(1)).alias("held"), F.min(rare).alias("rare"), F.min_by("times", rare).alias("times"))
              .where("held = many").select("window", "rare.shingle", "rare.offset", "times"))
    wanted = (prefix.join(own.select("window", "size", "words"), "window")
              .groupBy("shingle").agg(F.first("times").alias("times"), F.collect_list(F.struct("window", "offset", "size", "words")).alias("asked")))
    wanted = cut(wanted, "prefix")
    candidates = (attach(spots, wanted, ["shingle"], "times", spots.count(), ["asked"]).where("asked is not null")
                  .select("row", "run", "at", F.explode("asked").alias("a"))
                  .select("row", "run", (F.col("at") - F.col("a.offset")).alias("start"), "a.window", "a.size", F.col("a.words").alias("asked")))
    runs = read.where("size(spots) > 0").select("row", F.posexplode("runs").alias("run", "r")).select("row", "run", "r.first", "r.words")
    begin = F.col("start") - F.col("first")
    inside = candidates.join(runs, ["row", "run"]).withColumn("said", F.split("words", " "))
    there = inside.where((begin >= 0) & (begin + F.col("size") <= F.size("said")))
    same = F.array_join(F.slice("said", begin + 1, F.col("size")), " ") == F.col("asked")
    hits = cut(there.where(same).select("row", "start", "size", "window"), "hits")
    return rows, hits, own.select("window", "items")


def contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
                 item_text: str = "text", window: int = 10) -> DataFrame:
    """For each document: ``n_words``, ``n_hit`` words inside a window, ``n_items`` and the sorted ``items`` with a window in it."""
    rows, hits, windows = occurrences(docs, items, key, text, item, item_text, window)
    rows = cut(rows, "documents")
    end = F.col("start") + F.col("size")
    before = F.max(end).over(Window.partitionBy("row").orderBy("start", "size").rowsBetween(Window.unboundedPreceding, -1))
    covered = hits.select("row", "start", "size").distinct().withColumn("before", F.coalesce(before, F.lit(0)))
    n_hit = covered.groupBy("row").agg(F.sum(F.greatest(F.lit(0), end - F.greatest("start", "before"))).cast("long").alias("n_hit"))
    held = hits.select("row", "window").distinct()
    weights = held.groupBy("window").agg(F.count(F.lit(1)).alias("times"))
    named = attach(held, cut(weights.join(windows, "window"), "items"), ["window"], "times", held.count(), ["items"])
    by_row = (named.select("row", F.explode("items").alias("item")).distinct()
              .groupBy("row").agg(F.array_sort(F.collect_list("item")).alias("items")))
    found = n_hit.join(by_row, "row")
    some = rows.where("some").join(found, "row", "left").select("doc", "n_words", "n_hit", "items")
    none = rows.where("not some").select("doc", "n_words", F.lit(None).cast("long").alias("n_hit"), F.lit(None).cast("array<string>").alias("items"))
    items_found = F.coalesce("items", F.array().cast("array<string>"))
    return some.union(none).select(F.col("doc").alias(key), "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
                                   F.size(items_found).cast("long").alias("n_items"), items_found.alias("items"))
