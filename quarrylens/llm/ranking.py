"""Ranked lexical search, exact: posting lists in blocks of similar documents, skipped by their coordinatewise maxima.

The queries are the items of a table, taken in blocks whose words fit a dictionary of ``VOCABULARY`` words; all documents are
searched for all of them. Every step is a pass over partitions:

1. Documents become vectors of the dictionary's words, which are written; collection counts come from them.
2. Vectors are ranged by a code of random hyperplanes, so that similar documents are neighbours, and cut into cells. Inside a
   cell every word's posting list is clustered by the similarity of its documents; a block of the list stores the greatest
   impact of each word that shares a query with the list's word. Words beyond ``SUMMARY`` of them, and lists of fewer than
   ``SHORT`` documents, are bounded by the greatest impacts of the cell instead.
3. The cell of the highest bound of each query is scored whole. Its scores say what a document must reach at least.
4. All cells are searched: a cell, a list or a block is left out only where the exact bound stays below what must be reached;
   what is left is scored exactly. A task returns its best documents of a query, the best of these are the result.

The code decides how well blocks are told apart, never the result. Copies of one text may hold most of the rows: they share a
code, and a second key deals them over the ranges. Nothing but the dictionary, the queries of a block and their bounds is sent
to the tasks; a task holds one cell.

Nulls, empty texts and texts without a term are found by nothing and ask for nothing, and count neither in N nor in L. Rows of
one id are documents of their own; a null id comes last among equal scores. Rows of equal item and text are one query; an item
of several texts is one query for each. Very long texts are counted whole. Empty tables give no rows; other columns do not
matter, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.llm.common import cut

#: Runs of letters and digits in UTF-8, where all beyond ASCII counts as a letter; bytes.lower() changes A-Z only.
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Words of one dictionary; a single longer item has one of its own size.
VOCABULARY = 1 << 17
#: A cell ends at so many documents or entries.
CELL_DOCUMENTS, CELL_ENTRIES = 4096, 1 << 19
#: Documents of a block, documents of a list that is worth a summary, words of a summary.
BLOCK, SHORT, SUMMARY = 64, 8, 512
#: Hyperplanes of a code.
PLANES = 24


def terms(text: str | None) -> list[bytes]:
    """The terms of a text, with repeats."""
    return TERM.findall(text.encode().lower()) if text else []


def _wanted(items: DataFrame, item: str, text: str) -> DataFrame:
    """``(query, item, text, many)``: every distinct item and text once, with the number of its distinct terms."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            many = [len(set(terms(t))) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(many, pa.int64())], ["item", "text", "many"])

    kind = items.schema[item].dataType.simpleString()
    rows = items.select(F.col(item).alias("item"), F.col(text).cast("string").alias("text")).distinct()
    rows = rows.mapInArrow(count, f"item {kind}, text string, many long").where("many > 0")
    return cut(rows.withColumn("query", F.monotonically_increasing_id()), "items")


def _query_blocks(wanted: DataFrame) -> tuple[int, int]:
    """The number of blocks that keeps the terms of a block within the dictionary, and the number of items."""
    total, rows = wanted.agg(F.sum("many"), F.count(F.lit(1))).first()
    blocks = max(1, math.ceil((total or 0) / VOCABULARY))
    while 1 < blocks < rows:
        if wanted.groupBy(F.pmod(F.xxhash64("query"), F.lit(blocks))).agg(F.sum("many").alias("n")).agg(F.max("n")).first()[0] <= VOCABULARY:
            break
        blocks *= 2
    return blocks, rows


class Questions:
    """The queries of a block: their dictionary, and their terms and weights one after the other."""

    def __init__(self, asked: list[tuple[int, Counter]]):
        self.words = sorted(set().union(*(bag for _, bag in asked)))
        self.number = {w: k for k, w in enumerate(self.words)}
        self.ids = [q for q, _ in asked]
        self.starts = np.concatenate([[0], np.cumsum([len(bag) for _, bag in asked])]).astype(np.int64)
        self.terms = np.array([self.number[w] for _, bag in asked for w in sorted(bag)], np.int64)
        self.times = np.array([bag[w] for _, bag in asked for w in sorted(bag)], np.int64)
        self.weights = np.zeros(0, np.int64)

    def weigh(self, documents: int, length: int, frequency: np.ndarray) -> None:
        """Weights by document frequency, for a collection of so many documents and terms."""
        w = [math.floor(1000 * math.log((2 * documents + 2) / (2 * int(df) + 1))) for df in frequency]
        self.documents, self.length, self.word_weights = documents, length, np.array(w, np.int64)
        self.weights = self.times * self.word_weights[self.terms]

    def of(self, k: int) -> slice:
        return slice(self.starts[k], self.starts[k + 1])

    def partners(self) -> Callable[[int], np.ndarray]:
        """For a word, those that share a query with it, the heaviest ``SUMMARY`` of them, in order."""
        owner = np.repeat(np.arange(len(self.ids)), np.diff(self.starts))
        order = np.argsort(self.terms, kind="stable")
        first = np.searchsorted(self.terms[order], np.arange(len(self.words) + 1))
        known: dict[int, np.ndarray] = {}

        def partners(word: int) -> np.ndarray:
            if word not in known:
                asking = owner[order[first[word]:first[word + 1]]]
                found = np.unique(np.concatenate([self.terms[self.of(q)] for q in asking]))
                if len(found) > SUMMARY:
                    found = np.sort(found[np.argsort(-self.word_weights[found], kind="stable")[:SUMMARY]])
                known[word] = found
            return known[word]

        return partners


def _vectors(docs: DataFrame, sent) -> DataFrame:
    """``(doc, n, terms, counts)``: how many terms a document has, and the dictionary's terms among them with their counts."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = sent.value.number
        for batch in batches:
            n, found, counts, ends = [], [], [], [0]
            for text in batch.column(1):
                words = terms(text.as_py())
                n.append(len(words))
                for word, times in Counter(words).items():
                    if (k := number.get(word)) is not None:
                        found.append(k)
                        counts.append(times)
                ends.append(len(found))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(found, pa.int32())),
                 pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(counts, pa.int64()))], ["doc", "n", "terms", "counts"])

    kind = docs.schema["doc"].dataType.simpleString()
    return docs.mapInArrow(read, f"doc {kind}, n long, terms array<int>, counts array<long>")


def _impacts(asked: Questions, n: np.ndarray, sizes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """What an occurrence is worth before its word's weight."""
    m = 25 + (75 * n * asked.documents) // asked.length
    return (1_000_000_000 * counts) // (1000 * counts + 8 * np.repeat(m, sizes))


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets from 0 and values of a list column without nulls."""
    ends = np.asarray(column.offsets, np.int64)
    return ends - ends[0], np.asarray(column.values)[ends[0]:ends[-1]]


def _places(asked: Questions, starts: np.ndarray, words: np.ndarray, impacts: np.ndarray) -> np.ndarray:
    """Weighted vectors projected on random hyperplanes, scaled to length 1; no vector is empty."""
    signs = np.random.Generator(np.random.PCG64(11)).choice(np.array([-1, 1], np.int8), (len(asked.words), PLANES))
    out = np.empty((len(starts) - 1, PLANES), np.float32)
    value = (asked.word_weights[words] * impacts).astype(np.float32)
    step = 512
    for at in range(0, len(out), step):
        to = min(at + step, len(out))
        held = slice(starts[at], starts[to])
        out[at:to] = np.add.reduceat(signs[words[held]] * value[held, None], starts[at:to] - starts[at], axis=0)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def _coded(vectors: DataFrame, sent) -> DataFrame:
    """The vectors with their code: on which side of each hyperplane they lie."""
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = sent.value
        for batch in batches:
            if batch.num_rows:
                n = np.asarray(batch.column(1))
                starts, words = _lists(batch.column(2))
                impacts = _impacts(asked, n, np.diff(starts), _lists(batch.column(3))[1])
                side = _places(asked, starts, words, impacts) > 0
                codes = side @ (1 << np.arange(PLANES - 1, -1, -1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes, pa.int64())], [*batch.schema.names, "code"])

    return vectors.mapInArrow(code, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vectors.schema) + ", code long")


def _reach(starts: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the entries of some documents, one document after the other, and where each begins among them."""
    sizes = starts[docs + 1] - starts[docs]
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[docs] - (ends - sizes), sizes), ends - sizes


_CELL = ("starts", "words", "impacts", "place", "list_words", "list_blocks", "block_sizes", "block_docs", "maxima")


def _cell(asked: Questions, partners: Callable[[int], np.ndarray], keys: list, n: np.ndarray, starts: np.ndarray, words: np.ndarray,
          counts: np.ndarray) -> dict:
    """The index of some similar documents: their vectors and the clustered posting lists, with the summaries of the blocks."""
    impacts = _impacts(asked, n, np.diff(starts), counts)
    places = _places(asked, starts, words, impacts)
    order = np.argsort(words, kind="stable")
    owner = np.repeat(np.arange(len(keys)), np.diff(starts))[order]
    list_words, first = np.unique(words[order], return_index=True)
    last = np.append(first[1:], len(order))
    list_blocks, sizes, members, maxima = [], [], [], []
    slot = np.full(len(asked.words), -1, np.int64)
    for word, begin, end in zip(list_words, first, last):
        docs = owner[begin:end]
        if len(docs) < SHORT:
            list_blocks.append(0)  # no summary: the cell's maxima bound the list
            sizes.append([len(docs)])
            members.append(docs)
            continue
        near = np.zeros(len(docs), np.int64)
        if len(docs) > BLOCK:
            heads = docs[np.linspace(0, len(docs) - 1, -(-len(docs) // BLOCK)).astype(np.int64)]
            near = np.argmax(places[docs] @ places[heads].T, axis=1)
        near = np.unique(near, return_inverse=True)[1]
        docs = docs[by := np.argsort(near, kind="stable")]
        near, blocks = near[by], int(near.max()) + 1
        beside = partners(int(word))
        slot[beside] = np.arange(len(beside))
        summary = np.zeros(blocks * len(beside), np.int64)
        for at in range(0, len(docs), 1024):
            entries, _ = _reach(starts, docs[at:at + 1024])
            column = slot[words[entries]]
            block = np.repeat(near[at:at + 1024], starts[docs[at:at + 1024] + 1] - starts[docs[at:at + 1024]])
            inside = column >= 0
            np.maximum.at(summary, block[inside] * len(beside) + column[inside], impacts[entries][inside])
        slot[beside] = -1
        list_blocks.append(blocks)
        sizes.append(np.bincount(near, minlength=blocks))
        members.append(docs)
        maxima.append(summary)
    place = np.empty(len(keys), np.int64)
    place[sorted(range(len(keys)), key=lambda k: (keys[k] is None, keys[k] if keys[k] is not None else 0))] = np.arange(len(keys))
    peak_words, at = np.unique(words, return_inverse=True)
    peaks = np.zeros(len(peak_words), np.int64)
    np.maximum.at(peaks, at, impacts)
    parts = {"starts": starts, "words": words, "impacts": impacts, "place": place, "list_words": list_words, "list_blocks": list_blocks,
             "block_sizes": np.concatenate(sizes), "block_docs": np.concatenate(members), "maxima": np.concatenate([*maxima, []])}
    return {"keys": keys, "peak_words": peak_words.astype(np.int32).tobytes(), "peaks": peaks.astype(np.int32).tobytes(),
            **{name: np.asarray(parts[name]).astype(np.int32).tobytes() for name in _CELL}}


def _cells(coded: DataFrame, sent) -> DataFrame:
    """The index: one row for each cell of neighbouring codes."""
    kind = coded.schema["doc"].dataType.simpleString()
    schema = f"keys array<{kind}>, peak_words binary, peaks binary, " + ", ".join(f"{c} binary" for c in _CELL)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = sent.value
        partners = asked.partners()
        keys: list = []
        held: list[tuple] = []
        entries, shape = 0, None

        def done() -> pa.RecordBatch:
            sizes = np.array([len(h[1]) for h in held], np.int64)
            row = _cell(asked, partners, keys, np.array([h[0] for h in held], np.int64), np.concatenate([[0], np.cumsum(sizes)]),
                        np.concatenate([h[1] for h in held]).astype(np.int64), np.concatenate([h[2] for h in held]))
            columns = [pa.array([row["keys"]], pa.list_(shape))] + [pa.array([v], pa.binary()) for k, v in row.items() if k != "keys"]
            return pa.RecordBatch.from_arrays(columns, list(row))

        for batch in batches:
            shape = batch.column(0).type
            starts, words = _lists(batch.column(2))
            _, counts = _lists(batch.column(3))
            for k, (key, n) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                keys.append(key)
                held.append((n, words[starts[k]:starts[k + 1]], counts[starts[k]:starts[k + 1]]))
                entries += len(held[-1][1])
                if len(held) >= CELL_DOCUMENTS or entries >= CELL_ENTRIES:
                    yield done()
                    keys, held, entries = [], [], 0
        if held:
            yield done()

    spread = coded.withColumn("deal", F.xxhash64("doc", "n", "terms"))
    ranged = spread.repartitionByRange("code", "deal").sortWithinPartitions("code", "deal")
    return ranged.select("doc", "n", "terms", "counts").mapInArrow(build, schema).withColumn("cell", F.monotonically_increasing_id())


class _Opened:
    """A cell read back."""

    def __init__(self, row: dict, asked: Questions, partners: Callable[[int], np.ndarray]):
        for name in _CELL:
            setattr(self, name, np.frombuffer(row[name], np.int32).astype(np.int64))
        self.keys, self.asked, self.partners = row["keys"], asked, partners
        self.peak = np.zeros(len(asked.words), np.int64)
        self.peak[np.frombuffer(row["peak_words"], np.int32)] = np.frombuffer(row["peaks"], np.int32)
        self.where = np.full(len(asked.words), -1, np.int64)
        self.where[self.list_words] = np.arange(len(self.list_words))
        held = np.maximum(self.list_blocks, 1)  # a list without summary is one block
        self.block_first = np.concatenate([[0], np.cumsum(held)])
        self.doc_first = np.concatenate([[0], np.cumsum(self.block_sizes)])
        widths = np.array([b and b * len(partners(int(w))) for w, b in zip(self.list_words, self.list_blocks)], np.int64)
        self.max_first = np.concatenate([[0], np.cumsum(widths)])
        self.weight = np.zeros(len(asked.words), np.int64)

    def bounds(self) -> np.ndarray:
        """What no document of the cell exceeds, by query."""
        return np.add.reduceat(self.peak[self.asked.terms] * self.asked.weights, self.asked.starts[:-1])

    def best(self, query: int, least: int, best: int) -> list[tuple[int, object]]:
        """The best documents of a query that score ``least`` or more, as pairs of score and key."""
        words, weights = self.asked.terms[self.asked.of(query)], self.asked.weights[self.asked.of(query)]
        here = self.where[words] >= 0
        words, weights = words[here], weights[here]
        ceiling = self.peak[words] * weights
        rising = np.argsort(ceiling, kind="stable")
        needed = rising[np.cumsum(ceiling[rising]) >= max(least, 1)]  # a document in the other lists only stays below
        self.weight[words] = weights
        opened = []
        for k in needed:
            at = self.where[words[k]]
            first, blocks = self.block_first[at], self.list_blocks[at]
            if not blocks:
                opened.append(self.block_docs[self.doc_first[first]:self.doc_first[first + 1]])
                continue
            beside = self.partners(int(words[k]))
            summary = self.maxima[self.max_first[at]:self.max_first[at + 1]].reshape(blocks, len(beside))
            worth = self.weight[beside]
            bound = summary @ worth + (ceiling.sum() - self.peak[beside] @ worth)
            for block in np.flatnonzero(bound >= max(least, 1)):
                opened.append(self.block_docs[self.doc_first[first + block]:self.doc_first[first + block + 1]])
        found: list[tuple[int, object]] = []
        if opened:
            docs = np.unique(np.concatenate(opened))
            entries, begins = _reach(self.starts, docs)
            score = np.add.reduceat(self.weight[self.words[entries]] * self.impacts[entries], begins)
            docs, score = docs[score >= max(least, 1)], score[score >= max(least, 1)]
            for k in np.lexsort((self.place[docs], -score))[:best]:
                found.append((int(score[k]), self.keys[docs[k]]))
        self.weight[words] = 0
        return found


def _searched(cells: DataFrame, sent, least: dict[int, int], best: int, only: dict[int, list[int]] | None = None) -> DataFrame:
    """``(query, doc, score)``: the best documents of each task, in the cells of ``only`` for its queries or in all for all."""
    kind = cells.schema["keys"].dataType.elementType.simpleString()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = sent.value
        partners = asked.partners()
        tops: dict[int, list] = {}
        shape = None
        for batch in batches:
            shape = batch.schema.field("keys").type.value_type
            for row in range(batch.num_rows):
                cell = _Opened({c: batch.column(c)[row].as_py() for c in batch.schema.names}, asked, partners)
                bounds = cell.bounds()
                for q in range(len(asked.ids)) if only is None else only[batch.column("cell")[row].as_py()]:
                    top = tops.setdefault(q, [])
                    reach = max(least.get(q, 1), top[-1][0] if len(top) == best else 1)
                    if bounds[q] >= reach:
                        top += cell.best(q, reach, best)
                        top.sort(key=lambda found: (-found[0], found[1] is None, found[1] if found[1] is not None else 0))
                        del top[best:]
        rows = [(asked.ids[q], key, score) for q, top in tops.items() for score, key in top]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], shape),
                                              pa.array([r[2] for r in rows], pa.int64())], ["query", "doc", "score"])

    return cells.mapInArrow(search, f"query long, doc {kind}, score long")


def _highest(cells: DataFrame, sent) -> dict[int, list[int]]:
    """For each cell that has the highest bound of a query, these queries: at most one cell for each query."""
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = sent.value
        high, at = np.zeros(len(asked.ids), np.int64), np.full(len(asked.ids), -1, np.int64)
        for batch in batches:
            for cell, words, peaks in zip(*(batch.column(k).to_pylist() for k in range(3))):
                peak = np.zeros(len(asked.words), np.int64)
                peak[np.frombuffer(words, np.int32)] = np.frombuffer(peaks, np.int32)
                bound = np.add.reduceat(peak[asked.terms] * asked.weights, asked.starts[:-1])
                at[bound > high] = cell
                high = np.maximum(high, bound)
        q = np.flatnonzero(at >= 0)
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(at[q]), pa.array(high[q])], ["q", "cell", "bound"])

    bounds = cells.select("cell", "peak_words", "peaks").mapInArrow(look, "q long, cell long, bound long")
    chosen: dict[int, list[int]] = {}
    for q, cell in bounds.groupBy("q").agg(F.max_by("cell", F.struct("bound", "cell")).alias("cell")).collect():
        chosen.setdefault(cell, []).append(q)
    return chosen


def index(docs: DataFrame, asked: Questions, name: str = "index") -> tuple[DataFrame, object]:
    """The written cells of ``docs(doc, text)`` for some questions, and the questions, weighed, as they are sent to the tasks."""
    context = docs.sparkSession.sparkContext
    vectors = cut(_vectors(docs, context.broadcast(asked)), "vectors")
    documents, length = vectors.where("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    frequency = np.zeros(len(asked.words), np.int64)
    for word, df in vectors.select(F.explode("terms").alias("word")).groupBy("word").count().collect():  # the dictionary at most
        frequency[word] = df
    asked.weigh(documents, max(length, 1), frequency)
    sent = context.broadcast(asked)
    return cut(_cells(_coded(vectors.where("size(terms) > 0"), sent), sent), name), sent


def search(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
           best: int = 10) -> DataFrame:
    """``(item, rank, key, score)``: the ``best`` documents of every item, by descending score and ascending key."""
    wanted = _wanted(items, item, item_text)
    blocks, rows = _query_blocks(wanted)
    plain = docs.select(F.col(key).alias("doc"), F.col(text).cast("string").alias("text"))
    found = None
    for block in range(blocks if rows else 0):
        part = wanted.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == block).select("query", "text").collect()
        if not part:
            continue
        cells, sent = index(plain, Questions([(r["query"], Counter(terms(r["text"]))) for r in sorted(part)]))
        ids = sent.value.ids
        only = _highest(cells, sent)
        least = {}
        if only:
            probed = _searched(cells.where(F.col("cell").isin(list(only))), sent, {}, best, only)
            tops = _ranked(probed, best).groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
            number = {q: k for k, q in enumerate(ids)}
            least = {number[r["query"]]: r["least"] for r in tops.where(F.col("n") == best).collect()}
        hits = _ranked(_searched(cells, sent, least, best), best)
        found = hits if found is None else found.union(hits)
    if found is None:
        kind = docs.schema[key].dataType.simpleString()
        found = docs.sparkSession.createDataFrame([], f"query long, doc {kind}, score long, rank int")
    return (cut(found, "found").join(wanted.select("query", "item"), "query")
            .select(F.col("item").alias(item), "rank", F.col("doc").alias(key), "score"))


def _ranked(found: DataFrame, best: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
