"""Exact Jaccard join of documents as a metric-space join.

1 - Jaccard is a metric. A document is the set of its word shingles; equal sets are one class. Shingles are put in an order
that begins with rare ones (by a count sketch of fixed size; any order is right, this one is fast). Two sets at least as
similar as the threshold share LEAD of their leading shingles, so a class that shares fewer with all others has no link.
Every shared leading shingle elects one pivot, the class that shares most: two linked classes have a pivot in common. A
pivot and the classes that share it form a region. Counts of shingles by hash bound what two sets can share: a member that
no other one of its region can reach is left out before any text travels. Inside, distances to the pivot bound those between
members (triangle inequality): only members whose distances differ by at most 1 - threshold are compared, and two members
inside the pivot's ball are linked through it. A region too large for a task chooses new pivots among its members, becomes their Voronoi
regions, with members near a border in every region within the window of twice the radius, and is joined recursively;
where that separates nothing (a dense group), core members meet all others block by block.

Edge cases: a null text, an empty one and one without words have no shingles and link with nothing. With fewer words than a
shingle, the whole sequence is the only one. Repeated rows are rows of the same class. Ties of pivots go to the smaller
digest. An empty table gives an empty result. Other columns are not read. Shingles and sets are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quarrylens.llm.common import components, cut, freed_shuffles, small_batches
from quarrylens.llm.kernels import LOWER, Block, blocks, mixed, shingles, whole_sequences
from quarrylens.llm.languages import _arrow

#: Cells of the count sketch: its size does not depend on the data.
SKETCH, SKETCH_BLOCK = 1 << 19, 1 << 13
#: Members of a region that one task joins on its own; new pivots per split, about; levels of splitting.
CELL, FANOUT, LEVELS = 128, 16, 3
#: Share of a set by which its leading part is longer than the shortest one that must share a shingle.
LEAD = 0.02
#: Words of a bitmap that tells which rows may be needed: 4 MB of bits.
BITMAP = 1 << 19
#: Shingles that a count of a set's buckets holds on average, at most; sets that a task keeps in mind to tell copies.
BUCKET, COPIES = 16, 1 << 16
#: Regions are joined in as many turns that a turn sends the texts of one row in SLICES, about.
SLICES = 4


def _sets(block: Block, width: int) -> tuple[np.ndarray, np.ndarray]:
    """All shingles of a block and the ends of the documents' parts; distinct and in order within a document."""
    low = Block(LOWER[block.data], block.offsets, block.row)
    starts, ends, doc = low.words()
    h = low.hashes(starts, ends)
    some, some_doc = shingles(h, doc, width)
    few, few_doc = whole_sequences(h, doc, block.n, width)
    h, doc = np.concatenate([some, few]), np.concatenate([some_doc, few_doc])
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.searchsorted(doc[new], np.arange(block.n + 1))


def _cell(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(45)).astype(np.int64)  # 19 bits


def _digest(h: np.ndarray) -> int:
    """A digest of a set, from sums that do not depend on any order."""
    a, b = mixed(h).sum(dtype=np.uint64), mixed(h ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    return int(mixed(np.array([a ^ (b << np.uint64(1)) ^ np.uint64(len(h))], np.uint64)).view(np.int64)[0])


def _buckets(h: np.ndarray) -> bytes:
    """How many shingles of a set fall into each bucket of their hashes, a byte each; 255 stands for any more.

    The number of buckets is a power of two that follows the size, so the buckets of a larger set can be added up to those of
    a smaller one.
    """
    k = 16
    while k * BUCKET < len(h):
        k *= 2
    return np.minimum(np.bincount((h & np.uint64(k - 1)).astype(np.int64), minlength=k), 255).astype(np.uint8).tobytes()


def reachable(n: np.ndarray, buckets: list[bytes], percent: int) -> np.ndarray:
    """Which of some sets may be as similar as ``percent`` to another one: no two of them share more than their buckets do."""
    counts = [np.frombuffer(b, np.uint8).astype(np.int64) for b in buckets]
    counts = [np.where(c == 255, size, c) for c, size in zip(counts, n)]
    width = np.array([len(c) for c in counts])
    found = np.zeros(len(n), bool)
    for k in np.unique(width):
        some = np.flatnonzero(width >= k)
        alike = np.stack([counts[j].reshape(-1, k).sum(0) for j in some])
        for at in np.flatnonzero(width[some] == k):
            most = np.minimum(alike, alike[at]).sum(1)
            near = 100 * most >= percent * (n[some] + n[some[at]] - most)
            near[at] = False
            if near.any():
                found[some[near]] = found[some[at]] = True
    return found


def sketch(docs: DataFrame, text: str, width: int) -> np.ndarray:
    """How many documents' shingles fall into each cell: an array of SKETCH numbers, summed by block of cells."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SKETCH, np.int64)
        for batch in batches:
            for block in blocks(batch.column(0)):
                total += np.bincount(_cell(_sets(block, width)[0]), minlength=SKETCH)
        parts = total.reshape(-1, SKETCH_BLOCK)
        yield pa.record_batch([pa.array(range(len(parts)), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())],
                              names=["block", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[k] = sums.get(k, 0) + np.frombuffer(counts, np.int64)
        yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())],
                              names=["block", "counts"])

    parts = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(count, "block int, counts binary")
    rows = parts.repartition(16, "block").mapInArrow(add, "block int, counts binary").collect()  # SKETCH numbers in all
    total = np.zeros(SKETCH, np.int64)
    for r in rows:
        total[r.block * SKETCH_BLOCK:(r.block + 1) * SKETCH_BLOCK] = np.frombuffer(r.counts, np.int64)
    return np.minimum(total, 2**31 - 1).astype(np.int32)


def leading(docs: DataFrame, key: str, text: str, width: int, percent: int) -> DataFrame:
    """``(key, n, set, buckets, lead array<long>)``: size, digest, counts by bucket and leading shingles of every document's set.

    Copies that a task meets again have no leading shingles: those of the first one stand for the class.
    """
    sent = docs.sparkSession.sparkContext.broadcast(sketch(docs, text, width))
    rows = docs.select(F.col(key).alias(key), F.col(text).cast("string").alias("text"))
    schema = pa.schema([(key, _arrow(rows, key)), ("n", pa.int64()), ("set", pa.int64()), ("buckets", pa.binary()),
                        ("lead", pa.list_(pa.int64()))])

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sent.value
        seen: set[int] = set()
        for batch in batches:
            for block in blocks(batch.column(1)):
                h, ends = _sets(block, width)
                common = counts[_cell(h)]
                size, digest, buckets, leads = np.diff(ends), [], [], []
                for d in range(block.n):
                    own = slice(ends[d], ends[d + 1])
                    n = int(size[d])
                    keep = n - (percent * n + 99) // 100 + max(1, int(LEAD * n))
                    digest.append(_digest(h[own]) if n else None)
                    buckets.append(_buckets(h[own]) if n else None)
                    new = n and digest[-1] not in seen
                    leads.append(h[own][np.argsort(common[own], kind="stable")[:keep]].view(np.int64) if new else None)
                    if new and len(seen) < COPIES:
                        seen.add(digest[-1])
                yield pa.record_batch([batch.column(0).slice(block.row, block.n), pa.array(size.astype(np.int64)), pa.array(digest, pa.int64()),
                                       pa.array(buckets, pa.binary()), pa.array(leads, pa.list_(pa.int64()))], schema=schema)

    return rows.mapInArrow(lead, f"`{key}` {rows.schema[key].dataType.simpleString()}, n long, set long, buckets binary, lead array<long>")


def _bits(column: str) -> tuple[F.Column, F.Column]:
    """The word and the bit of a value in a bitmap of BITMAP words of 64 bits."""
    return F.shiftright(F.pmod(F.xxhash64(column), F.lit(BITMAP * 64)), 6), F.expr(f"shiftleft(1L, cast(pmod(xxhash64({column}), 64) as int))")


def likely(rows: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """The rows whose ``column`` may be among the single column of ``wanted``: all that are, and some others.

    The bitmap sent to the tasks has BITMAP words at most, whatever the data; it only spares shuffling, the join behind
    it decides.
    """
    word, bit = _bits("__wanted")
    bitmap = wanted.toDF("__wanted").select(word.alias("__word"), bit.alias("bit")).groupBy("__word").agg(F.bit_or("bit").alias("__bits"))
    word, bit = _bits(column)
    return rows.join(F.broadcast(bitmap), word == F.col("__word")).where(F.col("__bits").bitwiseAND(bit) != 0).select(rows.columns)


def region_members(docs: DataFrame, places: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """``(region, total, set, core, first, text binary)`` for ``places(region, total, set, key)``: the texts of classes, sent to
    their regions. Texts travel rather than sets: hashes do not compress, and a set takes more bytes than its text."""
    lists = places.groupBy(F.col(key).alias("__id"), "set").agg(F.collect_list(F.struct("region", "total")).alias("places"))
    rows = likely(docs.select(F.col(key).alias("__key"), F.col(text).cast("string").alias("text")), "__key", lists.select("__id"))
    some = rows.join(lists, F.col("__key").eqNullSafe(F.col("__id"))).select("set", "text", "places")
    schema = pa.schema([("region", pa.int64()), ("total", pa.int64()), ("set", pa.int64()), ("core", pa.bool_()), ("first", pa.bool_()),
                        ("text", pa.binary())])

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                h, ends = _sets(block, width)
                part = batch.slice(block.row, block.n)
                named, places_ = part.column(0).to_pylist(), part.column(2).to_pylist()
                out = [(p["region"], p["total"], named[d], True, p["region"] == named[d], block.data[block.offsets[d]:block.offsets[d + 1]].tobytes())
                       for d in range(block.n) if len(own := h[ends[d]:ends[d + 1]]) and _digest(own) == named[d]  # keys may repeat
                       for p in places_[d]]
                for at in range(0, len(out), 256):
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out[at:at + 256]), schema)], schema=schema)

    return some.mapInArrow(full, "region long, total long, set long, core boolean, first boolean, text binary")


def grouped(batches: Iterator[pa.RecordBatch], column: int = 0) -> Iterator[tuple]:
    """Consecutive rows of equal key, across batches."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        if not len(batch):
            continue
        keys = batch.column(column).to_numpy(zero_copy_only=False)
        starts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(starts, starts[1:]):
            if held and keys[a] != key:
                yield key, pa.Table.from_batches(held)
                held = []
            key = keys[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield key, pa.Table.from_batches(held)


class Members:
    """Sets of one region, numbered for quick overlaps."""

    def __init__(self, texts: list[bytes], width: int):
        sets = []
        for block in blocks(pa.array(texts, pa.large_binary()).view(pa.large_string())):
            h, ends = _sets(block, width)
            sets += [h[a:b] for a, b in zip(ends, ends[1:])]
        self.n = np.array([len(s) for s in sets])
        self.at = np.concatenate([[0], np.cumsum(self.n)])
        _, self.flat = np.unique(np.concatenate(sets), return_inverse=True)
        self.mark = np.zeros(int(self.flat.max()) + 1, bool)

    def reordered(self, order: np.ndarray) -> None:
        self.flat = np.concatenate([self.flat[self.at[k]:self.at[k + 1]] for k in order])
        self.n = self.n[order]
        self.at = np.concatenate([[0], np.cumsum(self.n)])

    def overlaps(self, x: int, a: int, b: int) -> np.ndarray:
        """Shingles that member ``x`` shares with each of the members ``a`` to ``b - 1``."""
        if a >= b:
            return np.zeros(0, np.int64)
        own = self.flat[self.at[x]:self.at[x + 1]]
        self.mark[own] = True
        got = np.add.reduceat(self.mark[self.flat[self.at[a]:self.at[b]]], self.at[a:b] - self.at[a], dtype=np.int64)
        self.mark[own] = False
        return got


def region_links(ids: np.ndarray, members: Members, core: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that connect what is connected inside a region: pairs with a core member, as few as a spanning forest needs.

    Members are put in order of their distance to the first one (the pivot); a member is compared with those whose distance
    differs by at most 1 - percent / 100, and not with one that shares the pivot's ball with it.
    """
    radius = 1 - percent / 100
    shared = members.overlaps(0, 0, len(ids))
    distance = 1 - shared / (members.n[0] + members.n - shared)
    order = np.argsort(distance, kind="stable")
    members.reordered(order)
    ids, core, distance, shared = ids[order], core[order], distance[order], shared[order]
    ball = 100 * shared >= percent * (members.n[0] + members.n - shared)
    root = list(range(len(ids)))

    def top(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    found = []

    def link(a: int, b: int) -> None:
        x, y = top(a), top(b)
        if x != y:
            root[x] = y
            found.append((int(ids[a]), int(ids[b])))

    for k in np.flatnonzero(ball)[1:]:
        link(0, int(k))
    far = int(ball.sum())  # members of the ball come first
    upto = np.searchsorted(distance, distance + radius + 1e-9, "right")
    for x in range(len(ids)):
        a, b = max(x + 1, far if x < far else 0), int(upto[x])
        if a >= b or not (core[x] or core[a:b].any()):
            continue
        got = members.overlaps(x, a, b)
        same = 100 * got >= percent * (members.n[x] + members.n[a:b] - got)
        if not core[x]:
            same &= core[a:b]
        for k in np.flatnonzero(same):
            link(x, a + int(k))
    return found


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], schema=_LINKS)


def _reached(places: DataFrame, key: str, percent: int) -> DataFrame:
    """``(region, total, set, key)`` of the places whose set may be linked to another one of the region, told by counts alone.

    Members of a region mostly share a few leading shingles by chance, the more the larger the input; their texts stay.
    """
    part = places.select("region", "total", "set", key, "n", "buckets")

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in grouped(batches):
            kept = reachable(rows.column("n").to_numpy(), rows.column("buckets").to_pylist(), percent)
            if kept.any():
                yield from rows.select(["region", "total", "set", key]).filter(pa.array(kept)).to_batches()

    return (part.repartition("region").sortWithinPartitions("region")
            .mapInArrow(reach, part.select("region", "total", "set", key).schema))


def _joined(members: DataFrame, width: int, percent: int) -> DataFrame:
    """Links inside regions of ``members(region, first, set, core, text)``, each region in one task, first members first."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in grouped(batches):
            if len(rows) > 1:
                yield _pairs(region_links(rows.column("set").to_numpy(), Members(rows.column("text").to_pylist(), width),
                                          rows.column("core").to_numpy(zero_copy_only=False).copy(), percent))

    return (members.select("region", "first", "set", "core", "text").repartition("region")
            .sortWithinPartitions("region", F.desc("first"), "set").mapInArrow(join, "a long, b long"))


def _split(members: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links to new pivots, and the Voronoi regions of these, of regions ``members(region, total, set, core, text)``.

    About FANOUT members of a region are pivots. A member's nearest pivot makes it core there (if it was core before); it
    is also placed with every pivot within twice the radius of that, as a core member there may be linked to it.
    """
    radius = 1 - percent / 100
    drawn = F.pmod(F.xxhash64("set", "region"), F.greatest(F.lit(1), F.floor(F.col("total") / FANOUT))) == 0
    # Where none is drawn, the smallest member is the pivot, told before the join: every task of a region sees the same ones.
    pivots = members.groupBy(F.col("region").alias("__region")).agg(
        F.collect_list(F.when(drawn, F.struct("set", "text"))).alias("drawn"), F.min(F.struct("set", "text")).alias("least"))
    pivots = pivots.select("__region", F.when(F.size("drawn") > 0, F.col("drawn")).otherwise(F.array("least")).alias("pivots"))
    schema = pa.schema([("of", pa.int64()), ("total", pa.int64()), ("region", pa.int64()), ("set", pa.int64()), ("core", pa.bool_()),
                        ("first", pa.bool_()), ("link", pa.bool_()), ("text", pa.binary())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for region, rows in grouped(batches):
            names = [p["set"] for p in rows.column("pivots")[0].as_py()]
            sets = [p["text"] for p in rows.column("pivots")[0].as_py()]
            for part in rows.to_batches(max_chunksize=512):
                own = part.column(part.schema.get_field_index("set")).to_numpy()
                data = part.column(part.schema.get_field_index("text"))
                core = part.column(part.schema.get_field_index("core")).to_pylist()
                total = part.column(part.schema.get_field_index("total"))[0].as_py()
                here = Members([*sets, *data.to_pylist()], width)
                k, m = len(names), len(own)
                shared = np.stack([here.overlaps(p, k, k + m) for p in range(k)])
                union = here.n[:k, None] + here.n[None, k:] - shared
                distance, near = 1 - shared / union, 100 * shared >= percent * union
                nearest = distance.argmin(0)
                to = distance <= distance.min(0) + 2 * radius + 1e-9
                p, x = np.nonzero(to)
                names_ = np.array(names)
                spot = mixed(names_[p].view(np.uint64) ^ mixed(np.array([region], np.int64).view(np.uint64))[0]).view(np.int64)
                yield pa.record_batch([pa.array(np.full(len(p), region), pa.int64()), pa.array(np.full(len(p), total), pa.int64()), pa.array(spot),
                                       pa.array(own[x]), pa.array([bool(core[j]) and nearest[j] == i for i, j in zip(p, x)], pa.bool_()),
                                       pa.array(names_[p] == own[x], pa.bool_()), pa.array(near[p, x], pa.bool_()),
                                       data.take(pa.array(x))], schema=schema)

    placed = cut(members.join(pivots, members["region"] == pivots["__region"]).select("region", "total", "set", "core", "text", "pivots")
                 .mapInArrow(place, "of long, total long, region long, set long, core boolean, first boolean, link boolean, text binary"),
                 "regions")
    heads = placed.where("first").select(F.col("region").alias("__r"), F.col("set").alias("head")).dropDuplicates(["__r"])
    links = placed.where("link and not first").join(heads, F.col("region") == F.col("__r")).select(F.col("set").alias("a"), F.col("head").alias("b"))
    return links, placed


def _blocks(members: DataFrame, width: int, percent: int) -> DataFrame:
    """Links between core members and all members of dense regions: blocks of either kind meet pairwise, each in one task.

    The pivot's ball needs no comparison inside. ``members(region, set, core, near, total, cores, text)``.
    """
    def parts(n: str) -> F.Column:
        return F.greatest(F.lit(1), F.ceil(F.col(n) / CELL)).cast("int")

    spread = F.pmod(F.xxhash64("set", F.lit(3)), F.col("all_parts"))
    rows = members.withColumn("all_parts", parts("total")).withColumn("core_parts", parts("cores"))
    one = rows.where("core").select("region", F.pmod(F.xxhash64("set", F.lit(5)), F.col("core_parts")).alias("i"),
                                    F.explode(F.sequence(F.lit(0), F.col("all_parts") - 1)).alias("j"), F.lit(True).alias("left"), "set", "near", "text")
    other = rows.select("region", F.explode(F.sequence(F.lit(0), F.col("core_parts") - 1)).alias("i"), spread.alias("j"),
                        F.lit(False).alias("left"), "set", "near", "text")
    cells = one.unionByName(other).withColumn("cell", F.xxhash64("region", "i", "j"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in grouped(batches):
            left = rows.column("left").to_numpy(zero_copy_only=False)
            near, ids = rows.column("near").to_numpy(zero_copy_only=False), rows.column("set").to_numpy()
            a = np.flatnonzero(left)
            rest = np.flatnonzero(~left)
            rest = rest[np.argsort(near[rest], kind="stable")]  # those outside the ball first
            outside = int((~near[rest]).sum())
            if not len(a) or not len(rest):
                continue
            data = rows.column("text").to_pylist()
            here = Members([data[k] for k in (*a, *rest)], width)
            ids = ids[np.concatenate([a, rest])]
            root: dict[int, int] = {}

            def top(k: int) -> int:
                while root.get(k, k) != k:
                    k = root[k]
                return k

            found = []
            for x in range(len(a)):
                b = len(a) + (outside if near[a[x]] else len(rest))
                got = here.overlaps(x, len(a), b)
                for k in np.flatnonzero(100 * got >= percent * (here.n[x] + here.n[len(a):b] - got)) + len(a):
                    u, v = top(int(ids[x])), top(int(ids[k]))
                    if u != v:
                        root[u] = v
                        found.append((int(ids[x]), int(ids[k])))
            yield _pairs(found)

    return (cells.select("cell", "left", "set", "near", "text").repartition("cell").sortWithinPartitions("cell")
            .mapInArrow(meet, "a long, b long"))


def links_of(docs: DataFrame, sized: DataFrame, key: str, text: str, width: int, percent: int) -> DataFrame:
    """``links(a, b)`` between classes that connect what is connected; ``sized`` is the result of ``leading``."""
    exploded = sized.where("lead is not null").select("set", F.explode("lead").alias("shingle"))
    # Every leading shingle travels once: those of one set only are found where they meet.
    ends = Window.partitionBy("shingle")
    rows = cut(exploded.withColumn("low", F.min("set").over(ends)).withColumn("high", F.max("set").over(ends)).where("low <> high")
               .select("set", "shingle").distinct(), "rows")
    known = sized.where("set is not null")
    # Two linked sets share max(1, LEAD * n) leading shingles, n being the smaller size, at least percent of the larger.
    need = F.greatest(F.lit(1), F.floor(F.col("n") * (LEAD * percent / 100 - 1e-9)))
    shares = rows.withColumn("shares", F.count(F.lit(1)).over(Window.partitionBy("set")))
    sizes = known.groupBy(F.col("set").alias("__set")).agg(F.first("n").alias("n"))
    live = (shares.join(sizes, F.col("set") == F.col("__set")).where(F.col("shares") >= need)
            .select("set", "shingle", (-F.round(1000 * F.col("shares") / F.col("n"))).cast("int").alias("rank")))
    elected = (live.withColumn("low", F.min("set").over(ends)).withColumn("high", F.max("set").over(ends))
               .withColumn("region", F.min(F.struct("rank", "set")).over(ends)["set"]).where("low <> high"))
    votes = cut(elected.groupBy("region", "set").agg(F.count(F.lit(1)).alias("votes")), "votes")
    classes = known.groupBy(F.col("set").alias("__set")).agg(F.first("n").alias("n"), F.min(key).alias(key), F.first("buckets").alias("buckets"))
    # Two linked sets share at least ``need`` voters: if each leaves out regions of less than half of them, one is left to both.
    least = Window.partitionBy("set").orderBy("votes", "region").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    pairs = cut(votes.withColumn("sum", F.sum("votes").over(least)).join(classes, F.col("set") == F.col("__set"))
                .where((F.col("sum") * 2 >= need) | (F.col("region") == F.col("set"))).select("region", "set", key, "n", "buckets"), "pairs")
    totals = pairs.groupBy(F.col("region").alias("__region")).agg(F.count(F.lit(1)).alias("total")).where("total > 1")
    places = pairs.join(totals, F.col("region") == F.col("__region")).select("region", "total", "set", key, "n", "buckets")
    near = cut(_reached(places.where(F.col("total") <= CELL), key, percent), "places")
    crowded = cut(places.where(F.col("total") > CELL).select("region", "total", "set", key), "places")
    # Where much of a table is near copies, its texts would lie on disk several times over, were all regions joined at once.
    turns = max(1, -(-SLICES * near.count() // max(1, sized.count())))
    turn = F.pmod(F.xxhash64("region", F.lit(7)), F.lit(turns))
    found = [cut(_joined(region_members(docs, near.where(turn == k) if turns > 1 else near, key, text, width), width, percent), "links")
             for k in range(turns)]
    hot = crowded
    for level in range(LEVELS):
        if hot.isEmpty():
            break
        hot = cut(region_members(docs, hot, key, text, width).drop("first"), "hot") if level == 0 else hot
        links, placed = _split(hot, width, percent)
        found.append(cut(links, "links"))
        counts = placed.groupBy(F.col("region").alias("__r")).agg(F.count(F.lit(1)).alias("now"), F.sum(F.col("core").cast("long")).alias("cores"))
        counts = counts.where("cores > 0 and now > 1")
        rows = placed.withColumnRenamed("total", "before").withColumnRenamed("link", "near").join(counts, F.col("region") == F.col("__r"))
        rows = rows.withColumnRenamed("now", "total").select("region", "before", "total", "cores", "set", "core", "first", "near", "text")
        found.append(cut(_joined(rows.where(F.col("total") <= CELL), width, percent), "links"))
        dense = F.col("total") > 0.7 * F.col("before") if level < LEVELS - 1 else F.lit(True)
        large = rows.where(F.col("total") > CELL)
        found.append(cut(_blocks(large.where(dense), width, percent), "links"))
        hot = cut(large.where(~dense).select("region", "total", "set", "core", "text"), "hot")
    whole = found[0]
    for more in found[1:]:
        whole = whole.unionByName(more)
    return whole


def set_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4, percent: int = 85) -> DataFrame:
    """``(key, n_shingles, set, component, component_id)`` for every row: the digests of its set and of its component, null without
    words, and the smallest key that links of at least ``percent`` can reach.

    Copies are never paired: rows of one class share its component.
    """
    spark = docs.sparkSession
    with small_batches(spark), freed_shuffles(spark):
        sized = cut(leading(docs, key, text, width, percent), "leading")
    with freed_shuffles(spark):
        linked = components(links_of(docs, sized, key, text, width, percent))
        classes = sized.where("set is not null").groupBy("set").agg(F.min(key).alias("smallest"))
        labelled = cut(classes.join(linked.select(F.col("id").alias("__set"), "component"), F.col("set") == F.col("__set"), "left")
                       .select("set", "smallest", F.coalesce("component", "set").alias("component")), "classes")
    lowest = labelled.groupBy(F.col("component").alias("__component")).agg(F.min("smallest").alias("component_id"))
    named = labelled.join(lowest, F.col("component") == F.col("__component")).select(F.col("set").alias("__set"), "component", "component_id")
    return (sized.join(named, F.col("set") == F.col("__set"), "left")
            .select(key, F.col("n").alias("n_shingles"), "set", "component", F.coalesce("component_id", key).alias("component_id")))


def join_components(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4, percent: int = 85) -> DataFrame:
    """``(key, n_shingles, component_id)`` for every row: the smallest key that links of at least ``percent`` can reach."""
    return set_classes(docs, key, text, width, percent).select(key, "n_shingles", "component_id")


def with_sets(docs: DataFrame, text: str = "text", width: int = 4) -> DataFrame:
    """``(row struct, set)``: every row and the digest of its set, null without words."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(text).cast("string").alias("text"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                h, ends = _sets(block, width)
                sets = [_digest(h[a:b]) if b > a else None for a, b in zip(ends, ends[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.row, block.n), pa.array(sets, pa.int64())], names=["row", "set"])

    return rows.mapInArrow(digest, StructType([rows.schema["row"], StructField("set", LongType())]))
