"""Near-duplicate vectors by NN-descent.

A neighbour graph begins with vectors that lie next to each other along a few random projections and is refined in rounds: the
neighbours of a vertex, in either direction, meet each other (a join of neighbours of neighbours), and every vertex keeps the
best it has met, of all vectors and again of those outside its own group, so a list full of members of a dense group hides
no other group. A list is saturated when it is full and all of it lies above the threshold: it doubles, vertex by vertex, up to
LONGEST. Beyond that, groups serve: they are the connected parts of all threshold edges that were ever met, and inside a group
links are counted exactly, block by block, without writing pairs. A link between groups that no list met is left to the audit,
which draws a sample, so recall is measured and not certain. Only vertices whose lists
changed meet again, and the rounds go on until they bring next to nothing. Recall is audited against brute force, vertex by
vertex, on fresh vertices each time: what an audit finds between groups joins them, and where it misses the target, twice as
many projections are added and the rounds go on, however often it takes.

The search carries half-precision vectors, a quarter of the bytes; a cosine within SLACK of the threshold, more than they can
err by, is checked in doubles before it joins groups.

Edge cases: vectors that are null, zero, of no length, or hold null or non-finite components have no links. Vectors of
different length have no links with each other. Equal vectors are one vertex with a number of copies. Repeated ids are
vertices of their own where their vectors differ; an id's rows are all returned. An empty table gives an empty result. Other
columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.llm.common import components, cut
from quarrylens.llm.jaccard import grouped

#: Neighbours that each of a vertex's two lists holds at first, those that a saturated list holds in the end; edges below this
#: cosine that still guide the descent are dropped.
NEIGHBOURS, LONGEST, GUIDE = 8, 32, 0.5
#: Bound of the error of a cosine of half-precision vectors: two roundings of 2^-11 each, and values too small for a half.
SLACK = 0.0011
#: Projections of the first search; each search after a failed audit takes twice as many as the one before.
PROJECTIONS = 4
#: Vectors in a window along a projection, and the share of new edges of a graph at which the descent ends.
WINDOW, NEW = 48, 0.001
#: Vertices of a draw of the audit, those with links that must be seen, and the mean over them of the share of links found. The
#: draws end at MOST_DRAWS: fewer than LINKED vertices with links in so many are less than 2 % of all.
AUDITED, LINKED, RECALL, MOST_DRAWS = 1024, 256, 0.999, 16
#: Members of one block of a group.
CELL = 256
SEED = 5


def _matrix(column: pa.Array | pa.ChunkedArray, size: int, kind: str = "<f8") -> np.ndarray:
    """Rows of little-endian numbers, read from the buffer of the column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary())
    if not len(column):
        return np.zeros((0, size))
    _, offsets, data = column.buffers()
    begin = int(np.frombuffer(offsets, np.int64, 1, 8 * column.offset)[0])
    return np.frombuffer(data, kind, len(column) * size, begin).reshape(len(column), size)


def _halves(column: pa.Array | pa.ChunkedArray, size: int) -> np.ndarray:
    return _matrix(column, size, "<f2").astype(np.float32)


def vertices(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """``(key, vertex, size, unit, rough)`` for every row: equal directions and lengths in components share a vertex.

    ``unit`` is the vector scaled to length one in doubles, ``rough`` the same in halves; unusable vectors have no vertex.
    """
    rows = vectors.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("vector"))
    schema = pa.schema([("key", pa.int64()), ("vertex", pa.int64()), ("size", pa.int32()), ("unit", pa.binary()), ("rough", pa.binary())])

    def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import blake2b

        for batch in batches:
            lists = batch.column(1)
            sizes = lists.value_lengths().fill_null(0).to_numpy().astype(np.int32)
            flat = lists.flatten().fill_null(np.nan).to_numpy()
            begin = np.cumsum(sizes, dtype=np.int64) - sizes
            names, units, roughs = [None] * len(batch), [None] * len(batch), [None] * len(batch)
            for size in np.unique(sizes[sizes > 0]):
                at = np.flatnonzero(sizes == size)
                x = flat[begin[at][:, None] + np.arange(size)]
                good = np.isfinite(x).all(axis=1) & x.any(axis=1)
                at, x = at[good], x[good]
                x = x / np.abs(x).max(axis=1, keepdims=True)
                x = (x / np.sqrt((x * x).sum(axis=1, keepdims=True))).astype("<f8")
                for k, one, half in zip(at, x, x.astype("<f2")):
                    units[k], roughs[k] = one.tobytes(), half.tobytes()
                    names[k] = int.from_bytes(blake2b(units[k], digest_size=8).digest(), "big", signed=True)
            known = np.array([n is not None for n in names], bool)
            yield pa.record_batch([batch.column(0), pa.array(names, pa.int64()), pa.array(np.where(known, sizes, 0), pa.int32()),
                                   pa.array(units, pa.binary()), pa.array(roughs, pa.binary())], schema=schema)

    return rows.mapInArrow(scale, "key long, vertex long, size int, unit binary, rough binary")


_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("cosine", pa.float64())])
_EDGES_SQL = "a long, b long, cosine double"


def _best(ids: np.ndarray, group: np.ndarray, most: np.ndarray, cosine: np.ndarray, threshold: float) -> pa.RecordBatch:
    """For each row of a block the ``most`` best others and the NEIGHBOURS best of other groups, from GUIDE on; threshold edges
    that connect all groups whose members are that near; and every edge between groups that may or may not be one."""
    np.fill_diagonal(cosine, -2)
    other = np.where(group[:, None] == group[None, :], -2, cosine)
    kept = np.zeros(cosine.shape, bool)
    for each, lengths in ((cosine, most), (other, np.full(len(ids), NEIGHBOURS))):
        k = min(int(lengths.max()), len(ids) - 1)
        at = np.argsort(-each, axis=1, kind="stable")[:, :k]
        good = (np.take_along_axis(each, at, 1) >= min(GUIDE, threshold - SLACK)) & (np.arange(k) < lengths[:, None])
        kept[np.nonzero(good)[0], at[good]] = True
    upper = np.triu(other)
    kept |= (upper >= threshold - SLACK) & (upper < threshold + SLACK)
    named, at = np.unique(group, return_inverse=True)
    root = list(range(len(named)))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in zip(*np.nonzero(upper >= threshold + SLACK)):
        u, v = top(at[x]), top(at[y])
        if u != v:
            root[u] = v
            kept[x, y] = True
    rows, cols = np.nonzero(kept)
    return pa.record_batch([pa.array(ids[rows]), pa.array(ids[cols]), pa.array(cosine[rows, cols].astype(np.float64))], schema=_EDGES)


def sign_bits(n: int) -> int:
    """Signs of projections in a code: about a window of ``n`` vectors shares one, and at least 8 are used."""
    return min(40, max(8, math.ceil(math.log2(max(n, 1) / WINDOW))))


def along_projection(points: DataFrame, seed: int, threshold: float, bits: int) -> DataFrame:
    """Edges between vectors that are near in order of (signs of ``bits`` projections, one more projection).

    The order is a range partitioning, so neither a dense group nor a hot vector fills one task; windows overlap by half.
    """
    schema = pa.schema([("vertex", pa.int64()), ("size", pa.int32()), ("rough", pa.binary()), ("group", pa.int64()), ("code", pa.int64()), ("place", pa.float64())])

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(1).to_numpy()
            code, place = np.zeros(len(batch), np.int64), np.zeros(len(batch))
            for size in np.unique(sizes):
                planes = np.random.default_rng([SEED, seed, int(size)]).standard_normal((int(size), bits + 1))
                at = np.flatnonzero(sizes == size)
                spots = _halves(batch.column(2).take(pa.array(at)), int(size)) @ planes
                code[at] = int(size) << bits | (spots[:, 1:] > 0) @ (1 << np.arange(bits))
                place[at] = spots[:, 0]
            yield pa.record_batch([*batch.columns, pa.array(code), pa.array(place)], schema=schema)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def edges(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            sizes = rows.column("size").to_numpy()
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                ids, group, x = rows.column("vertex").to_numpy()[at], rows.column("group").to_numpy()[at], _halves(rows.column("rough").take(pa.array(at)), int(size))
                for a in range(0, max(1, len(at) - WINDOW // 2), WINDOW // 2):
                    if len(part := ids[a:a + WINDOW]) > 1:
                        yield _best(part, group[a:a + WINDOW], np.full(len(part), NEIGHBOURS), x[a:a + WINDOW] @ x[a:a + WINDOW].T, threshold)

        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= 64 * WINDOW:
                rows = pa.Table.from_batches(held)
                yield from edges(rows)
                held = rows.slice(len(rows) - WINDOW).to_batches()
        if held and sum(map(len, held)):
            yield from edges(pa.Table.from_batches(held))

    placed = points.select("vertex", "size", "rough", "group").mapInArrow(project, "vertex long, size int, rough binary, `group` long, code long, place double")
    return (placed.repartitionByRange("code", "place", "vertex").sortWithinPartitions("code", "place", "vertex")
            .mapInArrow(windows, _EDGES_SQL))


def best_of(edges: DataFrame, labels: DataFrame, lengths: DataFrame, threshold: float) -> DataFrame:
    """``(a, b, cosine, most)``: the best neighbours of each vertex, as many as ``lengths(id, most)`` says or NEIGHBOURS, and the
    NEIGHBOURS best outside its group of ``labels(id, component)``; packed map-side, so no vertex fills a task. ``most`` is how
    many the vertex may hold next: twice as many if its list is saturated."""
    one = edges.groupBy("a", "b").agg(F.max("cosine").alias("cosine"))
    one = (one.join(labels.select(F.col("id").alias("a"), F.col("component").alias("x")), "a")
           .join(labels.select(F.col("id").alias("b"), F.col("component").alias("y")), "b"))
    packed = one.groupBy("a").agg(F.collect_list(F.struct((-F.col("cosine")).alias("less"), "b", (F.col("x") != F.col("y")).alias("outside"))).alias("list"))
    packed = (packed.join(lengths.withColumnRenamed("id", "a"), "a", "left")
              .select("a", F.array_sort("list").alias("list"), F.coalesce("most", F.lit(NEIGHBOURS)).alias("held")))
    last = F.get("list", F.col("held") - 1)["less"]
    saturated = F.coalesce(last <= -threshold, F.lit(False)) & (F.col("held") < LONGEST)
    both = F.array_union(F.slice("list", F.lit(1), F.col("held")), F.slice(F.filter("list", lambda e: e["outside"]), 1, NEIGHBOURS))
    return (packed.select("a", F.when(saturated, F.least(F.col("held") * 2, F.lit(LONGEST))).otherwise(F.col("held")).alias("most"), F.explode(both).alias("e"))
            .select("a", F.col("e.b").alias("b"), (-F.col("e.less")).alias("cosine"), "most"))


def descend(graph: DataFrame, points: DataFrame, threshold: float) -> DataFrame:
    """Edges between neighbours of a common vertex: lists of either direction meet, each list in one task.

    Only lists with a ``fresh`` edge meet: the members of the others have met before. ``points`` holds ``group`` and ``most``.
    """
    there = graph.select("a", "b")
    back = graph.groupBy(F.col("b").alias("a")).agg(F.collect_list(F.struct(F.xxhash64("a", "b").alias("draw"), F.col("a").alias("b"))).alias("list"))
    back = back.select("a", F.explode(F.slice(F.array_sort("list"), 1, 2 * NEIGHBOURS)).alias("e")).select("a", F.col("e.b").alias("b"))
    lists = there.unionByName(back).unionByName(there.select("a", F.col("a").alias("b"))).distinct()
    fresh = graph.where("fresh")
    changed = fresh.select("a").union(fresh.select("b")).distinct()
    rows = (lists.join(changed, "a", "left_semi").join(points, F.col("b") == F.col("vertex"))
            .select("a", "vertex", "size", "rough", "group", "most"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, part in grouped(batches):
            if len(part) > 1:
                x = _halves(part.column("rough"), part.column("size")[0].as_py())
                yield _best(part.column("vertex").to_numpy(), part.column("group").to_numpy(), part.column("most").to_numpy(), x @ x.T, threshold)

    return rows.repartition("a").sortWithinPartitions("a").mapInArrow(meet, _EDGES_SQL)


def certain(edges: DataFrame, points: DataFrame, labels: DataFrame, threshold: float) -> DataFrame:
    """Those ``edges(a, b, cosine)`` that reach the threshold in doubles; near it, only edges between groups are looked at."""
    doubt = (edges.where(F.col("cosine").between(threshold - SLACK, threshold + SLACK))
             .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
             .join(labels.select(F.col("id").alias("a"), F.col("component").alias("x")), "a")
             .join(labels.select(F.col("id").alias("b"), F.col("component").alias("y")), "b").where("x <> y")
             .join(points.select(F.col("vertex").alias("a"), "size", F.col("unit").alias("u")), "a")
             .join(points.select(F.col("vertex").alias("b"), F.col("unit").alias("v")), "b").select("a", "b", "size", "u", "v"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("size").to_numpy()
            for size in np.unique(sizes):
                part = batch.take(pa.array(np.flatnonzero(sizes == size)))
                u, v = (_matrix(part.column(c), int(size)) for c in ("u", "v"))
                near = pa.array((u * v).sum(axis=1) >= threshold)
                yield pa.record_batch([part.column("a").filter(near), part.column("b").filter(near)], names=["a", "b"])

    return edges.where(F.col("cosine") > threshold + SLACK).select("a", "b").unionByName(doubt.mapInArrow(check, "a long, b long"))


def merged(labels: DataFrame, edges: DataFrame) -> tuple[DataFrame, bool]:
    """``labels(id, component)`` after ``edges(a, b)`` have joined groups, and whether any did."""
    across = cut(edges.join(labels.select(F.col("id").alias("a"), F.col("component").alias("x")), "a")
                 .join(labels.select(F.col("id").alias("b"), F.col("component").alias("y")), "b")
                 .where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "across")
    if across.isEmpty():
        return labels, False
    found = components(across).select(F.col("id").alias("component"), F.col("component").alias("lower"))
    return cut(labels.join(found, "component", "left").select("id", F.coalesce("lower", "component").alias("component")), "groups"), True


def count_links(points: DataFrame, groups: DataFrame, threshold: float) -> DataFrame:
    """``(vertex, links)``: other rows within the threshold, exact inside each group of ``groups(id, component)``.

    A group is cut into blocks of about CELL vectors and every pair of blocks is one cell of work; a cell gives one number
    for each of its vectors, so no pair is written. ``points`` must hold ``copies``, the rows of a vertex.
    """
    sizes = groups.groupBy(F.col("component").alias("__c")).agg(F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias("parts"))
    rows = (groups.join(sizes, F.col("component") == F.col("__c")).join(points, F.col("id") == F.col("vertex"))
            .select("component", "parts", "vertex", "size", "unit", "copies", F.pmod(F.xxhash64("vertex", F.lit(1)), F.col("parts")).cast("int").alias("i")))
    cells = rows.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cells = cells.withColumn("cell", F.xxhash64("component", F.least("i", "j"), F.greatest("i", "j"))).withColumn("diagonal", F.col("i") == F.col("j"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, part in grouped(batches):
            x = _matrix(part.column("unit"), part.column("size")[0].as_py())
            ids, copies, block = (part.column(c).to_numpy() for c in ("vertex", "copies", "i"))
            whole = part.column("diagonal")[0].as_py()
            near = x @ x.T >= threshold
            np.fill_diagonal(near, False)
            if not whole:  # each block counts the other one
                near &= block[:, None] != block[None, :]
            yield pa.record_batch([pa.array(ids), pa.array(near @ copies)], names=["vertex", "links"])

    found = (cells.select("cell", "vertex", "size", "unit", "copies", "i", "diagonal").repartition("cell").sortWithinPartitions("cell")
             .mapInArrow(count, "vertex long, links long"))
    return found.groupBy("vertex").agg(F.sum("links").alias("links"))


def brute_force(points: DataFrame, threshold: float, salt: int, at: int, most: int = AUDITED) -> DataFrame:
    """``(a, b, group, links)`` of ``most`` vertices of ``points(vertex, size, unit, group, copies)``, those behind the first ``at``
    in order of a hash: ``links`` rows of ``group`` are linked with ``a``, one of them of the vertex ``b``. All vectors are
    compared with the chosen ones, whose block is sent to every task; pairs are not written."""
    chosen = (points.orderBy(F.xxhash64("vertex", F.lit(2 + salt)), "vertex").offset(at).limit(most)
              .select("vertex", "size", "unit").collect())
    sent = points.sparkSession.sparkContext.broadcast([(r.vertex, r["size"], bytes(r.unit)) for r in chosen])
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("group", pa.int64()), ("links", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            sizes = batch.column(1).to_numpy()
            for size in np.unique(sizes):
                mine = [(v, u) for v, s, u in own if s == size]
                if not mine:
                    continue
                at = np.flatnonzero(sizes == size)
                x = _matrix(batch.column(2).take(pa.array(at)), int(size))
                ids, groups, copies = (batch.column(c).to_numpy()[at] for c in (0, 3, 4))
                q = np.frombuffer(b"".join(u for _, u in mine), "<f8").reshape(len(mine), int(size))
                near = q @ x.T >= threshold
                near &= np.array([v for v, _ in mine])[:, None] != ids[None, :]
                found = []
                for (v, _), linked in zip(mine, near):
                    k = np.flatnonzero(linked)
                    names, first, where = np.unique(groups[k], return_index=True, return_inverse=True)
                    links = np.bincount(where, copies[k], len(names)).astype(np.int64)
                    found += [(v, int(ids[k[f]]), int(g), int(n)) for g, f, n in zip(names, first, links)]
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*found)] if found else [pa.array([], pa.int64())] * 4, schema=schema)

    return (points.select("vertex", "size", "unit", "group", "copies").mapInArrow(count, "a long, b long, `group` long, links long")
            .groupBy("a", "group").agg(F.min("b").alias("b"), F.sum("links").alias("links")).select("a", "b", "group", "links"))


def audited(points: DataFrame, labels: DataFrame, threshold: float, salt: int, n: int) -> tuple[float, DataFrame]:
    """The recall of ``labels``, as the mean over audited vertices with links of the share of links inside their group, and the
    edges ``(a, b)`` that lead out of groups."""
    grouped_ = points.join(labels, F.col("vertex") == F.col("id")).select("vertex", "size", "unit", F.col("component").alias("group"), "copies")
    linked, total, out = 0, 0.0, None
    for draw in range(MOST_DRAWS):
        true = cut(brute_force(grouped_, threshold, salt, draw * AUDITED)
                   .join(labels.select(F.col("id").alias("a"), F.col("component").alias("own")), "a")
                   .select("a", "b", "links", (F.col("own") == F.col("group")).alias("inside")), "audit")
        share = true.groupBy("a").agg((F.sum(F.when(F.col("inside"), F.col("links")).otherwise(0)) / F.sum("links")).alias("share"))
        told = share.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("share"), F.lit(0.0)).alias("sum")).first()
        linked, total = linked + told["n"], total + told["sum"]
        missed = true.where("not inside").select("a", "b")
        out = missed if out is None else out.unionByName(missed)
        if linked >= LINKED or (draw + 1) * AUDITED >= n:
            break
    return (total / linked if linked else 1.0), out


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.9) -> DataFrame:
    """``(key, n_links, component_id, kept)`` for every row, compared by cosine in double precision."""
    return searched(vectors, key, vector, threshold)[0]


def searched(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.9) -> tuple[DataFrame, float]:
    """The rows of ``near_duplicates`` and the recall that the last audit measured, before what it found was put right."""
    rows = cut(vertices(vectors, key, vector), "vectors")
    points = cut(rows.where("vertex is not null").groupBy("vertex").agg(
        F.first("size").alias("size"), F.first("unit").alias("unit"), F.first("rough").alias("rough"),
        F.count(F.lit(1)).alias("copies"), F.min("key").alias("smallest")), "points")
    n, rough = points.count(), points.select("vertex", "size", "rough")
    labels = cut(points.select(F.col("vertex").alias("id"), F.col("vertex").alias("component")), "groups")
    lengths = rough.sparkSession.createDataFrame([], "id long, most int")
    graph, seeds, audits = None, 0, 0
    while True:
        here = rough.join(labels, F.col("vertex") == F.col("id")).withColumnRenamed("component", "group")
        found = None
        for _ in range(PROJECTIONS << audits):
            more = along_projection(here, seeds, threshold, sign_bits(n))
            found = more if found is None else found.unionByName(more)
            seeds += 1
        found = cut(found, "found")
        while True:
            labels, joined = merged(labels, certain(found, points, labels, threshold))
            known = found if graph is None else graph.select("a", "b", "cosine").unionByName(found)
            better = best_of(known, labels, lengths, threshold)
            old = found.limit(0) if graph is None else graph
            better = cut(better.join(old.select("a", "b", F.lit(True).alias("old")), ["a", "b"], "left")
                         .select("a", "b", "cosine", "most", F.col("old").isNull().alias("fresh")), "graph")
            new, every = better.agg(F.coalesce(F.count_if("fresh"), F.lit(0)), F.count(F.lit(1))).first()
            graph, lengths = better, better.where(F.col("most") > NEIGHBOURS).select(F.col("a").alias("id"), "most").distinct()
            if not joined and new <= NEW * every:
                break
            state = (rough.join(labels, F.col("vertex") == F.col("id")).withColumnRenamed("component", "group").drop("id")
                     .join(lengths, F.col("vertex") == F.col("id"), "left").withColumn("most", F.coalesce("most", F.lit(NEIGHBOURS))).drop("id"))
            found = cut(descend(graph, state, threshold), "found")
        recall, missed = audited(points, labels, threshold, audits, n)
        audits += 1
        labels, joined = merged(labels, missed)  # an audit that misses the target joins groups, so there is a last one
        if recall >= RECALL or not joined:
            break
    groups = cut(labels.join(labels.groupBy("component").agg(F.count(F.lit(1)).alias("members")).where("members > 1").select("component"), "component")
                 .select("id", "component"), "groups")
    counted = cut(count_links(points, groups, threshold), "counted")
    # Copies of one vector are links of each other; equal cosines of copies with others are counted by their number.
    named = (points.join(groups, F.col("vertex") == F.col("id"), "left").select("vertex", "copies", "smallest", F.coalesce("component", "vertex").alias("component")))
    lowest = named.groupBy(F.col("component").alias("__c")).agg(F.min("smallest").alias("component_id"))
    labelled = (named.join(lowest, F.col("component") == F.col("__c")).join(counted.withColumnRenamed("vertex", "__v"), F.col("vertex") == F.col("__v"), "left")
                .select(F.col("vertex").alias("__vertex"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"))
    out = rows.join(labelled, F.col("vertex") == F.col("__vertex"), "left").select(
        F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "key").alias("component_id"))
    return out.withColumn("kept", F.col(key).eqNullSafe(F.col("component_id"))), recall
