"""Byte-level BPE by overlapping chunks.

A text longer than a chunk is cut into chunks that overlap; every chunk is pre-tokenised on its own, in any task. Cut
positions of two neighbouring chunks are compared inside their overlap: from the first one they share, both go on alike
(a pre-token depends only on where it begins and on what follows), so the texts are stitched there. Where two chunks share
no cut (a pre-token longer than the overlap), they are joined into one piece. The pieces between the stitches are then
encoded in any task and their ids concatenated by document; decoding concatenates the raw bytes of the tokens.

Edge cases: null counts as an empty text, which has no ids and no bytes. Repeated rows are encoded once per row; rows with
equal keys and different texts are kept apart. Control strings in a text are ordinary text. A pre-token of any length, such as
a million blanks, is encoded whole. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.llm.common import cut
from quarrylens.llm.languages import _arrow

#: Code points of a chunk, and of the part that it shares with the next.
CHUNK, OVERLAP = 32_768, 512
#: Cut positions this near to a chunk's end may change with what follows, unless the text ends there.
MARGIN = 64


@lru_cache(maxsize=4)
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def _pattern(pattern: str) -> regex.Pattern:
    return regex.compile(pattern)


#: From so many blanks in a row, a text's pre-tokens are found by ``regex``: the coder's own matcher ends the process on very long ones.
_BLANKS = re.compile(r"\s{4096}")


def _ids(coder, pattern: str, text: str) -> list[int]:
    """The ids of a text, whatever the length of its pre-tokens."""
    if not text:
        return []
    if not _BLANKS.search(text):
        return coder.encode_ordinary(text)
    return [i for m in _pattern(pattern).finditer(text) for i in coder._encode_single_piece(m.group())]


def cuts(text: str, pattern: str, begin: int, end: int) -> list[int]:
    """Where pre-tokens begin in ``text[begin:end]``, relative to ``text``."""
    return [m.start() for m in _pattern(pattern).finditer(text, begin, end)]


def _digest_ids(ids: list[int]) -> str:
    return " ".join(map(str, ids))


def _encode_rows(path: str, pattern: str, keys: int, encoded: pa.Schema):
    """Text (last column) to ids and the bytes that they decode to."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoding(path, pattern)
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                ids = [_ids(coder, pattern, t) for t in part.column(keys).to_pylist()]
                decoded = [coder.decode_bytes(x) for x in ids]
                yield pa.record_batch([*part.columns[:keys], pa.array(ids, pa.list_(pa.int32())),
                                       pa.array(decoded, pa.binary())], schema=encoded)

    return encode


def pieces(docs: DataFrame, key: str, text: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``(key, row, piece, text)``: the stitched pieces of every text longer than a chunk; ``row`` tells texts apart."""
    if not 0 < MARGIN < overlap <= chunk:
        raise ValueError("the overlap must be longer than the margin and no longer than a chunk")
    rows = docs.select(F.col(key).alias(key), F.col(text).alias("text"))
    kind = rows.schema[key].dataType.simpleString()
    base = [(key, _arrow(rows, key)), ("row", pa.string()), ("chunk", pa.int64())]
    chunk_schema = pa.schema([*base, ("text", pa.string()), ("last", pa.bool_())])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, whole in zip(batch.column(0), batch.column(1).to_pylist()):
                row = hashlib.sha256(whole.encode("utf-8", "surrogatepass")).hexdigest()
                starts = range(0, max(1, len(whole) - overlap), chunk)
                for n, at in enumerate(starts):
                    last = at == starts[-1]
                    part = whole[at:] if last else whole[at:at + chunk + overlap]
                    yield pa.record_batch([pa.array([k.as_py()], chunk_schema[0].type), [row], [n], [part], [last]],
                                          schema=chunk_schema)

    sliced = rows.mapInArrow(split, f"`{key}` {kind}, row string, chunk long, text string, last boolean")
    # Repeated rows give equal chunks: one of each is enough, as their number is known from the documents.
    chunks = cut(sliced.groupBy(key, "row", "chunk").agg(F.first("text").alias("text"), F.first("last").alias("last")), "chunks")
    mark_schema = pa.schema([*base, ("last", pa.bool_()), ("head", pa.list_(pa.int64())), ("tail", pa.list_(pa.int64()))])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads, tails = [], []
            for part, n, last in zip(batch.column(3).to_pylist(), batch.column(2).to_pylist(), batch.column(4).to_pylist()):
                found = np.array(cuts(part, pattern, 0, len(part)), np.int64)
                heads.append(found[found < overlap - MARGIN] + n * chunk if n else [])
                tails.append([] if last else found[(found >= chunk) & (found < chunk + overlap - MARGIN)] + n * chunk)
            yield pa.record_batch([*batch.columns[:3], batch.column(4), pa.array(heads, pa.list_(pa.int64())),
                                   pa.array(tails, pa.list_(pa.int64()))], schema=mark_schema)

    marks = chunks.mapInArrow(mark, f"`{key}` {kind}, row string, chunk long, last boolean, head array<long>, tail array<long>")
    # Only cut positions meet by document: a few numbers for each chunk of CHUNK code points.
    order = Window.partitionBy(key, "row").orderBy("chunk")
    shared = F.when(F.col("chunk") == 0, F.lit(0)).otherwise(F.array_min(F.array_intersect("head", F.lag("tail").over(order))))
    # A chunk that shares no cut with the one before is not known to be in step; what follows it stays in one piece.
    stitch = (marks.withColumn("begin", shared).withColumn("known", F.min(F.col("begin").isNotNull()).over(order))
              .withColumn("begin", F.when(F.col("known"), F.col("begin"))).withColumn("piece", F.count("begin").over(order))
              .withColumn("end", F.lead("begin").over(order)).withColumn("following", F.lead("chunk").over(order))
              .select(F.col(key).alias("__k"), F.col("row").alias("__r"), F.col("chunk").alias("__c"), "begin", "end",
                      "following", "piece"))
    joined = chunks.join(stitch, F.col(key).eqNullSafe(F.col("__k")) & (F.col("row") == F.col("__r"))
                         & (F.col("chunk") == F.col("__c")))
    at = F.col("chunk") * chunk
    begin = F.coalesce("begin", at) - at
    end = F.when(F.col("following").isNull(), F.length("text")).otherwise(F.coalesce("end", at + chunk) - at)
    own = joined.select(key, "row", "piece", "chunk",
                        F.substr("text", (begin + 1).cast("int"), (end - begin).cast("int")).alias("text"))
    return (own.groupBy(key, "row", "piece").agg(F.array_sort(F.collect_list(F.struct("chunk", "text"))).alias("parts"))
            .select(key, "row", "piece", F.concat_ws("", F.transform("parts", lambda p: p["text"])).alias("text")))


def encode(docs: DataFrame, ranks: str, pattern: str, key: str = "doc_id", text: str = "text", chunk: int = CHUNK,
           overlap: int = OVERLAP) -> DataFrame:
    """``(key, ids array<int>, decoded binary)`` for every row, as one call over the whole text would give.

    Texts of at most a chunk stay in their task; longer ones are spread over the cluster chunk by chunk. ``ranks`` is the
    path of a rank file that every machine has.
    """
    rows = docs.select(F.col(key).alias(key), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = rows.schema[key].dataType.simpleString()
    schema = pa.schema([(key, _arrow(rows, key)), ("ids", pa.list_(pa.int32())), ("decoded", pa.binary())])
    long = F.length("text") > chunk + overlap
    short = rows.where(~long).mapInArrow(_encode_rows(ranks, pattern, 1, schema), f"`{key}` {kind}, ids array<int>, decoded binary")
    split = pieces(rows.where(long), key, "text", pattern, chunk, overlap)
    piece_schema = pa.schema([schema[0], ("row", pa.string()), ("piece", pa.int64()), *list(schema)[1:]])
    coded = split.mapInArrow(_encode_rows(ranks, pattern, 3, piece_schema),
                             f"`{key}` {kind}, row string, piece long, ids array<int>, decoded binary")
    whole = (coded.groupBy(key, "row").agg(F.array_sort(F.collect_list(F.struct("piece", "ids", "decoded"))).alias("parts"))
             .select(F.col(key).alias("__k"), F.col("row").alias("__r"), F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"),
                     F.expr("aggregate(parts, X'', (whole, p) -> concat(whole, p.decoded))").alias("decoded")))
    times = rows.where(long).groupBy(key, F.sha2("text", 256).alias("row")).count()
    again = (times.join(whole, F.col(key).eqNullSafe(F.col("__k")) & (F.col("row") == F.col("__r")))
             .select(key, "ids", "decoded", F.explode(F.expr("sequence(1L, count)"))).select(key, "ids", "decoded"))
    return short.unionByName(again)


def digests(encoded: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(key, n_tokens, ids_sha256, decoded_sha256)``."""
    return encoded.select(key, F.size("ids").cast("long").alias("n_tokens"),
                          F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
                          F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))
