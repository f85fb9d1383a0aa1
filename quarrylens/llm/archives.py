"""WARC archives and a merged capture index.

Records are written as WARC/1.1 files by Spark's text writer (each record is a row, its last byte the line separator), so
they reach any file system that Spark reaches. Every file gives one run of index entries, sorted by URL key and time. The
runs are cut at common key bounds, and each key range merges its parts of all runs with a loser tree: the ranges, one after
another, are the globally ordered capture histories.

Edge cases: a null payload is an empty one; a null URL is empty and has an empty key. Pages with equal ids are captures of
their own. Equal payloads of at least SMALLEST bytes become revisits of the smallest id among them; ties of that id go to
one row only if the rows are equal in all else, otherwise every such row is a response. A long payload makes files of fewer
records. An empty table gives no files and an empty index. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Payloads below this many bytes are never revisits.
SMALLEST = 100
#: Records of one file at most, and payload bytes that the records of a file may come to: bounds the memory of a task that reads it.
FILE_RECORDS, FILE_BYTES = 2_000, 128 << 20
#: Index entries of one key range, about.
RANGE_ENTRIES = 10_000
# Fixed value: says that a revisit repeats a payload of the same digest.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: First capture time where the pages carry none; page_id seconds are added.
EPOCH = "2024-01-01 00:00:00"

_HEAD = re.compile(rb"([A-Za-z0-9-]+): ?(.*?)\r\n")


def url_key(url: Column) -> Column:
    """Sort-friendly form of a URL: host labels reversed, then the path; case, scheme, port and ``www.`` do not count."""
    bare = F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/@]*@)?(?:www\d*\.)?", "")
    host = F.regexp_extract(bare, r"^([^/:?#]*)", 1)
    path = F.regexp_replace(F.regexp_replace(bare, r"^[^/?#]*", ""), r"#.*$", "")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), ","), F.lit(")"), F.when(path == "", "/").otherwise(path))


def with_revisits(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", time: str | None = None) -> DataFrame:
    """``(key, url, html, time, digest, length, refers_to)``: which captures repeat the payload of an earlier id.

    Payloads are compared by SHA-256 and length; only digests and ids are shuffled, summed up map-side, and only digests
    that occur twice or more come back to the pages, on a join whose large side AQE can split.
    """
    when = F.timestamp_seconds(F.unix_timestamp(F.lit(EPOCH)) + F.coalesce(F.col(key).cast("long"), F.lit(0))) if time is None else F.col(time)
    rows = pages.select(F.col(key).alias("page_id"), F.coalesce(F.col(url), F.lit("")).alias("url"),
                        F.coalesce(F.col(html), F.lit("")).alias("html"), when.alias("time"))
    rows = rows.select("*", F.sha2("html", 256).alias("digest"), F.octet_length("html").cast("long").alias("length"))
    again = (rows.where(F.col("length") >= SMALLEST).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
             .where("n > 1").select(F.col("digest").alias("__digest"), "first"))
    return (rows.join(again, (F.col("digest") == F.col("__digest")) & (F.col("length") >= SMALLEST), "left")
            .withColumn("refers_to", F.when(F.col("page_id") != F.col("first"), F.col("first"))).drop("__digest", "first"))


def write_archives(captures: DataFrame, path: str) -> None:
    """WARC files of captures of ``with_revisits``; revisits carry no payload.

    A file has at most FILE_RECORDS records, and no more than FILE_BYTES hold of the longest payload there is; a longer one is alone.
    """
    longest = captures.agg(F.max("length")).first()[0] or 0
    most = max(1, min(FILE_RECORDS, FILE_BYTES // max(longest, 1)))
    ident = lambda k: F.concat(F.lit("<urn:page:"), k.cast("string"), F.lit(">"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    revisit = F.col("refers_to").isNotNull()
    clean = F.regexp_replace("url", r"[\r\n]", "%0A")
    when = F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    head = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", ident(F.coalesce(F.col("page_id").cast("string"), F.lit("")))), line("WARC-Date", F.coalesce(when, F.lit(""))),
        line("WARC-Target-URI", clean), line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        line("WARC-Payload-Length", F.col("length").cast("string")),
        F.when(revisit, F.concat(line("WARC-Refers-To", ident(F.col("refers_to"))), line("WARC-Profile", F.lit(PROFILE)))).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("length").cast("string"))), F.lit("\r\n"))
    record = F.concat(head, F.when(revisit, F.lit("")).otherwise(F.col("html")), F.lit("\r\n\r"))
    (captures.select(record.alias("value")).write.option("lineSep", "\n").option("maxRecordsPerFile", most)
     .option("compression", "gzip").text(path))


def records(data: bytes) -> Iterator[tuple[dict[str, str], int, int]]:
    """Header fields, and begin and length of the content, of every record of a WARC file; raises where it is broken."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if data[at:at + 5] != b"WARC/" or end < 0:
            raise ValueError(f"no WARC record at byte {at}")
        fields = {name.decode().lower(): value.decode("utf-8", "replace") for name, value in _HEAD.findall(data[at:end + 2])}
        size = int(fields["content-length"])
        if data[end + 4 + size:end + 8 + size] != b"\r\n\r\n":
            raise ValueError(f"a WARC record at byte {at} has another length than it says")
        yield fields, end + 4, size
        at = end + 8 + size


_ENTRY = pa.schema([("run", pa.string()), ("url", pa.string()), ("time", pa.string()), ("page_id", pa.string()), ("type", pa.string()),
                    ("digest", pa.string()), ("length", pa.int64()), ("refers_to", pa.string()), ("offset", pa.int64())])


def index_entries(spark: SparkSession, path: str) -> DataFrame:
    """An index entry per record, read back from the archives; a response's payload must have the digest it claims."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        for batch in batches:
            for k in range(len(batch)):
                data = batch.column(1)[k].as_py()
                data = zlib.decompress(data, 31) if data[:2] == b"\x1f\x8b" else data
                found: list[tuple] = []
                for fields, at, size in records(data):
                    digest = fields["warc-payload-digest"].removeprefix("sha256:")
                    if fields["warc-type"] == "response" and hashlib.sha256(data[at:at + size]).hexdigest() != digest:
                        raise ValueError(f"the payload of {fields['warc-record-id']} has another digest")
                    ident = lambda name: fields[name][len("<urn:page:"):-1] if name in fields else None  # noqa: B023, E731
                    found.append((batch.column(0)[k].as_py(), fields["warc-target-uri"], fields["warc-date"], ident("warc-record-id"),
                                  fields["warc-type"], digest, int(fields["warc-payload-length"]), ident("warc-refers-to"), at))
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*found), _ENTRY)] if found else
                                      [pa.array([], f.type) for f in _ENTRY], schema=_ENTRY)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    spread = files.select("path", "content").mapInArrow(
        read, "run string, url string, time string, page_id string, type string, digest string, length long, refers_to string, offset long")
    return spread.select("*", url_key(F.col("url")).alias("url_key"))


class LoserTree:
    """Merges sorted runs: each inner node keeps the loser of its match, so the next winner replays one path only.

    With k runs an entry costs about log2(k) comparisons. Ties go to the earlier run.
    """

    def __init__(self, runs: Iterable[Iterator[tuple]]):
        self.runs = [iter(r) for r in runs]
        self.heads: list[tuple | None] = [next(r, None) for r in self.runs]
        self.losers = [-1] * max(1, len(self.runs))
        for k in range(len(self.runs)):
            self._play(k)

    def _beats(self, a: int, b: int) -> bool:
        if a < 0 or b < 0:
            return a < 0  # during building: a free place lets the newcomer wait there
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and (x[0], a) < (y[0], b))

    def _play(self, winner: int) -> None:
        node = (winner + len(self.runs)) // 2
        while node > 0:
            if self._beats(self.losers[node], winner):
                self.losers[node], winner = winner, self.losers[node]
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self.runs and self.heads[self.losers[0]] is not None:
            k = self.losers[0]
            yield self.heads[k]
            self.heads[k] = next(self.runs[k], None)
            self._play(k)


def merged_index(entries: DataFrame, ranges: int | None = None) -> DataFrame:
    """``entries`` in order of URL key, time and id, with ``capture``, the number of the entry within its range, and ``range``.

    Range bounds come from Spark's sample; they cut by (key, time, id), so a host or URL with a third of all captures falls
    into many ranges. Inside a range the entries lie run by run, each run sorted, and a loser tree merges them; a task
    holds one range. Concatenated by ``range`` and ``capture``, the ranges are the whole history.
    """
    order = ["url_key", "time", "page_id"]
    n = ranges or max(1, entries.count() // RANGE_ENTRIES)
    columns = entries.columns
    cut = entries.repartitionByRange(n, *order).sortWithinPartitions("run", *order)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        batches = list(batches)
        if not batches:
            return
        table = pa.Table.from_batches(batches).combine_chunks()
        run, keys = table.column("run").to_pylist(), list(zip(*(table.column(c).to_pylist() for c in order)))
        keys = [tuple(x or "" for x in key) for key in keys]
        starts = [k for k in range(len(run)) if k == 0 or run[k] != run[k - 1]] + [len(run)]
        runs = [((keys[k], k) for k in range(a, b)) for a, b in zip(starts, starts[1:])]
        at = [k for _, k in LoserTree(runs)]
        merged = table.take(pa.array(at, pa.int64()))
        merged = merged.append_column("range", pa.array([TaskContext.get().partitionId()] * len(at), pa.int64()))
        yield from merged.append_column("capture", pa.array(range(len(at)), pa.int64())).to_batches(max_chunksize=10_000)

    return cut.mapInArrow(merge, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in entries.schema[:]) + ", range long, capture long"
                          ).select(*columns, "range", "capture")


def histories(merged: DataFrame) -> DataFrame:
    """A written ``merged_index`` with ``place``, the number of an entry in the whole history, from 0: its range's start and its capture."""
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each range of RANGE_ENTRIES entries.
    starts = merged.groupBy("range").agg(F.count(F.lit(1)).alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return merged.join(starts, "range").withColumn("place", F.col("start") + F.col("capture")).drop("start")
