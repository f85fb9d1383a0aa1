"""Words, shingles and lines of Arrow text batches as numpy arrays, many documents at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer document is handled alone.
BLOCK = 1 << 20

IS_GAP = np.zeros(256, bool)
IS_GAP[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32

_random = np.random.Generator(np.random.PCG64(20240607))
_CODE = _random.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_LANES = _random.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _grown(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if len(_powers[0]) < n:
        size = max(n, BLOCK + 1)
        for k, b in enumerate((_BASE, _INVERSE)):
            powers = np.full(size, b, np.uint64)
            powers[0] = 1
            _powers[k] = np.multiply.accumulate(powers)
    return _powers


def mixed(h: np.ndarray) -> np.ndarray:
    """Well spread 64-bit values (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Block:
    """Consecutive texts: their bytes, where each begins, and the row of the batch at which they begin."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, row: int):
        self.data, self.offsets, self.row, self.n = data, offsets, row, len(offsets) - 1

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begin, end and document of the runs of bytes that are ``inside``; no run crosses documents."""
        if not len(inside):
            return (np.zeros(0, np.int64),) * 3
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        begin = self.offsets[:-1][np.diff(self.offsets) > 0]
        first[begin] = inside[begin]
        last[begin[1:] - 1] = inside[begin[1:] - 1]
        starts = np.flatnonzero(first)
        return starts, np.flatnonzero(last) + 1, np.searchsorted(self.offsets, starts, "right") - 1

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.runs(~IS_GAP[self.data])

    def hashes(self, starts: np.ndarray, ends: np.ndarray, data: np.ndarray | None = None) -> np.ndarray:
        """A 64-bit hash of each byte range."""
        data = self.data if data is None else data
        power, inverse = _grown(len(data) + 1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_CODE[data] * power[:len(data)], out=total[1:])
        return mixed((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))

    def total(self, flags: np.ndarray) -> np.ndarray:
        """How many flagged bytes each document has."""
        sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return sums[self.offsets[1:]] - sums[self.offsets[:-1]]


def blocks(texts: pa.Array | pa.ChunkedArray) -> Iterator[Block]:
    """The texts of a batch in blocks of about BLOCK bytes; null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_string()) if texts.null_count else texts.cast(pa.large_string())
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK, "right")) - 1)
        yield Block(data[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at], at)
        at = to


def shingles(h: np.ndarray, doc: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of every run of ``width`` words; ``h`` and ``doc`` are those of the words, in order."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total += h[k:k + n] * _LANES[k]
    whole = doc[:n] == doc[width - 1:]
    return mixed(total)[whole], doc[:n][whole]


def whole_sequences(h: np.ndarray, doc: np.ndarray, n: int, below: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of the whole word sequence of each document with 1 to ``below - 1`` words."""
    count = np.bincount(doc, minlength=n)
    short = (count > 0) & (count < below)
    first = np.concatenate([[0], np.cumsum(count)])[:-1]
    docs = np.flatnonzero(short)
    total = count[docs].astype(np.uint64) * _LANES[below]
    for k in range(below - 1):
        more = count[docs] > k
        total[more] += h[first[docs[more]] + k] * _LANES[k]
    return mixed(total ^ np.uint64(0xA5A5A5A5A5A5A5A5)), docs


def apart(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Hashes that are equal within a document only."""
    return mixed(h + (doc.astype(np.uint64) + np.uint64(1)) * _LANES[-1])
