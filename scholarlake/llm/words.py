"""Vectorised word and byte kernels over Arrow string columns.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``; all of these
are ASCII, so splitting the UTF-8 bytes equals splitting the characters.
Words are identified by a 64-bit hash: a polynomial over random byte values,
finalised by a bijective mixer. Nothing here keeps state between batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
MASK = (1 << 64) - 1
#: Odd multiplier of the word polynomial and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 1 << 64)
#: Bytes of text that one numpy step works on.
SLICE_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser (two xor-shift-multiply rounds) on uint64."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def salted(x: np.ndarray, salt: int) -> np.ndarray:
    """An independent hash of uint64 keys for every salt."""
    return mix(x + U((salt * 0xD1342543DE82EF95 + 0x632BE59BD9B4E019) & MASK))


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def byte_values(seed: int = 0) -> np.ndarray:
    """256 random odd 64-bit values, one for each byte."""
    return salted(np.arange(256, dtype=U), 7919 + seed) | U(1)


class Kept(dict):
    """A cache of one process: it travels to others empty."""

    def __reduce__(self):
        return Kept, ()


POWERS = Kept()


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; not to be written to."""
    found = POWERS.get(base)
    if found is None or len(found) < n:
        found = np.full(max(n, SLICE_BYTES + 1), base, dtype=U)
        found[0] = 1
        np.multiply.accumulate(found, out=found)
        if n <= 4 * SLICE_BYTES:
            POWERS[base] = found
    return found[:n]


def raw_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=n + 1, offset=8 * column.offset)
    data = column.buffers()[2]
    lo, hi = int(offsets[0]), int(offsets[-1])
    if data is None or hi == lo:
        return np.zeros(0, np.uint8), offsets - lo
    return np.frombuffer(data, dtype=np.uint8, count=hi - lo, offset=lo), offsets - lo


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about ``limit`` text bytes; a longer text is a run of its own."""
    if not batch.num_rows:
        return
    sizes = np.diff(raw_text(batch.column(batch.schema.get_field_index(text)))[1])
    at, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > at and held + size > limit:
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += size
    yield batch.slice(at)


class Words:
    """Words of a run of texts.

    ``start``/``end``: byte offsets of each word; ``first``: index of each
    text's first word (one more entry than texts); ``hash``: word hashes.
    """

    def __init__(self, column: pa.Array, lower: bool = False, seed: int = 0, hashed: bool = True, letters: bool = False):
        """``letters``: words are runs of letters, digits and non-ASCII bytes instead, and ``lower`` also folds U+00C0 to U+00DE."""
        data, self.offsets = raw_text(column)
        if lower:
            data = data + ((data >= 65) & (data <= 90)) * np.uint8(32)
        if letters and lower and len(data):
            data[1:] += ((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) * np.uint8(32)
        self.data = data
        n = len(data)
        if letters:
            solid = (data >= 128) | ((data >= 97) & (data <= 122)) | ((data >= 65) & (data <= 90)) | ((data >= 48) & (data <= 57))
        else:
            solid = (data != 32) & ((data < 9) | (data > 13))
        edge = np.zeros(n + 1, bool)
        edge[self.offsets] = True
        opens = solid.copy()
        opens[1:] &= ~solid[:-1] | edge[1:-1]
        closes = solid.copy()
        closes[:-1] &= ~solid[1:] | edge[1:-1]
        self.start = np.flatnonzero(opens)
        self.end = np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.start, self.offsets)
        self.count = np.diff(self.first)
        if hashed:
            self.hash = self.hashes(seed)

    def hashes(self, seed: int = 0) -> np.ndarray:
        total = np.zeros(len(self.data) + 1, U)
        step = byte_values(seed)[self.data]
        step *= powers(BASE, len(self.data))
        np.cumsum(step, out=total[1:])
        self.total, self.back = total, powers(BASE_INV, len(self.data) + 1)[self.start]
        del step
        return mix((total[self.end] - total[self.start]) * self.back)

    def prefix_hash(self, n: int) -> np.ndarray:
        """Hashes of the words' first ``n`` bytes (of the whole word where it is shorter)."""
        return mix((self.total[np.minimum(self.start + n, self.end)] - self.total[self.start]) * self.back)

    def doc_of(self) -> np.ndarray:
        """Index of the text that holds each word."""
        return np.repeat(np.arange(len(self.count)), self.count)

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def windows(hashes: np.ndarray, first: np.ndarray, width: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of ``width`` consecutive words (by its first word) and where a run stays inside its text.

    The hash is a polynomial over word hashes, so equal runs hash alike anywhere.
    """
    n = len(hashes)
    if n < width:
        return np.zeros(0, U), np.zeros(0, bool)
    base = (0xA24BAED4963EE407 + 2 * seed * 0x9FB21C651E98DF25) & MASK | 1
    total = np.zeros(n + 1, U)
    np.cumsum(salted(hashes, 31 + seed) * powers(base, n), out=total[1:])
    h = mix((total[width:] - total[:-width]) * powers(pow(base, -1, 1 << 64), n + 1)[: n - width + 1])
    ends = np.repeat(first[1:], np.diff(first))
    return h, np.arange(n - width + 1) + width <= ends[: n - width + 1]
