"""Packing documents into token windows by best-fit decreasing.

Every task packs its own documents, a bounded number of tokens at a time: a
document is cut into full windows, and of what is left the longest goes first
into the tightest open window that takes it. A segment tree over remaining
capacities finds that window. Windows that would still be padded are then
filled exactly from the emptiest ones, and the last one of a scope is cut into
sequences whose lengths are powers of two. Nothing is shuffled.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from scholarlake.llm.tokens import WordIds
from scholarlake.llm.tools import rows_out, texts

#: Tokens whose remainders are packed together.
SCOPE_TOKENS = 8_000_000
#: Bits of a sequence number below the partition's.
SEQUENCE_BITS = 40
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
PIECES_ARROW = pa.schema([(name, pa.int64()) for name in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])

Piece = tuple[int, int, int]  # item, start, length


class OpenWindows:
    """Windows by remaining capacity; a segment tree says which capacities have one."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.some = [False] * (2 * self.size)
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, window: int, free: int) -> None:
        self.at[free].append(window)
        node = self.size + free
        while node and not self.some[node]:
            self.some[node] = True
            node >>= 1

    def tightest(self, need: int) -> tuple[int, int] | None:
        """(window, free) with the least free >= need, taken out."""
        node = self.size + need
        while not self.some[node]:
            while node & 1:
                node >>= 1
                if not node:
                    return None
            node += 1
        while node < self.size:
            node = 2 * node if self.some[2 * node] else 2 * node + 1
        free = node - self.size
        window = self.at[free].pop()
        if not self.at[free]:
            self.some[node] = False
            while node > 1:
                node >>= 1
                self.some[node] = self.some[2 * node] or self.some[2 * node + 1]
        return window, free


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Items of each window, items by decreasing length (ties: in their order)."""
    windows: list[list[int]] = []
    room = OpenWindows(capacity)
    for item in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        need = lengths[item]
        window, free = room.tightest(need) or (len(windows), capacity)
        if window == len(windows):
            windows.append([])
        windows[window].append(item)
        if free > need:
            room.add(window, free - need)
    return windows


def total(window: list[Piece]) -> int:
    return sum(length for _, _, length in window)


def halved(window: list[Piece]) -> Iterator[list[Piece]]:
    """Sequences of one window's tokens, each as long as the largest power of two that is left."""
    rest, left = deque(window), total(window)
    while left:
        want, made = 1 << (left.bit_length() - 1), []
        left -= want
        while want:
            item, start, length = rest.popleft()
            taken = min(want, length)
            made.append((item, start, taken))
            if length > taken:
                rest.appendleft((item, start + taken, length - taken))
            want -= taken
        yield made


def filled(windows: list[list[Piece]], capacity: int) -> Iterator[list[Piece]]:
    """The same tokens without padding: the fullest windows take pieces of the emptiest ones, what is left last is halved."""
    short = deque()
    for window in windows:
        n = total(window)
        if n == capacity or n & (n - 1) == 0:
            yield window
        else:
            short.append((n, window))
    short = deque(sorted(short, key=lambda x: x[0]))
    while short:
        n, window = short.pop()
        while n < capacity and short:
            donor = short[0][1]
            item, start, length = donor.pop()
            taken = min(capacity - n, length)
            window.append((item, start + length - taken, taken))
            n += taken
            if length > taken:
                donor.append((item, start, length - taken))
            elif not donor:
                short.popleft()
        yield from [window] if n == capacity else halved(window)


class Packer:
    """Packs one task's documents; numbers sequences from ``first``."""

    def __init__(self, capacity: int, first: int):
        self.capacity, self.next = capacity, first
        self.items: list[tuple[int, int, int, memoryview]] = []  # id, start, tokens of the document, ids of the rest
        self.held = 0

    def crc(self, ids: memoryview, start: int, length: int) -> int:
        return zlib.crc32(ids[4 * start : 4 * (start + length)])

    def add(self, doc_id: int, data: bytes) -> Iterator[tuple]:
        ids, n = memoryview(data), len(data) // 4
        full = n - n % self.capacity
        for start in range(0, full, self.capacity):
            yield doc_id, start, self.capacity, self.crc(ids, start, self.capacity), n, self.next, 0
            self.next += 1
        if n > full:
            self.items.append((doc_id, full, n, memoryview(bytes(ids[4 * full :]))))
        self.held += n
        if self.held >= SCOPE_TOKENS:
            yield from self.flush()

    def flush(self) -> Iterator[tuple]:
        lengths = [len(x[3]) // 4 for x in self.items]
        windows = [[(i, 0, lengths[i]) for i in w] for w in best_fit(lengths, self.capacity)]
        for window in filled(windows, self.capacity):
            offset = 0
            for item, start, length in window:
                doc_id, before, n, ids = self.items[item]
                yield doc_id, before + start, length, self.crc(ids, start, length), n, self.next, offset
                offset += length
            self.next += 1
        self.items, self.held = [], 0


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of a document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``tokenizer``: file of a lower-casing BPE with word ends, the same on all
    executors. A document is its ids and ``end_id``; each id lies in one piece,
    and a sequence's pieces follow each other from offset 0. Sequences have
    ``capacity`` ids or, a few per task, a smaller power of two of them, so
    none is padded. Null and empty texts are their end alone. Repeated rows and
    rows of one id, null ids too, are packed each for itself; an empty table
    gives no rows; other columns do not matter. A very long text is held once
    as ids. Sequences never mix documents of two input partitions; numbers are
    unique, and gapless within a partition.
    """
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, packer = WordIds(path), Packer(capacity, TaskContext.get().partitionId() << SEQUENCE_BITS)

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    yield from packer.add(doc_id, words.ids(text.as_py()) + end)
            yield from packer.flush()

        yield from rows_out(PIECES_ARROW, rows())

    return texts(docs, id_col=id_col, text_col=text_col).mapInArrow(run, PIECES)
