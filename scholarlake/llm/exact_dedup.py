"""Exact deduplication by Grace hashing.

Every map task first folds its own equal texts; one row per distinct text and
task is then shuffled by digest, so a group of copies sends at most one row
per input partition. Each reduce task runs the same table again: an
open-addressing hash table that compares complete content. A table that
outgrows its budget freezes: texts it holds still fold in, all others go to
``fanout`` spill files by another hash of the digest, and each file is worked
on the same way, one level deeper, until a bucket fits.
"""

from __future__ import annotations

import hashlib
import pickle
import struct
import tempfile
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarlake.llm.tools import rows_out, texts

#: Characters that do not count: space and U+0009 to U+000D.
IGNORED = b" \t\n\x0b\x0c\r"
TABLE_BYTES = 48 << 20
FANOUT = 16
MAX_LEVEL = 12


class GraceTable:
    """Folds (digest, content, best_len, best_id, count) rows with equal content.

    ``best``: most code points, then smallest id; a null id is never preferred.
    ``hasher(digest, level)`` gives 64 bits; the default re-hashes for every
    level. Two contents with one digest raise, for the digest names the group.
    """

    def __init__(self, budget: int = TABLE_BYTES, fanout: int = FANOUT, level: int = 0, hasher=None):
        self.budget, self.fanout, self.level = budget, fanout, level
        self.hasher = hasher or self.hashed
        self.slots, self.mask = array("q", [-1]) * 1024, 1023
        self.keys: list[int] = []
        self.rows: list[list] = []
        self.held, self.spill, self.folder = 0, None, None
        self.spilled = 0

    @staticmethod
    def hashed(digest: bytes, level: int) -> int:
        return struct.unpack("<Q", hashlib.blake2b(digest, digest_size=8, salt=struct.pack("<Q", level)).digest())[0]

    def add(self, digest: bytes, content: bytes, length: int, doc_id: int | None, count: int) -> None:
        key = self.hasher(digest, self.level)
        at = key & self.mask
        while (found := self.slots[at]) >= 0:
            if self.keys[found] == key:
                row = self.rows[found]
                if row[1] == content:
                    if length > row[2] or length == row[2] and doc_id is not None and (row[3] is None or doc_id < row[3]):
                        row[2], row[3] = length, doc_id
                    row[4] += count
                    return
                if row[0] == digest:
                    raise ValueError(f"two contents share the digest {digest.hex()}")
            at = (at + 1) & self.mask
        if self.spill is None and self.held + len(content) > self.budget and self.rows and self.level < MAX_LEVEL:
            self.folder = tempfile.TemporaryDirectory(prefix="grace-")
            self.spill = [open(f"{self.folder.name}/{i}", "wb") for i in range(self.fanout)]
        if self.spill is not None:
            pickle.dump((digest, content, length, doc_id, count), self.spill[(key >> 32) % self.fanout], protocol=5)
            self.spilled += 1
            return
        self.slots[at] = len(self.rows)
        self.keys.append(key)
        self.rows.append([digest, content, length, doc_id, count])
        self.held += len(content) + 200
        if len(self.rows) * 2 > self.mask:
            self.grow()

    def grow(self) -> None:
        self.mask = self.mask * 2 + 1
        self.slots = array("q", [-1]) * (self.mask + 1)
        for i, key in enumerate(self.keys):
            at = key & self.mask
            while self.slots[at] >= 0:
                at = (at + 1) & self.mask
            self.slots[at] = i

    def drain(self) -> Iterator[tuple]:
        """All folded rows; spill files are worked off one by one and then removed."""
        try:
            yield from map(tuple, self.rows)
            self.rows, self.keys, self.slots = [], [], array("q")
            for i, file in enumerate(self.spill or ()):
                file.close()
                deeper = GraceTable(self.budget, self.fanout, self.level + 1, self.hasher)
                try:
                    with open(f"{self.folder.name}/{i}", "rb") as f:
                        while True:
                            try:
                                row = pickle.load(f)
                            except EOFError:
                                break
                            deeper.add(*row)
                    yield from deeper.drain()
                finally:
                    deeper.close()
        finally:
            self.close()

    def close(self) -> None:
        for file in self.spill or ():
            file.close()
        if self.folder is not None:
            self.folder.cleanup()
            self.folder = None


FOLDED = "digest binary, content binary, best_len long, best_id long, n long"
FOLDED_ARROW = pa.schema([("digest", pa.binary()), ("content", pa.binary()), ("best_len", pa.int64()), ("best_id", pa.int64()), ("n", pa.int64())])
CLASSES_ARROW = pa.schema([("digest", pa.binary()), ("keep_id", pa.int64()), ("group_size", pa.int64())])
MEMBERS_ARROW = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary())])


def normalised(text: str) -> bytes:
    return text.encode("utf-8").translate(None, IGNORED)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table_bytes: int = TABLE_BYTES, fanout: int = FANOUT) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without white space; the longest original
    (code points) stays, then the smallest id. A null text is empty; empty
    texts form one group. Of texts of one length a null id comes last; where it
    is the longest, it stays and keep_id is null. Rows that repeat an id and text
    are the same document and get the same decision; other columns are not read.
    """
    docs = texts(docs, id_col=id_col, text_col=text_col)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = GraceTable(table_bytes, fanout)
        try:
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    text = text.as_py()
                    content = normalised(text)
                    table.add(hashlib.sha256(content).digest(), content, len(text), doc_id, 1)
            yield from rows_out(FOLDED_ARROW, table.drain(), size=lambda row: len(row[1]))
        finally:
            table.close()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = GraceTable(table_bytes, fanout)
        try:
            for batch in batches:
                for row in zip(*(batch.column(i) for i in range(5))):
                    table.add(*(x.as_py() for x in row))
            yield from rows_out(CLASSES_ARROW, ((row[0], row[3], row[4]) for row in table.drain()))
        finally:
            table.close()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [hashlib.sha256(normalised(t.as_py())).digest() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], schema=MEMBERS_ARROW)

    classes = docs.mapInArrow(fold, FOLDED).repartition("digest").mapInArrow(merge, "digest binary, keep_id long, group_size long")
    members = docs.mapInArrow(digests, "doc_id long, digest binary")
    # A hot group's members meet one class row; adaptive execution splits such a partition.
    return members.hint("merge").join(classes, "digest").select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """``docs`` without the rows that ``exact_dedup`` does not keep; all columns stay, whatever their names.

    Rows that repeat the id and text of a kept document are that document and
    stay; a null id is an id like others.
    """
    gone = exact_dedup(docs, id_col, text_col, **params).filter("not kept").select(F.col("doc_id").alias("id"), "text_sha256").distinct()
    key = F.sha2(F.regexp_replace(F.coalesce(F.col(f"row.{text_col}"), F.lit("")), r"[\x20\x09-\x0D]+", "").cast("binary"), 256)
    # All columns travel in one struct, so that no name of theirs can clash with the join's.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    left = rows.join(gone, F.col(f"row.{id_col}").eqNullSafe(F.col("id")) & (key == F.col("text_sha256")), "left_anti")
    return left.select("row.*")
