"""Look-ups of hashed keys for whole texts, by blocks of documents.

Rows per occurrence would swamp a shuffle. Here documents are dealt into
blocks by a hash of their id; a block *asks* about its distinct keys with one
packed array per bucket of the key space, each bucket *answers* all blocks
with packed arrays, and a block reads its answers beside its texts. A key asks
at most once per block, so a frequent key costs no more than the number of
blocks; equal exchanges of the texts are reused within a job.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarlake.llm.tools import n_parts
from scholarlake.llm.words import U

#: Beyond so many blocks a literal of their numbers would weigh on the plan; their places are numbers even enough then.
LITERAL_IDS = 20_000
#: Step number of a row that carries a block's earlier answers.
CARRIED = 0
ASKED = "bucket int, block int, step int, payload binary"
ASKED_ARROW = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("step", pa.int32()), ("payload", pa.binary())])


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes: a count, then dtype, length and data of each."""
    out = io.BytesIO()
    out.write(np.int64(len(arrays)).tobytes())
    for a in arrays:
        a = np.ascontiguousarray(a)
        out.write(a.dtype.str.encode().ljust(8))
        out.write(np.int64(len(a)).tobytes())
        out.write(a.tobytes())
    return out.getvalue()


def unpacked(data: bytes) -> list[np.ndarray]:
    view = memoryview(data)
    n, at, out = int(np.frombuffer(view[:8], np.int64)[0]), 8, []
    for _ in range(n):
        kind = np.dtype(bytes(view[at : at + 8]).decode().strip())
        size = int(np.frombuffer(view[at + 8 : at + 16], np.int64)[0])
        at += 16
        out.append(np.frombuffer(view[at : at + size * kind.itemsize], kind))
        at += size * kind.itemsize
    return out


def partition_of(ids: np.ndarray, parts: int) -> np.ndarray:
    """The partition that Spark's hash partitioning deals an int to: Murmur3 of one word, seed 42."""
    u = np.uint32
    k = ids.astype(u) * u(0xCC9E2D51)
    k = ((k << u(15)) | (k >> u(17))) * u(0x1B873593)
    h = u(42) ^ k
    h = ((h << u(13)) | (h >> u(19))) * u(5) + u(0xE6546B64)
    h = h ^ u(4)
    h = (h ^ (h >> u(16))) * u(0x85EBCA6B)
    h = (h ^ (h >> u(13))) * u(0xC2B2AE35)
    h = h ^ (h >> u(16))
    return np.mod(h.view(np.int32).astype(np.int64), parts)


def even_ids(parts: int) -> np.ndarray:
    """One int for each partition, so that as many blocks are dealt one to a partition."""
    out, at = np.full(parts, -1, np.int32), 0
    while (out < 0).any():
        ids = np.arange(at, at + 4 * parts, dtype=np.int32)
        where, first = np.unique(partition_of(ids, parts), return_index=True)
        new = out[where] < 0
        out[where[new]] = ids[first[new]]
        at += 4 * parts
    return out


class Blocks:
    """The documents (doc_id, text, ...) in as many blocks as there are shuffle partitions, and as many buckets of keys."""

    def __init__(self, docs: DataFrame):
        self.parts = self.n = n_parts(docs.sparkSession)
        #: Block and bucket numbers as rows carry them, by place; all steps translate by this one table.
        self.ids = even_ids(self.parts) if self.n <= LITERAL_IDS else np.arange(self.n, dtype=np.int32)
        number = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(self.n)).cast("int")
        block = F.lit(self.ids.tolist()).cast("array<int>")[number] if self.n <= LITERAL_IDS else number
        self.texts = docs.withColumn("block", block).repartition(self.parts, "block")

    def ask(self, run: Callable[[pa.Table], Iterator[tuple[int, bytes]]], step: int, answers: DataFrame | None = None) -> DataFrame:
        """``run(texts[, answers by step])`` yields (bucket, payload) for one block; earlier answers travel on."""
        ids = self.ids
        back = {int(x): i for i, x in enumerate(ids)}
        rows = lambda table, made: asked_rows(table, made, step, ids)
        if answers is None:
            return self.texts.groupBy("block").applyInArrow(lambda table: rows(table, run(table)), ASKED)

        def later(table: pa.Table, found: pa.Table) -> pa.Table:
            made = rows(table, run(table, by_step(found, back)) if table.num_rows else ())
            return pa.concat_tables([made, carried(found)])

        return self.texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(later, ASKED)

    def answer(self, asked: DataFrame, run: Callable[[list[list[np.ndarray]]], Iterator[tuple]], step: int) -> DataFrame:
        """``run(payloads)`` yields the arrays (or None) that answer each payload of one bucket; rows of other steps pass."""

        def bucket(table: pa.Table) -> pa.Table:
            steps = np.array(table.column("step").to_pylist())
            mine = table.take(pa.array(np.flatnonzero(steps == step)))
            others = table.take(pa.array(np.flatnonzero(steps != step))).select(ASKED_ARROW.names).cast(ASKED_ARROW)
            if not mine.num_rows:
                return others
            made = [None if a is None else packed(*a) for a in run([unpacked(x.as_py()) for x in mine.column("payload")])]
            keep = pa.array([i for i, a in enumerate(made) if a is not None], pa.int64())
            columns = [mine.column(c).take(keep).combine_chunks() for c in ("bucket", "block", "step")]
            return pa.concat_tables([pa.table([*columns, pa.array([a for a in made if a is not None], pa.binary())], schema=ASKED_ARROW), others])

        return asked.repartition(self.parts, "bucket").groupBy("bucket").applyInArrow(bucket, ASKED)

    def at_source(self, asked: DataFrame, run: Callable[[pa.Table, list[list[np.ndarray]]], Iterator[tuple]], step: int) -> DataFrame:
        """``run(texts, payloads)`` yields the arrays that answer what a step asked of this block's texts; rows of other steps pass."""

        def one(table: pa.Table, found: pa.Table) -> pa.Table:
            steps = found.column("step").to_numpy()
            mine, others = (found.filter(pa.array(steps == step)), found.filter(pa.array(steps != step)).select(ASKED_ARROW.names).cast(ASKED_ARROW))
            if not mine.num_rows:
                return others
            made = [packed(*a) for a in run(table, [unpacked(x.as_py()) for x in mine.column("payload")])]
            columns = [mine.column(c).combine_chunks() for c in ("bucket", "block", "step")]
            return pa.concat_tables([pa.table([*columns, pa.array(made, pa.binary())], schema=ASKED_ARROW), others])

        return self.texts.groupBy("block").cogroup(asked.groupBy("bucket")).applyInArrow(one, ASKED)

    def finish(self, answers: DataFrame, run: Callable[[pa.Table, dict], pa.Table], schema: str, empty: pa.Schema) -> DataFrame:
        """``run(texts, answers by step)`` makes the result rows of one block."""

        back = {int(x): i for i, x in enumerate(self.ids)}

        def one(table: pa.Table, found: pa.Table) -> pa.Table:
            return run(table, by_step(found, back)) if table.num_rows else empty.empty_table()

        return self.texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(one, schema)


def place_among(ids: np.ndarray, table: pa.Table) -> int:
    """A block's place among all ``ids``, by which `Blocks.ask` calls its buckets too."""
    return int(np.flatnonzero(ids == table.column("block")[0].as_py())[0])


def carried(found: pa.Table) -> pa.Table:
    """A block's answers so far as one row, which travels by the block's own number."""
    if not found.num_rows:
        return ASKED_ARROW.empty_table()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, ASKED_ARROW) as writer:
        writer.write_table(found.select(ASKED_ARROW.names).cast(ASKED_ARROW))
    block = found.column("block")[0].as_py()
    return pa.table([[block], [block], [CARRIED], [sink.getvalue().to_pybytes()]], schema=ASKED_ARROW)


def asked_rows(table: pa.Table, made, step: int, ids: np.ndarray) -> pa.Table:
    made = list(made)
    block = table.column("block")[0].as_py() if table.num_rows else 0
    return pa.table([pa.array([int(ids[b]) for b, _ in made], pa.int32()), pa.array([block] * len(made), pa.int32()), pa.array([step] * len(made), pa.int32()), pa.array([p for _, p in made], pa.binary())], schema=ASKED_ARROW)


def by_step(found: pa.Table, back: dict[int, int]) -> dict[int, dict[int, list[np.ndarray]]]:
    """{step: {bucket: arrays}} of a block's answers."""
    out: dict[int, dict[int, list[np.ndarray]]] = {}
    for payload in found.column("payload").filter(pa.compute.equal(found.column("step"), CARRIED)):
        out |= by_step(pa.ipc.open_stream(payload.as_py()).read_all(), back)
    found = found.filter(pa.compute.not_equal(found.column("step"), CARRIED))
    for bucket, step, payload in zip(found.column("bucket").to_pylist(), found.column("step").to_pylist(), found.column("payload")):
        out.setdefault(step, {})[back[bucket]] = unpacked(payload.as_py())
    return out


def split(bucket: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, tuple[np.ndarray, ...], np.ndarray]]:
    """(bucket, its part of the columns, its row numbers), rows in their order."""
    order = np.argsort(bucket, kind="stable")
    cut = np.flatnonzero(np.diff(bucket[order])) + 1
    for rows in np.split(order, cut) if len(order) else ():
        yield int(bucket[rows[0]]), tuple(c[rows] for c in columns), rows


def text_batch(table: pa.Table) -> pa.RecordBatch:
    """The block's (doc_id, text) as one batch with 64-bit offsets."""
    table = table.select(["doc_id", "text"])
    return table.set_column(1, "text", table.column(1).cast(pa.large_string())).combine_chunks().to_batches()[0]
