"""MinHash near-deduplication by fast similarity sketching.

A set's sketch has ``bands * rows`` coordinates. In round ``i`` every element
is thrown by a fresh hash into one coordinate and may take it if no earlier
round did; rounds ``t .. 2t-1`` throw every element into coordinate ``i - t``,
so that every coordinate is filled, while the expected work is
O(size + t log t). Coordinates agree with probability Jaccard and concentrate
as independent ones do. Bands of coordinates give candidate buckets, and each
candidate is confirmed on its full shingle sets.

Equal sets are one class from the start. A bucket never emits all its pairs:
first each class meets the bucket's hub. What is left are buckets that hold
several components. Their classes are joined on prefixes: of a set's shingles
in one global order, rare ones first, two sets at the threshold share one among
their first size - ceil(threshold * size) + 1. So classes that can have no link
meet nobody, however large their bucket. How late in a prefix the shingle comes
bounds the size of a partner, so the smaller of two linked sets has it early; late
rows that no early one is small enough for are left out. Shingles that join
several components are swept, by random pivots first if there are many pairs, until
no untested pair across components is left; no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarlake.llm.blocks import Blocks, packed, split
from scholarlake.llm.components import components, merged
from scholarlake.llm.tools import checkpointed, discard, signed, texts
from scholarlake.llm.words import BASE, MASK, U, Words, distinct, mix, salted, slices, windows

#: At similarity 0.8 a pair is missed by all bands with probability 1.3e-7.
BANDS, BAND_ROWS = 40, 5
#: Ids that may be broadcast; pairs a document that are swept without pivots.
BROADCAST_IDS, SWEEP_PAIRS = 1 << 20, 4


def shingle_sets(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all texts, offsets per text).

    A text of fewer than ``width`` words gives its whole sequence as one shingle; none gives none.
    """
    sets = []
    hashes, inside = windows(words.hash, words.first, width)
    for i in range(len(words.count)):
        lo, hi = words.first[i], words.first[i + 1]
        if hi - lo >= width:
            sets.append(distinct(hashes[lo : hi - width + 1]))
        elif hi > lo:
            total = int(hi - lo)
            for h in words.hash[lo:hi].tolist():
                total = (total * BASE + h) & MASK
            sets.append(mix(np.array([total], U)))
        else:
            sets.append(np.zeros(0, U))
    offsets = np.zeros(len(sets) + 1, np.int64)
    np.cumsum([len(s) for s in sets], out=offsets[1:])
    return (np.concatenate(sets) if sets else np.zeros(0, U)), offsets


def sketches(elements: np.ndarray, offsets: np.ndarray, t: int) -> np.ndarray:
    """Fast similarity sketches, one row of ``t`` coordinates for every non-empty set (others stay at the maximum)."""
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    out = np.full(n * t, np.iinfo(np.uint64).max, U)
    owner = np.repeat(np.arange(n, dtype=np.int64), sizes)
    left = elements
    for i in range(2 * t):
        if not len(left):
            break
        h = salted(left, 1000 + i)
        coordinate = (h >> U(32)) % U(t) if i < t else np.full(len(left), i - t, U)
        # The round is the upper part of a value: a coordinate filled in an earlier round stays.
        np.minimum.at(out, owner * t + coordinate.astype(np.int64), (U(i) << U(54)) | (mix(h) >> U(10)))
        if i & 3 == 3 or i < 4 or i >= t:
            open_ = (out.reshape(n, t) == np.iinfo(np.uint64).max).any(axis=1)
            keep = open_[owner]
            if not keep.all():
                left, owner = left[keep], owner[keep]
    return out.reshape(n, t)


SKETCH = "doc_id long, n long, d1 long, d2 long, bands array<long>"
SKETCH_ARROW = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("bands", pa.list_(pa.int64()))])


def sketched(docs: DataFrame, width: int, bands: int = BANDS, rows: int = BAND_ROWS) -> DataFrame:
    """(doc_id, n: set size, d1, d2: digest of the set, bands: bucket of each band)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                elements, offsets = shingle_sets(Words(part.column(1), lower=True), width)
                n = np.diff(offsets)
                full = n > 0
                digests = [np.zeros(len(n), U) for _ in range(2)]
                if len(elements):
                    for k in range(2):
                        digests[k][full] = mix(np.add.reduceat(salted(elements, 50 + k), offsets[:-1][full]) + n[full].astype(U))
                s = sketches(elements, offsets, bands * rows).reshape(len(n), bands, rows)
                h = np.zeros((len(n), bands), U)
                for r in range(rows):
                    h = mix(h * U(0x9E3779B97F4A7C15) + s[:, :, r])
                h = salted(h.ravel(), 9) + np.tile(salted(np.arange(bands, dtype=U), 3), len(n))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * bands), pa.array(signed(h)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(signed(digests[0])), pa.array(signed(digests[1])), lists], schema=SKETCH_ARROW)

    return docs.mapInArrow(run, SKETCH)


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, s: distinct shingle hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                elements, offsets = shingle_sets(Words(part.column(1), lower=True), width)
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(signed(elements)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["doc_id", "s"])

    return docs.mapInArrow(run, "doc_id long, s array<long>")


def only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id is in ``ids``: broadcast where their number is small, else joined."""
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those (a, b) whose full sets reach the threshold."""
    with_a = pairs.select("a", "b").join(sets.select(F.col("doc_id").alias("a"), F.col("s").alias("sa")), "a")
    with_b = with_a.join(sets.select(F.col("doc_id").alias("b"), F.col("s").alias("sb")), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    return with_b.filter(100 * both >= percent * (F.size("sa") + F.size("sb") - both)).select("a", "b")


def prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(bucket, rep, n, cap, root): a row for each shingle of a set's prefix that sets of another component hold too.

    ``sets`` has doc_id, s and root, the component so far. Shingles are ordered
    by the number of sets that hold them, looked up by blocks of sets (see
    ``blocks``), then by value. At their first common shingle two sets have no
    more in common than it and what follows in the shorter rest: ``cap`` is the
    size up to which a set can reach the threshold there. A shingle that only one
    component holds can link nothing new and makes no row.
    """
    blocks = Blocks(sets)
    bucket_of = lambda key: ((key >> U(32)) % U(blocks_n)).astype(np.int64)
    blocks_n = blocks.n

    def values(table: pa.Table) -> np.ndarray:
        return np.asarray(table.column("s").combine_chunks().flatten()).view(U)

    def ask(table: pa.Table) -> Iterator[tuple[int, bytes]]:
        v = values(table)
        root = np.repeat(table.column("root").to_numpy(), np.diff(np.asarray(table.column("s").combine_chunks().offsets)))
        order = np.argsort(v)
        v, root = v[order], root[order]
        cut = np.flatnonzero(np.append(True, v[1:] != v[:-1])) if len(v) else np.zeros(0, int)
        ends = (np.minimum.reduceat(root, cut), np.maximum.reduceat(root, cut)) if len(v) else (root, root)
        for b, columns, _ in split(bucket_of(v[cut]), v[cut], np.diff(cut, append=len(v)).astype(np.uint32), *ends):
            yield b, packed(*columns)

    def answer(payloads: list[list[np.ndarray]]) -> Iterator[tuple]:
        key, count, lo, hi = (np.concatenate(p) for p in zip(*payloads))
        order = np.argsort(key)
        cut = np.flatnonzero(np.append(True, np.diff(key[order]) != 0))
        which = np.empty(len(key), np.int64)
        which[order] = np.repeat(np.arange(len(cut)), np.diff(cut, append=len(key)))
        total = np.add.reduceat(count[order], cut, dtype=np.int64)
        mixed = np.minimum.reduceat(lo[order], cut) != np.maximum.reduceat(hi[order], cut)
        at = 0
        for p in payloads:
            mine = which[at : at + len(p[0])]
            yield total[mine], mixed[mine]
            at += len(p[0])

    def finish(table: pa.Table, answers: dict) -> pa.Table:
        v = values(table)
        key = distinct(v)
        held, mixed = np.zeros(len(key), np.int64), np.zeros(len(key), bool)
        for b, _, rows in split(bucket_of(key), key):
            held[rows], mixed[rows] = answers[1][b]
        at = np.searchsorted(key, v)
        held, mixed = held[at], mixed[at]
        sizes = np.diff(np.asarray(table.column("s").combine_chunks().offsets))
        ends = np.cumsum(sizes)
        out = [([], [], [], [], [])]
        for doc_id, root, n, end in zip(table.column("doc_id").to_pylist(), table.column("root").to_pylist(), sizes.tolist(), ends.tolist()):
            own, freq = v[end - n : end], held[end - n : end]
            order = np.lexsort((own, freq))[: n - (percent * n + 99) // 100 + 1]
            place = np.flatnonzero(mixed[end - n : end][order])
            cap = ((100 + percent) * (n - place) - percent * n) // percent
            out.append((own[order[place]], *(np.full(len(place), x) for x in (doc_id, n)), cap, np.full(len(place), root)))
        bucket, rep, n, cap, root = (np.concatenate([np.asarray(o[i], np.int64 if i else U) for o in out]) for i in range(5))
        return pa.table([signed(bucket), rep, n, cap, root], schema=PREFIX_ARROW)

    answered = blocks.answer(blocks.ask(ask, 1), answer, 1)
    return blocks.finish(answered, finish, "bucket long, rep long, n long, cap long, root long", PREFIX_ARROW)


PREFIX_ARROW = pa.schema([(c, pa.int64()) for c in ("bucket", "rep", "n", "cap", "root")])


def linkable(placed: DataFrame) -> DataFrame:
    """Rows of ``placed(bucket, rep, n, cap, root)`` that may still link components: in buckets with several, without late rows (cap < n) that no early row is small enough for.

    Of two sets that may be linked the smaller, or either of equal ones, is early.
    """
    least = F.min(F.when(F.col("cap") >= F.col("n"), F.col("n"))).alias("least")
    mixed = placed.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), least).filter("lo != hi").select("bucket", "least")
    return placed.join(mixed, "bucket").filter("cap >= n OR cap >= least").select("bucket", "rep", "n", "cap", "root")


def unsettled(cells: DataFrame, roots: DataFrame | None) -> DataFrame:
    """The linkable rows of ``cells(bucket, rep, n, cap)``, with their component ``root``."""
    cells = cells.select("bucket", "rep", "n", "cap")
    if roots is None:
        placed = cells.withColumn("root", F.col("rep"))
    else:
        placed = cells.join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    placed = checkpointed(placed.select("bucket", "rep", "n", "cap", "root"))
    out = checkpointed(linkable(placed))
    discard(placed)
    return out


def sweep(left: DataFrame, roots: DataFrame | None, sets: DataFrame, percent: int, limit: int) -> DataFrame | None:
    """Components after all pairs across components that share a bucket of ``left`` are tested.

    A pair has an early row (see `linkable`). Where pairs are more than
    ``limit``, random early pivots of the buckets are tested first, ever more of
    them, for links found shrink what is left. Each turn reads only the rows
    that the turn before left unsettled.
    """
    spread = 8
    early = F.col("cap") >= F.col("n")
    while True:
        own = left.groupBy("bucket", "root").agg(F.count_if(early).alias("e"), F.count("*").alias("c"))
        same = own.groupBy("bucket").agg(F.sum("e").alias("e"), F.sum("c").alias("c"), F.sum(F.col("e") * (F.col("c") - F.col("e") / 2)).alias("own"))
        total, biggest = same.agg(F.sum(F.col("e") * (F.col("c") - F.col("e") / 2) - F.col("own")), F.max("e")).first()
        if not total:
            discard(left)
            return roots
        every = total <= limit or spread >= biggest
        pivots = left.filter(early)
        if not every:
            m = pivots.groupBy("bucket").agg(F.count("*").alias("m"))
            chance = F.pmod(F.xxhash64("rep", "bucket", F.lit(spread)), F.lit(1 << 20)) * F.col("m") < F.lit(spread << 20)
            pivots = pivots.join(m, "bucket").filter(chance)
        pivots = pivots.select("bucket", F.col("rep").alias("p"), F.col("n").alias("p_n"), F.col("cap").alias("p_cap"), F.col("root").alias("p_root"))
        cross = left.join(pivots, "bucket").filter("root != p_root AND n <= p_cap AND p_n <= cap" + (" AND (rep < p OR cap < n)" if every else ""))
        cross = checkpointed(cross.select(F.least("rep", "p").alias("a"), F.greatest("rep", "p").alias("b")).distinct())
        more = checkpointed(confirmed(cross, sets, percent))
        if not more.isEmpty():
            roots = merged(roots, more)
        discard(cross, more)
        if every:
            discard(left)
            return roots
        rest = unsettled(left, roots)
        discard(left)
        left, spread = rest, spread * 16


def rank(column: str):
    """A fixed random order of classes: a hub is the same class in all buckets of a cluster."""
    return F.struct(F.xxhash64(F.col(column)).alias("h"), F.col(column).alias("c"))


def near_dedup(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = BAND_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Shingles are runs of ``width`` words, A-Z lower-cased. Documents with
    100 * common >= ``percent`` * union shingles are linked; ``component_id``
    is the smallest id reachable. An empty or null text has no shingle and is
    linked with nothing. Rows with a null id come back with a null component
    and are kept. Rows that repeat an id must repeat its text. Only the id and
    text columns are read.
    """
    docs = texts(docs, id_col=id_col, text_col=text_col)
    members = checkpointed(sketched(docs, width, bands, rows))
    first = F.min(F.struct("doc_id", "n", "bands"))
    classes = checkpointed(members.filter("n > 0 and doc_id is not null").groupBy("d1", "d2").agg(first.alias("r")).select("d1", "d2", "r.*"))
    light = members.select("doc_id", "n", "d1", "d2")

    cells = classes.select(F.col("doc_id").alias("rep"), "n", F.explode("bands").alias("bucket"))
    hubs = cells.groupBy("bucket").agg(F.min(F.struct(rank("rep").alias("k"), "n")).alias("hub"), F.count("*").alias("m")).filter("m > 1")
    cells = checkpointed(cells.join(hubs.select("bucket", F.col("hub.k.c").alias("hub"), F.col("hub.n").alias("hub_n"), "m"), "bucket"))
    # Classes that share a bucket: their full sets are made once.
    sets = checkpointed(full_sets(only(docs, cells.select(F.col("rep").alias("doc_id")).distinct()), width).dropDuplicates(["doc_id"]))
    close = 100 * F.least("n", "hub_n") >= percent * F.greatest("n", "hub_n")
    pairs = checkpointed(cells.filter("rep != hub").filter(close).select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b")).distinct())
    links = checkpointed(confirmed(pairs, sets, percent))
    roots = None if links.isEmpty() else components(links)
    left = unsettled(cells.filter("m > 2").select("bucket", "rep", "n", F.floor(F.col("n") * 100 / percent).alias("cap")), roots)
    if not left.isEmpty():
        some = checkpointed(sets.join(left.select(F.col("rep").alias("doc_id"), "root").distinct(), "doc_id"))
        rare = checkpointed(prefixes(some, percent))
        roots = sweep(checkpointed(linkable(rare)), roots, some.select("doc_id", "s"), percent, SWEEP_PAIRS * max(members.count(), 1 << 16))
        discard(some, rare)
    discard(left, cells, sets, pairs, links)

    if roots is None:
        named = classes.select("d1", "d2", F.col("doc_id").alias("component_id"))
    else:
        least = roots.groupBy("root").agg(F.min("node").alias("component_id"))
        of = roots.join(least, "root").select(F.col("node").alias("doc_id"), "component_id")
        named = classes.join(of, "doc_id", "left").select("d1", "d2", F.coalesce("component_id", "doc_id").alias("component_id"))
    placed = light.hint("merge").join(named, ["d1", "d2"], "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return placed.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), component).alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """``docs`` with one document of each component, the one of smallest id; all columns stay."""
    gone = near_dedup(docs, id_col=id_col, text_col=text_col, **params).filter("not kept").select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(gone, id_col, "left_anti")
