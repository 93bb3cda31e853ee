"""Benchmark decontamination by greedy string tiling.

Texts are runs of letters and digits, A-Z lower-cased. Every run of
``min_match`` tokens of an item is a seed, found in documents by its
Karp-Rabin hash. Only (document, item) pairs whose shared seeds could cover
enough of the item are tiled: the longest match of unmarked tokens is marked
in both texts, again and again, until none of ``min_match`` tokens is left, so
that a reordered passage counts by its parts. A document is contaminated if
the tiles cover at least ``coverage`` of some item's tokens. An item of fewer
than ``min_match`` tokens has no seed: it counts where it occurs whole.

The benchmark is joined in blocks of bounded size, one after the other in the
same pass over the documents; the best item so far travels with each row, so
the rows are the same for any number of blocks.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarlake.llm.tools import checkpointed, texts
from scholarlake.llm.words import Words, slices, windows

MIN_MATCH = 5
COVERAGE = 0.8
#: Bytes of benchmark text that are broadcast at a time, and blocks that one pass over the documents joins.
BLOCK_BYTES, PASS_BLOCKS = 16 << 20, 4
#: (Document, item, place) rows that a join of seeds holds at a time; one document may take more.
JOIN_ROWS = 1 << 20
BEST = "item_id long, coverage double, n_tiles long, tile_words long"


def tiles(pattern: np.ndarray, text: np.ndarray, min_match: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (start in pattern, start in text, length), longest first.

    Seeds of ``min_match`` equal tokens are extended along their diagonal to
    maximal matches; a match that an earlier tile cuts falls back to its
    unmarked parts. Ties go to the earlier place in the pattern, then text.
    """
    if len(pattern) < min_match or len(text) < min_match:
        return []
    at: dict[bytes, list[int]] = {}
    for i in range(len(pattern) - min_match + 1):
        at.setdefault(pattern[i : i + min_match].tobytes(), []).append(i)
    diagonals: dict[int, list[int]] = {}
    for j in range(len(text) - min_match + 1):
        for i in at.get(text[j : j + min_match].tobytes(), ()):
            diagonals.setdefault(j - i, []).append(i)
    heap: list[tuple[int, int, int]] = []
    for d, starts in diagonals.items():
        first = last = starts[0]
        for i in [*starts[1:], -1]:
            if i != last + 1:
                heap.append((-(last - first + min_match), first, first + d))
                first = i
            last = i
    heapq.heapify(heap)
    used_p, used_t = np.zeros(len(pattern), bool), np.zeros(len(text), bool)
    out = []
    while heap:
        n, i, j = heapq.heappop(heap)
        n = -n
        taken = used_p[i : i + n] | used_t[j : j + n]
        if not taken.any():
            used_p[i : i + n] = used_t[j : j + n] = True
            out.append((i, j, n))
            continue
        free = np.flatnonzero(np.diff(np.concatenate([[1], taken, [1]]).astype(np.int8)))
        for lo, hi in zip(free[::2], free[1::2]):
            if hi - lo >= min_match:
                heapq.heappush(heap, (-int(hi - lo), i + int(lo), j + int(lo)))
    return out


class Items:
    """Seeds of a block of items: sorted hashes, and for each the item and the place; short items by their whole hash."""

    def __init__(self, ids: list[int], column: pa.Array, min_match: int):
        words = Words(column, lower=True, letters=True)
        self.ids, self.min_match = np.array(ids, np.int64), min_match
        self.tokens = [words.hash[words.first[i] : words.first[i + 1]] for i in range(len(ids))]
        self.size = words.count
        seeds, inside = windows(words.hash, words.first, min_match)
        where = np.flatnonzero(inside)
        seeds, doc = seeds[where], words.doc_of()[where]
        order = np.argsort(seeds, kind="stable")
        self.seeds, self.item, self.place = seeds[order], doc[order], (where - words.first[doc])[order]
        #: {tokens: (sorted hashes, their items)}; of items with the same tokens the one of smallest id.
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in range(1, min_match):
            some = np.flatnonzero(words.count == n)
            if len(some):
                some = some[np.argsort(self.ids[some], kind="stable")]
                whole, first = np.unique(windows(words.hash, words.first, n)[0][words.first[some]], return_index=True)
                self.short[n] = whole, some[first]

    def check(self, column: pa.Array, coverage: float) -> Iterator[tuple[int, int, float, int, int]]:
        """(text index, item index, coverage, tiles, tiled words) of pairs that reach ``coverage``."""
        words = Words(column, lower=True, letters=True)
        doc_of = words.doc_of()
        for n, (whole, item) in self.short.items():
            found, inside = windows(words.hash, words.first, n)
            at = np.minimum(np.searchsorted(whole, found), len(whole) - 1)
            hit = np.flatnonzero((whole[at] == found) & inside)
            for d, i in np.unique(np.stack([doc_of[hit], item[at[hit]]]), axis=1).T.tolist():
                yield d, i, 1.0, 1, n
        found, inside = windows(words.hash, words.first, self.min_match)
        if not len(found) or not len(self.seeds):
            return
        lo = np.searchsorted(self.seeds, found)
        hit = np.flatnonzero((self.seeds[np.minimum(lo, len(self.seeds) - 1)] == found) & inside)
        if not len(hit):
            return
        # A seed joins once a text, however often the text repeats it.
        doc, lo = np.unique(np.stack([doc_of[hit], lo[hit]]), axis=1)
        n = np.searchsorted(self.seeds, self.seeds[lo], side="right") - lo
        # As many texts at a time as a bounded join holds.
        turn = np.cumsum(n) // JOIN_ROWS
        cut = np.flatnonzero((np.diff(turn) > 0) & (np.diff(doc) > 0)) + 1
        cut = cut[np.append(True, np.diff(turn[cut]) > 0)] if len(cut) else cut
        for d, seed, k in zip(np.split(doc, cut), np.split(lo, cut), np.split(n, cut)):
            yield from self.tiled(words, d, seed, k, coverage)

    def tiled(self, words: Words, doc: np.ndarray, lo: np.ndarray, n: np.ndarray, coverage: float) -> Iterator[tuple[int, int, float, int, int]]:
        """Pairs of texts and items that share seeds (the ``n`` places from ``lo``), tiled where these can cover enough."""
        doc = np.repeat(doc, n)
        posting = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        # Distinct places of an item whose seed is in the text bound what tiles can cover.
        key = np.unique(np.stack([doc, self.item[posting], self.place[posting]]), axis=1)
        cut = np.flatnonzero(np.any(np.diff(key[:2], axis=1) != 0, axis=0)) + 1
        for start, end in zip([0, *cut], [*cut, key.shape[1]]):
            d, item = key[0, start], key[1, start]
            covered = np.minimum(np.diff(key[2, start:end]), self.min_match).sum() + self.min_match
            need = coverage * self.size[item]
            if covered >= need:
                made = tiles(self.tokens[item], words.hash[words.first[d] : words.first[d + 1]], self.min_match)
                total = sum(t[2] for t in made)
                if total >= need:
                    yield int(d), int(item), total / int(self.size[item]), len(made), total


def blocks(benchmark: DataFrame, limit: int) -> Iterator[Broadcast]:
    """The benchmark's (ids, texts) in broadcast blocks of about ``limit`` bytes, dealt by a hash of the id."""
    total = benchmark.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    n = max(1, math.ceil(2 * total / limit))
    for i in range(n):
        rows = benchmark.filter(F.pmod(F.xxhash64("doc_id"), F.lit(n)) == i).collect()
        yield benchmark.sparkSession.sparkContext.broadcast(([r.doc_id for r in rows], [r.text for r in rows]))


def contamination(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, contaminated, item_id, coverage, n_tiles, tile_words.

    ``item_id`` is the item of highest coverage (then smallest id) among those
    reached, null if none; coverage is then 0. Items of fewer than
    ``min_match`` tokens are reached where they occur whole; items without a
    token, null items and null ids of items match nothing. Null texts are
    empty. Only the named columns are read. Every row is reported, repeated
    ones too.
    """
    docs = texts(docs, id_col=id_col, text_col=text_col)
    items = texts(benchmark, id_col=item_col, text_col="text").filter("doc_id is not null")
    found = docs.withColumns({c: F.lit(None if c == "item_id" else 0).cast(kind) for c, kind in (x.split(" ") for x in BEST.split(", "))})
    parts = list(blocks(items, block_bytes))
    for turn, held in enumerate(parts):
        last = turn == len(parts) - 1

        def run(batches: Iterator[pa.RecordBatch], held=held, last=last) -> Iterator[pa.RecordBatch]:
            block = Items(held.value[0], pa.array(held.value[1], pa.string()), min_match)
            for batch in batches:
                for part in slices(batch):
                    best = {d: (-share, i, n, total) for d, (i, share, n, total) in enumerate(zip(*(part.column(c).to_pylist() for c in range(2, 6)))) if i is not None}
                    for d, item, share, n, total in block.check(part.column(1), coverage):
                        new = (-share, int(block.ids[item]), n, total)
                        best[d] = min(best.get(d, new), new)
                    hits = [best.get(d) for d in range(part.num_rows)]
                    made = [
                        pa.array([h and h[1] for h in hits], pa.int64()),
                        pa.array([-h[0] if h else 0.0 for h in hits], pa.float64()),
                        pa.array([h[2] if h else 0 for h in hits], pa.int64()),
                        pa.array([h[3] if h else 0 for h in hits], pa.int64()),
                    ]
                    kept = ["doc_id"] if last else ["doc_id", "text"]
                    yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(kept))), *made], names=[*kept, "item_id", "coverage", "n_tiles", "tile_words"])

        found = found.mapInArrow(run, f"doc_id long, {'' if last else 'text string, '}{BEST}")
        if not last and turn % PASS_BLOCKS == PASS_BLOCKS - 1:
            found = checkpointed(found)
    return found.select("doc_id", F.col("item_id").isNotNull().alias("contaminated"), "item_id", "coverage", "n_tiles", "tile_words")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, coverage: float = COVERAGE, text_col: str = "text", item_col: str = "item_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without contaminated documents; all columns stay, no shuffle. A null id or text is a row like others."""
    at, schema = docs.columns.index(text_col), docs.schema
    items = texts(benchmark, id_col=item_col, text_col="text").filter("doc_id is not null")
    for turn, held in enumerate(blocks(items, block_bytes)):
        if turn and turn % PASS_BLOCKS == 0:
            docs = checkpointed(docs)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            block = Items(held.value[0], pa.array(held.value[1], pa.string()), min_match)
            for batch in batches:
                for part in slices(batch, text_col):
                    keep = np.ones(part.num_rows, bool)
                    for hit in block.check(part.column(at), coverage):
                        keep[hit[0]] = False
                    yield part.filter(pa.array(keep))

        docs = docs.mapInArrow(run, schema)
    return docs
