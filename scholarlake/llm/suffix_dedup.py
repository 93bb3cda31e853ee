"""Suffix-array dedup of byte strings across documents.

A string of ``width`` bytes that also starts in a document of smaller id
covers its bytes. Documents are compared in buckets of minimizers (see
``paths``): equal strings have equal minimizers, so every bucket can sort its
suffixes on its own. Minimizers of a single document are dropped first, then
equal paths are held as one copy with its smallest document. The differing
copies of a minimizer's paths are the texts whose suffixes a bucket sorts, by
the difference-cover algorithm (sampled triples, recursion on their names,
merge of the rest); suffixes whose adjacent prefixes agree on ``width`` bytes
are equal strings, and the smallest document of each run is the source.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarlake.llm.blocks import Blocks, packed, split, text_batch
from scholarlake.llm.paths import Paths, Sums, least, spread
from scholarlake.llm.suffixes import prefix_groups, suffix_array
from scholarlake.llm.tools import texts
from scholarlake.llm.words import U, byte_values, distinct, raw_text, slices

WIDTH, SEED = 50, 24
OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<struct<start: long, end: long>>"
OUT_ARROW = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
#: Text that a bucket sorts at a time; more is dealt into runs by minimizer.
SORT_BYTES = 1 << 20


def seeds_of(data: np.ndarray) -> np.ndarray:
    """Hash of the ``SEED`` (24) bytes from every byte on."""
    n = len(data) - SEED + 1
    if n <= 0:
        return np.zeros(0, U)
    words = np.ndarray(len(data) - 7, dtype="<u8", buffer=np.ascontiguousarray(data), strides=(1,))
    out = words[:n] * U(0x9E3779B97F4A7C15)
    for k in range(8, SEED, 8):
        out ^= out >> U(29)
        out += words[k : k + n]
        out *= U(0xBF58476D1CE4E5B9)
    out ^= out >> U(32)
    out *= U(0x94D049BB133111EB)
    out ^= out >> U(29)
    return out


class Part:
    """Bytes and paths of a run of texts."""

    def __init__(self, batch: pa.RecordBatch, width: int):
        self.batch, self.ids = batch, batch.column(0).to_numpy(zero_copy_only=False)
        self.data, self.first = raw_text(batch.column(1))
        self.paths = Paths(seeds_of(self.data), self.first, width, SEED)
        self.owner = self.ids[self.paths.doc]

    def only(self, keep: np.ndarray) -> None:
        """Drop the other paths and hash these."""
        p = self.paths
        p.start, p.n, p.key, p.doc = p.start[keep], p.n[keep], p.key[keep], p.doc[keep]
        self.owner = self.owner[keep]
        sums = Sums(byte_values(3)[self.data]) if len(p.start) else None
        self.path = sums.hash(p.start, p.end(), 0) if sums else np.zeros(0, U)
        self.check = sums.hash(p.start, p.end(), 1).astype(np.uint32) if sums else np.zeros(0, np.uint32)


def parts_of(table: pa.Table, width: int) -> list[Part]:
    return [Part(batch, width) for batch in slices(text_batch(table))]


#: Bits of a minimizer that tell it apart in its bucket; two that agree there only keep a path too many.
BRIEF = U((1 << 40) - 1)


def brief(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows in the order of their low bits, steps between those): four bytes a key where it fits."""
    order = np.argsort(key & BRIEF, kind="stable")
    steps = np.diff(key[order] & BRIEF, prepend=U(0))
    return order, steps.astype(np.uint32) if steps.max(initial=0) < 1 << 32 else steps


def answer_seeds(payloads: list[list[np.ndarray]]) -> Iterator[tuple | None]:
    """For each block's (steps between distinct minimizers, several documents of the block have it): a bit for each that several documents have."""
    keys = np.concatenate([np.cumsum(p[0].astype(U)) for p in payloads])
    order = np.argsort(keys)
    sorted_keys = keys[order]
    first = np.append(True, sorted_keys[1:] != sorted_keys[:-1])
    group = np.cumsum(first) - 1
    within = np.concatenate([np.unpackbits(p[1])[: len(p[0])] for p in payloads]).astype(bool)
    many = (np.bincount(group) > 1) | (np.bincount(group, weights=within[order]) > 0)
    bits = np.empty(len(keys), bool)
    bits[order] = many[group]
    at = 0
    for p in payloads:
        own = bits[at : at + len(p[0])]
        at += len(p[0])
        yield (np.packbits(own),) if own.any() else None


def answer_copies(payloads: list[list[np.ndarray]]) -> Iterator[tuple | None]:
    """For each block's (path, low bits of its minimizer, smallest doc, check): bits of paths that a smaller document has, bits of paths that it leads and that branch, checks of the former."""
    path, key, doc, check = (np.concatenate([p[i] for p in payloads]) for i in range(4))
    order = np.lexsort((doc, path))
    new = np.append(True, path[order][1:] != path[order][:-1])
    group = np.cumsum(new) - 1
    lead = order[new]
    # Minimizers whose paths are led by different documents branch.
    by_key = np.argsort(key[lead], kind="stable")
    k, d = key[lead][by_key], doc[lead][by_key]
    cut = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
    mixed = np.minimum.reduceat(d, cut) != np.maximum.reduceat(d, cut)
    branches = np.empty(len(lead), bool)
    branches[by_key] = np.repeat(mixed, np.diff(cut, append=len(k)))
    of = np.empty(len(path), np.int64)
    of[order] = group
    covered = doc[lead][of] < doc
    led = branches[of] & ~covered
    source = check[lead][of]
    at = 0
    for p in payloads:
        rows = slice(at, at + len(p[0]))
        at += len(p[0])
        c, l = covered[rows], led[rows]
        yield (np.packbits(c), np.packbits(l), source[rows][c]) if c.any() or l.any() else None


def sort_strings(key: np.ndarray, doc: np.ndarray, size: np.ndarray, data: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(smallest document of the string at each window, windows in row order); a row has ``size`` bytes."""
    first = np.cumsum(size) - size
    windows = size - width + 1
    out = np.empty(int(windows.sum()), np.int64)
    to = np.cumsum(windows) - windows
    order = np.argsort(key, kind="stable")
    # Runs of whole minimizers of about SORT_BYTES.
    weight = np.cumsum(size[order]) // SORT_BYTES
    new = np.ones(len(order), bool)
    new[1:] = key[order][1:] != key[order][:-1]
    group_start = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    run = weight[group_start]
    for rows in np.split(order, np.flatnonzero(np.diff(run)) + 1) if len(order) else ():
        at, row = spread(first[rows], size[rows])
        # Symbols from 1; each row ends in a symbol of its own.
        text = np.zeros(len(at) + len(rows), np.int64)
        place = np.arange(len(at)) + row
        text[place] = data[at].astype(np.int64) + 1 + len(rows)
        ends = np.cumsum(size[rows] + 1) - 1
        text[ends] = np.arange(1, len(rows) + 1)
        starts = np.cumsum(size[rows] + 1) - (size[rows] + 1)
        window, of = spread(starts, windows[rows])
        where = np.full(len(text), -1)
        where[window] = np.arange(len(window))
        suffixes = suffix_array(text)
        suffixes = suffixes[where[suffixes] >= 0]
        group = prefix_groups(text, suffixes, width)
        source = doc[rows][of[where[suffixes]]]
        low = np.minimum.reduceat(source, np.flatnonzero(np.diff(group, prepend=-1)))[group] if len(group) else source
        found = np.empty(len(window), np.int64)
        found[where[suffixes]] = low
        back, _ = spread(to[rows], windows[rows])
        out[back] = found
    return out, to


def answer_strings(width: int):
    def run(payloads: list[list[np.ndarray]]) -> Iterator[tuple | None]:
        """For each block's (minimizer, doc, size, bytes): the smallest document of every window, where another is smaller."""
        key, doc, size, data = (np.concatenate([p[i] for p in payloads]) for i in range(4))
        low, to = sort_strings(key, doc, size.astype(np.int64), data, width)
        at = 0
        for p in payloads:
            n = len(p[0])
            lo = int(to[at]) if n else 0
            count = int((p[2].astype(np.int64) - width + 1).sum())
            own = np.repeat(p[1], p[2].astype(np.int64) - width + 1)
            say = np.flatnonzero(low[lo : lo + count] < own)
            at += n
            yield (say.astype(np.uint32), low[lo : lo + count][say]) if len(say) else None

    return run


def suffix_dedup(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept, spans.

    Bytes covered by a string of ``width`` bytes (at least 32) that also starts
    in a document of smaller id go, judged on the input; ``spans`` are the
    removed byte ranges, ``kept`` the rest. A null or shorter text loses
    nothing. Rows that repeat an id count as one document; a null id counts as
    smaller than all and loses nothing.
    """
    if width < SEED + 8:
        raise ValueError(f"width must be at least {SEED + 8}")
    low_id = np.iinfo(np.int64).min
    docs = texts(docs, id_col=id_col, text_col=text_col).withColumn("doc_id", F.coalesce("doc_id", F.lit(low_id)))
    blocks = Blocks(docs)
    n_buckets = blocks.n
    bucket_of = lambda key: ((key >> U(32)) % U(n_buckets)).astype(np.int64)

    def ask_seeds(table: pa.Table) -> Iterator[tuple[int, bytes]]:
        parts = parts_of(table, width)
        key, owner = np.concatenate([p.paths.key for p in parts]), np.concatenate([p.owner for p in parts])
        order = np.argsort(key)
        key, owner = key[order], owner[order]
        cut = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, int)
        many = np.minimum.reduceat(owner, cut) != np.maximum.reduceat(owner, cut) if len(key) else np.zeros(0, bool)
        key = key[cut]
        for b, (k, m), _ in split(bucket_of(key), key, many):
            order, steps = brief(k)
            yield b, packed(steps, np.packbits(m[order]))

    def repeated(table: pa.Table, answers: dict) -> list[Part]:
        """The block's parts with the paths whose minimizer several documents have."""
        parts = parts_of(table, width)
        keys = np.concatenate([p.paths.key for p in parts])
        by_key = np.argsort(keys)
        sorted_keys = keys[by_key]
        first = np.append(True, sorted_keys[1:] != sorted_keys[:-1])[: len(keys)]
        key = sorted_keys[first]
        keep = np.zeros(len(key), bool)
        for b, (k,), rows in split(bucket_of(key), key):
            if b in answers.get(1, {}):
                order, _ = brief(k)
                keep[rows[order]] = np.unpackbits(answers[1][b][0])[: len(k)].astype(bool)
        mask = np.empty(len(keys), bool)
        mask[by_key] = keep[np.cumsum(first) - 1] if len(keys) else mask
        at = 0
        for p in parts:
            n = len(p.paths.key)
            p.only(mask[at : at + n])
            at += n
        return parts

    def block_paths(parts: list[Part]) -> tuple[np.ndarray, ...]:
        return least(*(np.concatenate(c) for c in zip(*[(p.path, p.owner, p.paths.key, p.check) for p in parts])))

    def ask_paths(table: pa.Table, answers: dict) -> Iterator[tuple[int, bytes]]:
        path, doc, key, check = block_paths(repeated(table, answers))
        for b, (p, k, d, c), _ in split(bucket_of(key), path, key, doc, check):
            yield b, packed(p, k.astype(np.uint32), d, c)

    def known(parts: list[Part], answers: dict):
        path, doc, key, check = block_paths(parts)
        covered, led, source = np.zeros(len(path), bool), np.zeros(len(path), bool), check.copy()
        for b, _, rows in split(bucket_of(key), path):
            if b in answers.get(2, {}):
                c, l, checks = answers[2][b]
                covered[rows], led[rows] = (np.unpackbits(x)[: len(rows)].astype(bool) for x in (c, l))
                source[rows[covered[rows]]] = checks
        # A path that another block's document leads is covered in all of this block; else beyond its own first document.
        return path, key, doc, np.where(covered, np.int64(low_id), doc), source, led

    def strings(parts: list[Part], path: np.ndarray, led: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(size of each led path in path order, their bytes one after another)."""
        where = np.full((len(path), 2), -1)
        for k, part in enumerate(parts):
            at = np.searchsorted(path, part.path)
            rows = np.flatnonzero(led[at]) if len(at) else at
            where[at[rows]] = np.stack([np.full(len(rows), k), rows], axis=1)
        where = where[led]
        size, pieces = np.zeros(len(where), np.int64), [None] * len(where)
        for k in np.unique(where[:, 0]):
            part, mine = parts[k], np.flatnonzero(where[:, 0] == k)
            rows = where[mine, 1]
            start, end = part.paths.start[rows], part.paths.end()[rows]
            size[mine] = end - start
            for i, lo, hi in zip(mine.tolist(), start.tolist(), end.tolist()):
                pieces[i] = part.data[lo:hi]
        return size, np.concatenate(pieces) if pieces else np.zeros(0, np.uint8)

    def ask_strings(table: pa.Table, answers: dict) -> Iterator[tuple[int, bytes]]:
        parts = repeated(table, answers)
        path, key, doc, _, _, led = known(parts, answers)
        if led.any():
            size, data = strings(parts, path, led)
            first = np.cumsum(size) - size
            for b, (k, d, n), rows in split(bucket_of(key[led]), key[led], doc[led], size):
                at, _ = spread(first[rows], n)
                yield b, packed(k, d, n.astype(np.uint32), data[at])

    def end(table: pa.Table, answers: dict) -> pa.Table:
        parts = repeated(table, answers)
        path, key, doc, first, source, led = known(parts, answers)
        sizes = np.zeros(len(path), np.int64)
        for p in parts:
            sizes[np.searchsorted(path, p.path)] = p.paths.n
        # Windows of led paths that a smaller document has: a run for each path.
        row, inner = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        rows = np.flatnonzero(led)
        for b, (r,), _ in split(bucket_of(key[rows]), rows):
            if b in answers.get(3, {}):
                say, to = answers[3][b][0].astype(np.int64), np.cumsum(sizes[r])
                which = np.searchsorted(to, say, side="right")
                row.append(r[which])
                inner.append(say - (to - sizes[r])[which])
        row, inner = np.concatenate(row), np.concatenate(inner)
        order = np.argsort(row, kind="stable")
        row, inner = row[order], inner[order]
        out = []
        for part in parts:
            at = np.searchsorted(path, part.path)
            covered = [np.zeros(0, np.int64)]
            if len(at):
                whole = np.flatnonzero((first[at] < part.owner) & (source[at] == part.check))
                covered.append(spread(part.paths.start[whole], part.paths.n[whole])[0])
                mine = np.flatnonzero(led[at] & (first[at] == part.owner))
                lo, hi = np.searchsorted(row, at[mine]), np.searchsorted(row, at[mine], side="right")
                place, of = spread(lo, hi - lo)
                covered.append(part.paths.start[mine][of] + inner[place])
            out.append(result(part, np.concatenate(covered)))
        return pa.Table.from_batches(out, schema=OUT_ARROW)

    def result(part: Part, covered: np.ndarray) -> pa.RecordBatch:
        n = len(part.data)
        depth = np.bincount(covered, minlength=n + width + 1) - np.bincount(covered + width, minlength=n + width + 1)
        gone = np.cumsum(depth)[:n] > 0
        removed, sha, kept, spans = [], [], [], []
        for lo, hi in zip(part.first[:-1].tolist(), part.first[1:].tolist()):
            own, mask = part.data[lo:hi], gone[lo:hi]
            if mask.any():
                edges = np.flatnonzero(np.diff(np.concatenate([[0], mask, [0]]).astype(np.int8)))
                spans.append([{"start": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2])])
                own = own[~mask]
            else:
                spans.append([])
            removed.append(hi - lo - len(own))
            kept.append(own.tobytes())
            sha.append(hashlib.sha256(kept[-1]).hexdigest())
        ids = pa.array([None if x == low_id else x for x in part.ids.tolist()], pa.int64())
        return pa.RecordBatch.from_arrays([ids, pa.array(np.diff(part.first)), pa.array(removed, pa.int64()), pa.array([len(s) for s in spans], pa.int64()), pa.array(sha), pa.array(kept, pa.binary()), pa.array(spans, OUT_ARROW.field("spans").type)], schema=OUT_ARROW)

    seeds = blocks.answer(blocks.ask(ask_seeds, 1), answer_seeds, 1)
    paths = blocks.answer(blocks.ask(ask_paths, 2, seeds), answer_copies, 2)
    suffixes = blocks.answer(blocks.ask(ask_strings, 3, paths), answer_strings(width), 3)
    return blocks.finish(suffixes, end, OUT, OUT_ARROW)
