"""Minimizer paths of a token sequence, and which of them repeat across documents.

A window is ``width`` consecutive tokens of one document: an edge of the de
Bruijn graph. The minimizer of a window is its smallest hash of ``seed``
tokens; consecutive windows with one minimizer form a path, whose inner nodes
do not branch inside the document. Equal windows have equal minimizers, so
only paths with one minimizer can share windows. A path that is the same in
all documents is compacted: one hash stands for all its windows. Only where
paths with one minimizer differ are windows looked at singly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from scholarlake.llm.blocks import split
from scholarlake.llm.words import U, mix, powers

#: Two independent polynomial bases; the second confirms a span at its source.
BASES = (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9 | 1)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    if len(x) < width:
        return x[:0]
    span, out = 1, x
    while 2 * span <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    if span < width:
        out = np.minimum(out[: len(x) - width + 1], out[width - span : width - span + len(x) - width + 1])
    return out


class Sums:
    """Prefix polynomials of token values: hashes of any stretch, under two bases."""

    def __init__(self, values: np.ndarray):
        self.total = []
        for base in BASES:
            total = np.zeros(len(values) + 1, U)
            np.cumsum(values * powers(base, len(values)), out=total[1:])
            self.total.append(total)

    def hash(self, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
        back = powers(pow(BASES[which], -1, 1 << 64), len(self.total[which]))
        h = (self.total[which][end] - self.total[which][start]) * back[start]
        return mix(h + (end - start).astype(U) * U(0x9E3779B97F4A7C15))


class Paths:
    """Paths of a run of texts: ``start`` (first window's token), ``n`` (windows), ``doc``, ``key`` (minimizer)."""

    def __init__(self, seeds: np.ndarray, first: np.ndarray, width: int, seed: int):
        """``seeds[i]``: hash of the ``seed`` tokens from token i; ``first``: each text's first token, and the end."""
        self.width = width
        low = sliding_min(seeds, width - seed + 1)
        # A text's last width - 1 tokens start no window, so windows of two texts are never neighbours.
        inside = np.ones(len(low), bool)
        for lo, hi in zip(first[:-1].tolist(), first[1:].tolist()):
            inside[max(lo, hi - width + 1) : hi] = False
        changes = low[1:] != low[:-1]
        opens = inside.copy()
        opens[1:] &= ~inside[:-1] | changes
        self.start = np.flatnonzero(opens)
        inside[:-1] &= ~inside[1:] | changes
        self.n = np.flatnonzero(inside) + 1 - self.start
        self.key = low[self.start]
        self.doc = np.searchsorted(first, self.start, side="right") - 1

    def end(self) -> np.ndarray:
        return self.start + self.n + self.width - 1


def least(key: np.ndarray, value: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, ...]:
    """(distinct keys sorted, smallest value of each, ``more`` at that value)."""
    order = np.lexsort((value, key))
    key = key[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    rows = order[new]
    return (key[new], value[rows], *(m[rows] for m in more))


def ranges(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """(distinct keys sorted, smallest and largest of each value)."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    if not len(key):
        return (key, *(v[:0] for v in values for _ in range(2)))
    cut = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return (key[cut], *(f.reduceat(v[order], cut) for v in values for f in (np.minimum, np.maximum)))


def differ(payloads: list[list[np.ndarray]], at: int, n: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """(distinct keys, for each of ``n`` values whether it differs) from the ranges that blocks sent at ``at``."""
    sent = [np.concatenate([p[at + i] for p in payloads]) for i in range(1 + 2 * n)]
    keys, group = np.unique(sent[0], return_inverse=True)
    out = []
    for low, high in zip(sent[1::2], sent[2::2]):
        ends = []
        for x, f, limit in ((low, np.minimum, "max"), (high, np.maximum, "min")):
            end = np.full(len(keys), getattr(np.iinfo(x.dtype), limit), x.dtype)
            f.at(end, group, x)
            ends.append(end)
        out.append(ends[0] != ends[1])
    return keys, out


def sources(payloads: list[list[np.ndarray]]) -> tuple[np.ndarray, ...]:
    """(distinct hashes, smallest document, place there, its block, whether several blocks have it) from (block; hash, doc, place)."""
    name, doc, place = (np.concatenate([p[i] for p in payloads]) for i in range(1, 4))
    block = np.concatenate([np.full(len(p[1]), p[0][0], np.int32) for p in payloads])
    names, first, at, of = least(name, doc, place, block)
    return names, first, at, of, np.bincount(np.searchsorted(names, name), minlength=len(names)) > 1


def answer_paths(payloads: list[list[np.ndarray]]) -> Iterator[tuple | None]:
    """For each block's (block; path, doc, place; key and its ranges): (rows of paths that other blocks have, source document, place, block; rows of branching keys).

    Paths and keys come to buckets of their own hashes: a block sends a range
    for each of its keys, so a key that all documents hold costs one row a
    block, and its many paths are spread over all buckets.
    """
    names, first, place, block, copies = sources(payloads)
    keys, (paths, docs) = differ(payloads, 4, 2)
    # Different paths of different documents: their windows are looked at singly.
    branches = paths & docs
    for p in payloads:
        i = np.searchsorted(names, p[1])
        say, look = np.flatnonzero(copies[i]), np.flatnonzero(branches[np.searchsorted(keys, p[4])])
        i = i[say]
        yield (say.astype(np.uint32), first[i], place[i], block[i], look.astype(np.uint32)) if len(say) or len(look) else None


def answer_windows(payloads: list[list[np.ndarray]]) -> Iterator[tuple | None]:
    """For each block's (block; window, doc, place; path and the ranges of its neighbours): (rows whose window a smaller document has, source; for each path, 1 if its next one differs, 2 if the one before)."""
    names, first, place, block, _ = sources(payloads)
    paths, (after, before) = differ(payloads, 4, 2)
    for p in payloads:
        i, j = np.searchsorted(names, p[1]), np.searchsorted(paths, p[4])
        say = np.flatnonzero(first[i] < p[2])
        i = i[say]
        yield say.astype(np.uint32), first[i], place[i], block[i], after[j].astype(np.uint8) | before[j].astype(np.uint8) << 1


def spread(start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values start .. start + n - 1 of every row, row numbers)."""
    row = np.repeat(np.arange(len(n)), n)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + start[row], row


def gathered(bucket: np.ndarray, key: np.ndarray, answers: dict[int, list[np.ndarray]], defaults: tuple) -> list[np.ndarray]:
    """Answers (row, column, ...) of sorted distinct keys, back at those keys; ``defaults`` where none came."""
    out = [np.full(len(key), d) for d in defaults]
    for b, _, rows in split(bucket, key):
        if b in answers:
            say, *columns = answers[b]
            for o, c in zip(out, columns):
                o[rows[say]] = c
    return out
