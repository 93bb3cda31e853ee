"""Suffix sorting by the difference cover {1, 2} modulo 3, vectorised."""

from __future__ import annotations

import numpy as np


def ranked(*columns: np.ndarray) -> tuple[np.ndarray, int]:
    """(dense rank of each row of non-negative columns from 1, number of ranks)."""
    rank, top = columns[0].astype(np.int64), int(columns[0].max(initial=0)) + 1
    for c in columns[1:]:
        high = int(c.max(initial=0)) + 1
        if top * high >= 1 << 62:
            names, rank = np.unique(rank, return_inverse=True)
            top = len(names)
        rank = rank * high + c
        top *= high
    names, rank = np.unique(rank, return_inverse=True)
    return rank + 1, len(names)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of ``text`` (integers from 1 up) in order; a suffix sorts before its extensions.

    Suffixes at 1 and 2 modulo 3 are sorted by triples, recursing on the
    triples' names where these repeat; those at 0 are sorted by their first
    symbol and the rank of the next suffix, and merged into the sample by
    comparing one or two symbols and a rank.
    """
    n = len(text)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: list(text[i:])), np.int64)
    s = np.concatenate([text.astype(np.int64), np.zeros(3, np.int64)])
    ones, twos = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate([ones, twos])
    names, distinct = ranked(s[sample], s[sample + 1], s[sample + 2])
    rank = np.zeros(n + 3, np.int64)
    if distinct < len(sample):
        order = sample[suffix_array(names)]
    else:
        order = sample[np.argsort(names)]
    rank[order] = np.arange(1, len(order) + 1)
    order = order[order < n]
    zeros = np.arange(0, n, 3)
    zeros = zeros[np.lexsort((rank[zeros + 1], s[zeros]))]
    # Sample suffixes at 1: compare (symbol, rank of the next); at 2: (symbol, symbol, rank).
    is_one = order % 3 == 1
    o1, o2 = order[is_one], order[~is_one]
    key, _ = ranked(np.concatenate([s[o1], s[zeros]]), np.concatenate([rank[o1 + 1], rank[zeros + 1]]))
    before = np.searchsorted(key[: len(o1)], key[len(o1) :])
    key, _ = ranked(np.concatenate([s[o2], s[zeros]]), np.concatenate([s[o2 + 1], s[zeros + 1]]), np.concatenate([rank[o2 + 2], rank[zeros + 2]]))
    before = before + np.searchsorted(key[: len(o2)], key[len(o2) :])
    out = np.empty(n, np.int64)
    at = before + np.arange(len(zeros))
    out[at] = zeros
    rest = np.ones(n, bool)
    rest[at] = False
    out[rest] = order
    return out


def prefix_groups(text: np.ndarray, order: np.ndarray, width: int) -> np.ndarray:
    """Group number of each suffix of ``order``: neighbours whose first ``width`` symbols agree share it.

    Every suffix of ``order`` must have ``width`` symbols.
    """
    same = np.ones(max(0, len(order) - 1), bool)
    alive = np.arange(len(same))
    for k in range(width):
        hit = text[order[alive] + k] == text[order[alive + 1] + k]
        same[alive[~hit]] = False
        alive = alive[hit]
    return np.concatenate([[0], np.cumsum(~same)]) if len(order) else np.zeros(0, np.int64)
