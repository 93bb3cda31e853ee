"""Substring dedup by de Bruijn compaction over words.

Runs of ``width`` words are the edges of a de Bruijn graph. Inside a document,
consecutive edges with one minimizer are a nonbranching path, named by a hash
(see ``paths``). Four joins between blocks of documents and buckets of hashes
follow:

1. Paths meet their equals: each learns the source, the smallest document that
   has all of it, and its place there. Where paths with one minimizer differ,
   which one range a block tells, one copy of each is taken apart into edges.
2. Edges taken apart meet their equals the same way, and repeated paths meet
   their neighbours: where all occurrences in the corpus go on alike, the node
   between two paths does not branch.
3. Across such nodes repeated paths compact to spans, as far as their source
   goes on as they do. A span is asked for at its source's coordinates.
4. The source's block compares the span with the words there by a second,
   independent hash; only spans that agree are removed.

So neither a path nor a minimizer that most documents hold weighs on one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarlake.llm.blocks import Blocks, packed, place_among, split, text_batch
from scholarlake.llm.paths import Paths, Sums, answer_paths, answer_windows, gathered, least, ranges, spread
from scholarlake.llm.tools import texts
from scholarlake.llm.words import U, Words, salted, slices, windows

WIDTH = 50
OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string, spans array<struct<start: long, end: long>>"
OUT_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


class Part:
    """Paths of a run of texts, with the hashes of their words; ``path``: hash of each path, ``place``: its first word in its text."""

    def __init__(self, batch: pa.RecordBatch, width: int):
        self.batch, self.ids = batch, batch.column(0).to_numpy(zero_copy_only=False)
        words = Words(batch.column(1))
        self.first, self.count = words.first, words.count
        seeds, _ = windows(words.hash, words.first, (width + 1) // 2)
        self.paths = Paths(seeds, words.first, width, (width + 1) // 2)
        self.sums = Sums(salted(words.hash, 21)) if len(self.paths.start) else None
        self.path = self.sums.hash(self.paths.start, self.paths.end()) if self.sums else np.zeros(0, U)
        self.owner = self.ids[self.paths.doc]
        self.place = self.paths.start - self.first[self.paths.doc]

    def neighbours(self) -> tuple[np.ndarray, np.ndarray]:
        """The path after and before each path in its text, 0 where there is none."""
        after, before = np.zeros(len(self.path), U), np.zeros(len(self.path), U)
        if len(self.path):
            goes_on = (self.paths.doc[1:] == self.paths.doc[:-1]) & (self.paths.start[:-1] + self.paths.n[:-1] == self.paths.start[1:])
            after[:-1][goes_on], before[1:][goes_on] = self.path[1:][goes_on], self.path[:-1][goes_on]
        return after, before


def parts_of(table: pa.Table, width: int) -> list[Part]:
    return [Part(batch, width) for batch in slices(text_batch(table))]


def joined(columns: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    return tuple(np.concatenate(c) for c in zip(*columns))


FAR = np.int64(np.iinfo(np.int64).max)


class Graph:
    """What the joins have told a block about its paths and windows."""

    def __init__(self, parts: list[Part], width: int, mine: int, n: int):
        self.parts, self.width, self.mine, self.n = parts, width, np.int32(mine), n
        self.path, self.doc, self.key, self.place = least(*joined([(p.path, p.owner, p.paths.key, p.place) for p in parts]))
        self.ranges = ranges(self.key, self.path, self.doc)

    def bucket(self, key: np.ndarray) -> np.ndarray:
        return ((key >> U(32)) % U(self.n)).astype(np.int64)

    def sent(self, *tables: tuple[np.ndarray, ...]) -> Iterator[tuple[int, bytes]]:
        """One payload a bucket: this block's number, then each table's rows of the bucket (by their first column)."""
        dealt = [{b: columns for b, columns, _ in split(self.bucket(x[0]), *x)} for x in tables]
        for b in sorted(set().union(*dealt)):
            yield b, packed(np.array([self.mine]), *(c for x, of in zip(tables, dealt) for c in of.get(b, tuple(y[:0] for y in x))))

    def paths(self, found: dict) -> None:
        """Sources of the distinct paths, and whether their windows are looked at singly, from the first answers."""
        got = gathered(self.bucket(self.path), self.path, {b: a[:4] for b, a in found.items()}, (FAR, np.int64(0), np.int32(0)))
        # The block's own smallest document may be the only one with the path.
        inner = self.doc < got[0]
        self.source = [np.where(inner, own, other) for own, other in zip((self.doc, self.place, self.mine), got)]
        keys = self.ranges[0]
        (look,) = gathered(self.bucket(keys), keys, {b: (a[4], np.ones(len(a[4]), bool)) for b, a in found.items()}, (False,))
        self.look = look[np.searchsorted(keys, self.key)]
        self.at = [np.searchsorted(self.path, p.path) for p in self.parts]
        times = np.bincount(np.concatenate(self.at), minlength=len(self.path))
        repeated = (got[0] != FAR) | (times > 1)
        around = [(p.path[keep], *(x[keep] for x in p.neighbours())) for p, keep in ((p, repeated[at]) for p, at in zip(self.parts, self.at))]
        self.around = ranges(*joined(around))

    def windows(self) -> None:
        """The windows of branching paths that a document of this block leads: by part (hash, doc, first token, place), and distinct."""
        self.single = []
        for part, at in zip(self.parts, self.at):
            rows = np.flatnonzero(self.look[at] & (self.source[0][at] == part.owner))
            start, row = spread(part.paths.start[rows], part.paths.n[rows])
            h = part.sums.hash(start, start + self.width) if len(start) else np.zeros(0, U)
            self.single.append((h, part.owner[rows][row], start, start - part.first[part.paths.doc[rows][row]]))
        self.window = least(*joined([(h, doc, place) for h, doc, _, place in self.single]))

    def spans(self, found: dict) -> list[tuple[np.ndarray, ...]]:
        """By part, what is repeated: (first token, windows, source block, document, place, second hash)."""
        h, doc, place = self.window
        got = gathered(self.bucket(h), h, {b: a[:4] for b, a in found.items()}, (FAR, np.int64(0), np.int32(0)))
        # Inside the block a smaller document may have the window too.
        inner = doc < got[0]
        source = [np.where(inner, own, other) for own, other in zip((doc, place, self.mine), got)]
        branch = np.zeros(len(self.around[0]), np.uint8)
        for b, _, rows in split(self.bucket(self.around[0]), self.around[0]):
            branch[rows] = found[b][4]
        out = []
        for part, at, (own, own_doc, start, _) in zip(self.parts, self.at, self.single):
            whole = np.flatnonzero(self.source[0][at] < part.owner)
            i = np.searchsorted(h, own)
            alone = np.flatnonzero(source[0][i] < own_doc)
            # A path goes on over a node that does not branch; single edges are cut by their source alone.
            k = np.minimum(np.searchsorted(self.around[0], part.path[whole]), max(len(branch) - 1, 0))
            flags = branch[k] if len(branch) else np.zeros(len(whole), np.uint8)
            columns = joined([
                (part.paths.start[whole], part.paths.n[whole], *(s[at[whole]] for s in self.source), flags, part.paths.doc[whole]),
                (start[alone], np.ones(len(alone), np.int64), *(s[i[alone]] for s in source), np.zeros(len(alone), np.uint8), np.searchsorted(part.first, start[alone], side="right") - 1),
            ])
            order = np.argsort(columns[0], kind="stable")
            first, n, of, where, block, flags, text = (c[order] for c in columns)
            on = (text[1:] == text[:-1]) & (first[:-1] + n[:-1] == first[1:]) & (of[1:] == of[:-1]) & (block[1:] == block[:-1]) & (where[:-1] + n[:-1] == where[1:])
            on &= (flags[:-1] & 1 == 0) & (flags[1:] & 2 == 0)
            cut = np.flatnonzero(np.append(True, ~on)) if len(first) else np.zeros(0, int)
            n = np.add.reduceat(n, cut) if len(cut) else n
            first = first[cut]
            check = part.sums.hash(first, first + n + self.width - 1, 1) if len(first) else np.zeros(0, U)
            out.append((first, n, block[cut].astype(np.int64), of[cut], where[cut], check))
        return out


def verified(parts: list[Part], width: int, doc: np.ndarray, place: np.ndarray, n: np.ndarray, check: np.ndarray) -> np.ndarray:
    """Whether the words at (document, place) of this block hash to ``check``; of rows that repeat an id any may."""
    out = np.zeros(len(doc), bool)
    for part in parts:
        order = np.argsort(part.ids, kind="stable")
        lo, hi = (np.searchsorted(part.ids[order], doc, side=s) for s in ("left", "right"))
        at, row = spread(lo, hi - lo)
        text = order[at]
        start = part.first[text] + place[row]
        end = start + n[row] + width - 1
        fits = end <= part.first[text + 1]
        start, end, row = start[fits], end[fits], row[fits]
        if len(row) and part.sums is not None:
            out[row[part.sums.hash(start, end, 1) == check[row]]] = True
    return out


def repeats(docs: DataFrame, width: int, finish, schema: str, empty: pa.Schema) -> DataFrame:
    """The block joins; ``finish(part, covered)`` gets the first tokens of windows to remove."""
    blocks = Blocks(docs)
    ids = blocks.ids

    def graph(table: pa.Table, answers: dict | None = None) -> Graph:
        g = Graph(parts_of(table, width), width, place_among(ids, table), len(ids))
        if answers is not None:
            g.paths(answers.get(1, {}))
            g.windows()
        return g

    def ask_paths(table: pa.Table) -> Iterator[tuple[int, bytes]]:
        g = graph(table)
        yield from g.sent((g.path, g.doc, g.place), g.ranges)

    def ask_windows(table: pa.Table, answers: dict) -> Iterator[tuple[int, bytes]]:
        g = graph(table, answers)
        yield from g.sent(g.window, g.around)

    def ask_spans(table: pa.Table, answers: dict) -> Iterator[tuple[int, bytes]]:
        _, n, block, doc, place, check = joined(graph(table, answers).spans(answers.get(2, {})))
        for b, columns, _ in split(block, doc, place, n, check):
            yield b, packed(*columns)

    def at_source(table: pa.Table, payloads: list[list[np.ndarray]]) -> Iterator[tuple]:
        parts = parts_of(table, width)
        for p in payloads:
            yield (verified(parts, width, *p),)

    def end(table: pa.Table, answers: dict) -> pa.Table:
        g = graph(table, answers)
        spans = g.spans(answers.get(2, {}))
        block = np.concatenate([s[2] for s in spans])
        good = np.zeros(len(block), bool)
        for b, _, rows in split(block, block):
            good[rows] = answers[3][b][0]
        out, at = [], 0
        for part, (first, n, *_) in zip(g.parts, spans):
            keep = good[at : at + len(first)]
            at += len(first)
            out.append(finish(part, spread(first[keep], n[keep])[0]))
        return pa.Table.from_batches(out, schema=empty)

    paths = blocks.answer(blocks.ask(ask_paths, 1), answer_paths, 1)
    edges = blocks.answer(blocks.ask(ask_windows, 2, paths), answer_windows, 2)
    spans = blocks.at_source(blocks.ask(ask_spans, 3, edges), at_source, 3)
    return blocks.finish(spans, end, schema, empty)


def substring_dedup(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256, kept_text, spans.

    Words covered by a window of ``width`` words that also starts in a
    document of smaller id go; windows are judged on the input. ``kept_text``:
    the kept words joined by one space; ``spans``: removed word ranges. A null
    or shorter text loses nothing. Rows that repeat an id count as one
    document; a null id counts as smaller than all and loses nothing.
    """
    docs = texts(docs, id_col=id_col, text_col=text_col)
    low = np.iinfo(np.int64).min

    def finish(part: Part, covered: np.ndarray) -> pa.RecordBatch:
        n = int(part.first[-1])
        depth = np.bincount(covered, minlength=n + width + 1) - np.bincount(covered + width, minlength=n + width + 1)
        gone = np.cumsum(depth)[:n] > 0
        removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[part.first])
        kept, sha, spans = [], [], []
        for i, text in enumerate(part.batch.column(1)):
            own = text.as_py().encode().split()
            cut: list[dict] = []
            if removed[i]:
                mask = gone[part.first[i] : part.first[i + 1]]
                own = list(compress(own, ~mask))
                edges = np.flatnonzero(np.diff(np.concatenate([[0], mask, [0]]).astype(np.int8)))
                cut = [{"start": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2])]
            out = b" ".join(own)
            sha.append(hashlib.sha256(out).hexdigest())
            kept.append(out.decode())
            spans.append(cut)
        ids = pa.array([None if x == low else x for x in part.ids.tolist()], pa.int64())
        return pa.RecordBatch.from_arrays([ids, pa.array(part.count), pa.array(removed), pa.array(sha), pa.array(kept, pa.string()), pa.array(spans, OUT_ARROW.field("spans").type)], schema=OUT_ARROW)

    return repeats(docs.withColumn("doc_id", F.coalesce("doc_id", F.lit(low))), width, finish, OUT, OUT_ARROW)
