"""Alignment of two tokenizers by a dictionary of token groups.

Byte offsets where tokens of both end cut a text into groups, and as no
tokenizer merges over a space behind a non-space, groups lie within words. A
task interns the distinct groups of a scope of its documents; Spark interns
them corpus-wide with their frequencies, expands the links of each distinct
group once, and joins what it knows of a group back to the scopes by the
group's key, where documents add up by their groups' places in the scope.
"""

from __future__ import annotations

import functools
import hashlib
import re
from array import array
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholarlake.llm.tokens import SLICE, WORD_BYTES, byte_letters, byte_level, loaded, pieces
from scholarlake.llm.tools import checkpointed, rows_out, texts

#: A scope of documents ends at so many characters, or once a process knows so many distinct groups.
SCOPE_BYTES = 32 << 20
SCOPE_GROUPS = 1_000_000
#: Words and units that a process remembers before it starts afresh.
TABLE_WORDS, TABLE_UNITS = 800_000, 400_000
#: A space behind a character that no rule takes for white space; U+2581 is how pieces write a space.
CUT = re.compile("(?<=[^\\s᠎▁]) ")
OTHER_SPACE = re.compile("(?:^|[\\s᠎▁]) ")
BYTE_PIECE = re.compile("<0x([0-9A-F]{2})>")
MADE = "scope long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, steps array<int>, times array<int>, grp string, place int, n long"
MADE_ARROW = pa.schema([("scope", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("groups_sha256", pa.string()), ("steps", pa.list_(pa.int32())), ("times", pa.list_(pa.int32())), ("grp", pa.string()), ("place", pa.int32()), ("n", pa.int64())])
ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
ALIGNED_ARROW = pa.schema([(c, pa.string() if c == "groups_sha256" else pa.int64()) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")])


class Pair:
    """Both tokenizers, with bounded tables of words and of the groups that they are cut into.

    ``places`` numbers distinct groups for as long as the tables last; what a
    word is cut into is kept as those numbers.
    """

    #: Latin letters, then ASCII punctuation but for the apostrophe: two units of a byte-level BPE.
    UNITS = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\\[-`{-~]*)")

    def __init__(self, a: str, b: str):
        self.a, self.b = loaded(a, True), pieces(b)
        byte = {letter: i for i, letter in enumerate(byte_letters())}
        size = self.a.get_vocab_size()
        self.blank = byte_letters()[32]
        #: One object an id, however many units hold it.
        self.ids = list(range(size))
        self.a_bytes = [bytes(byte[x] for x in t) if all(x in byte for x in t) else t.encode() for t in map(self.a.id_to_token, range(size))]
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            text = self.b.id_to_piece(i)
            hexed = BYTE_PIECE.fullmatch(text)
            self.b_bytes.append(bytes([int(hexed[1], 16)]) if hexed else text.replace("▁", " ").encode())
        self.a_size, self.b_size = list(map(len, self.a_bytes)), list(map(len, self.b_bytes))
        self.space = self.b.piece_to_id("▁")
        self.clear()

    def clear(self) -> None:
        self.units: dict[str, list[int]] = {}
        self.words: dict[str, bytes | None] = {}
        self.places: dict[tuple[int, ...], int] = {}
        self.names: list[str] = []
        self.tokens = array("q")

    def unit(self, text: str) -> list[int]:
        if (found := self.units.get(text)) is None:
            if len(self.units) >= TABLE_UNITS:
                self.units.clear()
            letters = text.replace(" ", self.blank) if text.isascii() else byte_level(text)  # visible ASCII stands for itself
            found = self.units[text] = [self.ids[t.id] for t in self.a.model.tokenize(letters)]
        return found

    def a_ids(self, word: str) -> list[int]:
        whole = self.UNITS.fullmatch(word)
        if whole is None:
            return self.a.encode(" " + word, add_special_tokens=False).ids
        return self.unit(" " + whole[1]) + self.unit(whole[2]) if whole[2] else self.unit(" " + whole[1])

    def place(self, key: tuple[int, ...], a: list[int], b: list[int]) -> int:
        """The number of a group that is new."""
        self.places[key] = len(self.names)
        self.names.append(",".join(map(str, a)) + "|" + ",".join(map(str, b)))
        self.tokens.append((len(a) << 32) + len(b))
        return self.places[key]

    def groups(self, word: str, b: list[int]) -> bytes | None:
        """Numbers of the groups of a space and a word, or None if the tokens' bytes are not the text's."""
        a, b, data = self.a_ids(word), b if word else [self.space], (" " + word).encode()
        if b"".join(map(self.a_bytes.__getitem__, a)) != data or b"".join(map(self.b_bytes.__getitem__, b)) != data:
            return None
        ends = list(accumulate(map(self.b_size.__getitem__, b)))
        cuts, at, out, from_a, from_b = set(ends), 0, array("i"), 0, 0
        for i, token in enumerate(a, 1):
            at += self.a_size[token]
            if at in cuts:
                to_b = ends.index(at, from_b) + 1
                key = (*a[from_a:i], -1, *b[from_b:to_b])
                out.append(self.places[key] if key in self.places else self.place(key, a[from_a:i], b[from_b:to_b]))
                from_a, from_b = i, to_b
        return out.tobytes()

    def learn(self, words: list[str]) -> list[str]:
        """Puts the words into the table; returns those too long to stay there."""
        if len(self.words) >= TABLE_WORDS:
            self.words.clear()
        new = list(set(words).difference(self.words))
        for word, b_ids in zip(new, self.b.encode(new, num_threads=1) if new else ()):
            self.words[word] = self.groups(word, b_ids)
        return [w for w in new if len(w) > WORD_BYTES]


@functools.cache
def pair_of(a: str, b: str) -> Pair:
    """One process's tables."""
    return Pair(a, b)


def words_of(text: str) -> Iterator[list[str]]:
    """The words of a space and ``text``, each without the space before it, some at a time."""
    at = 0
    while True:
        cut = CUT.search(text, at + SLICE)
        own = text[at : cut.start()] if cut else text[at:]
        yield CUT.split(own) if OTHER_SPACE.search(own) else own.split(" ")
        if cut is None:
            return
        at = cut.end()


class Scope:
    """Documents that share one dictionary: the groups that they hold and how often."""

    def __init__(self, pair: Pair, number: int):
        self.pair, self.number, self.held = pair, number, 0
        if len(pair.names) >= SCOPE_GROUPS:
            pair.clear()
        self.counts = np.zeros(1024, np.int64)

    def row(self, doc_id: int | None, text: str) -> tuple:
        digest, found, known, pair = hashlib.sha256(), [], bool(text), self.pair
        for words in words_of(text) if text else ():
            long = pair.learn(words)
            rows = list(map(pair.words.__getitem__, words))
            for word in long:
                del pair.words[word]
            if None in rows:
                known = False
                break
            own = np.frombuffer(b"".join(rows), np.int32)
            digest.update(((";" if found else "") + ";".join(map(pair.names.__getitem__, own.tolist()))).encode())
            found.append(own)
        self.held += len(text)
        if not known:
            return (self.number, doc_id, 0, 0, 0, "", [], [], None, None, None)
        places, times = np.unique(np.concatenate(found), return_counts=True)
        if len(pair.names) > len(self.counts):
            self.counts = np.append(self.counts, np.zeros(2 * len(pair.names) - len(self.counts), np.int64))
        self.counts[places] += times
        tokens = int(np.frombuffer(pair.tokens, np.int64)[places] @ times)
        return (self.number, doc_id, tokens >> 32, tokens & 0xFFFFFFFF, int(times.sum()), digest.hexdigest(), np.diff(places, prepend=np.int32(0)), times.astype(np.int32), None, None, None)

    @property
    def full(self) -> bool:
        return self.held >= SCOPE_BYTES or len(self.pair.names) >= SCOPE_GROUPS

    def dictionary(self) -> Iterator[tuple]:
        for place in np.flatnonzero(self.counts).tolist():
            yield (self.number, *[None] * 7, self.pair.names[place], place, int(self.counts[place]))


def links(group: Column) -> tuple[Column, Column]:
    """The A id and the B id of a group that end together.

    Any earlier common end would have cut the group, so these are its last ones.
    """
    last = lambda ids: F.substring_index(ids, ",", -1).cast("int")
    return last(F.substring_index(group, "|", 1)), last(F.substring_index(group, "|", -1))


def group_links(entries: DataFrame) -> DataFrame:
    """(grp, a, b, links, best) of every distinct group of ``entries(grp, n)``.

    ``links``: how many links of the corpus join its id pair; ``best``: whether
    no pair of that B id has more. Of two ids that end together one's bytes end
    the other's, so pairs are bounded by the vocabularies, not by the corpus.
    """
    a, b = links(F.col("grp"))
    groups = entries.groupBy("grp").agg(F.sum("n").alias("n")).select("grp", "n", a.alias("a"), b.alias("b"))
    pairs = groups.groupBy("a", "b").agg(F.sum("n").alias("links"))
    top = pairs.groupBy("b").agg(F.max("links").alias("top"))
    known = pairs.join(top, "b").select("a", "b", "links", (F.col("links") == F.col("top")).alias("best"))
    return groups.join(known, ["a", "b"]).select("grp", "a", "b", "links", "best")


def summed(rows: pa.Table, found: pa.Table) -> pa.Table:
    """Documents of one scope with the sums over their groups."""
    place = found.column("place").to_numpy()
    count, best = np.zeros(place.max(initial=-1) + 1, np.int64), np.zeros(place.max(initial=-1) + 1, np.int64)
    count[place], best[place] = found.column("links").to_numpy(), found.column("best").to_numpy().astype(np.int64)
    steps, times = rows.column("steps").combine_chunks(), rows.column("times").combine_chunks()
    sizes = pa.compute.list_value_length(steps).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    walked = np.append(0, np.cumsum(steps.flatten().to_numpy(zero_copy_only=False).astype(np.int64)))
    places = walked[1:] - np.repeat(walked[ends - sizes], sizes)
    weight = times.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    add = lambda x: np.diff(np.append(0, np.cumsum(weight * x[places]))[np.append(0, ends)])
    columns = [rows.column(c).combine_chunks() for c in ("doc_id", "n_a", "n_b", "n_groups", "n_groups")]
    return pa.table([*columns, pa.array(add(best)), pa.array(add(count)), rows.column("groups_sha256").combine_chunks()], schema=ALIGNED_ARROW)


def align(docs: DataFrame, a: str | None = None, b: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: tokens, groups and links of its two encodings, and what the corpus knows of its links.

    ``a``: file of a byte-level BPE; ``b``: of a piece model that puts a space
    before a text; both without special tokens, and the same on all executors.
    Texts that are null, empty or that either tokenizer does not give back byte
    by byte have zeros and an empty digest. Repeated rows, ids and null ids
    count as documents of their own; an empty table gives no rows; other
    columns do not matter. Very long texts are cut into slices between words.
    """
    a, b = a or public_tokenizers.path("byte_bpe_50k.json"), b or public_tokenizers.path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, number = pair_of(a, b), TaskContext.get().partitionId() << 20

        def rows() -> Iterator[tuple]:
            scope = Scope(pair, number)
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    yield scope.row(doc_id, text.as_py())
                    if scope.full:
                        yield from scope.dictionary()
                        scope = Scope(pair, scope.number + 1)
            yield from scope.dictionary()

        yield from rows_out(MADE_ARROW, rows(), size=lambda r: 8 * len(r[6]) if r[6] is not None else 16)

    made = checkpointed(texts(docs, id_col=id_col, text_col=text_col).mapInArrow(run, MADE))
    entries = made.filter("grp IS NOT NULL").select("scope", "place", "grp", "n")
    back = entries.select(F.col("scope").alias("of"), "place", F.col("grp").alias("key")).join(group_links(entries), F.col("key") == F.col("grp")).select("of", "place", "links", "best")
    rows = made.filter("grp IS NULL").select("scope", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "steps", "times")
    return rows.groupBy("scope").cogroup(back.groupBy("of")).applyInArrow(lambda own, found: summed(own, found), ALIGNED)
