"""Ids of public tokenizers for whole texts, word by word.

A tokenizer never merges over certain places of a text (a space after a
non-space, for one), so the words between such places can be looked up in a
bounded table; the ids are those of the whole text. What a rule does not
clearly cover goes to the tokenizer itself.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import sentencepiece
from tokenizers import Tokenizer

#: Words that a table holds before it starts afresh.
TABLE_WORDS = 400_000
#: Longer words leave the table after each slice, so that it stays bounded in bytes too.
WORD_BYTES = 200
#: Bytes of a text that are split into words at a time.
SLICE = 1 << 20
SPACE = re.compile(rb"[ \t\n\r\x0b\x0c]")


@functools.cache
def byte_letters() -> list[str]:
    """The letter by which byte-level vocabularies write each byte: itself if it is visible Latin-1, else the next one from U+0100."""
    seen = {b for b in range(256) if 33 <= b <= 126 or 161 <= b != 173}
    rest = iter(range(256, 512))
    return [chr(b) if b in seen else chr(next(rest)) for b in range(256)]


def byte_level(text: str) -> str:
    letters = byte_letters()
    return "".join([letters[b] for b in text.encode()])


@functools.cache
def loaded(path: str, plain: bool) -> Tokenizer:
    """``plain``: strings of special tokens inside texts are ordinary text."""
    made = Tokenizer.from_file(path)
    made.encode_special_tokens = plain
    return made


@functools.cache
def pieces(path: str) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_file=path)


class WordIds:
    """Ids of a lower-casing BPE with word ends, as little-endian 32-bit bytes.

    Such a tokenizer drops white space, so a text is cut at ASCII white space.
    A word of Latin letters with punctuation behind it is two units; any other
    word, and any text that may hold a special token, goes to the tokenizer.
    """

    #: Lower-case Latin letters, then ASCII punctuation but for the apostrophe, which may open a contraction.
    UNITS = re.compile("([a-zß-öø-ÿ]+)([!-&(-/:-@\\[-`{-~]*)")

    def __init__(self, path: str):
        self.tokenizer = loaded(path, False)
        self.specials = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words: dict[bytes, bytes] = {}
        self.units: dict[str, bytes] = {}

    def unit(self, text: str) -> bytes:
        if (found := self.units.get(text)) is None:
            if len(self.units) >= TABLE_WORDS:
                self.units.clear()
            found = self.units[text] = np.array([t.id for t in self.tokenizer.model.tokenize(byte_level(text))], "<u4").tobytes()
        return found

    def word(self, word: bytes) -> bytes:
        text = word.decode()
        whole = self.UNITS.fullmatch(text.lower()) if max(text) < "Ā" else None
        if whole is None:
            return self.encoded(text)
        return self.unit(whole[1]) + (self.unit(whole[2]) if whole[2] else b"")

    def encoded(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, text: str) -> bytes:
        data = text.encode()
        if any(s in data for s in self.specials):
            return self.encoded(text)
        made, at = [], 0
        while at < len(data):
            cut = SPACE.search(data, at + SLICE)
            end = cut.start() if cut else len(data)
            words = data[at:end].split()
            if len(self.words) >= TABLE_WORDS:
                self.words.clear()
            new = set(words).difference(self.words)
            for word in new:
                self.words[word] = self.word(word)
            made.extend(map(self.words.__getitem__, words))
            for word in new:
                if len(word) > WORD_BYTES:
                    del self.words[word]
            at = end
        return b"".join(made)
