"""Pluggable engines: OCR, embedding, extraction. HTTP adapters for services, stubs that need none."""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Callable, Iterator
from functools import lru_cache
from html.parser import HTMLParser
from typing import Protocol
from urllib.request import Request, urlopen

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Texts per embedding request, OCR token limit, time limits in seconds.
BATCH, MAX_TOKENS, EMBED_TIMEOUT, OCR_TIMEOUT, FETCH_TIMEOUT = 32, 4096, 120, 600, 20
OCR_PROMPT = "document parsing."
#: Words whose place a process remembers; a full table starts anew.
KNOWN_WORDS = 1 << 18


class Embedder(Protocol):
    """Unit vectors of texts; a zero vector gives None."""

    dim: int

    def embed(self, texts: list[str]) -> list[np.ndarray | None]: ...


class OcrEngine(Protocol):
    def infer_single(self, image: bytes, prompt: str = OCR_PROMPT, max_length: int = MAX_TOKENS) -> str: ...


class Extractor(Protocol):
    """(markdown, note) of a document's bytes."""

    def extract(self, content: bytes, name: str) -> tuple[str, str | None]: ...


def unit(v: np.ndarray) -> np.ndarray | None:
    n = float(np.linalg.norm(v))
    return (v / n).astype(np.float32) if n > 0 else None


def post(url: str, body: dict, key: str | None, timeout: float) -> dict:
    headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
    with urlopen(Request(url, json.dumps(body).encode(), headers), timeout=timeout) as reply:
        return json.loads(reply.read())


class HttpEmbedder:
    """An embedding service: batches of 32, answers put in order by their index."""

    def __init__(self, url: str, model: str, dim: int, key: str | None = None, send: Callable = post):
        self.url, self.model, self.dim, self.key, self.send = url, model, dim, key, send

    def embed(self, texts: list[str]) -> list[np.ndarray | None]:
        out: list[np.ndarray | None] = []
        for lo in range(0, len(texts), BATCH):
            reply = self.send(self.url, {"model": self.model, "input": texts[lo : lo + BATCH]}, self.key, EMBED_TIMEOUT)
            ordered = sorted(reply["data"], key=lambda d: d["index"])
            out += [unit(np.asarray(d["embedding"], np.float32)) for d in ordered]
        return out


class WordPlaces(dict):
    """Word -> its place among ``dim`` negative ones and then ``dim`` positive ones, by its hash."""

    def __init__(self, dim: int):
        super().__init__()
        self.dim = dim

    def __missing__(self, word: str) -> int:
        h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
        if len(self) >= KNOWN_WORDS:
            self.clear()
        self[word] = at = h % self.dim + (self.dim if h >> 63 else 0)
        return at


@lru_cache(maxsize=1)
def word_places(dim: int) -> WordPlaces:
    """The table of this process, which outlives a batch."""
    return WordPlaces(dim)


class HashEmbedder:
    """Deterministic stand-in: signed hashes of words, summed and normalised."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, texts: list[str]) -> list[np.ndarray | None]:
        at, out = word_places(self.dim), []
        for text in texts:
            n = np.bincount(np.fromiter(map(at.__getitem__, text.lower().split()), np.int64), minlength=2 * self.dim)
            out.append(unit((n[self.dim :] - n[: self.dim]).astype(float)))
        return out


class HttpOcr:
    """A chat-style vision service: the image as a data address."""

    def __init__(self, url: str, model: str, key: str | None = None, send: Callable = post):
        self.url, self.model, self.key, self.send = url, model, key, send

    def infer_single(self, image: bytes, prompt: str = OCR_PROMPT, max_length: int = MAX_TOKENS) -> str:
        content = [{"type": "image_url", "image_url": {"url": "data:image/png;base64," + base64.b64encode(image).decode()}}, {"type": "text", "text": prompt}]
        body = {"model": self.model, "temperature": 0, "max_tokens": max_length, "messages": [{"role": "user", "content": content}]}
        return self.send(self.url, body, self.key, OCR_TIMEOUT)["choices"][0]["message"]["content"]


class StubOcr:
    """Deterministic stand-in: one tagged line with the digest of the image."""

    def infer_single(self, image: bytes, prompt: str = OCR_PROMPT, max_length: int = MAX_TOKENS) -> str:
        return f"text [0, 0, 100, 20]{hashlib.md5(image).hexdigest()}"[:max_length]


class MissingExtractor:
    """Stands where no office library is installed: every document fails with a note."""

    def extract(self, content: bytes, name: str) -> tuple[str, str | None]:
        return "", f"no engine for {name.rpartition('.')[2] or 'this file'}"


class MainText(HTMLParser):
    """Main text of a page: blocks of <article> or <main> where present, else of <body>; no chrome."""

    SKIP = frozenset({"script", "style", "nav", "footer", "header", "aside", "form", "noscript", "head", "svg"})
    BLOCK = frozenset({"p", "div", "li", "br", "tr", "section", "article", "main", "ul", "ol", "table", "blockquote", "pre", "h1", "h2", "h3", "h4", "h5", "h6"})

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.skip, self.inside, self.mark = [], 0, ""
        self.block, self.main, self.done = [], [], []

    def flush(self):
        text = " ".join("".join(self.block).split())
        if text:
            self.done.append(self.mark + text)
            if self.inside:
                self.main.append(self.mark + text)
        self.block, self.mark = [], ""

    def run(self, html: str) -> str:
        self.feed(html)
        self.close()
        self.flush()
        return "\n\n".join(self.main or self.done)

    def handle_starttag(self, tag, attrs):
        if tag in self.SKIP:
            self.skip.append(tag)
        if tag in self.BLOCK:
            self.flush()
            self.mark = "#" * int(tag[1]) + " " if tag[0] == "h" and tag[1:].isdigit() else "- " if tag == "li" else ""
        self.inside += tag in ("article", "main")

    def handle_endtag(self, tag):
        if tag in self.skip:
            del self.skip[len(self.skip) - 1 - self.skip[::-1].index(tag) :]
        if tag in self.BLOCK:
            self.flush()
        if tag in ("article", "main") and self.inside:
            self.inside -= 1

    def handle_data(self, data):
        if not self.skip:
            self.block.append(data)


def main_text(html: str) -> str:
    return MainText().run(html)


@F.pandas_udf(StringType())
def extracted(html: pd.Series) -> pd.Series:
    return html.map(main_text, na_action="ignore")


def embedded(embedder: Embedder, text: Column) -> Column:
    """Unit vectors of a text column; the engine is made once per worker and sees batches.

    Not deterministic for Spark, which else moves a filter on the vector below it and calls the engine there
    once more. Use the column by its name: an expression that repeats it repeats the calls.
    """

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(embedder.embed(part.fillna("").tolist()), index=part.index, dtype=object)

    return run.asNondeterministic()(text)


def recognised(engine: OcrEngine, image: Column, prompt: str = OCR_PROMPT) -> Column:
    """Raw OCR text of an image column."""

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(lambda b: engine.infer_single(bytes(b), prompt), na_action="ignore")

    return run(image)
