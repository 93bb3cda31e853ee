"""Secret scans with multipart credential linking.

Strong patterns (assignments, access identifiers, long hex) are reported
always. Weak candidates - opaque tokens that could be a secret, named
identifiers, and endpoints - are reported only where complementary parts meet:
their scopes, intervals of ``SCOPE`` code points around each part, are joined
within the document, sorted by place and searched, so that a text with many
parts costs n log n and never lists pairs.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from scholarlake.llm.tools import rows_out, texts

#: Patterns, kinds in the order in which spans with one start are listed.
ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ASSIGN_HINTS = ("passw", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
IDENTIFIER = re.compile(r"""(?:[Cc][Ll][Ii][Ee][Nn][Tt]|[Aa][Cc][Cc][Oo][Uu][Nn][Tt]|[Aa][Cc][Cc][Ee][Ss][Ss]|[Uu][Ss][Ee][Rr])_?(?:[Kk][Ee][Yy]_?)?(?:[Ii][Dd]|[Nn][Aa][Mm][Ee])["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]{4,})""")
IDENTIFIER_HINTS = ("client", "account", "access", "user")
ENDPOINT = re.compile(r"""(?:https?|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://[^\x00-\x20"'<>|]{4,}""")
OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}+={0,2}(?![A-Za-z0-9+/_=-])")
KINDS = ("assign", "access", "hex", "identifier", "endpoint", "opaque")
ACCESS_LENGTH, ASSIGN_LENGTH, SCOPE, ENTROPY = 20, 6, 400, 3.5

OUT_ARROW = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_linked", pa.int64())])

Span = tuple[int, int, int]  # start, kind's place in KINDS, end


def base_spans(text: str) -> list[Span]:
    out: list[Span] = []
    low = text.lower()
    if any(h in low for h in ASSIGN_HINTS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LENGTH]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LENGTH]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def entropy(token: str) -> float:
    n = len(token)
    return -sum(c / n * math.log2(c / n) for c in Counter(token).values())


def opaque(token: str) -> bool:
    """Whether a token of 20 or more characters looks random: mixed classes and high entropy, at any length."""
    return any(c.isdigit() for c in token) and any(c.isalpha() for c in token) and entropy(token) >= ENTROPY


def free_of(spans: list[Span], taken: list[Span]) -> list[Span]:
    """Spans that overlap none of ``taken``."""
    if not spans or not taken:
        return spans
    starts, ends = np.sort([t[0] for t in taken]), np.sort([t[2] for t in taken])
    return [s for s in spans if np.searchsorted(starts, s[2]) == np.searchsorted(ends, s[0], side="right")]


def meets(spans: list[Span], others: list[Span], scope: int) -> np.ndarray:
    """Which spans have a part of ``others`` whose interval starts or ends within ``scope``."""
    if not spans or not others:
        return np.zeros(len(spans), bool)
    starts, ends = np.sort([o[0] for o in others]), np.sort([o[2] for o in others])
    lo, hi = np.array([s[0] for s in spans]) - scope, np.array([s[2] for s in spans]) + scope
    return np.searchsorted(starts, hi, side="right") > np.searchsorted(ends, lo)


def linked_spans(text: str, base: list[Span], scope: int = SCOPE) -> list[Span]:
    """Weak candidates with their complement in scope.

    An opaque token needs an identifier or endpoint; a named identifier needs
    a secret (assignment, hex or opaque token); an endpoint needs both.
    """
    low = text.lower()
    identifiers = [(m.start(), 3, m.end()) for m in IDENTIFIER.finditer(text)] if any(h in low for h in IDENTIFIER_HINTS) else []
    endpoints = [(m.start(), 4, m.end()) for m in ENDPOINT.finditer(text)] if "://" in text else []
    identifiers = free_of(identifiers, base)
    names = identifiers + [s for s in base if s[1] == 1]
    if not names and not endpoints:
        return []
    tokens = free_of([(m.start(), 5, m.end()) for m in OPAQUE.finditer(text) if opaque(m[0])], base + endpoints)
    secrets = tokens + [s for s in base if s[1] != 1]
    if not secrets:
        return []
    by_name, by_secret = meets(endpoints, names, scope), meets(endpoints, secrets, scope)
    out = [e for e, a, b in zip(endpoints, by_name, by_secret) if a and b]
    out += [i for i, a in zip(identifiers, meets(identifiers, secrets, scope)) if a]
    near = meets(tokens, names, scope) | meets(tokens, endpoints, scope)
    return out + [t for t, a in zip(tokens, near) if a]


def named(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{start}:{end}" for start, k, end in spans)


def secrets(docs: DataFrame, scope: int = SCOPE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked.

    ``spans``: kind:start:end in code points, by start, then kind; base spans
    and linked ones. An unnamed token counts from 20 characters on, without an
    upper bound, if it looks random. A null or empty text has none. Each row stands alone:
    null ids, repeated rows and other columns change nothing.
    """
    docs = texts(docs, id_col=id_col, text_col=text_col)

    def row(doc_id: int | None, text: str) -> tuple:
        base = base_spans(text)
        linked = linked_spans(text, base, scope)
        n = Counter(s[1] for s in base)
        return doc_id, n[0], n[1], n[2], hashlib.sha256(named(base).encode()).hexdigest(), named(sorted(base + linked)), len(linked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from rows_out(OUT_ARROW, (row(i, t.as_py()) for i, t in zip(batch.column(0).to_pylist(), batch.column(1))))

    return docs.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_linked long")
