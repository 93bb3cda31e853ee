"""Text expressions: trimming, slugs, page markers, chunk windows, OCR lines. All are built-in columns but NFKC."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Chunk widths, page marker, OCR line format and kinds, slug characters.
CHUNK_WIDTH, CHUNK_STEP, WHOLE_LIMIT = 900, 780, 1350
MARKER = r"\*\*\[p\.([^\]]+)\]\*\*"
MARKER_SPLIT = r"\*\*\[p\.[^\]]+\]\*\*"
OCR_LINE = r"^([a-z_]+)\s*\[(-?\d+),\s*(-?\d+),\s*(-?\d+),\s*(-?\d+)\](.*)$"
DROPPED_KINDS = ("header", "footer", "page_number", "aside_text")
UNSAFE = r'[\\/:*?"<>|]+'
WHITE = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
NEWLINES = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\u0085  ]"
UNTITLED, ANONYMOUS, NO_YEAR, AND_OTHERS = "untitled", "佚名", "无年份", " 等("


def py_strip(x: Column) -> Column:
    """Trim all Unicode white space, as Python's ``str.strip``."""
    return F.btrim(x, F.lit(WHITE))


def empty_to_null(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


@F.pandas_udf(StringType())
def nfkc(x: pd.Series) -> pd.Series:
    return x.map(lambda s: unicodedata.normalize("NFKC", s), na_action="ignore")


def slug_of(x: Column, width: int = 60) -> Column:
    """Slug of NFKC-normalised text: unsafe runs to a space, white space to ``_``, cut, default `untitled`."""
    spaced = py_strip(F.regexp_replace(x, UNSAFE, " "))
    cut = F.substring(F.regexp_replace(spaced, r"\s+", "_"), 1, width)
    return F.coalesce(empty_to_null(F.btrim(cut, F.lit("_"))), F.lit(UNTITLED))


def slug(x: Column, width: int = 60) -> Column:
    return slug_of(nfkc(x), width)


def item_dir(creator: Column, year: Column, title: Column) -> Column:
    """<creator>_<year>_<slug of the title>."""
    who = F.coalesce(empty_to_null(F.substring(F.replace(creator, F.lit(" "), F.lit("")), 1, 20)), F.lit(ANONYMOUS))
    return F.concat_ws("_", who, F.coalesce(empty_to_null(year), F.lit(NO_YEAR)), slug(title))


def stable_key(path: Column) -> Column:
    return F.concat(F.lit("adh"), F.substring(F.md5(path.cast("binary")), 1, 12))


def html_strip(x: Column, width: int | None = None) -> Column:
    """Tags to spaces, optionally cut."""
    plain = F.regexp_replace(x, r"<[^>]+>", " ")
    return F.substring(plain, 1, width) if width else plain


def safe_name(x: Column) -> Column:
    return F.replace(F.replace(F.replace(x, F.lit("/"), F.lit("_")), F.lit("\\"), F.lit("_")), F.lit(".."), F.lit("_"))


def truncated(x: Column, width: int = 200_000) -> Column:
    """The first ``width`` code points, with a note of the full length where cut."""
    note = F.concat(F.substring(x, 1, width), F.lit("\n\n…（已截断，全文 "), F.length(x).cast("string"), F.lit(" 字符）"))
    return F.when(F.length(x) > width, note).otherwise(x)


def page_label(label: Column, index: Column) -> Column:
    """The printed label, else the physical number (index + 1)."""
    return F.coalesce(empty_to_null(label), (index + 1).cast("string"))


def marked_page(label: Column, body: Column) -> Column:
    return F.concat(F.lit("**[p."), label, F.lit("]**\n\n"), body)


def page_pieces(markdown: Column) -> Column:
    """array<struct<page, body>>: text between page markers, with the label in force; blank pieces stay."""
    bodies = F.split(markdown, MARKER_SPLIT, -1)
    labels = F.concat(F.array(F.lit("")), F.regexp_extract_all(markdown, F.lit(MARKER), F.lit(1)))
    return F.zip_with(labels, bodies, lambda page, body: F.struct(page.alias("page"), body.alias("body")))


def windows(body: Column) -> Column:
    """Overlapping windows of a trimmed text: whole up to the limit, else every ``CHUNK_STEP`` characters.

    A step looks ahead at its window, so that a long text is not counted from its start for each of them.
    """
    cut = F.regexp_extract_all(body, F.lit(f"(?s)(?=(.{{1,{CHUNK_WIDTH}}})).{{1,{CHUNK_STEP}}}"), F.lit(1))
    return F.when(F.length(body) <= WHOLE_LIMIT, F.array(body)).otherwise(cut)


def creator_summary(creators: Column) -> Column:
    """"" for none, the name for one, else the first and the number: last name, else name."""
    name = lambda c: F.coalesce(empty_to_null(c["lastName"]), empty_to_null(c["name"]), F.lit(""))
    first = name(F.get(creators, F.lit(0)))
    n = F.coalesce(F.size(creators), F.lit(0))
    return F.when(n == 0, "").when(n == 1, first).otherwise(F.concat(first, F.lit(AND_OTHERS), n.cast("string"), F.lit(")")))


def year_of(date: Column) -> Column:
    return empty_to_null(F.substring(date, 1, 4))


def status_of(chars: Column) -> Column:
    return F.when(chars > 0, "ok").otherwise("empty")
