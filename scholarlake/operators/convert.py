"""Documents to page-labelled Markdown: routing, and a converter for each route."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from urllib.request import Request, urlopen

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from scholarlake.functions.text import DROPPED_KINDS, NEWLINES, OCR_LINE, empty_to_null, marked_page, page_label, py_strip
from scholarlake.operators.catalog import PDF_TYPES, SNAPSHOT_TYPES
from scholarlake.schemas import CONVERTED
from scholarlake.sources.engines import FETCH_TIMEOUT, Extractor, OcrEngine, extracted, main_text, recognised

# Pages sampled and characters a page that make a PDF `text`; extensions by route.
SAMPLED_PAGES, TEXT_CHARS = 10, 200
HTML_EXTS, TEXT_EXTS = (".html", ".htm", ".xhtml"), (".txt", ".md", ".markdown", ".csv")


def classified(pages: DataFrame) -> DataFrame:
    """(doc_id, pdf_class) of pages(doc_id, page from 0, text): `text` or `ocr` by the mean of the first pages; see `with_class` for documents without pages."""
    mean = F.avg(F.length(py_strip(F.col("text"))))
    return pages.filter(F.col("page") < SAMPLED_PAGES).groupBy("doc_id").agg(F.when(mean >= TEXT_CHARS, "text").otherwise("ocr").alias("pdf_class"))


def with_class(docs: DataFrame, pages: DataFrame) -> DataFrame:
    return docs.join(classified(pages), "doc_id", "left").withColumn("pdf_class", F.coalesce("pdf_class", F.lit("text")))


def route(content_type: Column, ext: Column, pdf_class: Column, url: Column, local: Column | None = None) -> Column:
    """Route of an attachment: text or ocr for PDFs, html, plain, office, web, else empty."""
    there = F.lit(True) if local is None else local.isNotNull()
    ext = F.lower(F.coalesce(ext, F.lit("")))
    return (
        F.when(there & (content_type.isin(*PDF_TYPES) | (ext == ".pdf")), pdf_class)
        .when(there & (ext.isin(*HTML_EXTS) | content_type.isin(*SNAPSHOT_TYPES)), "html")
        .when(there & ext.isin(*TEXT_EXTS), "plain")
        .when(there & (ext != ""), "office")
        .when(F.length(url) > 0, "web")
        .otherwise("empty")
    )


def ordered_blocks(blocks: DataFrame) -> DataFrame:
    """(doc_id, page, text): text blocks (type 0, not blank) of a page by (y to 0.1, x)."""
    kept = blocks.filter((F.col("type") == 0) & (py_strip(F.col("text")) != ""))
    rows = F.array_sort(F.collect_list(F.struct(F.round("y0", 1).alias("y"), F.col("x0").alias("x"), py_strip(F.col("text")).alias("t"))))
    return kept.groupBy("doc_id", "page").agg(F.array_join(F.transform(rows, lambda r: r["t"]), "\n\n").alias("text"))


def assembled(pages: DataFrame, route_name: str = "text") -> DataFrame:
    """Converted rows from pages(doc_id, page, label, text); blank pages have no marker but count."""
    label = page_label(F.col("label"), F.col("page"))
    body = py_strip(F.coalesce("text", F.lit("")))
    row = F.struct("page", label.alias("label"), body.alias("body"))
    both = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(row)).alias("p"))
    text = F.array_join(F.transform(F.filter("p", lambda r: r["body"] != ""), lambda r: marked_page(r["label"], r["body"])), "\n\n")
    return both.select(F.col("doc_id").cast("string").alias("item_key"), py_strip(text).alias("markdown"), F.lit(route_name).alias("route"), F.size("p").alias("pages"), F.transform("p", lambda r: r["label"]).alias("page_labels"), F.array().cast("array<string>").alias("notes"))


def ocr_lines(raw: DataFrame) -> DataFrame:
    """(doc_id, page, pos, kind, box, text) of raw(doc_id, page, raw): tagged lines with what continues them.

    What comes before the first tagged line is dropped.
    """
    lines = raw.select("doc_id", "page", F.posexplode(F.split("raw", NEWLINES, -1)).alias("pos", "line")).withColumn("line", py_strip(F.col("line")))
    part = lambda i: F.regexp_extract("line", OCR_LINE, i)
    tagged = lines.withColumn("kind", empty_to_null(part(1)))
    box = F.struct(*[F.try_to_number(part(i + 2), F.lit("S999999")).cast("int").alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))])
    tagged = tagged.withColumn("box", F.when(F.col("kind").isNotNull(), box)).withColumn("text", F.when(F.col("kind").isNotNull(), py_strip(part(6))).otherwise(F.col("line")))
    head = F.max(F.when(F.col("kind").isNotNull(), F.col("pos"))).over(Window.partitionBy("doc_id", "page").orderBy("pos"))
    kept = tagged.filter("kind is not null or text != ''").withColumn("head", head).filter("head is not null")
    rows = kept.groupBy("doc_id", "page", "head").agg(F.max("kind").alias("kind"), F.max("box").alias("box"), F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("r"))
    return rows.select("doc_id", "page", F.col("head").cast("long").alias("pos"), "kind", "box", F.array_join(F.transform("r", lambda x: x["text"]), " ").alias("text"))


def folded(lines: DataFrame, starts: Column, key: str = "doc_id", order: str = "pos", text: str = "text") -> DataFrame:
    """(key, block, n, text): lines that start no block continue the one before; those before the first block go."""
    block = F.sum(starts.cast("long")).over(Window.partitionBy(key).orderBy(order))
    rows = lines.withColumn("block", block).filter("block > 0").groupBy(key, "block").agg(F.array_sort(F.collect_list(F.struct(order, text))).alias("r"))
    return rows.select(key, "block", F.size("r").cast("long").alias("n"), F.array_join(F.transform("r", lambda x: x[text]), " ").alias("text"))


def ocr_pages(lines: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, page, label, text, note): Markdown of OCR lines; a printed page number overrides the label."""
    kept = lines.filter("text != ''")
    row = F.struct("pos", F.when(F.col("kind") == "title", F.concat(F.lit("## "), "text")).otherwise(F.col("text")).alias("t"))
    body = F.collect_list(F.when(~F.col("kind").isin(*DROPPED_KINDS), row))
    number = F.max_by(F.when(F.col("kind") == "page_number", F.col("text")), F.when(F.col("kind") == "page_number", F.col("pos")))
    pages = kept.groupBy("doc_id", "page").agg(F.array_join(F.transform(F.array_sort(body), lambda r: r["t"]), "\n\n").alias("text"), number.alias("detected"))
    out = labels.join(pages, ["doc_id", "page"], "left")
    known = page_label(F.col("label"), F.col("page"))
    note = F.when(F.col("detected") != known, F.concat(F.lit("p"), (F.col("page") + 1).cast("string"), F.lit(": OCR "), F.col("detected"), F.lit(" ("), known, F.lit(")")))
    return out.select("doc_id", "page", F.coalesce("detected", known).alias("label"), F.coalesce("text", F.lit("")).alias("text"), note.alias("note"))


def ocr_converted(images: DataFrame, engine: OcrEngine) -> DataFrame:
    """Converted rows of images(doc_id, page, label, image): an OCR stage of its own partitions, one engine a worker."""
    raw = images.repartition("doc_id", "page").select("doc_id", "page", recognised(engine, F.col("image")).alias("raw"))
    pages = ocr_pages(ocr_lines(raw), images.select("doc_id", "page", "label"))
    notes = pages.filter("note is not null").groupBy("doc_id").agg(F.array_sort(F.collect_list("note")).alias("n"))
    return assembled(pages, "ocr").join(notes.select(F.col("doc_id").cast("string").alias("item_key"), "n"), "item_key", "left").withColumn("notes", F.coalesce("n", "notes")).drop("n")


def decoded(content: Column) -> Column:
    """UTF-8 text, bytes that do not decode dropped."""

    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda b: bytes(b).decode("utf-8", "ignore"), na_action="ignore")

    return run(content)


def whole(rows: DataFrame, markdown: Column, route_name: str, note: Column | None = None) -> DataFrame:
    """Converted rows of documents without pages."""
    none = F.array().cast("array<string>")
    notes = none if note is None else F.when(note.isNotNull(), F.array(note)).otherwise(none)
    text = F.coalesce(markdown, F.lit(""))
    return rows.select("item_key", text.alias("markdown"), F.when(text == "", "empty").otherwise(route_name).alias("route") if route_name != "text" else F.lit("text").alias("route"), F.lit(0).alias("pages"), none.alias("page_labels"), notes.alias("notes"))


def plain_converted(files: DataFrame) -> DataFrame:
    return whole(files, py_strip(decoded(F.col("content"))), "text")


def html_converted(pages: DataFrame) -> DataFrame:
    """pages(item_key, html): main text, else the page as it is; the route is `anydoc`."""
    return whole(pages, F.coalesce(empty_to_null(extracted(F.col("html"))), F.col("html")), "anydoc")


Fetch = Callable[[str], tuple[int, str]]


def http_get(url: str) -> tuple[int, str]:
    with urlopen(Request(url, headers={"User-Agent": "scholarlake"}), timeout=FETCH_TIMEOUT) as reply:
        return reply.status, reply.read().decode("utf-8", "ignore")


def web_converted(rows: DataFrame, fetch: Fetch = http_get) -> DataFrame:
    """rows(item_key, url): fetched main text; any failure is an empty document with a note."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, notes = [], []
            for url in batch["url"]:
                try:
                    code, body = fetch(url)
                    texts.append(main_text(body) if code == 200 else "")
                    notes.append(None if code == 200 else f"HTTP {code}")
                except Exception as e:  # a fetch may fail in any way, and the note tells
                    texts.append("")
                    notes.append(f"{type(e).__name__}: {e}"[:200])
            yield pd.DataFrame({"item_key": batch["item_key"], "markdown": texts, "note": notes})

    return whole(rows.select("item_key", "url").mapInPandas(run, "item_key string, markdown string, note string"), F.col("markdown"), "web", F.col("note"))


def office_converted(files: DataFrame, extractor: Extractor) -> DataFrame:
    """files(item_key, name, content) through an office engine."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [extractor.extract(bytes(c or b""), n) for c, n in zip(batch["content"], batch["name"])]
            yield pd.DataFrame({"item_key": batch["item_key"], "markdown": [m for m, _ in made], "note": [n for _, n in made]})

    return whole(files.select("item_key", "name", "content").mapInPandas(run, "item_key string, markdown string, note string"), F.col("markdown"), "anydoc", F.col("note"))


def nothing(rows: DataFrame, note: str = "no usable attachment") -> DataFrame:
    return whole(rows, F.lit(""), "empty", F.lit(note))


def converted_schema() -> StructType:
    return StructType.fromDDL(CONVERTED)
