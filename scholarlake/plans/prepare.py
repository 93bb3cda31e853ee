"""The two pipelines: a collection of the catalog, or any files, to content, manifest and chunks."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarlake.checkpoints import removed, written
from scholarlake.functions.text import creator_summary, item_dir, slug, status_of
from scholarlake.operators import convert
from scholarlake.operators.catalog import picked, with_existence
from scholarlake.operators.chunks import chunk_rows
from scholarlake.plans.delta import planned, stale, summary
from scholarlake.plans.store import CODEC, Store
from scholarlake.sources.engines import Embedder, Extractor, MissingExtractor, OcrEngine
from scholarlake.sources.files import with_content

Progress = Callable[[str, dict], None]


class Engines:
    """What a pipeline is given: all but the embedder may be missing."""

    def __init__(self, embedder: Embedder, ocr: OcrEngine | None = None, extractor: Extractor | None = None, fetch: convert.Fetch = convert.http_get, pdf_pages: Callable[[DataFrame], DataFrame] | None = None, pdf_images: Callable[[DataFrame], DataFrame] | None = None, model: str = ""):
        self.embedder, self.ocr, self.extractor, self.fetch = embedder, ocr, extractor or MissingExtractor(), fetch
        #: files(item_key, path) -> pages(doc_id, page, label, text) and images(doc_id, page, label, image).
        self.pdf_pages, self.pdf_images, self.model = pdf_pages, pdf_images, model


def converted(todo: DataFrame, engines: Engines) -> DataFrame:
    """Converted rows of todo(item_key, content_type, ext, name, path, url): each route its own branch, OCR last."""
    pdf = todo.filter((F.lower("ext") == ".pdf") | (F.col("content_type") == "application/pdf"))
    if engines.pdf_pages is not None:
        pages = engines.pdf_pages(pdf.select("item_key", "path"))
        classed = convert.with_class(todo.withColumn("doc_id", F.col("item_key")), pages).drop("doc_id")
    else:
        pages, classed = None, todo.withColumn("pdf_class", F.lit("ocr"))
    routed = classed.withColumn("way", convert.route(F.col("content_type"), F.col("ext"), F.col("pdf_class"), F.col("url"), F.col("path")))
    of = lambda *ways: routed.filter(F.col("way").isin(*ways))
    read = lambda *ways: with_content(of(*ways).select("item_key", "name", "path"))
    parts = [
        convert.plain_converted(read("plain")),
        convert.html_converted(read("html").withColumn("html", convert.decoded(F.col("content")))),
        convert.office_converted(read("office"), engines.extractor),
        convert.web_converted(of("web"), engines.fetch),
        convert.nothing(of("empty")),
    ]
    if pages is not None:
        parts.append(convert.assembled(pages.join(of("text").select(F.col("item_key").alias("doc_id")), "doc_id", "left_semi")))
    if engines.ocr is not None and engines.pdf_images is not None:
        parts.append(convert.ocr_converted(engines.pdf_images(of("ocr").select("item_key", "path")), engines.ocr))
    else:
        parts.append(convert.nothing(of("ocr"), "a scanned document, and no OCR engine"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


#: What entries and chunks take from the records.
ABOUT = ("ord", "title", "creator", "year", "version", "source_mtime", "dir", "name")


def measured(rows: DataFrame) -> DataFrame:
    """``chars`` and ``content_hash`` of the texts, so that nothing that needs these alone reads a text again."""
    return rows.withColumn("chars", F.length("markdown").cast("long")).withColumn("content_hash", F.md5(F.col("markdown").cast("binary")))


def to_do(plan: DataFrame) -> DataFrame:
    """A plan with the action `drop` for deleted records, and ``markdown`` of what is to be converted alone; ``given``: it has one."""
    gone = F.coalesce("deleted", F.lit(False)) if "deleted" in plan.columns else F.lit(False)
    text = F.col("markdown") if "markdown" in plan.columns else F.lit(None).cast("string")
    out = plan.withColumn("action", F.when(gone, "drop").otherwise(F.col("action"))).drop("deleted")
    return measured(out.withColumn("markdown", F.when(F.col("action") == "convert", text))).withColumn("given", F.col("markdown").isNotNull())


def as_given(todo: DataFrame) -> DataFrame:
    """Converted rows, with their attributes, of records that carry their text."""
    none = F.array().cast("array<string>")
    return todo.select("item_key", "markdown", F.lit("text").alias("route"), F.lit(0).alias("pages"), none.alias("page_labels"), none.alias("notes"), *ABOUT, "chars", "content_hash")


def run(
    store: Store,
    collection: str,
    records: DataFrame,
    engines: Engines,
    rebuild: bool = False,
    partial: bool = False,
    progress: Progress | None = None,
    mark: tuple[str, int] | None = None,
) -> dict:
    """Bring a collection up to date with records(item_key, ord, title, creator, year, version, source_mtime, dir, content_type, ext, name, path, url).

    Records may also have ``markdown``, their text where no route is to convert
    them, and ``deleted``, which drops the item. ``partial``: the records are
    not all of the collection, so nothing else is dropped. All tables change in
    one version, or none does; ``mark``: the batch of a stream that it is, which
    a store takes once. Every key that is converted anew loses its old chunks.
    Converted rows are written once, so that a lost executor converts nothing
    again that chunks were made of; given texts are written with the plan and
    read from there, without another join. Every chunk is embedded once, and
    routes are planned only for records that need one.
    """
    began, tell = time.time(), progress or (lambda what, detail: None)
    with store.transaction() as t:
        old = t.read("manifest", collection)
        plan = written(to_do(planned(records, old, t.read("content", collection), rebuild)), CODEC)
        todo = plan.filter("action = 'convert'")
        n = todo.agg(F.count("*").alias("convert"), F.count_if(~F.col("given")).alias("routed")).first()
        tell("planned", {"convert": n.convert})
        done, made = as_given(todo.filter("given")), None
        if n.routed:
            routed = todo.filter("NOT given").drop("markdown", "chars", "content_hash")
            made = written(measured(converted(routed, engines).join(routed.select("item_key", *ABOUT), "item_key")), CODEC)
            done = made.unionByName(done)
        done = done.withColumn("collection", F.lit(collection)).withColumn("source_file", F.col("name"))
        tell("converted", {"items": done.count()})
        entries = done.select("collection", "item_key", "dir", "title", "creator", "year", "route", F.col("pages").cast("long").alias("pages"), "chars", status_of(F.col("chars")).alias("status"), "notes", "version", "source_mtime", "content_hash", "ord")
        meta = F.to_json(F.struct("item_key", "title", "creator", "year", "source_file", F.struct("route", "pages", "page_labels", F.col("chars").alias("char_count"), "notes").alias("conversion")))
        if partial:
            removed_keys = plan.filter("action = 'drop'").select("item_key")
            gone = done.select("item_key").union(removed_keys)
        else:
            current = plan.filter("action <> 'drop'").select("item_key")
            removed_keys = old.select("item_key").join(current, "item_key", "left_anti")
            gone = stale(t.read("chunks", collection).select("item_key").distinct(), current, done)
        rows = chunk_rows(done, engines.embedder, engines.model)
        if rebuild and not partial:
            t.drop("chunks", collection)
        else:
            # All keys of the new chunks are among these; taking them from the chunks would embed every chunk once more.
            t.delete("chunks", collection, gone)
        n_chunks = t.add("chunks", collection, rows)
        t.upsert("content", collection, done.select("collection", "item_key", "dir", "markdown"), removed_keys)
        t.upsert("packs", collection, done.select("collection", "item_key", "dir", meta.alias("meta")), removed_keys)
        t.entries(collection, entries, removed_keys)
        if mark is not None:
            t.mark(*mark)
        counts = plan.filter("action <> 'drop'").agg(F.count("*").alias("total"), F.count_if(F.col("action") == "convert").alias("converted"), F.count_if(F.col("action") == "skip").alias("skipped"))
        out = summary(counts, entries, n_chunks, time.time() - began)
    for table in ("chunks", "content", "packs", "manifest", "counts"):
        store.compact(table, collection)
    tell("done", out)
    removed(plan, made)
    return out


def item_records(items: DataFrame, attachments: DataFrame, files: DataFrame, limit: int | None = None) -> DataFrame:
    """Records of catalog items with their picked attachment: attachments(parent, key, ..., local), files(path, mtime)."""
    best = picked(with_existence(attachments, files))
    there = best.join(files.select(F.col("path").alias("local"), "mtime").distinct(), "local", "left")
    if limit is not None:
        items = items.orderBy("ord").limit(limit)
    both = items.join(there.select(F.col("parent").alias("item_key"), "content_type", F.col("filename").alias("name"), "local", F.col("url").alias("att_url"), "mtime", "exists"), "item_key", "left")
    who = creator_summary(F.col("creators"))
    ext = F.lower(F.regexp_extract(F.coalesce("name", F.lit("")), r"(\.[^.]+)$", 1))
    return both.select("item_key", "ord", "title", who.alias("creator"), "year", "version", F.col("mtime").alias("source_mtime"), item_dir(who, F.col("year"), F.col("title")).alias("dir"), "content_type", ext.alias("ext"), "name", F.when(F.col("exists"), F.col("local")).alias("path"), F.col("att_url").alias("url"))


def file_records(files: DataFrame) -> DataFrame:
    """Records of plain files: the key is the path's, the title the stem."""
    stem = F.regexp_replace("name", r"\.[^.]+$", "")
    none = F.lit(None).cast("string")
    by_path = F.xxhash64("path")
    return files.select("item_key", by_path.alias("ord"), stem.alias("title"), F.lit("").alias("creator"), none.alias("year"), F.lit(None).cast("long").alias("version"), F.col("mtime").alias("source_mtime"), F.concat_ws("_", slug(stem, 70), "item_key").alias("dir"), none.alias("content_type"), "ext", "name", "path", none.alias("url"))
