"""Command line: ``prepare`` files, or ``sync`` a collection of the catalog, into the store; ``search`` it.

Engines come from the environment or a ``.env`` file: EMBED_API_URL,
EMBED_MODEL, EMBED_DIM and EMBED_API_KEY for an embedding service (without one,
hashed words stand in), OCR_API_URL, OCR_MODEL and OCR_API_KEY for OCR,
CATALOG_URL, CATALOG_DATA_DIR and CATALOG_LINKED_BASE for the catalog; where
the two folders are not named, CATALOG_PROFILES may name the folder of profiles
that say them. ``--pdf-pages`` and ``--pdf-images`` name functions of one's own
(`module:function`) that give the text layer and the page images of PDF files.
"""

from __future__ import annotations

import argparse
import importlib
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholarlake import api
from scholarlake.config import load_env, ocr_backend, profile_prefs
from scholarlake.functions.text import slug
from scholarlake.operators import catalog
from scholarlake.plans.prepare import Engines, file_records, item_records, run
from scholarlake.plans.store import Store
from scholarlake.sources import catalog as rest
from scholarlake.sources.engines import Embedder, HashEmbedder, HttpEmbedder, HttpOcr, OcrEngine
from scholarlake.sources.files import fingerprints, scan_files


def engines(env: dict[str, str], use_ocr: bool = True) -> tuple[Embedder, str, OcrEngine | None]:
    """(embedder, its model's name, OCR engine or none) as the environment names them."""
    if env.get("EMBED_API_URL"):
        model = env.get("EMBED_MODEL", "")
        embedder: Embedder = HttpEmbedder(env["EMBED_API_URL"], model, int(env.get("EMBED_DIM", "1024")), env.get("EMBED_API_KEY"))
    else:
        embedder, model = HashEmbedder(), "hash"
    ocr = HttpOcr(env["OCR_API_URL"], env.get("OCR_MODEL", ""), env.get("OCR_API_KEY")) if use_ocr and env.get("OCR_API_URL") and ocr_backend(env) == "http" else None
    return embedder, model, ocr


def hook(name: str | None) -> Callable[[DataFrame], DataFrame] | None:
    """The function that ``module:function`` names."""
    if name is None:
        return None
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def collection_records(spark: SparkSession, env: dict[str, str], name: str, limit: int | None, fetch: rest.Fetch | None = None):
    """(name, records) of the catalog's collection that ``name`` means, with those below it."""
    rest.register_catalog(spark, fetch)
    source = spark.read.format("catalog").option("base_url", env.get("CATALOG_URL", ""))
    tops = rest.collections(source.option("path", "collections").load())
    found = catalog.resolve(tops, name).first()
    if found is None:
        raise SystemExit(f"no collection is called {name}")
    keys = sorted(r.key for r in catalog.descendants(tops, found.key).collect())
    raw = source.option("collections", ",".join(keys)).load().cache()
    said = profile_prefs(env["CATALOG_PROFILES"]) if env.get("CATALOG_PROFILES") else {}
    attached = catalog.located(rest.attachments(raw), env.get("CATALOG_DATA_DIR") or said.get("data_dir", ""), env.get("CATALOG_LINKED_BASE") or said.get("linked_base"))
    # One path an attachment: the catalog's own size.
    files = fingerprints(spark, [r.local for r in attached.filter("local is not null").select("local").distinct().collect()]).filter("mtime is not null")
    once = catalog.once(rest.items(raw), "item_key", "ord", "collection", "ord", "title", "creators", "year", "version").drop("collections")
    return found.name, item_records(once, attached, files, limit)


def main(args: list[str] | None = None, spark: SparkSession | None = None, env: dict[str, str] | None = None, fetch: rest.Fetch | None = None) -> int:
    parser = argparse.ArgumentParser(prog="scholarlake")
    parser.add_argument("--root", default="scholarlake-store")
    commands = parser.add_subparsers(dest="command", required=True)
    p = commands.add_parser("prepare")
    p.add_argument("name")
    p.add_argument("paths", nargs="+")
    p.add_argument("--limit", type=int)
    p.add_argument("--no-ocr", action="store_true")
    p.add_argument("--rebuild", action="store_true")
    p.add_argument("--flat", action="store_true", help="do not enter folders")
    c = commands.add_parser("sync")
    c.add_argument("collection", help="key, name or part of the name")
    c.add_argument("--limit", type=int)
    c.add_argument("--no-ocr", action="store_true")
    c.add_argument("--rebuild", action="store_true")
    for one in (p, c):
        one.add_argument("--pdf-pages", metavar="MODULE:FUNCTION", help="files(item_key, path) to pages(doc_id, page, label, text)")
        one.add_argument("--pdf-images", metavar="MODULE:FUNCTION", help="files(item_key, path) to images(doc_id, page, label, image), for OCR")
    s = commands.add_parser("search")
    s.add_argument("text")
    s.add_argument("--collection")
    s.add_argument("--top-k", type=int, default=8)
    a = parser.parse_args(args)
    spark = spark or SparkSession.builder.appName("scholarlake").getOrCreate()
    load_env(".env")
    env = dict(os.environ) if env is None else env
    store = Store(spark, a.root)
    embedder, model, ocr = engines(env, not getattr(a, "no_ocr", False))
    if a.command in ("prepare", "sync"):
        if a.command == "prepare":
            records = file_records(scan_files(spark, a.paths, not a.flat))
            if a.limit is not None:
                records = records.orderBy("path").limit(a.limit)
            name = spark.range(1).select(F.concat(F.lit("adhoc:"), slug(F.lit(a.name), 80)).alias("name")).first().name
        else:
            title, records = collection_records(spark, env, a.collection, a.limit, fetch)
            name = spark.range(1).select(slug(F.lit(title)).alias("name")).first().name
        print(run(store, name, records, Engines(embedder, ocr=ocr, model=model, pdf_pages=hook(a.pdf_pages), pdf_images=hook(a.pdf_images)), rebuild=a.rebuild, partial=a.limit is not None, progress=lambda what, detail: print(f"{what}: {detail}")))
    else:
        for r in api.semantic_search(store, embedder, a.text, a.top_k, a.collection).collect():
            print(f"{r.title} [p.{r.page or '-'}] {r.collection}\n  {r.text[:200]}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
