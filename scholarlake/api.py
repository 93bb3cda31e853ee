"""One function per read tool: DataFrames in, DataFrames out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarlake.functions.text import html_strip, slug, truncated
from scholarlake.operators import catalog, search
from scholarlake.plans.store import Store
from scholarlake.sources.engines import Embedder
from scholarlake.streaming import jobs

# Lengths of previews.
ABSTRACT, CHUNK, SIMILAR, NOTE, TEXT, COMMENT = 600, 500, 300, 200, 150, 120
NOTES_SHOWN = 5


def prepared(manifest: DataFrame) -> DataFrame:
    """(collection, total, ok)."""
    return manifest.groupBy("collection").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "ok").alias("ok"))


def counted(store: Store) -> DataFrame:
    """The same from the store's maintained counts: a row a collection and status, and a few changes since the last fold."""
    return store.read("counts").groupBy("collection").agg(F.sum("n").alias("total"), F.coalesce(F.sum(F.when(F.col("status") == "ok", F.col("n"))), F.lit(0)).alias("ok")).filter("total > 0")


def collections(tree: DataFrame, manifest: DataFrame) -> DataFrame:
    """The tree depth-first with the state of each collection, then packs that no collection has."""
    t = catalog.tree(tree)
    done = prepared(manifest)
    of = t.join(done.withColumnRenamed("collection", "of"), slug(F.col("name")) == slug(F.col("of")), "left")
    listed = of.select("key", "name", "depth", "num_items", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("ok", F.lit(0)).alias("ok"), F.col("total").isNotNull().alias("is_prepared"), "place")
    packs = done.filter(F.startswith(F.col("collection"), F.lit("adhoc:"))).select(F.col("collection").alias("name"), "total", "ok", F.lit(True).alias("is_prepared"))
    return listed.unionByName(packs, allowMissingColumns=True).orderBy(F.col("place").asc_nulls_last(), "name").drop("place")


def item(items: DataFrame, attachments: DataFrame, notes: DataFrame, item_key: str) -> dict[str, DataFrame]:
    """An item with its attachments and first notes."""
    preview = html_strip(F.col("html"), NOTE)
    return {
        "item": items.filter(F.col("item_key") == item_key).withColumn("abstract", F.substring("abstract", 1, ABSTRACT)),
        "attachments": attachments.filter(F.col("parent") == item_key).orderBy("att_ord"),
        "notes": notes.filter(F.col("item_key") == item_key).orderBy("ord").limit(NOTES_SHOWN).select("key", preview.alias("preview")),
    }


def annotations(rows: DataFrame, item_key: str, color: str | None = None, kind: str | None = None, n: int = 50) -> DataFrame:
    cut = lambda c, k: F.substring(c, 1, k).alias(c)
    return catalog.annotations(rows, item_key, color, kind, n).select("type", cut("text", TEXT), cut("comment", COMMENT), "color", "page_label", "modified")


def semantic_search(store: Store, embedder: Embedder, text: str, k: int = 8, collection: str | None = None) -> DataFrame:
    found = search.search(store.read("chunks", collection), embedder, text, k, collection)
    return found.select("title", "creator", "year", "page", "collection", "item_key", "source_file", F.substring("text", 1, CHUNK).alias("text"))


def find_similar(store: Store, item_key: str, k: int = 5) -> DataFrame:
    return search.similar_items(store.read("chunks"), item_key, k).withColumn("text", F.substring("text", 1, SIMILAR))


def manifest(store: Store, collection: str) -> DataFrame:
    return store.read("manifest", collection).orderBy("ord").select("item_key", "title", "creator", "year", "route", "pages", "chars", "status", "dir", "notes")


def read_item(store: Store, collection: str, needle: str) -> DataFrame:
    """Content of the first item whose title or folder contains ``needle``; without one, the titles."""
    entries = store.read("manifest", collection)
    hit = entries.filter(F.contains(F.col("title"), F.lit(needle)) | F.contains(F.col("dir"), F.lit(needle))).orderBy("ord").limit(1)
    if hit.isEmpty():
        return entries.orderBy("ord").select("item_key", "title", F.lit(None).cast("string").alias("text"))
    return hit.join(store.read("content", collection).select("item_key", "markdown"), "item_key", "left").select("item_key", "title", truncated(F.coalesce("markdown", F.lit(""))).alias("text"))


def content(store: Store, collection: str, item_key: str) -> DataFrame:
    return store.read("content", collection).filter(F.col("item_key") == item_key).select("markdown")


def meta(store: Store, collection: str, item_dir: str) -> DataFrame:
    return store.read("packs", collection).filter(F.col("dir") == item_dir).select("meta")


def packs(store: Store) -> DataFrame:
    """Packs of plain files with their counts."""
    return counted(store).filter(F.startswith(F.col("collection"), F.lit("adhoc:"))).orderBy("collection")


def job_status(queue: jobs.Jobs, job_id: str, lines: int = jobs.TOLD) -> dict[str, DataFrame]:
    events = queue.events().filter(F.col("job_id") == job_id)
    return {"job": jobs.latest(events), "log": jobs.ring(events.filter("msg != ''"), lines).orderBy("seq").select("ts", "msg")}


def job_list(queue: jobs.Jobs) -> DataFrame:
    return jobs.newest(jobs.latest(queue.events()))
