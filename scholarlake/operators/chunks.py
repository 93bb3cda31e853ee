"""Markdown to chunk rows: page pieces, overlapping windows, embeddings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholarlake.functions.text import page_pieces, py_strip, windows
from scholarlake.functions.vectors import checked
from scholarlake.sources.engines import Embedder, embedded


def chunked(docs: DataFrame, markdown: Column | str = "markdown", *keep: str) -> DataFrame:
    """One row a chunk: ``keep`` columns, page, page_ord, window_ord, text. No shuffle: all from one row."""
    md = F.col(markdown) if isinstance(markdown, str) else markdown
    pieces = docs.select(*keep, F.posexplode(page_pieces(md)).alias("page_ord", "piece"))
    bodies = pieces.select(*keep, F.col("page_ord").cast("long").alias("page_ord"), "piece.page", py_strip(F.col("piece.body")).alias("body")).filter("body != ''")
    cut = bodies.select(*keep, "page_ord", "page", F.posexplode(windows(F.col("body"))).alias("window_ord", "text"))
    return cut.withColumn("window_ord", F.col("window_ord").cast("long")).filter(py_strip(F.col("text")) != "")


def chunk_rows(converted: DataFrame, embedder: Embedder, model: str = "") -> DataFrame:
    """Vector rows of converted items (with title, creator, year, collection, source_file); chunks without a direction are left out."""
    keep = ("item_key", "title", "creator", "year", "collection", "source_file")
    rows = chunked(converted, "markdown", *keep).withColumn("vector", embedded(embedder, F.col("text")))
    vector = checked(F.col("vector"), embedder.dim)
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return rows.select(vector.alias("vector"), "text", blank("page"), "item_key", blank("title"), blank("creator"), blank("year"), "collection", blank("source_file"), "page_ord", "window_ord", F.lit(model).alias("model")).filter("vector is not null")
