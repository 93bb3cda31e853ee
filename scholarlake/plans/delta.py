"""The incremental planner: what to skip, convert and delete, from the last manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def planned(current: DataFrame, previous: DataFrame, have_content: DataFrame | None = None, rebuild: bool = False) -> DataFrame:
    """``current(item_key, version, source_mtime, ...)`` with ``action`` skip or convert.

    An item is skipped if its last status is ok, version and modification time
    are unchanged (two nulls are equal) and its content is still there.
    """
    old = previous.select("item_key", F.col("status").alias("old_status"), F.col("version").alias("old_version"), F.col("source_mtime").alias("old_mtime"))
    both = current.join(old, "item_key", "left")
    if have_content is not None:
        there = have_content.select("item_key", F.lit(True).alias("there")).distinct()
        both = both.join(there, "item_key", "left")
    else:
        both = both.withColumn("there", F.lit(True))
    same = (F.col("old_status") == "ok") & F.col("version").eqNullSafe(F.col("old_version")) & (F.col("source_mtime").isNull() | F.col("source_mtime").eqNullSafe(F.col("old_mtime"))) & F.coalesce("there", F.lit(False))
    skip = F.coalesce(same, F.lit(False)) & F.lit(not rebuild)
    return both.withColumn("action", F.when(skip, "skip").otherwise("convert")).drop("old_status", "old_version", "old_mtime", "there")


def stale(indexed: DataFrame, current: DataFrame, converted: DataFrame) -> DataFrame:
    """Keys whose chunks go: indexed but no longer there, or converted anew (even if now empty)."""
    return indexed.select("item_key").distinct().join(current.select("item_key"), "item_key", "left_anti").union(converted.select("item_key")).distinct()


def summary(counts: DataFrame, entries: DataFrame, n_chunks: int, elapsed: float) -> dict:
    """A run's counts(total, converted, skipped), those of its manifest entries, chunks and seconds."""
    found = entries.agg(F.count_if(F.col("status") == "empty").alias("empty"), F.count_if(F.col("route") == "ocr").alias("ocr_used"))
    return counts.first().asDict() | found.first().asDict() | {"chunks_indexed": n_chunks, "elapsed_sec": round(elapsed, 1)}
