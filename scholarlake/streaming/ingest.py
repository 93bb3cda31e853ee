"""Structured Streaming: documents as they come, by the same delta as a batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from scholarlake.plans.prepare import Engines, run
from scholarlake.plans.store import Store


def ingest(spark: SparkSession, source: str, schema: str, each: Callable[[DataFrame, int], None], checkpoint: str, files_per_trigger: int = 100, once: bool = True, **options: str) -> StreamingQuery:
    """Feed new Parquet files below ``source`` to ``each(rows, batch)``, one batch at a time; the checkpoint remembers what is done.

    ``once`` works off what is there and stops. A batch may come again after a
    failure, so ``each`` must be idempotent, as `Store.upsert` and `delta` are.
    """
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", str(files_per_trigger)).options(**options).parquet(source)
    writer = rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


#: What a change record may carry; those without ``markdown`` are converted by the routes.
CHANGES = "item_key string, ord bigint, title string, creator string, year string, version bigint, source_mtime bigint, dir string, content_type string, ext string, name string, path string, url string, markdown string, deleted boolean"


def newest(changes: DataFrame) -> DataFrame:
    """One change a key, that of the largest version; of equal versions a deletion, then the largest text. Null keys are no items.

    The text is in the row once: the largest row is the newest one.
    """
    rank = [F.coalesce("version", F.lit(-1)).alias("rank"), F.coalesce("deleted", F.lit(False)).alias("gone"), F.coalesce("markdown", F.lit("")).alias("text"), F.col("markdown").isNotNull().alias("given")]
    row = F.struct(*rank, *[c for c in changes.columns if c not in ("item_key", "markdown")])
    last = changes.filter("item_key IS NOT NULL").groupBy("item_key").agg(F.max(row).alias("row")).select("item_key", "row.*")
    return last.withColumn("markdown", F.when(F.col("given"), F.col("text"))).select(*changes.columns)


def delta(store: Store, collection: str, engines: Engines, stream: str, told: Callable[[int, dict], None] | None = None) -> Callable[[DataFrame, int], None]:
    """The sink of a stream of changes (`CHANGES`) into one collection.

    Each batch is planned against the manifest, converted, and becomes one
    version of the store that carries the stream's name and the batch's number.
    A batch that comes again, after a crash on either side of the commit, is
    known by that mark and changes nothing.
    """

    def each(changes: DataFrame, batch: int) -> None:
        if store.snapshot().marks.get(stream, -1) >= batch:
            return
        out = run(store, collection, newest(changes), engines, partial=True, mark=(stream, batch))
        if told is not None:
            told(batch, out)

    return each
