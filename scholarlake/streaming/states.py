"""The state of every job as a keyed stream: transitions, a bounded log and a timer for what waits."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from scholarlake.streaming.jobs import KEPT

# What a job may become; no entry: it is over.
NEXT = {"": ("queued",), "queued": ("deferred", "running", "error", "cancelled"), "deferred": ("queued", "running", "error", "cancelled"), "running": ("done", "error", "cancelled")}
EVENTS = "job_id string, status string, msg string, seq long"
STATES = "job_id string, status string, last long, illegal long, kept long, oldest long"
#: Keyed state needs RocksDB; batches without data, which timers ask for again and again, would keep a stream that works off what is there from ending.
SETTINGS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.noDataMicroBatches.enabled": "false"}


class JobState(StatefulProcessor):
    """One job: its status by legal transitions, how many were not, and its last ``kept`` messages.

    Events of a batch are taken in order of seq; one that is not beyond the
    last seen is a repetition. A job that is deferred is queued again after
    ``retry_ms``.
    """

    def __init__(self, kept: int = KEPT, retry_ms: int = 3_600_000):
        self.kept, self.retry_ms = kept, retry_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "status string, last long, seen long, illegal long")
        self.log = handle.getListState("log", "seq long, msg string")

    def told(self, key: tuple, log: list[tuple]) -> pd.DataFrame:
        status, last, _, illegal = self.job.get()
        return pd.DataFrame({"job_id": [key[0]], "status": [status], "last": [last], "illegal": [illegal], "kept": [len(log)], "oldest": [log[0][0] if log else -1]})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        status, last, seen, illegal = self.job.get() or ("", -1, -1, 0)
        new = [r for part in rows for r in zip(part["seq"], part["status"], part["msg"])]
        log = list(self.log.get())
        for seq, to, msg in sorted(new, key=lambda r: r[0]):
            if seq <= seen:
                continue
            seen = int(seq)
            if to is not None:
                if to in NEXT.get(status, ()):
                    status, last = to, seen
                    if to == "deferred":
                        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.retry_ms)
                else:
                    illegal += 1
            if msg:
                log.append((seen, msg))
        log = log[-self.kept :]
        self.job.update((status, last, seen, illegal))
        if log:
            self.log.put(log)
        yield self.told(key, log)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        status, last, seen, illegal = self.job.get()
        if status == "deferred":
            self.job.update(("queued", last, seen, illegal))
        yield self.told(key, list(self.log.get()))

    def close(self) -> None:
        pass


def job_states(events: DataFrame, kept: int = KEPT, retry_ms: int = 3_600_000) -> DataFrame:
    """A stream of `EVENTS` as a stream of changed `STATES`; the session's state store must be RocksDB."""
    keyed = events.filter("job_id IS NOT NULL AND seq IS NOT NULL").groupBy("job_id")
    return keyed.transformWithStateInPandas(JobState(kept, retry_ms), STATES, "Update", "ProcessingTime")


def follow(spark: SparkSession, source: str, out: str, checkpoint: str, kept: int = KEPT, retry_ms: int = 3_600_000, files_per_trigger: int = 100) -> StreamingQuery:
    """Work off the event files below ``source`` that the checkpoint does not know; a folder below ``out`` for each batch, rewritten if it comes again.

    Timers that have run out meanwhile go off with the first batch.
    """
    before = {name: spark.conf.get(name) for name in SETTINGS}
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    try:
        events = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", str(files_per_trigger)).parquet(source)
        each = lambda rows, batch: rows.write.mode("overwrite").parquet(f"{out}/batch={batch}")
        return job_states(events, kept, retry_ms).writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def current(spark: SparkSession, out: str) -> DataFrame:
    """The last state of every job that `follow` wrote."""
    rows = spark.read.schema(f"{STATES}, batch long").parquet(out)
    return rows.groupBy("job_id").agg(F.max_by(F.struct("status", "last", "illegal", "kept", "oldest"), "batch").alias("s")).select("job_id", "s.*")
