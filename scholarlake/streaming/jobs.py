"""Jobs as events: a serial queue, states by the last event, bounded logs."""

from __future__ import annotations

import queue
import threading
import time
import uuid
from collections import deque
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholarlake.schemas import JOB_EVENTS

# Log lines kept, shown by the API, shown by tools; jobs listed; memory guard in MB; polls in seconds.
KEPT, SHOWN, TOLD, LISTED = 200, 50, 15, 100
FREE_MB, MEMORY_POLL, WAIT_POLL = 12_288, 20, 2
FINAL = ("done", "error", "cancelled")


def latest(events: DataFrame, key: str = "job_id", order: str = "seq") -> DataFrame:
    """One row a job: its last state; a cancelled job stays so."""
    cancelled = F.max((F.col("status") == "cancelled").cast("int")) == 1
    return events.filter("status is not null").groupBy(key).agg(F.when(cancelled, "cancelled").otherwise(F.max_by("status", order)).alias("status"), F.min("ts").alias("created_at"), F.max("ts").alias("updated_at"), F.max(order).alias("last"))


def ring(events: DataFrame, n: int = KEPT, key: str = "job_id", order: str = "seq") -> DataFrame:
    """The last ``n`` log lines of every job."""
    return events.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).filter(F.col("rn") <= n)


def newest(jobs: DataFrame, n: int = LISTED) -> DataFrame:
    return jobs.orderBy(F.desc("created_at"), F.desc("job_id")).limit(n)


def active(jobs: DataFrame) -> DataFrame:
    return jobs.agg(F.count_if(~F.col("status").isin(*FINAL)).alias("active"))


class Cancelled(Exception):
    pass


class Jobs:
    """One worker, first in first out; a job waits (`deferred`) until memory is free; cancelling interrupts its Spark work."""

    def __init__(self, spark: SparkSession, run: Callable[[str, dict, Callable[[str, dict], None]], dict], free_mb: Callable[[], float] | None = None, least_mb: float = FREE_MB, poll: float = MEMORY_POLL):
        self.spark, self.run, self.free_mb, self.least_mb, self.poll = spark, run, free_mb, least_mb, poll
        #: Changes of state by job (a handful each), and the last log lines of each.
        self.states: dict[str, list[tuple]] = {}
        self.logs: dict[str, deque[tuple]] = {}
        self.told = 0
        self.results: dict[str, dict] = {}
        self.lock, self.waiting = threading.Lock(), queue.Queue()
        self.over: dict[str, threading.Event] = {}
        self.stopped: set[str] = set()
        threading.Thread(target=self.work, daemon=True).start()

    def tell(self, job_id: str, kind: str, params: dict, status: str | None, msg: str = "") -> None:
        with self.lock:
            row = (job_id, kind, {k: str(v) for k, v in params.items()}, status, datetime.now(timezone.utc), msg, self.told)
            self.told += 1
            if status is None:
                self.logs.setdefault(job_id, deque(maxlen=KEPT)).append(row)
            else:
                self.states.setdefault(job_id, []).append(row)

    def submit(self, kind: str, params: dict) -> str:
        job_id = uuid.uuid4().hex[:12]
        self.over[job_id] = threading.Event()
        self.tell(job_id, kind, params, "queued")
        self.waiting.put((job_id, kind, params))
        return job_id

    def cancel(self, job_id: str) -> bool:
        if job_id not in self.over or self.over[job_id].is_set():
            return False
        self.stopped.add(job_id)
        self.tell(job_id, "", {}, "cancelled")
        self.spark.interruptTag(job_id)
        return True

    def wait(self, job_id: str, timeout: float) -> bool:
        """Whether the job is over within ``timeout`` seconds."""
        return self.over[job_id].wait(timeout)

    def work(self) -> None:
        while True:
            job_id, kind, params = self.waiting.get()
            try:
                self.one(job_id, kind, params)
            except Cancelled:
                pass
            except Exception as e:  # a job may fail in any way; the queue goes on
                if job_id not in self.stopped:
                    self.tell(job_id, kind, params, "error", str(e)[:500])
            finally:
                self.over[job_id].set()

    def one(self, job_id: str, kind: str, params: dict) -> None:
        def progress(what: str, detail: dict) -> None:
            if job_id in self.stopped:
                raise Cancelled
            self.tell(job_id, kind, params, None, f"{what} {detail}")

        deferred = False
        while self.free_mb is not None and self.free_mb() < self.least_mb:
            if not deferred:
                self.tell(job_id, kind, params, "deferred")
                deferred = True
            if job_id in self.stopped:
                raise Cancelled
            time.sleep(self.poll)
        if job_id in self.stopped:
            raise Cancelled
        self.tell(job_id, kind, params, "running")
        self.spark.addTag(job_id)
        try:
            self.results[job_id] = self.run(kind, params, progress)
        finally:
            self.spark.removeTag(job_id)
        if job_id not in self.stopped:
            self.tell(job_id, kind, params, "done")

    def events(self) -> DataFrame:
        """The event table: all changes of state, and the last log lines of each job."""
        with self.lock:
            rows = [r for kept in (*self.states.values(), *self.logs.values()) for r in kept]
        return self.spark.createDataFrame(sorted(rows, key=lambda r: r[-1]), JOB_EVENTS)
