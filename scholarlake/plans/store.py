"""Parquet tables of the engine by collection - content, packs, manifest, chunks - as committed versions.

Rows go to a folder of their own and count from the commit that names it (see
`commits`). Deleting writes the keys alone; a reader leaves out the rows of
older folders by an anti join, and `compact` folds keys and folders together
when they have grown. A store may be read as of any version, and a
`Transaction` changes several tables in one version.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import replace
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from scholarlake.plans.commits import CommitLog, Conflict, Part, Snapshot
from scholarlake.schemas import CHUNKS, MANIFEST

CONTENT = "collection string, item_key string, dir string, markdown string"
PACKS = "collection string, item_key string, dir string, meta string"
#: Signed changes of the manifest's counts; their sums are the counts.
COUNTS = "collection string, status string, n bigint"
TABLES = {"content": CONTENT, "packs": PACKS, "manifest": MANIFEST, "chunks": CHUNKS, "counts": COUNTS}
KEYS = "collection string, item_key string"
#: Compression of the tables' files: two thirds of the default's bytes for texts.
CODEC = "zstd"
#: Rows of a bitmap (what Spark's `bitmap_construct_agg` makes), and bytes of bitmaps up to which `compact` broadcasts them.
BITMAP_ROWS, BITMAP_BYTES = 32_768, 1 << 26
#: Folder of a file by its path.
FOLDER = "([0-9a-f]{32})/[^/]*$"


def shaped(rows: DataFrame, schema: str) -> DataFrame:
    """Columns of a schema in its order, those that are missing as nulls."""
    return rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in (x.split(" ", 1) for x in schema.split(", "))])


class Store:
    """``version``: what is read; None for the last one. Writers add to the last one."""

    def __init__(self, spark: SparkSession, root: str, version: int | None = None):
        self.spark, self.root, self.version = spark, root.rstrip("/"), version
        self.log = CommitLog(spark, self.root)

    def at(self, version: int) -> Store:
        return Store(self.spark, self.root, version)

    def snapshot(self) -> Snapshot:
        return self.log.latest() if self.version is None else self.log.at(self.version)

    def read(self, table: str, collection: str | None = None, of: Snapshot | None = None) -> DataFrame:
        """All rows, or those of one collection (only its folders are read), of one version."""
        of = of or self.snapshot()
        parts, keys = of.of(table, collection), of.of(table, collection, "keys")
        newest: dict[str, int] = {}
        for p in keys:
            newest[p.collection] = max(p.version, newest.get(p.collection, 0))
        old = [p for p in parts if p.version < newest.get(p.collection, 0)]
        whole = [p for p in parts if p not in old]
        out = self.files(whole, TABLES[table])
        if not old:
            return out
        left = self.by_keys(self.versioned(old, TABLES[table]), keys, "left_anti").drop("at")
        return out.union(left) if whole else left

    def by_keys(self, rows: DataFrame, keys: list[Part], how: str) -> DataFrame:
        """Semi or anti join of `versioned` rows with the keys that newer folders delete."""
        gone = self.versioned(keys, KEYS).select(F.col("collection").alias("of"), F.col("item_key").alias("key"), F.col("at").alias("gone"))
        return rows.join(gone, (rows.collection == gone.of) & (rows.item_key == gone.key) & (rows["at"] < gone.gone), how)

    def left(self, parts: list[Part], keys: list[Part], schema: str) -> DataFrame:
        """What ``keys`` leave of folders, without a shuffle of the rows themselves.

        Keys alone are joined; what is gone is marked in bitmaps by file and place
        in it, one bit a row, and the rows are read past those.
        """
        rows = self.versioned(parts, schema, "_metadata.file_name AS file", f"_metadata.row_index DIV {BITMAP_ROWS} AS block", f"_metadata.row_index % {BITMAP_ROWS} AS place")
        bits = F.bitmap_construct_agg(F.col("place"))
        gone = self.by_keys(rows.select("collection", "item_key", "at", "file", "block", "place"), keys, "left_semi")
        marks = gone.groupBy("file", "block").agg(F.substring(bits, F.lit(1), (F.max("place") / 8).cast("int") + 1).alias("marks"))
        byte = F.conv(F.hex(F.substring("marks", (F.col("place") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        marked = F.getbit(F.coalesce(byte, F.lit(0)), (F.col("place") % 8).cast("int")) == 1
        return rows.join(F.broadcast(marks), ["file", "block"], "left").filter(~marked).drop("file", "block", "place", "at", "marks")

    def files(self, parts: list[Part], schema: str) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{p.path}" for p in parts])

    def versioned(self, parts: list[Part], schema: str, *more: str) -> DataFrame:
        """Rows with ``at``, the version of their folder, and ``more``, SQL over a file's columns and metadata; as many folders as the log names are broadcast."""
        at = self.spark.createDataFrame([(p.path[-32:], p.version) for p in parts], "folder string, at long")
        rows = self.files(parts, schema).select("*", *map(F.expr, more), F.regexp_extract("_metadata.file_path", FOLDER, 1).alias("folder"))
        return rows.join(F.broadcast(at), "folder").drop("folder")

    def written(self, table: str, collection: str, rows: DataFrame, kind: str = "rows") -> Part | None:
        """A folder of rows that no version names yet; None for no rows. Counts are taken in the pass that writes."""
        shape = TABLES[table] if kind == "rows" else KEYS
        seen = Observation()
        more = [F.min(F.size("vector")).alias("low"), F.max(F.size("vector")).alias("high"), F.min("model").alias("model"), F.max("model").alias("model_2")] if shape == CHUNKS else []
        rows = shaped(rows.withColumn("collection", F.lit(collection)), shape)
        path = f"data/{table}/{uuid.uuid4().hex}"
        rows.observe(seen, F.count(F.lit(1)).alias("n"), *more).write.parquet(f"{self.root}/{path}", compression=CODEC)
        got = seen.get
        if not got["n"]:
            self.removed(path)
            return None
        if more and (got["low"] != got["high"] or got["model"] != got["model_2"]):
            self.removed(path)
            raise ValueError(f"vectors of {got['low']} and {got['high']} dimensions, of models {got['model']!r} and {got['model_2']!r}")
        return Part(path, table, collection, kind, got["n"], dimension=got.get("low"), model=got.get("model"))

    def removed(self, path: str) -> None:
        fs, at = self.log.fs(f"{self.root}/{path}")
        fs.delete(at, True)

    def transaction(self) -> Transaction:
        return Transaction(self)

    def replace(self, table: str, collection: str, rows: DataFrame) -> int:
        """Put ``rows`` in the place of a collection; the number of rows."""
        with self.transaction() as t:
            return t.replace(table, collection, rows)

    def drop(self, table: str, collection: str) -> None:
        with self.transaction() as t:
            t.drop(table, collection)

    def upsert(self, table: str, collection: str, rows: DataFrame, gone: DataFrame) -> int:
        """Replace the rows of the keys in ``gone`` and ``rows`` by ``rows``; the number of these."""
        with self.transaction() as t:
            return t.upsert(table, collection, rows, gone)

    def append_chunks(self, collection: str, rows: DataFrame) -> int:
        """Add vector rows; dimension and model must be those of the index. The number of rows that the collection then has."""
        with self.transaction() as t:
            t.add("chunks", collection, rows)
        now = self.log.latest()
        if now.of("chunks", collection, "keys"):
            return self.read("chunks", collection, now).count()
        return sum(p.rows for p in now.of("chunks", collection))

    def delete_items(self, collection: str, keys: DataFrame | list[str]) -> int:
        """Delete the chunks of some items, by a frame of item_key or a list; the number of distinct keys asked for."""
        if not isinstance(keys, DataFrame):
            keys = self.spark.createDataFrame([(k,) for k in keys], "item_key string")
        with self.transaction() as t:
            return t.delete("chunks", collection, keys)

    def reset(self, collection: str) -> None:
        self.drop("chunks", collection)

    def item_keys(self, collection: str) -> DataFrame:
        return self.read("chunks", collection).select("item_key").distinct()

    def compact(self, table: str, collection: str, deleted: float = 0.1, folders: int = 16) -> int | None:
        """One folder in the place of the folders older than a collection's keys, and of the keys, once these are ``deleted`` of its rows.

        Once folders are ``folders`` many, or where there are no keys, it takes the place of all. The new version, or None.
        """
        while True:
            now = self.log.latest()
            parts, keys = now.of(table, collection), now.of(table, collection, "keys")
            if sum(p.rows for p in keys) < deleted * sum(p.rows for p in parts) and len(parts) < folders or not keys and len(parts) < 2:
                return None
            newest = max((p.version for p in keys), default=0)
            old = [p for p in parts if p.version < newest]
            whole = [p for p in parts if p not in old and (not keys or len(parts) >= folders)]
            rows = self.files(whole, TABLES[table])
            if old:
                left = self.left(old, keys, TABLES[table]) if self.bitmap_bytes(old) <= BITMAP_BYTES else self.by_keys(self.versioned(old, TABLES[table]), keys, "left_anti").drop("at")
                rows = rows.union(left) if whole else left
            if table == "counts":
                rows = rows.groupBy("status").agg(F.sum("n").alias("n")).filter("n != 0")
            new = self.written(table, collection, rows)
            gone = [p.path for p in old + whole + keys]

            def build(found: Snapshot, now=now, new=new, gone=gone):
                if not set(gone) <= found.parts.keys() or any(p.version > now.version for p in found.of(table, collection, "keys")):
                    raise Conflict(f"{collection} of {table} has changed")
                return [new] if new else [], gone, {}

            try:
                return self.log.commit(build)
            except Conflict:
                if new:
                    self.removed(new.path)

    def bitmap_bytes(self, parts: list[Part]) -> int:
        """At most so many bytes have the bitmaps of `left`, with what a row of theirs needs besides."""
        rows = sum(p.rows for p in parts)
        return rows // 8 + 256 * (rows // BITMAP_ROWS + len(self.files(parts, KEYS).inputFiles()))

    def vacuum(self, keep: int = 1, older_than: float = 86_400.0) -> int:
        """Remove folders that none of the last ``keep`` versions names and no writer may still be at; how many."""
        last = self.log.latest().version
        live = {p for v in range(max(1, last - keep + 1), last + 1) for p in self.log.at(v).parts}
        n = 0
        for table in TABLES:
            fs, at = self.log.fs(f"{self.root}/data/{table}")
            for found in fs.listStatus(at) if fs.exists(at) else ():
                path = f"data/{table}/{found.getPath().getName()}"
                if path not in live and found.getModificationTime() / 1000 <= time.time() - older_than:
                    self.removed(path)
                    n += 1
        return n

    def export(self, collection: str, folder: str) -> int:
        """content.md and meta.json of every item below ``folder``, which tasks must be able to write to."""
        of = self.snapshot()
        rows = self.read("content", collection, of).join(self.read("packs", collection, of).select("item_key", "meta"), "item_key", "left")

        def write(part) -> None:
            for r in part:
                target = Path(folder, r.dir)
                target.mkdir(parents=True, exist_ok=True)
                (target / "content.md").write_text(r.markdown or "", encoding="utf-8")
                (target / "meta.json").write_text(r.meta or "{}", encoding="utf-8")

        rows.foreachPartition(write)
        return rows.count()


class Transaction:
    """Changes of several tables that become one version when the block ends, or none.

    ``base`` is what the block may read while it works. Keys delete rows of
    earlier versions only, so writers of other rows need not wait for each
    other; whoever replaces a collection replaces what is there at the commit.
    Counts are changes against ``base``: entries of one collection have one
    writer at a time, or the second one's commit is a `Conflict`.
    """

    def __init__(self, store: Store):
        self.store, self.base = store, store.log.latest()
        self.parts: list[Part] = []
        self.whole: set[tuple[str, str]] = set()
        self.marks: dict[str, int] = {}
        self.version: int | None = None

    def __enter__(self) -> Transaction:
        return self

    def __exit__(self, kind, error, trace) -> None:
        if kind is None:
            try:
                self.version = self.store.log.commit(self.built)
            except Exception:
                self.discard()
                raise
        if kind is not None or self.version is None:
            self.discard()

    def discard(self) -> None:
        for p in self.parts:
            self.store.removed(p.path)

    def read(self, table: str, collection: str | None = None) -> DataFrame:
        return self.store.read(table, collection, self.base)

    def mark(self, stream: str, batch: int) -> None:
        """This version is a stream's batch; a version that has it, or a later one, makes the commit void."""
        self.marks[stream] = batch

    def add(self, table: str, collection: str, rows: DataFrame, kind: str = "rows") -> int:
        part = self.store.written(table, collection, rows, kind)
        if part is not None:
            self.parts.append(part)
        return part.rows if part else 0

    def replace(self, table: str, collection: str, rows: DataFrame) -> int:
        self.drop(table, collection)
        return self.add(table, collection, rows)

    def drop(self, table: str, collection: str) -> None:
        self.whole.add((table, collection))

    def delete(self, table: str, collection: str, keys: DataFrame) -> int:
        """Write the keys, sorted; rows of theirs that earlier versions have are gone."""
        return self.add(table, collection, keys.select("item_key").distinct().sortWithinPartitions("item_key"), "keys")

    def upsert(self, table: str, collection: str, rows: DataFrame, gone: DataFrame) -> int:
        self.delete(table, collection, gone.select("item_key").union(rows.select("item_key")))
        return self.add(table, collection, rows)

    def entries(self, collection: str, rows: DataFrame, gone: DataFrame) -> int:
        """`upsert` of manifest rows, which also writes by how much the counts of each status change."""
        keys = gone.select("item_key").union(rows.select("item_key")).distinct()
        lost = self.read("manifest", collection).join(keys, "item_key", "left_semi").select("status", F.lit(-1).cast("long").alias("n"))
        changes = rows.select("status", F.lit(1).cast("long").alias("n")).union(lost).groupBy("status").agg(F.sum("n").alias("n"))
        self.add("counts", collection, changes.filter("n != 0"))
        return self.upsert("manifest", collection, rows, gone)

    def built(self, now: Snapshot):
        if any(now.marks.get(s, -1) >= b for s, b in self.marks.items()):
            return None
        for p in now.of("manifest"):
            if p.version > self.base.version and any((q.table, q.collection) == ("counts", p.collection) for q in self.parts):
                raise Conflict(f"entries of {p.collection} have changed")
        remove = [p.path for p in now.parts.values() if (p.table, p.collection) in self.whole]
        stay = [p for p in now.of("chunks") if p.path not in remove]
        for new in (p for p in self.parts if p.table == "chunks" and p.kind == "rows"):
            for p in stay:
                if (p.dimension, p.model) != (new.dimension, new.model):
                    raise ValueError(f"the index holds {p.dimension} dimensions of model {p.model!r}, not {new.dimension} of {new.model!r}")
            stay.append(new)
        return [replace(p, version=0) for p in self.parts], remove, self.marks
