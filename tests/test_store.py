import hashlib
import os
import threading
import uuid

import pytest
from pyspark.sql import functions as F

from scholarlake import api
from scholarlake.plans import commits
from scholarlake.plans import store as stores
from scholarlake.plans.commits import CommitLog, Conflict, Part, Snapshot
from scholarlake.plans.prepare import Engines
from scholarlake.plans.store import Store, Transaction
from scholarlake.sources.engines import HashEmbedder
from scholarlake.streaming.ingest import CHANGES, delta, ingest, newest

CONTENT = "collection string, item_key string, dir string, markdown string"


def content(spark, *rows):
    return spark.createDataFrame([("c", k, "d", t) for k, t in rows], CONTENT)


def keys(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "item_key string")


def rows(store, collection=None):
    return sorted((r.item_key, r.markdown) for r in store.read("content", collection).collect())


def test_versions_and_deletes(spark, tmp_path):
    store = Store(spark, str(tmp_path / "a store"))
    assert rows(store) == [] and store.snapshot().version == 0
    assert store.replace("content", "c", content(spark, ("a", "1"), ("b", "1"))) == 2
    assert store.upsert("content", "c", content(spark, ("b", "2"), ("n", "2")), keys(spark, "a", "none")) == 2
    assert store.replace("content", "o'ther/x", content(spark, ("a", "o"))) == 1
    assert rows(store, "c") == [("b", "2"), ("n", "2")] and rows(store) == [("a", "o"), ("b", "2"), ("n", "2")] and rows(store, "o'ther/x") == [("a", "o")]
    with store.transaction() as t:
        assert t.delete("content", "c", keys(spark, "n", "n")) == 1
    assert rows(store, "c") == [("b", "2")]
    store.upsert("content", "c", content(spark, ("n", "5")), keys(spark))
    assert rows(store, "c") == [("b", "2"), ("n", "5")]
    assert [rows(store.at(v), "c") for v in (1, 2, 3, 4)] == [[("a", "1"), ("b", "1")], [("b", "2"), ("n", "2")], [("b", "2"), ("n", "2")], [("b", "2")]]
    with pytest.raises(ValueError):
        store.at(9).read("content")
    pinned = store.at(5)
    store.drop("content", "c")
    assert rows(store, "c") == [] and rows(pinned, "c") == [("b", "2"), ("n", "5")]
    assert store.snapshot().of("content", "c", "keys") == []
    again = Store(spark, str(tmp_path / "a store"))
    assert rows(again) == [("a", "o")]
    assert store.vacuum(older_than=86400) == 0 and store.vacuum(older_than=-5) > 0
    assert rows(again) == [("a", "o")]


def test_deleting_writes_keys_alone_and_compaction_folds_them(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    many = spark.range(1000).select(F.lit("c").alias("collection"), F.col("id").cast("string").alias("item_key"), F.lit("d").alias("dir"), F.lit("text").alias("markdown"))
    store.replace("content", "c", many)
    before = store.snapshot().of("content", "c")
    with store.transaction() as t:
        t.delete("content", "c", many.filter("item_key % 100 = 0"))
    now = store.snapshot()
    assert now.of("content", "c") == before and [p.rows for p in now.of("content", "c", "keys")] == [10]
    assert store.compact("content", "c") is None
    with store.transaction() as t:
        t.delete("content", "c", many.filter("item_key % 10 = 0"))
    assert store.read("content", "c").count() == 900
    version = store.compact("content", "c")
    now = store.snapshot()
    assert version == now.version and [p.rows for p in now.of("content", "c")] == [900] and not now.of("content", "c", "keys")
    assert store.read("content", "c").count() == 900 and store.at(version - 1).read("content", "c").count() == 900 and store.at(1).read("content").count() == 1000


def test_compaction_gives_way_to_a_delete(spark, tmp_path, monkeypatch):
    store, other = Store(spark, str(tmp_path)), Store(spark, str(tmp_path))
    store.replace("content", "c", content(spark, ("a", "1"), ("b", "1"), ("n", "1")))
    with store.transaction() as t:
        t.delete("content", "c", keys(spark, "a"))
    real, once = CommitLog.commit, []

    def commit(self, build):
        if not once:
            once.append(1)
            with other.transaction() as t:
                t.delete("content", "c", keys(spark, "b"))
        return real(self, build)

    monkeypatch.setattr(CommitLog, "commit", commit)
    assert store.compact("content", "c") == 4
    assert rows(store) == [("n", "1")]


def test_a_reader_between_any_steps_sees_old_or_new(spark, tmp_path, monkeypatch):
    """Every file operation of a writer is followed by a read from a store of its own."""
    root = str(tmp_path / "s")
    store = Store(spark, root)
    store.replace("content", "c", content(spark, ("a", "old"), ("b", "old")))
    old, new, seen = [("a", "old"), ("b", "old")], [("n", "new")], []
    for name in ("created", "fs"):
        real = getattr(CommitLog, name)

        def watched(self, *a, real=real, **k):
            out = real(self, *a, **k)
            if self is store.log:
                seen.append(rows(Store(spark, root)))
            return out

        monkeypatch.setattr(CommitLog, name, watched)
    store.replace("content", "c", content(spark, ("n", "new")))
    assert old in seen and new in seen and all(x in (old, new) for x in seen)


def test_a_writer_that_dies_leaves_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.replace("content", "c", content(spark, ("a", "1")))
    with pytest.raises(KeyboardInterrupt):
        with store.transaction() as t:
            t.upsert("content", "c", content(spark, ("a", "2")), keys(spark))
            t.replace("packs", "c", spark.createDataFrame([("c", "a", "d", "m")], "collection string, item_key string, dir string, meta string"))
            raise KeyboardInterrupt
    assert rows(store) == [("a", "1")] and store.read("packs").count() == 0
    assert len(os.listdir(tmp_path / "data" / "content")) == 1


def test_writers_at_once_all_get_in(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(commits, "STATE_EVERY", 5)
    log = CommitLog(spark, str(tmp_path))

    def add(i):
        CommitLog(spark, str(tmp_path)).commit(lambda now: ([Part(f"p{i}", "content", "c", "rows", 1)], [], {f"s{i}": i}))

    threads = [threading.Thread(target=add, args=(i,)) for i in range(12)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    now = log.latest()
    assert now.version == 12 and {p.path for p in now.of("content")} == {f"p{i}" for i in range(12)} and now.marks == {f"s{i}": i for i in range(12)}
    assert log.state(12).version == 10 and log.at(7).version == 7 and len(log.at(7).parts) == 7
    assert not log.created("00000000000000000003.json", "{}") and sorted(p.version for p in now.parts.values()) == list(range(1, 13))
    assert Snapshot().after([], [], {}).version == 1


def test_counts_follow_the_manifest(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    entry = lambda *given: spark.createDataFrame([(k, s) for k, s in given], "item_key string, status string")
    recount = lambda: sorted(map(tuple, api.prepared(store.read("manifest")).collect()))
    for rows_, gone in ([("a", "ok"), ("b", "empty"), ("n", "ok")], []), ([("a", "empty"), ("x", "ok")], ["b", "none"]), ([], ["x"]):
        with store.transaction() as t:
            t.entries("c", entry(*rows_), keys(spark, *gone))
        assert sorted(map(tuple, api.counted(store).collect())) == recount()
    assert recount() == [("c", 2, 1)]
    store.compact("counts", "c", folders=2)
    assert [p.rows for p in store.snapshot().of("counts")] == [2] and sorted(map(tuple, api.counted(store).collect())) == recount()
    late = store.transaction()
    with store.transaction() as t:
        t.entries("c", entry(("a", "ok")), keys(spark))
    late.entries("c", entry(("a", "ok")), keys(spark))
    with pytest.raises(Conflict):
        late.__exit__(None, None, None)
    assert sorted(map(tuple, api.counted(store).collect())) == recount() == [("c", 2, 2)]


def changes(spark, *given):
    """(key, version, text or None, deleted)"""
    return spark.createDataFrame([(k, 1, k, "", None, v, None, "d", None, None, None, None, None, t, gone) for k, v, t, gone in given], CHANGES)


def test_stream_of_changes_survives_a_kill_and_a_replay(spark, tmp_path, monkeypatch):
    store, told = Store(spark, str(tmp_path / "s")), []
    sink = delta(store, "c", Engines(HashEmbedder(8), model="h"), "feed", lambda batch, out: told.append((batch, out["converted"], out["skipped"])))
    go = lambda: ingest(spark, str(tmp_path / "in" / "*"), CHANGES, sink, str(tmp_path / "ck")).awaitTermination()
    changes(spark, ("a", 1, "one", False), ("b", 1, "two", False), ("b", 0, "older", False), (None, 1, "x", False), ("e", 1, "", None)).write.parquet(str(tmp_path / "in" / "0"))
    go()
    assert rows(store) == [("a", "one"), ("b", "two"), ("e", "")] and told == [(0, 3, 0)]
    changes(spark, ("a", 2, "one more", False), ("b", 1, "same version", False), ("n", 1, "new", False), ("e", 2, None, True)).write.parquet(str(tmp_path / "in" / "1"))
    real, dies = Transaction.upsert, []

    def upsert(self, table, *a):
        if table == "packs" and not dies:
            dies.append(1)
            raise RuntimeError("killed between two tables")
        return real(self, table, *a)

    monkeypatch.setattr(Transaction, "upsert", upsert)
    with pytest.raises(Exception, match="killed"):
        go()
    assert rows(store) == [("a", "one"), ("b", "two"), ("e", "")] and store.read("chunks").count() == 2
    go()
    want = [("a", "one more"), ("b", "two"), ("n", "new")]
    assert rows(store) == want and told[1:] == [(1, 2, 1)]
    version = store.snapshot().version
    sink(changes(spark, ("a", 9, "replayed", False)), 1)
    assert store.snapshot().version == version and rows(store) == want
    late = store.transaction()
    late.mark("feed", 1)
    late.upsert("content", "c", content(spark, ("a", "late")), keys(spark))
    late.__exit__(None, None, None)
    assert late.version is None and rows(store) == want
    assert {r.item_key: r.text for r in store.read("chunks").collect()} == {"a": "one more", "b": "two", "n": "new"} and store.read("manifest").count() == 3


def stages(spark):
    """(id, bytes shuffled, bytes written) of the stages that are still known."""
    sc, lists = spark.sparkContext, spark._jvm.java.util.ArrayList
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    found = sc._jsc.sc().statusStore().stageList(lists(), False, False, sc._gateway.new_array(sc._gateway.jvm.double, 0), lists())
    return [(found.apply(i).stageId(), found.apply(i).shuffleWriteBytes(), found.apply(i).outputBytes()) for i in range(found.size())]


def shuffled(spark, run):
    """Bytes that a call shuffles, with merge joins wherever a join isn't told otherwise."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    before = max((s for s, _, _ in stages(spark)), default=-1)
    try:
        run()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    return sum(n for s, n, _ in stages(spark) if s > before)


def long_texts(spark, n):
    """(id, text) of 20,480 hex digits, which hardly compress in a shuffle."""
    return spark.range(n).select("id", F.array_join(F.transform(F.sequence(F.lit(1), F.lit(320)), lambda i: F.sha2(F.concat_ws(" ", "id", i), 256)), "").alias("text"))


def test_a_batch_shuffles_its_texts_once(spark, tmp_path):
    given = long_texts(spark, 60)
    key = F.col("id").cast("string")
    rows_ = given.select(key.alias("item_key"), F.col("id").alias("ord"), *[F.lit("t").alias(c) for c in ("title", "creator", "dir")], F.lit(1).cast("long").alias("version"), F.col("text").alias("markdown"), F.lit(False).alias("deleted"))
    stores.shaped(rows_, CHANGES).write.parquet(str(tmp_path / "in"))
    store = Store(spark, str(tmp_path / "s"))
    sink = delta(store, "c", Engines(HashEmbedder(8), model="h"), "feed")
    n = shuffled(spark, lambda: sink(spark.read.schema(CHANGES).parquet(str(tmp_path / "in")), 0))
    assert store.read("content").count() == 60 and store.read("chunks").count() > 60
    assert n < 1.5 * 60 * 20_480


def test_a_batch_embeds_every_chunk_once(spark, tmp_path):
    asked = tmp_path / "asked"
    asked.mkdir()

    class Counting:
        dim = 8

        def embed(self, texts):
            (asked / uuid.uuid4().hex).write_text(str(len(texts)))
            return HashEmbedder(8).embed(texts)

    store = Store(spark, str(tmp_path / "s"))
    sink = delta(store, "c", Engines(Counting(), model="h"), "feed")
    sink(changes(spark, *[(str(i), 1, f"word{i} " * 500, False) for i in range(20)], ("e", 1, "", False)), 0)
    made = store.read("chunks", "c").count()
    assert made > 40 and sum(int(f.read_text()) for f in asked.iterdir()) == made
    sink(changes(spark, ("0", 2, "one", False), ("1", 2, None, True), ("2", 1, "same version", False)), 1)
    assert sum(int(f.read_text()) for f in asked.iterdir()) == made + 1
    assert {r.item_key for r in store.read("chunks", "c").collect()} == {str(i) for i in range(20) if i != 1}


def test_routes_are_planned_for_records_without_a_text_alone(spark, tmp_path):
    planned = []

    def pdf_pages(files):
        planned.append(1)
        return spark.createDataFrame([], "doc_id string, page int, label string, text string")

    store = Store(spark, str(tmp_path / "s"))
    sink = delta(store, "c", Engines(HashEmbedder(8), pdf_pages=pdf_pages, model="h"), "feed")
    sink(changes(spark, ("a", 1, "one", False), ("d", 1, None, True)), 0)
    assert not planned and rows(store) == [("a", "one")]
    sink(changes(spark, ("a", 2, "no\u00e9l", False), ("b", 1, None, False)), 1)
    assert planned and rows(store) == [("a", "no\u00e9l"), ("b", "")]
    found = {r.item_key: (r.chars, r.status, r.content_hash) for r in store.read("manifest", "c").collect()}
    assert found == {"a": (4, "ok", hashlib.md5("no\u00e9l".encode()).hexdigest()), "b": (0, "empty", hashlib.md5(b"").hexdigest())}


def test_compaction_shuffles_keys_alone_and_leaves_newer_folders(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    of = lambda rows_, mark: rows_.select(F.col("id").cast("string").alias("item_key"), F.lit("d").alias("dir"), F.concat("text", F.lit(mark)).alias("markdown"))
    texts = long_texts(spark, 60)
    store.replace("content", "c", of(texts, "1"))
    store.upsert("content", "c", of(texts.filter("id % 3 = 0"), "2"), keys(spark, "none"))
    newest_part = store.snapshot().of("content", "c")[-1]
    n = shuffled(spark, lambda: store.compact("content", "c"))
    now = store.snapshot()
    assert [p.rows for p in now.of("content", "c")] == [20, 40] and now.of("content", "c")[0] == newest_part and not now.of("content", "c", "keys")
    assert sorted((r.item_key, r.end) for r in store.read("content", "c").select("item_key", F.substring("markdown", -1, 1).alias("end")).collect()) == sorted((str(i), "2" if i % 3 == 0 else "1") for i in range(60))
    assert n < 0.1 * 60 * 20_480


@pytest.mark.parametrize("most", [1 << 26, 0])
def test_compaction_leaves_what_a_reader_sees(spark, tmp_path, monkeypatch, most):
    """Several rows a key, files of more rows than a bitmap has, keys of several versions, keys that come back; with and without bitmaps."""
    monkeypatch.setattr(stores, "BITMAP_BYTES", most)
    store = Store(spark, str(tmp_path))
    of = lambda n, mark: spark.range(0, n, 1, 1).select((F.col("id") % (n // 2)).cast("string").alias("item_key"), F.lit("d").alias("dir"), F.lit(mark).alias("markdown"))
    store.replace("content", "c", of(70_000, "1"))
    store.upsert("content", "c", of(9_000, "2"), keys(spark, "34999", "none"))
    with store.transaction() as t:
        t.delete("content", "c", of(70_000, "").filter("item_key % 5 = 0"))
    store.upsert("content", "c", of(20, "3"), keys(spark))
    store.replace("content", "other", of(10, "o"))
    before = {(r.item_key, r.markdown): r["count"] for r in store.read("content", "c").groupBy("item_key", "markdown").count().collect()}
    assert store.compact("content", "c") and not store.snapshot().of("content", "c", "keys")
    assert {(r.item_key, r.markdown): r["count"] for r in store.read("content", "c").groupBy("item_key", "markdown").count().collect()} == before
    assert len(before) == 28_001 and before["5", "3"] == 2 and ("0", "1") not in before and store.read("content", "other").count() == 10


def test_the_newest_change(spark):
    rows_ = newest(changes(spark, ("a", 1, "x", False), ("a", 1, "y", None), ("d", 2, "z", False), ("d", 2, None, True), ("n", None, None, False), ("v", None, "old", True), ("v", 0, None, False), ("e", 1, "", False))).collect()
    assert {r.item_key: (r.version, r.markdown, r.deleted) for r in rows_} == {"a": (1, "y", None), "d": (2, None, True), "n": (None, None, False), "v": (0, None, False), "e": (1, "", False)}
