import hashlib
import json
import os
import unicodedata

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
from scholarlake import api, queries
from scholarlake.cli import main
from scholarlake.config import load_env, ocr_backend, profile_prefs
from scholarlake.functions import text as T
from scholarlake.functions.vectors import checked, cosine, normalised
from scholarlake.operators import catalog, chunks, convert, search
from scholarlake.plans.delta import planned, stale
from scholarlake.plans.prepare import Engines, file_records, run
from scholarlake.plans.store import Store
from scholarlake.sources import catalog as rest
from scholarlake.sources import engines
from scholarlake.sources.engines import HashEmbedder, HttpEmbedder, HttpOcr, StubOcr, main_text
from scholarlake.sources.files import browse, fingerprints, scan_files, stored_files
from scholarlake.streaming.ingest import ingest
from scholarlake.streaming.jobs import Jobs, latest, ring

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in queries.ORACLES:
        assert rows
        return
    found = duck.sql(queries.ORACLES[name])
    assert sorted(found.columns) == sorted(df.columns)
    order = [found.columns.index(c) for c in df.columns]
    assert sorted((plain(tuple(r)) for r in rows), key=repr) == sorted((plain(tuple(r[i] for i in order)) for r in found.fetchall()), key=repr)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def chunk_rule(md):
    """The rule stated plainly: (label, text)."""
    import re

    out, parts = [], re.split(r"\*\*\[p\.([^\]]+)\]\*\*", md)
    for label, body in zip(["", *parts[1::2]], parts[::2]):
        body = body.strip()
        if len(body) <= 1350:
            out += [(label, body)] if body else []
        else:
            out += [(label, body[s : s + 900]) for s in range(0, len(body), 780) if body[s : s + 900].strip()]
    return out


EDGES = ["", " \t", "**[p.1]**", "before **[p.ii]** after", "**[p.1]****[p.2]** x", "**[p.]** no marker", "x" * 1350, "x" * 1351, "y" * 1600, "😀" * 1400, "　\x1c a \x1f　", "a" * 800 + " " * 1000 + "b"]


def test_chunk_rule_on_edges(spark):
    rows = spark.createDataFrame(list(enumerate(EDGES)), "i int, markdown string")
    got = {}
    for r in chunks.chunked(rows, "markdown", "i").orderBy("page_ord", "window_ord").collect():
        got.setdefault(r.i, []).append((r.page, r.text))
    for i, md in enumerate(EDGES):
        assert got.get(i, []) == chunk_rule(md), repr(md)[:60]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet=" \n\tab*[]p.1　\x1c", max_size=40), min_size=1, max_size=20))
def test_strip_and_chunks_property(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    assert [r.x for r in rows.select("i", T.py_strip(F.col("t")).alias("x")).orderBy("i").collect()] == [t.strip() for t in texts]
    got = {}
    for r in chunks.chunked(rows, "t", "i").orderBy("page_ord", "window_ord").collect():
        got.setdefault(r.i, []).append((r.page, r.text))
    assert [got.get(i, []) for i in range(len(texts))] == [chunk_rule(t) for t in texts]


def test_slugs(spark):
    cases = ["A / B: c?", "///", "ｆｕｌｌ　ｗｉｄｔｈ", "_x_", "a" * 100, "", "é\t\n z"]
    want = []
    for c in cases:
        s = "_".join("".join(" " if ch in '\\/:*?"<>|' else ch for ch in unicodedata.normalize("NFKC", c)).split())[:60].strip("_")
        want.append(s or "untitled")
    got = spark.createDataFrame(list(enumerate(cases)), "i int, t string").select("i", T.slug(F.col("t")).alias("s")).orderBy("i").collect()
    assert [r.s for r in got] == want


def test_ocr_lines_and_pages(spark):
    raw = "lost\n\ntitle [1, 2, 3, 4] Head\nmore of it\r\ntext [-1, 0, 5, 6]body\nheader [0, 0, 1, 1] gone\npage_number [0, 0, 1, 1] iv\npage_number [0, 0, 1, 1]\nunknown_kind [0, 0, 1, 1] kept\nformula [0, 0, 1, 1] x=1"
    rows = spark.createDataFrame([(1, 0, raw)], "doc_id int, page int, raw string")
    lines = convert.ocr_lines(rows).orderBy("pos").collect()
    assert [(r.kind, r.text) for r in lines] == [("title", "Head more of it"), ("text", "body"), ("header", "gone"), ("page_number", "iv"), ("page_number", ""), ("unknown_kind", "kept"), ("formula", "x=1")]
    assert tuple(lines[1].box) == (-1, 0, 5, 6)
    page = convert.ocr_pages(convert.ocr_lines(rows), rows.withColumn("label", F.lit("9")).select("doc_id", "page", "label")).first()
    assert page.label == "iv" and page.text == "## Head more of it\n\nbody\n\nkept\n\nx=1" and "iv" in page.note
    done = convert.ocr_converted(spark.createDataFrame([("k", 0, "", bytearray(b"img"))], "doc_id string, page int, label string, image binary"), StubOcr()).first()
    assert done.route == "ocr" and done.markdown.startswith("**[p.1]**\n\n")


def test_pdf_blocks_classes_and_pages(spark):
    blocks = spark.createDataFrame([("d", 0, 20.04, 5.0, "second", 0), ("d", 0, 10.0, 1.0, "first", 0), ("d", 0, 20.0, 9.0, "third", 0), ("d", 0, 0.0, 0.0, "image", 1), ("d", 1, 0.0, 0.0, "  ", 0)], "doc_id string, page int, y0 double, x0 double, text string, type int")
    assert convert.ordered_blocks(blocks).first().text == "first\n\nsecond\n\nthird"
    pages = spark.createDataFrame([("a", 0, "x" * 200), ("a", 1, "x" * 200), ("b", 0, "x" * 199)] + [("c", i, "x" * (300 if i < 10 else 0)) for i in range(30)], "doc_id string, page int, text string")
    docs = spark.createDataFrame([(x,) for x in "abcz"], "doc_id string")
    assert {r.doc_id: r.pdf_class for r in convert.with_class(docs, pages).collect()} == {"a": "text", "b": "ocr", "c": "text", "z": "text"}
    md = convert.assembled(spark.createDataFrame([("d", 0, "", "one"), ("d", 1, "ii", " "), ("d", 2, "x", "two")], "doc_id string, page int, label string, text string")).first()
    assert md.markdown == "**[p.1]**\n\none\n\n**[p.x]**\n\ntwo" and md.pages == 3 and md.page_labels == ["1", "ii", "x"]


def test_readers(spark):
    files = spark.createDataFrame([("a", bytearray(b" ok \xff\xc3\xa9 "), "a.txt")], "item_key string, content binary, name string")
    assert convert.plain_converted(files).first().markdown == "ok é"
    html = "<html><head><title>t</title></head><body><nav>menu</nav><article><h1>Head</h1><p>One &amp; two<br>three<script>x</script></article><footer>f</footer></body></html>"
    assert main_text(html) == "# Head\n\nOne & two\n\nthree"
    got = convert.html_converted(spark.createDataFrame([("a", html), ("b", "<nav>only menu</nav>")], "item_key string, html string")).orderBy("item_key").collect()
    assert [r.route for r in got] == ["anydoc"] * 2 and got[1].markdown == "<nav>only menu</nav>"

    def fetch(url):
        if "bad" in url:
            raise OSError("no route")
        return (200, html) if "ok" in url else (404, "")

    web = convert.web_converted(spark.createDataFrame([("a", "http://ok"), ("b", "http://bad"), ("c", "http://gone")], "item_key string, url string"), fetch).orderBy("item_key").collect()
    assert [(r.route, bool(r.notes)) for r in web] == [("web", False), ("empty", True), ("empty", True)]


def record(key, kind, **data):
    return {"version": 3, "data": {"key": key, "itemType": kind} | data, "meta": {"numItems": 2}}


RECORDS = [
    record("I1", "book", title="", name="Named", creators=[{"lastName": "Ada", "firstName": "A"}, {"name": "Org"}], date="2019-05", publisher="P", tags=[{"tag": "x"}], url="u"),
    record("I2", "article", title="Graphs of Things", creators=[], date="", publicationTitle="J", tags=[]),
    record("A1", "attachment", parentItem="I1", contentType="application/pdf", path="storage:a.pdf", linkMode="imported_file"),
    record("A1", "attachment", parentItem="I1", contentType="application/pdf", path="storage:a.pdf", linkMode="imported_file"),
    record("A2", "attachment", parentItem="I1", contentType="text/html", path="attachments:b/../c.html", url="http://x"),
    record("N1", "note", parentItem="I1", note="<p>hi</p>", dateModified="2020"),
    record("X1", "annotation", parentItem="A1", annotationType="highlight", annotationText="t", annotationColor="#FFD400", dateModified="2021"),
    record("X2", "annotation", parentItem="A1", annotationType="note", annotationComment="c", annotationColor="#ffd400", dateModified="2022"),
]


def test_catalog_source_and_tables(spark):
    asked = []

    def fetch(path, params):
        start, n = int(params["start"]), int(params["limit"])
        return RECORDS[start : start + n]

    assert len(list(rest.paged(fetch, "items", {}, 3))) == len(RECORDS) and not asked
    rest.register_catalog(spark, fetch, "testcatalog")
    raw = spark.read.format("testcatalog").option("page", "3").load()
    raw = spark.createDataFrame(raw.collect(), raw.schema)
    items = rest.items(raw)
    rows = {r.item_key: r for r in items.collect()}
    assert rows["I1"].title == "Named" and rows["I1"].year == "2019" and rows["I1"].publication == "P" and rows["I2"].year is None and set(rows) == {"I1", "I2"}
    att = rest.attachments(raw)
    assert att.count() == 2
    located = catalog.located(att, "/data", "/base")
    local = {r.key: r.local for r in located.collect()}
    assert local == {"A1": "/data/storage/A1/a.pdf", "A2": "/base/c.html"}
    here = catalog.with_existence(located, spark.createDataFrame([("/data/storage/A1/a.pdf",)], "path string"))
    assert catalog.picked(here).first().key == "A1"
    notes = rest.annotations(raw, att)
    assert [r.type for r in catalog.annotations(notes, "I1", color="#FFd400").collect()] == ["note", "highlight"]
    assert [r.type for r in api.annotations(notes, "I1", kind="highlight").collect()] == ["highlight"]
    assert catalog.search_items(items, title="graphs").first().item_key == "I2" and catalog.search_items(items, creator="adaa org", year="2019", tag="x").count() == 1
    got = api.item(items, att, rest.notes(raw), "I1")
    assert got["notes"].first().preview == " hi " and got["attachments"].count() == 2
    who = items.select("item_key", T.creator_summary(F.col("creators")).alias("c"))
    assert {r.item_key: r.c for r in who.collect()} == {"I1": "Ada 等(2)", "I2": ""}


def test_tree_with_cycle_and_orphan(spark):
    rows = [("a", "A", None), ("b", "B", "a"), ("c", "C", "b"), ("o", "Orphan", "gone"), ("x", "X", "y"), ("y", "Y", "x")]
    df = spark.createDataFrame([(k, n, p, 0, 0, i) for i, (k, n, p) in enumerate(rows)], "key string, name string, parent string, num_items long, num_collections long, api_ord long")
    assert [r.line for r in catalog.listing(df).orderBy("ord").collect()] == ["A", "  B", "    C", "Orphan"]
    assert {r.key for r in catalog.descendants(df, "x").collect()} == {"x", "y"}
    assert catalog.resolve(df, "").count() == 0 and catalog.resolve(df, "rph").first().key == "o" and catalog.resolve(df, "b").first().key == "b"


def test_delta(spark):
    schema = "item_key string, version long, source_mtime long"
    current = spark.createDataFrame([("same", 1, 5), ("bumped", 2, 5), ("touched", 1, 6), ("nulls", 1, None), ("new", 1, 1), ("lost", 1, 5), ("empty", 1, 5)], schema)
    old = spark.createDataFrame([("same", 1, 5, "ok"), ("bumped", 1, 5, "ok"), ("touched", 1, 5, "ok"), ("nulls", 1, None, "ok"), ("lost", 1, 5, "ok"), ("empty", 1, 5, "empty"), ("removed", 1, 5, "ok")], schema + ", status string")
    content = spark.createDataFrame([(k,) for k in ("same", "bumped", "touched", "nulls", "empty")], "item_key string")
    plan = planned(current, old, content)
    assert {r.item_key for r in plan.filter("action = 'skip'").collect()} == {"same", "nulls"}
    assert planned(current, old, content, rebuild=True).filter("action = 'skip'").isEmpty()
    gone = stale(old, current, plan.filter("action = 'convert'"))
    assert {r.item_key for r in gone.collect()} == {"removed", "bumped", "touched", "new", "lost", "empty"}


def test_vectors_and_search(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, [1.0, 0.0])], "k int, v array<float>")
    assert [r.n for r in df.select("k", normalised(F.col("v")).alias("n")).orderBy("k").collect()] == [[0.6, 0.8], None, [1.0, 0.0]]
    assert df.filter("k = 1").select(F.round(cosine(F.col("v"), F.col("v")), 9)).first()[0] == 1.0
    with pytest.raises(Exception, match="dimension"):
        df.select(checked(F.col("v"), 3)).collect()
    q = df.withColumnRenamed("k", "query_key").withColumnRenamed("v", "vector")
    got = search.knn(df.withColumnRenamed("k", "key").withColumnRenamed("v", "vector"), q, 5)
    assert {(r.query_key, r.key) for r in got.collect()} == {(1, 1), (1, 3), (3, 1), (3, 3)}
    assert search.knn(df.withColumnRenamed("k", "key").withColumnRenamed("v", "vector"), q.limit(0)).collect() == []
    assert [r.k for r in search.top_k(df.withColumnRenamed("v", "vector"), [1, 0], 1, key="k").collect()] == [3]


def test_http_engines():
    def send(url, body, key, timeout):
        if "input" in body:
            assert len(body["input"]) <= 32
            return {"data": [{"index": i, "embedding": [len(t), 0.0]} for i, t in reversed(list(enumerate(body["input"])))]}
        return {"choices": [{"message": {"content": "text [0, 0, 1, 1]" + body["messages"][0]["content"][0]["image_url"]["url"][-4:]}}]}

    got = HttpEmbedder("u", "m", 2, send=send).embed(["a"] * 40 + [""])
    assert len(got) == 41 and got[-1] is None and np.allclose(got[0], [1, 0])
    assert HttpOcr("u", "m", send=send).infer_single(b"abc").startswith("text [")


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")


def test_scan_files(spark, tmp_path):
    for name in ("a.MD", "_under.md", ".hidden.md", ".dot/x.txt", "node_modules/n.md", "sub/content.md", "sub/b.txt", "sub/c.zip"):
        write(tmp_path / name, name)
    got = scan_files(spark, [str(tmp_path), str(tmp_path / "a.MD")])
    assert [os.path.relpath(r.path, tmp_path) for r in got.collect()] == [".dot/x.txt", "_under.md", "a.MD", "sub/b.txt"]
    assert [r.name for r in scan_files(spark, [str(tmp_path)], recursive=False).collect()] == ["_under.md", "a.MD"]
    assert {r.name for r in stored_files(spark, str(tmp_path)).collect()} >= {"a.MD", "b.txt"}
    with pytest.raises(FileNotFoundError):
        scan_files(spark, [str(tmp_path / "none")])
    assert browse(str(tmp_path))["files"] == ["_under.md", "a.MD"] and [r.size for r in fingerprints(spark, [str(tmp_path / "a.MD"), str(tmp_path)]).collect()] == [4, None]


def test_prepare_is_incremental(spark, tmp_path):
    src, store = tmp_path / "src", Store(spark, str(tmp_path / "store"))
    write(src / "one.txt", "alpha beta " * 200)
    write(src / "two.html", "<body><p>gamma delta</p></body>")
    write(src / "three.docx", "binary")
    write(src / "empty.md", "  ")
    go = lambda **k: run(store, "adhoc:t", file_records(scan_files(spark, [str(src)])), Engines(HashEmbedder(), model="hash"), **k)
    first = go()
    assert (first["total"], first["converted"], first["skipped"], first["empty"]) == (4, 4, 0, 2) and first["chunks_indexed"] == 4
    again = go()
    assert (again["converted"], again["skipped"]) == (2, 2)
    before = {r.item_key for r in store.item_keys("adhoc:t").collect()}
    (src / "one.txt").unlink()
    write(src / "two.html", "<body><p>epsilon</p></body>")
    os.utime(src / "two.html", (1, 1))
    third = go()
    assert third["total"] == 3 and third["converted"] == 3
    after = {r.item_key for r in store.item_keys("adhoc:t").collect()}
    assert len(before) == 2 and len(after) == 1 and after < before
    assert store.read("manifest", "adhoc:t").count() == 3 and store.read("content", "adhoc:t").count() == 3
    hit = api.semantic_search(store, HashEmbedder(), "epsilon", 3).first()
    assert hit.text == "epsilon" and hit.title == "two"
    assert api.read_item(store, "adhoc:t", "two").first().text == "epsilon" and api.read_item(store, "adhoc:t", "zzz").count() == 3
    assert json.loads(api.meta(store, "adhoc:t", store.read("manifest", "adhoc:t").filter("title = 'two'").first().dir).first().meta)["conversion"]["route"] == "anydoc"
    assert api.packs(store).first().ok == 1 and api.manifest(store, "adhoc:t").count() == 3
    assert store.export("adhoc:t", str(tmp_path / "out")) == 3 and len(list((tmp_path / "out").glob("*/content.md"))) == 3
    assert go(rebuild=True)["converted"] == 3
    assert store.delete_items("adhoc:t", list(after)) == 1 and store.item_keys("adhoc:t").isEmpty()


def test_prepare_refuses_another_model(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    write(tmp_path / "src" / "one.txt", "alpha beta")
    go = lambda name, model: run(store, name, file_records(scan_files(spark, [str(tmp_path / "src")])), Engines(HashEmbedder(), model=model))
    go("adhoc:a", "hash")
    with pytest.raises(ValueError):
        go("adhoc:b", "other")
    assert store.read("chunks").select("model").distinct().count() == 1


def test_store_dimension_guard(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    row = lambda v, m: spark.createDataFrame([(v, "t", "", "k", "", "", "", "c d'e", "", 0, 0, m)], __import__("scholarlake.schemas", fromlist=["CHUNKS"]).CHUNKS)
    assert store.append_chunks("c d'e", row([1.0, 0.0], "m")) == 1 and store.append_chunks("c d'e", row([0.0, 1.0], "m")) == 2
    for bad in (row([1.0], "m"), row([1.0, 0.0], "other")):
        with pytest.raises(ValueError):
            store.append_chunks("c d'e", bad)
    assert api.find_similar(store, "k").count() == 0
    store.reset("c d'e")
    assert store.read("chunks").count() == 0


def test_cli(spark, tmp_path, capsys):
    write(tmp_path / "src" / "n.txt", "needle in text")
    assert main(["--root", str(tmp_path / "s"), "prepare", "My pack", str(tmp_path / "src")], spark) == 0
    assert main(["--root", str(tmp_path / "s"), "search", "needle", "--top-k", "1"], spark) == 0
    assert "needle in text" in capsys.readouterr().out


def test_jobs(spark):
    def work(kind, params, progress):
        progress("step", {})
        if kind == "bad":
            raise ValueError("broken")
        return {"n": spark.range(10).count()}

    queue = Jobs(spark, work, free_mb=lambda: 99_999)
    ids = [queue.submit("prepare", {"a": 1}), queue.submit("bad", {}), queue.submit("prepare", {})]
    assert all(queue.wait(i, 60) for i in ids)
    states = {r.job_id: r.status for r in latest(queue.events()).collect()}
    assert [states[i] for i in ids] == ["done", "error", "done"] and queue.results[ids[0]] == {"n": 10}
    assert api.job_status(queue, ids[0])["log"].count() == 1 and api.job_list(queue).count() == 3 and not queue.cancel(ids[0])
    slow = Jobs(spark, work, free_mb=lambda: 0, poll=0.05)
    waiting = slow.submit("prepare", {})
    assert not slow.wait(waiting, 0.3) and slow.cancel(waiting) and slow.wait(waiting, 10)
    assert latest(slow.events()).first().status == "cancelled"


def test_job_ring(spark):
    rows = spark.createDataFrame([("j", i) for i in range(300)], "job_id string, seq long")
    assert ring(rows).agg(F.min("seq"), F.count("*")).first() == (100, 200)


def test_stream_in_batches_equals_batch(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs.repartition(7).write.parquet(str(tmp_path / "in"))
    store, seen = Store(spark, str(tmp_path / "store")), []

    def each(rows, batch):
        seen.append(batch)
        store.upsert("content", "s", rows.select(F.lit("s").alias("collection"), F.col("doc_id").cast("string").alias("item_key"), F.lit("d").alias("dir"), F.col("text").alias("markdown")), rows.limit(0).select(F.col("source").alias("item_key")))

    for _ in range(2):
        ingest(spark, str(tmp_path / "in"), "doc_id long, text string, lang string, source string, n_chars long", each, str(tmp_path / "ck"), files_per_trigger=3).awaitTermination()
    assert len(seen) == 3 and store.read("content", "s").count() == docs.count()


def test_config(tmp_path):
    write(tmp_path / ".env", "# c\nA=1\nB='two'\nbad\n")
    env = {"A": "0"}
    assert load_env(tmp_path / ".env", env) == {"A": "1", "B": "two"} and env == {"A": "0", "B": "two"} and load_env(tmp_path / "none") == {}
    write(tmp_path / "p" / "prefs.js", 'user_pref("extensions.zotero.dataDir", "/d");')
    assert profile_prefs(tmp_path) == {"data_dir": "/d"}
    assert ocr_backend({"OCR_API_URL": "x"}) == "http" and ocr_backend({}) == "local" and ocr_backend({"OCR_BACKEND": "local", "OCR_API_URL": "x"}) == "local"


def test_entry_without_the_llm_folders(tmp_path):
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.abspath(entry.__file__))
    shutil.copytree(os.path.join(root, "scholarlake"), tmp_path / "scholarlake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert 'chunk_windows' in q and 'pipeline' not in q and not any(n.startswith('op') for n in q) and set(o) <= set(q)"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}).returncode == 0


def test_prepare_from_the_catalog(spark, tmp_path):
    from scholarlake.plans.prepare import item_records

    data = tmp_path / "data"
    write(data / "storage" / "A1" / "a.txt", "alpha words of a paper")
    raw = spark.createDataFrame(
        [(i, "C", json.dumps(r)) for i, r in enumerate([
            record("I1", "book", title="First / Work", creators=[{"lastName": "Ada"}], date="2019-05"),
            record("I2", "article", title="Second", date=""),
            record("A1", "attachment", parentItem="I1", contentType="text/plain", path="storage:a.txt"),
            record("A2", "attachment", parentItem="I2", contentType="text/html", url="http://ok"),
        ])],
        "ord long, collection string, json string",
    )
    attached = catalog.located(rest.attachments(raw), str(data), None)
    files = scan_files(spark, [str(data)])
    records = item_records(rest.items(raw), attached, files)
    store = Store(spark, str(tmp_path / "store"))
    engines = Engines(HashEmbedder(), fetch=lambda url: (200, "<p>web text</p>"))
    got = run(store, "C", records, engines)
    assert (got["total"], got["converted"], got["empty"], got["chunks_indexed"]) == (2, 2, 0, 2)
    rows = {r.item_key: r for r in store.read("manifest", "C").collect()}
    assert rows["I1"].dir == "Ada_2019_First_Work" and rows["I1"].route == "text" and rows["I2"].route == "web" and rows["I2"].source_mtime is None
    assert run(store, "C", records, engines)["skipped"] == 2
    limited = item_records(rest.items(raw), attached, files, limit=1)
    assert run(store, "C", limited, engines, rebuild=True, partial=True)["converted"] == 1
    assert store.read("manifest", "C").count() == 2 and store.item_keys("C").count() == 2
    listed = api.collections(spark.createDataFrame([("k", "C", None, 2, 0, 0)], "key string, name string, parent string, num_items long, num_collections long, api_ord long"), store.read("manifest")).collect()
    assert [(r.name, r.ok, r.is_prepared) for r in listed] == [("C", 2, True)]
    assert api.find_similar(store, "I1").first().item_key == "I2"


def test_trees_have_no_depth_limit(spark):
    n = 300
    rows = [(f"k{i}", f"N{i}", f"k{i - 1}" if i else None, 0, i) for i in range(n)] + [("x", "X", "z", 0, n), ("y", "Y", "x", 0, n + 1), ("z", "Z", "y", 0, n + 2), ("w", "W", "x", 0, n + 3)]
    df = spark.createDataFrame(rows, "key string, name string, parent string, num_items long, api_ord long")
    t = {r.key: r for r in catalog.tree(df, paths=True).collect()}
    assert len(t) == n and all(t[f"k{i}"].depth == i and t[f"k{i}"].path == [f"k{j}" for j in range(i + 1)] for i in (0, 1, 150, 299))
    assert {r.key for r in catalog.descendants(df, "k100").collect()} == {f"k{i}" for i in range(100, n)}
    assert {r.key for r in catalog.descendants(df, "x").collect()} == {"x", "y", "z", "w"} and {r.key for r in catalog.descendants(df, "nobody").collect()} == {"nobody"}
    assert [r.line for r in catalog.listing(df).orderBy("ord").collect()] == ["  " * i + f"N{i}" for i in range(n)]
    assert catalog.tree(df.limit(0)).collect() == []


def test_ocr_lines_of_a_long_page(spark):
    lines = [f"text [0, 0, {i % 900}, 9]line {i}" if i % 3 == 0 else f"more {i}" for i in range(20_000)]
    raw = spark.createDataFrame([(1, 0, "\n".join(lines))], "doc_id long, page int, raw string")
    rows = convert.ocr_lines(raw).collect()
    assert len(rows) == 6667 and {r.pos: r.text for r in rows}[300] == "line 300 more 301 more 302"


def test_knn_in_several_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(120, 8)).round(1)
    v[7] = 0
    rows = spark.createDataFrame([(i, x.tolist(), i % 3) for i, x in enumerate(v)], "key long, vector array<double>, scope long").repartition(3)
    queries_ = rows.filter("key % 4 = 0").withColumnRenamed("key", "query_key")
    want = sorted(map(tuple, search.knn(rows, queries_, 5, scope="scope", but_self=True).collect()))
    monkeypatch.setattr(search, "BLOCK", 10)
    monkeypatch.setattr(search, "QUERIES", 9)
    monkeypatch.setattr(search, "CELLS", 16)
    assert sorted(map(tuple, search.knn(rows, queries_, 5, scope="scope", but_self=True).collect())) == want
    unit = v / np.maximum(np.linalg.norm(v, axis=1), 1e-12)[:, None]
    for q in (0, 4):
        sims = sorted((-round(float(unit[q] @ unit[k]), 6), k) for k in range(120) if k % 3 == q % 3 and k != q and k != 7)[:5]
        assert [k for _, k in sims] == [k for qk, k, *_ in sorted(want, key=lambda r: (r[0], r[3])) if qk == q]
    assert search.knn(rows, queries_.limit(0), 5).collect() == [] and search.knn(rows.limit(0), queries_, 5).collect() == []
    short = spark.createDataFrame([(900, [1.0, 0.0], 0), (901, None, 0), (902, [0.0, 3.0], 0)], rows.schema)
    mixed = search.knn(rows.union(short), queries_.union(short.withColumnRenamed("key", "query_key")), 5, scope="scope", but_self=True).collect()
    assert sorted(map(tuple, (r for r in mixed if r.query_key < 900))) == want and sorted((r.query_key, r.key, r.sim) for r in mixed if r.query_key >= 900) == [(900, 902, 0.0), (902, 900, 0.0)]


def test_knn_leaves_out_cells_that_are_too_far(spark, monkeypatch):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    v = centres[np.arange(600) % 12] + rng.normal(size=(600, 16)) * 0.05
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "key long, vector array<double>").repartition(3)
    asked, told = rows.filter("key % 20 = 0").withColumnRenamed("key", "query_key"), []
    want = sorted(map(tuple, search.knn(rows, asked, 5).collect()))
    monkeypatch.setattr(search, "BLOCK", 20)
    assert sorted(map(tuple, search.knn(rows, asked, 5, report=lambda *n: told.append(n)).collect())) == want
    assert told[0][1] < 0.5 * told[0][0]


def test_named_files_are_taken_by_extension(spark, tmp_path, monkeypatch):
    for name in (".hidden.md", "content.md", "a.bin"):
        (tmp_path / name).write_text("x")
    paths = [str(tmp_path / n) for n in (".hidden.md", "content.md", "a.bin")]
    assert sorted(r.name for r in scan_files(spark, paths).collect()) == [".hidden.md", "content.md"]
    assert scan_files(spark, [str(tmp_path)]).collect() == []
    monkeypatch.setenv("HOME", str(tmp_path))
    assert scan_files(spark, ["~/content.md"]).count() == 1


def test_job_log_is_bounded_in_memory(spark):
    def work(kind, params, progress):
        for i in range(500):
            progress("step", {"i": i})
        return {}

    queue = Jobs(spark, work)
    job = queue.submit("x", {})
    assert queue.wait(job, 30) and len(queue.logs[job]) == 200
    rows = queue.events().filter(F.col("job_id") == job)
    assert rows.filter("msg != ''").count() == 200 and latest(rows).first().status == "done"


def test_sync_and_engines(spark, tmp_path, capsys):
    from scholarlake.cli import engines

    def fetch(path, params):
        if path == "collections":
            every = [{"data": {"key": "C1", "name": "Graphs", "parentCollection": False}, "meta": {}}, {"data": {"key": "C2", "name": "Below", "parentCollection": "C1"}, "meta": {}}]
        else:
            key = path.split("/")[1]
            every = [{"data": {"key": f"I{key}", "itemType": "book", "title": f"About {key}"}, "version": 1}, {"data": {"key": f"A{key}", "itemType": "attachment", "parentItem": f"I{key}", "path": str(folder / f"{key}.md"), "contentType": "text/markdown"}}]
        return every[int(params["start"]) : int(params["start"]) + int(params["limit"])]

    folder = tmp_path / "f"
    folder.mkdir()
    for key in ("C1", "C2"):
        (folder / f"{key}.md").write_text(f"Words on {key}")
    assert main(["--root", str(tmp_path / "s"), "sync", "graph"], spark, {"CATALOG_DATA_DIR": "/data"}, fetch) == 0
    store = Store(spark, str(tmp_path / "s"))
    assert sorted((r.item_key, r.status, r.title) for r in store.read("manifest", "Graphs").collect()) == [("IC1", "ok", "About C1"), ("IC2", "ok", "About C2")]
    assert main(["--root", str(tmp_path / "s"), "search", "words on C2", "--collection", "Graphs"], spark, {}) == 0 and "About C2" in capsys.readouterr().out
    env = {"EMBED_API_URL": "http://e", "EMBED_MODEL": "m", "EMBED_DIM": "8", "OCR_API_URL": "http://o"}
    assert engines(env)[1] == "m" and engines(env)[2] is not None and engines(env, use_ocr=False)[2] is None and engines({})[1:] == ("hash", None)


def test_hashed_words_are_remembered_within_a_bound(monkeypatch):
    texts = ["", " \t", "One two one\x1cTWO İx", "a b c d e f g h a", "+".join("ab"), "x " * 400 + "y"]
    monkeypatch.setattr(engines, "KNOWN_WORDS", 4)
    for dim in (1, 7, 16):
        for text, got in zip(texts, HashEmbedder(dim).embed(texts), strict=True):
            v = np.zeros(dim)
            for word in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                v[h % dim] += 1 if h >> 63 else -1
            want = engines.unit(v)
            assert (got is None) == (want is None) and (got is None or got.dtype == np.float32 and (got == want).all())
        assert len(engines.word_places(dim)) <= 4
    engines.word_places.cache_clear()


def test_windows_of_long_texts_and_wide_characters(spark):
    texts = [c * n for c in ("x", "\n", "😀") for n in (0, 1, 1350, 1351, 1559, 1560, 1561, 1680, 1681)] + ["a\r\nb 中😀\u0085c$" * 50_000]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", T.windows(F.col("t")).alias("w")).orderBy("i").collect()
    assert [r.w for r in got] == [[t] if len(t) <= 1350 else [t[i : i + 900] for i in range(0, len(t), 780)] for t in texts]
