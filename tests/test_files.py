import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

from scholarlake import cli
from scholarlake.plans.prepare import Engines, file_records, run
from scholarlake.plans.store import Store
from scholarlake.sources.engines import HashEmbedder
from scholarlake.sources.files import bytes_of, stored_files, with_content


def test_listed_paths_keep_their_content(spark, tmp_path):
    src = tmp_path / "in"
    (src / "deep er").mkdir(parents=True)
    texts = {"one.txt": "alpha beta", "deep er/two %20.md": "gamma delta"}
    for name, text in texts.items():
        (src / name).write_text(text)
    listed = stored_files(spark, f"file://{src}")
    assert {r.name: bytes(r.content).decode() for r in with_content(listed).collect()} == {"one.txt": "alpha beta", "two %20.md": "gamma delta"}
    store = Store(spark, str(tmp_path / "store"))
    run(store, "c", file_records(listed), Engines(HashEmbedder(8), model="h"))
    assert sorted(r.markdown for r in store.read("content", "c").collect()) == sorted(texts.values())
    assert bytes_of(str(src / "none")) is None and bytes_of(f"file:{src}/none") is None


HOOK = """
from pyspark.sql import functions as F


def images(files):
    return files.select(F.col("item_key").alias("doc_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("page"), F.lit(None).cast("string").alias("label"), F.lit("png").cast("binary").alias("image"))
"""


class Service(BaseHTTPRequestHandler):
    def do_POST(self):
        self.rfile.read(int(self.headers["Content-Length"]))
        body = json.dumps({"choices": [{"message": {"content": "text [0, 0, 100, 20]recognised words"}}]}).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *a):
        pass


def test_command_line_reaches_the_ocr_service(spark, tmp_path, monkeypatch, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "scan.pdf").write_bytes(b"%PDF")
    (tmp_path / "ownhook.py").write_text(HOOK)
    monkeypatch.syspath_prepend(str(tmp_path))
    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    env = {"OCR_API_URL": f"http://127.0.0.1:{server.server_port}/", "OCR_MODEL": "m"}
    go = lambda *more: cli.main(["--root", str(tmp_path / "store"), "prepare", "scans", str(tmp_path / "in"), "--rebuild", "--pdf-images", "ownhook:images", *more], spark, env)
    try:
        assert go() == 0
        row = Store(spark, str(tmp_path / "store")).read("manifest").first()
        assert (row.route, row.status, row.pages) == ("ocr", "ok", 2)
        assert Store(spark, str(tmp_path / "store")).read("content").first().markdown.count("recognised words") == 2
        assert go("--no-ocr") == 0
        row = Store(spark, str(tmp_path / "store")).read("manifest").first()
        assert row.status == "empty" and "no OCR engine" in row.notes[0]
    finally:
        server.shutdown()
