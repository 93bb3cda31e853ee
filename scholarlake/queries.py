"""The query catalogue over the test tables, each with its SQL where SQL can express it.

Test tables stand in for the engine's: documents for converted items (source =
collection), pages for snapshots, embeddings for chunk vectors, conversations
for ordered children, events for jobs, labels for the last manifest. All run
over whole tables; limits are those of the features.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholarlake import api
from scholarlake.checkpoints import shared_folder
from scholarlake.functions import text as T
from scholarlake.functions.vectors import checked, norm
from scholarlake.operators import catalog, chunks, convert, search
from scholarlake.plans.delta import planned, stale
from scholarlake.plans.store import Store
from scholarlake.sources import catalog as rest
from scholarlake.sources.engines import HashEmbedder, StubOcr, embedded, extracted, recognised
from scholarlake.streaming import jobs

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def md5(x):
    return F.md5(x.cast("binary"))


def lines_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "text"))
    return rows.withColumn("pos", F.col("pos").cast("long"))


def chunk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks and characters by collection."""
    rows = chunks.chunked(table(spark, sf_dir, "documents"), "text", "source")
    return rows.groupBy("source").agg(F.count("*").alias("n_chunks"), F.sum(F.length("text").cast("long")).alias("n_chars"))


STRIP = r"regexp_replace({0}, '\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z', '', 'g')"
BODIES = f"b AS (SELECT doc_id, source, {STRIP.format('text')} AS body FROM documents)"
CUT = "unnest(CASE WHEN length(body) <= 1350 THEN [0] ELSE range(0, length(body), 780) END)"
PIECE = "CASE WHEN length(body) <= 1350 THEN body ELSE substr(body, st + 1, 900) END"
LINES = r"l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)"
NUMBERED = f"{LINES}, s AS (SELECT doc_id, pos, {STRIP.format('text')} AS body FROM l)"

query(f"""WITH {BODIES}, w AS (SELECT source, body, {CUT} AS st FROM b), c AS (SELECT source, {PIECE} AS t FROM w)
SELECT source, count(*) AS n_chunks, sum(length(t))::BIGINT AS n_chars FROM c WHERE {STRIP.format('t')} <> '' GROUP BY source""")(chunk_counts)


@query(f"""WITH {BODIES}, w AS (SELECT doc_id, body, {CUT} AS st FROM b), c AS (SELECT doc_id, st // 780 AS window_ord, {PIECE} AS t FROM w)
SELECT doc_id, window_ord, length(t)::BIGINT AS n, md5(t) AS hash FROM c WHERE {STRIP.format('t')} <> ''""")
def chunk_windows(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.windows(T.py_strip(F.col("text")))).alias("window_ord", "t")).filter(T.py_strip(F.col("t")) != "")
    return rows.select("doc_id", F.col("window_ord").cast("long").alias("window_ord"), F.length("t").cast("long").alias("n"), md5(F.col("t")).alias("hash"))


def assembled(spark, sf_dir) -> DataFrame:
    """Every line of a document as a page."""
    pages = lines_of(spark, sf_dir).select("doc_id", F.col("pos").cast("int").alias("page"), F.lit("").alias("label"), "text")
    return convert.assembled(pages)


@query(f"""WITH {NUMBERED}, m AS (SELECT doc_id, count(*) AS pages, coalesce(string_agg('**[p.' || (pos + 1) || ']**' || chr(10) || chr(10) || body, chr(10) || chr(10) ORDER BY pos) FILTER (body <> ''), '') AS md FROM s GROUP BY doc_id)
SELECT doc_id, pages, length(md)::BIGINT AS chars, md5(md) AS content_hash, CASE WHEN length(md) > 0 THEN 'ok' ELSE 'empty' END AS status FROM m""")
def page_assemble(spark, sf_dir):
    md, chars = F.col("markdown"), F.length("markdown").cast("long")
    return assembled(spark, sf_dir).select(F.col("item_key").cast("long").alias("doc_id"), F.col("pages").cast("long").alias("pages"), chars.alias("chars"), md5(md).alias("content_hash"), T.status_of(chars).alias("status"))


@query(f"""WITH {NUMBERED}, p AS (SELECT doc_id, (pos + 1)::VARCHAR AS page, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS page_ord, body FROM s WHERE body <> ''),
w AS (SELECT doc_id, page, page_ord, body, {CUT} AS st FROM p), c AS (SELECT doc_id, page, page_ord, st // 780 AS window_ord, {PIECE} AS t FROM w)
SELECT doc_id, page, page_ord, window_ord, md5(t) AS hash FROM c WHERE {STRIP.format('t')} <> ''""")
def page_chunks(spark, sf_dir):
    rows = chunks.chunked(assembled(spark, sf_dir), "markdown", "item_key")
    return rows.select(F.col("item_key").cast("long").alias("doc_id"), "page", "page_ord", "window_ord", md5(F.col("text")).alias("hash"))


@query(f"WITH {LINES} SELECT doc_id, pos, length(text)::BIGINT AS n, md5(text) AS hash FROM l")
def line_explode(spark, sf_dir):
    return lines_of(spark, sf_dir).select("doc_id", "pos", F.length("text").cast("long").alias("n"), md5(F.col("text")).alias("hash"))


@query(f"""WITH {LINES}, g AS (SELECT doc_id, pos, text, sum(regexp_matches(text, '^[A-E]')::BIGINT) OVER (PARTITION BY doc_id ORDER BY pos) AS block FROM l)
SELECT doc_id, block::BIGINT AS block, count(*) AS n, md5(string_agg(text, ' ' ORDER BY pos)) AS hash FROM g WHERE block > 0 GROUP BY doc_id, block""")
def block_fold(spark, sf_dir):
    rows = convert.folded(lines_of(spark, sf_dir), F.col("text").rlike("^[A-E]"))
    return rows.select("doc_id", "block", "n", md5(F.col("text")).alias("hash"))


KIND = "CASE pos % 6 WHEN 0 THEN 'title' WHEN 1 THEN 'text' WHEN 3 THEN 'header' WHEN 4 THEN 'page_number' WHEN 5 THEN 'table' END"


def ocr_raw(spark, sf_dir) -> DataFrame:
    """Lines of documents as raw OCR output: every sixth line continues the one before."""
    rows = lines_of(spark, sf_dir).withColumn("kind", F.expr(KIND))
    line = F.when(F.col("kind").isNull(), F.col("text")).otherwise(F.concat(F.col("kind"), F.lit(" [0, -1, "), F.col("pos").cast("string"), F.lit(", 9]"), F.col("text")))
    page = rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("x")))), lambda r: r["x"]), "\n").alias("raw"))
    return page.select("doc_id", F.lit(0).alias("page"), "raw")


OCR_SQL = f"""{NUMBERED}, k AS (SELECT doc_id, pos, {KIND} AS kind, body FROM s), g AS (SELECT *, max(CASE WHEN kind IS NOT NULL THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos) AS head FROM k WHERE kind IS NOT NULL OR body <> ''),
o AS (SELECT doc_id, head AS pos, max(kind) AS kind, string_agg(body, ' ' ORDER BY pos) AS text FROM g GROUP BY doc_id, head)"""


@query(f"WITH {OCR_SQL} SELECT doc_id, pos, kind, 0 AS x1, -1 AS y1, pos::INTEGER AS x2, md5(text) AS hash FROM o")
def ocr_line_parse(spark, sf_dir):
    return convert.ocr_lines(ocr_raw(spark, sf_dir)).select("doc_id", "pos", "kind", "box.x1", "box.y1", "box.x2", md5(F.col("text")).alias("hash"))


@query(f"""WITH {OCR_SQL}, d AS (SELECT doc_id FROM documents), p AS (SELECT doc_id,
string_agg(CASE WHEN kind = 'title' THEN '## ' || text ELSE text END, chr(10) || chr(10) ORDER BY pos) FILTER (kind IN ('title', 'text', 'table')) AS text, arg_max(text, pos) FILTER (kind = 'page_number') AS detected FROM o WHERE text <> '' GROUP BY doc_id)
SELECT doc_id, coalesce(detected, '1') AS label, md5(coalesce(text, '')) AS hash, coalesce(detected <> '1', false) AS noted FROM d LEFT JOIN p USING (doc_id)""")
def ocr_page_markdown(spark, sf_dir):
    raw = ocr_raw(spark, sf_dir)
    pages = convert.ocr_pages(convert.ocr_lines(raw), raw.select("doc_id", "page", F.lit(None).cast("string").alias("label")))
    return pages.select("doc_id", "label", md5(F.col("text")).alias("hash"), F.col("note").isNotNull().alias("noted"))


@query("SELECT page_id, substr(regexp_replace(html, '<[^>]+>', ' ', 'g'), 1, 200) AS preview FROM pages")
def html_note_preview(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.html_strip(F.col("html"), 200).alias("preview"))


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages")
def html_title(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


SLUG = r"trim(substr(regexp_replace(regexp_replace(regexp_replace({0}, '[\\/:*?\"<>|]+', ' ', 'g'), '\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z', '', 'g'), '\s+', '_', 'g'), 1, {1}), '_')"


@query(f"""WITH t AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages)
SELECT page_id, coalesce(nullif({SLUG.format('title', 60)}, ''), 'untitled') AS slug, '佚名_' || 'y' || page_id % 10 || '_' || coalesce(nullif({SLUG.format('title', 60)}, ''), 'untitled') AS dir FROM t""")
def slug_titles(spark, sf_dir):
    rows = html_title(spark, sf_dir)
    year = F.concat(F.lit("y"), (F.col("page_id") % 10).cast("string"))
    return rows.select("page_id", T.slug(F.col("title")).alias("slug"), T.item_dir(F.lit(""), year, F.col("title")).alias("dir"))


@query("SELECT doc_id, md5(text) AS content_hash, 'adh' || substr(md5(source || '/' || doc_id), 1, 12) AS item_key, replace(replace(replace(source || '/../' || doc_id, '/', '_'), chr(92), '_'), '..', '_') AS safe FROM documents")
def content_hash_keys(spark, sf_dir):
    path = F.concat_ws("/", "source", F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", md5(F.col("text")).alias("content_hash"), T.stable_key(path).alias("item_key"), T.safe_name(F.concat_ws("/../", "source", F.col("doc_id").cast("string"))).alias("safe"))


@query("SELECT md5(text) AS content_hash, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def dup_content(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(md5(F.col("text")).alias("content_hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).filter("n > 1")


@query("SELECT md5(text) AS content_hash, arg_min(doc_id, doc_id) AS item_key, arg_min(lang, doc_id) AS lang, string_agg(DISTINCT source, ',' ORDER BY source) AS collections FROM documents GROUP BY 1")
def dedupe_membership(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").withColumn("content_hash", md5(F.col("text"))).withColumn("item_key", F.col("doc_id"))
    return catalog.once(rows, "content_hash", "doc_id", "source", "item_key", "lang").withColumn("collections", F.array_join("collections", ","))


def vectors(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector"), F.col("label").cast("long").alias("collection"))


SIM = "round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6)"
KNN = f"""WITH s AS (SELECT q.vec_id AS query_key, v.vec_id AS key, {SIM} AS sim FROM embeddings q JOIN embeddings v ON {{0}}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_key ORDER BY sim DESC, key) AS rank FROM s) SELECT query_key, key, sim, rank FROM r WHERE rank <= 8"""


def queries_of(rows: DataFrame) -> DataFrame:
    return rows.filter("key % 20 = 0").withColumnRenamed("key", "query_key")


@query(KNN.format("q.vec_id % 20 = 0"))
def search_topk(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    return search.knn(rows, queries_of(rows), 8)


@query(KNN.format("q.vec_id % 20 = 0 AND q.label = v.label"))
def search_topk_scoped(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    return search.knn(rows, queries_of(rows), 8, scope="collection")


@query(KNN.format("q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id"))
def similar_exclude_self(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    return search.knn(rows, queries_of(rows), 8, but_self=True)


@query(f"""WITH s AS (SELECT v.vec_id AS key, v.label::BIGINT AS collection, {SIM} AS sim FROM embeddings q JOIN embeddings v ON q.vec_id = (SELECT min(vec_id) FROM embeddings)) SELECT * FROM s ORDER BY sim DESC, key LIMIT 8""")
def search_one(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    first = rows.orderBy("key").limit(1).collect()
    return search.top_k(rows, first[0].vector if first else [1.0], 8, key="key").select("key", "collection", "sim")


@query("""WITH h AS (SELECT label, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM embeddings),
e AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM h WHERE rn <= 3), a AS (SELECT label, i, avg(x) AS x FROM e GROUP BY ALL)
SELECT label::BIGINT AS collection, (i - 1)::BIGINT AS i, round(x / sqrt(sum(x * x) OVER (PARTITION BY label)), 6) AS x FROM a""")
def similar_centroid(spark, sf_dir):
    rows = search.centroids(vectors(spark, sf_dir), "collection", ["key"])
    return rows.select("collection", F.posexplode("centroid").alias("i", "x")).select("collection", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


@query("SELECT vec_id AS key, len(embedding)::BIGINT AS dim, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 5) AS norm FROM embeddings")
def vector_norm_check(spark, sf_dir):
    return vectors(spark, sf_dir).select("key", F.size("vector").cast("long").alias("dim"), F.round(norm(F.col("vector")), 5).alias("norm"))


@query("SELECT DISTINCT label::BIGINT AS collection, vec_id // 3 AS item_key FROM embeddings")
def collection_item_keys(spark, sf_dir):
    return vectors(spark, sf_dir).select("collection", F.floor(F.col("key") / 3).alias("item_key")).distinct()


def nested(spark, sf_dir) -> DataFrame:
    """Documents as a tree of collections, three children each."""
    k = F.col("doc_id")
    parent = F.when(k > 0, F.floor((k - 1) / 3).cast("string"))
    return table(spark, sf_dir, "documents").select(k.cast("string").alias("key"), F.col("source").alias("name"), parent.alias("parent"), F.col("n_chars").alias("num_items"), k.alias("api_ord"))


TREE = """WITH RECURSIVE t(key, depth, path) AS (SELECT doc_id, 0, doc_id::VARCHAR FROM documents WHERE doc_id = 0
UNION ALL SELECT d.doc_id, t.depth + 1, t.path || '/' || d.doc_id FROM t JOIN documents d ON d.doc_id > 0 AND (d.doc_id - 1) // 3 = t.key)"""


@query(f"{TREE} SELECT key::VARCHAR AS key, depth::BIGINT AS depth, path FROM t")
def collection_tree(spark, sf_dir):
    return catalog.tree(nested(spark, sf_dir), paths=True).select("key", "depth", F.array_join("path", "/").alias("path"))


@query(f"{TREE} SELECT key::VARCHAR AS key FROM t WHERE path || '/' LIKE '0/1/%'")
def descendants(spark, sf_dir):
    return catalog.descendants(nested(spark, sf_dir), "1")


@query("SELECT source AS collection, count(*) AS total, count_if(l.quality = 1)::BIGINT AS ok, count_if(l.doc_id IS NULL)::BIGINT AS missing FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def collection_status(spark, sf_dir):
    both = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").withColumn("there", F.lit(True)), "doc_id", "left")
    return both.groupBy(F.col("source").alias("collection")).agg(F.count("*").alias("total"), F.count_if(F.col("quality") == 1).alias("ok"), F.count_if(F.col("there").isNull()).alias("missing"))


def manifests(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(current, previous) records: labels are the last manifest, every seventh with another version."""
    docs = table(spark, sf_dir, "documents")
    current = docs.select(F.col("doc_id").alias("item_key"), F.col("n_chars").alias("version"), F.when(F.col("doc_id") % 5 > 0, F.col("doc_id")).alias("source_mtime"))
    old = table(spark, sf_dir, "labels").join(docs.select("doc_id", "n_chars"), "doc_id")
    version = F.col("n_chars") + F.when(F.col("doc_id") % 7 == 0, 1).otherwise(0)
    mtime = F.col("doc_id") + F.when(F.col("doc_id") % 11 == 0, 1).otherwise(0)
    return current, old.select(F.col("doc_id").alias("item_key"), F.when(F.col("quality") == 1, "ok").otherwise("empty").alias("status"), version.alias("version"), mtime.alias("source_mtime"))


PLAN = """p AS (SELECT d.doc_id AS item_key, CASE WHEN coalesce(l.quality = 1 AND d.doc_id % 7 <> 0 AND (d.doc_id % 5 = 0 OR d.doc_id % 11 <> 0), false) THEN 'skip' ELSE 'convert' END AS action FROM documents d LEFT JOIN labels l USING (doc_id))"""


@query(f"WITH {PLAN} SELECT item_key, action FROM p")
def delta_plan(spark, sf_dir):
    return planned(*manifests(spark, sf_dir)).select("item_key", "action")


@query(f"""WITH {PLAN} SELECT DISTINCT item_key FROM (SELECT doc_id * 3 AS item_key FROM labels WHERE doc_id * 3 NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT item_key FROM p WHERE action = 'convert')""")
def stale_keys(spark, sf_dir):
    current, old = manifests(spark, sf_dir)
    indexed = table(spark, sf_dir, "labels").select((F.col("doc_id") * 3).alias("item_key"))
    return stale(indexed, current, planned(current, old).filter("action = 'convert'"))


@query(f"WITH {PLAN} SELECT count(*) AS total, count_if(action = 'convert')::BIGINT AS converted, count_if(action = 'skip')::BIGINT AS skipped FROM p")
def run_summary(spark, sf_dir):
    return delta_plan(spark, sf_dir).agg(F.count("*").alias("total"), F.count_if(F.col("action") == "convert").alias("converted"), F.count_if(F.col("action") == "skip").alias("skipped"))


ATTACHED = """a AS (SELECT page_id AS key, page_id // 5 AS parent, CASE page_id % 3 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'text/html' ELSE 'image/png' END AS content_type,
CASE page_id % 4 WHEN 0 THEN 'storage:f' || page_id || '.pdf' WHEN 1 THEN 'attachments:sub/./g' || page_id || '.HTML' WHEN 2 THEN '/abs/../x//' || page_id || '.md' END AS path, CASE WHEN page_id % 6 < 4 THEN url ELSE '' END AS url FROM pages),
r AS (SELECT *, CASE key % 4 WHEN 0 THEN '/data/storage/' || key || '/f' || key || '.pdf' WHEN 1 THEN '/base/sub/g' || key || '.HTML' WHEN 2 THEN '/x/' || key || '.md' END AS local, CASE key % 4 WHEN 0 THEN 'f' || key || '.pdf' WHEN 1 THEN 'g' || key || '.HTML' WHEN 2 THEN key || '.md' ELSE '' END AS filename,
key % 8 IN (0, 1) AS exists FROM a), e AS (SELECT *, CASE WHEN exists THEN 'local' WHEN length(url) > 0 THEN 'link' ELSE 'missing' END AS state FROM r)"""


def attached(spark, sf_dir) -> DataFrame:
    k = F.col("page_id")
    path = F.expr("CASE page_id % 4 WHEN 0 THEN 'storage:f' || page_id || '.pdf' WHEN 1 THEN 'attachments:sub/./g' || page_id || '.HTML' WHEN 2 THEN '/abs/../x//' || page_id || '.md' END")
    kind = F.expr("CASE page_id % 3 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'text/html' ELSE 'image/png' END")
    rows = table(spark, sf_dir, "pages").select(k.cast("string").alias("key"), F.floor(k / 5).alias("parent"), kind.alias("content_type"), F.lit(None).cast("string").alias("filename"), path.alias("path"), F.when(k % 6 < 4, F.col("url")).otherwise("").alias("url"), k.alias("att_ord"))
    located = catalog.located(rows, "/data", "/base")
    return catalog.with_existence(located, located.filter(F.col("att_ord") % 8 < 2).select(F.col("local").alias("path")))


@query(f"WITH {ATTACHED} SELECT key::BIGINT AS key, local, filename, exists, state FROM e")
def attachment_resolve(spark, sf_dir):
    return attached(spark, sf_dir).select(F.col("key").cast("long").alias("key"), "local", "filename", "exists", "state")


@query(f"""WITH {ATTACHED}, k AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY CASE WHEN content_type = 'application/pdf' AND exists THEN 0 WHEN content_type = 'text/html' AND local IS NOT NULL THEN 1 WHEN length(url) > 0 THEN 2 ELSE 3 END, key) AS rn FROM e)
SELECT parent, key::BIGINT AS key FROM k WHERE rn = 1""")
def attachment_pick(spark, sf_dir):
    return catalog.picked(attached(spark, sf_dir)).select("parent", F.col("key").cast("long").alias("key"))


@query(f"""WITH {ATTACHED} SELECT key::BIGINT AS key, CASE WHEN local IS NOT NULL AND (content_type = 'application/pdf' OR key % 4 = 0) THEN 'ocr' WHEN local IS NOT NULL AND (key % 4 = 1 OR content_type = 'text/html') THEN 'html' WHEN key % 4 = 2 THEN 'plain' WHEN length(url) > 0 THEN 'web' ELSE 'empty' END AS route FROM e""")
def route_assign(spark, sf_dir):
    ext = F.regexp_extract("filename", r"(\.[^.]+)$", 1)
    return attached(spark, sf_dir).select(F.col("key").cast("long").alias("key"), convert.route(F.col("content_type"), ext, F.lit("ocr"), F.col("url"), F.col("local")).alias("route"))


@query(f"WITH {NUMBERED} SELECT doc_id, CASE WHEN avg(length(body)) >= 200 THEN 'text' ELSE 'ocr' END AS pdf_class FROM s WHERE pos < 10 GROUP BY doc_id")
def classify_sampled(spark, sf_dir):
    return convert.classified(lines_of(spark, sf_dir).withColumnRenamed("pos", "page"))


def items(spark, sf_dir) -> DataFrame:
    name = lambda last: F.struct(F.lit(last).alias("lastName"), F.lit(None).cast("string").alias("firstName"), F.col("lang").alias("name"))
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.col("text").alias("title"), F.col("n_chars").cast("string").alias("date"), F.array(name("Ada"), name("Bo")).alias("creators"), F.array("source", "lang").alias("tags"), F.col("doc_id").alias("ord"))


@query("SELECT doc_id, text AS title FROM documents WHERE contains(lower(text), 'the') AND n_chars::VARCHAR LIKE '1%' AND contains(lower('Ada' || lang || ' Bo' || lang), 'aen b') AND list_contains([source, lang], 'en') ORDER BY doc_id LIMIT 20")
def item_search(spark, sf_dir):
    return catalog.search_items(items(spark, sf_dir), title="The", year="1", creator="AEN B", tag="en", limit=20).select("doc_id", "title")


@query("SELECT n_nationkey::BIGINT AS key, n_name AS name FROM nation WHERE contains(lower(n_name), 'nation') ORDER BY n_nationkey LIMIT 1")
def resolve_name(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("key"), F.col("n_name").alias("name"), F.col("n_nationkey").alias("api_ord"))
    return catalog.resolve(rows, "Nation").select(F.col("key").cast("long").alias("key"), "name")


@query("""WITH r AS (SELECT conv_id, turn, role, substr(text, 1, 300) AS preview, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations WHERE lower(role) = 'user')
SELECT conv_id, turn, role, preview FROM r WHERE rn <= 3""")
def annotations_recent(spark, sf_dir):
    """The last three of every item."""
    rows = table(spark, sf_dir, "conversations")
    notes = rows.select(F.col("conv_id").alias("item_key"), F.upper("role").alias("color"), F.lpad(F.col("turn").cast("string"), 12, "0").alias("modified"), F.col("turn").alias("ord"), "role", "text", "turn", F.lit("note").alias("type"))
    return catalog.annotations(notes, None, color="user", kind="note", n=3).select(F.col("item_key").alias("conv_id"), "turn", "role", F.substring("text", 1, 300).alias("preview"))


@query("SELECT conv_id, count(*) AS n, string_agg(turn || ':' || role, ',' ORDER BY turn, role) AS children FROM conversations GROUP BY conv_id")
def group_children(spark, sf_dir):
    rows = catalog.grouped(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role")
    return rows.select("conv_id", "n", F.array_join(F.transform("children", lambda c: F.concat_ws(":", c["turn"].cast("string"), c["role"])), ",").alias("children"))


@query("SELECT conv_id, CASE WHEN count(*) = 1 THEN arg_min(role, (turn, role)) ELSE arg_min(role, (turn, role)) || ' 等(' || count(*) || ')' END AS creator FROM conversations GROUP BY conv_id")
def creator_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("lastName", F.col("role")).withColumn("name", F.lit(""))
    return catalog.grouped(rows, "conv_id", "turn", "lastName", "name").select("conv_id", T.creator_summary(F.col("children")).alias("creator"))


def job_events(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.col("event_type").alias("status"), "ts", F.col("event_id").alias("seq"))


@query("SELECT user_id AS job_id, arg_max(event_type, event_id) AS status, max(event_id) AS last FROM events GROUP BY 1")
def job_latest_state(spark, sf_dir):
    return jobs.latest(job_events(spark, sf_dir)).select("job_id", "status", "last")


@query("WITH r AS (SELECT user_id AS job_id, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) SELECT job_id, seq FROM r WHERE rn <= 50")
def job_log_ring(spark, sf_dir):
    return jobs.ring(job_events(spark, sf_dir), jobs.SHOWN).select("job_id", "seq")


@query("SELECT user_id AS job_id, min(event_id) AS first FROM events GROUP BY 1 ORDER BY 2 DESC, 1 DESC LIMIT 100")
def jobs_recent(spark, sf_dir):
    rows = job_events(spark, sf_dir).groupBy("job_id").agg(F.min("seq").alias("created_at"))
    return jobs.newest(rows).select("job_id", F.col("created_at").alias("first"))


@query("SELECT count_if(s NOT IN ('purchase', 'error', 'done', 'cancelled'))::BIGINT AS active FROM (SELECT arg_max(event_type, event_id) AS s FROM events GROUP BY user_id)")
def jobs_active(spark, sf_dir):
    rows = jobs.latest(job_events(spark, sf_dir)).withColumn("status", F.when(F.col("status") == "purchase", "done").otherwise(F.col("status")))
    return jobs.active(rows)


NOTE = "chr(10) || chr(10) || '…（已截断，全文 ' || length(text) || ' 字符）'"


@query(f"SELECT doc_id, md5(CASE WHEN length(text) > 200000 THEN substr(text, 1, 200000) || {NOTE} ELSE text END) AS hash, md5(CASE WHEN length(text) > 2000 THEN substr(text, 1, 2000) || {NOTE} ELSE text END) AS hash_2000 FROM documents")
def read_item(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", md5(T.truncated(F.col("text"))).alias("hash"), md5(T.truncated(F.col("text"), 2000)).alias("hash_2000"))


@query("SELECT 'region' AS kind, r_regionkey::BIGINT AS key, r_name AS name, NULL::BIGINT AS parent FROM region UNION ALL SELECT 'nation', n_nationkey, n_name, n_regionkey FROM nation")
def union_catalog(spark, sf_dir):
    top = table(spark, sf_dir, "region").select(F.lit("region").alias("kind"), F.col("r_regionkey").cast("long").alias("key"), F.col("r_name").alias("name"))
    rest = table(spark, sf_dir, "nation").select(F.lit("nation").alias("kind"), F.col("n_nationkey").cast("long").alias("key"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("long").alias("parent"))
    return top.unionByName(rest, allowMissingColumns=True)


@query("SELECT doc_id, coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'p' || doc_id END, ''), (doc_id + 1)::VARCHAR) AS label, nullif(substr(n_chars::VARCHAR, 1, 4), '') AS year FROM documents")
def page_labels(spark, sf_dir):
    label = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.concat(F.lit("p"), F.col("doc_id").cast("string")))
    return table(spark, sf_dir, "documents").select("doc_id", T.page_label(label, F.col("doc_id")).alias("label"), T.year_of(F.col("n_chars").cast("string")).alias("year"))


@query()
def embed_stub(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", embedded(HashEmbedder(), F.col("text")).alias("vector"))


@query("SELECT doc_id, 'text' AS kind, md5(text) AS text FROM documents")
def ocr_stub(spark, sf_dir):
    images = table(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("page"), F.lit("").alias("label"), F.encode("text", "utf-8").alias("image"))
    return convert.ocr_lines(images.select("doc_id", "page", recognised(StubOcr(), F.col("image")).alias("raw"))).select("doc_id", "kind", "text")


@query()
def html_extract(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", extracted(F.col("html")).alias("text"))


@query("SELECT source, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY source")
def stream_ingest(spark, sf_dir):
    """Documents through a stream into batches of counts, summed."""
    from scholarlake.streaming.ingest import ingest

    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    out = f"{folder}/out"
    schema = table(spark, sf_dir, "documents").schema.simpleString()[7:-1].replace(":", " ")

    def each(rows: DataFrame, batch: int) -> None:
        rows.groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars")).write.mode("overwrite").parquet(f"{out}/batch={batch}")

    ingest(spark, f"{sf_dir}/documents.parque[t]", schema, each, f"{folder}/checkpoint").awaitTermination()
    rows = spark.read.schema("source string, n long, chars long").parquet(f"{out}/batch=*")
    return rows.groupBy("source").agg(F.sum("n").alias("n"), F.sum("chars").alias("chars"))


# The catalog's records, made from documents: every third is an attachment, every fourth a note, every fifth an annotation.
KIND_OF = "CASE WHEN doc_id % 5 = 4 THEN 'annotation' WHEN doc_id % 4 = 3 THEN 'note' WHEN doc_id % 3 = 2 THEN 'attachment' WHEN doc_id % 2 = 0 THEN 'book' ELSE 'article' END"


def raw_records(spark, sf_dir) -> DataFrame:
    """Documents as raw records of the catalog."""
    k = F.col("doc_id")
    key = k.cast("string")
    kind = F.expr(KIND_OF)
    up = (k - k % 3 + 2).cast("string")
    data = F.struct(
        key.alias("key"), kind.alias("itemType"), F.when(k % 7 > 0, F.col("source")).alias("title"), F.when(k % 7 == 0, F.col("lang")).alias("name"), F.concat(F.col("n_chars").cast("string"), F.lit("-05")).alias("date"),
        F.when(k % 2 == 0, "").otherwise(F.col("lang")).alias("publicationTitle"), F.col("source").alias("publisher"), F.array(F.struct(F.col("lang").alias("lastName"), F.lit(None).cast("string").alias("name")), F.struct(F.lit(None).cast("string").alias("lastName"), F.col("source").alias("name"))).alias("creators"),
        F.array(F.struct(F.col("lang").alias("tag"))).alias("tags"), up.alias("parentItem"), F.concat(F.lit("storage:"), key).alias("path"), F.lit("text/html").alias("contentType"), F.col("text").alias("note"), F.col("text").alias("annotationText"),
        F.when(k % 2 == 0, "#FFD400").otherwise("#ff6666").alias("annotationColor"), F.lpad(key, 12, "0").alias("dateModified"),
    )
    return table(spark, sf_dir, "documents").select(k.alias("ord"), F.col("source").alias("collection"), F.to_json(F.struct(data.alias("data"), F.col("n_chars").alias("version"))).alias("json"))


@query(f"""WITH r AS (SELECT *, {KIND_OF} AS kind FROM documents) SELECT doc_id::VARCHAR AS item_key, kind AS item_type, CASE WHEN doc_id % 7 > 0 THEN source ELSE lang END AS title, n_chars AS version, substr(n_chars || '-05', 1, 4) AS year,
CASE WHEN doc_id % 2 = 0 THEN source ELSE lang END AS publication, lang AS tag, lang || ' 等(2)' AS creator, source AS collection FROM r WHERE kind IN ('book', 'article')""")
def catalog_items(spark, sf_dir):
    rows = rest.items(raw_records(spark, sf_dir))
    return rows.select("item_key", "item_type", "title", "version", "year", "publication", F.element_at("tags", 1).alias("tag"), T.creator_summary(F.col("creators")).alias("creator"), "collection")


@query(f"WITH r AS (SELECT *, {KIND_OF} AS kind FROM documents) SELECT (doc_id - doc_id % 3 + 2)::VARCHAR AS parent, doc_id::VARCHAR AS key, '/data/storage/' || doc_id || '/' || doc_id AS local, doc_id::VARCHAR AS filename FROM r WHERE kind = 'attachment'")
def catalog_attachments(spark, sf_dir):
    return catalog.located(rest.attachments(raw_records(spark, sf_dir)), "/data", None).select("parent", "key", "local", "filename")


@query(f"WITH r AS (SELECT *, {KIND_OF} AS kind FROM documents) SELECT (doc_id - doc_id % 3 + 2)::VARCHAR AS item_key, doc_id::VARCHAR AS key, md5(text) AS hash, lang AS tag FROM r WHERE kind = 'note'")
def catalog_notes(spark, sf_dir):
    return rest.notes(raw_records(spark, sf_dir)).select("item_key", "key", md5(F.col("html")).alias("hash"), F.element_at("tags", 1).alias("tag"))


@query(f"""WITH r AS (SELECT *, doc_id - doc_id % 3 + 2 AS up, {KIND_OF} AS kind FROM documents)
SELECT a.up::VARCHAR AS item_key, n.up::VARCHAR AS attachment, md5(n.text) AS hash, CASE WHEN n.doc_id % 2 = 0 THEN '#FFD400' ELSE '#ff6666' END AS color FROM r n JOIN r a ON a.doc_id = n.up AND a.kind = 'attachment' WHERE n.kind = 'annotation'""")
def catalog_annotations(spark, sf_dir):
    raw = raw_records(spark, sf_dir)
    return rest.annotations(raw, rest.attachments(raw)).select("item_key", "attachment", md5(F.col("text")).alias("hash"), "color")


PAGED = 230


@query("WITH c AS (SELECT n_nationkey AS c, n_name FROM nation), r AS (SELECT c, i, CASE WHEN i % 3 = 0 THEN 'book' ELSE 'note' END AS kind FROM c, range(0, 230 + c) t(i)) SELECT c::VARCHAR AS collection, count(*) AS n, sum(i)::BIGINT AS places FROM r WHERE kind = 'book' GROUP BY c")
def catalog_pages(spark, sf_dir):
    """Pages of records by collection through the registered source; the type goes to the service."""

    def fetch(path: str, params: dict) -> list[dict]:
        c, start, n = int(path.split("/")[1]), int(params["start"]), int(params["limit"])
        every = ({"data": {"key": f"{c}-{i}", "itemType": "note" if i % 3 else "book", "place": i}} for i in range(PAGED + c))
        found = [r for r in every if params.get("itemType") in (None, r["data"]["itemType"])]
        return found[start : start + n]

    rest.register_catalog(spark, fetch, "pagedcatalog")
    # The catalog's collections, one partition each.
    keys = [str(r.n_nationkey) for r in table(spark, sf_dir, "nation").select("n_nationkey").distinct().collect()]
    raw = spark.read.format("pagedcatalog").option("collections", ",".join(sorted(keys))).load().filter("item_type = 'book'")
    return raw.groupBy("collection").agg(F.count("*").alias("n"), F.sum(F.get_json_object("json", "$.data.place").cast("long")).alias("places"))


@query("""WITH m AS (SELECT source, count(*) AS total, count_if(quality = 1)::BIGINT AS ok FROM documents JOIN labels USING (doc_id) GROUP BY source), c AS (SELECT DISTINCT source FROM documents)
SELECT c.source AS name, 1::BIGINT AS depth, coalesce(total, 0) AS total, coalesce(ok, 0) AS ok, total IS NOT NULL AS is_prepared FROM c LEFT JOIN m USING (source)
UNION ALL SELECT 'root', 0, 0, 0, false""")
def collections_prepared(spark, sf_dir):
    """Collections below one root with the state of each, joined by slug."""
    docs = table(spark, sf_dir, "documents")
    names = docs.groupBy("source").agg(F.min("doc_id").alias("api_ord"), F.count("*").alias("num_items"))
    one = spark.range(1).select(F.lit("root").alias("key"), F.lit("root").alias("name"), F.lit(None).cast("string").alias("parent"), F.lit(0).cast("long").alias("num_items"), F.lit(-1).cast("long").alias("api_ord"))
    rows = one.unionByName(names.select(F.concat(F.lit("k"), "source").alias("key"), F.col("source").alias("name"), F.lit("root").alias("parent"), "num_items", "api_ord"))
    entries = docs.join(table(spark, sf_dir, "labels"), "doc_id").select(T.slug(F.col("source")).alias("collection"), F.when(F.col("quality") == 1, "ok").otherwise("empty").alias("status"))
    return api.collections(rows, entries).select("name", "depth", "total", "ok", "is_prepared")


@query(f"{TREE}, p AS (SELECT key, depth, list_transform(string_split(path, '/'), lambda x: x::BIGINT) AS place FROM t) SELECT row_number() OVER (ORDER BY place) AS ord, repeat('  ', depth::INTEGER) || source AS line FROM p JOIN documents ON doc_id = key")
def collection_listing(spark, sf_dir):
    return catalog.listing(nested(spark, sf_dir))


@query(f"WITH {NUMBERED} SELECT doc_id, (pos // 7)::INTEGER AS page, md5(string_agg(body, chr(10) || chr(10) ORDER BY pos % 3, pos)) AS hash FROM s WHERE body <> '' AND pos % 5 <> 2 GROUP BY doc_id, pos // 7")
def page_blocks(spark, sf_dir):
    """Lines as text blocks of pages, by height then place."""
    pos = F.col("pos")
    blocks = lines_of(spark, sf_dir).select("doc_id", F.floor(pos / 7).cast("int").alias("page"), (pos % 3).cast("double").alias("y0"), pos.cast("double").alias("x0"), "text", F.when(pos % 5 == 2, 1).otherwise(0).alias("type"))
    return convert.ordered_blocks(blocks).select("doc_id", "page", md5(F.col("text")).alias("hash"))


@query(f"""WITH h AS (SELECT embedding, row_number() OVER (ORDER BY vec_id) AS rn FROM embeddings WHERE label = 0), e AS (SELECT unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM h WHERE rn <= 3),
c AS (SELECT list(x ORDER BY i) AS embedding FROM (SELECT i, avg(x) AS x FROM e GROUP BY i)), s AS (SELECT v.label, v.vec_id, {SIM.replace('q.embedding', 'c.embedding')} AS sim FROM embeddings v, c WHERE v.label <> 0)
SELECT label::VARCHAR AS item_key, max(sim) AS sim, arg_max(vec_id, (sim, -vec_id))::VARCHAR AS page FROM s GROUP BY label ORDER BY 2 DESC, 1 LIMIT 5""")
def similar_to_item(spark, sf_dir):
    """Items (labels) nearest to the first."""
    rows = vectors(spark, sf_dir).select(F.col("collection").cast("string").alias("item_key"), "vector", F.col("key").alias("page_ord"), F.lit(0).cast("long").alias("window_ord"), F.col("key").cast("string").alias("page"), *[F.lit("").alias(c) for c in ("title", "creator", "year", "collection", "text")])
    return search.similar_items(rows, "0", 5).select("item_key", "sim", "page")


@query(f"""WITH p AS (SELECT d.doc_id AS item_key, CASE WHEN coalesce(l.quality = 1 AND d.doc_id % 7 <> 0 AND (d.doc_id % 5 = 0 OR d.doc_id % 11 <> 0) AND d.doc_id % 2 = 0, false) THEN 'skip' ELSE 'convert' END AS action FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT item_key, action, 'convert' AS rebuilt FROM p""")
def delta_with_content(spark, sf_dir):
    """The plan where only even documents still have their content, and a rebuild of all."""
    current, old = manifests(spark, sf_dir)
    content = current.filter("item_key % 2 = 0").select("item_key")
    again = planned(current, old, content, rebuild=True).select("item_key", F.col("action").alias("rebuilt"))
    return planned(current, old, content).select("item_key", "action").join(again, "item_key")


@query("SELECT vec_id AS key, len(embedding)::BIGINT AS dim FROM embeddings")
def vector_dimension(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    size = rows.select(F.size("vector").alias("n")).limit(1).collect()
    return rows.select("key", F.size(checked(F.col("vector"), size[0].n if size else 0)).cast("long").alias("dim"))


def stored(spark, sf_dir) -> Store:
    """A store with documents of each language as a collection: manifest, content, packs."""
    store = Store(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")
    docs = table(spark, sf_dir, "documents")
    key = F.col("doc_id").cast("string")
    entries = docs.select(F.col("lang").alias("collection"), key.alias("item_key"), F.concat(F.lit("d"), key).alias("dir"), F.concat(F.col("source"), F.lit(" "), key).alias("title"), F.lit("").alias("creator"), F.lit(None).cast("string").alias("year"), F.lit("text").alias("route"), F.lit(0).cast("long").alias("pages"), F.col("n_chars").alias("chars"), F.lit("ok").alias("status"), F.array().cast("array<string>").alias("notes"), F.col("n_chars").alias("version"), F.lit(None).cast("long").alias("source_mtime"), md5(F.col("text")).alias("content_hash"), F.col("doc_id").alias("ord"), F.col("text").alias("markdown"), F.col("source").alias("meta"))
    # Languages are few.
    with store.transaction() as t:
        for lang in sorted(r.lang for r in docs.select("lang").distinct().collect()):
            for name in ("manifest", "content", "packs"):
                t.replace(name, lang, entries.filter(F.col("collection") == lang))
    return store


@query("SELECT lang AS collection, doc_id::VARCHAR AS item_key, source || ' ' || doc_id AS title, n_chars AS chars, md5(text) AS hash, source AS meta FROM documents")
def store_round_trip(spark, sf_dir):
    """Manifest, content and packs written by collection and read back together."""
    store = stored(spark, sf_dir)
    text = store.read("content").select("collection", "item_key", md5(F.col("markdown")).alias("hash"))
    packs = store.read("packs").select("collection", "item_key", "meta")
    return store.read("manifest").join(text, ["collection", "item_key"]).join(packs, ["collection", "item_key"]).select("collection", "item_key", "title", "chars", "hash", "meta")


@query(f"WITH f AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM documents WHERE contains(source || ' ' || doc_id, '1')) SELECT lang AS collection, doc_id::VARCHAR AS item_key, md5(CASE WHEN length(text) > 200000 THEN substr(text, 1, 200000) || {NOTE} ELSE text END) AS hash FROM f WHERE rn = 1")
def store_read_item(spark, sf_dir):
    """The first item of each collection whose title holds the needle."""
    store = stored(spark, sf_dir)
    out = None
    for lang in sorted(r.collection for r in store.read("manifest").select("collection").distinct().collect()):
        one = api.read_item(store, lang, "1").select(F.lit(lang).alias("collection"), "item_key", md5(F.col("text")).alias("hash"))
        out = one if out is None else out.unionByName(one)
    return out


@query("""SELECT label::VARCHAR AS collection, count(*) AS n FROM embeddings WHERE label % 3 <> 1 AND NOT (label % 3 = 2 AND (vec_id // 3) % 4 = 0) GROUP BY label""")
def store_append_delete(spark, sf_dir):
    """Chunks written and appended by halves; every third collection then loses some items, every third all; counted."""
    store = Store(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")
    rows = vectors(spark, sf_dir)
    made = rows.select("vector", F.col("collection").cast("string").alias("collection"), F.floor(F.col("key") / 3).cast("string").alias("item_key"), *[F.lit("").alias(c) for c in ("text", "page", "title", "creator", "year", "source_file")], F.col("key").alias("page_ord"), F.lit(0).cast("long").alias("window_ord"), F.lit("m").alias("model"))
    # Labels are few.
    for label in sorted(r.collection for r in rows.select("collection").distinct().collect()):
        own = made.filter(F.col("collection") == str(label))
        store.append_chunks(str(label), own.filter("page_ord % 2 = 0"))
        store.append_chunks(str(label), own.filter("page_ord % 2 = 1"))
        if label % 3 == 1:
            store.reset(str(label))
        elif label % 3 == 2:
            store.delete_items(str(label), store.item_keys(str(label)).filter("cast(item_key as long) % 4 = 0"))
    return store.read("chunks").groupBy("collection").agg(F.count("*").alias("n"))


def texts_of(spark, sf_dir, text=None) -> DataFrame:
    """Documents as content rows; the store names the collection."""
    key = F.col("doc_id").cast("string")
    return table(spark, sf_dir, "documents").select("doc_id", key.alias("item_key"), F.concat(F.lit("d"), key).alias("dir"), (F.col("text") if text is None else text).alias("markdown"))


def written_versions(spark, sf_dir) -> Store:
    """Documents in four versions: all; every third with more text; without every seventh; compacted."""
    store = Store(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")
    docs = texts_of(spark, sf_dir)
    store.replace("content", "all", docs)
    store.upsert("content", "all", texts_of(spark, sf_dir, F.concat(F.col("text"), F.lit(" again"))).filter("doc_id % 3 = 0"), docs.limit(0))
    with store.transaction() as t:
        t.delete("content", "all", docs.filter("doc_id % 7 = 0"))
    store.compact("content", "all", deleted=0.0)
    return store


@query("""WITH c AS (SELECT doc_id, length(text) AS a, length(text) + CASE WHEN doc_id % 3 = 0 THEN 6 ELSE 0 END AS b FROM documents)
SELECT 1::BIGINT AS version, count(*) AS n, sum(a)::BIGINT AS chars FROM c UNION ALL SELECT 2, count(*), sum(b)::BIGINT FROM c
UNION ALL SELECT v, count(*), sum(b)::BIGINT FROM c, (VALUES (3), (4)) t(v) WHERE doc_id % 7 <> 0 GROUP BY v""")
def store_time_travel(spark, sf_dir):
    """Rows and characters of every version of a collection."""
    store = written_versions(spark, sf_dir)
    out = None
    for version in range(1, store.snapshot().version + 1):
        one = store.at(version).read("content", "all").agg(F.lit(version).cast("long").alias("version"), F.count("*").alias("n"), F.sum(F.length("markdown")).alias("chars"))
        out = one if out is None else out.union(one)
    return out


@query("SELECT doc_id::VARCHAR AS item_key, md5(CASE WHEN doc_id % 3 = 0 THEN text || ' again' ELSE text END) AS hash FROM documents WHERE doc_id % 7 <> 0")
def store_compacted(spark, sf_dir):
    """What is left of a collection after changes, deletes and a compaction."""
    return written_versions(spark, sf_dir).read("content", "all").select("item_key", md5(F.col("markdown")).alias("hash"))


@query("""SELECT doc_id::VARCHAR AS item_key, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END::BIGINT AS version, length(x) AS chars, md5(x) AS hash, md5(x) AS content_hash
FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text || ' again' ELSE text END AS x FROM documents WHERE doc_id % 5 <> 0)""")
def stream_delta(spark, sf_dir):
    """Documents as a stream of changes: all new; every third changed and every seventh sent again unchanged but for its text; every fifth deleted."""
    from scholarlake.plans.prepare import Engines
    from scholarlake.streaming.ingest import CHANGES, delta, ingest

    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    store, key = Store(spark, f"{folder}/store"), F.col("doc_id").cast("string")
    docs = table(spark, sf_dir, "documents")
    record = lambda version, text, gone: docs.select("doc_id", key.alias("item_key"), F.col("doc_id").alias("ord"), F.concat_ws(" ", "source", key).alias("title"), F.lit("").alias("creator"), F.lit(None).cast("string").alias("year"), version.cast("long").alias("version"), F.lit(None).cast("long").alias("source_mtime"), F.concat(F.lit("d"), key).alias("dir"), *[F.lit(None).cast("string").alias(c) for c in ("content_type", "ext", "name", "path", "url")], text.alias("markdown"), F.lit(gone).alias("deleted"))
    again = F.concat(F.col("text"), F.lit(" again"))
    third = F.col("doc_id") % 3 == 0
    batches = [
        record(F.lit(1), F.col("text"), False),
        record(F.when(third, 2).otherwise(1), F.when(third, again).otherwise(F.lit("not a new version")), False).filter("doc_id % 3 = 0 OR doc_id % 7 = 0"),
        record(F.lit(3), F.lit(None).cast("string"), True).filter("doc_id % 5 = 0"),
    ]
    sink = delta(store, "all", Engines(HashEmbedder(16), model="hash"), "changes")
    for i, rows in enumerate(batches):
        rows.drop("doc_id").write.parquet(f"{folder}/in/{i}", compression="zstd")
        ingest(spark, f"{folder}/in/*", CHANGES, sink, f"{folder}/checkpoint").awaitTermination()
    found = store.read("content", "all").select("item_key", md5(F.col("markdown")).alias("hash"))
    return store.read("manifest", "all").join(found, "item_key").select("item_key", "version", "chars", "hash", "content_hash")


STATUS_OF = "CASE event_id % 9 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' WHEN 2 THEN 'deferred' WHEN 3 THEN 'done' WHEN 4 THEN 'queued' WHEN 5 THEN 'running' WHEN 6 THEN 'error' END"


@query(f"""WITH l AS (SELECT user_id::VARCHAR AS job_id, list({{'status': {STATUS_OF}, 'last': event_id, 'illegal': 0::BIGINT}} ORDER BY event_id) AS rows FROM events GROUP BY 1),
r AS (SELECT job_id, rows, list_reduce(list_prepend({{'status': '', 'last': (-1)::BIGINT, 'illegal': 0::BIGINT}}, rows), lambda a, x: CASE WHEN x.status IS NULL THEN a
WHEN (a.status = '' AND x.status = 'queued') OR (a.status = 'queued' AND x.status IN ('deferred', 'running', 'error')) OR (a.status = 'deferred' AND x.status IN ('queued', 'running', 'error')) OR (a.status = 'running' AND x.status IN ('done', 'error'))
THEN {{'status': x.status, 'last': x.last, 'illegal': a.illegal}} ELSE {{'status': a.status, 'last': a.last, 'illegal': a.illegal + 1}} END) AS s FROM l)
SELECT job_id, s.status AS status, s.last AS last, s.illegal AS illegal, least(len(rows), 20)::BIGINT AS kept, rows[greatest(1, len(rows) - 19)].last AS oldest FROM r""")
def stream_job_state(spark, sf_dir):
    """Events as a keyed stream in three runs over one checkpoint: status by legal transitions, illegal ones counted, the last 20 messages."""
    from scholarlake.streaming import states

    folder = f"{shared_folder(spark)}/jobs-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("job_id"), F.expr(STATUS_OF).alias("status"), F.col("event_type").alias("msg"), F.col("event_id").alias("seq"))
    third = F.percentile_approx("seq", [0.33, 0.66]).alias("c")
    low, high = (rows.agg(third).first().c or [0, 0])
    for i, part in enumerate([F.col("seq") <= low, (F.col("seq") > low) & (F.col("seq") <= high), F.col("seq") > high]):
        rows.filter(part).write.parquet(f"{folder}/in/{i}")
        states.follow(spark, f"{folder}/in/*", f"{folder}/out", f"{folder}/checkpoint", kept=20).awaitTermination()
    return states.current(spark, f"{folder}/out")


@query("""SELECT lang AS collection, count(*) AS total, count_if(CASE WHEN doc_id % 3 = 0 THEN doc_id % 2 = 0 ELSE n_chars > 500 END)::BIGINT AS ok FROM documents WHERE doc_id % 5 <> 0 GROUP BY lang""")
def counts_maintained(spark, sf_dir):
    """Counts by collection after three changes of its entries: all; every third with another status; every fifth gone. Nothing is counted again."""
    store = Store(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")
    docs = table(spark, sf_dir, "documents")
    key = F.col("doc_id").cast("string").alias("item_key")
    entry = lambda ok: docs.select("doc_id", "lang", key, F.when(ok, "ok").otherwise("empty").alias("status"))
    # Languages are few.
    for lang in sorted(r.lang for r in docs.select("lang").distinct().collect()):
        own = F.col("lang") == lang
        for rows, gone in ((entry(F.col("n_chars") > 500), "false"), (entry(F.col("doc_id") % 2 == 0).filter("doc_id % 3 = 0"), "false"), (entry(F.lit(True)).filter("false"), "doc_id % 5 = 0")):
            with store.transaction() as t:
                t.entries(lang, rows.filter(own), docs.filter(own).filter(gone).select(key))
    return api.counted(store)
