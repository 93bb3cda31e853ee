"""Schemas of the engine's tables."""

COLLECTIONS = "key string, name string, parent string, num_items bigint, num_collections bigint, api_ord bigint"
CREATORS = "array<struct<creatorType: string, firstName: string, lastName: string, name: string>>"
ITEMS = f"item_key string, item_type string, title string, version bigint, creators {CREATORS}, date string, year string, publication string, abstract string, tags array<string>, url string, doi string, collection string, ord bigint"
ATTACHMENTS = "parent string, key string, content_type string, filename string, link_mode string, path string, url string, att_ord bigint"
NOTES = "item_key string, key string, html string, tags array<string>, modified string, ord bigint"
ANNOTATIONS = "item_key string, attachment string, type string, text string, comment string, color string, page_label string, tags array<string>, modified string, ord bigint"
FILES = "path string, size bigint, mtime bigint, item_key string, name string, ext string"
CONVERTED = "item_key string, markdown string, route string, pages int, page_labels array<string>, notes array<string>"
CHUNKS = "vector array<float>, text string, page string, item_key string, title string, creator string, year string, collection string, source_file string, page_ord bigint, window_ord bigint, model string"
MANIFEST = "collection string, item_key string, dir string, title string, creator string, year string, route string, pages bigint, chars bigint, status string, notes array<string>, version bigint, source_mtime bigint, content_hash string, ord bigint"
JOB_EVENTS = "job_id string, kind string, params map<string,string>, status string, ts timestamp, msg string, seq bigint"
#: One raw record of the catalog's REST export, kept as JSON text.
RAW = "ord bigint, collection string, json string"
