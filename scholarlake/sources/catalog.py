"""The bibliographic catalog: a paged REST data source and the tables parsed from its records."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from urllib.parse import urlencode
from urllib.request import urlopen

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, InputPartition

from scholarlake.functions.text import empty_to_null, year_of
from scholarlake.schemas import CREATORS, RAW

# Page size, item types that are not bibliographic items.
PAGE = 100
CHILD_TYPES = ("attachment", "note", "annotation")
NO_TITLE = "(untitled)"

Fetch = Callable[[str, dict[str, str]], list[dict]]


def http_fetch(base_url: str, timeout: float = 20.0) -> Fetch:
    """GET <base_url>/<path>?<params>, a JSON array."""

    def fetch(path: str, params: dict[str, str]) -> list[dict]:
        with urlopen(f"{base_url.rstrip('/')}/{path}?{urlencode(params)}", timeout=timeout) as reply:
            return json.loads(reply.read())

    return fetch


def paged(fetch: Fetch, path: str, params: dict[str, str], page: int = PAGE) -> Iterator[dict]:
    """All records of a path: pages from 0 until one is empty or short."""
    start = 0
    while True:
        found = fetch(path, params | {"start": str(start), "limit": str(page)})
        yield from found
        if len(found) < page:
            return
        start += page


class OneCollection(InputPartition):
    def __init__(self, key: str | None, place: int):
        super().__init__(key)
        self.key, self.place = key, place


class CatalogReader(DataSourceReader):
    """One partition per collection; equality filters on the item type and the keyword go to the service."""

    def __init__(self, fetch: Fetch, options: dict[str, str]):
        self.fetch, self.options = fetch, options
        self.params = {k: options[o] for k, o in (("q", "q"), ("itemType", "itemtype")) if options.get(o)}

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("item_type",):
                self.params["itemType"] = f.value
            yield f

    def partitions(self):
        keys = [k for k in self.options.get("collections", "").split(",") if k]
        return [OneCollection(k, i) for i, k in enumerate(keys)] or [OneCollection(None, 0)]

    def read(self, partition):
        path = f"collections/{partition.key}/items" if partition.key else self.options.get("path", "items")
        for i, record in enumerate(paged(self.fetch, path, self.params, int(self.options.get("page", PAGE)))):
            # Collections in the order in which they are named, records in the service's.
            yield ((partition.place << 40) + i, partition.key, json.dumps(record), (record.get("data") or {}).get("itemType"))


def register_catalog(spark: SparkSession, fetch: Fetch | None = None, name: str = "catalog") -> None:
    """Register format ``name``: options base_url (without an injected ``fetch``), path or collections, q, itemType, page."""

    class Catalog(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return f"{RAW}, item_type string"

        def reader(self, schema):
            options = {k.lower(): v for k, v in self.options.items()}
            return CatalogReader(fetch or http_fetch(options["base_url"]), options)

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Catalog)


def field(name: str):
    return F.get_json_object("json", f"$.data.{name}")


def tags():
    return F.coalesce(F.transform(F.from_json(field("tags"), "array<struct<tag: string>>"), lambda t: t["tag"]), F.array().cast("array<string>"))


def collections(raw: DataFrame) -> DataFrame:
    """Collections; a parent of `false` or none is a root's."""
    meta = lambda n: F.coalesce(F.get_json_object("json", f"$.meta.{n}").cast("long"), F.lit(0))
    parent = F.nullif(F.nullif(field("parentCollection"), F.lit("false")), F.lit(""))
    return raw.select(field("key").alias("key"), field("name").alias("name"), parent.alias("parent"), meta("numItems").alias("num_items"), meta("numCollections").alias("num_collections"), F.col("ord").cast("long").alias("api_ord"))


def items(raw: DataFrame) -> DataFrame:
    """Bibliographic items, without children records."""
    title = F.coalesce(empty_to_null(field("title")), empty_to_null(field("name")), F.lit(NO_TITLE))
    return raw.withColumn("item_type", field("itemType")).filter(~F.col("item_type").isin(*CHILD_TYPES)).select(
        field("key").alias("item_key"), "item_type", title.alias("title"),
        F.coalesce(F.get_json_object("json", "$.version"), field("version")).cast("long").alias("version"),
        F.coalesce(F.from_json(field("creators"), CREATORS), F.array().cast(CREATORS)).alias("creators"),
        F.coalesce(field("date"), F.lit("")).alias("date"), year_of(field("date")).alias("year"),
        F.coalesce(empty_to_null(field("publicationTitle")), empty_to_null(field("publisher"))).alias("publication"),
        field("abstractNote").alias("abstract"), tags().alias("tags"), field("url").alias("url"), field("DOI").alias("doi"), "collection", F.col("ord").cast("long").alias("ord"),
    )


def attachments(raw: DataFrame) -> DataFrame:
    """Attachments of items, one row a key even where several collections list it."""
    found = raw.filter(field("itemType") == "attachment").select(
        field("parentItem").alias("parent"), field("key").alias("key"), field("contentType").alias("content_type"), field("filename").alias("filename"),
        field("linkMode").alias("link_mode"), field("path").alias("path"), field("url").alias("url"), F.col("ord").cast("long").alias("att_ord"),
    )
    return found.groupBy("key").agg(F.min_by(F.struct("parent", "content_type", "filename", "link_mode", "path", "url", "att_ord"), "att_ord").alias("a")).select("a.parent", "key", "a.content_type", "a.filename", "a.link_mode", "a.path", "a.url", "a.att_ord")


def notes(raw: DataFrame) -> DataFrame:
    return raw.filter(field("itemType") == "note").select(field("parentItem").alias("item_key"), field("key").alias("key"), field("note").alias("html"), tags().alias("tags"), field("dateModified").alias("modified"), F.col("ord").cast("long").alias("ord"))


def annotations(raw: DataFrame, attached: DataFrame) -> DataFrame:
    """Annotations with the item above their attachment: two equi joins on children."""
    found = raw.filter(field("itemType") == "annotation").select(
        field("parentItem").alias("attachment"), field("annotationType").alias("type"), field("annotationText").alias("text"), field("annotationComment").alias("comment"),
        field("annotationColor").alias("color"), field("annotationPageLabel").alias("page_label"), tags().alias("tags"), field("dateModified").alias("modified"), F.col("ord").cast("long").alias("ord"),
    )
    return found.join(attached.select(F.col("key").alias("attachment"), F.col("parent").alias("item_key")), "attachment").select("item_key", "attachment", "type", "text", "comment", "color", "page_label", "tags", "modified", "ord")
