"""Catalog operators: tree, name resolution, metadata search, annotations, attachments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholarlake.checkpoints import removed, written
from scholarlake.functions.text import empty_to_null
from scholarlake.operators.trees import numbered, one_a_key

# Attachment types.
PDF_TYPES = ("application/pdf",)
SNAPSHOT_TYPES = ("text/html", "application/xhtml+xml")


def chains(nodes: DataFrame, start: list[Column], step, over: Column) -> DataFrame:
    """``nodes(key, up, ...)`` followed upwards by doubling: every turn a row takes over what its ``up`` has found.

    ``start``: columns that each row begins with; ``step(own, above)``: their
    values after a turn; rows with ``over`` are done. The turns are the
    logarithm of the longest chain: when a turn ends none, what is left runs in
    a circle, for a chain of any length has all lengths below it. Joins are
    merge joins: small files hold many rows, which no broadcast takes through the driver.
    """
    at = written(nodes.select("key", "up", *start))
    names = [c for c in at.columns if c not in ("key", "up")]
    left = at.filter(~over).count()
    while left:
        above = at.select(F.col("key").alias("up"), F.col("up").alias("up_2"), *[F.col(c).alias(f"{c}_2") for c in names])
        joined = at.filter(~over).join(above.hint("merge"), "up", "left")
        rows = joined.select("key", F.col("up_2").alias("up"), *[step(c).alias(c) for c in names])
        new = written(at.filter(over).union(rows))
        removed(at)
        at, before, left = new, left, new.filter(~over).count()
        if left == before:
            break
    return at


def tree(collections: DataFrame, paths: bool = False) -> DataFrame:
    """Every collection below its root: depth, place in a depth-first listing, size of its subtree; with ``paths`` the keys from the root too.

    A collection whose parent is not there is a root; collections of a cycle,
    or only reachable from one, have no row; of rows that repeat a key the
    first by api_ord counts. Neither the depth nor the number of collections
    is limited; paths grow with the depth and are joined by doubling.
    """
    found = numbered(collections.select("key", "parent", "api_ord", "name", "num_items"))
    rows = found.select("key", "name", "num_items", "depth", F.col("pre").alias("place"), "size")
    if not paths:
        return rows
    nodes = found.select("key", F.when(F.col("depth") > 0, F.col("parent")).alias("up"))
    step = lambda c: F.concat(F.col(f"{c}_2"), F.col(c))
    return rows.join(chains(nodes, [F.array("key").alias("path")], step, F.col("up").isNull()).select("key", "path").hint("merge"), "key")


def listing(collections: DataFrame) -> DataFrame:
    """(ord, line): depth-first, two spaces a level."""
    line = F.concat(F.repeat(F.lit("  "), F.col("depth").cast("int")), F.col("name"))
    return tree(collections).select((F.col("place") + 1).alias("ord"), line.alias("line"))


def descendants(collections: DataFrame, key: str) -> DataFrame:
    """Keys of a collection and all below it, however deep: those whose place lies in its interval.

    A collection in a circle, or below one, has no interval; what is below it
    is found by following parents.
    """
    t = tree(collections)
    own = t.filter(F.col("key") == key).select("place", "size").collect()
    if own:
        return t.filter((F.col("place") >= own[0].place) & (F.col("place") < own[0].place + own[0]["size"])).select("key")
    nodes = one_a_key(collections.select("key", "parent", "api_ord")).select("key", F.col("parent").alias("up"))
    there = F.coalesce(F.col("up") == F.lit(key), F.lit(False))
    found = chains(nodes, [there.alias("below")], lambda c: F.coalesce(F.col(f"{c}_2"), F.lit(False)) | F.coalesce(F.col("up_2") == F.lit(key), F.lit(False)), F.col("below") | F.col("up").isNull())
    self_row = collections.sparkSession.range(1).select(F.lit(key).alias("key"))
    return found.filter("below").select("key").union(self_row).distinct()


def resolve(collections: DataFrame, name: str) -> DataFrame:
    """The collection that ``name`` means: key or name exactly, else the first whose name contains it; none for ""."""
    fold = F.lower(F.lit(name))
    rank = F.when((F.col("key") == name) | (F.col("name") == name), 0).when(F.contains(F.lower("name"), fold), 1)
    return collections.withColumn("rank", rank).filter(F.col("rank").isNotNull() & (F.lit(name) != "")).orderBy("rank", "api_ord").limit(1).drop("rank")


def search_items(items: DataFrame, title: str | None = None, year: str | None = None, creator: str | None = None, tag: str | None = None, limit: int = 20) -> DataFrame:
    """Items that meet all given conditions, in source order."""
    if title:
        items = items.filter(F.contains(F.lower("title"), F.lower(F.lit(title))))
    if year:
        items = items.filter(F.startswith(F.col("date"), F.lit(year)))
    if creator:
        part = lambda c, n: F.coalesce(c[n], F.lit(""))
        names = F.array_join(F.transform("creators", lambda c: F.concat(part(c, "lastName"), part(c, "firstName"), part(c, "name"))), " ")
        items = items.filter(F.contains(F.lower(names), F.lower(F.lit(creator))))
    if tag:
        items = items.filter(F.array_contains("tags", tag))
    return items.orderBy("ord").limit(limit)


def recent(rows: DataFrame, n: int, *more: Column) -> DataFrame:
    """The last modified rows first; equal times keep their order."""
    return rows.orderBy(F.desc("modified"), "ord", *more).limit(n)


def annotations(rows: DataFrame, item_key: str | None, color: str | None = None, kind: str | None = None, n: int = 50) -> DataFrame:
    """The last ``n`` annotations of an item, or of every item."""
    if item_key is not None:
        rows = rows.filter(F.col("item_key") == item_key)
    if color:
        rows = rows.filter(F.lower("color") == color.lower())
    if kind:
        rows = rows.filter(F.col("type") == kind)
    if item_key is not None:
        return recent(rows, n)
    last = Window.partitionBy("item_key").orderBy(F.desc("modified"), "ord")
    return rows.withColumn("rn", F.row_number().over(last)).filter(F.col("rn") <= n).drop("rn")


def grouped(children: DataFrame, parent: str, ordinal: str, *columns: str) -> DataFrame:
    """(parent, n, children: array in source order)."""
    row = F.struct(ordinal, *columns)
    return children.groupBy(parent).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(row)).alias("children"))


def once(records: DataFrame, key: str, ordinal: str, member_of: str, *columns: str) -> DataFrame:
    """One row a key: the first record, and all collections that list it."""
    first = F.min_by(F.struct(*columns), F.col(ordinal)).alias("first")
    return records.groupBy(key).agg(first, F.array_sort(F.collect_set(member_of)).alias("collections")).select(key, "first.*", "collections")


def located(attachments: DataFrame, data_dir: str | Column, linked_base: str | Column | None) -> DataFrame:
    """``local`` path and ``filename`` of attachments by the form of their path."""
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    path = F.coalesce(F.col("path"), F.lit(""))
    rest = lambda n: F.substring(path, n + 1, F.length(path))
    local = (
        F.when(F.startswith(path, F.lit("attachments:")), F.concat_ws("/", F.rtrim(as_column(linked_base), F.lit("/")), rest(12)) if linked_base is not None else F.lit(None))
        .when(F.startswith(path, F.lit("storage:")), F.concat_ws("/", F.rtrim(as_column(data_dir), F.lit("/")), F.lit("storage"), F.col("key"), rest(8)))
        .when(F.startswith(path, F.lit("/")), path)
    )
    base = F.element_at(F.split(F.replace(path, F.lit(":"), F.lit("/")), "/"), -1)
    return attachments.withColumn("local", normal_path(local)).withColumn("filename", F.coalesce(empty_to_null(F.col("filename")), base))


def normal_path(path: Column) -> Column:
    """Without doubled slashes, `.` parts and resolvable `..` parts."""
    parts = F.filter(F.split(path, "/+"), lambda x: (x != "") & (x != "."))
    up = F.aggregate(parts, F.array().cast("array<string>"), lambda done, x: F.when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.array_append(done, x)))
    return F.concat(F.when(F.startswith(path, F.lit("/")), "/").otherwise(""), F.array_join(up, "/"))


def with_existence(located_rows: DataFrame, files: DataFrame) -> DataFrame:
    """``exists`` from a file listing, and the label of the state."""
    there = files.select(F.col("path").alias("local"), F.lit(True).alias("exists")).distinct()
    out = located_rows.join(there, "local", "left").withColumn("exists", F.coalesce("exists", F.lit(False)))
    return out.withColumn("state", state(F.col("exists"), F.col("url")))


def state(exists: Column, url: Column) -> Column:
    return F.when(exists, "local").when(F.length(url) > 0, "link").otherwise("missing")


def picked(attachments: DataFrame) -> DataFrame:
    """One attachment an item: existing PDF, else snapshot with a path, else one with an address, else the first."""
    rank = (
        F.when(F.col("content_type").isin(*PDF_TYPES) & F.col("exists"), 0)
        .when(F.col("content_type").isin(*SNAPSHOT_TYPES) & F.col("local").isNotNull(), 1)
        .when(F.length("url") > 0, 2)
        .otherwise(3)
    )
    first = Window.partitionBy("parent").orderBy(rank, "att_ord")
    return attachments.withColumn("rn", F.row_number().over(first)).filter("rn = 1").drop("rn")
