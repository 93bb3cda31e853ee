"""Vector search: exact cosine top-k, as SQL for one query or by blocks of both sides for many."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholarlake.checkpoints import written
from scholarlake.functions.vectors import cosine, doubles, normalised
from scholarlake.sources.engines import Embedder

DIGITS = 6
#: Vectors of a block and queries of a block, pivots at most, and similarities that a task holds at a time.
BLOCK, QUERIES, PIVOTS, CELLS = 4096, 4096, 256, 1 << 21
#: Similarities are rounded; a bound must miss by more to leave a cell out.
MARGIN = 2e-6


def top_k(chunks: DataFrame, query: list[float], k: int = 8, collection: str | None = None, key: str = "chunk_id", vector: str = "vector") -> DataFrame:
    """The ``k`` rows nearest to one vector, best first; a collection is chosen before ranking. One partial top-k a task."""
    if collection is not None:
        chunks = chunks.filter(F.col("collection") == F.lit(collection))
    scored = chunks.withColumn("sim", F.round(cosine(F.col(vector), F.lit(list(map(float, query)))), DIGITS))
    return scored.filter("sim is not null and not isnan(sim)").orderBy(F.desc("sim"), key).limit(k)


def best_of(sim: np.ndarray, keys: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``k`` largest finite entries of each row, best first; ties by key."""
    if sim.shape[1] > k:
        least = -np.partition(-sim, k - 1, axis=1)[:, k - 1]
        row, column = np.nonzero(sim >= least[:, None])
    else:
        row, column = (x.ravel() for x in np.indices(sim.shape))
    there = np.isfinite(sim[row, column])
    row, column = row[there], column[there]
    order = np.lexsort((keys[column], -sim[row, column], row))
    row, column = row[order], column[order]
    first = np.searchsorted(row, np.arange(len(sim)))
    some = np.arange(len(row)) - first[row] < k
    return row[some], column[some]


def unit_rows(vectors: pa.Array) -> np.ndarray:
    """Unit vectors of equal size as rows; without a direction a row of NaN."""
    v = np.asarray(vectors.flatten(), np.float64).reshape(len(vectors), -1)
    size = np.linalg.norm(v, axis=1)[:, None]
    return np.divide(v, size, out=np.full_like(v, np.nan), where=size > 0)


def placing(pivots: np.ndarray | None, angles: bool):
    """For each row its nearest pivot and the angle to it (or those to all); rows of another size than the pivots' are one cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("_dim").to_numpy()
            for size in np.unique(sizes):
                rows = batch.filter(pa.array(sizes == size))
                unit = unit_rows(rows.column("vector"))
                rows, unit = rows.filter(pa.array(np.isfinite(unit).all(axis=1))), unit[np.isfinite(unit).all(axis=1)]
                if not rows.num_rows:
                    continue
                if pivots is not None and pivots.shape[1] == size:
                    all_of = np.arccos(np.clip(unit @ pivots.T, -1, 1))
                else:
                    all_of = np.zeros((rows.num_rows, 1))
                cell = all_of.argmin(axis=1).astype(np.int32)
                told = pa.array(list(all_of), pa.list_(pa.float64())) if angles else pa.array(all_of[np.arange(len(cell)), cell])
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(cell), told], [*rows.schema.names, "_cell", "_angle"])

    return run


def multiplied(found: pa.Table, block: pa.Table, k: int, but_self: bool) -> pa.Table:
    """The best ``k`` of one block of vectors for each query of one block of queries."""
    names = ["_q", "_key", "sim"]
    if not found.num_rows or not block.num_rows:
        return pa.table([found.column("_q").slice(0, 0), block.column("_key").slice(0, 0), pa.array([], pa.float64())], names)
    asked, keys = found.column("_q").to_pylist(), np.array(block.column("_key").to_pylist())
    q, v = unit_rows(found.column("vector").combine_chunks()), unit_rows(block.column("vector").combine_chunks()).T
    step, out = max(1, CELLS // len(keys)), []
    for at in range(0, len(asked), step):
        own = asked[at : at + step]
        sim = np.round(q[at : at + step] @ v, DIGITS)
        if but_self:
            sim[np.array(own)[:, None] == keys[None, :]] = -np.inf
        row, column = best_of(sim, keys, k)
        out.append(pa.table([pa.array([own[r] for r in row], found.schema.field("_q").type), pa.array(keys[column].tolist(), block.schema.field("_key").type), pa.array(sim[row, column])], names))
    return pa.concat_tables(out)


def knn(vectors: DataFrame, queries: DataFrame, k: int = 8, key: str = "key", query_key: str = "query_key", scope: str | None = None, but_self: bool = False, report: Callable[[int, int], None] | None = None) -> DataFrame:
    """(query_key, key, sim, rank) of vectors(key, vector[, scope]) for queries(query_key, vector[, scope]), exactly.

    Vectors form cells around a few of them as pivots, cells split into blocks
    of bounded size, and so do queries; a block of queries meets a block of
    vectors in one task, as a product of matrices whose best k go on. A query
    first meets its own cell. What it finds there bounds what it still needs:
    a cell is left out if, by the triangle inequality of angles, none of its
    vectors can be as near as the k-th found. ``report`` is told how many
    meetings of a query and a cell there could be, and how many were needed.
    ``scope``: only rows with the query's value, null meets none; ``but_self``:
    without the row of the query's key. Null vectors and those without a
    direction meet nothing, vectors of different sizes not each other.
    """
    key_type, q_type = vectors.schema[key].dataType.simpleString(), queries.schema[query_key].dataType.simpleString()
    within = F.col(scope).cast("string") if scope else F.lit("")
    own = lambda df, name, to: df.filter("vector IS NOT NULL").select(F.col(name).alias(to), F.col("vector").cast("array<double>").alias("vector"), within.alias("_scope"), F.size("vector").alias("_dim"))
    every, asked = own(vectors, key, "_key"), own(queries, query_key, "_q")
    sizes = dict(every.select(F.lit("v").alias("of")).union(asked.select(F.lit("q").alias("of"))).groupBy("of").count().collect())
    n, n_q = sizes.get("v", 0), sizes.get("q", 0)
    many, pivots = min(PIVOTS, n // BLOCK), None
    if many > 1:
        first = every.orderBy(F.xxhash64("_key")).limit(many).select("vector").collect()  # as many vectors as there are pivots
        pivots = unit_rows(pa.array([r.vector for r in first if len(r.vector) == len(first[0].vector)], pa.list_(pa.float64())))
        pivots = pivots[np.isfinite(pivots).all(axis=1)]
    columns = "vector array<double>, _scope string, _dim int, _cell int, _angle"
    placed = every.mapInArrow(placing(pivots, False), f"_key {key_type}, {columns} double")
    found = asked.mapInArrow(placing(pivots, True), f"_q {q_type}, {columns} array<double>").withColumn("_block", F.pmod(F.xxhash64("_q"), F.lit(max(1, -(-n_q // QUERIES)))))
    cell = ["_dim", "_scope", "_cell"]
    if many > 1:
        placed = written(placed)
        cells = placed.groupBy(*cell).agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("_parts"), F.min("_angle").alias("_low"), F.max("_angle").alias("_high"))
    else:
        cells = placed.select(*cell).distinct().withColumn("_parts", F.lit(max(1, -(-n // BLOCK))).cast("long"))
    group = [*cell, "_block", "_part"]

    def met(pairs: DataFrame) -> DataFrame:
        """The best of pairs(_q, vector, _block, cell, _parts), each query with all parts of its cells."""
        wanted = pairs.select(*cell, "_block", "_parts").distinct()
        left = pairs.select("_q", "vector", *cell, "_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)).alias("_part"))
        right = placed.select("_key", "vector", *cell).join(wanted, cell).withColumn("_part", F.pmod(F.xxhash64("_key"), F.col("_parts"))).select("_key", "vector", *[F.col(c).alias(f"{c}_v") for c in group])
        return left.groupBy(*group).cogroup(right.groupBy(*[f"{c}_v" for c in group])).applyInArrow(lambda a, b: multiplied(a, b, k, but_self), f"_q {q_type}, _key {key_type}, sim double")

    best = F.row_number().over(Window.partitionBy("_q").orderBy(F.desc("sim"), "_key"))
    if many <= 1:
        out = met(found.withColumn("_parts", F.lit(max(1, -(-n // BLOCK))).cast("long")))
    else:
        home = written(met(found.join(cells, cell)).withColumn("rank", best).filter(F.col("rank") <= k).drop("rank"))
        # A query's bound needs k finds; rows of one query share them.
        bound = home.groupBy(F.col("_q").alias("_of")).agg(F.when(F.count("*") >= k, F.min("sim")).alias("_least"))
        others = found.withColumnRenamed("_cell", "_home").join(cells, ["_dim", "_scope"]).filter("_cell != _home").join(bound, F.col("_q") == F.col("_of"), "left")
        away = F.element_at("_angle", F.col("_cell") + 1)
        nearest = F.greatest(away - F.col("_high"), F.col("_low") - away, F.lit(0.0))
        needed = others.filter(F.col("_least").isNull() | (F.cos(nearest) + MARGIN >= F.col("_least")))
        if report is not None:
            report(others.count(), needed.count())
        out = home.union(met(needed.select("_q", "vector", *cell, "_block", "_parts")))
    return out.withColumn("rank", best.cast("long")).filter(F.col("rank") <= k).select(F.col("_q").alias(query_key), F.col("_key").alias(key), "sim", "rank")


def centroids(vectors: DataFrame, item: str, order: list[str], first: int = 3) -> DataFrame:
    """(item, centroid): unit mean of an item's first vectors."""
    rn = F.row_number().over(Window.partitionBy(item).orderBy(*order))
    head = vectors.withColumn("rn", rn).filter(F.col("rn") <= first)
    each = head.select(item, F.posexplode(doubles(F.col("vector"))).alias("i", "x")).groupBy(item, "i").agg(F.avg("x").alias("x"))
    whole = each.groupBy(item).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda r: r["x"]).alias("c"))
    return whole.select(item, normalised(F.col("c")).alias("centroid"))


def similar_items(vectors: DataFrame, item_key: str, k: int = 5) -> DataFrame:
    """Items nearest to an item: its centroid against all other items' chunks, the best chunk of each counts."""
    own = centroids(vectors.filter(F.col("item_key") == item_key), "item_key", ["page_ord", "window_ord"]).collect()
    others = vectors.filter(F.col("item_key") != item_key)
    if not own or own[0].centroid is None:
        return others.limit(0).withColumn("sim", F.lit(0.0))
    scored = others.withColumn("sim", F.round(cosine(F.col("vector"), F.lit(own[0].centroid)), DIGITS)).filter("sim is not null")
    best = scored.groupBy("item_key").agg(F.max_by(F.struct("title", "creator", "year", "collection", "page", "text", "sim"), F.struct("sim", (-F.col("page_ord")).alias("p"), (-F.col("window_ord")).alias("w"))).alias("b"))
    return best.select("item_key", "b.*").orderBy(F.desc("sim"), "item_key").limit(k)


def search(chunks: DataFrame, embedder: Embedder, text: str, k: int = 8, collection: str | None = None) -> DataFrame:
    """Nearest chunks to a text."""
    query = embedder.embed([text])[0]
    if query is None:
        return chunks.limit(0)
    return top_k(chunks.withColumn("chunk_id", F.concat_ws("/", "item_key", F.lpad(F.col("page_ord").cast("string"), 9, "0"), F.lpad(F.col("window_ord").cast("string"), 9, "0"))), query.tolist(), k, collection)
