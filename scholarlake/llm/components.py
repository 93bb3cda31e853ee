"""Connected components by repeated contraction, in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarlake.llm.tools import checkpointed, discard


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links(a, b)``; ``root`` is one node of its component.

    Each round every node hooks onto the neighbour of smallest rank (a hash
    that changes with the round, so that long paths shrink by a constant
    factor), and links between roots are contracted. Lineage is cut each round.
    """
    edges = links.select("a", "b").filter("a != b")
    found, turn = None, 0
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("rank"), F.col(c).alias("node"))  # noqa: B023, E731
        hooked = checkpointed(both.groupBy("a").agg(F.least(F.min(rank("b")), rank("a")).getField("node").alias("to")).select(F.col("a").alias("node"), "to"))
        if found is None:
            found = hooked.withColumnRenamed("to", "root")
            found._stored_at = hooked._stored_at
        else:
            step = hooked.select(F.col("node").alias("root"), "to")
            new = checkpointed(found.join(step, "root", "left").select("node", F.coalesce("to", "root").alias("root")))
            discard(found)
            found = new
        left, right = hooked.select(F.col("node").alias("a"), F.col("to").alias("ra")), hooked.select(F.col("node").alias("b"), F.col("to").alias("rb"))
        rest = checkpointed(edges.join(left, "a").join(right, "b").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).filter("a != b").distinct())
        discard(edges, *([hooked] if turn else []))
        edges = rest
        if edges.isEmpty():
            discard(edges)
            return found
        turn += 1


def merged(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """``roots(node, root)`` after more links: only links between roots are worked on."""
    if roots is None:
        return components(links)
    left, right = roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    between = links.join(left, "a", "left").join(right, "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")).filter("a != b").distinct()
    between = checkpointed(between)
    if between.isEmpty():
        return roots
    step = components(between)
    old = roots.join(step.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    new = step.join(roots.select("node"), "node", "left_anti").select("node", "root")
    out = checkpointed(old.union(new))
    discard(between, step, roots)
    return out
