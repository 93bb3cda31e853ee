"""Trees as intervals: an Euler tour, ranked in parallel, numbers every node and all below it.

Going down into a node and up out of it are two arcs of one tour of the
forest. What follows an arc is known from first children, next siblings and
parents; how many arcs follow to the tour's end is found by following blocks of
arcs within a task, then by doubling over the arcs at which blocks are entered.
Whatever has a row a node is joined by merging, never broadcast through the driver.
A node's descendants are then the nodes whose numbers lie in its interval.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarlake.checkpoints import removed, written
from scholarlake.ranks import ranked

#: Arcs that one task follows.
BLOCK = 1 << 16
#: What follows the last arc, and what follows an arc of a circle.
END, CIRCLE = -1, -2
ARCS = "arc long, next long, downs long, level long"


def one_a_key(nodes: DataFrame) -> DataFrame:
    """One row a key, that of the smallest api_ord (ties: by the other columns); null keys are no nodes."""
    rest = [c for c in nodes.columns if c not in ("key", "api_ord")]
    first = F.min_by(F.struct(*nodes.columns), F.struct("api_ord", *rest)).alias("row")
    return nodes.filter("key IS NOT NULL").groupBy("key").agg(first).select("row.*")


def followed(table: pa.Table) -> pa.Table:
    """Arcs of one block as jumps out of it, with the sums on the way."""
    table = table.sort_by("arc")
    arc, after, downs, level = (table.column(c).to_numpy().copy() for c in ("arc", "next", "downs", "level"))
    at = np.searchsorted(arc, after)
    at[at == len(arc)] = 0
    inside = arc[at] == after
    for _ in range(len(arc).bit_length() + 1):
        rows = np.flatnonzero(inside)
        if not len(rows):
            break
        to = at[rows]
        more = downs[to], level[to], after[to], at[to], inside[to]
        downs[rows] += more[0]
        level[rows] += more[1]
        after[rows], at[rows], inside[rows] = more[2:]
    after[inside] = CIRCLE
    return pa.table([arc, after, downs, level], names=["arc", "next", "downs", "level"])


def tour(arcs: DataFrame) -> DataFrame:
    """``arcs(arc, next, downs, level)`` with the sums from each arc to the end; next is END, or CIRCLE where there is none."""
    jumps = written(arcs.groupBy(F.floor(F.col("arc") / BLOCK)).applyInArrow(followed, ARCS))
    exits = jumps.filter("next >= 0").select(F.col("next").alias("target")).distinct()
    at = written(jumps.join(exits.hint("merge"), jumps.arc == exits.target, "left_semi"))
    left = at.filter("next >= 0").count()
    while left:
        ahead = at.select(F.col("arc").alias("target"), F.col("next").alias("next_2"), F.col("downs").alias("downs_2"), F.col("level").alias("level_2"))
        add = lambda c: (F.col(c) + F.coalesce(f"{c}_2", F.lit(0))).alias(c)
        going = at.filter("next >= 0").join(ahead.hint("merge"), F.col("next") == F.col("target"), "left").select("arc", F.coalesce("next_2", "next").alias("next"), add("downs"), add("level"))
        new = written(at.filter("next < 0").select(going.columns).union(going))
        removed(at)
        at, before, left = new, left, new.filter("next >= 0").count()
        if left == before:  # a chain of any length has shorter ones in it, so none of these ends
            break
    rest = at.select(F.col("arc").alias("target"), F.when(F.col("next") == END, END).otherwise(CIRCLE).alias("next_2"), F.col("downs").alias("downs_2"), F.col("level").alias("level_2"))
    both = jumps.join(rest.hint("merge"), jumps.next == rest.target, "left")
    return both.select("arc", F.coalesce("next_2", "next").alias("next"), (F.col("downs") + F.coalesce("downs_2", F.lit(0))).alias("downs"), (F.col("level") + F.coalesce("level_2", F.lit(0))).alias("level"))


def numbered(nodes: DataFrame) -> DataFrame:
    """``nodes(key, parent, api_ord, ...)`` with depth, ``pre`` (their place depth-first, from 0) and ``size`` (of their subtree, themselves included).

    A node whose parent is not there is a root. Siblings go by api_ord, then
    key. Of rows that repeat a key the first counts; nodes of a circle, or
    below one, have no row. Rows stay linear in the nodes at any depth.
    """
    one = written(one_a_key(nodes))
    there = one.select(F.col("key").alias("up")).distinct()
    placed, _, stored = ranked(one.join(there.hint("merge"), one.parent == there.up, "left"), F.col("up").asc_nulls_first(), F.col("api_ord"), F.col("key"))
    after = placed.select((F.col("rank") - 1).alias("rank"), F.col("up").alias("up_after"), F.lit(True).alias("some"))
    child = placed.filter("up IS NOT NULL").groupBy(F.col("up").alias("key")).agg(F.min("rank").alias("child"))
    parents = placed.select(F.col("key").alias("up"), F.col("rank").alias("above"))
    known = placed.select("key", "up", "rank").join(after.hint("merge"), "rank", "left").join(child.hint("merge"), "key", "left").join(parents.hint("merge"), "up", "left")
    down, up = 2 * F.col("rank"), 2 * F.col("rank") + 1
    beside = F.when(F.col("some") & F.col("up").eqNullSafe(F.col("up_after")), down + 2).otherwise(F.coalesce(2 * F.col("above") + 1, F.lit(END)))
    arc = lambda at, to, n, step: F.struct(at.alias("arc"), to.cast("long").alias("next"), F.lit(n).cast("long").alias("downs"), F.lit(step).cast("long").alias("level"))
    arcs = known.select(F.explode(F.array(arc(down, F.coalesce(2 * F.col("child"), up), 1, 1), arc(up, beside, 0, -1))).alias("x")).select("x.*")
    ends = written(tour(arcs).filter(F.col("next") == END))
    is_down = F.col("arc") % 2 == 0
    spans = ends.groupBy(F.floor(F.col("arc") / 2).cast("long").alias("rank")).agg(F.max(F.when(is_down, F.col("downs"))).alias("from"), F.max(F.when(~is_down, F.col("downs"))).alias("to"), F.max(F.when(is_down, -F.col("level"))).alias("depth"))
    n = ends.agg(F.max("downs")).first()[0] or 0
    return placed.join(spans.hint("merge"), "rank").select(*[c for c in nodes.columns], "depth", (F.lit(n) - F.col("from")).alias("pre"), (F.col("from") - F.col("to")).alias("size"))
