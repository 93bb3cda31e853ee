"""The trie of conversation prefixes as a Cartesian tree over sorted conversations.

Conversations are sorted by their turns; neighbours share a prefix of so many
turns (their LCP). Every node of the trie is an interval of that order: the
nearest smaller LCP to the left and right of a place bound the interval of the
turns shared there. They are found in parallel: within blocks by a stack, and
across blocks by the blocks' minima and their running minima. Places with one
interval merge to a node, depths that no LCP names are filled in, and whatever
a node needs to know of its subtree is a difference of running sums, or a
minimum over its interval.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from scholarlake.llm.tools import checkpointed, crc_mod, discard
from scholarlake.ranks import ranked

#: Conversations of a block at least, and blocks at most: what the driver holds is a few numbers a block.
BLOCK_ROWS = 64
MAX_BLOCKS = 1 << 17
WORD = "[^\\x20\\x09-\\x0D]+"
EMPTY = hashlib.sha256(b"").hexdigest()
PLACES = (
    "rank long, block long, conv_id long, length int, lcp int, after int, leaf int, total long, fresh long, words array<long>, least_before long, least_behind long, "
    "total_to long, fresh_to long, leaves_to long, left long, right long, left_block long, right_block long, least long, low_left boolean, low_right boolean"
)


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, name, words): turns by number, null first, with a digest of role and text and the words of the text.

    Null role or text counts as empty; rows without conv_id belong to none; turns of one number come in a fixed order of their digests.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    name = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    turns = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), name.alias("name"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    placed, _, _ = ranked(turns, F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("name"))
    firsts = placed.groupBy(F.col("conv_id").alias("of")).agg(F.min("rank").alias("first"))
    return placed.join(firsts, placed.conv_id == firsts.of).select("conv_id", (F.col("rank") - F.col("first")).alias("pos"), "name", "words")


def rebuilt(turns: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """Conversation c anew: the first h turns of c - c % every, then its own turns after its first h, h = crc32(c) % most.

    Remainders take the sign of c. Conversations that end up without turns
    keep one row, with null pos.
    """
    turns = checkpointed(turns)
    convs = turns.select("conv_id").distinct().withColumn("head", crc_mod("conv_id", most)).withColumn("base", F.expr(f"conv_id - conv_id % {every}"))
    starts = turns.filter(F.col("pos") < most - 1).select(F.col("conv_id").alias("base"), "pos", "name", "words")
    heads = convs.join(starts, "base").filter(F.col("pos") < F.col("head")).select("conv_id", "pos", "name", "words")
    own = turns.filter(F.col("pos") >= crc_mod("conv_id", most)).select("conv_id", "pos", "name", "words")
    nothing = convs.select("conv_id", F.lit(None).cast("long").alias("pos"), F.lit(None).cast("binary").alias("name"), F.lit(None).cast("long").alias("words"))
    return heads.union(own).union(nothing)


def shared(a: Column, b: Column) -> Column:
    """How many leading elements two arrays share."""
    differ = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), F.lit(False))
    return F.when(differ == 0, F.size(a)).otherwise(differ - 1).cast("int")


def summed(words: Column) -> Column:
    return F.aggregate(words, F.lit(0).cast("long"), lambda x, y: x + y)


def sparse(values: np.ndarray) -> list[np.ndarray]:
    """Minima of all runs whose length is a power of two."""
    levels, width = [values], 1
    while 2 * width <= len(values):
        levels.append(np.minimum(levels[-1][:-width], levels[-1][width:]))
        width *= 2
    return levels


def least_of(levels: list[np.ndarray], low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Minimum of ``low <= i < high`` for each pair; none may be empty."""
    level = np.log2(np.maximum(high - low, 1)).astype(np.int64)
    out = np.empty(len(low), levels[0].dtype)
    for k in np.unique(level):
        own = level == k
        out[own] = np.minimum(levels[k][low[own]], levels[k][high[own] - (1 << int(k))])
    return out


def nearest_smaller(values: list[int]) -> tuple[list[int], list[int]]:
    """For each place the nearest strictly smaller one on its left (-1) and right (the length)."""
    left, right, stack = [-1] * len(values), [len(values)] * len(values), []
    for i, v in enumerate(values):
        while stack and values[stack[-1]] > v:
            right[stack.pop()] = i
        left[i] = stack[-1] if stack and values[stack[-1]] < v else left[stack[-1]] if stack else -1
        stack.append(i)
    return left, right


class Blocks:
    """What the driver knows of all blocks: the least LCP and id of each, and sums before it."""

    def __init__(self, rows: list, n: int):
        rows = sorted(rows)
        self.n = n
        self.lcp, self.least = np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64)
        self.before = np.array([np.append(0, np.cumsum([r[k] for r in rows])[:-1]) for k in (3, 4, 5)], np.int64)

    def towards(self, block: int, values: np.ndarray, step: int) -> np.ndarray:
        """The nearest block on one side whose least LCP is below each of the (distinct, falling) values, or -1."""
        out, at = np.full(len(values), -1, np.int64), block + step
        for k, v in enumerate(values):
            while 0 <= at < len(self.lcp) and self.lcp[at] >= v:
                at += step
            if not 0 <= at < len(self.lcp):
                break
            out[k] = at
        return out

    def places(self, table: pa.Table) -> pa.Table:
        """The rows of one block with all that it can tell of them."""
        table = table.sort_by("rank")
        col = lambda c: table.column(c).to_numpy()
        block, start, conv, lcp = int(table.column("block")[0].as_py()), int(table.column("rank")[0].as_py()), col("conv_id"), col("lcp").astype(np.int64)
        left, right = (np.array(x, np.int64) for x in nearest_smaller(lcp.tolist()))
        size = len(lcp)
        no_left, no_right = left < 0, right == size
        least = np.zeros(size, np.int64)
        inside = ~no_left & ~no_right
        least[inside] = least_of(sparse(conv), left[inside], right[inside])

        def outside(open_: np.ndarray, step: int) -> np.ndarray:
            out = np.full(size, -1, np.int64)
            values = np.unique(lcp[open_ & (lcp >= 0)])[::-1]
            found = self.towards(block, values, step)
            for v, at in zip(values, found):
                out[open_ & (lcp == v)] = at
            return out

        to_left, to_right = outside(no_left, -1), outside(no_right, 1)
        low = lambda x: np.append(True, x[1:] < np.minimum.accumulate(x)[:-1])
        words = table.column("words").combine_chunks()
        values, sizes = words.flatten().to_numpy(zero_copy_only=False).astype(np.int64), pa.compute.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        running = np.append(0, np.cumsum(values))
        padded = np.insert(running[1:] - np.repeat(running[ends - sizes], sizes), ends - sizes, 0)
        sums = [np.cumsum(col(c)) + self.before[k][block] for k, c in enumerate(("total", "fresh", "leaf"))]
        integer = lambda x, known=None: pa.array(x, pa.int64(), mask=None if known is None else ~known)
        more = [
            pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes + 1)), pa.int32()), pa.array(padded, pa.int64())),
            *[integer(x) for x in (np.minimum.accumulate(conv), np.minimum.accumulate(conv[::-1])[::-1], *sums)],
            integer(left + start, ~no_left),
            integer(np.where(no_right, self.n, right + start), ~no_right | (to_right < 0)),
            integer(to_left, to_left >= 0),
            integer(to_right, to_right >= 0),
            integer(least, inside),
            pa.array(low(lcp[::-1])[::-1]),
            pa.array(low(lcp)),
        ]
        kept = ["rank", "block", "conv_id", "length", "lcp", "after", "leaf", "total", "fresh"]
        return pa.table([*[table.column(c) for c in kept], *more], names=[c.split()[0] for c in PLACES.split(", ")])


def neighbours(convs: DataFrame) -> tuple[DataFrame, int]:
    """Sorted conversations with the turns that each shares with the one before (-1: none is) and after it, and their number."""
    placed, n, _ = ranked(convs, "names", "conv_id")
    before = placed.select((F.col("rank") + 1).alias("rank"), F.col("names").alias("names_before"))
    lcp = placed.join(before, "rank", "left").select("rank", "conv_id", "words", F.size("names").alias("length"), F.when(F.col("names_before").isNull(), -1).otherwise(shared(F.col("names"), F.col("names_before"))).alias("lcp"))
    lcp = checkpointed(lcp)
    after = lcp.select((F.col("rank") - 1).alias("rank"), F.col("lcp").alias("after"))
    total, known = summed(F.col("words")), summed(F.slice("words", F.lit(1), F.greatest("lcp", F.lit(0))))
    rows = lcp.join(after, "rank", "left").withColumn("after", F.coalesce("after", F.lit(-1)))
    size = max(BLOCK_ROWS, -(-n // MAX_BLOCKS))
    rows = rows.select("*", F.floor(F.col("rank") / size).cast("long").alias("block"), total.alias("total"), (total - known).alias("fresh"), (F.col("after") < F.col("length")).cast("int").alias("leaf"))
    return checkpointed(rows), n


def resolved(places: DataFrame) -> DataFrame:
    """``places`` with the bounds that lie in other blocks, from those blocks' running minima."""
    for side, low, pick in (("left", "low_left", F.max), ("right", "low_right", F.min)):
        asked = places.filter(F.col(f"{side}_block").isNotNull()).select(F.col("block").alias("of"), F.col(f"{side}_block").alias("at"), F.col("lcp").alias("below")).distinct()
        lows = places.filter(low).select(F.col("block").alias("at"), "rank", F.col("lcp").alias("low"))
        found = asked.select("at", "below").distinct().join(lows, "at").filter("low < below").groupBy("at", "below").agg(pick("rank").alias("found"))
        answers = asked.join(found, ["at", "below"]).select("of", "below", "found")
        joined = places.join(answers, (places.block == answers.of) & (places.lcp == answers.below) & places[f"{side}_block"].isNotNull(), "left")
        places = joined.withColumn(side, F.coalesce(side, "found")).drop("of", "below", "found")
    return places


def digests(fragments: DataFrame) -> DataFrame:
    """(first, ends_sha256) of the comma-joined ``ids`` of each ``first``, in order of ``at``; one fragment in memory at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for batch in batches:
            firsts, made = [], []
            for first, ids in zip(batch.column(0).to_pylist(), batch.column(1)):
                if first != now:
                    if digest is not None:
                        firsts.append(now)
                        made.append(digest.hexdigest())
                    now, digest = first, hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(ids.as_py().encode())
            yield pa.RecordBatch.from_arrays([pa.array(firsts, pa.int64()), pa.array(made, pa.string())], ["first", "ends_sha256"])
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([digest.hexdigest()])], ["first", "ends_sha256"])

    return fragments.repartition("first").sortWithinPartitions("first", "at").select("first", "ids").mapInArrow(run, "first long, ends_sha256 string")


def prefix_trie(turns: DataFrame) -> DataFrame:
    """One row per distinct prefix of the conversations ``turns(conv_id, pos, name, words)``: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``name`` tells turns apart and pos orders them; rows of null pos are no
    turns, but make their conversation known. No conversations give no rows;
    any other table has a root. Equal conversations meet in one node. The
    names of one conversation's turns, 24 bytes each, are one row.
    """
    packed = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "name", "words")))).alias("own"))
    convs = packed.select("conv_id", F.transform("own", lambda x: x["name"]).alias("names"), F.transform("own", lambda x: x["words"]).alias("words"))
    rows, n = neighbours(convs)
    blocks = Blocks(rows.groupBy("block").agg(F.min("lcp"), F.min("conv_id"), F.sum("total"), F.sum("fresh"), F.sum("leaf")).collect(), n)  # a row a block
    places = checkpointed(rows.groupBy("block").applyInArrow(lambda table: blocks.places(table), PLACES))
    places = checkpointed(resolved(places))
    discard(rows)

    inner = places.filter("lcp >= 0").groupBy(F.col("left").alias("l"), F.col("right").alias("r")).agg(F.max("lcp").alias("depth"), F.count("*").alias("borders"), F.sum((F.col("length") == F.col("lcp")).cast("long")).alias("ended"), F.min("least").alias("least"))
    alone = places.filter("length > greatest(lcp, after)").select(F.col("rank").alias("l"), (F.col("rank") + 1).alias("r"), F.col("length").alias("depth"), F.lit(0).cast("long"), F.lit(0).cast("long"), F.col("conv_id").alias("least"))
    last = places.select((F.col("rank") + 1).alias("r"), F.col("block").alias("last_block"), F.col("after").alias("r_lcp"), F.col("least_before").alias("last_least"), F.col("total_to").alias("r_total"), F.col("fresh_to").alias("r_fresh"), F.col("leaves_to").alias("r_leaves"))
    first = places.select(F.col("rank").alias("l"), F.col("block").alias("first_block"), F.col("lcp").alias("l_lcp"), F.col("length").alias("l_length"), F.col("least_behind").alias("first_least"), F.col("words").alias("l_words"), F.col("total"), (F.col("total_to") - F.col("total")).alias("l_total"), F.col("fresh_to").alias("l_fresh"), (F.col("leaves_to") - F.col("leaf")).alias("l_leaves"))
    between = least_between(blocks.least)
    least = F.coalesce("least", F.when(F.col("first_block") == F.col("last_block"), F.col("first_least")).otherwise(F.least("first_least", "last_least", between("first_block", "last_block"))))
    nodes = inner.union(alone).join(last, "r").join(first, "l").withColumn("above", F.greatest("l_lcp", "r_lcp"))
    nodes = nodes.select(
        "l", "r", "depth", "above", least.alias("least"), (F.col("borders") + 1 - F.col("ended") - (F.col("l_length") == F.col("depth")).cast("long")).alias("children"),
        (F.col("r_leaves") - F.col("l_leaves")).alias("leaves"), F.slice("l_words", F.greatest("above", F.lit(0)) + 1, F.greatest("depth", F.lit(1)) - F.greatest("above", F.lit(0))).alias("words"),
        (F.col("r_total") - F.col("l_total") - F.col("total") - F.col("r_fresh") + F.col("l_fresh")).alias("spare"), F.when(F.col("above") >= 0, F.when(F.col("l_lcp") >= F.col("r_lcp"), F.col("l")).otherwise(F.col("r"))).alias("border"),
    )
    nodes = checkpointed(nodes)
    spans = places.select(F.col("rank").alias("border"), F.col("left").alias("up_l"), F.col("right").alias("up_r"))
    ups = nodes.select(F.col("l").alias("up_l"), F.col("r").alias("up_r"), F.col("least").alias("up"))
    start = F.when(F.col("lcp") < F.col("length"), F.col("rank")).otherwise(F.col("left"))
    runs = places.select("block", start.alias("first"), "rank", "conv_id", "length").groupBy("block", "first").agg(F.min("rank").alias("at"), F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    ends = digests(runs).select(F.col("first").alias("l"), "ends_sha256").join(places.select(F.col("rank").alias("l"), F.col("length").alias("depth")), "l")
    known = nodes.join(spans, "border", "left").join(ups, ["up_l", "up_r"], "left").join(ends, ["l", "depth"], "left")
    low = F.greatest(F.col("above"), F.lit(0))
    told = known.withColumn("at", F.explode(F.sequence(F.col("above") + 1, F.col("depth")))).withColumn("before", F.element_at("words", F.greatest(F.col("at") - 1, F.lit(0)) - low + 1))
    bottom = F.col("at") == F.col("depth")
    return told.select(
        F.col("least").alias("conv_id"),
        F.col("at").cast("long").alias("depth"),
        F.when(F.col("at") > F.col("above") + 1, F.col("least")).otherwise(F.col("up")).alias("parent_conv_id"),
        (F.col("r") - F.col("l")).alias("n_convs"),
        F.when(bottom, F.col("children")).otherwise(1).cast("long").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        (F.col("spare") - (F.col("r") - F.col("l") - 1) * F.col("before")).alias("saved_tokens"),
        F.when(bottom, F.coalesce("ends_sha256", F.lit(EMPTY))).otherwise(EMPTY).alias("ends_sha256"),
    )


def least_between(least: np.ndarray):
    """Column function: the least id of the blocks strictly between two, null if there is none; ``least`` has at most MAX_BLOCKS numbers."""

    @pandas_udf("long")
    def between(first: pd.Series, last: pd.Series) -> pd.Series:
        low, high = first.to_numpy() + 1, last.to_numpy()
        some = low < high
        out = pd.Series([None] * len(first), dtype="Int64")
        if some.any():
            out[some] = least_of(sparse(least), low[some], high[some])
        return out

    return between
