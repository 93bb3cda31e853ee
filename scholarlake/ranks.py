"""Places of rows in a total order, without a single task that sees them all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarlake.checkpoints import written

#: Bits of Spark's increasing ids below the partition's.
LOCAL_BITS = 33


def ranked(df: DataFrame, *order) -> tuple[DataFrame, int, DataFrame]:
    """(``df`` with ``rank`` from 0 by ``order``, its number of rows, the written table behind it).

    Rows are dealt by range and sorted; a row's place is its place in its
    partition and the rows of the partitions before, one number a partition.
    """
    stored = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("rank", F.monotonically_increasing_id()))
    part = F.shiftright("rank", LOCAL_BITS)
    starts, n = [], 0
    for p, size in sorted(stored.groupBy(part.alias("p")).count().collect()):
        starts.append((p, n))
        n += size
    if not starts:
        return stored, 0, stored
    before = df.sparkSession.createDataFrame(starts, "p long, before long")  # a row a partition
    local = F.col("rank").bitwiseAND(F.lit((1 << LOCAL_BITS) - 1))
    out = stored.join(F.broadcast(before), part == before.p).withColumn("rank", local + F.col("before")).drop("p", "before")
    return out, n, stored
