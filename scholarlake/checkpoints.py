"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; only a local session without one gets its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="scholarlake-"))
    return sc.getCheckpointDir()


def written(df: DataFrame, codec: str | None = None) -> DataFrame:
    """``df`` written as Parquet (``codec``: None for the session's) and read again, without its lineage; the files go with `removed`, or when the driver's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def removed(*frames: DataFrame | None) -> None:
    """Delete the files of written frames that no plan needs any more."""
    for df in frames:
        if df is not None and hasattr(df, "_written_to"):
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written_to)
            at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
