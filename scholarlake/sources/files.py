"""Files: listing with the scan's rules, keys and fingerprints, and reading bytes of listed paths."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyarrow import fs as pa_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholarlake.schemas import FILES

# Folders and files that a scan skips, extensions that it takes.
SKIPPED_DIRS = frozenset({".git", "__pycache__", ".DS_Store", "node_modules", "_lancedb"})
PACK_FILES = frozenset({"content.md", "meta.json", "_manifest.json"})
EXTENSIONS = frozenset({".pdf", ".html", ".htm", ".xhtml", ".txt", ".md", ".markdown", ".csv", ".docx", ".pptx", ".xlsx", ".epub", ".rtf", ".odt", ".doc"})


def wanted(path: Path) -> bool:
    return not path.name.startswith(".") and path.name not in PACK_FILES and path.suffix.lower() in EXTENSIONS


def scan_files(spark: SparkSession, paths: list[str], recursive: bool = True) -> DataFrame:
    """One row per file by absolute path, sorted by it.

    Folders are walked on the driver, as Spark's own listing leaves out names
    that start with `_`, which a scan takes. A file that is named itself is
    taken whatever its name, by its extension only; `~` is the home folder. A
    missing path is an error.
    """
    found: set[str] = set()
    for top in (Path(p).expanduser() for p in paths):
        if not top.exists():
            raise FileNotFoundError(top)
        if top.is_file():
            found.update([os.path.abspath(top)] if top.suffix.lower() in EXTENSIONS else [])
            continue
        for folder, dirs, names in os.walk(top):
            dirs[:] = sorted(d for d in dirs if d not in SKIPPED_DIRS) if recursive else []
            found.update(os.path.abspath(os.path.join(folder, n)) for n in names if wanted(Path(n)))
    rows = []
    for path in sorted(found):
        stat = os.stat(path)
        rows.append((path, stat.st_size, int(stat.st_mtime), key_of(path), os.path.basename(path), Path(path).suffix.lower()))
    return spark.createDataFrame(rows, FILES)


def stored_files(spark: SparkSession, path: str) -> DataFrame:
    """The same columns for a folder in any store that Spark reads; only names that Spark lists."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "modificationTime", "length")
    name = F.element_at(F.split("path", "/"), -1)
    ext = F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1))
    listed = files.select("path", F.col("length").alias("size"), F.unix_timestamp("modificationTime").alias("mtime"), F.concat(F.lit("adh"), F.substring(F.md5(F.col("path").cast("binary")), 1, 12)).alias("item_key"), name.alias("name"), ext.alias("ext"))
    return listed.filter(F.col("ext").isin(*sorted(EXTENSIONS)) & ~name.startswith(".") & ~name.isin(*sorted(PACK_FILES)))


def key_of(path: str) -> str:
    return "adh" + hashlib.md5(path.encode()).hexdigest()[:12]


def bytes_of(path: str) -> bytes | None:
    """Bytes of a local path, a ``file:`` path, or one in a store that Arrow opens; None if there is no such file, an error if it cannot be read."""
    local = re.sub("^file:/+", "/", path)
    if "://" not in local:
        return Path(local).read_bytes() if os.path.isfile(local) else None
    fs, at = pa_fs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", local))
    if fs.get_file_info(at).type != pa_fs.FileType.File:
        return None
    with fs.open_input_stream(at) as stream:
        return stream.read()


def with_content(files: DataFrame) -> DataFrame:
    """``files`` and their bytes, read by the tasks by the path that a listing gave; null where a file is gone."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["content"] = [None if p is None else bytes_of(p) for p in batch["path"]]
            yield batch

    return files.mapInPandas(read, f"{', '.join(f'{n} {t}' for n, t in files.dtypes)}, content binary")


def fingerprints(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, mtime, size): null for what is not a file."""
    rows = [(p, int(os.stat(p).st_mtime), os.stat(p).st_size) if os.path.isfile(p) else (p, None, None) for p in paths]
    return spark.createDataFrame(rows, "path string, mtime bigint, size bigint")


def browse(path: str) -> dict[str, list[str]]:
    """One level of a folder: visible folders and files, sorted."""
    entries = [e for e in os.scandir(path) if not e.name.startswith(".")]
    return {"dirs": sorted(e.name for e in entries if e.is_dir()), "files": sorted(e.name for e in entries if e.is_file())}
