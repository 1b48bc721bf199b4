"""Code trees as DataFrames.

Spark's file sources hide names that begin with ``_`` or ``.``, which would
lose every ``__init__.py``. The walk is therefore done by tasks: one job per
folder level lists the folders of that level in parallel, each folder by one
task, and the files found are spread evenly before anything is read, so that
neither a large repository nor a large folder is read by one task. A root or
folder that can't be listed, and a file that can't be read, is a row with an
``error`` and stops nothing else.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusaudit import dims
from corpusaudit.functions import paths
from corpusaudit.session import shared_folder
from corpusaudit.sources.storage import is_link, open_fs

BATCH_ROWS = 5_000
BATCH_BYTES = 32 * 1024 * 1024
_LISTED = "repo string, root string, rel_path string, is_dir boolean, size_bytes bigint, error string"


# -- rules of the two profiles ---------------------------------------------
def selected(file_path: Column, profile: str = "discovery", suffixes: list[str] | None = None) -> Column:
    """Whether a scan profile keeps a relative path."""
    above = paths.folders(file_path)
    if profile == "discovery":
        wanted = paths.suffix(file_path).isin(*(suffixes or dims.DISCOVERY_SUFFIXES))
        return wanted & ~F.exists(above, lambda d: d.isin(*dims.DISCOVERY_EXCLUDED))
    if profile == "index":
        wanted = paths.suffix(file_path).isin(*(suffixes or dims.INDEX_SUFFIXES))
        parts = F.split(file_path, "/")
        return wanted & ~F.exists(parts, lambda d: d.startswith(".") | d.isin(*dims.INDEX_EXCLUDED))
    raise ValueError(f"unknown profile {profile!r}")


def select_code_files(files: DataFrame, profile: str = "discovery", suffixes: list[str] | None = None) -> DataFrame:
    """Files of a table that the profile keeps."""
    return files.filter(selected(F.col("file_path"), profile, suffixes))


_DISCOVERY_EXCLUDED = frozenset(dims.DISCOVERY_EXCLUDED)
_INDEX_EXCLUDED = frozenset(dims.INDEX_EXCLUDED)


def _enters(folder: str, profile: str) -> bool:
    if profile == "discovery":
        return folder not in _DISCOVERY_EXCLUDED
    return not folder.startswith(".") and folder not in _INDEX_EXCLUDED


# -- walk ------------------------------------------------------------------
def _lister(profile: str):
    def list_folders(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        for batch in batches:
            for repo, root, rel in zip(batch["repo"], batch["root"], batch["rel_path"]):
                try:
                    fs, base = open_fs(root)
                    found = fs.get_file_info(pafs.FileSelector(f"{base}/{rel}" if rel else base))
                except (OSError, ValueError) as problem:  # ValueError: not a file system that can be opened
                    rows.append((repo, root, rel, False, None, f"unreadable: {problem}"))
                    continue
                for info in found:
                    is_dir = info.type == pafs.FileType.Directory
                    if is_dir and (not _enters(info.base_name, profile) or is_link(fs, info.path)):
                        continue
                    if not is_dir and info.type != pafs.FileType.File:
                        continue
                    name = f"{rel}/{info.base_name}" if rel else info.base_name
                    rows.append((repo, root, name, is_dir, None if is_dir else info.size, None))
                    if len(rows) >= BATCH_ROWS:
                        yield _frame(rows, _LISTED)
                        rows = []
        if rows:
            yield _frame(rows, _LISTED)

    return list_folders


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[part.split()[0] for part in schema.split(", ")])


def list_tree(roots: DataFrame, profile: str = "discovery") -> DataFrame:
    """Listing of all code files below ``roots`` (columns repo, root), and of the folders that can't be listed."""
    spark = roots.sparkSession
    shared_folder(spark)
    width = max(spark.sparkContext.defaultParallelism, 1)
    frontier = roots.select("repo", "root", F.lit("").alias("rel_path"))
    levels: list[DataFrame] = []
    while True:
        listed = (
            frontier.repartition(width, "repo", "rel_path").mapInPandas(_lister(profile), _LISTED).checkpoint()
        )
        levels.append(listed.filter(~F.col("is_dir")))
        frontier = listed.filter("is_dir").select("repo", "root", "rel_path")
        if frontier.isEmpty():
            break
    files = reduce(DataFrame.unionByName, levels).drop("is_dir").withColumnRenamed("rel_path", "file_path")
    return files.filter(F.col("error").isNotNull() | selected(F.col("file_path"), profile))


def _read(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows: list[tuple] = []
    held = 0
    for batch in batches:
        for repo, root, file_path, size, error, limit in batch.itertuples(index=False, name=None):
            size = None if pd.isna(size) else int(size)
            data, error = None, error or None
            if error is None and not pd.isna(limit) and size is not None and size > limit:
                error = f"too large: {size} bytes"
            elif error is None:
                try:
                    fs, base = open_fs(root)
                    with fs.open_input_stream(f"{base}/{file_path}", compression=None) as stream:
                        data = stream.read()
                except OSError as problem:
                    error = f"unreadable: {problem}"
            rows.append((repo, root, file_path, size, data, error))
            held += len(data or b"")
            if held >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                yield _frame(rows, _READ)
                rows, held = [], 0
    if rows:
        yield _frame(rows, _READ)


_READ = "repo string, root string, file_path string, size_bytes bigint, content binary, error string"


def scan_code_files(
    spark: SparkSession,
    roots: dict[str, str] | DataFrame,
    profile: str = "discovery",
    max_size: int | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Files below the roots with their bytes; unread files and folders carry an ``error``.

    Files of any size are read unless ``max_size`` sets a limit in bytes.
    """
    if isinstance(roots, dict):
        roots = spark.createDataFrame(list(roots.items()), "repo string, root string")
    listed = list_tree(roots, profile)
    width = partitions or spark.sparkContext.defaultParallelism
    spread = listed.repartition(width, "repo", "file_path").withColumn("limit", F.lit(max_size).cast("bigint"))
    return spread.mapInPandas(_read, _READ)


# -- decoding --------------------------------------------------------------
def _text_mode(c: Column) -> Column:
    """Line ends as Python's text mode gives them."""
    return F.regexp_replace(c, "\r\n?", "\n")


def read_text(files: DataFrame, max_size: int | None = None, profile: str = "discovery") -> DataFrame:
    """Decode ``content`` bytes of any size, or of up to ``max_size``; add ``encoding`` and ``error``.

    Discovery takes UTF-8, else Latin-1. The index profile drops bytes that are
    not UTF-8; in a file that needs this, replacement characters already in the
    text are dropped too.
    """
    raw = F.col("content")
    as_text = raw.cast("string")
    valid = F.is_valid_utf8(as_text)
    known = F.col("error") if "error" in files.columns else F.lit(None).cast("string")
    size = F.octet_length(raw).cast("bigint")
    if max_size is not None:
        too_large = F.when(size > max_size, F.concat(F.lit("too large: "), size.cast("string"), F.lit(" bytes")))
        known = F.coalesce(known, too_large)
    if profile == "index":
        other = F.replace(F.make_valid_utf8(as_text), F.lit("�"), F.lit(""))
        encoding = F.when(~valid, "utf-8 (dropped bytes)")
    else:
        other = F.decode(raw, "ISO-8859-1")
        encoding = F.when(~valid, "latin-1")
    return (
        files.withColumn("error", known)
        .withColumn("encoding", F.when(F.col("error").isNull(), F.when(valid, "utf-8").otherwise(encoding)))
        .withColumn("content", F.when(F.col("error").isNull(), _text_mode(F.when(valid, as_text).otherwise(other))))
    )


def readable(decoded: DataFrame) -> DataFrame:
    """Files with text; empty ones are dropped."""
    return decoded.filter(F.col("error").isNull() & (F.col("content") != "")).drop("error")


def unreadable(decoded: DataFrame) -> DataFrame:
    """The error table of a read."""
    return decoded.filter(F.col("error").isNotNull()).drop("content")
