"""Repositories packed as ZIP archives, one row per member.

An archive that can't be opened is one row with an ``error``; a member that
can't be read, damaged or encrypted, is a row of its own and loses no other.
"""

from __future__ import annotations

import io
import posixpath
import zipfile
import zlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusaudit.functions import paths
from corpusaudit.sources.storage import open_fs
from corpusaudit.sources.tree import BATCH_BYTES, BATCH_ROWS

_MEMBERS = "archive string, member string, file_path string, size_bytes bigint, error string"
_CONTENTS = _MEMBERS + ", content binary"


def _member_path(name: str) -> tuple[str | None, str | None]:
    """Clean relative path of a member, or the reason to reject it."""
    if name.startswith("/") or ".." in name.split("/"):
        return None, "unsafe member path"
    return posixpath.normpath(name), None


def _members(archive: zipfile.ZipFile) -> Iterator[tuple[str, str | None, int, str | None]]:
    for info in archive.infolist():
        if not info.is_dir():
            file_path, error = _member_path(info.filename)
            yield info.filename, file_path, info.file_size, error


#: What opening an archive or reading a member may raise. ValueError: too short to seek in; RuntimeError: encrypted.
_BAD = (zipfile.BadZipFile, OSError, EOFError, ValueError, RuntimeError, NotImplementedError, zlib.error)


def _content(archive: zipfile.ZipFile, member: str) -> tuple[bytes | None, str | None]:
    try:
        return archive.read(member), None
    except _BAD as problem:
        return None, f"unreadable member: {problem}"


def _list(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Members of each archive; reads only the directory at the archive's end."""
    columns = [part.split()[0] for part in _MEMBERS.split(", ")]
    rows: list[tuple] = []
    for batch in batches:
        for path in batch["archive"]:
            try:
                fs, bare = open_fs(path)
                with fs.open_input_file(bare) as handle, zipfile.ZipFile(handle) as archive:
                    for item in _members(archive):
                        rows.append((path, *item))
                        if len(rows) >= BATCH_ROWS:
                            yield pd.DataFrame(rows, columns=columns)
                            rows = []
            except _BAD as problem:
                rows.append((path, None, None, None, f"not a valid archive: {problem}"))
    if rows:
        yield pd.DataFrame(rows, columns=columns)


def _read(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [part.split()[0] for part in _CONTENTS.split(", ")]
    rows: list[tuple] = []
    held = 0
    for batch in batches:
        for path, group in batch.groupby("archive", sort=False):
            good = group["error"].isna()
            for row in group[~good].itertuples(index=False, name=None):
                rows.append((*row, None))
            wanted = list(group[good].itertuples(index=False, name=None))
            try:
                if not wanted:
                    continue
                fs, bare = open_fs(path)
                with fs.open_input_file(bare) as handle, zipfile.ZipFile(handle) as archive:
                    while wanted:
                        name, member, file_path, size, _ = wanted[0]
                        data, error = _content(archive, member)
                        rows.append((name, member, file_path, size, error, data))
                        del wanted[0]
                        held += len(data or b"")
                        if held >= BATCH_BYTES:
                            yield pd.DataFrame(rows, columns=columns)
                            rows, held = [], 0
            except _BAD as problem:  # the archive as a whole
                rows += [(*row[:4], f"unreadable archive: {problem}", None) for row in wanted]
    if rows:
        yield pd.DataFrame(rows, columns=columns)


def read_zip_repos(archives: DataFrame, partitions: int | None = None) -> DataFrame:
    """Members of archives given by path (column ``archive``), with their bytes.

    Members are listed first and then spread by name, so one large archive is
    read by many tasks, each seeking to its own members.
    """
    width = partitions or archives.sparkSession.sparkContext.defaultParallelism
    listed = archives.select("archive").repartition(width, "archive").mapInPandas(_list, _MEMBERS)
    read = listed.repartition(width, "archive", "member").mapInPandas(_read, _CONTENTS)
    return _with_repo(read)


def _expand(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [part.split()[0] for part in _CONTENTS.split(", ")]
    rows: list[tuple] = []
    held = 0
    for batch in batches:
        for path, content in zip(batch["archive"], batch["content"]):
            try:
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for member, file_path, size, error in _members(archive):
                        data = None
                        if error is None:
                            data, error = _content(archive, member)
                        rows.append((path, member, file_path, size, error, data))
                        held += len(data or b"")
                        if held >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                            yield pd.DataFrame(rows, columns=columns)
                            rows, held = [], 0
            except _BAD as problem:
                rows.append((path, None, None, None, f"not a valid archive: {problem}", None))
    if rows:
        yield pd.DataFrame(rows, columns=columns)


def expand_archives(archives: DataFrame) -> DataFrame:
    """The same for archives already held as bytes (columns archive, content)."""
    return _with_repo(archives.select("archive", "content").mapInPandas(_expand, _CONTENTS))


def _with_repo(members: DataFrame) -> DataFrame:
    return members.withColumn("repo", paths.stem(F.col("archive")))
