"""Path expressions with the rules of Python's ``PurePosixPath``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusaudit.functions.text import strip


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def suffix(path: Column) -> Column:
    """``.gitignore`` has none, ``a.tar.gz`` has ``.gz``, ``a.`` has none."""
    return F.regexp_extract(basename(path), r"^[\s\S]+(\.[^.]+)$", 1)


def stem(path: Column) -> Column:
    name = basename(path)
    return F.left(name, F.length(name) - F.length(suffix(path)))


def folders(path: Column) -> Column:
    """The folder names above the file."""
    parts = F.split(path, "/")
    return F.slice(parts, 1, F.size(parts) - 1)


def clean_repo_url(url: Column) -> Column:
    """Trim, drop trailing slashes and one ``.git``."""
    bare = F.rtrim(strip(url), F.lit("/"))
    return F.when(bare.endswith(".git"), F.left(bare, F.length(bare) - 4)).otherwise(bare)


def repo_name(url: Column) -> Column:
    return F.substring_index(clean_repo_url(url), "/", -1)
