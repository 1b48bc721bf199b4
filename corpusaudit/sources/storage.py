"""Access to files of a shared file system from inside tasks."""

from __future__ import annotations

import os

import pyarrow.fs as pafs


def open_fs(root: str) -> tuple[pafs.FileSystem, str]:
    """File system and bare path of a URI, or of a plain local or mounted path."""
    if "://" in root:
        return pafs.FileSystem.from_uri(root)
    return pafs.LocalFileSystem(), os.path.abspath(root)


def is_link(fs: pafs.FileSystem, path: str) -> bool:
    return isinstance(fs, pafs.LocalFileSystem) and os.path.islink(path)
