"""Checks on uploaded files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusaudit import dims
from corpusaudit.functions import paths

MAX_UPLOAD_BYTES = 10 * 1024 * 1024


def validate_uploads(files: DataFrame, max_bytes: int = MAX_UPLOAD_BYTES) -> DataFrame:
    """Suffix, then size, then encoding of ``content`` bytes; the first failure is the reason.

    The whole file must be UTF-8, not just its beginning.
    """
    suffix = F.lower(paths.suffix(F.col("file_path")))
    size = F.octet_length("content").cast("bigint")
    reason = (
        F.when(~suffix.isin(*dims.UPLOAD_SUFFIXES), "unsupported type")
        .when(size > max_bytes, "too large")
        .when(~F.is_valid_utf8(F.col("content").cast("string")), "encoding error")
    )
    return (
        files.withColumn("size_bytes", size)
        .withColumn("reason", reason)
        .withColumn("is_valid", F.col("reason").isNull())
        .withColumn("language", F.when(F.col("is_valid"), dims.language_of(suffix, "upload")))
    )
