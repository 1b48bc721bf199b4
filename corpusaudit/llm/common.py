"""Helpers that the operators of this folder share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusaudit.session import stored  # noqa: F401 - used by the operators


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_remainder(key: str, modulus: int) -> Column:
    """crc32 of the key as text, by ``modulus``; null for a null key."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % modulus


def spread(key: Column) -> Column:
    """An order of rows that has nothing to do with their content: by hash of the key."""
    return F.xxhash64(F.lit(17), key.cast("string"))
