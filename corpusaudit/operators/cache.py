"""Reuse of stored analyses and of transformation examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusaudit.operators.files import cache_key
from corpusaudit.operators.grouping import first_per_group


def with_cache_key(files: DataFrame) -> DataFrame:
    return files.withColumn("cache_key", cache_key(F.col("file_path"), F.col("content")))


def cached_split(files: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits with ``payload``, misses). The newest payload of a key is used.

    Keys alone are compared with the cache; only the texts that are missing from
    it move.
    """
    keyed = with_cache_key(files)
    newest = newest_payloads(cache)
    hits = keyed.drop("content").join(newest, "cache_key")
    return hits, missing(keyed, newest)


def missing(keyed: DataFrame, known: DataFrame) -> DataFrame:
    """The rows whose ``cache_key`` isn't among the known ones: first the keys, then the texts of those that are left."""
    absent = keyed.select("cache_key").distinct().join(known.select("cache_key"), "cache_key", "left_anti")
    return keyed.join(absent, "cache_key", "left_semi")


def newest_payloads(cache: DataFrame) -> DataFrame:
    return cache.groupBy("cache_key").agg(F.max_by("payload", "created_at").alias("payload"))


#: Characters of a key that name the part of a stored cache it is in: 256 parts.
KEY_PART = 2


def key_part(key: Column) -> Column:
    return F.substring(key, 1, KEY_PART)


def write_cache(cache: DataFrame, path: str, mode: str = "append") -> None:
    """Store analyses (cache_key, payload, created_at) in parts by the beginning of their key."""
    cache.select("cache_key", "payload", "created_at", key_part(F.col("cache_key")).alias("key_part")).write.partitionBy("key_part").mode(mode).parquet(path)


def look_up(stored_cache: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of a cache with a ``key_part`` that have one of the keys; only the parts that the keys fall in are read.

    The driver holds the names of those parts, at most one for each beginning of
    a key, and the cache's rows are met by key without moving payloads of others.
    """
    wanted = keys.select("cache_key").distinct()
    parts = [r[0] for r in wanted.select(key_part(F.col("cache_key")).alias("part")).distinct().collect()]
    return stored_cache.where(F.col("key_part").isin(*parts)).join(wanted, "cache_key", "left_semi")


def merge_cache(cache: DataFrame, new: DataFrame) -> DataFrame:
    """Union of both; the newest payload wins."""
    both = cache.select("cache_key", "payload", "created_at").unionByName(
        new.select("cache_key", "payload", "created_at")
    )
    return both.groupBy("cache_key").agg(
        F.max_by("payload", "created_at").alias("payload"), F.max("created_at").alias("created_at")
    )


def store_examples(transformations: DataFrame) -> DataFrame:
    """Examples (pattern, before, after, repo if there is one, file_path) with whole texts."""
    repo = ["repo"] if "repo" in transformations.columns else []
    return transformations.select("pattern", F.col("original_code").alias("before"), F.col("modernized_code").alias("after"), *repo, "file_path")


def transformation_examples(
    examples: DataFrame, wanted: DataFrame, limit: int | None = None, order: list[Column] | None = None
) -> DataFrame:
    """The examples for each wanted pattern, the first ``limit`` of each by ``order`` if that is given.

    Examples are cut per pattern before the join, so it never multiplies rows.
    """
    patterns = wanted.select("pattern").distinct()
    if limit is None:
        return patterns.join(examples, "pattern")
    best = first_per_group(examples, ["pattern"], order or [F.col("file_path").asc()], limit, "example_no")
    return patterns.join(best, "pattern")
