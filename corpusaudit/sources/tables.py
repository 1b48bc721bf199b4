"""Embedding index and repository URLs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusaudit.functions import paths
from corpusaudit.operators import knn

_LISTS = "width int, model string, centres array<array<double>>, probes int"


def write_index(chunks: DataFrame, path: str, lists: knn.Lists | None = None) -> knn.Lists:
    """Store chunks by search list and the lists beside; adaptive rebalancing splits large ones.

    Without ``lists`` they are trained, their number by that of the chunks.
    """
    lists = lists or knn.train_lists(chunks)
    knn.with_list(chunks, lists).hint("rebalance", F.col("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/chunks")
    rows = [(w, m, c.tolist(), lists.probes[w, m]) for (w, m), c in lists.centres.items()]
    chunks.sparkSession.createDataFrame(rows, _LISTS).write.mode("overwrite").parquet(f"{path}/lists")
    return lists


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, knn.Lists]:
    """The chunks with their ``bucket``, and the lists."""
    rows = spark.read.schema(_LISTS).parquet(f"{path}/lists").collect()
    lists = knn.Lists({(r["width"], r["model"]): np.array(r["centres"]) for r in rows}, {(r["width"], r["model"]): r["probes"] for r in rows})
    return spark.read.parquet(f"{path}/chunks"), lists


def parse_repo_url(df: DataFrame, column: str = "url") -> DataFrame:
    """Add the cleaned URL and the repository name."""
    url = F.col(column)
    return df.withColumn("repo_url", paths.clean_repo_url(url)).withColumn("repo", paths.repo_name(url))
