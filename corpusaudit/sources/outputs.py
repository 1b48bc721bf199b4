"""Outputs of a run and commit batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusaudit.functions import paths
from corpusaudit.operators.grouping import ROWS_PER_TASK, batches

TEST_PREFIX = "test_"


def output_rows(transformations: DataFrame) -> DataFrame:
    """Modernised, original and test texts as rows (kind, path, text).

    The full path is kept; a file without tests gets no test row.
    """
    path = F.col("file_path")
    kinds = F.array(
        F.struct(F.lit("modernized").alias("kind"), path.alias("path"), F.col("modernized_code").alias("text")),
        F.struct(F.lit("original").alias("kind"), path.alias("path"), F.col("original_code").alias("text")),
        F.struct(
            F.lit("tests").alias("kind"),
            F.concat(F.lit(TEST_PREFIX), paths.basename(path)).alias("path"),
            F.col("test_code").alias("text"),
        ),
    )
    keys = [c for c in ("repo",) if c in transformations.columns]
    exploded = transformations.select(*keys, F.explode(kinds).alias("o")).select(*keys, "o.*")
    return exploded.filter((F.col("kind") != "tests") | (F.coalesce("text", F.lit("")) != ""))


def write_outputs(transformations: DataFrame, path: str) -> None:
    """Write the outputs as Parquet, one folder per kind."""
    output_rows(transformations).write.mode("overwrite").partitionBy("kind").parquet(path)


def select_run_artifacts(listing: DataFrame, transformations: DataFrame) -> DataFrame:
    """Top-level outputs (columns kind, path) whose name belongs to a file of this run.

    Where both tables name the repository, it must be the same. A test belongs to the name left after every ``test_`` is removed. The names
    are made distinct first, so a name shared by many files never multiplies rows.
    """
    repo = [c for c in ("repo",) if c in listing.columns and c in transformations.columns]
    names = transformations.select(*repo, paths.basename(F.col("file_path")).alias("owner")).distinct()
    owner = F.when(
        F.col("kind") == "tests", F.replace(F.col("path"), F.lit(TEST_PREFIX), F.lit(""))
    ).otherwise(F.col("path"))
    top_level = listing.filter(~F.col("path").contains("/"))
    return top_level.withColumn("owner", owner).join(names, [*repo, "owner"], "left_semi").drop("owner")


def commit_batches(
    changed: DataFrame, size: int = 10, rows_per_task: int = ROWS_PER_TASK, group: list[str] | None = None
) -> DataFrame:
    """Number the files of each repository into commits of ``size``, in path order."""
    numbered = batches(changed, size, ["file_path"], group or ["repo"], rows_per_task)
    batch = F.col("batch_id") + 1
    return numbered.withColumn("batch", batch).withColumn(
        "message", F.concat(F.lit("Modernize batch "), batch.cast("string"))
    ).drop("batch_id")
