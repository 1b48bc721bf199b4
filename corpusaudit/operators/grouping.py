"""Numbering and grouping that stay even when one group holds much of the data."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusaudit.functions.once import let

#: Rows of one group that one task may sort; larger groups are cut into ranges.
ROWS_PER_TASK = 2_000_000
#: Upper bound on the number of cut points, and so on what the driver holds.
MAX_CUTS = 5_000


Keys = str | list[str]


def key_list(key: Keys) -> list[str]:
    """A key of one column or of several, such as repo and file_path."""
    return [key] if isinstance(key, str) else list(key)


def file_key(df: DataFrame) -> list[str]:
    """What identifies a file of a table: its path, and its repository where the table names one."""
    return [c for c in ("repo", "file_path") if c in df.columns]


def _cut_points(df: DataFrame, key: Column, rows: int, rows_per_task: int) -> tuple[Column, int]:
    """Sampled cut points in order, as one constant array, and their number.

    They decide balance only; any choice gives the same result. The sample holds
    about 20 rows per cut, and the driver sees no more than the cuts.
    """
    wanted = min(MAX_CUTS, -(-rows // rows_per_task))
    sample = df.select(key.alias("k")).sample(min(1.0, wanted * 20 / rows), seed=7)
    picked = (
        sample.distinct()
        .withColumn("tile", F.ntile(wanted).over(Window.orderBy("k")))
        .groupBy("tile")
        .agg(F.min("k").alias("k"))
    )
    cuts = [row["k"] for row in picked.orderBy("tile").select(F.to_json("k").alias("k")).collect()]
    # Spark folds the parsed text into a literal; building it value by value would be slow.
    schema = T.ArrayType(df.select(key.alias("k")).schema["k"].dataType)
    return F.from_json(F.lit("[" + ", ".join(cuts) + "]"), schema), len(cuts)


def _range_of(key: Column, cuts: Column, n: int) -> Column:
    """Number of cuts at or below the key, looked up in two steps of about sqrt(n)."""
    step = max(1, math.isqrt(n))

    def at_or_below(some: Column) -> Column:
        return F.size(F.filter(some, lambda cut: cut <= key))

    every = F.filter(cuts, lambda _, i: i % step == 0)
    before = let(at_or_below(every), lambda x: F.greatest(x - 1, F.lit(0)) * step)
    return let(before, lambda skipped: skipped + at_or_below(F.slice(cuts, skipped + 1, step)))


def row_numbers(
    df: DataFrame,
    group: list[str],
    order: list[str],
    out: str = "rn",
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Number the rows of each group by ``order``, starting at 1.

    ``group`` + ``order`` must identify a row. With no large group this is a
    plain window. Otherwise rows are cut into ranges of (group, order), numbered
    inside each range, and shifted by the rows of earlier ranges. Shifts are at
    most one per cut and group that crosses it, so they are safe to broadcast.
    """
    by_group = df.groupBy(*group) if group else df.groupBy()
    counts = by_group.agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("top"), F.sum("n").alias("rows")).first()
    top, rows = counts["top"] or 0, counts["rows"] or 0
    if top <= rows_per_task:
        window = Window.partitionBy(*group) if group else Window.partitionBy()
        return df.withColumn(out, F.row_number().over(window.orderBy(*order)).cast("bigint"))

    key = F.struct(*group, *order)
    cuts, n = _cut_points(df, key, rows, rows_per_task)
    cut_df = df.withColumn("range_id", _range_of(key, cuts, n))
    per_range = cut_df.groupBy(*group, "range_id").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy(*group).orderBy("range_id").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        per_range.withColumn("shift", F.sum("n").over(earlier))
        .filter(F.col("shift").isNotNull())
        .drop("n")
    )
    inside = Window.partitionBy(*group, "range_id").orderBy(*order)
    return (
        cut_df.withColumn("pos_in_range", F.row_number().over(inside))
        .join(F.broadcast(shifts), [*group, "range_id"], "left")
        .withColumn(out, (F.col("pos_in_range") + F.coalesce("shift", F.lit(0))).cast("bigint"))
        .drop("range_id", "pos_in_range", "shift")
    )


def batches(
    df: DataFrame,
    size: int,
    order: list[str],
    group: list[str] | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Add ``batch_id`` (from 0) of contiguous batches of ``size`` rows per group."""
    numbered = row_numbers(df, group or [], order, "rn", rows_per_task)
    return numbered.withColumn("batch_id", F.floor((F.col("rn") - 1) / size).cast("bigint")).drop("rn")


def first_per_group(df: DataFrame, group: list[str], order: list[Column], k: int, out: str = "rn") -> DataFrame:
    """The first k rows of each group; Spark keeps k per group before shuffling."""
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(out, F.row_number().over(window)).filter(F.col(out) <= k)


def last_write_wins(frames: list[DataFrame], key: Keys, version: str) -> DataFrame:
    """Union of batch results; the row of the highest version is kept per key."""
    keys = key_list(key)
    union = reduce(lambda a, b: a.unionByName(b), frames)
    row = F.struct(*[F.col(c) for c in union.columns if c not in keys])
    return union.groupBy(*keys).agg(F.max_by(row, version).alias("r")).select(*keys, "r.*")
