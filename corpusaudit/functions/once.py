"""Columns that are computed exactly once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column that later filters and projections read but never repeat.

    Filters on a computed column are pushed below it together with a copy of its
    expression, and projections may inline it several times. A one-element
    explode is a barrier to both: it keeps the row and evaluates the value once.
    """
    others = [c for c in df.columns if c != name]
    placed = "once_" + name if name in df.columns else name
    out = df.select("*", F.explode(F.array(value)).alias(placed))
    return out if placed == name else out.select(*others, F.col(placed).alias(name))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, however often the body reads it."""
    return F.transform(F.array(value), body)[0]
