"""Weights and ranks of severities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusaudit import dims


def weight(severity: Column, default: int) -> Column:
    return F.coalesce(dims.lookup(severity, dims.SEVERITY_WEIGHT), F.lit(default))


def rank(severity: Column) -> Column:
    return F.coalesce(dims.lookup(severity, dims.SEVERITY_RANK), F.lit(0))
