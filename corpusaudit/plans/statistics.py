"""Totals of a run. Each is one aggregation; none collects rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusaudit import dims
from corpusaudit.functions.text import count_of


def _sum(c: str | Column) -> Column:
    return F.coalesce(F.sum(c), F.lit(0))


def _percent(part: Column, whole: Column) -> Column:
    return F.round(part / F.greatest(whole, F.lit(1)) * 100, 2)


def category_stats(classified: DataFrame) -> DataFrame:
    """Files per known category, zeros kept, and the total over all categories."""
    category = F.col("category")
    return classified.agg(
        *[F.count_if(category == c).alias(c) for c in dims.CATEGORIES], F.count(F.lit(1)).alias("total")
    )


def analysis_statistics(categorised: DataFrame) -> DataFrame:
    """Counts, severities, mean score and effort of categorised facts, one row."""
    category = F.col("category")
    total = F.count(F.lit(1))
    high, low = F.count_if(category == "modernize_high"), F.count_if(category == "modernize_low")
    return categorised.agg(
        total.alias("total_files"),
        high.alias("modernize_high"),
        low.alias("modernize_low"),
        (total - high - low).alias("skip"),
        *[_sum(f"n_{s}").cast("bigint").alias(s) for s in dims.SEVERITIES],
        F.round(_sum("modernization_score") / F.greatest(total, F.lit(1)), 2).alias("average_modernization_score"),
        F.round(_sum("effort_hours"), 2).alias("total_estimated_effort_hours"),
        _sum("n_patterns").cast("bigint").alias("patterns_detected"),
    )


def severity_breakdown(patterns: DataFrame, keep_zero: bool = True) -> DataFrame:
    """Patterns per severity, most severe first."""
    counts = patterns.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in dims.SEVERITIES])
    rows = counts.select(
        F.explode(
            F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(s).alias("severity"), F.col(s).alias("patterns")) for i, s in enumerate(dims.SEVERITIES)])
        ).alias("r")
    ).select("r.*")
    return rows if keep_zero else rows.filter(F.col("patterns") > 0)


def validation_rollup(validations: DataFrame) -> DataFrame:
    """Tests run, passed and failed; mean coverage over files that have any."""
    run, passed = _sum("tests_run"), _sum("tests_passed")
    coverage = F.col("coverage_percent")
    return validations.agg(
        F.count(F.lit(1)).alias("files_validated"),
        run.cast("bigint").alias("total_tests"),
        passed.cast("bigint").alias("tests_passed"),
        (run - passed).cast("bigint").alias("tests_failed"),
        F.coalesce(F.round(F.avg(F.when(coverage > 0, coverage)), 2), F.lit(0.0)).alias("average_coverage"),
        _percent(passed, run).alias("pass_rate"),
    )


def run_statistics(files: DataFrame, transformations: DataFrame, validations: DataFrame) -> DataFrame:
    """Totals over the three tables of a run, one row.

    Each table is reduced on its own; the three rows are then summed.
    """
    coverage = F.col("coverage_percent")
    parts = [
        files.agg(F.count(F.lit(1)).alias("files")),
        transformations.agg(F.count(F.lit(1)).alias("done")),
        validations.agg(
            _sum("tests_run").cast("bigint").alias("run"),
            _sum("tests_passed").cast("bigint").alias("passed"),
            _sum(F.when(coverage > 0, coverage)).alias("coverage"),
            F.count_if(coverage > 0).alias("covered"),
        ),
    ]
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return union.agg(
        _sum("files").alias("total_files"),
        _sum("done").alias("files_modernized"),
        _sum("run").alias("tests_generated"),
        _percent(_sum("passed"), _sum("run")).alias("test_pass_rate"),
        F.round(_sum("coverage") / F.greatest(_sum("covered"), F.lit(1)), 2).alias("average_coverage"),
    )


def change_stats(transformations: DataFrame, validations: DataFrame) -> DataFrame:
    """Files changed, newlines in their new texts, and the pass rate, one row."""
    parts = [
        transformations.agg(
            F.count(F.lit(1)).alias("files"), _sum(count_of(F.col("modernized_code"), "\n")).alias("lines")
        ),
        validations.agg(_sum("tests_run").cast("bigint").alias("run"), _sum("tests_passed").cast("bigint").alias("passed")),
    ]
    union = parts[0].unionByName(parts[1], allowMissingColumns=True)
    run, passed = _sum("run"), _sum("passed")
    return union.agg(
        _sum("files").alias("total_files"),
        _sum("lines").cast("bigint").alias("lines_added"),
        F.round(F.when(run > 0, passed / run * 100).otherwise(0.0), 2).alias("pass_rate"),
    )
