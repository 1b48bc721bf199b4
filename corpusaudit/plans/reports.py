"""Reports as rows (section, ord, label, value), and the audit bundle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusaudit import dims
from corpusaudit.operators import analysis
from corpusaudit.operators.grouping import first_per_group
from corpusaudit.plans import ranking, statistics
from corpusaudit.session import stored

Section = list[tuple[str, Column]]


def _records(section: str, items: Section) -> list[Column]:
    return [
        F.struct(
            F.lit(section).alias("section"),
            F.lit(i).alias("ord"),
            F.lit(label).alias("label"),
            value.cast("double").alias("value"),
        )
        for i, (label, value) in enumerate(items)
    ]


def _rows(row: DataFrame, *records: Column) -> DataFrame:
    """Records of a one-row frame as report rows."""
    return row.select(F.explode(F.array(*records)).alias("r")).select("r.*")


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _severities(item: dict[str, Column]) -> list[Column]:
    return _records("severities", [(label, value) for label, value in item.items()])


def _without_zero(section: str) -> Column:
    return ~((F.col("section") == section) & (F.col("value") == 0))


def pattern_report(facts: DataFrame, top: int = 10) -> DataFrame:
    """Summary, languages, severities without zeros, and the first files.

    The facts are read twice: once for all counts, which are taken per language
    and then summed, and once for the first files.
    """
    sums = ["n_patterns", "modernization_score", *[f"n_{s}" for s in dims.SEVERITIES]]
    per_language = facts.groupBy("language").agg(
        F.count(F.lit(1)).alias("files"),
        F.count_if("requires_modernization").alias("required"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums],
    )
    # There are as many languages as the dictionaries name, a few dozen.
    languages = F.sort_array(F.collect_list(F.struct((-F.col("files")).alias("m"), "language")))
    totals = per_language.agg(
        languages.alias("languages"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ["files", "required", *sums]]
    )
    score = F.round(F.col("modernization_score") / F.greatest("files", F.lit(1)), 1)
    summary = _records(
        "summary",
        [
            ("files analysed", F.col("files")),
            ("files requiring modernization", F.col("required")),
            ("patterns detected", F.col("n_patterns")),
            ("average modernization score", score),
        ],
    )
    by_language = F.transform(
        "languages",
        lambda x, i: F.struct(
            F.lit("languages").alias("section"),
            i.alias("ord"),
            x["language"].alias("label"),
            (-x["m"]).cast("double").alias("value"),
        ),
    )
    fixed = F.array(*summary, *_severities({s: F.col(f"n_{s}") for s in dims.SEVERITIES}))
    counted = totals.select(F.explode(F.concat(fixed, by_language)).alias("r")).select("r.*")
    first = ranking.top_files(facts, top).select(
        F.lit("top files").alias("section"),
        (F.col("rank") - 1).alias("ord"),
        F.col("file_path").alias("label"),
        F.col("priority_score").alias("value"),
    )
    return counted.filter(_without_zero("severities")).unionByName(first)


def run_report(run_stats: DataFrame, analysis_stats: DataFrame, rollup: DataFrame) -> DataFrame:
    """Statistics, pattern analysis and phase results; a zero coverage is left out."""
    stats = _rows(run_stats, *_records("statistics", [(c.replace("_", " ").title(), F.col(c)) for c in run_stats.columns]))
    patterns = _rows(
        analysis_stats,
        *_records(
            "patterns",
            [
                ("Patterns Detected", F.col("patterns_detected")),
                ("Average Modernization Score", F.col("average_modernization_score")),
                ("Total Estimated Effort", F.col("total_estimated_effort_hours")),
            ],
        ),
        *_severities({s.upper(): F.col(s) for s in dims.SEVERITIES}),
        *_records("classification", [(c, F.col(c)) for c in dims.CATEGORIES]),
    )
    validation = _rows(rollup, *_records("validation", [(c, F.col(c)) for c in rollup.columns]))
    no_coverage = (F.col("label") == "Average Coverage") & (F.col("value") == 0)
    return _union([stats.filter(~no_coverage), patterns.filter(_without_zero("severities")), validation])


def change_summary(run_stats: DataFrame, target_version: str) -> DataFrame:
    """Lines of a change request; the coverage line only if there is any coverage."""

    def number(c: str) -> Column:
        return F.format_string("%.1f", F.col(c))

    items = F.array(
        F.lit(f"Automated migration to {target_version}"),
        F.concat(F.lit("Files Modernized: "), F.col("files_modernized").cast("string"), F.lit(" / "), F.col("total_files").cast("string")),
        F.concat(F.lit("Tests Generated: "), F.col("tests_generated").cast("string")),
        F.concat(F.lit("Test Pass Rate: "), number("test_pass_rate"), F.lit("%")),
        F.when(F.col("average_coverage") > 0, F.concat(F.lit("Code Coverage: "), number("average_coverage"), F.lit("%"))),
    )
    return run_stats.select(F.posexplode(F.array_compact(items)).alias("ord", "line"))


def file_list(changed: DataFrame, n: int = 50) -> DataFrame:
    """The first n paths, numbered, and a last row that counts the others."""
    first = changed.select("file_path").orderBy("file_path").limit(n)
    # The window sees only the n rows the limit leaves.
    numbered = first.withColumn("ord", F.row_number().over(Window.orderBy("file_path"))).select(
        "ord", F.concat(F.col("ord").cast("string"), F.lit(". `"), F.col("file_path"), F.lit("`")).alias("line")
    )
    left = changed.agg((F.count(F.lit(1)) - n).alias("left")).filter(F.col("left") > 0)
    more = left.select(
        F.lit(n + 1).alias("ord"),
        F.concat(F.lit("... and "), F.col("left").cast("string"), F.lit(" more files")).alias("line"),
    )
    return numbered.unionByName(more)


def error_log(*errors: DataFrame) -> DataFrame:
    """Errors of all phases (columns phase, item, error), every row kept."""
    return _union([e.select("phase", F.col("item").cast("string").alias("item"), "error") for e in errors])


def shown_errors(errors: DataFrame, n: int = 5) -> DataFrame:
    """The first n errors of each phase, for display."""
    return first_per_group(errors, ["phase"], [F.asc("item"), F.asc("error")], n, "error_no")


def audit(files: DataFrame, rules=None) -> dict[str, DataFrame]:
    """All results of an audit of files (repo, file_path, content).

    The texts are read once: the analyses carry what every result needs and are
    written to the shared folder.
    """
    analysed = stored(analysis.categorise(analysis.with_facts(analysis.analyse_files(files, rules))), "audit")
    flat_facts = analysed.drop("patterns")
    return {
        "analyses": analysed,
        "prioritised": ranking.prioritise(flat_facts),
        "plans": ranking.plan_of_nested(analysed.filter("requires_modernization")),
        "statistics": statistics.analysis_statistics(flat_facts),
        "report": pattern_report(flat_facts),
    }
