"""Priorities, work plans and grouped patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusaudit import dims
from corpusaudit.functions import severity
from corpusaudit.operators.grouping import Keys, first_per_group, key_list


def priority_score(facts: DataFrame) -> DataFrame:
    """Add ``priority_score``: file weight, weighted patterns, and the missing score."""
    score = (
        severity.weight(F.col("overall_priority"), dims.FILE_WEIGHT_DEFAULT)
        + F.col("pattern_score")
        + (100 - F.col("modernization_score")) / 10
    )
    return facts.withColumn("priority_score", F.round(score, 4))


def prioritise(facts: DataFrame, k: int | None = None, per_repo: bool = False) -> DataFrame:
    """Files by falling score, ties by path; the first k overall or per repository."""
    scored = priority_score(facts)
    order = [F.desc("priority_score"), F.asc("file_path")]
    if per_repo:
        if k is None:
            return scored.orderBy("repo", *order)
        return first_per_group(scored, ["repo"], order, k, "rank")
    ranked = scored.orderBy(*order)
    return ranked if k is None else ranked.limit(k)


def top_files(facts: DataFrame, k: int = 10, required_only: bool = False) -> DataFrame:
    """The k first files with their rank."""
    chosen = facts.filter("requires_modernization") if required_only else facts
    # The window sees only the k rows the limit leaves.
    window = Window.orderBy(F.desc("priority_score"), F.asc("file_path"))
    return prioritise(chosen, k).withColumn("rank", F.row_number().over(window))


def plan_steps(patterns: DataFrame, order: list[str], key: Keys = "file_path", payload: list[str] | None = None) -> DataFrame:
    """Per file and pattern type the most severe pattern, the first of equals.

    ``order`` gives the order of appearance and must break every tie. Both parts
    are minima of records, so nothing is sorted or collected.
    """
    payload = payload or ["confidence", "estimated_effort_hours"]
    fields = dict.fromkeys([*order, "severity", *payload])
    record = F.struct((-severity.rank(F.col("severity"))).alias("r"), *fields)
    keys = key_list(key)
    best = patterns.groupBy(*keys, "pattern_type").agg(
        F.min(record).alias("best"), F.min(F.struct(*order)).alias("first_seen")
    )
    return best.select(*keys, "pattern_type", "first_seen", "best.severity", *[F.col(f"best.{c}").alias(c) for c in payload])


def transformation_plan(analyses: DataFrame, patterns: DataFrame, order: list[str], key: Keys = "file_path") -> DataFrame:
    """One plan per file: ordered steps, effort of the kept patterns, priority.

    Steps are at most one per pattern type of the file.
    """
    steps = plan_steps(patterns, order, key)
    step = F.struct("first_seen", "pattern_type", "severity", "confidence", "estimated_effort_hours")
    per_file = steps.groupBy(*key_list(key)).agg(
        F.sort_array(F.collect_list(step)).alias("steps"), F.sum("estimated_effort_hours").alias("effort")
    )
    return analyses.join(per_file, key_list(key)).select(
        *analyses.columns,
        F.concat("language", F.lit(" modernization")).alias("pattern"),
        F.transform("steps", lambda s: s.dropFields("first_seen")).alias("steps"),
        F.round("effort", 4).alias("estimated_effort_hours"),
    )


def plan_of_nested(analyses: DataFrame) -> DataFrame:
    """The same plan from the nested patterns of an analysis, inside the row."""
    p = F.col("patterns")
    types = F.array_distinct(F.transform(p, lambda x: x["pattern_type"]))

    def best(pattern_type):
        of_type = F.filter(p, lambda x: x["pattern_type"] == pattern_type)
        top = F.array_max(F.transform(of_type, lambda x: severity.rank(x["severity"])))
        return F.filter(of_type, lambda x: severity.rank(x["severity"]) == top)[0]

    steps = F.transform(types, best)
    effort = F.aggregate(F.col("steps"), F.lit(0.0), lambda acc, s: acc + s["estimated_effort_hours"])
    return (
        analyses.withColumn("steps", steps)
        .withColumn("pattern", F.concat("language", F.lit(" modernization")))
        .withColumn("estimated_effort_hours", effort)
        .drop("patterns")
    )


def transformable(analyses: DataFrame, files: DataFrame, key: Keys = "file_path") -> DataFrame:
    """Analyses that require work, joined with their text; files without text drop out."""
    return (
        analyses.filter("requires_modernization")
        .join(files.select(*key_list(key), "content"), key_list(key))
        .filter(F.coalesce("content", F.lit("")) != "")
    )


def combine_patterns(groups: DataFrame, max_groups: int | None = None, max_files: int | None = None) -> DataFrame:
    """Files with the names of their groups joined by AND, in group order.

    ``groups`` has group_no, name and a files array in rank order; the limits
    are the numbers of groups and of files per group to use, by default all.
    """
    chosen = groups if max_groups is None else groups.orderBy("group_no").limit(max_groups)
    files = F.col("files") if max_files is None else F.slice("files", 1, max_files)
    rows = chosen.select("group_no", "name", F.explode(files).alias("file_path"))
    names = F.transform(F.sort_array(F.collect_list(F.struct("group_no", "name"))), lambda g: g["name"])
    return rows.groupBy("file_path").agg(F.array_join(names, " AND ").alias("combined_pattern"))
