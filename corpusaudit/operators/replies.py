"""Parsing of structured model replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusaudit import dims
from corpusaudit.functions.once import with_once
from corpusaudit.functions.text import strip

# Fields of the reply shapes.
PATTERN = (
    "struct<pattern_type:string,severity:string,line_numbers:array<int>,confidence:double,"
    "description:string,recommendation:string,estimated_effort_hours:double>"
)
SHAPES = {
    "language": "language string, framework string, confidence double",
    "patterns": (
        f"patterns array<{PATTERN}>, modernization_score double, requires_modernization boolean, "
        "overall_priority string"
    ),
    "batch": (
        "files array<struct<file_path:string,language:string,framework:string,"
        f"patterns:array<{PATTERN}>,modernization_score:double,requires_modernization:boolean,overall_priority:string>>"
    ),
    "classification": (
        "classification string, confidence double, reasoning string, language string, framework string"
    ),
    "analysis": (
        "summary string, "
        "issues array<struct<type:string,severity:string,description:string,line_numbers:array<int>,recommendation:string>>, "
        "transformation_steps array<struct<step:string,description:string,priority:string,estimated_hours:double>>, "
        "dependencies array<string>, estimated_total_hours double"
    ),
    "tests": (
        "test_framework string, test_count int, coverage_areas array<string>, test_types array<string>, notes string"
    ),
}
FILE_CLASSES = ["primary", "secondary", "test", "config", "documentation"]
STEP_PRIORITIES = ["critical", "high", "medium", "low"]
TEST_TYPES = ["unit", "integration", "edge_case", "error_handling"]


def _patterns_bad(patterns: Column) -> Column:
    """A pattern without type or texts, or with an unknown severity."""
    return F.exists(
        patterns,
        lambda p: p["pattern_type"].isNull()
        | p["description"].isNull()
        | p["recommendation"].isNull()
        | ~F.coalesce(p["severity"].isin(*dims.SEVERITIES), F.lit(False)),
    )


def _outside(c: Column, allowed: list[str]) -> Column:
    return c.isNotNull() & ~c.isin(*allowed)


# Fields that the reply to an analysis, and each of its patterns, must have.
ANALYSIS_FIELDS = ["patterns", "modernization_score", "requires_modernization", "overall_priority"]
PATTERN_FIELDS = ["pattern_type", "severity", "line_numbers", "confidence", "description", "recommendation", "estimated_effort_hours"]


def _lacks(r: Column, fields: list[str]) -> Column:
    bad = F.lit(False)
    for field in fields:
        bad = bad | r[field].isNull()
    return bad


def _analysis_lacks(r: Column, strict: bool) -> Column:
    """A reply without its required fields; unless ``strict``, only the list of patterns is required."""
    if not strict:
        return r["patterns"].isNull()
    return _lacks(r, ANALYSIS_FIELDS) | F.coalesce(F.exists(r["patterns"], lambda p: _lacks(p, PATTERN_FIELDS)), F.lit(False))


def _checks(shape: str, r: Column, strict: bool) -> list[tuple[str, Column]]:
    """(error, condition) pairs; the first that holds is reported."""
    none = F.lit(False)
    if shape == "language":
        return [("missing field", r["language"].isNull() | r["confidence"].isNull())]
    if shape == "patterns":
        return [
            ("missing field", _analysis_lacks(r, strict)),
            ("bad pattern", F.coalesce(_patterns_bad(r["patterns"]), none)),
            ("value outside enum", _outside(r["overall_priority"], dims.SEVERITIES)),
        ]
    if shape == "batch":
        files = r["files"]
        return [
            ("missing field", F.coalesce(F.exists(files, lambda f: f["file_path"].isNull() | _analysis_lacks(f, strict)), F.lit(True))),
            ("bad pattern", F.coalesce(F.exists(files, lambda f: F.coalesce(_patterns_bad(f["patterns"]), none)), none)),
            (
                "value outside enum",
                F.coalesce(F.exists(files, lambda f: _outside(f["overall_priority"], dims.SEVERITIES)), none),
            ),
        ]
    if shape == "classification":
        missing = r["classification"].isNull() | r["confidence"].isNull() | r["reasoning"].isNull() | r["language"].isNull()
        return [("missing field", missing), ("value outside enum", _outside(r["classification"], FILE_CLASSES))]
    if shape == "analysis":
        missing = (
            r["summary"].isNull()
            | r["issues"].isNull()
            | r["transformation_steps"].isNull()
            | r["dependencies"].isNull()
            | r["estimated_total_hours"].isNull()
        )
        outside = F.exists(r["issues"], lambda i: _outside(i["severity"], dims.SEVERITIES)) | F.exists(
            r["transformation_steps"], lambda s: _outside(s["priority"], STEP_PRIORITIES)
        )
        return [("missing field", missing), ("value outside enum", F.coalesce(outside, none))]
    missing = (
        r["test_framework"].isNull()
        | r["test_count"].isNull()
        | r["coverage_areas"].isNull()
        | r["test_types"].isNull()
        | r["notes"].isNull()
    )
    outside = F.exists(r["test_types"], lambda t: _outside(t, TEST_TYPES))
    return [("missing field", missing), ("value outside enum", F.coalesce(outside, none))]


def parse_replies(replies: DataFrame, shape: str, strict: bool = True) -> DataFrame:
    """Add ``reply`` (typed, null when bad) and ``error`` (null when good).

    All fields that a shape requires must be there. Unless ``strict``, analyses
    and patterns may leave out what has a default, but not their patterns.
    """
    schema = SHAPES[shape] + ", corrupt string"
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt"}
    parsed = with_once(replies, "reply", F.from_json("response_text", schema, options))
    empty = F.coalesce(strip(F.col("response_text")), F.lit("")) == ""
    error = F.when(empty, "empty reply").when(F.col("reply.corrupt").isNotNull(), "malformed JSON")
    for name, bad in _checks(shape, F.col("reply"), strict):
        error = error.when(bad, name)
    return parsed.withColumn("error", error).withColumn(
        "reply", F.when(F.col("error").isNull(), F.col("reply").dropFields("corrupt"))
    )


def _filled_pattern(p: Column) -> Column:
    return F.struct(
        p["pattern_type"].alias("pattern_type"),
        p["severity"].alias("severity"),
        p["description"].alias("description"),
        F.coalesce(p["line_numbers"], F.array().cast("array<int>")).alias("line_numbers"),
        F.coalesce(p["confidence"], F.lit(0.8)).alias("confidence"),
        p["recommendation"].alias("recommendation"),
        F.coalesce(p["estimated_effort_hours"], F.lit(1.0)).alias("estimated_effort_hours"),
    )


_FILLED = (
    "array<struct<pattern_type:string,severity:string,description:string,line_numbers:array<int>,"
    "confidence:double,recommendation:string,estimated_effort_hours:double>>"
)


def _filled(patterns: Column) -> Column:
    return F.coalesce(F.transform(patterns, _filled_pattern), F.array().cast(_FILLED))


def analyses_from_replies(replies: DataFrame) -> DataFrame:
    """One analysis per single-file reply; a bad reply gives the neutral analysis.

    Good replies get the defaults for missing values. Neutral means no patterns,
    ``info``, 100, not required.
    """
    parsed = parse_replies(replies, "patterns", strict=False)
    good, r = F.col("error").isNull(), F.col("reply")
    return parsed.select(
        *[c for c in replies.columns if c != "response_text"],
        _filled(r["patterns"]).alias("patterns"),
        F.when(good, F.coalesce(r["overall_priority"], F.lit("medium"))).otherwise("info").alias("overall_priority"),
        F.when(good, F.coalesce(r["modernization_score"], F.lit(50.0))).otherwise(100.0).alias("modernization_score"),
        F.when(good, F.coalesce(r["requires_modernization"], F.lit(True))).otherwise(False).alias("requires_modernization"),
        "error",
    )


def explode_batch(replies: DataFrame) -> DataFrame:
    """Batch replies as one row per file and pattern, defaults filled in.

    A file without patterns keeps one row with a null pattern type.
    """
    parsed = parse_replies(replies, "batch", strict=False).filter(F.col("error").isNull())
    files = parsed.select("request_id", F.explode("reply.files").alias("f"))
    rows = files.select("request_id", "f", F.explode_outer(_filled(F.col("f.patterns"))).alias("p"))
    return rows.select(
        "request_id",
        F.col("f.file_path").alias("file_path"),
        F.coalesce("f.language", F.lit("Unknown")).alias("language"),
        F.col("f.framework").alias("framework"),
        F.coalesce("f.overall_priority", F.lit("medium")).alias("overall_priority"),
        F.coalesce("f.modernization_score", F.lit(50.0)).alias("modernization_score"),
        F.coalesce("f.requires_modernization", F.lit(True)).alias("requires_modernization"),
        "p.*",
    )


def error_rows(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("error").isNotNull()).select("request_id", "error")
