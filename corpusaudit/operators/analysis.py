"""File analyses: summaries, categories, nesting, defaults.

``key`` names what identifies a file: its path within one repository, or
``["repo", "file_path"]`` over many.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusaudit import dims
from corpusaudit.functions import severity
from corpusaudit.functions.once import with_once
from corpusaudit.operators import rules as R
from corpusaudit.operators.grouping import Keys, batches, first_per_group, key_list

FACTS = [
    "n_patterns", *[f"n_{s}" for s in dims.SEVERITIES], "pattern_score", "effort_hours",
]


def _requires(rank: Column) -> Column:
    return rank >= dims.SEVERITY_RANK["low"]


def _priority_name(rank: Column) -> Column:
    names = {str(v): k for k, v in dims.SEVERITY_RANK.items()}
    return F.coalesce(dims.lookup(rank.cast("string"), names), F.lit("info"))


def analyse_files(files: DataFrame, rules=None) -> DataFrame:
    """Nested analyses straight from the texts, in one narrow pass.

    Our own definitions: the priority is the highest severity found, ``info``
    if none; the score is ``rules.modern_score``; modernisation is required
    when a pattern of at least low severity is found.
    """
    found = R.detect_nested(files, rules)
    top = F.coalesce(F.array_max(F.transform("patterns", lambda p: severity.rank(p["severity"]))), F.lit(0))
    return (
        found.withColumn("top_rank", top)
        .withColumn("overall_priority", _priority_name(F.col("top_rank")))
        .withColumn("modernization_score", R.modern_score(F.col("patterns")))
        .withColumn("requires_modernization", _requires(F.col("top_rank")))
        .drop("top_rank", "content")
    )


def summarise_file(files: DataFrame, patterns: DataFrame, key: Keys = "file_path") -> DataFrame:
    """The same summary from a flat pattern table; files without patterns are kept.

    The patterns are reduced per file before the join, partially on the map side.
    """
    w = severity.weight(F.col("severity"), dims.PATTERN_WEIGHT_DEFAULT)
    per_file = patterns.groupBy(*key_list(key)).agg(
        F.max(severity.rank(F.col("severity"))).alias("top_rank"),
        F.sum(w / 4 * F.col("confidence")).alias("lost"),
        F.count(F.lit(1)).alias("n_patterns"),
    )
    top = F.coalesce("top_rank", F.lit(0))
    return files.join(per_file, key_list(key), "left").select(
        *files.columns,
        _priority_name(top).alias("overall_priority"),
        F.greatest(F.lit(0.0), F.round(100 - F.coalesce("lost", F.lit(0.0)), 4)).alias("modernization_score"),
        _requires(top).alias("requires_modernization"),
        F.coalesce("n_patterns", F.lit(0)).alias("n_patterns"),
    )


def pattern_facts(patterns: DataFrame, key: Keys = "file_path") -> DataFrame:
    """What later steps need of a file's patterns, as numbers."""
    s = F.col("severity")
    return patterns.groupBy(*key_list(key)).agg(
        F.count(F.lit(1)).alias("n_patterns"),
        *[F.count_if(s == name).alias(f"n_{name}") for name in dims.SEVERITIES],
        F.sum(severity.weight(s, dims.PATTERN_WEIGHT_DEFAULT) * F.col("confidence")).alias("pattern_score"),
        F.sum("estimated_effort_hours").alias("effort_hours"),
    )


def with_facts(analyses: DataFrame, patterns: DataFrame | None = None, key: Keys = "file_path") -> DataFrame:
    """Analyses with the facts of their patterns.

    With a flat pattern table this is one aggregation and one join. Without,
    the facts come from the nested ``patterns`` column and nothing moves.
    """
    if patterns is not None:
        joined = analyses.join(pattern_facts(patterns, key), key_list(key), "left")
        zeros = {c: F.lit(0.0 if c in ("pattern_score", "effort_hours") else 0) for c in FACTS}
        return joined.withColumns({c: F.coalesce(F.col(c), z) for c, z in zeros.items()})
    p = F.col("patterns")

    def total(value) -> Column:
        return F.aggregate(p, F.lit(0.0), lambda acc, x: acc + value(x))

    def number_of(name: str) -> Column:
        return F.size(F.filter(p, lambda x: x["severity"] == name)).cast("bigint")

    facts = {"n_patterns": F.size(p).cast("bigint")}
    facts.update({f"n_{name}": number_of(name) for name in dims.SEVERITIES})
    facts["pattern_score"] = total(
        lambda x: severity.weight(x["severity"], dims.PATTERN_WEIGHT_DEFAULT) * x["confidence"]
    )
    facts["effort_hours"] = total(lambda x: x["estimated_effort_hours"])
    return analyses.withColumns(facts)


def categorise(facts: DataFrame) -> DataFrame:
    """Add ``category``: not required is skipped; severe or low-scoring files go first."""
    score = F.col("modernization_score")
    urgent = (F.col("n_critical") > 0) | (F.col("n_high") > 0) | (score < 75)
    return facts.withColumn(
        "category",
        F.when(~F.col("requires_modernization"), "skip")
        .when(urgent, "modernize_high")
        .otherwise("modernize_low"),
    )


def normalise_category(replies: DataFrame, requested: DataFrame | None = None, key: Keys = "file_path") -> DataFrame:
    """Unknown categories become ``skip``; so does every requested file without a reply.

    ``replies`` holds one row per file (see ``grouping.last_write_wins``).
    """
    if requested is not None:
        replies = requested.select(*key_list(key)).join(replies, key_list(key), "left")
    known = F.col("category").isin(*dims.CATEGORIES)
    return replies.withColumn("category", F.when(known, F.col("category")).otherwise("skip"))


def fill_pattern_defaults(df: DataFrame) -> DataFrame:
    """Defaults for a flat pattern table with missing values."""
    defaults = {
        "confidence": F.lit(0.8),
        "estimated_effort_hours": F.lit(1.0),
        "line_numbers": F.array().cast("array<int>"),
        "overall_priority": F.lit("medium"),
        "modernization_score": F.lit(50.0),
        "requires_modernization": F.lit(True),
        "language": F.lit("Unknown"),
    }
    return df.withColumns({c: F.coalesce(F.col(c), d) for c, d in defaults.items() if c in df.columns})


def cap_patterns(patterns: DataFrame, n: int, order: list[Column], key: Keys = "file_path") -> DataFrame:
    """The n most critical patterns of each file, numbered."""
    first = [severity.rank(F.col("severity")).desc(), F.col("confidence").desc()]
    return first_per_group(patterns, key_list(key), [*first, *order], n)


def to_nested(patterns: DataFrame, fields: list[str], key: Keys = "file_path", max_per_row: int | None = None) -> DataFrame:
    """One row per file with its patterns as an array in the order of ``fields``.

    With ``max_per_row``, a file with more patterns has several rows, numbered
    from 0 by ``part``, that continue one another; ``fields`` must then tell the
    patterns of a file apart.
    """
    keys = key_list(key)
    rows = patterns.select(*keys, *[c for c in fields if c not in keys])
    if max_per_row is None:
        numbered = rows.withColumn("part", F.lit(0))
    else:
        numbered = batches(rows, max_per_row, fields, keys).withColumn("part", F.col("batch_id").cast("int"))
    return numbered.groupBy(*keys, "part").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("patterns"))


def to_flat(nested: DataFrame, key: Keys = "file_path") -> DataFrame:
    keys = key_list(key)
    return nested.select(*keys, F.explode("patterns").alias("p")).select(*keys, "p.*")


def nested_to_json(nested: DataFrame, key: Keys = "file_path") -> DataFrame:
    """The stored form: the key and the whole row as JSON text."""
    return nested.select(*key_list(key), F.to_json(F.struct(*nested.columns)).alias("payload"))


def nested_from_json(cached: DataFrame, schema: T.StructType | str) -> DataFrame:
    return with_once(cached, "a", F.from_json("payload", schema)).select("a.*")
