"""Facts about files: names, languages, frameworks, versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusaudit import dims
from corpusaudit.functions import paths, text


def path_parts(files: DataFrame, column: str = "file_path") -> DataFrame:
    path = F.col(column)
    return (
        files.withColumn("file_name", paths.basename(path))
        .withColumn("stem", paths.stem(path))
        .withColumn("extension", paths.suffix(path))
    )


def file_info(files: DataFrame) -> DataFrame:
    """Name, suffix, sizes and whether it is code; sizes are rounded half up."""
    size = F.col("size_bytes") if "size_bytes" in files.columns else F.octet_length("content").cast("bigint")
    named = path_parts(files).withColumn("size_bytes", size)
    return named.withColumn("size_kb", F.round(F.col("size_bytes") / 1024, 2)).withColumn(
        "is_code", F.col("extension").isin(*dims.DISCOVERY_SUFFIXES)
    )


def detect_language(files: DataFrame, scheme: str = "display") -> DataFrame:
    """Language by suffix under one of five schemes, by a broadcast join."""
    table = dims.load_dimension(files.sparkSession, "languages").filter(F.col("scheme") == scheme)
    table = table.select(F.col("extension").alias("lower_suffix"), "language")
    joined = files.withColumn("lower_suffix", F.lower(paths.suffix(F.col("file_path")))).join(
        F.broadcast(table), "lower_suffix", "left"
    )
    default = dims.SCHEME_DEFAULTS.get(scheme)
    return (joined.fillna({"language": default}) if default else joined).drop("lower_suffix")


def language_by_content(c: Column, variant: str = "runner") -> Column:
    """First content rule that holds, most specific first; ``python`` if none does."""
    imports = c.contains("import ") | c.contains("from ")
    java = text.any_of(c, ["public class", "import java."])
    python = c.contains("def ") & imports
    script = text.any_of(c, ["function ", "const ", "let "])
    if variant == "runner":
        typed = text.any_of(c, ["interface ", "type "])
        rules = [("java", java), ("python", python), ("javascript", script), ("typescript", typed)]
    elif variant == "tests":
        rules = [
            ("java", java),
            ("go", text.any_of(c, ["package main", "func main()"])),
            ("python", python),
            ("javascript", script),
            ("csharp", c.contains("namespace ") & c.contains("using ")),
            ("rust", text.any_of(c, ["fn main()", "use std::"])),
            ("php", c.contains("<?php")),
            ("ruby", c.contains("class ") & c.contains("def ") & c.contains("end")),
        ]
    else:
        raise ValueError(f"unknown variant {variant!r}")
    return F.coalesce(*[F.when(rule, F.lit(name)) for name, rule in rules], F.lit("python"))


def detect_language_by_content(files: DataFrame, variant: str = "runner") -> DataFrame:
    """Language by suffix where known, else by content."""
    by_suffix = dims.language_of(paths.suffix(F.col("file_path")), variant)
    return files.withColumn("language", F.coalesce(by_suffix, language_by_content(F.col("content"), variant)))


def detect_framework(files: DataFrame) -> DataFrame:
    """Framework with the most telling marker in the whole text, else null (our own rules)."""
    hits = F.array(
        *[
            F.when(
                F.col("content").contains(marker),
                F.struct(F.lit(conf).alias("confidence"), F.lit(-i).alias("o"), F.lit(name).alias("framework")),
            )
            for i, (name, marker, conf) in enumerate(dims.FRAMEWORK_MARKERS)
        ]
    )
    best = F.array_max(hits)
    return files.withColumn("framework", best["framework"]).withColumn("framework_confidence", best["confidence"])


def assign_test_framework(files: DataFrame, kind: str = "unit") -> DataFrame:
    """Test framework for the ``language`` of a file; pytest where none is listed."""
    table = dims.load_dimension(files.sparkSession, "test_frameworks").filter(F.col("kind") == kind)
    default = "pytest-benchmark" if kind == "performance" else "pytest"
    table = table.select(F.col("language").alias("framework_language"), "framework")
    joined = files.withColumn("framework_language", F.lower("language")).join(
        F.broadcast(table), "framework_language", "left"
    )
    return joined.fillna({"framework": default}).drop("framework_language")


def languages_present(files: DataFrame) -> DataFrame:
    """Languages per repository under the search scheme; python where none is known."""
    language = dims.language_of(paths.suffix(F.col("file_path")), "search")
    # Python stands in only if no file of the repository has a known language.
    sets = files.groupBy("repo").agg(F.collect_set(language).alias("found"))
    found = F.when(F.size("found") == 0, F.array(F.lit("python"))).otherwise(F.col("found"))
    return sets.select("repo", F.explode(found).alias("language"))


def search_queries(files: DataFrame) -> DataFrame:
    """Search queries per repository: the common ones, then those of each language."""
    table = dims.load_dimension(files.sparkSession, "search_queries")
    common = [q for _, _, q in dims.dimension_rows("search_queries")[: len(dims.COMMON_QUERIES)]]
    repos = files.select("repo").distinct()
    shared = repos.select(
        "repo", F.lit(None).cast("string").alias("language"), F.posexplode(F.array(*[F.lit(q) for q in common])).alias("ord", "query")
    )
    specific = languages_present(files).join(F.broadcast(table), "language").select("repo", "language", "ord", "query")
    return shared.unionByName(specific)


def language_breakdown(df: DataFrame) -> DataFrame:
    return df.groupBy("language").agg(F.count(F.lit(1)).alias("files")).orderBy(F.desc("files"), "language")


def primary_language(files: DataFrame, scheme: str = "upload") -> DataFrame:
    """Most frequent language per repository, the first by name of equals, else null."""
    language = dims.language_of(paths.suffix(F.col("file_path")), scheme)
    counts = files.groupBy("repo", language.alias("language")).agg(F.count(F.lit(1)).alias("n"))
    # Among counted languages the smallest (-n, name) wins; an unknown one never does.
    key = F.when(F.col("language").isNotNull(), F.struct((-F.col("n")).alias("m"), F.col("language").alias("name")))
    return counts.groupBy("repo").agg(F.min(key).alias("best")).select(
        "repo", F.col("best.name").alias("primary_language")
    )


def suggest_versions(primary: DataFrame) -> DataFrame:
    """Target versions for each primary language, in order; all of them if unknown."""
    table = dims.load_dimension(primary.sparkSession, "target_versions")
    known = [k for k in dims.target_versions() if k is not None]
    offered = F.when(F.col("primary_language").isin(*known), F.col("primary_language")).otherwise("*")
    table = table.select(F.coalesce("language", F.lit("*")).alias("offer"), "ord", "version")
    return primary.withColumn("offer", offered).join(F.broadcast(table), "offer").drop("offer")


def all_versions(primary: DataFrame) -> DataFrame:
    """Distinct versions offered to any repository, sorted."""
    return suggest_versions(primary).select("version").distinct().orderBy("version")


def cache_key(path: Column, content: Column) -> Column:
    """Content key that is the same in every run."""
    return F.sha2(F.concat(path, F.lit("\0"), content), 256)


def pattern_id(pattern: Column, file_paths: Column) -> Column:
    """MD5 of the pattern name and its sorted files (an array bounded by the search's k)."""
    return F.md5(F.concat_ws(":", pattern, F.array_join(F.sort_array(file_paths), "|")))
