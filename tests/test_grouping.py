"""Numbering, batching and nesting with large groups and any partitioning."""

import pytest
from pyspark.sql import functions as F

from corpusaudit.operators import analysis, grouping, requests
from corpusaudit.plans import ranking
from corpusaudit.sources import outputs


@pytest.fixture
def skewed(spark):
    """600 rows, a third of them in one group, in no order and many partitions."""
    ids = spark.range(600).withColumn("repo", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("r"), F.col("id") % 40)))
    return ids.withColumn("file_path", F.concat(F.lit("f"), F.lpad(F.col("id").cast("string"), 4, "0"))).orderBy(F.rand(1)).repartition(17)


@pytest.mark.parametrize("limit", [1, 7, 50, 10_000])
def test_row_numbers_do_not_depend_on_ranges(skewed, limit, rows):
    plain = grouping.row_numbers(skewed, ["repo"], ["file_path"])
    ranged = grouping.row_numbers(skewed, ["repo"], ["file_path"], rows_per_task=limit)
    assert rows(plain, "id", "rn") == rows(ranged, "id", "rn")


def test_hot_group_is_split(skewed):
    key = F.struct("repo", "file_path")
    cuts, n = grouping._cut_points(skewed, key, 600, 20)
    assert n == 30
    ranges = skewed.select("repo", grouping._range_of(key, cuts, n).alias("r"), F.size(F.filter(cuts, lambda c: c <= key)).alias("all"))
    assert ranges.filter("r != all").isEmpty()
    sizes = ranges.groupBy("repo", "r").count()
    assert sizes.agg(F.max("count")).first()[0] <= 60


@pytest.mark.parametrize("kind", ["timestamp", "double", "string"])
def test_numbers_over_other_types(spark, kind, rows):
    value = {"timestamp": F.timestamp_seconds(F.col("id") * 37 % 1000), "double": F.rand(3), "string": F.concat(F.lit("é\"\\"), F.col("id"))}[kind]
    df = spark.range(300).withColumn("k", value)
    plain = grouping.row_numbers(df, [], ["k", "id"])
    assert rows(plain, "id", "rn") == rows(grouping.row_numbers(df, [], ["k", "id"], rows_per_task=40), "id", "rn")


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_batches_cover_rows_once(skewed, parts, rows):
    done = outputs.commit_batches(skewed.repartition(parts), 10, rows_per_task=30)
    sizes = done.groupBy("repo", "batch").count().collect()
    by_repo = {}
    for r in sizes:
        by_repo.setdefault(r["repo"], {})[r["batch"]] = r["count"]
    for batches in by_repo.values():
        last = max(batches)
        assert sorted(batches) == list(range(1, last + 1))
        assert all(n == 10 for b, n in batches.items() if b < last)
    assert done.count() == 600


def test_nesting_splits_oversized_files(skewed, rows):
    patterns = skewed.withColumn("file_path", F.col("repo")).withColumn("severity", F.lit("low"))
    nested = analysis.to_nested(patterns, ["id", "severity"], max_per_row=50)
    sizes = nested.groupBy("file_path").agg(F.count("*").alias("parts"), F.sum(F.size("patterns")).alias("n"))
    hot = sizes.filter("file_path = 'hot'").first()
    assert (hot["parts"], hot["n"]) == (4, 200)
    assert sizes.filter("file_path != 'hot' and parts > 1").isEmpty()
    back = analysis.to_flat(nested)
    assert rows(back, "file_path", "id") == rows(patterns, "file_path", "id")


def test_first_per_group_limits_before_the_shuffle(skewed):
    first = grouping.first_per_group(skewed, ["repo"], [F.asc("file_path")], 3)
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert first.filter("repo = 'hot'").count() == 3


def test_last_write_wins(spark, rows):
    a = spark.createDataFrame([("x", 1, 1), ("y", 1, 1)], "k string, v int, b int")
    b = spark.createDataFrame([("x", 2, 2)], "k string, v int, b int")
    assert rows(grouping.last_write_wins([a, b], "k", "b"), "k", "v") == [("x", 2), ("y", 1)]


def test_batch_requests_of_a_hot_repository(spark, skewed):
    files = skewed.withColumn("content", F.repeat(F.lit("x"), 7000))
    built = requests.build_batch_requests(files, "batch-analyse", rows_per_task=25)
    counts = built.groupBy("task").agg(F.sum(F.size("file_paths")).alias("files")).collect()
    assert sum(r["files"] for r in counts) == 600
    assert built.filter(F.size("file_paths") > 3).isEmpty()
    lengths = {r["n"] for r in built.filter("task = 'analyse'").select(F.length("prompt").alias("n")).collect()}
    assert all(n > 4000 for n in lengths)


def test_priorities_tie_by_path(spark):
    facts = spark.createDataFrame([(f"f{i}", "low", 0.0, 50.0) for i in (3, 1, 2)],
                                  "file_path string, overall_priority string, pattern_score double, modernization_score double")
    for parts in (1, 3):
        top = ranking.top_files(facts.repartition(parts), 2).collect()
        assert [(r["file_path"], r["rank"]) for r in top] == [("f1", 1), ("f2", 2)]
