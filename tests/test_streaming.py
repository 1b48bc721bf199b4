"""Streams give what the batch operators give."""

from pyspark.sql import functions as F

from corpusaudit import adapters
from corpusaudit.catalog import QUERIES
from corpusaudit.operators import analysis, cache
from corpusaudit.streaming import audit, progress


def _deliver(spark, tmp_path, *frames, cache=None):
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    for frame in frames:
        frame.write.mode("append").parquet(source)
    stream = spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(source)
    audit.stream_audit(stream, out, check, cache).awaitTermination()
    return out


def test_stream_equals_batch_with_redelivery(spark, sf_dir, tmp_path, rows):
    files = adapters.view(spark, sf_dir, "sources").select("file_path", "content").limit(60)
    halves = [files.filter(F.crc32("file_path") % 2 == i) for i in (0, 1)]
    _deliver(spark, tmp_path, halves[0])
    out = _deliver(spark, tmp_path, halves[0], halves[1], halves[1])
    batch = analysis.analyse_files(files).withColumn("n_patterns", F.size("patterns"))
    columns = ["file_path", "overall_priority", "modernization_score", "n_patterns"]
    assert rows(audit.read_results(spark, out), *columns) == rows(batch, *columns)
    made = audit.read_cache(spark, out)
    assert made.count() == files.distinct().count() and made.select("created_at").distinct().count() > 1


def test_equal_files_of_two_repositories(spark, tmp_path, rows):
    files = spark.createDataFrame([("x", "a.py", "print 'a'"), ("y", "a.py", "print 'a'"), ("y", "b.py", "pass")], "repo string, file_path string, content string")
    out = _deliver(spark, tmp_path, files)
    assert rows(audit.read_results(spark, out), "repo", "file_path") == [("x", "a.py"), ("y", "a.py"), ("y", "b.py")]
    assert audit.read_cache(spark, out).count() == 2


def test_stream_and_batch_share_a_cache(spark, tmp_path, rows):
    files = spark.createDataFrame([(f"f{i}.py", f"print 'x{i}'") for i in range(8)], "file_path string, content string")
    out = _deliver(spark, tmp_path, files.limit(5))
    hits, misses = cache.cached_split(files, audit.read_cache(spark, out))
    assert (hits.count(), misses.count()) == (5, 3)
    made = audit.payloads(misses).withColumn("created_at", F.lit(9))
    merged = cache.merge_cache(audit.read_cache(spark, out), made)
    again = _deliver(spark, tmp_path / "second", files, cache=merged)
    assert audit.read_cache(spark, again).isEmpty()
    assert audit.read_results(spark, again, merged).count() == 8


def test_a_batch_run_again_replaces_itself(spark, tmp_path):
    files = cache.with_cache_key(spark.createDataFrame([("a.py", "x"), ("b.py", "y"), ("c.py", "z")], "file_path string, content string"))
    for batch_id in (0, 1, 1):
        audit.analyse_batch(files.where("file_path < 'c.py'") if batch_id == 0 else files, batch_id, str(tmp_path))
    made = audit.read_cache(spark, str(tmp_path))
    assert sorted(r["created_at"] for r in made.collect()) == [0, 0, 1]  # what batch 0 has analysed is found by key


def test_documents_in_part_files_are_streamed(spark, tmp_path, rows):
    texts = [(i, f"import os\nprint 'text {i}'\n", "en", "web", 25) for i in range(12)]
    documents = spark.createDataFrame(texts, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    documents.coalesce(1).write.parquet(str(tmp_path / "one"))
    (tmp_path / "file").mkdir()
    next((tmp_path / "one").glob("part-*")).rename(tmp_path / "file" / "documents.parquet")
    documents.repartition(3).write.parquet(str(tmp_path / "parts" / "documents.parquet"))
    for name in ("stream_audit", "stream_with_cache"):
        one, parts = (rows(QUERIES[name](spark, str(tmp_path / kind))) for kind in ("file", "parts"))
        assert len(one) == 24 and one == parts


def _state_rows(query):
    return query.lastProgress["stateOperators"][0]["numRowsTotal"] if query.lastProgress else None


def test_keys_leave_the_state_and_stay_known(spark, tmp_path, rows):
    """Contents come again after the watermark has passed them: the state has forgotten them, the cache hasn't."""
    day = lambda d, names: spark.createDataFrame([(n, f"text of {n}", d) for n in names], "file_path string, content string, at string").withColumn("at", F.to_timestamp("at"))
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    sizes = []
    for frame in (day("2024-01-01", [f"a{i}" for i in range(40)]), day("2024-01-05", [f"b{i}" for i in range(5)]), day("2024-01-06", ["c1", "a1", "a2"]), day("2023-12-01", ["late"])):
        frame.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(source)
        running = audit.stream_audit(stream, out, check, delay="1 hour", arrived="at")
        running.awaitTermination()
        sizes.append(_state_rows(running.queries[1]))
    assert sizes[0] >= 40 and max(sizes[1:]) < sizes[0] / 2, sizes
    made = audit.read_cache(spark, out)
    assert made.count() == made.select("cache_key").distinct().count() == 46
    assert rows(audit.unanalysed(spark, out), "file_path") == [("late",)]
    assert audit.read_results(spark, out).count() == 46


def test_a_stored_cache_is_read_in_parts(spark, tmp_path):
    files = cache.with_cache_key(spark.createDataFrame([(f"f{i}.py", f"x{i}") for i in range(600)], "file_path string, content string"))
    made = files.select("cache_key", F.lit("{}").alias("payload"), F.lit(1).cast("bigint").alias("created_at"))
    cache.write_cache(made, str(tmp_path / "cache"))
    stored = spark.read.parquet(str(tmp_path / "cache"))
    few = files.limit(3)
    found = cache.look_up(stored, few)
    assert {r["cache_key"] for r in found.collect()} == {r["cache_key"] for r in few.collect()}
    parts = {r["cache_key"][:2] for r in few.collect()}
    read = {f.split("key_part=")[1][:2] for f in found.inputFiles()} if found.inputFiles() else parts
    assert "PartitionFilters: [key_part" in found._jdf.queryExecution().executedPlan().toString() and parts <= read
    out = _deliver(spark, tmp_path / "s", files.select("file_path", "content").union(spark.createDataFrame([("new.py", "new")])), cache=str(tmp_path / "cache"))
    assert audit.read_cache(spark, out).count() == 1


def _progress(spark, tmp_path, *frames, delay="1 day"):
    """Rows that the stream wrote, and the state's size after each delivery."""
    source, out, sizes = str(tmp_path / "events"), str(tmp_path / "rows"), []
    for frame in frames:
        frame.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(source)
        writer = progress.stream_progress(stream, delay).foreachBatch(lambda batch, batch_id: batch.write.mode("append").parquet(out))
        query = writer.trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "check")).start()
        query.awaitTermination()
        sizes.append(_state_rows(query))
    return spark.read.parquet(out), sizes


def test_progress_stream(spark, sf_dir, tmp_path, rows):
    events = adapters.view(spark, sf_dir, "progress")
    written, _ = _progress(spark, tmp_path, events, delay="10000 days")
    assert rows(progress.latest_of_batches(written)) == rows(progress.latest_progress(events))


def test_ended_runs_leave_the_state(spark, tmp_path, rows):
    def events(day, runs):
        made = spark.createDataFrame([(r, i, f"Phase {1 + i % 5}", None) for r in runs for i in range(3)], "run_id string, seq bigint, phase string, message string")
        return made.withColumn("ts", F.to_timestamp(F.lit(day)))

    frames = [events("2024-01-01", [f"r{i}" for i in range(30)]), events("2024-01-10", ["s1", "s2"]), events("2024-01-20", ["t1"])]
    written, sizes = _progress(spark, tmp_path, *frames)
    assert sizes[0] >= 30 and max(sizes[1:]) < sizes[0] / 2, sizes
    every = frames[0].unionByName(frames[1]).unionByName(frames[2])
    assert rows(progress.latest_of_batches(written)) == rows(progress.latest_progress(every))


def test_phases(spark):
    df = spark.createDataFrame([("Phase 1",), ("Phase 5",), ("Phase 9",)], "p string")
    assert [r[0] for r in df.select(progress.phase_progress(F.col("p"))).collect()] == [0.15, 0.85, 0.5]
