"""Runs: requests and retries, validation totals, reports, streams."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import functions as F

from corpusaudit import adapters, dims
from corpusaudit.catalog.audit import _STATS, _SUMMARY
from corpusaudit.catalog.files import _RULES_TESTS
from corpusaudit.catalog.registry import query, quoted, sql_language, sql_stem, v
from corpusaudit.operators import analysis, replies, requests, testlogs
from corpusaudit.operators.cache import with_cache_key
from corpusaudit.plans import reports, statistics
from corpusaudit.session import fresh_folder, stored
from corpusaudit.streaming import audit as stream
from corpusaudit.streaming import progress

_SRC = v("sources")
_DISPLAY = f"coalesce({sql_language('file_path', 'display')}, 'Unknown')"


def _ask(task: str, *parts: str) -> str:
    return " || chr(10) || ".join([quoted(requests.ASKS[task]), *parts])


def _request_sql(task: str, *parts: str, source: str = "") -> str:
    temperature, tokens, shape = requests.TASKS[task]
    piece = "piece::BIGINT AS piece, pieces::BIGINT AS pieces, first_line::BIGINT AS first_line" if source else "1::BIGINT AS piece, 1::BIGINT AS pieces, 1::BIGINT AS first_line"
    return f"""SELECT repo, file_path, {quoted(task)} AS task, {temperature}::DOUBLE AS temperature, {tokens}::BIGINT AS max_tokens, {quoted(shape)}::VARCHAR AS response_schema,
      md5({_ask(task, *parts)}) AS prompt, {piece} FROM {source or _SRC}"""


def _shown(df):
    return df.select(
        "repo", F.col("file_paths")[0].alias("file_path"), "task", "temperature", "max_tokens", "response_schema", F.md5("prompt").alias("prompt"),
        "piece", "pieces", "first_line",
    )


def _cut_sql(n: int) -> str:
    """Pieces of n characters, numbered, with the line that each begins on."""
    return f"""(SELECT * REPLACE (substr(content, (piece - 1) * {n} + 1, {n}) AS content), 1 + length(substr(content, 1, (piece - 1) * {n})) - length(replace(substr(content, 1, (piece - 1) * {n}), chr(10), '')) AS first_line
      FROM (SELECT *, greatest(ceil(length(content) / {n}.0), 1)::BIGINT AS pieces, unnest(range(1, greatest(ceil(length(content) / {n}.0), 1)::BIGINT + 1)) AS piece FROM {_SRC}) w) cut"""


_PART = "'File: ' || file_path || CASE WHEN pieces > 1 THEN ' (part ' || piece || ' of ' || pieces || ')' ELSE '' END"

_FILE, _LANG = "'File: ' || file_path", f"'Language: ' || {_DISPLAY}"
_PATTERN_LIST = "CASE " + _DISPLAY + " " + " ".join(f"WHEN {quoted(k)} THEN {quoted('; '.join(x))}" for k, x in dims.LEGACY_PATTERNS.items()) + " END"


@query(
    "requests_single",
    " UNION ALL ".join(
        [
            _request_sql("language", _FILE, _LANG, "content"),
            _request_sql("analyse", _FILE, _LANG, f"'Patterns: ' || {_PATTERN_LIST}", "content"),
            _request_sql("security", _FILE, "content"),
            _request_sql("refactor", _PART, "content", source=_cut_sql(2000)),
            _request_sql("transform", _FILE, "'Plan: p' || doc_id", "content"),
            _request_sql("hints", _FILE, "content"),
            _request_sql("docstrings", _FILE, "content"),
        ]
    ),
)
def _(read):
    """One request per whole file for every single-file task; for one of them, pieces that together are the file."""
    files = read("sources").select("repo", "file_path", "content", F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("plan"))
    out = None
    for task in ("language", "analyse", "security", "refactor", "transform", "hints", "docstrings"):
        part = _shown(requests.build_requests(files, task, 2000 if task == "refactor" else None))
        out = part if out is None else out.unionByName(part)
    return out


def _framework_sql(kind: str) -> str:
    mapping = dims.PERFORMANCE_FRAMEWORKS if kind == "performance" else dims.TEST_FRAMEWORKS
    whens = " ".join(f"WHEN {quoted(l)} THEN {quoted(f)}" for l, f in mapping.items())
    default = "pytest-benchmark" if kind == "performance" else "pytest"
    return f"CASE {_TESTED} {whens} ELSE {quoted(default)} END"


_TESTED = f"coalesce({sql_language('file_path', 'tests')}, {_RULES_TESTS.replace('(c,', '(content,')})"
_HEAD = [_FILE, f"'Module: ' || {sql_stem('file_path')}", f"'Language: ' || {_TESTED}"]


@query(
    "requests_tests",
    " UNION ALL ".join(
        [
            _request_sql("unit-tests", *_HEAD, f"'Framework: ' || {_framework_sql('unit')}", "content", "(content || 'x')"),
            _request_sql("security-tests", *_HEAD, f"'Framework: ' || {_framework_sql('security')}", "'Vulnerabilities: v'", "content"),
            _request_sql("performance-tests", *_HEAD, f"'Framework: ' || {_framework_sql('performance')}", "content"),
        ]
    ),
)
def _(read):
    files = read("sources").select(
        "repo", "file_path", "content", F.concat("content", F.lit("x")).alias("modernized_code"), F.lit("v").alias("vulnerabilities")
    )
    parts = [_shown(requests.build_requests(files, t)) for t in ("unit-tests", "security-tests", "performance-tests")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_NUMBERED = f"(SELECT *, {_DISPLAY} AS language, (row_number() OVER (PARTITION BY repo ORDER BY file_path) - 1) // {{n}} AS b FROM {_SRC}) x"


@query(
    "requests_classify",
    f"""SELECT min(file_path) AS first_path, count(*) AS files, md5({_ask('classify', "'[' || string_agg('\"' || file_path || '\"', ',' ORDER BY file_path) || ']'")}) AS prompt
    FROM {_NUMBERED.replace('{n}', '25')} GROUP BY repo, b""",
)
def _(read):
    built = requests.build_batch_requests(read("sources").select("repo", "file_path", "content"), "classify")
    return built.select(F.col("file_paths")[0].alias("first_path"), F.size("file_paths").alias("files"), F.md5("prompt").alias("prompt"))


def _batch_sql(n: int) -> str:
    small = f"(SELECT * FROM {_SRC} WHERE length(content) <= {n}) s"
    numbered = f"(SELECT *, {_DISPLAY} AS language, (row_number() OVER (PARTITION BY repo ORDER BY file_path) - 1) // 3 AS b FROM {small}) x"
    body = "string_agg(file_path || chr(10) || language || chr(10) || content, chr(10) || chr(10) ORDER BY file_path)"
    alone = _ask("analyse", "min('File: ' || file_path)", "min('Language: ' || language)", f"min('Patterns: ' || {_PATTERN_LIST})", "min(content)")
    large = _request_sql("analyse", _PART, _LANG, f"'Patterns: ' || {_PATTERN_LIST}", "content", source=f"(SELECT * FROM {_cut_sql(n)} WHERE pieces > 1) l")
    return f"""SELECT repo, min(file_path) AS first_path, count(*)::BIGINT AS files, CASE WHEN count(*) = 1 THEN 'analyse' ELSE 'batch-analyse' END AS task, 1::BIGINT AS piece, 1::BIGINT AS pieces,
        CASE WHEN count(*) > 1 THEN md5({_ask('batch-analyse', body)}) ELSE md5({alone}) END AS prompt FROM {numbered} GROUP BY repo, b
      UNION ALL SELECT repo, file_path, 1::BIGINT, task, piece, pieces, prompt FROM ({large}) y"""


@query("requests_batch_analyse", _batch_sql(6000))
def _(read):
    """Whole files in batches of three; files above 6000 characters alone, in pieces that together are the file."""
    built = requests.build_batch_requests(read("sources").select("repo", "file_path", "content"), "batch-analyse", max_chars=6000)
    return built.select("repo", F.col("file_paths")[0].alias("first_path"), F.size("file_paths").alias("files"), "task", "piece", "pieces", F.md5("prompt").alias("prompt"))


def _group_sql(task: str, n: int | None) -> str:
    cut = _cut_sql(n) if n else f"(SELECT *, 1 AS piece, 1 AS pieces FROM {_SRC}) cut"
    shown = """string_agg(repo || '/' || file_path || CASE WHEN pieces > 1 THEN ' (part ' || piece || ' of ' || pieces || ')' ELSE '' END || chr(10) || content, chr(10) || chr(10) ORDER BY file_path, piece)"""
    return f"""SELECT {quoted(task)} AS task, count(*) AS files, b + 1 AS piece, max(b) OVER (PARTITION BY repo) + 1 AS pieces, md5({_ask(task, "'Group: ' || repo", shown)}) AS prompt
      FROM (SELECT *, (row_number() OVER (PARTITION BY repo ORDER BY file_path, piece) - 1) // 5 AS b FROM {cut}) x GROUP BY repo, b"""


@query("requests_groups", f"{_group_sql('deep-analyse', 1000)} UNION ALL {_group_sql('integration-tests', None)}")
def _(read):
    """All files of each group, five to a request, whole or in pieces of 1000 characters."""
    groups = read("sources").select(F.col("repo").alias("group_name"), "repo", "file_path", "content")
    both = requests.build_group_requests(groups, "deep-analyse", max_chars=1000).unionByName(requests.build_group_requests(groups, "integration-tests"))
    return both.select("task", F.size("file_paths").alias("files"), "piece", "pieces", F.md5("prompt").alias("prompt"))


def _measure(prompts: Sequence[str]) -> list[str]:
    """A stand-in for a model: a reply that only depends on the prompt."""
    return [json.dumps({"language": "Text", "confidence": 0.5, "framework": str(len(p))}) for p in prompts]


@query(
    "batch_infer",
    f"""SELECT file_path, 'Text' AS language, length({_ask('language', _FILE, _LANG, 'content')})::VARCHAR AS framework, NULL::VARCHAR AS error FROM {_SRC}""",
)
def _(read):
    """Requests, replies of a caller's function, and their parsed form."""
    asked = requests.build_requests(read("sources").select("repo", "file_path", "content"), "language")
    answered = requests.batch_infer(asked, _measure).drop("error")
    parsed = replies.parse_replies(answered, "language")
    return (
        asked.select("request_id", F.col("file_paths")[0].alias("file_path"))
        .join(parsed.select("request_id", "reply.language", "reply.framework", "error"), "request_id")
        .drop("request_id")
    )


@query(
    "transform_or_keep",
    f"""SELECT conv_id, turn, CASE WHEN turn % 4 = 1 THEN md5(text) ELSE md5(code) END AS digest FROM conversations JOIN (SELECT conv_id, turn, CASE turn % 4 WHEN 2 THEN 'short' ELSE trim(text, ' ' || chr(10) || chr(9) || chr(13)) END AS code FROM conversations) c USING (conv_id, turn)""",
)
def _(read):
    """New texts from replies; the original where no reply came."""
    key = F.concat_ws("/", "conv_id", "turn").alias("file_path")
    files = read("conversations").select("conv_id", "turn", key, F.col("text").alias("content"))
    answered = read("exchanges").filter(F.col("turn") % 4 != 1).select(key, F.col("reply").alias("response_text"))
    return requests.transform_or_keep(files, answered).select("conv_id", "turn", F.md5("modernized_code").alias("digest"))


@query(
    "route_failures",
    """SELECT request_id, file_path, CASE WHEN n > 1 THEN 'retry single' ELSE 'fallback' END AS action FROM
      (SELECT o_custkey AS request_id, 'f' || o_orderkey AS file_path, count(*) OVER (PARTITION BY o_custkey) AS n, o_orderkey FROM orders) r
    WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A')""",
)
def _(read):
    path = F.concat(F.lit("f"), F.col("o_orderkey").cast("string")).alias("file_path")
    asked = read("orders").select(F.col("o_custkey").alias("request_id"), path, "o_orderkey")
    done = read("lineitem").filter("l_returnflag = 'A'").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    answered = asked.join(done, "o_orderkey")
    return requests.route_failures(asked.drop("o_orderkey"), answered.drop("o_orderkey"))


# -- validations -----------------------------------------------------------------
_VAL = v("validations")
_ROLLUP = f"""SELECT count(*) AS files_validated, sum(tests_run)::BIGINT AS total_tests, sum(tests_passed)::BIGINT AS tests_passed, (sum(tests_run) - sum(tests_passed))::BIGINT AS tests_failed,
  coalesce(round(avg(coverage_percent) FILTER (coverage_percent > 0), 2), 0) AS average_coverage, round(sum(tests_passed) / greatest(sum(tests_run), 1) * 100, 2) AS pass_rate FROM {_VAL}"""


@query("validation_rollup", _ROLLUP)
def _(read):
    return statistics.validation_rollup(read("validations"))


@query(
    "transformations_validated",
    f"""SELECT a.file_path, a.language, coalesce(r.tests_run, 0) AS tests_run, coalesce(r.tests_passed, 0) AS tests_passed FROM {v('analyses').rsplit(' ', 1)[0]} a LEFT JOIN
      (SELECT file_path, sum(tests_run)::BIGINT AS tests_run, sum(tests_passed)::BIGINT AS tests_passed FROM {_VAL} GROUP BY file_path) r USING (file_path)""",
)
def _(read):
    """Files with the sums of their test results; results are reduced before the join."""
    per_file = read("validations").groupBy("file_path").agg(F.sum("tests_run").alias("tests_run"), F.sum("tests_passed").alias("tests_passed"))
    joined = read("analyses").select("file_path", "language").join(per_file, "file_path", "left")
    return joined.fillna(0, ["tests_run", "tests_passed"])


def _results(read, column):
    return read("validations").select("file_path", (F.col("exit_code") == 0).alias("success"), F.col(column).alias("tests_passed"))


@query(
    "equivalence",
    f"""SELECT file_path, round(score, 3) AS equivalence_score, score >= 0.95 AS behavioral_equivalence FROM (SELECT file_path, CASE WHEN NOT ok THEN 0 WHEN a = b THEN 1
      ELSE b / greatest(a, 1) END::DOUBLE AS score FROM (SELECT file_path, max(exit_code) = 0 AS ok, sum(tests_run) AS a, sum(tests_passed) AS b FROM {_VAL} GROUP BY file_path) x) y""",
)
def _(read):
    """Tests passed after a change against all tests of the file before it."""
    return testlogs.equivalence(_results(read, "tests_run"), _results(read, "tests_passed"), "file_path")


_RUN = f"""SELECT (SELECT count(*) FROM documents) AS total_files, (SELECT count(*) FROM {v('transformations')} WHERE starts_with(file_path, 'src')) AS files_modernized,
  sum(tests_run)::BIGINT AS tests_generated, round(sum(tests_passed) / greatest(sum(tests_run), 1) * 100, 2) AS test_pass_rate,
  round(avg(coverage_percent) FILTER (coverage_percent > 0), 2) AS average_coverage FROM {_VAL}"""


def _run_stats(read):
    done = read("transformations").filter(F.col("file_path").startswith("src"))
    return statistics.run_statistics(read("files"), done, read("validations"))


@query("run_statistics", _RUN)
def _(read):
    return _run_stats(read)


@query(
    "change_stats",
    f"""SELECT count(*) AS total_files, sum(length(modernized_code) - length(replace(modernized_code, chr(10), '')))::BIGINT AS lines_added,
      (SELECT round(sum(tests_passed) / sum(tests_run) * 100, 2) FROM {_VAL}) AS pass_rate FROM {v('transformations')}""",
)
def _(read):
    return statistics.change_stats(read("transformations"), read("validations"))


@query(
    "run_report",
    f"""WITH run AS ({_RUN}), st AS ({_STATS}), ro AS ({_ROLLUP})
    SELECT 'statistics' AS section, 0::BIGINT AS ord, 'Total Files' AS label, total_files::DOUBLE AS value FROM run UNION ALL SELECT 'statistics', 1, 'Files Modernized', files_modernized FROM run
    UNION ALL SELECT 'statistics', 2, 'Tests Generated', tests_generated FROM run UNION ALL SELECT 'statistics', 3, 'Test Pass Rate', test_pass_rate FROM run
    UNION ALL SELECT 'statistics', 4, 'Average Coverage', average_coverage FROM run WHERE average_coverage <> 0
    UNION ALL SELECT 'patterns', 0, 'Patterns Detected', patterns_detected FROM st UNION ALL SELECT 'patterns', 1, 'Average Modernization Score', average_modernization_score FROM st
    UNION ALL SELECT 'patterns', 2, 'Total Estimated Effort', total_estimated_effort_hours FROM st
    UNION ALL SELECT 'severities', o, upper(s), n FROM (SELECT unnest([0, 1, 2, 3, 4]) AS o, unnest(['critical', 'high', 'medium', 'low', 'info']) AS s, unnest([critical, high, medium, low, info]) AS n FROM st) WHERE n > 0
    UNION ALL SELECT 'classification', o, s, n FROM (SELECT unnest([0, 1, 2]) AS o, unnest(['modernize_high', 'modernize_low', 'skip']) AS s, unnest([modernize_high, modernize_low, skip]) AS n FROM st)
    UNION ALL SELECT 'validation', o, s, n FROM (SELECT unnest([0, 1, 2, 3, 4, 5]) AS o, unnest(['files_validated', 'total_tests', 'tests_passed', 'tests_failed', 'average_coverage', 'pass_rate']) AS s,
       unnest([files_validated, total_tests, tests_passed, tests_failed, average_coverage, pass_rate]) AS n FROM ro)""",
)
def _(read):
    facts = analysis.categorise(analysis.with_facts(read("analyses"), read("patterns")))
    return reports.run_report(
        _run_stats(read),
        statistics.analysis_statistics(facts),
        statistics.validation_rollup(read("validations")),
    )


@query(
    "change_summary",
    f"""WITH run AS ({_RUN}) SELECT 0::BIGINT AS ord, 'Automated migration to Python 3.14' AS line UNION ALL SELECT 1, 'Files Modernized: ' || files_modernized || ' / ' || total_files FROM run
    UNION ALL SELECT 2, 'Tests Generated: ' || tests_generated FROM run UNION ALL SELECT 3, 'Test Pass Rate: ' || printf('%.1f', test_pass_rate) || '%' FROM run
    UNION ALL SELECT 4, 'Code Coverage: ' || printf('%.1f', average_coverage) || '%' FROM run WHERE average_coverage > 0""",
)
def _(read):
    return reports.change_summary(_run_stats(read), "Python 3.14")


@query(
    "file_list",
    f"""SELECT rn AS ord, rn || '. `' || file_path || '`' AS line FROM (SELECT file_path, row_number() OVER (ORDER BY file_path) AS rn FROM {v('files')}) x WHERE rn <= 50
    UNION ALL SELECT 51, '... and ' || (count(*) - 50) || ' more files' FROM {v('files')} HAVING count(*) > 50""",
)
def _(read):
    return reports.file_list(read("files"))


def _errors(read):
    parsed = replies.parse_replies(read("replies"), "patterns", strict=False)
    parse = replies.error_rows(parsed).select(F.lit("parse").alias("phase"), F.col("request_id").alias("item"), "error")
    runs = testlogs.normalise_validations(read("logs").withColumn("stderr", F.lit("")))
    failed = runs.filter(F.col("error").isNotNull()).select(
        F.lit("validation").alias("phase"), F.concat_ws("/", "file_id", "run_id").alias("item"), "error"
    )
    return reports.error_log(parse, failed)


@query(
    "error_log",
    f"""SELECT 'parse' AS phase, request_id::VARCHAR AS item, CASE request_id % 5 WHEN 2 THEN 'bad pattern' WHEN 3 THEN 'empty reply' ELSE 'malformed JSON' END AS error
      FROM {v('replies')} WHERE request_id % 5 >= 2
    UNION ALL SELECT 'validation', file_id || '/' || run_id, CASE WHEN language = 'ruby' THEN 'Unsupported language: ruby{". " + testlogs.UNSUPPORTED}'
      WHEN language = 'java' AND contains(stdout, 'COMPILATION ERROR') THEN 'Java compilation error'
      WHEN language = 'java' AND contains(stdout, 'BUILD FAILURE') THEN regexp_extract(stdout, '(?m)^.ERROR. missing.*$')
      WHEN language = 'java' THEN {quoted(testlogs.NO_TESTS)} ELSE {quoted(testlogs.SUITE_FAILED)} END
      FROM {v('logs')} WHERE language = 'ruby' OR (language = 'java' AND (NOT contains(stdout, 'Tests run') AND NOT (contains(stdout, 'SUCCESS') AND exit_code = 1)))
        OR (language IN ('javascript', 'typescript') AND contains(stdout, 'Test Suites'))""",
)
def _(read):
    return _errors(read)


@query(
    "shown_errors",
    f"""SELECT 'parse' AS phase, item, rn AS error_no FROM (SELECT request_id::VARCHAR AS item, row_number() OVER (ORDER BY request_id::VARCHAR) AS rn FROM {v('replies')} WHERE request_id % 5 >= 2) x WHERE rn <= 5""",
)
def _(read):
    parsed = replies.parse_replies(read("replies"), "patterns", strict=False)
    parse = replies.error_rows(parsed).select(F.lit("parse").alias("phase"), F.col("request_id").alias("item"), "error")
    return reports.shown_errors(reports.error_log(parse)).select("phase", "item", "error_no")


# -- streams ---------------------------------------------------------------------
def _stream(read, folder, cache=None):
    """The files of two repositories that hold the same paths, as a stream.

    The documents are one file or a folder of part files. The path is a pattern
    that fits it alone: a stream can read a file that a pattern names, but not
    one that is its base path.
    """
    spark = read.spark
    arriving = spark.readStream.schema(read("documents").schema).parquet(f"{read.sf_dir}/documents.parque[t]")
    sources = spark.sql(adapters.VIEWS["sources"], documents=arriving).select("file_path", "content")
    files = sources.withColumn("repo", F.explode(F.array(F.lit("left"), F.lit("right"))))
    stream.stream_audit(files, folder + "/results", folder + "/progress", cache).awaitTermination()


@query(
    "stream_audit",
    f"""SELECT repo, file_path, overall_priority, modernization_score, requires_modernization, n_patterns FROM {_SUMMARY}, (VALUES ('left'), ('right')) r(repo)""",
)
def _(read):
    """The documents as a stream of files; results equal those of the batch audit, in each repository."""
    folder = fresh_folder(read.spark, "stream-audit")
    _stream(read, folder)
    return stream.read_results(read.spark, folder + "/results").drop("cache_key")


@query(
    "stream_with_cache",
    f"""SELECT repo, file_path, CASE WHEN doc_id % 2 = 0 THEN 'known' ELSE overall_priority END AS overall_priority, doc_id % 2 = 1 AS analysed
    FROM (SELECT file_path, overall_priority, doc_id FROM {_SUMMARY} JOIN (SELECT file_path, doc_id FROM {_SRC}) d USING (file_path)) s, (VALUES ('left'), ('right')) r(repo)""",
)
def _(read):
    """The same stream with a cache that holds every second file: those aren't analysed again."""
    spark = read.spark
    folder = fresh_folder(spark, "stream-cache")
    files = read("sources").filter("doc_id % 2 = 0").select("file_path", "content")
    payload = F.to_json(F.struct(F.array().cast("array<string>").alias("patterns"), F.lit("known").alias("overall_priority")))
    cache = stored(with_cache_key(files).select("cache_key", payload.alias("payload"), F.lit(0).alias("created_at")), "cache")
    _stream(read, folder, cache)
    made = stream.read_cache(spark, folder + "/results").select("cache_key", F.lit(True).alias("made"))
    results = stream.read_results(spark, folder + "/results", cache).join(made, "cache_key", "left")
    return results.select("repo", "file_path", "overall_priority", F.col("made").isNotNull().alias("analysed"))


@query(
    "latest_progress",
    f"""SELECT run_id, phase, message, CASE phase WHEN 'Phase 1' THEN 0.15 WHEN 'Phase 2' THEN 0.30 WHEN 'Phase 3' THEN 0.45 WHEN 'Phase 4' THEN 0.65 WHEN 'Phase 5' THEN 0.85 ELSE 0.5 END::DOUBLE AS progress, events
    FROM (SELECT run_id, arg_max(phase, (ts, seq)) AS phase, arg_max(message, (ts, seq)) AS message, count(*) AS events FROM {v('progress')} GROUP BY run_id) x""",
)
def _(read):
    return progress.latest_progress(read("progress"))


@query(
    "stream_progress",
    f"""SELECT run_id, phase, message, CASE phase WHEN 'Phase 1' THEN 0.15 WHEN 'Phase 2' THEN 0.30 WHEN 'Phase 3' THEN 0.45 WHEN 'Phase 4' THEN 0.65 WHEN 'Phase 5' THEN 0.85 ELSE 0.5 END::DOUBLE AS progress, events
    FROM (SELECT run_id, arg_max(phase, (ts, seq)) AS phase, arg_max(message, (ts, seq)) AS message, count(*) AS events FROM {v('progress')} GROUP BY run_id) x""",
)
def _(read):
    """The events as a stream: what it wrote last of each run is what a batch gives."""
    folder = fresh_folder(read.spark, "stream-progress")
    events = read("progress")
    events.write.parquet(f"{folder}/events")
    writer = progress.stream_progress(read.spark.readStream.schema(events.schema).parquet(f"{folder}/events"), "10000 days")
    writer = writer.foreachBatch(lambda batch, batch_id: batch.write.mode("overwrite").parquet(f"{folder}/rows/batch_id={batch_id}"))
    writer.trigger(availableNow=True).option("checkpointLocation", f"{folder}/state").start().awaitTermination()
    return progress.latest_of_batches(read.spark.read.parquet(f"{folder}/rows"))
