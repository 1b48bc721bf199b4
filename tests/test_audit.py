"""Analyses, plans, replies, requests, caches and reports."""

import pytest
from pyspark.sql import functions as F

from corpusaudit.operators import analysis, cache, replies, requests, rules
from corpusaudit.plans import ranking, reports, statistics

CATEGORIES = [
    (False, 1, 1, 10.0, "skip"), (True, 1, 0, 90.0, "modernize_high"), (True, 0, 0, 49.9, "modernize_high"),
    (True, 0, 1, 90.0, "modernize_high"), (True, 0, 0, 74.9, "modernize_high"), (True, 0, 0, 75.0, "modernize_low"),
]


def test_categories(spark):
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(CATEGORIES)],
                               "i int, requires_modernization boolean, n_critical int, n_high int, modernization_score double, expected string")
    assert analysis.categorise(df).filter("category != expected").isEmpty()


SOURCE = 'import MySQLdb\npassword = "hunter22"\nprint "x"\nprint "y"\ndef f(a):\n    pass\n'


def test_detection_lines(spark):
    files = spark.createDataFrame([("r", "a.py", SOURCE), ("r", "b.md", SOURCE), ("r", "c.py", "try:\n    pass\n")],
                                  "repo string, file_path string, content string")
    found = {(r["file_path"], r["pattern_type"]): r["line_numbers"] for r in rules.detect_patterns(files).collect()}
    assert found[("a.py", "Python 2 syntax (print statements, old-style classes)")] == [3, 4]
    assert found[("a.py", "Hardcoded credentials")] == [2]
    assert found[("a.py", "Missing error handling")] == []
    assert not any(f in ("b.md", "c.py") for f, _ in found)


def test_every_rule_names_a_listed_pattern():
    from corpusaudit import dims

    for rule in rules.RULES:
        assert rule.pattern_type in dims.LEGACY_PATTERNS[rule.language], rule
        assert rule.severity in dims.SEVERITIES and rule.kind in ("match", "absent")
    assert {r.language for r in rules.RULES} == set(dims.LEGACY_PATTERNS)


@pytest.mark.parametrize("rule", rules.RULES, ids=lambda r: f"{r.language}-{r.pattern_type}")
def test_rules_compile(rule):
    import re

    re.compile(rule.regex)


def test_base_language(spark):
    df = spark.createDataFrame([("a.jsx",), ("b.js",)], "file_path string")
    assert {r["file_path"] for r in rules.rules_for(df).collect()} == {"b.js"}
    assert {r["file_path"] for r in rules.rules_for(df, base_language=True).collect()} == {"a.jsx", "b.js"}


def test_nested_and_flat_paths_agree(spark, sf_dir, rows):
    from corpusaudit import adapters

    files = adapters.view(spark, sf_dir, "sources").select("repo", "file_path", "content")
    nested = analysis.with_facts(analysis.analyse_files(files))
    flat = rules.detect_patterns(files)
    summary = analysis.summarise_file(files.select("repo", "file_path"), flat, ["repo", "file_path"])
    columns = ["file_path", "overall_priority", "modernization_score", "requires_modernization", "n_patterns"]
    assert rows(nested, *columns) == rows(summary, *columns)
    stats = statistics.analysis_statistics(analysis.categorise(nested)).first()
    assert stats["modernize_high"] + stats["modernize_low"] + stats["skip"] == stats["total_files"]


def test_plan_keeps_first_of_equal_severity(spark):
    patterns = spark.createDataFrame(
        [("f", "A", "low", 1, 0.5, 1.0), ("f", "B", "high", 2, 0.6, 2.0), ("f", "A", "high", 4, 0.7, 3.0), ("f", "A", "high", 3, 0.8, 4.0)],
        "file_path string, pattern_type string, severity string, pos int, confidence double, estimated_effort_hours double")
    analyses = spark.createDataFrame([("f", "Python")], "file_path string, language string")
    for parts in (1, 4):
        plan = ranking.transformation_plan(analyses, patterns.repartition(parts), ["pos"]).first()
        assert [(s["pattern_type"], s["severity"], s["confidence"]) for s in plan["steps"]] == [("A", "high", 0.8), ("B", "high", 0.6)]
        assert plan["estimated_effort_hours"] == 6.0 and plan["pattern"] == "Python modernization"


def test_same_path_in_two_repositories(spark):
    key = ["repo", "file_path"]
    analyses = spark.createDataFrame([("a", "x.py"), ("b", "x.py")], "repo string, file_path string")
    patterns = spark.createDataFrame([("a", "x.py", "high", 0.5, 1.0)] * 2,
                                     "repo string, file_path string, severity string, confidence double, estimated_effort_hours double")
    facts = {r["repo"]: r["n_patterns"] for r in analysis.with_facts(analyses, patterns, key).collect()}
    assert facts == {"a": 2, "b": 0}


GOOD = '{"patterns": [{"pattern_type": "t", "severity": "low", "description": "d", "recommendation": "r"}]}'


@pytest.mark.parametrize("text, error", [
    (GOOD, None), ("", "empty reply"), (None, "empty reply"), ("{", "malformed JSON"),
    (GOOD.replace("low", "urgent"), "bad pattern"), (GOOD.replace('"description": "d", ', ""), "bad pattern"),
    ('{"patterns": [], "overall_priority": "soon"}', "value outside enum"), ("{}", "missing field"),
    ('{"patterns": []}', None),
])
def test_replies(spark, text, error):
    df = spark.createDataFrame([("1", text)], "request_id string, response_text string")
    row = replies.analyses_from_replies(df).first()
    assert row["error"] == error
    if error:
        assert (row["patterns"], row["overall_priority"], row["modernization_score"], row["requires_modernization"]) == ([], "info", 100.0, False)
    elif text == GOOD:
        p = row["patterns"][0]
        assert (p["confidence"], p["estimated_effort_hours"], p["line_numbers"]) == (0.8, 1.0, [])
        assert (row["overall_priority"], row["modernization_score"], row["requires_modernization"]) == ("medium", 50.0, True)


def test_required_fields(spark):
    whole = ('{"patterns": [{"pattern_type": "p", "severity": "low", "line_numbers": [], "confidence": 1, "description": "d", "recommendation": "r", '
             '"estimated_effort_hours": 1}], "modernization_score": 1, "requires_modernization": true, "overall_priority": "low"}')
    file = whole[:-1] + ', "file_path": "f", "language": "Go", "framework": null}'
    texts = [whole, whole.replace('"confidence": 1, ', ""), whole.replace('"modernization_score": 1, ', ""), "{}"]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "request_id string, response_text string")
    got = {r["request_id"]: r["error"] for r in replies.parse_replies(df, "patterns").collect()}
    assert got == {"0": None, "1": "missing field", "2": "missing field", "3": "missing field"}
    batches = ['{"files": [%s]}' % file, '{"files": [%s]}' % file.replace('"file_path": "f", ', ""), '{"files": [{"file_path": "f"}]}', "{}"]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(batches)], "request_id string, response_text string")
    got = {r["request_id"]: r["error"] for r in replies.parse_replies(df, "batch").collect()}
    assert got == {"0": None, "1": "missing field", "2": "missing field", "3": "missing field"}


def test_pieces_cover_the_text_and_replies_join(spark):
    text = "".join(f"line {i}\n" for i in range(50))
    files = spark.createDataFrame([("r1", "a.py", text), ("r2", "a.py", text), ("r1", "b.py", ""), ("r1", "c.py", None)], "repo string, file_path string, content string")
    asked = requests.build_requests(files, "security", max_chars=37).cache()
    assert asked.select("request_id").distinct().count() == asked.count()
    rows = asked.filter("repo = 'r1' AND file_paths[0] = 'a.py'").orderBy("piece").collect()
    shown = [r["prompt"].split("\n", 2)[2] for r in rows]
    assert "".join(shown) == text and [r["pieces"] for r in rows] == [len(rows)] * len(rows)
    assert [r["first_line"] for r in rows] == [1 + "".join(shown[:i]).count("\n") for i in range(len(rows))]
    found = asked.select("request_id", F.expr("array(named_struct('pattern_type', concat('p', piece), 'line_numbers', array(1)))").alias("patterns"),
                         F.when(F.col("piece") == 2, "high").otherwise("low").alias("overall_priority"),
                         F.col("piece").cast("double").alias("modernization_score"), (F.col("piece") == 3).alias("requires_modernization"))
    merged = {(r["repo"], r["file_path"]): r for r in requests.merge_pieces(asked, found).collect()}
    assert len(merged) == 4
    one = merged["r2", "a.py"]
    assert (one["overall_priority"], one["modernization_score"], one["requires_modernization"]) == ("high", 1.0, True)
    assert [p["line_numbers"] for p in one["patterns"]] == [[r["first_line"]] for r in rows]


def test_groups_and_batches_show_every_file(spark):
    files = spark.createDataFrame([("g", "r", f"f{i:02}.py", "x" * (i * 10)) for i in range(12)], "group_name string, repo string, file_path string, content string")
    asked = requests.build_group_requests(files, "deep-analyse", max_chars=60).collect()
    assert sum(len(r["file_paths"]) for r in asked) == sum(max(1, -(-i * 10 // 60)) for i in range(12))
    assert sum(r["prompt"].count("x") for r in asked) >= sum(i * 10 for i in range(12))
    batches = requests.build_batch_requests(files, "batch-analyse", max_chars=60).collect()
    assert {p for r in batches for p in r["file_paths"]} == {f"f{i:02}.py" for i in range(12)}
    assert sum(r["prompt"].count("x") for r in batches) >= sum(i * 10 for i in range(12))


def test_equal_files_of_several_repositories_have_their_own_ids(spark):
    files = spark.createDataFrame([(f"r{i}", "setup.py", "same") for i in range(10)], "repo string, file_path string, content string")
    asked = requests.build_requests(files, "refactor")
    assert asked.select("request_id").distinct().count() == 10
    assert asked.join(asked.select("request_id"), "request_id").count() == 10


def test_one_bad_prompt_is_one_error_row(spark, tmp_path):
    calls = str(tmp_path / "calls")

    def predict(prompts):
        with open(calls, "a") as log:
            log.write(f"{len(prompts)}\n")
        if any("bad" in p for p in prompts):
            raise RuntimeError("refused")
        return [p.upper() for p in prompts]

    df = spark.createDataFrame([(str(i), "bad" if i == 333 else f"ok {i}") for i in range(1000)], "request_id string, prompt string")
    out = requests.batch_infer(df.coalesce(1), predict, 8).collect()
    assert [(r["request_id"], r["error"]) for r in out if r["error"]] == [("333", "refused")]
    assert {r["request_id"]: r["response_text"] for r in out} == {str(i): None if i == 333 else f"OK {i}" for i in range(1000)}
    assert len(open(calls).readlines()) == 125 + 6


def test_failing_batches_stay_apart(spark):
    def predict(prompts):
        if any("bad" in p for p in prompts):
            raise RuntimeError("refused")
        return [p.upper() for p in prompts]

    df = spark.createDataFrame([(str(i), "bad" if i == 3 else "ok") for i in range(6)], "request_id string, prompt string")
    out = {r["request_id"]: (r["response_text"], r["error"]) for r in requests.batch_infer(df.coalesce(1), predict, 2).collect()}
    assert [k for k, v in out.items() if v[1]] == ["3"] and out["0"] == out["2"] == ("OK", None)


def test_routing(spark, rows):
    asked = spark.createDataFrame([("r1", "a"), ("r1", "b"), ("r2", "c"), ("r3", "d")], "request_id string, file_path string")
    answered = spark.createDataFrame([("r1", "a"), ("r3", "d")], "request_id string, file_path string")
    assert rows(requests.route_failures(asked, answered)) == [("r1", "b", "retry single"), ("r2", "c", "fallback")]


def test_hits_and_misses_split_the_input(spark, sf_dir):
    from corpusaudit import adapters

    files = adapters.view(spark, sf_dir, "files").select("file_path", "content")
    stored = cache.with_cache_key(files.filter(F.length("content") % 2 == 0)).select(
        "cache_key", F.lit("{}").alias("payload"), F.current_timestamp().alias("created_at"))
    hits, misses = cache.cached_split(files, stored.unionByName(stored))
    a, b = hits.select("file_path"), misses.select("file_path")
    assert a.intersect(b).isEmpty() and a.unionByName(b).exceptAll(files.select("file_path")).isEmpty()
    assert a.count() + b.count() == files.count()


def test_audit_bundle(spark, sf_dir):
    from corpusaudit import adapters

    files = adapters.view(spark, sf_dir, "sources").select("repo", "file_path", "content")
    results = reports.audit(files)
    assert results["statistics"].first()["total_files"] == files.count()
    plans = results["plans"]
    assert plans.count() == results["analyses"].filter("requires_modernization").count()
    assert {r["section"] for r in results["report"].collect()} == {"summary", "languages", "severities", "top files"}


def test_empty_inputs(spark, rows):
    none = spark.createDataFrame([], "file_path string, tests_run int, tests_passed int, coverage_percent double")
    assert statistics.validation_rollup(none).first().asDict() == {
        "files_validated": 0, "total_tests": 0, "tests_passed": 0, "tests_failed": 0, "average_coverage": 0.0, "pass_rate": 0.0}
    done = spark.createDataFrame([], "file_path string, modernized_code string")
    stats = statistics.run_statistics(done, done, none)
    assert stats.first()["average_coverage"] == 0.0
    assert statistics.change_stats(done, none).first()["pass_rate"] == 0.0
    lines = [r["line"] for r in reports.change_summary(stats, "Java 25").orderBy("ord").collect()]
    assert len(lines) == 4 and lines[3] == "Test Pass Rate: 0.0%"


def test_file_list(spark):
    df = spark.range(52).select(F.concat(F.lit("f"), F.lpad(F.col("id").cast("string"), 2, "0")).alias("file_path"))
    lines = [r["line"] for r in reports.file_list(df).orderBy("ord").collect()]
    assert lines[0] == "1. `f00`" and lines[-1] == "... and 2 more files" and len(lines) == 51
    assert reports.file_list(df.limit(3)).count() == 3
