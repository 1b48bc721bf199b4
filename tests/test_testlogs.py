"""Golden cases for test-runner logs."""

import pytest
from pyspark.sql import functions as F

from corpusaudit.operators import testlogs


def parsed(spark, log, expression):
    return spark.createDataFrame([(log,)], "t string").select(expression(F.col("t"))).first()[0]


PYTEST = [
    ("== 3 passed, 1 failed, 2 skipped, 1 error in 0.50s ==", (7, 3, 1, 1, 2)),
    ("= 5 passed in 1s =", (5, 5, 0, 0, 0)),
    ("a PASSED\nb FAILED\nc SKIPPED\nd ERROR\n", (3, 1, 1, 1, 1)),
    ("a PASSED", (0, 0, 0, 0, 0)),
    ("", (0, 0, 0, 0, 0)),
]


@pytest.mark.parametrize("log, expected", PYTEST)
def test_pytest(spark, log, expected):
    assert tuple(parsed(spark, log, testlogs.pytest_counts)) == expected


def test_pytest_simple(spark):
    assert tuple(parsed(spark, "a PASSED b PASSED c FAILED", testlogs.pytest_simple_counts)) == (3, 2, 1, 0, 0)


@pytest.mark.parametrize("log, expected", [("TOTAL    100   20    4   2   80%", 80.0), ("TOTAL 75%", 75.0), ("none", 0.0)])
def test_coverage(spark, log, expected):
    assert parsed(spark, log, testlogs.coverage_py) == expected


def test_surefire(spark):
    log = "Tests run: 10, Failures: 2, Errors: 1, Skipped: 3\nTests run: 99, Failures: 0, Errors: 0, Skipped: 0"
    assert tuple(parsed(spark, log, testlogs.surefire_counts)) == (10, 4, 3, 1, 3)


BUILDS = [
    ("x\nCOMPILATION ERROR\n[ERROR] a", 1, testlogs.COMPILATION_FAILED),
    ("[ERROR] Failed to execute goal\n  [ERROR] second \nBUILD FAILURE", 1, "[ERROR] second"),
    ("BUILD FAILURE", 1, testlogs.BUILD_FAILED),
    ("[INFO] fine", 0, testlogs.NO_TESTS),
    ("[INFO] fine", 1, None),
]


@pytest.mark.parametrize("log, code, expected", BUILDS)
def test_builds(spark, log, code, expected):
    assert parsed(spark, log, lambda c: testlogs.surefire_error(c, F.lit(""), F.lit(code))) == expected


JEST = [
    ("Tests: 5 passed, 5 total", (5, 5, 0, 0, 0)),
    ("Tests: 1 failed, 4 passed, 5 total", (5, 4, 1, 0, 0)),
    ("Tests: 2 skipped, 3 passed, 5 total", (5, 3, 0, 0, 2)),
    ("Tests: 1 todo, 4 passed, 5 total", (5, 4, 0, 0, 0)),
    ("Tests: 0 total", (0, 0, 0, 0, 0)),
    ("Tests: 2 skipped, 5 total", (5, 3, 0, 0, 2)),
]


@pytest.mark.parametrize("log, expected", JEST)
def test_jest(spark, log, expected):
    assert tuple(parsed(spark, log, testlogs.jest_counts)) == expected


def test_jest_suite_failure(spark):
    assert parsed(spark, "Test Suites: 1 failed\nTests: 0 total", testlogs.jest_error) == testlogs.SUITE_FAILED
    assert parsed(spark, "Test Suites: 1 failed\nTests: 1 failed, 1 total", testlogs.jest_error) is None


@pytest.mark.parametrize("log, code, expected", [
    ('npm\n {"numTotalTests": 4, "numPassedTests": 3, "numFailedTests": 1, "success": false}', 0, (4, 3, 1, False)),
    ('{"numTotalTests": ', 0, (1, 1, 0, True)),
    ("no json", 1, (1, 0, 1, False)),
    ('{"numTotalTests": 2, "numPassedTests": 2, "success": true}', 1, (2, 2, 0, True)),
])
def test_jest_json(spark, log, code, expected):
    counts = parsed(spark, log, lambda c: testlogs.jest_json_counts(c, F.lit(code)))
    success = parsed(spark, log, lambda c: testlogs.jest_json_success(c, F.lit(code)))
    assert (*tuple(counts)[:3], success) == expected


def test_jest_coverage(spark):
    assert parsed(spark, "All files | 85.71 | 75 |", testlogs.jest_coverage) == 85.71
    assert parsed(spark, "nothing", testlogs.jest_coverage) == 0.0


def test_one_schema_for_all_languages(spark):
    rows = [("python", "== 2 passed in 1s ==", None, 0, None), ("Java", "BUILD FAILURE", "", 1, "Total 50%"),
            ("typescript", "Tests: 1 passed, 1 total", "", 0, None), ("ruby", "", "", 0, None), ("python", "x" * 20_000, "", 1, None)]
    logs = spark.createDataFrame(rows, "language string, stdout string, stderr string, exit_code int, coverage_html string")
    got = testlogs.normalise_validations(logs).collect()
    assert [r["success"] for r in got] == [True, False, True, False, False]
    assert [r["tests_run"] for r in got] == [2, 0, 1, 0, 0]
    assert got[3]["error"].startswith("Unsupported language: ruby. Supported") and got[3]["execution_mode"] == "unsupported"
    assert len(got[4]["stdout"]) == 20_000 and {r["execution_time"] for r in got} == {0.0}
    clipped = testlogs.normalise_validations(logs.withColumn("execution_time", F.lit(1.5)), clip=10_000).collect()
    assert len(clipped[4]["stdout"]) == 10_000 and {r["execution_time"] for r in clipped} == {1.5}


def test_a_summary_behind_a_long_log_counts(spark):
    assert parsed(spark, "x\n" * 20_000 + "== 1 passed in 1s ==", testlogs.pytest_counts)["tests_run"] == 1


def test_equivalence_sums_before_joining(spark):
    rows = [("a", True, 5), ("b", True, 10), ("b", True, 10), ("c", False, 1), ("d", True, 0)]
    new = [("a", True, 5), ("b", True, 10), ("b", True, 9), ("c", True, 1), ("d", True, 1)]
    schema = "k string, success boolean, tests_passed int"
    out = testlogs.equivalence(spark.createDataFrame(rows, schema), spark.createDataFrame(new, schema), "k")
    got = {r["k"]: (r["equivalence_score"], r["behavioral_equivalence"]) for r in out.collect()}
    assert got == {"a": (1.0, True), "b": (0.95, True), "c": (0.0, False), "d": (1.0, True)}
