"""Test-runner logs as one result schema.

Parsers are column expressions over the whole log, so a table of logs of all
languages is read once. Logs are kept whole unless the caller clips the stored copy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusaudit.functions.once import let, with_once
from corpusaudit.functions.text import any_of, count_of, head, lines, strip
from corpusaudit.operators.grouping import Keys, key_list

# Formats of the runners' output.
PYTEST_SUMMARY = r"=+\s*(.*?)\s+in\s+[\d.]+s\s*=+"
COVERAGE_FULL = r"TOTAL\s+\d+\s+\d+\s+\d+\s+\d+\s+(\d+)%"
COVERAGE_SHORT = r"TOTAL.*?(\d+)%"
SUREFIRE = r"Tests run: (\d+),\s*Failures: (\d+),\s*Errors: (\d+),\s*Skipped: (\d+)"
JACOCO = r"Total.*?(\d+)%"
JEST_TESTS = r"Tests:\s+(.+)"
JEST_SUITES = r"Test Suites:\s+(\d+)\s+failed"
JEST_COVERAGE = r"All files\s*\|\s*([\d.]+)"
NO_TESTS = "No tests detected by Maven Surefire (missing @Test annotations?)"
BUILD_FAILED = "Maven build failed"
COMPILATION_FAILED = "Java compilation error"
SUITE_FAILED = "Test suite failed to run (compilation/syntax error)"
RUNNERS = ["python", "java", "javascript", "typescript"]
UNSUPPORTED = f"Supported languages: {', '.join(RUNNERS)}"

PYTEST_WORDS = ["passed", "failed", "error", "skipped"]
JEST_WORDS = ["total", "passed", "failed", "skipped"]
COUNTERS = ["tests_run", "tests_passed", "tests_failed", "tests_errors", "tests_skipped"]


def _as_int(digits: Column) -> Column:
    """Captured digits as a number, null if there are none or too many.

    Casting an empty text raises and catches an error per row, so it is not tried.
    """
    return let(digits, lambda d: F.when(F.length(d).between(1, 18), d.cast("bigint")))


def _int(c: Column, regex: str, group: int = 1) -> Column:
    """A captured number, null where the expression does not match."""
    return _as_int(F.regexp_extract(c, "(?d)" + regex, group))


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0).cast("bigint"))


def _counts(run: Column, passed: Column, failed: Column, errors: Column | None = None, skipped: Column | None = None) -> Column:
    zero = F.lit(0)
    values = [run, passed, failed, zero if errors is None else errors, zero if skipped is None else skipped]
    return F.struct(*[v.cast("bigint").alias(n) for n, v in zip(COUNTERS, values)])


def _words_before(line: Column, words: list[str]) -> list[Column]:
    """The numbers that stand before each word in a short summary, 0 if absent."""
    return [_zero(_int(line, rf"(\d+)\s+{word}")).alias(word) for word in words]


def pytest_counts(log: Column) -> Column:
    """Counts of the summary line; without one, of the per-test lines (skipped not run)."""

    def of_summary(c: Column) -> Column:
        run = c["passed"] + c["failed"] + c["error"] + c["skipped"]
        return F.when(run > 0, _counts(run, c["passed"], c["failed"], c["error"], c["skipped"])).otherwise(
            let(F.struct(*[count_of(log, f" {w.upper()}\n").alias(w) for w in PYTEST_WORDS]), of_lines)
        )

    def of_lines(c: Column) -> Column:
        return _counts(c["passed"] + c["failed"] + c["error"], c["passed"], c["failed"], c["error"], c["skipped"])

    summary = F.regexp_extract(log, "(?d)" + PYTEST_SUMMARY, 1)
    return let(summary, lambda line: let(F.struct(*_words_before(line, PYTEST_WORDS)), of_summary))


def pytest_simple_counts(log: Column) -> Column:
    """Counts of the result words alone."""
    found = F.struct(*[count_of(log, f" {w.upper()}").alias(w) for w in PYTEST_WORDS[:3]])
    return let(
        found, lambda c: _counts(c["passed"] + c["failed"] + c["error"], c["passed"], c["failed"], c["error"])
    )


def coverage_py(log: Column) -> Column:
    return F.coalesce(_int(log, COVERAGE_FULL), _int(log, COVERAGE_SHORT), F.lit(0)).cast("double")


def surefire_counts(log: Column) -> Column:
    def of_numbers(n: Column) -> Column:
        run, failures, errors, skipped = (_zero(_as_int(F.get(n, F.lit(i)))) for i in range(4))
        failed = failures + errors
        return _counts(run, run - failed - skipped, failed, errors, skipped)

    line = F.regexp_extract(log, "(?d)" + SUREFIRE, 0)
    return let(F.regexp_extract_all(line, F.lit(r"(\d+)"), F.lit(1)), of_numbers)


def build_failure(stdout: Column, stderr: Column) -> Column:
    """Reason of a failed Java build, else null."""
    errors = F.filter(lines(stdout), lambda l: l.contains("[ERROR]") & ~l.contains("Failed to execute goal"))
    first = strip(F.get(errors, F.lit(0)))
    failed = any_of(stdout, ["BUILD FAILURE", "COMPILATION ERROR"]) | stderr.contains("BUILD FAILURE")
    reason = F.when(stdout.contains("COMPILATION ERROR"), F.lit(COMPILATION_FAILED)).otherwise(
        F.coalesce(first, F.lit(BUILD_FAILED))
    )
    return F.when(failed, reason)


def surefire_error(stdout: Column, stderr: Column, exit_code: Column) -> Column:
    """Build failure, or success without any test found."""
    nothing = _int(stdout, SUREFIRE).isNull() & (exit_code == 0)
    return F.coalesce(build_failure(stdout, stderr), F.when(nothing, NO_TESTS))


def jacoco_coverage(html: Column) -> Column:
    return F.coalesce(_int(html, JACOCO), F.lit(0)).cast("double")


def jest_counts(log: Column) -> Column:
    def of_line(c: Column) -> Column:
        run, passed, failed, skipped = c["total"], c["passed"], c["failed"], c["skipped"]
        inferred = (run > 0) & (passed == 0) & (failed == 0)
        return _counts(run, F.when(inferred, run - failed - skipped).otherwise(passed), failed, skipped=skipped)

    line = F.regexp_extract(log, "(?d)" + JEST_TESTS, 1)
    return let(line, lambda x: let(F.struct(*_words_before(x, JEST_WORDS)), of_line))


def jest_error(log: Column) -> Column:
    """Reason if the suite did not run at all, else null."""
    failed = log.contains("Test Suites: ") & log.contains(" failed") & _int(log, JEST_SUITES).isNotNull()
    return F.when(failed & (jest_counts(log)["tests_run"] == 0), SUITE_FAILED)


def jest_coverage(log: Column) -> Column:
    number = F.regexp_extract(log, "(?d)" + JEST_COVERAGE, 1)
    return F.coalesce(let(number, lambda n: F.when(n != "", n.try_cast("double"))), F.lit(0.0))


def exit_code_counts(exit_code: Column) -> Column:
    """One test that passes exactly when the exit code is 0."""
    ok = (exit_code == 0).cast("bigint")
    return _counts(F.lit(1), ok, 1 - ok)


_JEST_JSON = "numTotalTests bigint, numPassedTests bigint, numFailedTests bigint, success boolean"


def _jest_json(log: Column) -> Column:
    """Parsed first JSON line with totals, null if there is none or it is malformed."""
    candidates = F.filter(lines(log), lambda l: strip(l).startswith("{") & l.contains("numTotalTests"))
    parsed = F.from_json(
        F.get(candidates, F.lit(0)), _JEST_JSON + ", corrupt string", {"columnNameOfCorruptRecord": "corrupt"}
    )
    return let(parsed, lambda r: F.when(r["corrupt"].isNull(), r))


def jest_json_counts(log: Column, exit_code: Column) -> Column:
    def of_reply(r: Column) -> Column:
        counts = _counts(_zero(r["numTotalTests"]), _zero(r["numPassedTests"]), _zero(r["numFailedTests"]))
        return F.when(r.isNotNull(), counts).otherwise(exit_code_counts(exit_code))

    return let(_jest_json(log), of_reply)


def jest_json_success(log: Column, exit_code: Column) -> Column:
    return let(
        _jest_json(log),
        lambda r: F.when(r.isNotNull(), F.coalesce(r["success"], F.lit(False))).otherwise(exit_code == 0),
    )


def _staged(logs: DataFrame, language: Column, out: Column) -> DataFrame:
    """Add, one stage after another, the line with the totals, its numbers as texts, and the numbers.

    Each stage is a column of its own, so that all of it runs in generated code
    and no expression is searched for twice.
    """
    script = language.isin("javascript", "typescript")
    html = F.coalesce("coverage_html", F.lit("")) if "coverage_html" in logs.columns else F.lit("")
    line = (
        F.when(language == "python", F.regexp_extract(out, "(?d)" + PYTEST_SUMMARY, 1))
        .when(language == "java", F.regexp_extract(out, "(?d)" + SUREFIRE, 0))
        .when(script, F.regexp_extract(out, "(?d)" + JEST_TESTS, 1))
    )
    cover = (
        F.when(language == "python", F.coalesce(_digits(F.regexp_extract(out, "(?d)" + COVERAGE_FULL, 1)), F.regexp_extract(out, "(?d)" + COVERAGE_SHORT, 1)))
        .when(language == "java", F.regexp_extract(html, "(?d)" + JACOCO, 1))
        .when(script, F.regexp_extract(out, "(?d)" + JEST_COVERAGE, 1))
    )
    logs = with_once(with_once(logs, "t_line", line), "t_cover", cover)
    words = lambda names: F.array(*[F.regexp_extract("t_line", rf"(?d)(\d+)\s+{w}", 1) for w in names])
    texts = (
        F.when(language == "python", words(PYTEST_WORDS))
        .when(language == "java", F.regexp_extract_all("t_line", F.lit(r"(\d+)"), F.lit(1)))
        .when(script, words(JEST_WORDS))
    )
    logs = with_once(logs, "t_texts", texts)
    numbers = [F.coalesce(F.when(F.length(t).between(1, 18), t.cast("bigint")), F.lit(0).cast("bigint")) for i in range(4) for t in [F.get("t_texts", F.lit(i))]]
    return with_once(logs, "t_numbers", F.array(*numbers))


def _digits(c: Column) -> Column:
    return F.when(F.length(c).between(1, 18), c)


def _as_number(c: Column) -> Column:
    """A captured percentage, 0 where there is none or it has too many digits."""
    return F.coalesce(F.when(F.length(c).between(1, 18), c.try_cast("double")), F.lit(0.0))


def _staged_counts(language: Column, out: Column) -> Column:
    a, b, c, d = (F.get("t_numbers", F.lit(i)) for i in range(4))
    by_line = [count_of(out, f" {w.upper()}\n") for w in PYTEST_WORDS]
    python = F.when(a + b + c + d > 0, _counts(a + b + c + d, a, b, c, d)).otherwise(
        _counts(by_line[0] + by_line[1] + by_line[2], *by_line)
    )
    java = _counts(a, a - b - c - d, b + c, c, d)
    inferred = (a > 0) & (b == 0) & (c == 0)
    script = _counts(a, F.when(inferred, a - c - d).otherwise(b), c, skipped=d)
    return F.when(language == "python", python).when(language == "java", java).when(language.isin("javascript", "typescript"), script)


def _staged_error(language: Column, out: Column, err: Column, exit_code: Column) -> Column:
    told = F.length(F.coalesce(F.get("t_texts", F.lit(0)), F.lit(""))).between(1, 18)
    java = F.coalesce(build_failure(out, err), F.when(~told & (exit_code == 0), NO_TESTS))
    failed = out.contains("Test Suites: ") & out.contains(" failed") & _int(out, JEST_SUITES).isNotNull()
    script = F.when(failed & (F.get("t_numbers", F.lit(0)) == 0), SUITE_FAILED)
    return F.when(language == "java", java).when(language.isin("javascript", "typescript"), script)


def normalise_validations(logs: DataFrame, mode: str = "runner", clip: int | None = None) -> DataFrame:
    """Logs (language, stdout, stderr, exit_code, coverage_html) in one result schema.

    ``runner`` parses full reports, ``sandbox`` takes exit codes and Jest JSON,
    ``local`` counts Python result words. One pass; a language without a runner
    gives an error row. ``clip`` keeps only so many characters of the stored logs;
    an ``execution_time`` in seconds is passed on, 0 where it is missing.
    """
    out, err = F.coalesce("stdout", F.lit("")), F.coalesce("stderr", F.lit(""))
    language, exit_code = F.lower("language"), F.col("exit_code")
    script = language.isin("javascript", "typescript")
    success, error, coverage = exit_code == 0, F.lit(None).cast("string"), F.lit(0.0)
    by_exit = exit_code_counts(exit_code)
    dropped = ["stdout", "stderr", "exit_code", "coverage_html", "language", "execution_time"]
    took = F.coalesce(F.col("execution_time").cast("double"), F.lit(0.0)) if "execution_time" in logs.columns else F.lit(0.0)
    keys = [c for c in logs.columns if c not in dropped]  # before stages add theirs
    if mode == "runner":
        logs = _staged(logs, language, out)
        counts, error = _staged_counts(language, out), _staged_error(language, out, err, exit_code)
        logs, error = with_once(logs, "run_error", error), F.col("run_error")
        counts = F.when(error.isNull() | (language == "python"), counts)
        cover = _as_number(F.col("t_cover"))
        coverage = F.when(language == "python", cover).when(error.isNull(), cover)
    elif mode == "sandbox":
        counts = F.when(language.isin("python", "java"), by_exit).when(script, jest_json_counts(out, exit_code))
        success = F.when(script, jest_json_success(out, exit_code)).otherwise(success)
    elif mode == "local":
        counts = F.when(language == "python", pytest_simple_counts(out)).when(language.isin(*RUNNERS), by_exit)
    else:
        raise ValueError(f"unknown mode {mode!r}")
    supported = language.isin(*RUNNERS)
    unsupported = F.concat(F.lit("Unsupported language: "), F.col("language"), F.lit(". " + UNSUPPORTED))
    parsed = logs.select(
        *keys,
        "language",
        F.when(~supported, unsupported).otherwise(error).alias("error"),
        F.when(supported, success).otherwise(False).alias("ran"),
        counts.alias("c"),
        F.coalesce(coverage, F.lit(0.0)).alias("coverage_percent"),
        "exit_code",
        F.when(supported, F.lit(mode)).otherwise("unsupported").alias("execution_mode"),
        (out if clip is None else head(out, clip)).alias("stdout"),
        (err if clip is None else head(err, clip)).alias("stderr"),
        took.alias("execution_time"),
    )
    return parsed.select(
        *keys,
        "language",
        (F.col("ran") & F.col("error").isNull()).alias("success"),
        *[_zero(F.col(f"c.{n}")).alias(n) for n in COUNTERS],
        "coverage_percent",
        "exit_code",
        "execution_mode",
        "error",
        "execution_time",
        "stdout",
        "stderr",
    )


def equivalence(original: DataFrame, modernized: DataFrame, key: Keys) -> DataFrame:
    """Score of the new version's test results against the old one's.

    1 if both succeed with equal passes, else their ratio, 0 if either fails;
    equivalent from 0.95. Several results of one file are summed first, so the
    join never pairs them.
    """
    keys = key_list(key)

    def per_file(results: DataFrame, prefix: str) -> DataFrame:
        return results.groupBy(*keys).agg(
            F.bool_and("success").alias(f"{prefix}_ok"), F.sum("tests_passed").alias(f"{prefix}_passed")
        )

    a, b = F.col("a_passed"), F.col("b_passed")
    score = (
        F.when(~(F.col("a_ok") & F.col("b_ok")), 0.0).when(a == b, 1.0).otherwise(b / F.greatest(a, F.lit(1)))
    )
    return per_file(original, "a").join(per_file(modernized, "b"), keys).select(
        *keys,
        F.round(score, 3).alias("equivalence_score"),
        (score >= 0.95).alias("behavioral_equivalence"),
    )
