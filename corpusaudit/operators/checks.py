"""Consistency of source code and the tests written for it.

A row holds a source and its test, so every check is a set difference of names
found in the row's own two texts: nothing is shuffled and no name is exploded.
Regular expressions use Unicode classes and newline-only line ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusaudit import dims
from corpusaudit.functions import paths
from corpusaudit.functions.once import let, with_once
from corpusaudit.functions.text import any_of, lines, strip, words
from corpusaudit.operators.grouping import file_key

# What is looked for in sources and tests.
RELATIVE_IMPORTS = r"import\s+\{([^}]+)\}\s+from\s+[\"']\./"
EXPORT_LIST = r"export\s+\{([^}]*)\}"
TS_KINDS = ["function", "class", "enum", "interface", "type"]
JS_KINDS = ["function", "class", "const", "let", "var"]
PY_FROM_IMPORT = r"from\s+\w+\s+import\s+([^#\n]+)"
PY_IMPORT = r"import\s+(\w+)"
TOP_LEVEL_AWAIT = r"\btop-level\s+await\b|^await\s+"
CLI_MARKERS = ["process.argv[1]", "if (require.main === module)"]
FIX_ORDER = ["enum", "interface", "type", "class", "function", "const"]
# The blocks that are cut out of a source.
URL_BLOCK = (
    r"\n// Modern ES module.*?\n.*?import.*?from ['\"]url['\"];.*?\n.*?import.*?from ['\"]path['\"];"
    r".*?\n\nconst __filename.*?import\.meta\.url\);.*?\n.*?if \(process\.argv\[1\].*?\{.*?\n.*?\n.*?\n\}"
)
# The line anchor keeps the search linear in long lines; a match always starts a line.
META_LINE = r"^.*import\.meta.*\n"
CLI_BLOCK = r"\nif \(process\.argv\[1\].*?\{[^}]*\}"
# Texts of the issues.
NOT_EXPORTED = "' is declared in source but not exported. Add 'export' keyword before the declaration."
NOT_FOUND = "' is imported in tests but not found in source code."
JS_NOT_EXPORTED = "' is imported in tests but not exported in source. Add it to the export statement."
NOT_DEFINED = "' is imported in tests but not defined in source code."
MODULE_ISSUES = {
    "import_meta": (
        "Code uses 'import.meta' which requires ES modules. "
        "Jest/ts-jest uses CommonJS. Remove import.meta usage."
    ),
    "top_level_await": (
        "Code uses top-level await which requires ES modules. "
        "Jest/ts-jest uses CommonJS. Wrap in async function."
    ),
    "cli_block": (
        "Code includes CLI execution logic. Library code should not include main execution blocks."
    ),
}
NAME_ISSUES = {
    "not_exported": NOT_EXPORTED,
    "not_found": NOT_FOUND,
    "js_not_exported": JS_NOT_EXPORTED,
    "not_defined": NOT_DEFINED,
}


ISSUES = "array<struct<kind:string,name:string>>"


def _all(c: Column, regex: str, group: int = 1, flags: str = "dU") -> Column:
    return F.regexp_extract_all(c, F.lit(f"(?{flags}){regex}"), F.lit(group))


def _split_names(groups: Column) -> Column:
    """Comma-separated groups as distinct trimmed names."""
    return F.array_distinct(F.flatten(F.transform(groups, lambda g: F.transform(F.split(g, ","), strip))))


def _words_of(groups: Column) -> Column:
    return F.flatten(F.transform(groups, lambda g: _all(g, r"\w+", 0)))


def _after(c: Column, keywords: list[str]) -> Column:
    """Names after one of the keywords; the name is looked ahead at, so runs overlap.

    The word boundary is looked behind at once a keyword is found, which is much
    cheaper than testing it at every character.
    """
    any_keyword = "(?:" + "|".join(keywords) + ")"
    return _all(c, rf"{any_keyword}(?<=\b{any_keyword})(?=\s+(\w+))")


def _with_blank(names: Column, *more: Column) -> Column:
    """An empty import (a trailing comma) counts as present once any of ``names`` is."""
    blank = F.array(F.lit(""))
    return F.concat(let(names, lambda n: F.when(F.size(n) > 0, F.concat(n, blank)).otherwise(n)), *more)


def imported_relative(test: Column) -> Column:
    return _split_names(_all(test, RELATIVE_IMPORTS))


def exported_ts(source: Column) -> Column:
    kinds = _all(source, r"export\s+(?:" + "|".join(TS_KINDS) + r")(?=\s+(\w+))")
    listed = _words_of(_all(source, EXPORT_LIST))
    return _with_blank(F.concat(kinds, listed), _all(source, r"export\s+const\s+(\w+)\s*="))


def declared_ts(source: Column) -> Column:
    return _with_blank(_after(source, TS_KINDS), _all(source, r"const(?<=\bconst)\s+(\w+)\s*="))


def exported_js(source: Column) -> Column:
    kinds = _all(source, r"export\s+(?:" + "|".join(JS_KINDS) + r")(?=\s+(\w+))")
    listed = _words_of(_all(source, EXPORT_LIST))
    module = _words_of(_all(source, r"module\.exports\s*=\s*\{([^}]*)\}"))
    return _with_blank(F.concat(kinds, listed, module), _all(source, r"exports\.(\w+)\s*="))


def imported_py(test: Column, bare: bool = True) -> Column:
    """Names of ``from m import`` lines and, with ``bare``, of every ``import m``."""
    names = _split_names(_all(test, PY_FROM_IMPORT))
    return F.array_distinct(F.concat(names, _all(test, PY_IMPORT))) if bare else names


def defined_py(source: Column) -> Column:
    flags = "dmU"
    classes = _all(source, r"^class\s+(\w+)", flags=flags)
    return _with_blank(
        classes,
        _all(source, r"^def\s+(\w+)\s*\(", flags=flags),
        _all(source, r"^(\w+)\s*=", flags=flags),
    )


def _issues(names: Column, kind: str) -> Column:
    """Issue records for names, in name order."""
    return F.transform(F.sort_array(names), lambda n: F.struct(F.lit(kind).alias("kind"), n.alias("name")))


def ts_export_issues(source: Column, test: Column) -> Column:
    def split_by_declaration(missing: Column) -> Column:
        return let(
            declared_ts(source),
            lambda declared: F.concat(
                _issues(F.array_intersect(missing, declared), "not_exported"),
                _issues(F.array_except(missing, declared), "not_found"),
            ),
        )

    missing = F.array_except(imported_relative(test), exported_ts(source))
    return let(missing, lambda m: F.when(F.size(m) > 0, split_by_declaration(m)).otherwise(F.array().cast(ISSUES)))


def js_export_issues(source: Column, test: Column) -> Column:
    return _issues(F.array_except(imported_relative(test), exported_js(source)), "js_not_exported")


def py_definition_issues(source: Column, test: Column, bare: bool = True) -> Column:
    return _issues(F.array_except(imported_py(test, bare), defined_py(source)), "not_defined")


def module_issues(source: Column) -> Column:
    found = F.array(
        F.when(source.contains("import.meta"), "import_meta"),
        F.when(source.rlike("(?dmU)" + TOP_LEVEL_AWAIT), "top_level_await"),
        F.when(any_of(source, CLI_MARKERS), "cli_block"),
    )
    return F.transform(
        F.array_compact(found), lambda k: F.struct(k.alias("kind"), F.lit(None).cast("string").alias("name"))
    )




def code_issues(source: Column, test: Column, language: Column) -> Column:
    """Issues by language; a language without checks has none."""
    language = F.lower(language)
    return (
        F.when(language == "typescript", F.concat(module_issues(source), ts_export_issues(source, test)))
        .when(language == "javascript", js_export_issues(source, test))
        .when(language == "python", py_definition_issues(source, test))
        .otherwise(F.array().cast(ISSUES))
        .cast(ISSUES)
    )


def issue_message(kind: Column, name: Column) -> Column:
    by_name = F.concat(F.lit("'"), name, dims.lookup(kind, NAME_ISSUES))
    return F.coalesce(dims.lookup(kind, MODULE_ISSUES), by_name)


# -- DataFrame forms ---------------------------------------------------------
def check_pairs(pairs: DataFrame, issues: Column) -> DataFrame:
    """Add ``issues`` and ``is_valid`` to rows of source and test."""
    return with_once(pairs, "issues", issues).withColumn("is_valid", F.size("issues") == 0)


def validate_code(pairs: DataFrame) -> DataFrame:
    """Checks chosen by ``language`` on source_code and test_code."""
    return check_pairs(pairs, code_issues(F.col("source_code"), F.col("test_code"), F.col("language")))


def issue_rows(checked: DataFrame, *keys: str) -> DataFrame:
    """One row per issue with its text."""
    rows = checked.select(*keys, F.explode("issues").alias("i")).select(*keys, "i.*")
    return rows.withColumn("message", issue_message(F.col("kind"), F.col("name")))


#: Declarations at the start of a line; a match of one fixed expression, however many names are wanted.
LINE_DECLARATION = r"\n((?:enum|interface|type|class|function)\s+\w+|const\s+\w+(?=\s*=))"


def fix_exports_ts(source: Column, names: Column) -> Column:
    """Put ``export`` before every declaration of each name, of the first kind that it is declared as.

    The declarations are read once; one expression then changes all names.
    """

    def declared(texts: Column) -> Column:
        kinds = F.array(*[F.lit(k) for k in FIX_ORDER])
        place = lambda d: F.array_position(kinds, F.regexp_extract(d, r"^\w+", 0))
        return F.array_distinct(
            F.transform(texts, lambda d: F.struct(F.regexp_extract(d, r"(?U)(\w+)$", 1).alias("name"), place(d).alias("place")))
        )

    def wanted(found: Column) -> Column:
        def first(name: Column) -> Column:
            return F.array_min(F.filter(found, lambda d: d["name"] == name))

        return F.array_compact(F.transform(names, first))

    def part(d: Column) -> Column:
        kind = F.element_at(F.array(*[F.lit(k) for k in FIX_ORDER]), d["place"].cast("int"))
        return F.concat(kind, F.lit(r"\s+"), d["name"], F.when(kind == "const", F.lit(r"\s*=")).otherwise(F.lit(r"\b")))

    def replaced(parts: Column) -> Column:
        pattern = F.concat(F.lit(r"(?U)(\n)("), F.array_join(F.transform(parts, part), "|"), F.lit(")"))
        return F.when(F.size(parts) > 0, F.regexp_replace(source, pattern, F.lit("$1export $2"))).otherwise(source)

    return let(_all(source, LINE_DECLARATION), lambda texts: let(declared(texts), lambda found: let(wanted(found), replaced)))


def fix_module_system_ts(source: Column) -> Column:
    """Cut out module-only code: the whole block, else each line with it; then CLI blocks."""
    # A cut whose expression does not match changes nothing, so none needs a guard.
    without_block = F.regexp_replace(source, "(?s)" + URL_BLOCK, "")
    without_meta = F.regexp_replace(without_block, "(?dm)" + META_LINE, "")
    cut = F.when(source.contains("import.meta"), without_meta).otherwise(source)
    return F.regexp_replace(cut, "(?s)" + CLI_BLOCK, "")


def validate_and_fix(pairs: DataFrame) -> DataFrame:
    """Check, fix TypeScript, check changed text again (columns fixed_code, is_valid, issues)."""
    first = validate_code(pairs)
    broken = (F.lower("language") == "typescript") & ~F.col("is_valid")
    kinds = F.col("issues.kind")
    names = F.transform(
        F.filter("issues", lambda i: (i["kind"] == "not_exported") & i["name"].rlike(r"^(?U)\w+\z")), lambda i: i["name"]
    )
    has_module_issue = F.arrays_overlap(kinds, F.array(*[F.lit(k) for k in MODULE_ISSUES]))
    source, module_fixed = F.col("source_code"), F.col("module_fixed")
    step = with_once(
        first, "module_fixed", F.when(broken & has_module_issue, fix_module_system_ts(source)).otherwise(source)
    )
    exported = F.when(broken & (F.size(names) > 0), fix_exports_ts(module_fixed, names)).otherwise(module_fixed)
    step = with_once(step, "fixed_code", exported).drop("module_fixed")
    fixed = F.col("fixed_code")
    again = F.when(fixed != source, code_issues(fixed, F.col("test_code"), F.col("language"))).otherwise(F.col("issues"))
    return with_once(step, "issues", again).withColumn("is_valid", F.size("issues") == 0)


# -- packages and imports ----------------------------------------------------
def python_packages(content: Column) -> Column:
    """Known packages of import lines, in order of first use."""
    stripped = F.transform(lines(content), strip)
    imports = F.filter(stripped, lambda l: l.startswith("import ") | l.startswith("from "))
    modules = F.transform(imports, lambda l: F.substring_index(F.get(words(l), F.lit(1)), ".", 1))
    return F.array_distinct(F.filter(modules, lambda m: m.isin(*dims.PYTHON_PACKAGES)))


def script_packages(content: Column) -> Column:
    """Known packages quoted anywhere on a line, by line and then by list order."""

    def on_line(line: Column) -> Column:
        hits = [
            F.when(line.contains(f"'{p}'") | line.contains(f'"{p}"'), F.lit(p)) for p in dims.SCRIPT_PACKAGES
        ]
        return F.array_compact(F.array(*hits))

    return F.array_distinct(F.flatten(F.transform(lines(content), on_line)))


def required_packages(files: DataFrame) -> DataFrame:
    """One row per file and package with its position; Java names none."""
    language = F.col("language")
    found = F.when(language == "python", python_packages(F.col("content"))).when(
        language.isin("javascript", "typescript"), script_packages(F.col("content"))
    )
    keys = [c for c in files.columns if c != "content"]
    return files.select(*keys, F.posexplode(found).alias("ord", "package"))


def imported_modules(source: Column) -> Column:
    """Modules a file imports, by last name: Python imports and relative script imports."""
    python = F.concat(
        _all(source, r"^\s*from\s+([\w.]+)\s+import\b", flags="dmU"), _all(source, r"^\s*import\s+([\w.]+)", flags="dmU")
    )
    script = _all(source, r"\bfrom\s+[\"']\./([\w/.-]+)[\"']")
    return F.array_distinct(
        F.transform(F.concat(F.transform(python, lambda m: F.replace(m, F.lit("."), F.lit("/"))), script), paths.stem)
    )


def import_edges(files: DataFrame, column: str = "source_code") -> DataFrame:
    """Edges from a file to the names of the modules it imports."""
    return files.select(*file_key(files), F.explode(imported_modules(F.col(column))).alias("module"))


def import_degrees(files: DataFrame, column: str = "source_code") -> DataFrame:
    """Files a file depends on, and files that depend on it, matched by module name within a repository.

    Both are counted per module before joining back, so a name such as ``utils``
    that many files share or import never forms pairs.
    """
    key = file_key(files)
    module = [c for c in key if c != "file_path"] + ["module"]
    edges = import_edges(files, column)
    named = files.select(*key, paths.stem(F.col("file_path")).alias("module"))
    holders = named.groupBy(*module).agg(F.count(F.lit(1)).alias("holders"))
    importers = edges.groupBy(*module).agg(F.count(F.lit(1)).alias("importers"))
    out = edges.join(holders, module).groupBy(*key).agg(F.sum("holders").alias("depends_on"))
    return (
        named.join(importers, module, "left")
        .join(out, key, "left")
        .select(
            *key,
            F.coalesce("depends_on", F.lit(0)).cast("bigint").alias("depends_on"),
            F.coalesce("importers", F.lit(0)).cast("bigint").alias("depended_on_by"),
        )
    )


# -- test texts --------------------------------------------------------------
# Reasons to reject a test text.
PY_NO_TESTS = "No test functions found (must start with 'test_' or be in 'Test' class)"
PY_NO_IMPORTS = "No import statements found"
JAVA_NO_TESTS = "No @Test annotations found (required for JUnit 5)"
JAVA_NO_JUNIT = "Missing JUnit imports (import org.junit.jupiter.api.Test)"
JAVA_NO_CLASS = "No test class found"
JS_NO_TESTS = "No Jest test functions found (describe/test/it)"
JS_NO_IMPORTS = "No import/require statements found"
JS_NO_EXPECT = "No expect() assertions found"


@F.pandas_udf(T.StringType())
def syntax_error(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Message of the Python syntax error in each text, null if it compiles."""

    def problem(source: str | None) -> str | None:
        try:
            compile(source or "", "<string>", "exec")
        except (SyntaxError, ValueError, MemoryError, RecursionError) as error:
            return f"Syntax error in test code: {error}"
        return None

    for batch in texts:
        yield batch.map(problem)


def valid_tests(tests: DataFrame, check_syntax: bool = True) -> DataFrame:
    """Add ``reason`` (first failing check of the language, else null) and ``is_valid``."""
    t, language = F.col("test_code"), F.col("language")
    has_tests, has_imports = any_of(t, ["def test_", "class Test"]), t.contains("import")
    python = F.when(~has_tests, PY_NO_TESTS).when(~has_imports, PY_NO_IMPORTS)
    if check_syntax:
        # Only texts that pass the cheap checks are worth compiling.
        compiled = syntax_error(F.when((language == "python") & has_tests & has_imports, t))
        tests = tests.withColumn("syntax", compiled)
        python = python.otherwise(F.col("syntax"))
    java = (
        F.when(~t.contains("@Test"), JAVA_NO_TESTS)
        .when(~t.contains("org.junit"), JAVA_NO_JUNIT)
        .when(~t.contains("class"), JAVA_NO_CLASS)
    )
    script = (
        F.when(~any_of(t, ["describe(", "test(", "it("]), JS_NO_TESTS)
        .when(~any_of(t, ["import", "require"]), JS_NO_IMPORTS)
        .when(~t.contains("expect("), JS_NO_EXPECT)
    )
    reason = F.when(language == "python", python).when(language == "java", java).when(
        language.isin("javascript", "typescript"), script
    )
    return tests.withColumn("reason", reason).withColumn("is_valid", F.col("reason").isNull()).drop("syntax")


def accepted_tests(tests: DataFrame) -> DataFrame:
    """Generated tests long enough to keep; Python ones must hold a test function."""
    t = F.col("test_code")
    short = F.length(strip(t)) < 100
    empty = (F.col("language") == "python") & ~t.contains("def test_")
    return tests.withColumn("accepted", ~(short | empty))


def main_class(code: Column, module: Column) -> Column:
    """Public class of a Java text, else the module name in PascalCase."""
    named = F.regexp_extract(code, r"(?U)public\s+class\s+(\w+)", 1)
    pascal = F.array_join(
        F.transform(F.split(module, "_"), lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substr(w, F.lit(2))))), ""
    )
    return F.when(named != "", named).otherwise(pascal)
