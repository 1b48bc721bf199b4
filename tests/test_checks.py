"""Golden cases for code checks, fixes and packages."""

import pytest
from pyspark.sql import functions as F

from corpusaudit.operators import checks


def pairs(spark, cases, language):
    return spark.createDataFrame([(s, t, language) for s, t in cases], "source_code string, test_code string, language string")


def issues(spark, source, test, language):
    row = checks.validate_code(pairs(spark, [(source, test)], language)).first()
    return {(i["kind"], i["name"]) for i in row["issues"]}


TS = [
    ("export {A, B};", 'import {A, B} from "./m";', set()),
    ("export { X as A };", "import { A } from './m'", set()),
    ("export const A = 1;", 'import { A } from "./m";', set()),
    ("class A {}", 'import { A } from "./m";', {("not_exported", "A")}),
    ("const A = 1", 'import { A } from "./m";', {("not_exported", "A")}),
    ("let A = 1", 'import { A } from "./m";', {("not_found", "A")}),
    ("export type A = B", 'import {A,} from "./m";', set()),
    ("const x = 1", 'import {A,} from "./m";', {("not_found", "A"), ("not_found", "")}),
    ("export class AB {}", 'import { A } from "./m";', {("not_found", "A")}),
    ("class A {}", 'import { A } from "lib";', set()),
    ("type class A", 'import { A } from "./m";', {("not_exported", "A")}),
    ("f(import.meta.url)", "", {("import_meta", None)}),
    ("await x;\n", "", {("top_level_await", None)}),
    ("  await x;\n", "", set()),
    ("if (require.main === module) {}", "", {("cli_block", None)}),
]


@pytest.mark.parametrize("source, test, expected", TS)
def test_typescript(spark, source, test, expected):
    assert issues(spark, source, test, "TypeScript") == expected


JS = [
    ("export let a = 1;", 'import { a } from "./m.js"', set()),
    ("module.exports = { a, b };", 'import { a, b } from "./m.js"', set()),
    ("exports.a = 1", 'import { a } from "./m.js"', set()),
    ("function a() {}", 'import { a } from "./m.js"', {("js_not_exported", "a")}),
]


@pytest.mark.parametrize("source, test, expected", JS)
def test_javascript(spark, source, test, expected):
    assert issues(spark, source, test, "javascript") == expected


PY = [
    ("def a():\n  pass\nclass B: pass\nC = 1\n", "from m import a, B, C  # all", set()),
    ("  def a(): pass", "from m import a", {("not_defined", "a")}),
    ("x = 1", "import os", {("not_defined", "os")}),
    ("def é(): pass\n", "from m import é", set()),
]


@pytest.mark.parametrize("source, test, expected", PY)
def test_python(spark, source, test, expected):
    assert issues(spark, source, test, "python") == expected


def test_other_languages_have_no_checks(spark):
    assert issues(spark, "import.meta", 'import { A } from "./m"', "go") == set()


def test_messages(spark):
    df = checks.validate_code(pairs(spark, [("class A {}\nf(import.meta)", 'import { A, Z } from "./m";')], "typescript"))
    texts = {r["message"] for r in checks.issue_rows(df).collect()}
    assert "'A' is declared in source but not exported. Add 'export' keyword before the declaration." in texts
    assert "'Z' is imported in tests but not found in source code." in texts
    assert any(t.startswith("Code uses 'import.meta'") for t in texts)


FIXES = [
    ("\nclass A {}", 'import { A } from "./m";', "\nexport class A {}", True),
    ("\nenum A {}\nclass A {}", 'import { A } from "./m";', "\nexport enum A {}\nclass A {}", True),
    ("class A {}", 'import { A } from "./m";', "class A {}", False),  # no newline before the declaration
    ("a;\nconst u = import.meta.url;\nb;", "", "a;\nb;", True),
    ("a;\nif (process.argv[1] === f) { run(); }\nb;", "", "a;\nb;", True),
    ("\nconst A = 1\nuse(import.meta)\n", 'import { A } from "./m";', "\nexport const A = 1\n", True),
    ("ok", "", "ok", True),
]


@pytest.mark.parametrize("source, test, fixed, valid", FIXES)
def test_fixes(spark, source, test, fixed, valid):
    row = checks.validate_and_fix(pairs(spark, [(source, test)], "typescript")).first()
    assert (row["fixed_code"], row["is_valid"]) == (fixed, valid)


def test_fixing_twice_changes_nothing(spark):
    cases = [(s, t) for s, t, _, _ in FIXES]
    once = checks.validate_and_fix(pairs(spark, cases, "typescript"))
    again = checks.validate_and_fix(once.select(F.col("fixed_code").alias("source_code"), "test_code", "language"))
    assert again.filter("fixed_code != source_code").isEmpty()


def test_only_typescript_is_fixed(spark):
    row = checks.validate_and_fix(pairs(spark, [("\nfunction a() {}", 'import { a } from "./m"')], "javascript")).first()
    assert row["fixed_code"] == "\nfunction a() {}" and not row["is_valid"]


def test_long_lines_are_fixed_in_linear_time(spark):
    source = "x" * 400_000 + "\nimport.meta;\n" + "y" * 400_000
    row = checks.validate_and_fix(pairs(spark, [(source, "")], "typescript")).first()
    assert len(row["fixed_code"]) == 800_001


def test_packages_in_order_of_use(spark):
    python = "from pandas.core import x\nimport numpy\nx = 1\nimport pandas\n  import requests as r\nimport os\nimportant"
    script = "import m from 'moment';\nconst a = require(\"axios\"), e = 'express'\nimport r from 'react'"
    df = spark.createDataFrame([("a", "python", python), ("b", "typescript", script), ("c", "java", python)],
                               "file_path string, language string, content string")
    found = [(r["file_path"], r["ord"], r["package"]) for r in checks.required_packages(df).collect()]
    assert sorted(found) == [("a", 0, "pandas"), ("a", 1, "numpy"), ("a", 2, "requests"), ("b", 0, "moment"),
                             ("b", 1, "express"), ("b", 2, "axios"), ("b", 3, "react")]


def test_test_texts(spark):
    cases = [
        ("python", "import x\ndef test_a(): pass", None),
        ("python", "import x\ndef test_a(: pass", "Syntax error"),
        ("python", "x", checks.PY_NO_TESTS),
        ("python", "def test_a(): pass", checks.PY_NO_IMPORTS),
        ("java", "@Test org.junit class", None),
        ("java", "@Test", checks.JAVA_NO_JUNIT),
        ("typescript", "require('x'); test('a')", checks.JS_NO_EXPECT),
        ("go", "", None),
    ]
    df = spark.createDataFrame([(i, *c[:2]) for i, c in enumerate(cases)], "i int, language string, test_code string")
    got = [r["reason"] for r in checks.valid_tests(df).orderBy("i").collect()]
    for reason, (_, _, expected) in zip(got, cases):
        assert (reason is None) if expected is None else reason.startswith(expected)


def test_degrees_do_not_pair_shared_names(spark):
    """Three files named utils and 200 that import it: counts, not 600 pairs."""
    rows = [(f"d{i}/utils.py", "") for i in range(3)] + [(f"a/m{i}.py", "from lib.utils import x\nimport json") for i in range(200)]
    df = spark.createDataFrame(rows, "file_path string, source_code string")
    degrees = checks.import_degrees(df)
    assert {(r["depends_on"], r["depended_on_by"]) for r in degrees.collect()} == {(0, 200), (3, 0)}
    assert degrees.count() == 203


def test_main_class(spark):
    df = spark.createDataFrame([("public  class Foo {", "m"), ("class Foo", "my_fOO_2x")], "c string, m string")
    assert [r[0] for r in df.select(checks.main_class(F.col("c"), F.col("m"))).collect()] == ["Foo", "MyFoo2x"]
