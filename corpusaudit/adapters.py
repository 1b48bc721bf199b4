"""Views that shape the driver's tables into this engine's input schemas.

Each view is one SELECT that Spark and DuckDB both run, so a check can use the
same input on both sides. ``{table}`` marks a base table or another view.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

VIEWS: dict[str, str] = {}

VIEWS["files"] = """
SELECT source AS repo, dir || '/f' || cast(doc_id AS string) || ext AS file_path,
       'f' || cast(doc_id AS string) || ext AS file_name, ext AS extension,
       n_chars AS size_chars, text AS content, doc_id
FROM (SELECT *, CASE doc_id % 7 WHEN 0 THEN 'src' WHEN 1 THEN 'src/app' WHEN 2 THEN 'node_modules/lib'
                 WHEN 3 THEN '.git' WHEN 4 THEN 'build' WHEN 5 THEN 'tests' ELSE 'venv/lib' END AS dir,
             CASE doc_id % 11 WHEN 0 THEN '.py' WHEN 1 THEN '.java' WHEN 2 THEN '.js' WHEN 3 THEN '.ts'
                 WHEN 4 THEN '.tsx' WHEN 5 THEN '.php' WHEN 6 THEN '.rb' WHEN 7 THEN '.h' WHEN 8 THEN '.md'
                 WHEN 9 THEN '' ELSE '.PY' END AS ext
      FROM {documents}) d
"""

# The whole text of each document as the comments of a small legacy source file.
VIEWS["sources"] = """
SELECT repo, dir || '/f' || cast(doc_id AS string) || ext AS file_path, ext AS extension, doc_id,
       CASE ext
         WHEN '.py' THEN 'import MySQLdb' || chr(10) || 'from flask import Flask, request' || chr(10)
              || 'import os.path' || chr(10) || 'password = "hunter2' || cast(doc_id AS string) || '"' || chr(10)
              || CASE WHEN doc_id % 3 = 0 THEN 'print "start"' || chr(10) ELSE '' END
              || 'def run' || cast(doc_id % 5 AS string) || '(x):' || chr(10)
              || '    cur.execute("SELECT * FROM t WHERE id=" + x)' || chr(10)
              || '    return hashlib.md5(x)' || chr(10)
         WHEN '.java' THEN 'import java.util.Vector;' || chr(10) || 'public class Job' || cast(doc_id % 5 AS string) || ' {{' || chr(10)
              || '  Vector v = new Vector();' || chr(10)
              || CASE WHEN doc_id % 3 = 0 THEN '  synchronized (this) {{ }}' || chr(10) ELSE '' END || '}}' || chr(10)
         WHEN '.js' THEN 'var a = 1;' || chr(10) || 'const e = require(''express'');' || chr(10)
              || CASE WHEN doc_id % 3 = 0 THEN 'eval("a");' || chr(10) || '$(document).ready(function () {{}});' || chr(10) ELSE '' END
              || 'function go' || cast(doc_id % 5 AS string) || '() {{ return a; }}' || chr(10)
         WHEN '.ts' THEN 'import {{ x }} from "lodash";' || chr(10) || 'let y: any = x as string;' || chr(10)
              || 'export class T' || cast(doc_id % 5 AS string) || ' {{}}' || chr(10)
         WHEN '.php' THEN '<?php' || chr(10) || 'mysql_connect("h");' || chr(10)
              || CASE WHEN doc_id % 3 = 0 THEN 'eval($_GET["c"]);' || chr(10) ELSE '' END
         WHEN '.rb' THEN 'class R' || cast(doc_id % 5 AS string) || ' < ActiveRecord::Base' || chr(10) || '  $count = 1' || chr(10) || 'end' || chr(10)
         WHEN '.go' THEN 'package main' || chr(10) || 'import "io/ioutil"' || chr(10) || 'func main() {{ go work() }}' || chr(10)
         ELSE '#!/bin/sh' || chr(10) || 'rm $1' || chr(10) END
       || '# ' || text AS content
FROM (SELECT doc_id, text, source AS repo,
             CASE doc_id % 4 WHEN 0 THEN 'src' WHEN 1 THEN 'src/app' WHEN 2 THEN 'lib' ELSE 'tools' END AS dir,
             CASE doc_id % 8 WHEN 0 THEN '.py' WHEN 1 THEN '.java' WHEN 2 THEN '.js' WHEN 3 THEN '.ts'
                 WHEN 4 THEN '.php' WHEN 5 THEN '.rb' WHEN 6 THEN '.go' ELSE '.sh' END AS ext
      FROM {documents}) d
"""

# The same files in two repositories.
VIEWS["forks"] = """
SELECT 'left' AS repo, file_path, content, doc_id FROM {sources} UNION ALL SELECT 'right' AS repo, file_path, content, doc_id FROM {sources}
"""

VIEWS["patterns"] = """
SELECT 'f' || cast(l_orderkey AS string) || '.py' AS file_path, l_orderkey AS file_id,
       'pt_' || cast(l_partkey % 9 AS string) AS pattern_type,
       CASE l_linenumber % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' ELSE 'info' END AS severity,
       l_linenumber AS line_number, round(l_discount * 10, 2) AS confidence,
       round(l_quantity * 0.25, 2) AS estimated_effort_hours, l_partkey AS pos
FROM {lineitem}
"""

VIEWS["analyses"] = """
SELECT 'f' || cast(o_orderkey AS string) || '.py' AS file_path, o_orderkey AS file_id,
       'repo' || cast(o_custkey % 50 AS string) AS repo,
       CASE o_custkey % 4 WHEN 0 THEN 'Python' WHEN 1 THEN 'Java' WHEN 2 THEN 'Go' ELSE 'PHP' END AS language,
       CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'critical' WHEN '2' THEN 'high' WHEN '3' THEN 'medium'
            WHEN '4' THEN 'low' ELSE 'info' END AS overall_priority,
       cast(cast(floor(o_totalprice) AS bigint) % 101 AS double) AS modernization_score,
       o_orderstatus <> 'F' AS requires_modernization
FROM {orders}
"""

VIEWS["validations"] = """
SELECT file_path, language, tests_run, tests_run - tests_failed AS tests_passed, tests_failed, coverage_percent, exit_code
FROM (SELECT 'f' || cast(l_orderkey AS string) || '.py' AS file_path,
             CASE l_partkey % 4 WHEN 0 THEN 'python' WHEN 1 THEN 'java' WHEN 2 THEN 'javascript' ELSE 'typescript' END AS language,
             cast(floor(l_quantity) AS bigint) AS tests_run,
             least(cast(floor(l_quantity) AS bigint), cast(l_linenumber % 3 AS bigint)) AS tests_failed,
             CASE WHEN l_returnflag = 'R' THEN cast(0 AS double) ELSE round(l_discount * 1000, 2) END AS coverage_percent,
             CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS exit_code
      FROM {lineitem}) v
"""

# One row per transformed file, with the text before and after.
VIEWS["transformations"] = """
SELECT repo, file_path, content AS original_code,
       'import logging' || chr(10) || content || chr(10) AS modernized_code,
       'def test_' || cast(doc_id AS string) || '():' || chr(10) || '    assert True' AS test_code, doc_id
FROM {files}
"""

VIEWS["logs"] = """
SELECT l_orderkey * 100 + l_linenumber AS file_id, l_partkey AS run_id, language, exit_code, p AS told_passed, f AS told_failed,
       CASE language
         WHEN 'python' THEN CASE WHEN f = 2 THEN 't.py::a PASSED' || chr(10) || 't.py::b FAILED' || chr(10) || 't.py::c SKIPPED' || chr(10)
              ELSE '===== ' || cast(p AS string) || ' passed, ' || cast(f AS string) || ' failed, 1 skipped in 0.52s =====' || chr(10) || 'TOTAL    100   20    80%' END
         WHEN 'java' THEN CASE WHEN f = 2 THEN '[ERROR] Failed to execute goal x' || chr(10) || '[ERROR] missing symbol ' || cast(p AS string) || chr(10) || 'BUILD FAILURE'
              WHEN p = 7 THEN 'COMPILATION ERROR' WHEN p = 8 THEN 'BUILD SUCCESS'
              ELSE 'Tests run: ' || cast(p + f AS string) || ', Failures: ' || cast(f AS string) || ', Errors: 0, Skipped: 0' END
         WHEN 'ruby' THEN '1 example, 0 failures'
         ELSE CASE WHEN p = 9 THEN 'Test Suites: 1 failed, 1 total' || chr(10) || 'Tests:       0 total'
              WHEN p = 10 THEN '{{"numTotalTests": 4, "numPassedTests": 3, "numFailedTests": 1, "success": false}}'
              WHEN p = 11 THEN 'Tests:       ' || cast(p AS string) || ' total'
              ELSE 'Tests:       ' || cast(f AS string) || ' failed, ' || cast(p AS string) || ' passed, ' || cast(p + f AS string) || ' total' || chr(10) || 'All files | 85.71 | 75 | 100 |' END
       END AS stdout,
       '<tr>Total</tr><td>' || cast(p AS string) || ' of ' || cast(p + f AS string) || '</td><td>' || cast(p % 101 AS string) || '%</td>' AS coverage_html
FROM (SELECT l_orderkey, l_linenumber, l_partkey, cast(floor(l_quantity) AS bigint) AS p, cast(l_linenumber % 3 AS bigint) AS f,
             CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS exit_code,
             CASE l_partkey % 5 WHEN 0 THEN 'python' WHEN 1 THEN 'java' WHEN 2 THEN 'javascript' WHEN 3 THEN 'typescript' ELSE 'ruby' END AS language
      FROM {lineitem}) x
"""

VIEWS["exchanges"] = """
SELECT conv_id, turn,
       CASE turn % 4
         WHEN 0 THEN 'Here it is:' || chr(10) || '```python' || chr(10) || text || chr(10) || '```'
         WHEN 1 THEN text || chr(10) || '```'
         WHEN 2 THEN '```' || chr(10) || 'short' || chr(10) || '```' || chr(10) || '```js' || chr(10) || text || chr(10) || '```'
         ELSE text END AS reply
FROM {conversations}
"""

VIEWS["replies"] = """
SELECT event_id AS request_id, 'f' || cast(user_id AS string) || '.py' AS file_path,
       CASE event_id % 5
         WHEN 0 THEN '{{"patterns": [{{"pattern_type": "pt_1", "severity": "high", "confidence": 0.5, "line_numbers": [1, 2], "description": "d", "recommendation": "r", "estimated_effort_hours": 2.5}}], "modernization_score": 40, "requires_modernization": true, "overall_priority": "high"}}'
         WHEN 1 THEN '{{"patterns": [{{"pattern_type": "pt_2", "severity": "low", "description": "d", "recommendation": "r"}}], "modernization_score": 80}}'
         WHEN 2 THEN '{{"patterns": [{{"pattern_type": "pt_3", "severity": "urgent", "description": "d", "recommendation": "r"}}], "modernization_score": 60, "requires_modernization": true, "overall_priority": "low"}}'
         WHEN 3 THEN ''
         ELSE '{{"patterns": ' END AS response_text
FROM {events}
"""

VIEWS["batch_replies"] = """
SELECT event_id AS request_id,
       '{{"files": [{{"file_path": "a' || cast(event_id AS string) || '.py", "language": "Python", "framework": null, "patterns": ['
       || '{{"pattern_type": "' || event_type || '", "severity": "high", "line_numbers": [10, 11], "confidence": 0.95, "description": "x", "recommendation": "y", "estimated_effort_hours": 2.0}},'
       || '{{"pattern_type": "plain", "severity": "low", "description": "x", "recommendation": "y"}}], "modernization_score": 35, "requires_modernization": true, "overall_priority": "critical"}},'
       || '{{"file_path": "b' || cast(user_id AS string) || '.py", "patterns": []}}]}}' AS response_text
FROM {events}
"""

VIEWS["code_pairs"] = """
SELECT doc_id, 'd' || cast(doc_id % 20 AS string) || '/m' || cast(doc_id AS string) || '.ts' AS file_path,
       '// ' || replace(text, chr(10), ' ') || chr(10)
         || 'export function f1() {{}}' || chr(10) || 'enum E' || cast(doc_id % 3 AS string) || ' {{ A }}' || chr(10)
         || CASE WHEN doc_id % 4 = 0 THEN 'export {{ C1, E0 }};' || chr(10) ELSE '' END
         || CASE WHEN doc_id % 5 = 0 THEN 'const u = import.meta.url;' || chr(10) ELSE '' END
         || CASE WHEN doc_id % 6 = 0 THEN 'await boot();' || chr(10) ELSE '' END
         || CASE WHEN doc_id % 7 = 0 THEN 'module.exports = {{ J1, E1 }};' || chr(10) || 'exports.J2 = 3;' || chr(10) ELSE '' END
         || CASE WHEN doc_id % 9 = 0 THEN 'if (process.argv[1] === x) {{ run(); }}' || chr(10) ELSE '' END
         || 'class C1 {{}}' || chr(10) || 'export const K1 = 1;' || chr(10) AS source_code,
       'import {{ f1, E' || cast(doc_id % 2 AS string) || ', Z9 }} from "./m";' || chr(10)
         || CASE WHEN doc_id % 3 = 0 THEN 'import {{ C1, K1, J2 }} from "./n";' || chr(10) ELSE '' END
         || 'test("x", () => {{ expect(1).toBe(1); }});' AS test_code
FROM {documents}
"""

VIEWS["python_pairs"] = """
SELECT doc_id, 'd' || cast(doc_id % 20 AS string) || '/m' || cast(doc_id AS string) || '.py' AS file_path,
       '# ' || replace(text, chr(10), ' ') || chr(10) || 'def run(x):' || chr(10) || '    return x' || chr(10)
         || CASE WHEN doc_id % 2 = 0 THEN 'class Job:' || chr(10) || '    pass' || chr(10) ELSE '' END
         || CASE WHEN doc_id % 3 = 0 THEN 'LIMIT = 3' || chr(10) ELSE '' END AS source_code,
       'import pytest' || chr(10) || 'from m' || cast((doc_id * 7) % 50 AS string) || ' import run, Job, LIMIT  # names' || chr(10)
         || 'def test_run():' || chr(10) || '    assert run(1) == 1' AS test_code
FROM {documents}
"""

VIEWS["progress"] = """
SELECT user_id AS run_id, event_id AS seq, ts, 'Phase ' || cast(event_id % 6 + 1 AS string) AS phase, event_type AS message
FROM {events}
"""

VIEWS["chunks"] = """
SELECT vec_id AS chunk_id, 'f' || cast(vec_id AS string) || '.py' AS file_path, embedding, label,
       'label ' || cast(label AS string) || ' chunk ' || cast(vec_id AS string) AS text
FROM {embeddings}
"""

#: Modules whose names recur in fifteen packages, with the module paths that they import.
VIEWS["packages"] = """
SELECT concat('p', doc_id % 5, '/q', doc_id % 3, '/m', cast(floor(doc_id / 15) AS bigint) % 40, '_', cast(floor(doc_id / 600) AS bigint), '.py') AS file_path,
       concat('from m', (doc_id * 7) % 40, '_0 import x', chr(10), 'from .m', (doc_id * 3) % 40, '_0 import y', chr(10), 'import q', (doc_id + 1) % 3, '.m', (doc_id * 11) % 40, '_0', chr(10), replace(replace(coalesce(text, ''), 'import', 'export'), 'from', 'form')) AS source_code,
       concat('m', (doc_id * 7) % 40, '_0') AS near, concat('p', doc_id % 5, '/q', doc_id % 3, '/m', (doc_id * 3) % 40, '_0') AS beside, concat('q', (doc_id + 1) % 3, '/m', (doc_id * 11) % 40, '_0') AS other
FROM {documents}
"""

_NAME = re.compile(r"(?<!\{)\{(\w+)\}(?!\})")


def tables(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, or a base table, as a DataFrame."""
    if name not in VIEWS:
        return tables(spark, sf_dir, name)
    text = VIEWS[name]
    inputs = {n: view(spark, sf_dir, n) for n in dict.fromkeys(_NAME.findall(text))}
    return spark.sql(text, **inputs)


def view_sql(name: str) -> str:
    """The same view as plain SQL over the base tables, in brackets."""
    if name not in VIEWS:
        return name
    text = VIEWS[name]
    inputs = {n: view_sql(n) for n in dict.fromkeys(_NAME.findall(text))}
    return "(" + text.strip().format(**inputs) + ")"
