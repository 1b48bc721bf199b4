"""Text functions, replies, checks of code and tests, test logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusaudit import dims
from corpusaudit.catalog.registry import names, query, quoted, v, values
from corpusaudit.functions import text
from corpusaudit.operators import analysis, checks, imports, replies, testlogs
from corpusaudit.session import stored

# The white space of text.SPACES as a RE2 class and as DuckDB characters.
_WS = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in text.SPACES) + "]"
_WS_CHARS = " || ".join(f"chr({ord(c)})" for c in text.SPACES)


def _strip(x: str) -> str:
    return f"trim({x}, {_WS_CHARS})"


def _words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{_WS}+'), lambda w: w <> '')"


@query(
    "text_heads",
    """SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS snippet,
      substr(text, 1, 500) || '...' AS preview500, substr(text, 1, 1000) || '...' AS preview1000,
      length(CASE WHEN length(text) > 8000 THEN substr(text, 1, 8000) || chr(10) || chr(10) || '# ... (truncated)' ELSE text END) AS clipped,
      length(substr(text, 1, CASE WHEN length(text) > 6000 THEN 4000 ELSE 6000 END)) AS adaptive,
      length(substr(text, 1, CASE WHEN doc_id % 4 > 2 THEN 2000 ELSE 3000 END)) AS per_batch FROM documents""",
)
def _(read):
    c = F.col("text")
    return read("documents").select(
        "doc_id",
        text.snippet(c).alias("snippet"),
        text.preview(c, 500).alias("preview500"),
        text.preview(c, 1000).alias("preview1000"),
        F.length(text.clip_marked(c)).alias("clipped"),
        F.length(text.adaptive_head(c)).alias("adaptive"),
        F.length(text.batch_head(c, F.col("doc_id") % 4)).alias("per_batch"),
    )


@query(
    "truncate_words",
    f"""SELECT doc_id, CASE WHEN len(w) > 250 THEN array_to_string(w[1:250], ' ') ELSE text END AS kept
    FROM (SELECT doc_id, text, {_words('text')} AS w FROM documents) x""",
)
def _(read):
    return read("documents").select("doc_id", text.truncate_words(F.col("text")).alias("kept"))


def _untag(block: str, tags: list[str], fold: bool) -> str:
    first = _strip(f"regexp_extract({block}, '^[^\\n]*')")
    tag = f"lower({first})" if fold else first
    rest = f"CASE WHEN contains({block}, chr(10)) THEN substr({block}, strpos({block}, chr(10)) + 1) ELSE '' END"
    return _strip(f"CASE WHEN {tag} IN ({names(tags)}) THEN {rest} ELSE {block} END")


@query(
    "first_code_block",
    f"""SELECT conv_id, turn, CASE WHEN len(p) >= 3 THEN {_untag('p[2]', text.FIRST_BLOCK_TAGS, False)}
      WHEN len(p) = 2 THEN {_strip('p[1]')} ELSE {_strip('reply')} END AS code
    FROM (SELECT *, string_split(reply, '```') AS p FROM {v('exchanges')}) x""",
)
def _(read):
    return read("exchanges").select("conv_id", "turn", text.first_code_block(F.col("reply")).alias("code"))


@query(
    "largest_code_block",
    f"""WITH parts AS (SELECT conv_id, turn, unnest(string_split(reply, '```')) AS part,
        generate_subscripts(string_split(reply, '```'), 1) AS n FROM {v('exchanges')}),
      blocks AS (SELECT conv_id, turn, n, {_untag('part', text.LARGEST_BLOCK_TAGS, True)} AS block FROM parts WHERE n % 2 = 0),
      best AS (SELECT conv_id, turn, arg_max(block, (length(block), -n)) AS block FROM blocks WHERE length(block) > 50 GROUP BY ALL)
    SELECT e.conv_id, e.turn, coalesce(b.block, CASE WHEN {' OR '.join(f"starts_with({_strip('e.reply')}, {quoted(s)})" for s in text.CODE_STARTS)}
      THEN {_strip('e.reply')} ELSE '' END) AS code FROM {v('exchanges').rsplit(' ', 1)[0]} e LEFT JOIN best b USING (conv_id, turn)""",
)
def _(read):
    return read("exchanges").select("conv_id", "turn", text.largest_code_block(F.col("reply")).alias("code"))


@query(
    "truncated_output",
    f"""SELECT doc_id, length(text) > 1000 AND right(rtrim(text, {_WS_CHARS}), 1) NOT IN (')', '}}', ']', '"', '''')
      AND NOT (contains(tail, 'if __name__') OR contains(tail, 'main()') OR contains(tail, 'return')) AS truncated
    FROM (SELECT doc_id, text, array_to_string(l[greatest(len(l) - 4, 1):], chr(10)) AS tail
          FROM (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents) a) b""",
)
def _(read):
    return read("documents").select("doc_id", text.looks_truncated(F.col("text")).alias("truncated"))


_SECRETS = ["license", "example.com", "the", "information"]


@query(
    "redact",
    "SELECT doc_id, replace(replace(replace(text, 'license', '[REDACTED]'), 'example.com', '[REDACTED]'), 'information', '[REDACTED]') AS text FROM documents",
)
def _(read):
    """Known values are replaced in whole texts; the short one is left alone."""
    return read("documents").select("doc_id", text.redact(F.col("text"), _SECRETS).alias("text"))


def _masked(c: str) -> str:
    for form in text.SECRET_FORMS:
        c = f"regexp_replace({c}, {quoted(form)}, '[REDACTED]', 'g')"
    return c


@query("redact_forms", f"SELECT doc_id, {_masked('text')} AS text FROM documents")
def _(read):
    """Whatever looks like a token or a key, in whole texts."""
    return read("documents").select("doc_id", text.redact(F.col("text"), forms=text.SECRET_FORMS).alias("text"))


_ADDRESS = "[a-z]+[.][0-9]+@[a-z0-9.]+[a-z0-9]"


@query("redact_known", f"SELECT doc_id, regexp_replace(text, '{_ADDRESS}', '[REDACTED]', 'g') AS text FROM documents")
def _(read):
    """All addresses that occur anywhere, taken as a table of secrets, in whole texts."""
    documents = read("documents").select("doc_id", "text")
    found = F.explode(F.regexp_extract_all("text", F.lit(_ADDRESS), F.lit(0)))
    return text.redact_all(documents, "text", documents.select(found.alias("secret")))


_NAMES = "[a-z]+[.][0-9]+"


@query(
    "redact_in_blocks",
    f"SELECT doc_id, regexp_replace(text, '{_NAMES}(@[a-z0-9.]+[a-z0-9])?', '[REDACTED]', 'g') AS text FROM documents",
)
def _(read):
    """Addresses and the names that they begin with, in ten blocks of a filter: a name alone goes, an address goes whole."""
    documents = read("documents").select("doc_id", "text")
    found = F.explode(F.array_union(F.regexp_extract_all("text", F.lit(_ADDRESS), F.lit(0)), F.regexp_extract_all("text", F.lit(_NAMES), F.lit(0))))
    secrets = stored(documents.select(found.alias("secret")).distinct(), "found")
    return text.redact_all(documents, "text", secrets, block=max(1, -(-secrets.count() // 10)))


@query(
    "text_severity",
    """SELECT doc_id, CASE WHEN contains(t, 'critical') THEN 'critical' WHEN contains(t, 'high') THEN 'high'
      WHEN contains(t, 'medium') OR contains(t, 'moderate') THEN 'medium' WHEN contains(t, 'low') THEN 'low' ELSE 'unknown' END AS severity
    FROM (SELECT doc_id, lower(text) AS t FROM documents) x""",
)
def _(read):
    return read("documents").select("doc_id", text.extract_severity(F.col("text")).alias("severity"))


# -- replies -----------------------------------------------------------------
@query(
    "parse_replies",
    """SELECT request_id, CASE request_id % 5 WHEN 1 THEN 'missing field' WHEN 2 THEN 'missing field' WHEN 3 THEN 'empty reply' WHEN 4 THEN 'malformed JSON' END AS error,
      CASE request_id % 5 WHEN 0 THEN 'high' END AS priority, CASE WHEN request_id % 5 = 0 THEN (response_text::JSON->>'modernization_score')::DOUBLE END AS score
    FROM (SELECT request_id, CASE WHEN request_id % 5 IN (3, 4) THEN '{}' ELSE response_text END AS response_text FROM """
    + v("replies")
    + ") x",
)
def _(read):
    parsed = replies.parse_replies(read("replies"), "patterns")
    return parsed.select(
        "request_id",
        "error",
        F.col("reply.overall_priority").alias("priority"),
        F.col("reply.modernization_score").alias("score"),
    )


_SHAPES = """SELECT event_id AS request_id,
  CASE event_id % 3 WHEN 0 THEN '{{"language": "Go", "framework": null, "confidence": 0.5, "classification": "test", "reasoning": "r", "summary": "s", "issues": [{{"type": "t", "severity": "high", "description": "d", "line_numbers": [1], "recommendation": "r"}}], "transformation_steps": [], "dependencies": [], "estimated_total_hours": 2, "test_framework": "pytest", "test_count": 3, "coverage_areas": [], "test_types": ["unit"], "notes": ""}}'
   WHEN 1 THEN '{{"language": "Go", "confidence": 0.5, "classification": "other", "reasoning": "r", "summary": "s", "issues": [{{"severity": "urgent"}}], "transformation_steps": [], "dependencies": [], "estimated_total_hours": 2, "test_framework": "pytest", "test_count": 3, "coverage_areas": [], "test_types": ["load"], "notes": ""}}'
   ELSE '{{"framework": "x"}}' END AS response_text FROM {events}"""


@query(
    "parse_reply_shapes",
    """SELECT event_id AS request_id, s.shape, CASE event_id % 3 WHEN 0 THEN NULL
      WHEN 1 THEN CASE s.shape WHEN 'language' THEN NULL ELSE 'value outside enum' END ELSE 'missing field' END AS error
    FROM events, (VALUES ('language'), ('classification'), ('analysis'), ('tests')) s(shape)
    UNION ALL SELECT event_id, s.shape, 'missing field' FROM events, (VALUES ('patterns'), ('batch')) s(shape)""",
)
def _(read):
    """All reply shapes, each checked for required fields and enums."""
    events = read("events")
    rows = events.sparkSession.sql(_SHAPES, events=events)
    parsed = [
        replies.parse_replies(rows, shape).select("request_id", F.lit(shape).alias("shape"), "error")
        for shape in ("language", "classification", "analysis", "tests", "patterns", "batch")
    ]
    return reduce(DataFrame.unionByName, parsed)


@query(
    "reply_analyses",
    """SELECT request_id, file_path, CASE request_id % 5 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'info' END AS overall_priority,
      CASE request_id % 5 WHEN 0 THEN 40.0 WHEN 1 THEN 80.0 ELSE 100.0 END::DOUBLE AS modernization_score,
      request_id % 5 < 2 AS requires_modernization, CASE WHEN request_id % 5 < 2 THEN 1 ELSE 0 END::BIGINT AS n_patterns,
      CASE request_id % 5 WHEN 0 THEN 0.5 WHEN 1 THEN 0.8 END::DOUBLE AS confidence,
      CASE request_id % 5 WHEN 0 THEN 2.5 WHEN 1 THEN 1.0 END::DOUBLE AS effort FROM """
    + v("replies"),
)
def _(read):
    """Defaults for good replies, the neutral analysis for bad ones."""
    rows = replies.analyses_from_replies(read("replies"))
    first = F.get("patterns", F.lit(0))
    return rows.select(
        "request_id", "file_path", "overall_priority", "modernization_score", "requires_modernization",
        F.size("patterns").alias("n_patterns"), first["confidence"].alias("confidence"),
        first["estimated_effort_hours"].alias("effort"),
    )


@query(
    "pattern_defaults",
    """SELECT event_id, coalesce((props::JSON->>'confidence')::DOUBLE, 0.8)::DOUBLE AS confidence,
      coalesce((props::JSON->>'k')::DOUBLE, 1.0) AS estimated_effort_hours, 'Unknown' AS language, 50.0::DOUBLE AS modernization_score FROM events""",
)
def _(read):
    schema = "confidence double, k double, language string, score double"
    parsed = read("events").select("event_id", F.from_json("props", schema).alias("p")).select(
        "event_id", "p.confidence", F.col("p.k").alias("estimated_effort_hours"), "p.language", F.col("p.score").alias("modernization_score")
    )
    return analysis.fill_pattern_defaults(parsed)


@query(
    "explode_batch",
    """SELECT event_id AS request_id, f.path AS file_path, f.language, f.pattern_type, f.severity, f.confidence, f.effort AS estimated_effort_hours,
      f.lines AS line_numbers, f.priority AS overall_priority, f.score AS modernization_score FROM events, LATERAL (VALUES
      ('a' || event_id || '.py', 'Python', event_type, 'high', 0.95::DOUBLE, 2.0::DOUBLE, '10,11', 'critical', 35.0::DOUBLE),
      ('a' || event_id || '.py', 'Python', 'plain', 'low', 0.8::DOUBLE, 1.0::DOUBLE, '', 'critical', 35.0::DOUBLE),
      ('b' || user_id || '.py', 'Unknown', NULL, NULL, NULL, NULL, NULL, 'medium', 50.0::DOUBLE)) f(path, language, pattern_type, severity, confidence, effort, lines, priority, score)""",
)
def _(read):
    rows = replies.explode_batch(read("batch_replies"))
    return rows.select(
        "request_id", "file_path", "language", "pattern_type", "severity", "confidence", "estimated_effort_hours",
        F.array_join("line_numbers", ",").alias("line_numbers"), "overall_priority", "modernization_score",
    )


@query(
    "normalise_category",
    f"""SELECT file_path, CASE WHEN file_id % 4 = 3 THEN 'skip' ELSE CASE WHEN c IN ({names(dims.CATEGORIES)}) THEN c ELSE 'skip' END END AS category
    FROM (SELECT file_path, file_id, CASE overall_priority WHEN 'critical' THEN 'modernize_high' WHEN 'high' THEN 'modernize_low' WHEN 'low' THEN 'primary' ELSE 'skip' END AS c FROM {v('analyses')}) x""",
)
def _(read):
    """Every fourth file got no reply; some replies name an unknown category."""
    a = read("analyses")
    p = F.col("overall_priority")
    category = F.when(p == "critical", "modernize_high").when(p == "high", "modernize_low").when(p == "low", "primary").otherwise("skip")
    answered = a.filter(F.col("file_id") % 4 != 3).select("file_path", category.alias("category"))
    return analysis.normalise_category(answered, a).select("file_path", "category")


# -- code and tests ------------------------------------------------------------
_PAIRS = v("code_pairs")
_IMPORTS = f"""imports AS (SELECT DISTINCT doc_id, {_strip('unnest(string_split(g, chr(44)))')} AS name FROM
  (SELECT doc_id, unnest(regexp_extract_all(test_code, 'import\\s+\\{{([^}}]+)\\}}\\s+from\\s+["'']\\./', 1)) AS g FROM {_PAIRS}) a)"""


def _names_sql(regex: str, source: str = "source_code") -> str:
    return f"SELECT doc_id, unnest(regexp_extract_all({source}, '{regex}', 1)) AS name FROM {_PAIRS}"


_LISTED = """SELECT doc_id, unnest(regexp_extract_all(g, '\\w+')) FROM (SELECT doc_id, unnest(regexp_extract_all(source_code, '{regex}', 1)) AS g FROM {pairs}) b"""
_TS_EXPORTS = f"""exported AS ({_names_sql('export\\s+(?:function|class|enum|interface|type)\\s+(\\w+)')}
  UNION {_LISTED.format(regex='export\\s+\\{([^}]*)\\}', pairs=_PAIRS)} UNION {_names_sql('export\\s+const\\s+(\\w+)\\s*=')})"""
_JS_EXPORTS = f"""exported AS ({_names_sql('export\\s+(?:function|class|const|let|var)\\s+(\\w+)')}
  UNION {_LISTED.format(regex='export\\s+\\{([^}]*)\\}', pairs=_PAIRS)} UNION {_LISTED.format(regex='module\\.exports\\s*=\\s*\\{([^}]*)\\}', pairs=_PAIRS)}
  UNION {_names_sql('exports\\.(\\w+)\\s*=')})"""
_TS_DECLARED = f"""declared AS ({_names_sql('\\b(?:function|class|enum|interface|type)\\s+(\\w+)')} UNION {_names_sql('\\bconst\\s+(\\w+)\\s*=')})"""


@query(
    "missing_exports_ts",
    f"""WITH {_IMPORTS}, {_TS_EXPORTS}, {_TS_DECLARED}, missing AS (SELECT * FROM imports EXCEPT SELECT * FROM exported)
    SELECT doc_id, CASE WHEN (doc_id, name) IN (SELECT (doc_id, name) FROM declared) THEN 'not_exported' ELSE 'not_found' END AS kind, name,
      CASE WHEN (doc_id, name) IN (SELECT (doc_id, name) FROM declared) THEN '''' || name || {quoted(checks.NOT_EXPORTED)}
           ELSE '''' || name || {quoted(checks.NOT_FOUND)} END AS message FROM missing""",
)
def _(read):
    checked = checks.check_pairs(read("code_pairs"), checks.ts_export_issues(F.col("source_code"), F.col("test_code")))
    return checks.issue_rows(checked, "doc_id")


@query(
    "missing_exports_js",
    f"""WITH {_IMPORTS}, {_JS_EXPORTS} SELECT doc_id, 'js_not_exported' AS kind, name, '''' || name || {quoted(checks.JS_NOT_EXPORTED)} AS message
    FROM (SELECT * FROM imports EXCEPT SELECT * FROM exported) m""",
)
def _(read):
    checked = checks.check_pairs(read("code_pairs"), checks.js_export_issues(F.col("source_code"), F.col("test_code")))
    return checks.issue_rows(checked, "doc_id")


def _missing_py(bare: bool) -> str:
    pairs = v("python_pairs")
    plain = f"UNION SELECT doc_id, unnest(regexp_extract_all(test_code, 'import\\s+(\\w+)', 1)) FROM {pairs}" if bare else ""
    return f"""WITH imports AS (SELECT doc_id, {_strip('unnest(string_split(g, chr(44)))')} AS name FROM
        (SELECT doc_id, unnest(regexp_extract_all(test_code, 'from\\s+\\w+\\s+import\\s+([^#\\n]+)', 1)) AS g FROM {pairs}) a {plain}),
      defined AS (SELECT doc_id, unnest(regexp_extract_all(source_code, '(?m)^def\\s+(\\w+)\\s*\\(', 1)) AS name FROM {pairs}
        UNION SELECT doc_id, unnest(regexp_extract_all(source_code, '(?m)^class\\s+(\\w+)', 1)) FROM {pairs}
        UNION SELECT doc_id, unnest(regexp_extract_all(source_code, '(?m)^(\\w+)\\s*=', 1)) FROM {pairs})
      SELECT doc_id, name FROM (SELECT * FROM imports EXCEPT SELECT * FROM defined) m"""


@query("missing_defs_py", _missing_py(True))
def _(read):
    checked = checks.check_pairs(read("python_pairs"), checks.py_definition_issues(F.col("source_code"), F.col("test_code")))
    return checks.issue_rows(checked, "doc_id").select("doc_id", "name")


@query("missing_from_imports_py", _missing_py(False))
def _(read):
    issues = checks.py_definition_issues(F.col("source_code"), F.col("test_code"), bare=False)
    return checks.issue_rows(checks.check_pairs(read("python_pairs"), issues), "doc_id").select("doc_id", "name")


_MODULE = f"""SELECT doc_id, 'import_meta' AS kind FROM {_PAIRS} WHERE contains(source_code, 'import.meta')
  UNION ALL SELECT doc_id, 'top_level_await' FROM {_PAIRS} WHERE regexp_matches(source_code, '(?m)\\btop-level\\s+await\\b|^await\\s+')
  UNION ALL SELECT doc_id, 'cli_block' FROM {_PAIRS} WHERE contains(source_code, 'process.argv[1]') OR contains(source_code, 'if (require.main === module)')"""


@query("module_system_issues", _MODULE)
def _(read):
    checked = checks.check_pairs(read("code_pairs"), checks.module_issues(F.col("source_code")))
    return checks.issue_rows(checked, "doc_id").select("doc_id", "kind")


@query(
    "validate_code",
    f"""WITH {_IMPORTS}, {_TS_EXPORTS}, missing AS (SELECT * FROM imports EXCEPT SELECT * FROM exported),
      found AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id FROM missing UNION ALL SELECT doc_id FROM ({_MODULE})) GROUP BY doc_id)
    SELECT p.doc_id, 'typescript' AS language, coalesce(n, 0) AS n_issues, coalesce(n, 0) = 0 AS is_valid FROM {_PAIRS.rsplit(' ', 1)[0]} p LEFT JOIN found USING (doc_id)
    UNION ALL SELECT doc_id, 'rust', 0, true FROM documents""",
)
def _(read):
    pairs = read("code_pairs").withColumn("language", F.explode(F.array(F.lit("typescript"), F.lit("rust"))))
    return checks.validate_code(pairs).select("doc_id", "language", F.size("issues").alias("n_issues"), "is_valid")


_E = "regexp_replace({0}, '(\\n)({1}\\s+{2}\\b)', '\\1export \\2', 'g')"


@query(
    "validate_and_fix",
    f"""SELECT doc_id, fixed AS fixed_code FROM (
      SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN e1 WHEN doc_id % 3 = 0 THEN regexp_replace(e1, '(\\n)(class\\s+C1\\b)', '\\1export \\2', 'g') ELSE e1 END AS fixed FROM (
        SELECT doc_id, CASE WHEN doc_id % 3 = doc_id % 2 AND NOT (doc_id % 4 = 0 AND doc_id % 2 = 0)
            THEN regexp_replace(cut, '(\\n)(enum\\s+E' || (doc_id % 2) || '\\b)', '\\1export \\2', 'g') ELSE cut END AS e1 FROM (
          SELECT doc_id, CASE WHEN contains(m, 'process.argv[1]') THEN regexp_replace(m, '(?s)\\nif \\(process\\.argv\\[1\\].*?\\{{[^}}]*\\}}', '', 'g') ELSE m END AS cut
          FROM (SELECT doc_id, regexp_replace(source_code, '.*import\\.meta.*\\n', '', 'g') AS m FROM {_PAIRS}) a) b) c) d""",
)
def _(read):
    """TypeScript sources after the fixes that the checks ask for."""
    pairs = read("code_pairs").withColumn("language", F.lit("TypeScript"))
    return checks.validate_and_fix(pairs).select("doc_id", "fixed_code")


@query(
    "remaining_issues",
    f"""SELECT doc_id, 'not_found' AS kind, name FROM (
        SELECT doc_id, unnest(['E' || (doc_id % 2), 'Z9']) AS name FROM documents
        UNION ALL SELECT doc_id, 'J2' FROM documents WHERE doc_id % 3 = 0) x
      WHERE name <> 'E' || (doc_id % 3) AND NOT (name = 'E0' AND doc_id % 4 = 0)
    UNION ALL SELECT doc_id, 'top_level_await', NULL FROM {_PAIRS} WHERE doc_id % 6 = 0""",
)
def _(read):
    """Issues left after fixing: names that exist nowhere and top-level await."""
    pairs = read("code_pairs").withColumn("language", F.lit("typescript"))
    return checks.issue_rows(checks.validate_and_fix(pairs), "doc_id").select("doc_id", "kind", "name")


_SRC = v("sources")


@query(
    "required_packages",
    f"""WITH l AS (SELECT file_path, extension, {_strip('unnest(string_split(content, chr(10)))')} AS line, generate_subscripts(string_split(content, chr(10)), 1) AS n FROM {_SRC}),
      used AS (SELECT file_path, split_part({_words('line')}[2], '.', 1) AS package, n, 0 AS o FROM l WHERE extension = '.py' AND (starts_with(line, 'import ') OR starts_with(line, 'from '))
        UNION ALL SELECT file_path, p.package, n, p.o FROM l JOIN {values([(p, i) for i, p in enumerate(dims.SCRIPT_PACKAGES)], 'p(package, o)')}
          ON contains(line, '''' || p.package || '''') OR contains(line, '"' || p.package || '"') WHERE extension IN ('.js', '.ts')),
      firsts AS (SELECT file_path, package, min((n, o)) AS f FROM used WHERE package IN ({names(dims.PYTHON_PACKAGES + dims.SCRIPT_PACKAGES)}) GROUP BY ALL)
    SELECT file_path, row_number() OVER (PARTITION BY file_path ORDER BY f) - 1 AS ord, package FROM firsts""",
)
def _(read):
    language = dims.language_of(F.col("extension"), "runner")
    files = read("sources").select("file_path", "content", language.alias("language"))
    return checks.required_packages(files).drop("language")


_PY = v("python_pairs")


@query(
    "import_degrees",
    f"""WITH files AS (SELECT doc_id, file_path, 'm' || doc_id AS module FROM {_PY}),
      edges AS (SELECT DISTINCT file_path, unnest(['pytest', 'm' || ((doc_id * 7) % 50)]) AS module FROM files)
    SELECT f.file_path, (SELECT count(*) FROM edges e JOIN files g ON g.module = e.module WHERE e.file_path = f.file_path) AS depends_on,
      (SELECT count(*) FROM edges e WHERE e.module = f.module) AS depended_on_by FROM files f""",
)
def _(read):
    """Dependencies between the test modules and the sources they import."""
    return checks.import_degrees(read("python_pairs").select("file_path", "test_code"), "test_code")


@query(
    "resolved_imports",
    f"""WITH files AS (SELECT * FROM {v('packages')}), modules AS (SELECT file_path AS target, regexp_replace(file_path, '[.]py$', '') AS module FROM files),
      wanted AS (SELECT file_path, near AS want FROM files UNION ALL SELECT file_path, other FROM files),
      found AS (SELECT w.file_path, w.want, m.target, row_number() OVER (PARTITION BY w.file_path, w.want ORDER BY
          CASE WHEN split_part(w.file_path, '/', 1) <> split_part(m.target, '/', 1) THEN 0 WHEN split_part(w.file_path, '/', 2) <> split_part(m.target, '/', 2) THEN 1 ELSE 2 END DESC,
          length(m.target), m.target) AS place FROM wanted w JOIN modules m ON m.module = w.want OR ends_with(m.module, '/' || w.want))
    SELECT file_path, target FROM (SELECT file_path, target FROM found WHERE place = 1 UNION SELECT file_path, target FROM files JOIN modules ON module = beside) x WHERE file_path <> target""",
)
def _(read):
    """Modules whose names recur in fifteen packages: each import means the nearest."""
    return imports.resolved_imports(read("packages").select("file_path", "source_code"))


_TESTED = f"""(SELECT doc_id, test_code AS t, 'javascript' AS language FROM {_PAIRS} UNION ALL SELECT doc_id, test_code, 'python' FROM {_PY}
  UNION ALL SELECT doc_id, source_code, 'java' FROM {_PAIRS} UNION ALL SELECT doc_id, text, 'python' FROM documents) x"""


def _tests(read):
    pairs, python, docs = read("code_pairs"), read("python_pairs"), read("documents")
    parts = [
        pairs.select("doc_id", "test_code", F.lit("javascript").alias("language")),
        python.select("doc_id", "test_code", F.lit("python").alias("language")),
        pairs.select("doc_id", F.col("source_code").alias("test_code"), F.lit("java").alias("language")),
        docs.select("doc_id", F.col("text").alias("test_code"), F.lit("python").alias("language")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(
    "valid_tests",
    f"""SELECT doc_id, language, reason, reason IS NULL AS is_valid FROM (SELECT doc_id, language, CASE language
      WHEN 'python' THEN CASE WHEN NOT contains(t, 'def test_') AND NOT contains(t, 'class Test') THEN {quoted(checks.PY_NO_TESTS)}
        WHEN NOT contains(t, 'import') THEN {quoted(checks.PY_NO_IMPORTS)} END
      WHEN 'java' THEN CASE WHEN NOT contains(t, '@Test') THEN {quoted(checks.JAVA_NO_TESTS)} WHEN NOT contains(t, 'org.junit') THEN {quoted(checks.JAVA_NO_JUNIT)}
        WHEN NOT contains(t, 'class') THEN {quoted(checks.JAVA_NO_CLASS)} END
      ELSE CASE WHEN NOT contains(t, 'describe(') AND NOT contains(t, 'test(') AND NOT contains(t, 'it(') THEN {quoted(checks.JS_NO_TESTS)}
        WHEN NOT contains(t, 'import') AND NOT contains(t, 'require') THEN {quoted(checks.JS_NO_IMPORTS)} WHEN NOT contains(t, 'expect(') THEN {quoted(checks.JS_NO_EXPECT)} END
      END AS reason FROM {_TESTED}) y""",
)
def _(read):
    """Test texts judged by content; the Python ones here all compile or hold no test."""
    return checks.valid_tests(_tests(read)).select("doc_id", "language", "reason", "is_valid")


@query(
    "accepted_tests",
    f"SELECT doc_id, language, NOT (length({_strip('t')}) < 100 OR (language = 'python' AND NOT contains(t, 'def test_'))) AS accepted FROM {_TESTED}",
)
def _(read):
    return checks.accepted_tests(_tests(read)).select("doc_id", "language", "accepted")


@query(
    "main_class",
    f"""SELECT doc_id, CASE WHEN regexp_matches(content, 'public\\s+class\\s+\\w+') THEN regexp_extract(content, 'public\\s+class\\s+(\\w+)', 1)
      ELSE 'My' || 'File' || doc_id END AS main_class FROM {_SRC}""",
)
def _(read):
    module = F.concat(F.lit("my_fILE"), F.col("doc_id").cast("string"))
    return read("sources").select("doc_id", checks.main_class(F.col("content"), module).alias("main_class"))


# -- test logs -----------------------------------------------------------------
_LOGS = v("logs")


def _num(c: str, regex: str, group: int = 1) -> str:
    return f"coalesce(try_cast(regexp_extract({c}, '{regex}', {group}) AS BIGINT), 0)"


def _cnt(needle: str) -> str:
    return f"((length(stdout) - length(replace(stdout, {needle}, ''))) // length({needle}))"


def _pytest(cols: str) -> str:
    return f"""SELECT file_id, run_id, {cols} FROM (SELECT *, p + f + e + s AS r FROM (SELECT *, {_num('sm', '(\\d+)\\s+passed')} AS p, {_num('sm', '(\\d+)\\s+failed')} AS f,
    {_num('sm', '(\\d+)\\s+error')} AS e, {_num('sm', '(\\d+)\\s+skipped')} AS s FROM
    (SELECT *, regexp_extract(stdout, '=+\\s*(.*?)\\s+in\\s+[\\d.]+s\\s*=+', 1) AS sm FROM {_LOGS}) a) b) c"""


_FALL = {w: _cnt(f"(' {w}' || chr(10))") for w in ("PASSED", "FAILED", "ERROR", "SKIPPED")}


def _counts(read, column):
    return read("logs").select("file_id", "run_id", column.alias("c")).select("file_id", "run_id", "c.*")


@query(
    "parse_pytest",
    _pytest(
        f"CASE WHEN r > 0 THEN r ELSE {_FALL['PASSED']} + {_FALL['FAILED']} + {_FALL['ERROR']} END AS tests_run, "
        + ", ".join(
            f"CASE WHEN r > 0 THEN {x} ELSE {_FALL[w]} END AS {n}"
            for x, w, n in [
                ("p", "PASSED", "tests_passed"), ("f", "FAILED", "tests_failed"),
                ("e", "ERROR", "tests_errors"), ("s", "SKIPPED", "tests_skipped"),
            ]
        )
    ),
)
def _(read):
    return _counts(read, testlogs.pytest_counts(F.col("stdout")))


@query(
    "parse_pytest_simple",
    f"""SELECT file_id, run_id, p + f + e AS tests_run, p AS tests_passed, f AS tests_failed, e AS tests_errors, 0::BIGINT AS tests_skipped
    FROM (SELECT *, {_cnt("' PASSED'")} AS p, {_cnt("' FAILED'")} AS f, {_cnt("' ERROR'")} AS e FROM {_LOGS}) x""",
)
def _(read):
    return _counts(read, testlogs.pytest_simple_counts(F.col("stdout")))


@query(
    "log_coverage",
    f"""SELECT file_id, run_id, coalesce(try_cast(regexp_extract(stdout, 'TOTAL\\s+\\d+\\s+\\d+\\s+\\d+\\s+\\d+\\s+(\\d+)%', 1) AS DOUBLE),
        try_cast(regexp_extract(stdout, 'TOTAL.*?(\\d+)%', 1) AS DOUBLE), 0) AS python, {_num('coverage_html', 'Total.*?(\\d+)%')}::DOUBLE AS java,
      coalesce(try_cast(regexp_extract(stdout, 'All files\\s*\\|\\s*([\\d.]+)', 1) AS DOUBLE), 0) AS script FROM {_LOGS}""",
)
def _(read):
    out = F.col("stdout")
    return read("logs").select(
        "file_id", "run_id", testlogs.coverage_py(out).alias("python"),
        testlogs.jacoco_coverage(F.col("coverage_html")).alias("java"), testlogs.jest_coverage(out).alias("script"),
    )


_SURE = "Tests run: (\\d+),\\s*Failures: (\\d+),\\s*Errors: (\\d+),\\s*Skipped: (\\d+)"


@query(
    "parse_surefire",
    f"""SELECT file_id, run_id, r AS tests_run, r - (f + e) - s AS tests_passed, f + e AS tests_failed, e AS tests_errors, s AS tests_skipped FROM
    (SELECT *, {_num('stdout', _SURE, 1)} AS r, {_num('stdout', _SURE, 2)} AS f, {_num('stdout', _SURE, 3)} AS e, {_num('stdout', _SURE, 4)} AS s FROM {_LOGS}) x""",
)
def _(read):
    return _counts(read, testlogs.surefire_counts(F.col("stdout")))


_BUILD = f"""CASE WHEN contains(stdout, 'COMPILATION ERROR') THEN {quoted(testlogs.COMPILATION_FAILED)} WHEN contains(stdout, 'BUILD FAILURE')
  THEN coalesce({_strip("list_filter(string_split(stdout, chr(10)), lambda l: contains(l, '[ERROR]') AND NOT contains(l, 'Failed to execute goal'))[1]")}, {quoted(testlogs.BUILD_FAILED)}) END"""
_JAVA_ERROR = f"coalesce({_BUILD}, CASE WHEN NOT regexp_matches(stdout, '{_SURE}') AND exit_code = 0 THEN {quoted(testlogs.NO_TESTS)} END)"


@query(
    "build_failures",
    f"SELECT file_id, run_id, {_BUILD} AS failure, {_JAVA_ERROR} AS error FROM {_LOGS}",
)
def _(read):
    out, err = F.col("stdout"), F.lit("")
    return read("logs").select(
        "file_id", "run_id", testlogs.build_failure(out, err).alias("failure"),
        testlogs.surefire_error(out, err, F.col("exit_code")).alias("error"),
    )


_JEST = f"""(SELECT *, CASE WHEN r > 0 AND p = 0 AND f = 0 THEN r - f - s ELSE p END AS pp FROM (SELECT *, {_num('tl', '(\\d+)\\s+total')} AS r, {_num('tl', '(\\d+)\\s+passed')} AS p,
   {_num('tl', '(\\d+)\\s+failed')} AS f, {_num('tl', '(\\d+)\\s+skipped')} AS s FROM (SELECT *, regexp_extract(stdout, 'Tests:\\s+(.+)', 1) AS tl FROM {_LOGS}) a) b) c"""


@query(
    "parse_jest",
    f"""SELECT file_id, run_id, r AS tests_run, pp AS tests_passed, f AS tests_failed, s AS tests_skipped,
      CASE WHEN contains(stdout, 'Test Suites: ') AND contains(stdout, ' failed') AND regexp_matches(stdout, 'Test Suites:\\s+\\d+\\s+failed') AND r = 0 THEN {quoted(testlogs.SUITE_FAILED)} END AS error FROM {_JEST}""",
)
def _(read):
    rows = read("logs").select(
        "file_id", "run_id", testlogs.jest_counts(F.col("stdout")).alias("c"), testlogs.jest_error(F.col("stdout")).alias("error")
    )
    return rows.select("file_id", "run_id", "c.tests_run", "c.tests_passed", "c.tests_failed", "c.tests_skipped", "error")


@query(
    "parse_jest_json",
    f"""SELECT file_id, run_id, CASE WHEN j THEN 4 ELSE 1 END::BIGINT AS tests_run, CASE WHEN j THEN 3 WHEN exit_code = 0 THEN 1 ELSE 0 END::BIGINT AS tests_passed,
      CASE WHEN j THEN 1 WHEN exit_code = 0 THEN 0 ELSE 1 END::BIGINT AS tests_failed, CASE WHEN j THEN false ELSE exit_code = 0 END AS success
    FROM (SELECT *, contains(stdout, 'numTotalTests') AS j FROM {_LOGS}) x""",
)
def _(read):
    out, code = F.col("stdout"), F.col("exit_code")
    rows = read("logs").select(
        "file_id", "run_id", testlogs.jest_json_counts(out, code).alias("c"), testlogs.jest_json_success(out, code).alias("success")
    )
    return rows.select("file_id", "run_id", "c.tests_run", "c.tests_passed", "c.tests_failed", "success")


@query(
    "exit_code_results",
    f"""SELECT file_path, language, 1::BIGINT AS tests_run, CASE WHEN exit_code = 0 THEN 1 ELSE 0 END::BIGINT AS tests_passed,
      CASE WHEN exit_code = 0 THEN 0 ELSE 1 END::BIGINT AS tests_failed FROM {v('validations')}""",
)
def _(read):
    rows = read("validations").select("file_path", "language", testlogs.exit_code_counts(F.col("exit_code")).alias("c"))
    return rows.select("file_path", "language", "c.tests_run", "c.tests_passed", "c.tests_failed")


def _with_stderr(read):
    return read("logs").withColumn("stderr", F.lit(""))


_UNSUPPORTED = f"'Unsupported language: ' || language || {quoted('. ' + testlogs.UNSUPPORTED)}"
_SCRIPT_ERROR = f"CASE WHEN regexp_matches(stdout, 'Test Suites:\\s+\\d+\\s+failed') AND r = 0 THEN {quoted(testlogs.SUITE_FAILED)} END"


# What each log says, from the numbers that it was made of (p passed, f failed), not from its text.
_TOLD = f"""(SELECT *, CASE WHEN language = 'ruby' THEN {_UNSUPPORTED}
      WHEN language = 'java' AND f = 2 THEN '[ERROR] missing symbol ' || p WHEN language = 'java' AND p = 7 THEN {quoted(testlogs.COMPILATION_FAILED)}
      WHEN language = 'java' AND p = 8 AND exit_code = 0 THEN {quoted(testlogs.NO_TESTS)}
      WHEN language IN ('javascript', 'typescript') AND p = 9 THEN {quoted(testlogs.SUITE_FAILED)} END AS error,
      CASE WHEN language = 'python' THEN 'py' WHEN language = 'java' AND f < 2 AND p NOT IN (7, 8) THEN 'full' WHEN language = 'java' AND f < 2 AND p = 8 THEN 'empty'
        WHEN language IN ('javascript', 'typescript') AND p NOT IN (9, 10, 11) THEN 'full' WHEN language IN ('javascript', 'typescript') AND p = 11 THEN 'total' END AS kind
    FROM (SELECT *, told_passed AS p, told_failed AS f FROM {_LOGS}) l) t"""


@query(
    "normalise_validations",
    f"""SELECT file_id, run_id, language, exit_code = 0 AND error IS NULL AS success,
      CASE WHEN kind = 'py' THEN CASE WHEN f = 2 THEN 2 ELSE p + f + 1 END WHEN kind = 'full' THEN p + f WHEN kind = 'total' THEN p ELSE 0 END::BIGINT AS tests_run,
      CASE WHEN kind = 'py' AND f = 2 THEN 1 WHEN kind IN ('py', 'full', 'total') THEN p ELSE 0 END::BIGINT AS tests_passed,
      CASE WHEN kind = 'py' AND f = 2 THEN 1 WHEN kind IN ('py', 'full') THEN f ELSE 0 END::BIGINT AS tests_failed, 0::BIGINT AS tests_errors,
      CASE WHEN kind = 'py' THEN 1 ELSE 0 END::BIGINT AS tests_skipped,
      CASE WHEN kind = 'py' AND f < 2 THEN 80 WHEN language = 'java' AND error IS NULL THEN p % 101 WHEN language IN ('javascript', 'typescript') AND kind = 'full' THEN 85.71 ELSE 0 END::DOUBLE AS coverage_percent,
      exit_code::BIGINT AS exit_code, CASE WHEN language = 'ruby' THEN 'unsupported' ELSE 'runner' END AS execution_mode, error, 0::DOUBLE AS execution_time, md5(stdout) AS stdout FROM {_TOLD}""",
)
def _(read):
    """Every log in one schema, with all its columns and whole texts."""
    return testlogs.normalise_validations(_with_stderr(read)).drop("stderr", "told_passed", "told_failed").withColumn("stdout", F.md5("stdout"))


@query(
    "sandbox_validations",
    f"""SELECT language, count(*) AS logs, count_if(language <> 'ruby' AND CASE WHEN language IN ('javascript', 'typescript') AND j THEN false ELSE exit_code = 0 END)::BIGINT AS successes,
      sum(CASE WHEN language = 'ruby' THEN 0 WHEN language IN ('javascript', 'typescript') AND j THEN 4 ELSE 1 END)::BIGINT AS tests_run
    FROM (SELECT *, contains(stdout, 'numTotalTests') AS j FROM {_LOGS}) x GROUP BY language""",
)
def _(read):
    rows = testlogs.normalise_validations(_with_stderr(read), "sandbox")
    return rows.groupBy("language").agg(
        F.count(F.lit(1)).alias("logs"), F.count_if("success").alias("successes"), F.sum("tests_run").alias("tests_run")
    )


@query(
    "local_validations",
    f"""SELECT language, sum(CASE language WHEN 'ruby' THEN 0 WHEN 'python' THEN {_cnt("' PASSED'")} + {_cnt("' FAILED'")} + {_cnt("' ERROR'")} ELSE 1 END)::BIGINT AS tests_run,
      count_if(language = 'ruby')::BIGINT AS errors FROM {_LOGS} GROUP BY language""",
)
def _(read):
    rows = testlogs.normalise_validations(_with_stderr(read), "local")
    return rows.groupBy("language").agg(F.sum("tests_run").alias("tests_run"), F.count_if(F.col("error").isNotNull()).alias("errors"))
