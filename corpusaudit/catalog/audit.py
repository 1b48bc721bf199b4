"""Pattern detection, analyses, plans, statistics and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusaudit import dims
from corpusaudit.catalog.registry import query, sql_language, v, values
from corpusaudit.operators import analysis, quality
from corpusaudit.operators import rules as R
from corpusaudit.operators.cache import cached_split, merge_cache, store_examples, transformation_examples, with_cache_key
from corpusaudit.operators.files import cache_key
from corpusaudit.operators.grouping import first_per_group, last_write_wins
from corpusaudit.plans import ranking, reports, statistics
from corpusaudit.session import fresh_folder

_SRC = v("sources")
_DISPLAY = f"coalesce({sql_language('file_path', 'display')}, 'Unknown')"


def _rules_sql(rules: list[R.Rule]) -> str:
    rows = [
        (r.language, r.pattern_type, r.kind, r.regex, r.severity, r.confidence, r.effort, r.description, r.recommendation, r.security, i)
        for i, r in enumerate(rules)
    ]
    return values(rows, "r(language, pattern_type, kind, regex, severity, confidence, effort, description, recommendation, security, o)")


def _findings(rules: list[R.Rule], source: str = _SRC, path: str = "file_path", content: str = "content", language: str = _DISPLAY) -> str:
    """Findings as rows, by joining lines with rules."""
    any_language = "true" if all(r.language == "*" for r in rules) else "r.language = f.language"
    return f"""(WITH f AS MATERIALIZED (SELECT {path} AS file_path, {language} AS language, {content} AS content FROM {source}),
      l AS (SELECT file_path, language, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS n FROM f)
      SELECT f.file_path, f.language, r.pattern_type, r.kind, r.severity, r.confidence, r.effort, r.security, r.description, r.recommendation, r.o, string_agg(f.n::VARCHAR, ',' ORDER BY f.n) AS line_numbers, list(f.n) AS ns
        FROM l f JOIN {_rules_sql(rules)} ON {any_language} WHERE r.kind = 'match' AND regexp_matches(f.line, r.regex) GROUP BY ALL
      UNION ALL SELECT f.file_path, f.language, r.pattern_type, r.kind, r.severity, r.confidence, r.effort, r.security, r.description, r.recommendation, r.o, '', []
        FROM f JOIN {_rules_sql(rules)} ON {any_language} WHERE r.kind = 'absent' AND NOT regexp_matches(f.content, '(?m)' || r.regex)) found"""


_FOUND = _findings(R.RULES)
_COLS = "file_path, language, pattern_type, severity, confidence, effort AS estimated_effort_hours, description, recommendation, line_numbers"


def _shown(df):
    return df.select(
        "file_path", "language", "pattern_type", "severity", "confidence", "estimated_effort_hours", "description",
        "recommendation", F.array_join("line_numbers", ",").alias("line_numbers"),
    )


@query(
    "rules_for",
    f"""SELECT f.file_path, f.language, p.ord, p.pattern_type FROM (SELECT file_path, {_DISPLAY} AS language FROM {v('files')}) f
    JOIN {values([(l, i, x) for l, xs in dims.LEGACY_PATTERNS.items() for i, x in enumerate(xs)], 'p(language, ord, pattern_type)')} ON p.language = f.language""",
)
def _(read):
    return R.rules_for(read("files").select("file_path"))


@query("detect_patterns", f"SELECT {_COLS} FROM {_FOUND}")
def _(read):
    return _shown(R.detect_patterns(read("sources").select("file_path", "content")))


@query(
    "detect_in_pages",
    f"SELECT {_COLS} FROM {_findings(R.TEXT_RULES, 'pages', 'url', 'html', chr(39) + 'Unknown' + chr(39))}",
)
def _(read):
    pages = read("pages").select(F.col("url").alias("file_path"), F.col("html").alias("content"))
    return _shown(R.detect_patterns(pages, R.TEXT_RULES).withColumn("language", F.lit("Unknown")))


@query(
    "detect_in_documents",
    f"SELECT {_COLS.replace('language,', '')} FROM {_findings(R.TEXT_RULES, v('files'))}",
)
def _(read):
    return _shown(R.detect_patterns(read("files").select("file_path", "content"), R.TEXT_RULES)).drop("language")


_PAT = v("patterns")
_RANK = "CASE severity WHEN 'critical' THEN 5 WHEN 'high' THEN 4 WHEN 'medium' THEN 3 WHEN 'low' THEN 2 WHEN 'info' THEN 1 ELSE 0 END"
_WEIGHT = "CASE severity WHEN 'critical' THEN 100 WHEN 'high' THEN 75 WHEN 'medium' THEN 50 WHEN 'low' THEN 25 WHEN 'info' THEN 10 ELSE 25 END"
_ORDER = ["pos", "line_number", "severity", "confidence", "estimated_effort_hours"]


@query(
    "cap_patterns",
    f"""SELECT file_path, rn, pattern_type, severity, confidence, pos FROM (SELECT *, row_number() OVER (PARTITION BY file_path
      ORDER BY {_RANK} DESC, confidence DESC, pattern_type, pos, estimated_effort_hours) AS rn FROM {_PAT}) x WHERE rn <= 5""",
)
def _(read):
    order = [F.asc("pattern_type"), F.asc("pos"), F.asc("estimated_effort_hours")]
    return analysis.cap_patterns(read("patterns"), 5, order).select("file_path", "rn", "pattern_type", "severity", "confidence", "pos")


@query(
    "first_per_group",
    f"""SELECT pattern_type, rn, file_path, pos FROM (SELECT *, row_number() OVER (PARTITION BY pattern_type ORDER BY file_path, pos, line_number) AS rn
      FROM {_PAT}) x WHERE rn <= 5""",
)
def _(read):
    order = [F.asc("file_path"), F.asc("pos"), F.asc("line_number")]
    return first_per_group(read("patterns"), ["pattern_type"], order, 5).select("pattern_type", "rn", "file_path", "pos")


_LOST = f"round(100 - sum({_WEIGHT} / 4.0 * confidence), 4)"
_TOPNAME = "CASE max_rank WHEN 5 THEN 'critical' WHEN 4 THEN 'high' WHEN 3 THEN 'medium' WHEN 2 THEN 'low' ELSE 'info' END"


@query(
    "summarise_file",
    f"""SELECT a.file_path, {_TOPNAME} AS overall_priority, greatest(0, coalesce(score, 100))::DOUBLE AS modernization_score,
      coalesce(max_rank, 0) >= 2 AS requires_modernization, coalesce(n, 0) AS n_patterns
    FROM {v('analyses').rsplit(' ', 1)[0]} a LEFT JOIN (SELECT file_path, max({_RANK}) AS max_rank, {_LOST} AS score, count(*) AS n FROM {_PAT} GROUP BY file_path) p USING (file_path)""",
)
def _(read):
    return analysis.summarise_file(read("analyses").select("file_path"), read("patterns"))


_SUMMARY = f"""(SELECT file_path, {_TOPNAME} AS overall_priority, greatest(0, round(100 - coalesce(lost, 0), 4))::DOUBLE AS modernization_score,
    coalesce(max_rank, 0) >= 2 AS requires_modernization, coalesce(n, 0) AS n_patterns, coalesce(w, 0) AS pattern_score, coalesce(nc, 0) AS n_critical, coalesce(nh, 0) AS n_high,
    coalesce(eff, 0) AS effort_hours
  FROM (SELECT file_path FROM {_SRC}) s LEFT JOIN
   (SELECT file_path, max({_RANK}) AS max_rank, sum({_WEIGHT} / 4.0 * confidence) AS lost, count(*) AS n, sum({_WEIGHT} * confidence) AS w,
      count_if(severity = 'critical')::BIGINT AS nc, count_if(severity = 'high')::BIGINT AS nh, sum(effort) AS eff FROM {_FOUND} GROUP BY file_path) p USING (file_path)) summary"""


@query(
    "analyse_files",
    f"SELECT file_path, overall_priority, modernization_score, requires_modernization, n_patterns FROM {_SUMMARY}",
)
def _(read):
    a = analysis.analyse_files(read("sources").select("file_path", "content"))
    return a.select(
        "file_path", "overall_priority", "modernization_score", "requires_modernization", F.size("patterns").alias("n_patterns")
    )


@query(
    "top_files_of_texts",
    f"""SELECT file_path, rank, priority_score, overall_priority, n_patterns FROM (SELECT *, row_number() OVER (ORDER BY priority_score DESC, file_path) AS rank FROM
      (SELECT *, round(CASE overall_priority WHEN 'critical' THEN 100 WHEN 'high' THEN 75 WHEN 'medium' THEN 50 WHEN 'low' THEN 25 ELSE 10 END + pattern_score
        + (100 - modernization_score) / 10, 4) AS priority_score FROM {_SUMMARY}) a) b WHERE rank <= 10""",
)
def _(read):
    """The files that most need attention, from their whole texts."""
    facts = analysis.with_facts(analysis.analyse_files(read("sources").select("file_path", "content")))
    return ranking.top_files(facts).select("file_path", "rank", "priority_score", "overall_priority", "n_patterns")


# -- analyses and flat patterns ------------------------------------------------
_FACTS = f"""(SELECT a.*, coalesce(n, 0) AS n_patterns, coalesce(nc, 0) AS n_critical, coalesce(nh, 0) AS n_high, coalesce(nm, 0) AS n_medium, coalesce(nl, 0) AS n_low,
    coalesce(ni, 0) AS n_info, coalesce(w, 0) AS pattern_score, coalesce(eff, 0) AS effort_hours
  FROM {v('analyses').rsplit(' ', 1)[0]} a LEFT JOIN (SELECT file_path, count(*) AS n, count_if(severity = 'critical')::BIGINT AS nc, count_if(severity = 'high')::BIGINT AS nh,
    count_if(severity = 'medium')::BIGINT AS nm, count_if(severity = 'low')::BIGINT AS nl, count_if(severity = 'info')::BIGINT AS ni,
    sum({_WEIGHT} * confidence) AS w, sum(estimated_effort_hours) AS eff FROM {_PAT} GROUP BY file_path) p USING (file_path))"""
_CATEGORY = """CASE WHEN NOT requires_modernization THEN 'skip' WHEN n_critical > 0 OR modernization_score < 50 THEN 'modernize_high'
  WHEN n_high > 0 OR modernization_score < 75 THEN 'modernize_high' ELSE 'modernize_low' END"""
_SCORE = """round(CASE overall_priority WHEN 'critical' THEN 100 WHEN 'high' THEN 75 WHEN 'medium' THEN 50 WHEN 'low' THEN 25 WHEN 'info' THEN 10 ELSE 50 END
  + pattern_score + (100 - modernization_score) / 10, 4)"""


def _facts(read):
    return analysis.with_facts(read("analyses"), read("patterns"))


@query("categorise", f"SELECT file_path, {_CATEGORY} AS category FROM {_FACTS} f")
def _(read):
    return analysis.categorise(_facts(read)).select("file_path", "category")


_SEC = f"(SELECT * FROM {_FOUND} WHERE security IS NOT NULL)"


_FORK = "fork"
_FORKS = f"(VALUES ('left'), ('right')) {_FORK}(repo)"


@query(
    "security_findings",
    f"SELECT {_FORK}.repo, file_path, security AS vulnerability, severity, unnest(ns) AS line_number, description, recommendation FROM {_SEC} s, {_FORKS}",
)
def _(read):
    """Findings in the files of two repositories that hold the same paths."""
    return R.security_findings(read("forks").select("repo", "file_path", "content"))


@query(
    "security_scores",
    f"""SELECT {_FORK}.repo, file_path, coalesce(n, 0) AS n_kinds, greatest(0, round(100 - coalesce(lost, 0), 4))::DOUBLE AS security_score FROM {_FORKS}, (SELECT file_path FROM {_SRC}) s
    LEFT JOIN (SELECT file_path, count(*) AS n, sum({_WEIGHT} / 4.0 * confidence) AS lost FROM {_SEC} x GROUP BY file_path) p USING (file_path)""",
)
def _(read):
    return R.security_scores(read("forks").select("repo", "file_path", "content"))


@query(
    "duplicate_code",
    f"SELECT sha256(content) AS content_hash, 2 * count(*) AS copies, 'left' AS first_repo, min(file_path) AS first_path FROM {_SRC} GROUP BY 1",
)
def _(read):
    """Equal texts over two repositories that hold the same files."""
    return quality.duplicate_code(read("forks").select("repo", "file_path", "content"))


@query(
    "duplicate_files",
    f"""SELECT content_hash, file_path, copies, first_path FROM (SELECT file_path, sha256(content) AS content_hash, count(*) OVER (PARTITION BY content) AS copies,
      min(file_path) OVER (PARTITION BY content) AS first_path FROM {v('files')}) x WHERE copies > 1""",
)
def _(read):
    return quality.duplicate_files(read("files").select("file_path", "content"))


@query(
    "near_copies",
    f"""WITH RECURSIVE t AS (SELECT DISTINCT text, list_filter(string_split_regex(text, '[ \\t\\n\\r]+'), lambda w: w <> '') AS w FROM documents),
      n AS (SELECT text, w, row_number() OVER (ORDER BY text) AS id FROM t WHERE len(w) > 0),
      s AS (SELECT id, list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM n),
      u AS (SELECT id, len(g) AS size, unnest(g) AS x FROM s),
      common AS (SELECT a.id AS a, b.id AS b, any_value(a.size) AS m, any_value(b.size) AS k, count(*) AS c FROM u a JOIN u b ON a.x = b.x AND a.id < b.id
        WHERE a.size >= 0.8 * b.size AND b.size >= 0.8 * a.size GROUP BY a.id, b.id),
      e AS (SELECT a, b FROM common WHERE c >= 0.8 * (m + k - c)), ab AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
      r AS (SELECT id, id AS root FROM n UNION SELECT ab.b, r.root FROM r JOIN ab ON ab.a = r.id),
      g AS (SELECT text, min(root) AS root FROM r JOIN n USING (id) GROUP BY text),
      f AS (SELECT file_path, count(*) OVER (PARTITION BY root) AS files, min(file_path) OVER (PARTITION BY root) AS first_path FROM {v('files')} JOIN g ON g.text = content)
    SELECT file_path, first_path, files FROM f WHERE files > 1""",
)
def _(read):
    """Groups of near copies among all texts; the SQL compares every two texts that share a shingle."""
    return quality.near_copies(read("files").select("file_path", "content"))


def _metrics(source: str, path: str, content: str) -> str:
    return f"""(SELECT *, 100 - 20 * ((max_line > 120)::BIGINT + (branches * 4 > n_lines)::BIGINT + (NOT handles_errors)::BIGINT + (comment_ratio < 0.05)::BIGINT) AS quality_score
    FROM (SELECT *, round(comment_lines / n_lines, 4) AS comment_ratio FROM (SELECT {path} AS file_path, len(string_split({content}, chr(10))) AS n_lines,
      list_max(list_transform(string_split({content}, chr(10)), lambda x: length(x))) AS max_line, len(regexp_extract_all({content}, '{quality.BRANCH_WORDS}')) AS branches,
      len(regexp_extract_all({content}, '(?m){quality.COMMENT_LINE}')) AS comment_lines, regexp_matches({content}, '{quality.ERROR_WORDS}') AS handles_errors FROM {source}) a) b)"""


@query("quality_metrics", f"SELECT * FROM {_metrics(_SRC, 'file_path', 'content')} m")
def _(read):
    return quality.quality_metrics(read("sources").select("file_path", "content"))


@query(
    "refactor_suggestions",
    f"""SELECT file_path, 'complexity' AS category, 'high' AS priority FROM {_metrics('pages', 'url', 'html')} m WHERE branches * 4 > n_lines
    UNION ALL SELECT file_path, 'error handling', 'medium' FROM {_metrics('pages', 'url', 'html')} m WHERE NOT handles_errors
    UNION ALL SELECT file_path, 'long lines', 'low' FROM {_metrics('pages', 'url', 'html')} m WHERE max_line > 120
    UNION ALL SELECT file_path, 'documentation', 'low' FROM {_metrics('pages', 'url', 'html')} m WHERE comment_ratio < 0.05""",
)
def _(read):
    return quality.refactor_suggestions(read("pages").select(F.col("url").alias("file_path"), F.col("html").alias("content")))


@query(
    "nested_round_trip",
    f"SELECT file_path, pos, line_number::BIGINT AS line_number, pattern_type, severity, confidence, estimated_effort_hours FROM {_PAT}",
)
def _(read):
    """Patterns packed per file, written as JSON, read back and unpacked."""
    patterns = read("patterns")
    fields = ["pos", "line_number", "pattern_type", "severity", "confidence", "estimated_effort_hours"]
    nested = analysis.to_nested(patterns, fields)
    return analysis.to_flat(analysis.nested_from_json(analysis.nested_to_json(nested), nested.schema))


@query(
    "nested_sizes",
    f"SELECT file_path, 0::BIGINT AS part, count(*) AS n, min(pos) AS first_pos FROM {_PAT} GROUP BY file_path",
)
def _(read):
    nested = analysis.to_nested(read("patterns"), ["pos", "line_number", "pattern_type", "severity"])
    return nested.select("file_path", "part", F.size("patterns").alias("n"), F.col("patterns")[0]["pos"].alias("first_pos"))


# -- ranking and plans -----------------------------------------------------------
@query("prioritise", f"SELECT file_path, {_SCORE} AS priority_score FROM {_FACTS} f")
def _(read):
    return ranking.prioritise(_facts(read)).select("file_path", "priority_score")


@query(
    "prioritise_per_repo",
    f"""SELECT repo, rank, file_path, priority_score FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY priority_score DESC, file_path) AS rank
      FROM (SELECT *, {_SCORE} AS priority_score FROM {_FACTS} f) a) b WHERE rank <= 10""",
)
def _(read):
    return ranking.prioritise(_facts(read), 10, per_repo=True).select("repo", "rank", "file_path", "priority_score")


@query(
    "top_files",
    f"""SELECT file_path, rank, priority_score, n_patterns FROM (SELECT *, row_number() OVER (ORDER BY priority_score DESC, file_path) AS rank
      FROM (SELECT *, {_SCORE} AS priority_score FROM {_FACTS} f WHERE requires_modernization) a) b WHERE rank <= 10""",
)
def _(read):
    return ranking.top_files(_facts(read), 10, required_only=True).select("file_path", "rank", "priority_score", "n_patterns")


_BEST = f"""(SELECT file_path, pattern_type, first_pos, severity, confidence, estimated_effort_hours FROM (SELECT *,
   row_number() OVER (PARTITION BY file_path, pattern_type ORDER BY {_RANK} DESC, {', '.join(_ORDER)}) AS rn,
   first_value((pos, line_number, severity, confidence, estimated_effort_hours)) OVER (PARTITION BY file_path, pattern_type ORDER BY {', '.join(_ORDER)}) AS first_pos
   FROM {_PAT}) x WHERE rn = 1) best"""


@query(
    "transformation_plan",
    f"""SELECT a.file_path, a.language || ' modernization' AS pattern, a.overall_priority, round(sum(best.estimated_effort_hours) OVER (PARTITION BY a.file_path), 4) AS total_effort,
      row_number() OVER (PARTITION BY a.file_path ORDER BY first_pos, pattern_type) - 1 AS step_no, best.pattern_type, best.severity, best.confidence
    FROM {v('analyses').rsplit(' ', 1)[0]} a JOIN {_BEST} ON best.file_path = a.file_path""",
)
def _(read):
    plan = ranking.transformation_plan(read("analyses"), read("patterns"), _ORDER)
    rows = plan.select(
        "file_path", "pattern", "overall_priority", F.col("estimated_effort_hours").alias("total_effort"),
        F.posexplode("steps").alias("step_no", "s"),
    )
    return rows.select(
        "file_path", "pattern", "overall_priority", "total_effort", "step_no", "s.pattern_type", "s.severity", "s.confidence"
    )


@query(
    "plan_of_texts",
    f"""SELECT file_path, row_number() OVER (PARTITION BY file_path ORDER BY o) - 1 AS step_no, pattern_type, severity, line_numbers, round(sum(effort) OVER (PARTITION BY file_path), 4) AS total_effort
    FROM {_FOUND} WHERE file_path IN (SELECT file_path FROM {_FOUND} WHERE severity <> 'info')""",
)
def _(read):
    analyses = analysis.analyse_files(read("sources").select("file_path", "content"))
    plans = ranking.plan_of_nested(analyses.filter("requires_modernization"))
    rows = plans.select("file_path", F.round("estimated_effort_hours", 4).alias("total_effort"), F.posexplode("steps").alias("step_no", "s"))
    return rows.select(
        "file_path", "step_no", "s.pattern_type", "s.severity", F.array_join("s.line_numbers", ",").alias("line_numbers"), "total_effort"
    )


@query(
    "transformable",
    f"""SELECT a.file_path, count(*) AS lines FROM {v('analyses').rsplit(' ', 1)[0]} a JOIN lineitem l ON a.file_id = l.l_orderkey
    WHERE a.requires_modernization AND l_returnflag <> 'N' GROUP BY a.file_path""",
)
def _(read):
    """Analyses that require work, joined with texts; empty texts drop out."""
    lines = read("lineitem").select(
        F.concat(F.lit("f"), F.col("l_orderkey").cast("string"), F.lit(".py")).alias("file_path"),
        F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).otherwise("").alias("content"),
    )
    joined = ranking.transformable(read("analyses"), lines)
    return joined.groupBy("file_path").agg(F.count(F.lit(1)).alias("lines"))


# -- statistics and reports ----------------------------------------------------
@query(
    "category_stats",
    f"""SELECT count_if(c = 'modernize_high')::BIGINT AS modernize_high, count_if(c = 'modernize_low')::BIGINT AS modernize_low, count_if(c = 'skip')::BIGINT AS skip, count(*) AS total
    FROM (SELECT CASE overall_priority WHEN 'info' THEN 'other' ELSE {_CATEGORY} END AS c FROM {_FACTS} f) x""",
)
def _(read):
    classified = analysis.categorise(_facts(read))
    category = F.when(F.col("overall_priority") == "info", "other").otherwise(F.col("category"))
    return statistics.category_stats(classified.withColumn("category", category))


_STATS = f"""SELECT count(*) AS total_files, count_if(c = 'modernize_high')::BIGINT AS modernize_high, count_if(c = 'modernize_low')::BIGINT AS modernize_low,
  count_if(c = 'skip')::BIGINT AS skip, sum(n_critical)::BIGINT AS critical, sum(n_high)::BIGINT AS high, sum(n_medium)::BIGINT AS medium, sum(n_low)::BIGINT AS low, sum(n_info)::BIGINT AS info,
  round(avg(modernization_score), 2) AS average_modernization_score, round(sum(effort_hours), 2) AS total_estimated_effort_hours, sum(n_patterns)::BIGINT AS patterns_detected
  FROM (SELECT *, {_CATEGORY} AS c FROM {_FACTS} f) x"""


@query("analysis_statistics", _STATS)
def _(read):
    return statistics.analysis_statistics(analysis.categorise(_facts(read)))


@query(
    "severity_breakdown",
    f"""SELECT d.ord, d.severity, count(p.severity) AS patterns FROM {values(list(enumerate(dims.SEVERITIES)), 'd(ord, severity)')} LEFT JOIN {_PAT.rsplit(' ', 1)[0]} p USING (severity) GROUP BY ALL""",
)
def _(read):
    return statistics.severity_breakdown(read("patterns"))


@query(
    "pattern_report",
    f"""WITH f AS MATERIALIZED (SELECT *, {_SCORE} AS priority_score FROM {_FACTS} x)
    SELECT 'summary' AS section, o AS ord, label, value FROM (SELECT unnest([0, 1, 2, 3])::BIGINT AS o, unnest(['files analysed', 'files requiring modernization', 'patterns detected', 'average modernization score']) AS label,
       unnest([count(*), count_if(requires_modernization), sum(n_patterns), round(avg(modernization_score), 1)]::DOUBLE[]) AS value FROM f)
    UNION ALL SELECT 'languages', row_number() OVER (ORDER BY count(*) DESC, language) - 1, language, count(*)::DOUBLE FROM f GROUP BY language
    UNION ALL SELECT 'severities', o, s, n FROM (SELECT unnest([0, 1, 2, 3, 4])::BIGINT AS o, unnest(['critical', 'high', 'medium', 'low', 'info']) AS s,
       unnest([sum(n_critical), sum(n_high), sum(n_medium), sum(n_low), sum(n_info)]::DOUBLE[]) AS n FROM f) WHERE n > 0
    UNION ALL SELECT 'top files', rn - 1, file_path, priority_score FROM (SELECT *, row_number() OVER (ORDER BY priority_score DESC, file_path) AS rn FROM f) WHERE rn <= 10""",
)
def _(read):
    return reports.pattern_report(_facts(read))


@query(
    "audit_statistics",
    f"""SELECT count(*) AS total_files, count_if(c = 'modernize_high')::BIGINT AS modernize_high, count_if(c = 'modernize_low')::BIGINT AS modernize_low, count_if(c = 'skip')::BIGINT AS skip,
      round(avg(modernization_score), 2) AS average_modernization_score, round(sum(effort_hours), 2) AS total_estimated_effort_hours, sum(n_patterns)::BIGINT AS patterns_detected
    FROM (SELECT *, {_CATEGORY} AS c FROM {_SUMMARY}) x""",
)
def _(read):
    """The statistics of the audit bundle over whole texts."""
    results = reports.audit(read("sources").select("repo", "file_path", "content"))
    return results["statistics"].drop(*dims.SEVERITIES)


# -- cache and examples ----------------------------------------------------------
def _cache(read):
    """A cache that knows two thirds of the files, one of three of them twice."""
    d = F.col("doc_id")
    keyed = with_cache_key(read("files"))
    entry = F.struct(F.concat(F.lit("v"), F.lit("1")).alias("payload"), F.lit(1).alias("created_at"))
    newer = F.struct(F.lit("v2").alias("payload"), F.lit(2).alias("created_at"))
    versions = F.when(d % 3 == 0, F.array(entry, newer)).when(d % 3 == 1, F.array(entry)).otherwise(F.filter(F.array(entry), lambda x: F.lit(False)))
    return keyed.select("cache_key", F.explode(versions).alias("e")).select("cache_key", "e.*")


@query(
    "cache_hits",
    f"SELECT file_path, CASE doc_id % 3 WHEN 0 THEN 'v2' ELSE 'v1' END AS payload FROM {v('files')} WHERE doc_id % 3 <> 2",
)
def _(read):
    hits, _ = cached_split(read("files"), _cache(read))
    return hits.select("file_path", "payload")


@query("cache_misses", f"SELECT file_path, length(content) AS size FROM {v('files')} WHERE doc_id % 3 = 2")
def _(read):
    _, misses = cached_split(read("files"), _cache(read))
    return misses.select("file_path", F.length("content").alias("size"))


@query(
    "merge_cache",
    f"SELECT sha256(file_path || chr(0) || content) AS cache_key, CASE doc_id % 3 WHEN 0 THEN 'v2' WHEN 1 THEN 'v1' ELSE 'new' END AS payload FROM {v('files')}",
)
def _(read):
    files = read("files")
    key = cache_key(F.col("file_path"), F.col("content"))
    new = files.filter(F.col("doc_id") % 3 == 2).select(key.alias("cache_key"), F.lit("new").alias("payload"), F.lit(3).alias("created_at"))
    return merge_cache(_cache(read), new).select("cache_key", "payload")


@query(
    "transformation_examples",
    f"""SELECT pattern_type AS pattern, example_no, file_path, pos FROM (SELECT *, row_number() OVER (PARTITION BY pattern_type ORDER BY file_path, pos, line_number) AS example_no
      FROM {_PAT}) x WHERE example_no <= 5 AND pattern_type IN (SELECT 'pt_' || (o_custkey % 7) FROM orders)""",
)
def _(read):
    examples = read("patterns").withColumnRenamed("pattern_type", "pattern")
    wanted = read("orders").select(F.concat(F.lit("pt_"), (F.col("o_custkey") % 7).cast("string")).alias("pattern"))
    order = [F.asc("file_path"), F.asc("pos"), F.asc("line_number")]
    return transformation_examples(examples, wanted, 5, order).select("pattern", "example_no", "file_path", "pos")


@query("stored_examples", f"""SELECT file_path, pattern, md5(content) AS before, md5('import logging' || chr(10) || content || chr(10)) AS after
    FROM (SELECT *, 'pt_' || (doc_id % 5) AS pattern FROM {v('files')}) x WHERE pattern IN ('pt_1', 'pt_3')""")
def _(read):
    """Transformations stored as examples with their whole texts, and found again by pattern."""
    done = read("transformations").withColumn("pattern", F.concat(F.lit("pt_"), (F.col("doc_id") % 5).cast("string")))
    folder = fresh_folder(read.spark, "examples")
    store_examples(done).write.parquet(folder)
    wanted = read.spark.createDataFrame([("pt_1",), ("pt_3",), ("pt_9",)], "pattern string")
    found = transformation_examples(read.spark.read.parquet(folder), wanted)
    return found.select("file_path", "pattern", F.md5("before").alias("before"), F.md5("after").alias("after"))


@query(
    "last_write_wins",
    f"""SELECT file_path, arg_max(overall_priority, batch) AS overall_priority FROM (SELECT file_path, overall_priority, 1 AS batch FROM {v('analyses')}
      UNION ALL SELECT file_path, 'redone', 2 FROM {v('analyses')} WHERE modernization_score < 30) x GROUP BY file_path""",
)
def _(read):
    first = read("analyses").select("file_path", "overall_priority", F.lit(1).alias("batch"))
    second = read("analyses").filter("modernization_score < 30").select("file_path", F.lit("redone").alias("overall_priority"), F.lit(2).alias("batch"))
    return last_write_wins([first, second], "file_path", "batch").select("file_path", "overall_priority")


