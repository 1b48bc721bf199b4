"""Sources, sinks and facts about files."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import functions as F

from corpusaudit import dims
from corpusaudit.catalog.registry import (
    names, query, quoted, sql_basename, sql_language, sql_stem, sql_suffix, v, values,
)
from corpusaudit.functions import severity
from corpusaudit.operators import files as FI
from corpusaudit.operators import grouping
from corpusaudit.session import fresh_folder
from corpusaudit.sources.storage import open_fs
from corpusaudit.sources import archives, outputs, tables, tree, uploads

_PARTS = "string_split(file_path, '/')"
_DIRS = "string_split(file_path, '/')[1:-2]"


@query(
    "scan_discovery",
    f"""SELECT repo, file_path, size_chars FROM {v('files')}
    WHERE {sql_suffix('file_path')} IN ({names(dims.DISCOVERY_SUFFIXES)})
      AND NOT list_has_any({_DIRS}, [{names(dims.DISCOVERY_EXCLUDED)}])""",
)
def _(read):
    return tree.select_code_files(read("files")).select("repo", "file_path", "size_chars")


@query(
    "scan_index",
    f"""SELECT repo, file_path, file_name, extension, size_chars AS size FROM {v('files')}
    WHERE {sql_suffix('file_path')} IN ({names(dims.INDEX_SUFFIXES)})
      AND NOT list_has_any({_PARTS}, [{names(dims.INDEX_EXCLUDED)}])
      AND len(list_filter({_PARTS}, lambda x: starts_with(x, '.'))) = 0""",
)
def _(read):
    kept = tree.select_code_files(read("files"), "index")
    return kept.select("repo", "file_path", "file_name", "extension", F.length("content").alias("size"))


@query(
    "read_text",
    """SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND regexp_matches(text, '[\\x{80}-\\x{ff}]')
           AND NOT regexp_matches(text, '[^\\x{00}-\\x{ff}]') THEN 'latin-1' ELSE 'utf-8' END AS encoding,
       regexp_replace(text, '\\r\\n?', chr(10), 'g') AS content FROM documents""",
)
def _(read):
    """Every second text is stored as Latin-1 where it can be, then decoded."""
    text = F.col("text")
    narrow = (F.col("doc_id") % 2 == 0) & ~text.rlike("[^\\x00-\\xff]")
    stored = F.when(narrow, F.encode(F.when(narrow, text), "ISO-8859-1")).otherwise(text.cast("binary"))
    raw = read("documents").select("doc_id", stored.alias("content"))
    return tree.readable(tree.read_text(raw)).select("doc_id", "encoding", "content")


def _zip_documents(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch["doc_id"], batch["text"]):
            buffer = io.BytesIO()
            with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
                archive.writestr(f"src/f{doc_id}.py", text)
                archive.writestr("docs/./README.md", text[::-1])
                if doc_id % 5 == 0:
                    archive.writestr("../outside.py", "x")
            data = buffer.getvalue() if doc_id % 10 != 3 else text.encode()
            rows.append((f"in/r{doc_id}.zip", data))
        yield pd.DataFrame(rows, columns=["archive", "content"])


@query(
    "archive_members",
    """SELECT 'r' || doc_id AS repo, 'src/f' || doc_id || '.py' AS file_path, md5(text) AS digest, NULL::VARCHAR AS problem
         FROM documents WHERE doc_id % 10 <> 3
       UNION ALL SELECT 'r' || doc_id, 'docs/README.md', md5(reverse(text)), NULL FROM documents WHERE doc_id % 10 <> 3
       UNION ALL SELECT 'r' || doc_id, NULL, NULL, 'unsafe member path' FROM documents WHERE doc_id % 5 = 0 AND doc_id % 10 <> 3
       UNION ALL SELECT 'r' || doc_id, NULL, NULL, 'not a valid archive' FROM documents WHERE doc_id % 10 = 3""",
)
def _(read):
    """Documents are packed into archives by tasks and unpacked again; some are damaged."""
    packed = read("documents").select("doc_id", "text").mapInPandas(_zip_documents, "archive string, content binary")
    return archives.expand_archives(packed).select(
        "repo", "file_path", F.md5("content").alias("digest"), F.substring_index("error", ":", 1).alias("problem")
    )


def _write_files(folder: str):
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = open_fs(folder)
        for batch in batches:
            for repo, path, text in zip(batch["repo"], batch["file_path"], batch["content"]):
                full = f"{base}/{repo}/{path}"
                fs.create_dir(full.rpartition("/")[0], recursive=True)
                with fs.open_output_stream(full, compression=None) as out:
                    out.write(text.encode())
            yield batch[["repo"]].drop_duplicates()

    return run


@query(
    "scan_tree",
    f"""SELECT repo, file_path, md5(regexp_replace(content, '\r\n?', chr(10), 'g')) AS digest, NULL::VARCHAR AS problem FROM {v('files')}
    WHERE {sql_suffix('file_path')} IN ({names(dims.DISCOVERY_SUFFIXES)}) AND NOT list_has_any({_DIRS}, [{names(dims.DISCOVERY_EXCLUDED)}])
    UNION ALL SELECT 'absent', '', NULL, 'unreadable'""",
)
def _(read):
    """All documents as files of a tree per repository, walked and read; one of the roots doesn't exist."""
    folder = fresh_folder(read.spark, "tree")
    repos = read("files").select("repo", "file_path", "content").mapInPandas(_write_files(folder), "repo string").distinct()
    roots = repos.select("repo", F.concat(F.lit(folder + "/"), "repo").alias("root")).checkpoint()
    absent = read.spark.createDataFrame([("absent", folder + "/no/such/folder")], "repo string, root string")
    files = tree.read_text(tree.scan_code_files(read.spark, roots.unionByName(absent)))
    return files.select("repo", "file_path", F.md5("content").alias("digest"), F.substring_index("error", ":", 1).alias("problem"))


def _write_archives(folder: str):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        number = frame["number"].iloc[0]
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w", zipfile.ZIP_STORED) as archive:
            for doc_id, text in sorted(zip(frame["doc_id"], frame["text"])):
                archive.writestr(f"src/f{doc_id}.py", text)
        data = bytearray(buffer.getvalue())
        for doc_id in frame["doc_id"][frame["doc_id"] % 10 == 7]:  # damage the stored text behind the member's header
            name = f"src/f{doc_id}.py".encode()
            data[data.index(name) + len(name)] ^= 255
        fs, base = open_fs(folder)
        fs.create_dir(base, recursive=True)
        with fs.open_output_stream(f"{base}/r{number}.zip", compression=None) as out:
            out.write(bytes(data))
        return pd.DataFrame({"archive": [f"{folder}/r{number}.zip"]})

    return run


@query(
    "scan_zips",
    """SELECT 'r' || doc_id // 50 AS repo, 'src/f' || doc_id || '.py' AS file_path, CASE WHEN doc_id % 10 <> 7 THEN md5(text) END AS digest,
      CASE WHEN doc_id % 10 = 7 THEN 'unreadable member' END AS problem FROM documents
    UNION ALL SELECT 'absent', NULL, NULL, 'not a valid archive'""",
)
def _(read):
    """Documents in archives of fifty, read by path; every tenth member is damaged, and one archive is missing."""
    folder = fresh_folder(read.spark, "archives")
    numbered = read("documents").select(F.floor(F.col("doc_id") / 50).alias("number"), "doc_id", "text")
    written = numbered.groupBy("number").applyInPandas(_write_archives(folder), "archive string").checkpoint()
    absent = read.spark.createDataFrame([(folder + "/absent.zip",)], "archive string")
    return archives.read_zip_repos(written.unionByName(absent)).select(
        "repo", "file_path", F.md5("content").alias("digest"), F.substring_index("error", ":", 1).alias("problem")
    )


@query(
    "validate_uploads",
    f"""SELECT file_path, reason IS NULL AS is_valid, reason, CASE WHEN reason IS NULL THEN {sql_language('file_path', 'upload')} END AS language
    FROM (SELECT file_path, CASE WHEN lower({sql_suffix('file_path')}) NOT IN ({names(dims.UPLOAD_SUFFIXES)}) THEN 'unsupported type'
            WHEN size > 20000 THEN 'too large' WHEN latin THEN 'encoding error' END AS reason
      FROM (SELECT file_path, narrow AND regexp_matches(content, '[\\x{{80}}-\\x{{ff}}]') AS latin,
              CASE WHEN narrow THEN length(content) ELSE strlen(content) END AS size
            FROM (SELECT *, doc_id % 3 = 0 AND NOT regexp_matches(content, '[^\\x{{00}}-\\x{{ff}}]') AS narrow FROM {v('files')}) a) b) c""",
)
def _(read):
    text = F.col("content")
    narrow = (F.col("doc_id") % 3 == 0) & ~text.rlike("[^\\x00-\\xff]")
    stored = F.when(narrow, F.encode(F.when(narrow, text), "ISO-8859-1")).otherwise(text.cast("binary"))
    checked = uploads.validate_uploads(read("files").select("file_path", stored.alias("content")), max_bytes=20_000)
    return checked.select("file_path", "is_valid", "reason", "language")


@query(
    "output_rows",
    f"""SELECT repo, 'modernized' AS kind, file_path AS path, modernized_code AS text FROM {v('transformations')}
    UNION ALL SELECT repo, 'original', file_path, original_code FROM {v('transformations')}
    UNION ALL SELECT repo, 'tests', 'test_' || {sql_basename('file_path')}, test_code FROM {v('transformations')}""",
)
def _(read):
    return outputs.output_rows(read("transformations"))


@query(
    "written_outputs",
    f"""SELECT kind, count(*) AS files, sum(chars)::BIGINT AS chars FROM (
      SELECT 'modernized' AS kind, length(modernized_code) AS chars FROM {v('transformations')}
      UNION ALL SELECT 'original', length(original_code) FROM {v('transformations')}
      UNION ALL SELECT 'tests', length(test_code) FROM {v('transformations')}) GROUP BY kind""",
)
def _(read):
    """Outputs written by kind to the shared folder and read back."""
    rows = read("transformations")
    path = fresh_folder(read.spark, "outputs")
    outputs.write_outputs(rows, path)
    back = rows.sparkSession.read.parquet(path)
    return back.groupBy("kind").agg(F.count(F.lit(1)).alias("files"), F.sum(F.length("text")).alias("chars"))


_LISTING = f"""(SELECT CASE doc_id % 3 WHEN 0 THEN 'tests' ELSE 'modernized' END AS kind,
      CASE doc_id % 3 WHEN 0 THEN 'test_f' WHEN 1 THEN 'f' ELSE 'sub/f' END || doc_id || extension AS path FROM {v('files')}) listing"""


@query(
    "run_artifacts",
    f"""SELECT kind, path FROM {_LISTING} WHERE NOT contains(path, '/') AND
      CASE kind WHEN 'tests' THEN replace(path, 'test_', '') ELSE path END IN
      (SELECT {sql_basename('file_path')} FROM {v('transformations')} WHERE starts_with(file_path, 'src'))""",
)
def _(read):
    d = F.col("doc_id")
    head = F.when(d % 3 == 0, "test_f").when(d % 3 == 1, "f").otherwise("sub/f")
    listing = read("files").select(
        F.when(d % 3 == 0, "tests").otherwise("modernized").alias("kind"),
        F.concat(head, d.cast("string"), F.col("extension")).alias("path"),
    )
    done = read("transformations").filter(F.col("file_path").startswith("src"))
    return outputs.select_run_artifacts(listing, done)


@query(
    "commit_batches",
    f"""SELECT repo, file_path, (rn - 1) // 10 + 1 AS batch, 'Modernize batch ' || ((rn - 1) // 10 + 1) AS message
    FROM (SELECT repo, file_path, row_number() OVER (PARTITION BY repo ORDER BY file_path) AS rn FROM {v('files')}) x""",
)
def _(read):
    return outputs.commit_batches(read("files").select("repo", "file_path"))


@query(
    "batches",
    f"""SELECT repo, batch_id, count(*) AS files, min(file_path) AS first_path FROM
    (SELECT repo, file_path, (row_number() OVER (PARTITION BY repo ORDER BY file_path) - 1) // 25 AS batch_id FROM {v('files')}) x
    GROUP BY repo, batch_id""",
)
def _(read):
    numbered = grouping.batches(read("files").select("repo", "file_path"), 25, ["file_path"], ["repo"])
    return numbered.groupBy("repo", "batch_id").agg(
        F.count(F.lit(1)).alias("files"), F.min("file_path").alias("first_path")
    )


@query(
    "global_batches",
    """SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 25 AS batch_id FROM documents""",
)
def _(read):
    """Batches over the whole table; ranges of ids are numbered apart and shifted."""
    return grouping.batches(read("documents").select("doc_id"), 25, ["doc_id"], rows_per_task=500)


@query(
    "repo_urls",
    """SELECT page_id, CASE WHEN ends_with(u, '.git') THEN substr(u, 1, length(u) - 4) ELSE u END AS repo_url,
      regexp_replace(CASE WHEN ends_with(u, '.git') THEN substr(u, 1, length(u) - 4) ELSE u END, '^.*/', '') AS repo
    FROM (SELECT page_id, rtrim(trim('  ' || url || CASE page_id % 3 WHEN 0 THEN '.git/' WHEN 1 THEN '//' ELSE '' END), '/') AS u FROM pages) x""",
)
def _(read):
    tail = F.when(F.col("page_id") % 3 == 0, ".git/").when(F.col("page_id") % 3 == 1, "//").otherwise("")
    pages = read("pages").select("page_id", F.concat(F.lit("  "), "url", tail).alias("url"))
    return tables.parse_repo_url(pages).select("page_id", "repo_url", "repo")


@query(
    "file_info",
    f"""SELECT file_path, {sql_basename('file_path')} AS file_name, {sql_suffix('file_path')} AS extension, strlen(content) AS size_bytes,
      round(strlen(content) / 1024.0, 2)::DOUBLE AS size_kb, {sql_suffix('file_path')} IN ({names(dims.DISCOVERY_SUFFIXES)}) AS is_code FROM {v('files')}""",
)
def _(read):
    info = FI.file_info(read("files").select("file_path", "content"))
    return info.select("file_path", "file_name", "extension", "size_bytes", "size_kb", "is_code")


@query(
    "path_parts",
    f"""SELECT page_id, {sql_basename('url')} AS file_name, {sql_stem('url')} AS stem, {sql_suffix('url')} AS extension FROM pages""",
)
def _(read):
    return FI.path_parts(read("pages").select("page_id", "url"), "url").drop("url")


@query(
    "languages_by_scheme",
    "SELECT file_path, "
    + ", ".join(
        f"coalesce({sql_language('file_path', s)}, {quoted(dims.SCHEME_DEFAULTS.get(s))}) AS {s}_language"
        for s in dims.LANGUAGE_SCHEMES
    )
    + f" FROM {v('files')}",
)
def _(read):
    files = read("files").select("file_path")
    for scheme in dims.LANGUAGE_SCHEMES:
        files = FI.detect_language(files, scheme).withColumnRenamed("language", f"{scheme}_language")
    return files


_RULES_RUNNER = """CASE WHEN contains(c, 'public class') OR contains(c, 'import java.') THEN 'java'
  WHEN contains(c, 'def ') AND (contains(c, 'import ') OR contains(c, 'from ')) THEN 'python'
  WHEN contains(c, 'function ') OR contains(c, 'const ') OR contains(c, 'let ') THEN 'javascript'
  WHEN contains(c, 'interface ') OR contains(c, 'type ') THEN 'typescript' ELSE 'python' END"""
_RULES_TESTS = """CASE WHEN contains(c, 'public class') OR contains(c, 'import java.') THEN 'java'
  WHEN contains(c, 'package main') OR contains(c, 'func main()') THEN 'go'
  WHEN contains(c, 'def ') AND (contains(c, 'import ') OR contains(c, 'from ')) THEN 'python'
  WHEN contains(c, 'function ') OR contains(c, 'const ') OR contains(c, 'let ') THEN 'javascript'
  WHEN contains(c, 'namespace ') AND contains(c, 'using ') THEN 'csharp'
  WHEN contains(c, 'fn main()') OR contains(c, 'use std::') THEN 'rust'
  WHEN contains(c, '<?php') THEN 'php'
  WHEN contains(c, 'class ') AND contains(c, 'def ') AND contains(c, 'end') THEN 'ruby' ELSE 'python' END"""
_BARE = f"(SELECT doc_id, content AS c FROM {v('sources')}) x"


@query(
    "language_by_content",
    f"SELECT doc_id, {_RULES_RUNNER} AS runner_language, {_RULES_TESTS} AS tests_language FROM {_BARE}",
)
def _(read):
    c = F.col("content")
    return read("sources").select(
        "doc_id",
        FI.language_by_content(c, "runner").alias("runner_language"),
        FI.language_by_content(c, "tests").alias("tests_language"),
    )


@query(
    "language_by_suffix_or_content",
    f"SELECT file_path, coalesce({sql_language('file_path', 'runner')}, {_RULES_RUNNER}) AS language FROM (SELECT *, content AS c FROM {v('sources')}) x",
)
def _(read):
    return FI.detect_language_by_content(read("sources").select("file_path", "content")).drop("content")


@query(
    "frameworks",
    f"""SELECT s.file_path, arg_max(m.framework, (m.confidence, -m.o)) AS framework, max(m.confidence) AS framework_confidence
    FROM {v('sources').rsplit(' ', 1)[0]} s LEFT JOIN
    {values([(f, m, c, i) for i, (f, m, c) in enumerate(dims.FRAMEWORK_MARKERS)], 'm(framework, marker, confidence, o)')}
      ON contains(s.content, m.marker) GROUP BY s.file_path""",
)
def _(read):
    return FI.detect_framework(read("sources").select("file_path", "content")).drop("content")


def _frameworks_sql(kind: str) -> str:
    mapping = dims.PERFORMANCE_FRAMEWORKS if kind == "performance" else dims.TEST_FRAMEWORKS
    default = "pytest-benchmark" if kind == "performance" else "pytest"
    whens = " ".join(f"WHEN {quoted(l)} THEN {quoted(f)}" for l, f in mapping.items())
    return f"CASE coalesce({sql_language('file_path', 'tests')}, 'python') {whens} ELSE {quoted(default)} END"


@query(
    "test_frameworks",
    f"SELECT file_path, {_frameworks_sql('unit')} AS unit, {_frameworks_sql('security')} AS security, {_frameworks_sql('performance')} AS performance FROM {v('files')}",
)
def _(read):
    files = FI.detect_language(read("files").select("file_path"), "tests")
    for kind in ("unit", "security", "performance"):
        files = FI.assign_test_framework(files, kind).withColumnRenamed("framework", kind)
    return files.drop("language")


_SEARCH = f"(SELECT repo, {sql_language('file_path', 'search')} AS language FROM {v('files')}) x"
_PRESENT = f"""(SELECT DISTINCT repo, language FROM {_SEARCH} WHERE language IS NOT NULL
  UNION ALL SELECT repo, 'python' FROM {_SEARCH} GROUP BY repo HAVING count(language) = 0) present"""


@query("languages_present", f"SELECT repo, language FROM {_PRESENT}")
def _(read):
    return FI.languages_present(read("files").select("repo", "file_path"))


@query(
    "search_queries",
    f"""SELECT repo, NULL::VARCHAR AS language, q.ord, q.query FROM (SELECT DISTINCT repo FROM {v('files')}) r,
       {values([(i, x) for i, x in enumerate(dims.COMMON_QUERIES)], 'q(ord, query)')}
    UNION ALL SELECT present.repo, present.language, q.ord, q.query FROM {_PRESENT} JOIN
       {values([(l, i, x) for l, qs in dims.LANGUAGE_QUERIES.items() for i, x in enumerate(qs)], 'q(language, ord, query)')}
       ON q.language = present.language""",
)
def _(read):
    return FI.search_queries(read("files").select("repo", "file_path"))


@query("language_breakdown", f"SELECT coalesce({sql_language('file_path', 'display')}, 'Unknown') AS language, count(*) AS files FROM {v('files')} GROUP BY 1")
def _(read):
    return FI.language_breakdown(FI.detect_language(read("files").select("file_path")))


_UPLOAD = f"(SELECT repo, {sql_language('file_path', 'upload')} AS language FROM {v('files')}) x"
_PRIMARY = f"""(SELECT repo, arg_min(language, (-n, language)) FILTER (language IS NOT NULL) AS primary_language
  FROM (SELECT repo, language, count(*) AS n FROM {_UPLOAD} GROUP BY ALL) y GROUP BY repo) prim"""


@query("primary_language", f"SELECT repo, primary_language FROM {_PRIMARY}")
def _(read):
    return FI.primary_language(read("files").select("repo", "file_path"))


_OFFERS = [(l or "*", i, x) for l, xs in dims.target_versions().items() for i, x in enumerate(xs)]


@query(
    "suggest_versions",
    f"""SELECT repo, primary_language, o.ord, o.version FROM {_PRIMARY} JOIN {values(_OFFERS, 'o(offer, ord, version)')}
    ON o.offer = coalesce(primary_language, '*')""",
)
def _(read):
    return FI.suggest_versions(FI.primary_language(read("files").select("repo", "file_path")))


@query(
    "all_versions",
    f"""SELECT DISTINCT o.version FROM {_PRIMARY} JOIN {values(_OFFERS, 'o(offer, ord, version)')}
    ON o.offer = coalesce(primary_language, '*')""",
)
def _(read):
    return FI.all_versions(FI.primary_language(read("files").select("repo", "file_path")))


@query("cache_keys", f"SELECT doc_id, sha256(file_path || chr(0) || content) AS cache_key FROM {v('files')}")
def _(read):
    return read("files").select("doc_id", FI.cache_key(F.col("file_path"), F.col("content")).alias("cache_key"))


@query(
    "severity_weights",
    f"""SELECT file_path, coalesce(d.weight, 50) AS weight, coalesce(d.severity_rank, 0) AS severity_rank
    FROM (SELECT file_path, CASE WHEN modernization_score < 10 THEN 'none' ELSE overall_priority END AS s FROM {v('analyses')}) a
    LEFT JOIN {values(list((s, dims.SEVERITY_WEIGHT[s], dims.SEVERITY_RANK[s]) for s in dims.SEVERITIES), 'd(severity, weight, severity_rank)')} ON d.severity = a.s""",
)
def _(read):
    s = F.when(F.col("modernization_score") < 10, "none").otherwise(F.col("overall_priority"))
    return read("analyses").select(
        "file_path", severity.weight(s, 50).alias("weight"), severity.rank(s).alias("severity_rank")
    )


@query(
    "dimension_join",
    f"""SELECT d.severity, d.weight, d.severity_rank, count(a.file_path) AS files FROM
    {values([(s, dims.SEVERITY_WEIGHT[s], dims.SEVERITY_RANK[s]) for s in dims.SEVERITIES], 'd(severity, weight, severity_rank)')}
    LEFT JOIN {v('analyses').rsplit(' ', 1)[0]} a ON a.overall_priority = d.severity GROUP BY ALL""",
)
def _(read):
    """Files per row of a dimension table, zeros kept; files are counted before the join."""
    analyses = read("analyses")
    counts = analyses.groupBy(F.col("overall_priority").alias("severity")).agg(F.count(F.lit(1)).alias("files"))
    table = dims.load_dimension(analyses.sparkSession, "severities")
    return table.join(counts, "severity", "left").fillna({"files": 0})
