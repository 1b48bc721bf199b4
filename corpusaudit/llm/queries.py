"""Registered queries of the training-data operators, with SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from corpusaudit.llm import decontaminate, jaccard_join, language, lengths, masked_lm, mixing, pivot_search, quality, resample, simhash, spelling, urls, warc
from corpusaudit.session import fresh_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query()
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score, learnt from the labels that aren't held out."""
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), threshold=0.3)


@_query()
def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learnt from the documents that aren't held out."""
    return language.classify(_table(spark, sf_dir, "documents"))


@_query()
def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and the group of near copies that it is in."""
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), size=3, limit=3)


@_query(
    """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
      s AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
        FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
      r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM s)
    SELECT query_id, place::INTEGER AS rank, vec_id, score FROM r WHERE place <= 5"""
)
def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best rows for every fiftieth vector."""
    return pivot_search.exact_top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


@_query()
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back through their index."""
    folder = fresh_folder(spark, "warc")
    warc.write_archive(_table(spark, sf_dir, "pages"), folder, min_bytes=0)
    return warc.read_archive(spark, folder).select(
        F.col("id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast("long").alias("refers_to"), "error",
    )


#: Rounds of raking in SQL, which can't stop by itself; the operator stops when its marginals hold.
SQL_ROUNDS = 30


def _mix_sql(documents: str = "documents", rounds: int = SQL_ROUNDS) -> str:
    """The same mix: rounds written out one after another, and the scale from the cells in the order of their ratios."""
    steps, last = [], "c0"
    for r in range(rounds):
        for d in mixing.DIMENSIONS:
            now = f"r{r}_{d}"
            steps.append(
                f"{now} AS MATERIALIZED (SELECT {last}.* REPLACE (w * t.share / s.n AS w) FROM {last}"
                f" JOIN (SELECT {d}, sum(w) AS n FROM {last} GROUP BY {d}) s ON {last}.{d} IS NOT DISTINCT FROM s.{d}"
                f" JOIN t_{d} t ON {last}.{d} IS NOT DISTINCT FROM t.{d})"
            )
            last = now
    targets = ", ".join(
        f"t_{d} AS (SELECT {d}, pow(n, {mixing.TEMPER[d]}) / sum(pow(n, {mixing.TEMPER[d]})) OVER () AS share"
        f" FROM (SELECT {d}, sum(tokens)::DOUBLE AS n FROM facts GROUP BY {d}) x WHERE n > 0)"
        for d in mixing.DIMENSIONS
    )
    off = " UNION ALL ".join(
        f"SELECT max(abs(s.n / t.share - 1)) AS off FROM (SELECT {d}, sum(w) AS n FROM {last} GROUP BY {d}) s JOIN t_{d} t ON s.{d} IS NOT DISTINCT FROM t.{d}"
        for d in mixing.DIMENSIONS
    )
    same = " AND ".join(f"facts.{d} IS NOT DISTINCT FROM p.{d}" for d in mixing.DIMENSIONS)
    return f"""WITH facts AS MATERIALIZED (SELECT doc_id, source, lang, CASE WHEN text IS NULL THEN NULL
        WHEN regexp_matches(text, '[Ll][Ii][Cc][Ee][Nn][CcSs][Ee]') THEN 'legal' WHEN contains(text, ' | ') THEN 'table'
        WHEN contains(text, '@') THEN 'contact' WHEN length(text) < 1000 THEN 'short' ELSE 'prose' END AS topic,
        coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS tokens FROM {documents}),
      {targets}, c0 AS (SELECT source, lang, topic, sum(tokens)::BIGINT AS tokens, sum(tokens)::DOUBLE AS w FROM facts
        GROUP BY ALL HAVING sum(tokens) > 0), {", ".join(steps)},
      ranked AS (SELECT *, {mixing.SHARE} * sum(tokens) OVER () AS wanted, coalesce(sum(tokens) OVER before, 0) AS full_tokens, sum(w) OVER rest AS rest
        FROM {last} WINDOW before AS (ORDER BY w / tokens DESC, source, lang, topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
        rest AS (ORDER BY w / tokens DESC, source, lang, topic ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
      scale AS (SELECT max((wanted - full_tokens) / rest) AS c FROM ranked WHERE wanted > full_tokens),
      p AS (SELECT source, lang, topic, least(1, c * w / tokens) AS probability FROM {last}, scale)
    SELECT doc_id, facts.source, facts.lang, facts.topic, tokens, round(coalesce(probability, 0), 6) AS probability,
      tokens > 0 AND ('0x' || substr(md5('0:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0 < coalesce(probability, 0) AS kept,
      (SELECT round(max(off), 9) FROM ({off}) o) AS fit_error
    FROM facts LEFT JOIN p ON {same}"""


@_query(_mix_sql())
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's probability in a mix raked to tempered shares of sources, languages and topics."""
    return mixing.mix(_table(spark, sf_dir, "documents"))


#: The rules that URLs are judged by.
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def _fits(host: str, path: str) -> str:
    return f"((host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}'))"


def _longest(value: Callable[[tuple[str, str, str]], str], otherwise: str) -> str:
    ordered = sorted(URL_RULES, key=lambda r: -len(r[0] + r[1]))
    return "CASE " + " ".join(f"WHEN {_fits(r[0], r[1])} THEN '{value(r)}'" for r in ordered) + f" ELSE {otherwise} END"


@_query(
    f"""SELECT page_id, host, path, {_longest(lambda r: r[0] + r[1], 'NULL')} AS rule, {_longest(lambda r: r[2], "'allow'")} AS verdict
    FROM (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
          FROM (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages) a) b"""
)
def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL judged by the fixed rules."""
    return urls.judge_urls(_table(spark, sf_dir, "pages"), spark.createDataFrame(URL_RULES, urls.RULES))


@_query()
def op8_token_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token lengths of all documents, with running sums for every context limit."""
    return lengths.histogram(_table(spark, sf_dir, "documents"))


@_query()
def op9_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pseudo-likelihood under a network trained on all documents."""
    documents = _table(spark, sf_dir, "documents")
    return masked_lm.score(documents, masked_lm.fit(documents))


@_query()
def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, and the items."""
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@_query()
def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of five-word shingles and the group of near copies that it is in."""
    return jaccard_join.near_groups(_table(spark, sf_dir, "documents"))


@_query()
def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the documents with the more frequent form that it is a variant of."""
    return spelling.variants(_table(spark, sf_dir, "documents"))


@_query()
def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's importance weight towards the benchmark's words, and the ranks of those drawn."""
    return resample.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
