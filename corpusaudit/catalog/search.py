"""Chunks, embeddings, search and grouped patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusaudit.catalog.registry import query, v
from corpusaudit.catalog.texts import _words
from corpusaudit.functions.once import with_once
from corpusaudit.operators import knn, search
from corpusaudit.operators.files import pattern_id
from corpusaudit.operators.search import word_length_embedder
from corpusaudit.plans.ranking import combine_patterns
from corpusaudit.session import fresh_folder
from corpusaudit.sources import tables

_CENTROIDS = """q AS (SELECT label AS query_id, list(x ORDER BY i) AS qv FROM (SELECT label, i, avg(x) AS x FROM
   (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) a GROUP BY label, i) b GROUP BY label)"""
_CHUNKS = v("chunks")


def _ranked(k: int, metric: str = "cosine", where: str = "true") -> str:
    score = {
        "cosine": "list_cosine_similarity(c.embedding::DOUBLE[], q.qv)",
        "l2": "-list_distance(c.embedding::DOUBLE[], q.qv)",
    }[metric]
    return f"""(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM
      (SELECT q.query_id, c.chunk_id, c.file_path, c.text, round({score}, 6) AS score FROM q, {_CHUNKS.rsplit(' ', 1)[0]} c WHERE {where}) a) b WHERE rank <= {k}) hits"""


_SHOWN = "query_id::BIGINT AS query_id, rank, chunk_id, file_path, score, text"


def _queries(read):
    return search.centroids(read("chunks"), "label")


@query("similar", f"WITH {_CENTROIDS} SELECT {_SHOWN} FROM {_ranked(20)}")
def _(read):
    """The 20 chunks most like the mean of each label, over all chunks."""
    return search.similar(_queries(read), read("chunks"), 20)


@query("similar_by_distance", f"WITH {_CENTROIDS} SELECT {_SHOWN} FROM {_ranked(20, 'l2')}")
def _(read):
    return search.similar(_queries(read), read("chunks"), 20, metric="l2")


@query("similar_ann", f"WITH {_CENTROIDS} SELECT query_id::BIGINT AS query_id, 20::BIGINT AS chunks, true AS good FROM q")
def _(read):
    """How many chunks the approximate search gives each query, and whether 18 of the exact 20 are among them."""
    queries, chunks = _queries(read), read("chunks")
    found = search.similar_ann(queries, chunks, 20, knn.train_lists(chunks, 20, recall=0.99)).select("query_id", "chunk_id")
    exact = search.similar(queries, chunks, 20).select("query_id", "chunk_id", F.lit(1).alias("hit"))
    joined = found.join(exact, ["query_id", "chunk_id"], "left")
    return joined.groupBy("query_id").agg(F.count("*").alias("chunks"), (F.count("hit") >= 18).alias("good"))


@query("similar_models", f"""WITH {_CENTROIDS}, pairs AS (SELECT q.query_id, 'short' AS model, list_resize(q.qv, 16) AS qv FROM q UNION ALL SELECT q.query_id + 100, 'long', q.qv FROM q),
    c AS (SELECT chunk_id, file_path, text, CASE WHEN chunk_id % 3 = 0 THEN 'short' ELSE 'long' END AS model,
      CASE WHEN chunk_id % 3 = 0 THEN list_resize(embedding::DOUBLE[], 16) ELSE embedding::DOUBLE[] END AS e FROM {_CHUNKS.rsplit(' ', 1)[0]} x)
    SELECT query_id::BIGINT AS query_id, rank, chunk_id, file_path, score, text FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
      FROM (SELECT p.query_id, c.chunk_id, c.file_path, c.text, round(-list_distance(c.e, p.qv), 6) AS score FROM pairs p JOIN c USING (model)) a) b WHERE rank <= 20""")
def _(read):
    """Two models with vectors of different widths: each query meets its own, and queries without a vector meet none."""
    queries = _queries(read)
    short = queries.select("query_id", F.lit("short").alias("model"), F.slice("embedding", 1, 16).alias("embedding"))
    long = queries.select(F.col("query_id") + 100, F.lit("long"), "embedding")
    none = queries.select(F.col("query_id") + 200, F.lit("long"), F.lit(None).cast("array<double>"))
    own = F.when(F.col("chunk_id") % 3 == 0, "short").otherwise("long")
    cut = F.when(F.col("chunk_id") % 3 == 0, F.slice("embedding", 1, 16)).otherwise(F.col("embedding"))
    chunks = read("chunks").withColumn("embedding", cut).withColumn("model", own)
    return search.similar(short.union(long).union(none), chunks, 20, metric="l2")


@query("index_round_trip", f"SELECT chunk_id, file_path, true AS listed FROM {_CHUNKS}")
def _(read):
    """The index written by list to the shared folder and read back."""
    path = fresh_folder(read.spark, "index")
    tables.write_index(read("chunks"), path)
    stored, lists = tables.read_index(read.spark, path)
    n = max(len(c) for c in lists.centres.values())
    return stored.select("chunk_id", "file_path", F.col("bucket").between(0, n - 1).alias("listed"))


_GROUPS = f"""(SELECT query_id, string_agg(file_path, ',' ORDER BY rank) AS files, string_agg(printf('%.6f', score), ',' ORDER BY rank) AS scores,
   list(file_path ORDER BY rank) AS listed FROM {_ranked(10)} GROUP BY query_id) g"""


@query("pattern_groups", f"WITH {_CENTROIDS} SELECT query_id::BIGINT AS query_id, files, scores FROM {_GROUPS}")
def _(read):
    groups = search.pattern_groups(_queries(read), read("chunks"))
    return groups.select(
        "query_id",
        F.array_join("files", ",").alias("files"),
        F.array_join(F.transform("scores", lambda s: F.format_string("%.6f", s)), ",").alias("scores"),
    )


@query(
    "pattern_ids",
    f"WITH {_CENTROIDS} SELECT query_id::BIGINT AS query_id, md5('label ' || query_id || ':' || array_to_string(list_sort(listed), '|')) AS pattern_id FROM {_GROUPS}",
)
def _(read):
    groups = search.pattern_groups(_queries(read), read("chunks"))
    name = F.concat(F.lit("label "), F.col("query_id").cast("string"))
    return groups.select("query_id", pattern_id(name, F.col("files")).alias("pattern_id"))


@query(
    "combine_patterns",
    f"""WITH {_CENTROIDS} SELECT file_path, string_agg('label ' || query_id, ' AND ' ORDER BY query_id) AS combined_pattern
    FROM {_ranked(10)} GROUP BY file_path""",
)
def _(read):
    groups = search.pattern_groups(_queries(read), read("chunks")).select(
        F.col("query_id").alias("group_no"), F.concat(F.lit("label "), F.col("query_id").cast("string")).alias("name"), "files"
    )
    return combine_patterns(groups)


@query("retrieve_examples", f"WITH {_CENTROIDS} SELECT {_SHOWN} FROM {_ranked(5)}")
def _(read):
    return search.retrieve_examples(_queries(read), read("chunks"))


@query(
    "context_for",
    f"WITH {_CENTROIDS} SELECT {_SHOWN} FROM {_ranked(10, 'cosine', 'c.chunk_id IN (SELECT o_custkey FROM orders)')}",
)
def _(read):
    """Search within the files that another table names."""
    files = read("orders").select(F.concat(F.lit("f"), F.col("o_custkey").cast("string"), F.lit(".py")).alias("file_path"))
    return search.context_for(_queries(read), files, read("chunks"))


# -- chunks and embeddings -------------------------------------------------------
_PIECES = f"""(SELECT doc_id, unnest(range(greatest(ceil((len(w) - 20) / 180.0), 1)::BIGINT)) AS chunk_no, w FROM (SELECT doc_id, {_words('text')} AS w FROM documents) x WHERE len(w) > 0) p"""


@query(
    "chunk_text",
    f"SELECT doc_id, chunk_no, array_to_string(w[chunk_no * 180 + 1:chunk_no * 180 + 200], ' ') AS text, len(w[chunk_no * 180 + 1:chunk_no * 180 + 200]) AS n_words FROM {_PIECES}",
)
def _(read):
    return search.chunk_text(read("documents").select("doc_id", F.col("text").alias("content")))


def _lengths(limit: int | None = None) -> str:
    """Counts of the words of a whole text by length; the mean of its pieces where a limit cuts it."""
    pieces = f"greatest(ceil(len(w) / {limit}.0), 1)" if limit else "1"
    dims = ", ".join(f"(10000 * (len(list_filter(w, lambda x: length(x) % 8 = {d})) / {pieces})::FLOAT)::BIGINT" for d in range(8))
    return f"array_to_string([{dims}], ',')"


def _joined(c):
    return F.array_join(F.transform(c, lambda x: F.floor(x.cast("double") * 10_000 + 0.5).cast("string")), ",")


@query(
    "embed",
    f"SELECT doc_id, {_lengths()} AS embedding, 'lengths' AS model FROM (SELECT doc_id, {_words('text')} AS w FROM documents) x",
)
def _(read):
    """Every document embedded by a caller's function, here one that counts word lengths."""
    chunks = read("documents").select("doc_id", "text")
    done = search.embed(chunks, word_length_embedder, batch_size=16, model="lengths")
    return done.select("doc_id", _joined("embedding").alias("embedding"), "model")


def _small_only(texts):
    if any(len(t.split()) > 100 for t in texts):
        raise ValueError("too large")
    return word_length_embedder(texts)


@query(
    "embed_with_fallback",
    f"""SELECT doc_id, {_lengths(250)} AS embedding, CASE WHEN len(w) > 100 THEN 'large' ELSE 'small' END AS model FROM (SELECT doc_id, {_words('text')} AS w FROM documents) x""",
)
def _(read):
    """A first provider that refuses long texts, and a second that takes them; both take 250 words at a time."""
    providers = [("small", _small_only), ("large", word_length_embedder)]
    done = search.embed_with_fallback(read("documents").select("doc_id", "text"), providers, batch_size=4, max_words=250)
    return done.select("doc_id", _joined("embedding").alias("embedding"), "model")


# -- text search -----------------------------------------------------------------
_SEARCHES = [
    ("migration", search.guide_query("migration", "the", "of")),
    ("documentation", search.guide_query("documentation", "and")),
    ("version", search.guide_query("documentation_version", "der", "le")),
    ("practices", search.guide_query("best_practices", "la", "de")),
    ("vulnerabilities", search.guide_query("vulnerabilities", "die", "la")),
]
_TOKENS = """t AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(txt), '[\\p{L}\\p{N}]+')) AS token FROM (VALUES """ + ", ".join(
    f"('{q}', '{t}')" for q, t in _SEARCHES
) + """) s(query_id, txt)), sizes AS (SELECT query_id, count(*) AS n FROM t GROUP BY query_id)"""
_HIDDEN = search.HIDDEN
_GUIDES = f"""g AS (SELECT page_id, url, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title,
   trim(regexp_replace(regexp_replace(regexp_replace(html, '{_HIDDEN}', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g')) AS text FROM pages)"""


def _guides(read):
    html = F.col("html")
    return with_once(read("pages").select("url", "html"), "text", search.html_text(html)).select("url", search.html_title(html).alias("title"), "text")


@query(
    "doc_search",
    f"""WITH {_TOKENS}, {_GUIDES}, pt AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(lower(title || ' ' || text), '[\\p{{L}}\\p{{N}}]+')) AS token FROM g),
      m AS (SELECT query_id, page_id, round(count(*) / any_value(n), 6) AS score FROM pt JOIN t USING (token) JOIN sizes USING (query_id) GROUP BY query_id, page_id),
      shown AS (SELECT query_id, url, title, score, text, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS snippet, lower(text) AS s FROM m JOIN g USING (page_id)),
      u AS (SELECT *, row_number() OVER (PARTITION BY query_id, url ORDER BY score DESC, title DESC, snippet DESC) AS place FROM shown),
      r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, url) AS rank FROM u WHERE place = 1)
    SELECT query_id, rank, url, title, snippet, score,
      CASE WHEN contains(s, 'critical') THEN 'critical' WHEN contains(s, 'high') THEN 'high' WHEN contains(s, 'medium') OR contains(s, 'moderate') THEN 'medium' WHEN contains(s, 'low') THEN 'low' ELSE 'unknown' END AS severity
    FROM r WHERE rank <= 5""",
)
def _(read):
    return search.doc_search(_guides(read), _SEARCHES)


_BM25 = f"""docs AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents), stats AS (SELECT count(*) AS n, avg(len(w)) AS avg FROM docs),
  tf AS (SELECT doc_id, nw, token, count(*) AS tf FROM (SELECT doc_id, len(w) AS nw, unnest(w) AS token FROM docs) x WHERE token IN (SELECT token FROM t) GROUP BY ALL),
  df AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
  bm AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * nw / avg))), 6) AS score
    FROM tf JOIN t USING (token) JOIN df USING (token), stats GROUP BY query_id, doc_id)"""


@query("keyword_scores", f"WITH {_TOKENS}, {_BM25} SELECT query_id, doc_id, score FROM bm")
def _(read):
    searches = read.spark.createDataFrame(_SEARCHES, "query_id string, text string")
    return search.keyword_scores(read("documents"), searches)


@query(
    "hybrid_search",
    f"""WITH {_TOKENS}, {_BM25}, {_CENTROIDS.replace('SELECT label AS query_id', 'SELECT CASE label ' + ' '.join(f"WHEN {i} THEN '{n}'" for i, (n, _) in enumerate(_SEARCHES)) + ' END AS query_id', 1).replace('FROM embeddings)', 'FROM embeddings WHERE label < 5)')},
      lists AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bm
        UNION ALL SELECT query_id, chunk_id, rank FROM {_ranked(1_000_000_000)}),
      fused AS (SELECT query_id, doc_id, round(sum(1 / (60 + rank)), 8) AS score FROM lists GROUP BY query_id, doc_id)
    SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM fused) x WHERE rank <= 10""",
)
def _(read):
    """Keyword and vector lists fused; the vector of a search is the mean of one label."""
    label_names = F.create_map(*[F.lit(x) for i, (n, _) in enumerate(_SEARCHES) for x in (i, n)])
    named = _queries(read).select(label_names[F.col("query_id")].alias("query_id"), "embedding").filter(F.col("query_id").isNotNull())
    return search.hybrid_search(read("documents"), _SEARCHES, named, read("chunks"))
