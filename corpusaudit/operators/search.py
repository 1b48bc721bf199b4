"""Chunks, embeddings and search.

Vectors are searched by ``knn``; words are counted in the task that reads a text
and scored block by block.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - pa.compute
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from corpusaudit.functions.once import with_once
from corpusaudit.functions.text import extract_severity, snippet, words
from corpusaudit.operators import knn
from corpusaudit.operators.grouping import Keys, key_list
from corpusaudit.session import stored

SCORE_DIGITS = 6
#: Words of searches that travel to the tasks together; more are answered in further scans.
MOST_WORDS = 100_000


# -- chunks and embeddings ---------------------------------------------------
def chunk_text(files: DataFrame, size: int = 200, overlap: int = 20) -> DataFrame:
    """Windows of ``size`` words that share ``overlap`` words; all words are covered."""
    step = size - overlap
    w = F.col("w")
    n_chunks = F.greatest(F.ceil((F.size(w) - overlap) / step), F.lit(1)).cast("int")

    def piece(i: Column) -> Column:
        part = F.slice(w, i * step + 1, size)
        return F.struct(F.array_join(part, " ").alias("text"), F.size(part).alias("n_words"))

    keys = [c for c in files.columns if c != "content"]
    return (
        with_once(files, "w", words(F.col("content")))
        .filter(F.size("w") > 0)
        .select(*keys, F.posexplode(F.transform(F.sequence(F.lit(0), n_chunks - 1), piece)).alias("chunk_no", "p"))
        .select(*keys, "chunk_no", "p.*")
    )


EmbedFn = Callable[[Sequence[str]], Sequence[Sequence[float]]]


def word_length_embedder(texts: Sequence[str], dim: int = 8) -> list[list[float]]:
    """Deterministic stand-in for a model: counts of words by length modulo ``dim``."""
    vectors = []
    for value in texts:
        counts = np.bincount([len(w) % dim for w in value.split()] or [0], minlength=dim).astype(float)
        if not value.split():
            counts[:] = 0.0
        vectors.append(counts.tolist())
    return vectors


def embed(
    chunks: DataFrame, embed_fn: EmbedFn, batch_size: int = 2, model: str = "default", max_words: int | None = None
) -> DataFrame:
    """Add ``embedding`` and ``model``; see ``embed_with_fallback``."""
    return embed_with_fallback(chunks, [(model, embed_fn)], batch_size, max_words)


def _pieces(value: str, max_words: int | None) -> list[str]:
    """The text itself, or all its words in pieces that the function takes."""
    own = value.split() if max_words else []
    if not max_words or len(own) <= max_words:
        return [value]
    return [" ".join(own[i : i + max_words]) for i in range(0, len(own), max_words)]


def embed_with_fallback(
    chunks: DataFrame, providers: Sequence[tuple[str, EmbedFn]], batch_size: int = 2, max_words: int | None = None
) -> DataFrame:
    """Embed with the first provider; a failing batch goes on text by text.

    Texts are embedded whole. Where the functions take no more than
    ``max_words`` words, a longer text is embedded in pieces and has the mean of
    their vectors. Each text then takes the first provider that accepts all of
    it. ``model`` tells whose vector it is; vectors of different models are never
    compared. A text that every provider refuses, and a null text, gets an
    ``error`` and no vector.
    """
    schema = chunks.select("*").schema
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    ddl += ", embedding array<float>, model string, error string"

    def mean(vectors: Sequence[Sequence[float]]) -> list[float]:
        return list(vectors[0]) if len(vectors) == 1 else np.mean(np.array(vectors, float), axis=0).tolist()

    def one(value: str | None) -> tuple[list[float] | None, str | None, str | None]:
        if value is None:
            return None, None, "no text"
        problems = []
        for name, fn in providers:
            try:
                return mean([fn([piece])[0] for piece in _pieces(value, max_words)]), name, None
            except Exception as problem:  # noqa: BLE001 - any failure of the caller's function
                problems.append(f"{name}: {problem}")
        return None, None, "; ".join(problems)

    def together(part: list[str | None]) -> list[tuple]:
        name, first = providers[0]
        pieces = [_pieces(value, max_words) for value in part if value is not None]
        if len(pieces) < len(part):
            return [one(value) for value in part]
        try:
            flat = [piece for own in pieces for piece in own]
            found = [v for i in range(0, len(flat), batch_size) for v in first(flat[i : i + batch_size])]
        except Exception:  # noqa: BLE001
            return [one(value) for value in part]
        ends = np.cumsum([len(own) for own in pieces])
        return [(mean(found[end - len(own) : end]), name, None) for own, end in zip(pieces, ends)]

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = frame["text"].tolist()
            results = [x for i in range(0, len(texts), batch_size) for x in together(texts[i : i + batch_size])]
            frame["embedding"], frame["model"], frame["error"] = (list(c) for c in zip(*results)) if results else ([], [], [])
            yield frame

    return chunks.mapInPandas(run, ddl)


# -- search --------------------------------------------------------------------
def _with_texts(ranked: DataFrame, chunks: DataFrame, k: int, n_queries: int, full_text: bool) -> DataFrame:
    """The hits with path and text; a few hits, by the number of queries, are looked up without moving texts."""
    hits = F.broadcast(ranked) if k * n_queries <= knn.TRAVEL_HITS else ranked
    shown = F.col("text") if full_text else snippet(F.col("text"))
    return chunks.select("chunk_id", "file_path", "text").join(hits, "chunk_id").select(
        "query_id", "rank", "chunk_id", "file_path", "score", shown.alias("text")
    )


def similar(queries: DataFrame, chunks: DataFrame, k: int = 20, metric: str = "cosine", full_text: bool = False) -> DataFrame:
    """The k most similar chunks of each query, ties by chunk id.

    ``queries`` has query_id and embedding; ``chunks`` chunk_id (once each),
    file_path, embedding and text; a ``model`` column on both is respected, and
    vectors are compared with those of their own width only. Scores are rounded
    to six digits before ranking; with ``l2`` they are negative distances. Rows
    without a usable vector take no part; ``knn.without_vector`` lists them.
    """
    ranked, n = knn.nearest(queries, chunks, k, metric)
    return _with_texts(ranked, chunks, k, n, full_text)


def similar_ann(
    queries: DataFrame, chunks: DataFrame, k: int = 20, lists: knn.Lists | None = None, metric: str = "cosine", full_text: bool = False
) -> DataFrame:
    """As ``similar``, looking only at the lists nearest to each query.

    Without ``lists`` they are trained here. Chunks that carry a ``bucket``, as
    an index does, are read only in the lists that some query looks at. A query
    always gets k chunks if there are as many.
    """
    lists = lists or knn.train_lists(chunks, k)
    if "bucket" not in chunks.columns:
        chunks = knn.with_list(chunks, lists)
    ranked, n = knn.nearest_in_lists(queries, chunks, lists, k, metric)
    return _with_texts(ranked, chunks, k, n, full_text)


# -- uses of search ----------------------------------------------------------
def centroids(chunks: DataFrame, by: str) -> DataFrame:
    """Mean vector per group as queries (query_id, embedding)."""
    return knn.means(chunks, by)


def pattern_groups(queries: DataFrame, chunks: DataFrame, k: int = 10) -> DataFrame:
    """Each query with the files and scores of its k best chunks, in rank order."""
    hits = similar(queries, chunks, k)
    ranked = F.sort_array(F.collect_list(F.struct("rank", "file_path", "score")))
    return hits.groupBy("query_id").agg(ranked.alias("hits")).select(
        "query_id", F.col("hits.file_path").alias("files"), F.col("hits.score").alias("scores")
    )


def retrieve_examples(queries: DataFrame, chunks: DataFrame, k: int = 5) -> DataFrame:
    """The k best chunks of each query with their whole text."""
    return similar(queries, chunks, k, full_text=True)


def context_for(queries: DataFrame, files: DataFrame, chunks: DataFrame, k: int = 10, key: Keys = "file_path") -> DataFrame:
    """Search restricted to the chunks of listed files; over many repositories ``key`` names the repository too."""
    wanted = files.select(*key_list(key)).distinct()
    return similar(queries, chunks.join(wanted, key_list(key), "left_semi"), k, full_text=True)


# -- text search -------------------------------------------------------------
TOKEN = r"[\p{L}\p{N}]+"
# The texts of guide searches.
GUIDE_QUERIES = {
    "migration": "{0} to {1} migration guide best practices",
    "documentation": "{0} official documentation",
    "documentation_version": "{0} official documentation version {1}",
    "best_practices": "{1} {0} best practices 2024",
    "vulnerabilities": "{1} {0} security vulnerability CVE",
}
# Results per kind of guide search.
GUIDE_RESULTS = {
    "migration": 5,
    "documentation": 3,
    "documentation_version": 3,
    "best_practices": 5,
    "vulnerabilities": 5,
}


def guide_query(kind: str, subject: str, other: str = "python") -> str:
    return GUIDE_QUERIES[kind].format(subject, other)


_TOKEN = re.compile(r"[^\W_]+")

Searches = Sequence[tuple[str, str]] | DataFrame


def word_list(value: str | None) -> list[str]:
    """Letters and digits in a row, in lower case."""
    return _TOKEN.findall((value or "").lower())


def _blocks(searches: Searches) -> Iterator[dict[str, list[str]]]:
    """Different words of each search (a list of id and text, or a table of query_id and text), ``MOST_WORDS`` or so at a time."""
    if not isinstance(searches, DataFrame):
        block: dict[str, list[str]] = {}
        held = 0
        for query_id, value in searches:
            block[query_id] = list(dict.fromkeys(word_list(value)))
            held += len(block[query_id])
            if held >= MOST_WORDS:
                yield block
                block, held = {}, 0
        if block:
            yield block
        return
    total = searches.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // (2 * MOST_WORDS))  # a word and its gap are two characters at least
    for i in range(n):
        rows = searches.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i).select("query_id", "text").collect()
        if rows:
            yield {r["query_id"]: list(dict.fromkeys(word_list(r["text"]))) for r in rows}


def _by_word(block: dict[str, list[str]]) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for query_id, own in block.items():
        for word in own:
            out.setdefault(word, []).append(query_id)
    return out


def _union(spark: SparkSession, frames: list[DataFrame], schema: str) -> DataFrame:
    return reduce(DataFrame.unionByName, frames) if frames else spark.createDataFrame([], schema)


HIDDEN = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->"


def html_text(html: Column) -> Column:
    """Text of a page without scripts, styles, comments and tags."""
    bare = F.regexp_replace(html, HIDDEN, " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"<[^>]*>", " "), r"[ \t\r\n]+", " "))


def html_title(html: Column) -> Column:
    return F.regexp_extract(html, r"(?is)<title>(.*?)</title>", 1)


_GUIDE_HITS = "query_id string, url string, score double, title string, snippet string, severity string"


def doc_search(guides: DataFrame, searches: Searches, k: int = 5) -> DataFrame:
    """The k guides that share most words with each search text, ties by URL.

    ``guides`` has url, title, text. The score is the share of the search's words
    found in title or text; the severity is judged on the whole text. A URL that
    occurs more than once counts by its best row, then the last by title. Each
    task keeps its best k per search, so only those leave it.
    """
    rows = guides.select(
        "url", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(snippet(F.col("text")), F.lit("")).alias("snippet"), extract_severity(F.coalesce("text", F.lit(""))).alias("severity"),
    ).where("url IS NOT NULL")
    found = [rows.mapInArrow(_guide_scorer(block, k), _GUIDE_HITS) for block in _blocks(searches)]
    hits = _union(guides.sparkSession, found, _GUIDE_HITS)
    best = hits.groupBy("query_id", "url").agg(F.max(F.struct("score", "title", "snippet", "severity")).alias("b")).select("query_id", "url", "b.*")
    window = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("url"))
    ranked = best.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "url", "title", "snippet", "score", "severity")


def _guide_scorer(block: dict[str, list[str]], k: int):
    by_word = _by_word(block)
    sizes = {query_id: len(own) for query_id, own in block.items()}

    def first(best: dict[str, tuple]) -> dict[str, tuple]:
        return dict(sorted(best.items(), key=lambda x: (-x[1][0], x[0]))[:k])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, dict[str, tuple]] = {query_id: {} for query_id in block}
        for batch in batches:
            for x in batch.to_pylist():
                seen = Counter(q for w in {*word_list(x["title"]), *word_list(x["text"])} if w in by_word for q in by_word[w])
                for query_id, n in seen.items():
                    best = kept[query_id]
                    row = (round(n / sizes[query_id], SCORE_DIGITS), x["title"], x["snippet"], x["severity"])
                    best[x["url"]] = max(best.get(x["url"], row), row)
                    if len(best) >= 8 * k + 64:
                        kept[query_id] = first(best)
        rows = [(q, url, *row) for q, best in kept.items() for url, row in first(best).items()]
        kinds = [pa.string(), pa.string(), pa.float64(), pa.string(), pa.string(), pa.string()]
        columns = list(zip(*rows)) if rows else [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=[f.split()[0] for f in _GUIDE_HITS.split(", ")])

    return run


#: Documents of a posting block, and (search, candidate) pairs that travel to the tasks together.
POSTING_BLOCK, MOST_CANDIDATES = 2048, 1 << 20


@dataclass
class _Keywords:
    """Posting blocks of one block of searches, and what BM25 needs of the corpus."""

    blocks: DataFrame
    by_word: dict[str, list[str]]
    idf: dict[str, float]
    mean: float
    k1: float
    b: float

    def scores(self, best: int | None = None) -> DataFrame:
        """(query_id, doc_id, score) of the documents that share a word with a search, or of the ``best`` in each task."""
        kind = self.blocks.schema["ids"].dataType.elementType
        schema = T.StructType([T.StructField("query_id", T.StringType()), T.StructField("doc_id", kind), T.StructField("score", T.DoubleType())])
        return self.blocks.mapInArrow(_bm25(self.by_word, self.idf, self.mean, self.k1, self.b, best), schema)


def _keywords(docs: DataFrame, block: dict[str, list[str]], k1: float, b: float) -> _Keywords:
    """The documents' posting blocks for the searched words, written, and the statistics that come from them."""
    by_word = _by_word(block)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"n long, words long, ids array<{kind}>, lengths array<int>, postings array<struct<word:string,most:int,shortest:int,docs:array<int>,times:array<int>>>"
    blocks = stored(docs.select("doc_id", "text").mapInArrow(_posting_blocks(by_word), schema), "posting-blocks")
    size = blocks.agg(F.sum("n").alias("n"), F.sum("words").alias("words")).first()
    n = size["n"] or 0
    listed = blocks.select(F.explode("postings").alias("p")).groupBy("p.word").agg(F.sum(F.size("p.docs")).alias("n")).collect()  # a row for each searched word
    idf = {r["word"]: math.log(1 + (n - r["n"] + 0.5) / (r["n"] + 0.5)) for r in listed}
    return _Keywords(blocks, by_word, idf, (size["words"] or 0) / n if n and size["words"] else 1.0, k1, b)


def keyword_scores(docs: DataFrame, searches: Searches, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """BM25 score of each search and document that share a word (columns doc_id, text).

    Texts are read once and written as posting blocks of the searched words; the
    statistics of the corpus and all scores come from there.
    """
    scored = [_keywords(docs, block, k1, b).scores() for block in _blocks(searches)]
    return _union(docs.sparkSession, scored, f"query_id string, doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def _posting_blocks(by_word: dict[str, list[str]]):
    """A row for every ``POSTING_BLOCK`` documents: how many, their words, and of those with a searched word the ids, lengths and postings.

    A posting carries the largest count of its word and the shortest document it
    is in, which bound the score of every document of the block.
    """
    known = frozenset(by_word)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, ids, lengths, postings = 0, 0, [], [], {}

        def block(kind: pa.DataType) -> pa.RecordBatch:
            rows = [
                {"word": w, "most": max(times), "shortest": min(lengths[d] for d in own), "docs": own, "times": times} for w, (own, times) in postings.items()
            ]
            posting = pa.list_(pa.struct([("word", pa.string()), ("most", pa.int32()), ("shortest", pa.int32()), ("docs", pa.list_(pa.int32())), ("times", pa.list_(pa.int32()))]))
            cells = ((n, pa.int64()), (total, pa.int64()), (ids, pa.list_(kind)), (lengths, pa.list_(pa.int32())), (rows, posting))
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in cells], names=["n", "words", "ids", "lengths", "postings"])

        kind = None
        for batch in batches:
            kind = batch.schema.field("doc_id").type
            for key, x in zip(batch.column("doc_id"), batch.column("text")):
                own = word_list(x.as_py())
                seen = Counter(filter(known.__contains__, own))
                n, total = n + 1, total + len(own)
                for word, times in seen.items():
                    docs, counts = postings.setdefault(word, ([], []))
                    docs.append(len(ids))
                    counts.append(times)
                if seen:
                    ids.append(key.as_py())
                    lengths.append(len(own))
                if n >= POSTING_BLOCK:
                    yield block(kind)
                    n, total, ids, lengths, postings = 0, 0, [], [], {}
        if n:
            yield block(kind)

    return run


def _bm25(by_word: dict[str, list[str]], idf: dict[str, float], mean: float, k1: float, b: float, best: int | None):
    def gain(word: str, times, length):
        return idf[word] * times * (k1 + 1) / (times + k1 * (1 - b + b * length / mean))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None
        kept: dict[str, tuple[np.ndarray, list]] = {}
        for batch in batches:
            kind = batch.schema.field("ids").type.value_type
            for row in batch.to_pylist():
                lengths = np.array(row["lengths"], float)
                asked: dict[str, list[dict]] = {}
                for posting in row["postings"]:
                    for q in by_word[posting["word"]]:
                        asked.setdefault(q, []).append(posting)
                for q, own in asked.items():
                    if best is not None and q in kept and len(kept[q][0]) >= best:
                        # No document of the block can have more than all its words at their largest count in its shortest document.
                        if round(sum(gain(p["word"], p["most"], p["shortest"]) for p in own) + 1e-9, SCORE_DIGITS) < kept[q][0][-1]:
                            continue
                    total, hit = np.zeros(len(lengths)), np.zeros(len(lengths), bool)
                    for p in own:
                        at = np.array(p["docs"])
                        total[at] += gain(p["word"], np.array(p["times"], float), lengths[at])
                        hit[at] = True
                    at = np.flatnonzero(hit)
                    score, ids = np.array([round(float(x), SCORE_DIGITS) for x in total[at]]), [row["ids"][i] for i in at]
                    if best is None:
                        yield _scored([q] * len(ids), ids, score, kind)
                        continue
                    if q in kept:
                        score, ids = np.concatenate([kept[q][0], score]), kept[q][1] + ids
                    order = sorted(range(len(ids)), key=lambda i: (-score[i], ids[i]))[:best]
                    kept[q] = score[order], [ids[i] for i in order]
        for q, (score, ids) in kept.items():
            yield _scored([q] * len(ids), ids, score, kind)

    return run


def _scored(queries: list[str], ids: list, score: np.ndarray, kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(queries, pa.string()), pa.array(ids, kind), pa.array(score, pa.float64())], names=["query_id", "doc_id", "score"])


# -- both lists ----------------------------------------------------------------
#: What is added to a rank before its reciprocal is taken, and digits of a fused score.
RANK_OFFSET, FUSED_DIGITS = 60, 8


def enough_depth(k: int) -> int:
    """Ranks of both lists after which no document that is in neither can be among the best k.

    The first k of either list have 1 / (60 + k) at least, and a document that
    neither list shows down to a depth has less than two reciprocals of it.
    """
    depth = 2 * k + RANK_OFFSET
    while round(2 / (RANK_OFFSET + depth + 1), FUSED_DIGITS) >= round(1 / (RANK_OFFSET + k), FUSED_DIGITS):
        depth += 1
    return depth


def hybrid_search(
    docs: DataFrame, searches: Searches, queries: DataFrame, chunks: DataFrame, k: int = 10, depth: int | None = None
) -> DataFrame:
    """Keyword and vector lists joined by reciprocal rank, the best k documents of each search.

    ``docs`` has doc_id, text; a chunk's ``chunk_id`` is the id of its document;
    ``queries`` holds the vector of each search under the same query_id. Whole
    lists are joined; ``depth`` takes only that many documents of each.

    Neither list is sorted or written whole. Tasks keep the first documents of
    each search, as many as make the result certain (``enough_depth``). Those
    that only one list shows have their place in the other one counted: how many
    rows there are better.
    """
    seen = depth or enough_depth(k)
    fused = [_fused(docs, block, queries, chunks, seen, depth is None) for block in _small_blocks(searches, seen)]
    asked = searches.select("query_id") if isinstance(searches, DataFrame) else docs.sparkSession.createDataFrame([(q,) for q, _ in searches], "query_id string")
    alone = queries.join(asked, "query_id", "left_anti")
    if not alone.isEmpty():  # vectors without words
        fused.append(_fused(docs, {}, alone, chunks, seen, depth is None))
    kind = docs.schema["doc_id"].dataType.simpleString()
    both = _union(docs.sparkSession, fused, f"query_id string, doc_id {kind}, rank int")
    total = both.groupBy("query_id", "doc_id").agg(F.round(F.sum(1 / (RANK_OFFSET + F.col("rank"))), FUSED_DIGITS).alias("score"))
    return total.withColumn("rank", _rank()).filter(F.col("rank") <= k)


def _rank() -> Column:
    return F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("doc_id")))


def _small_blocks(searches: Searches, depth: int) -> Iterator[dict[str, list[str]]]:
    """Blocks of searches whose candidates travel together."""
    most = max(1, MOST_CANDIDATES // (2 * depth))
    for block in _blocks(searches):
        names = list(block)
        for i in range(0, len(names), most):
            yield {q: block[q] for q in names[i : i + most]}


def _fused(docs: DataFrame, block: dict[str, list[str]], queries: DataFrame, chunks: DataFrame, seen: int, whole: bool) -> DataFrame:
    """(query_id, doc_id, rank): a row for each list that a candidate of these searches is in."""
    asked = queries.where(F.col("query_id").isin(*block)) if block else queries
    words = _keywords(docs, block, 1.2, 0.75) if block else None
    by_vector = stored(knn.nearest(asked, chunks, seen)[0].select("query_id", F.col("chunk_id").alias("doc_id"), "score", "rank"), "vector-list")
    if words is None:
        return by_vector.select("query_id", "doc_id", "rank")
    ranked = words.scores(seen).withColumn("rank", _rank()).where(F.col("rank") <= seen)
    by_words = stored(ranked, "word-list")
    lists = [by_words, by_vector]
    if whole:
        only_words = by_words.join(by_vector, ["query_id", "doc_id"], "left_anti").select("query_id", "doc_id")
        only_vector = by_vector.join(by_words, ["query_id", "doc_id"], "left_anti").select("query_id", "doc_id")
        lists += [_places(words.scores(), only_vector), knn.places(asked, chunks, only_words)]
    return reduce(DataFrame.unionByName, [x.select("query_id", "doc_id", F.col("rank").cast("int").alias("rank")) for x in lists])


def _places(scored: DataFrame, wanted: DataFrame) -> DataFrame:
    """(query_id, doc_id, rank) of the ``wanted`` (query_id, doc_id, at most ``MOST_CANDIDATES``) in the order of all scores.

    Each task counts its better rows for every wanted one; those that have no
    score are in no place.
    """
    by_query: dict[str, list[tuple]] = {}
    for r in scored.join(F.broadcast(wanted), ["query_id", "doc_id"]).collect():
        by_query.setdefault(r["query_id"], []).append((r["score"], r["doc_id"]))
    sent = scored.sparkSession.sparkContext.broadcast(by_query)
    kind = scored.schema["doc_id"].dataType
    arrow = to_arrow_type(kind)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ahead = {q: knn.Ahead(own) for q, own in sent.value.items()}
        for batch in batches:
            for part in batch.column("query_id").dictionary_encode().dictionary.to_pylist() if batch.num_rows else ():
                if part in ahead:
                    own = batch.filter(pa.compute.equal(batch.column("query_id"), part))
                    ahead[part].add(own.column("score").to_numpy(), own.column("doc_id").to_pylist())
        rows = [(q, key, n) for q, own in ahead.items() for key, n in own.rows()]
        columns = list(zip(*rows)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), arrow, pa.int64()))], names=["query_id", "doc_id", "better"])

    counted = scored.mapInArrow(run, f"query_id string, doc_id {kind.simpleString()}, better long")
    return counted.groupBy("query_id", "doc_id").agg((F.sum("better") + 1).alias("rank"))
