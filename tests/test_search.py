"""Search against brute force, embedding fallbacks, text search."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusaudit import adapters
from corpusaudit.operators import knn, search


@pytest.fixture(scope="module")
def chunks(spark, sf_dir):
    return adapters.view(spark, sf_dir, "chunks").select("chunk_id", "file_path", "embedding", "text", "label").cache()


@pytest.fixture(scope="module")
def queries(chunks):
    return search.centroids(chunks, "label").cache()


def brute_force(chunks, queries, k):
    rows = sorted(chunks.collect(), key=lambda r: r["chunk_id"])
    m = np.array([r["embedding"] for r in rows], dtype=float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    best = set()
    for q in queries.collect():
        v = np.array(q["embedding"])
        scores = np.round(m @ (v / np.linalg.norm(v)), 6)
        order = sorted(range(len(rows)), key=lambda i: (-scores[i], rows[i]["chunk_id"]))[:k]
        best |= {(q["query_id"], n + 1, rows[i]["chunk_id"]) for n, i in enumerate(order)}
    return best


@pytest.mark.parametrize("parts", [1, 5])
def test_similar_equals_brute_force(chunks, queries, parts):
    found = search.similar(queries, chunks.repartition(parts), 7)
    assert {(r["query_id"], r["rank"], r["chunk_id"]) for r in found.collect()} == brute_force(chunks, queries, 7)


def test_many_queries_meet_blocks_in_parts(chunks, queries, monkeypatch):
    for name, value in (("TRAVEL_BYTES", 0), ("TRAVEL_HITS", 0), ("QUERY_BLOCK", 3), ("BLOCK", 20)):
        monkeypatch.setattr(knn, name, value)
    found = search.similar(queries, chunks, 7)
    assert {(r["query_id"], r["rank"], r["chunk_id"]) for r in found.collect()} == brute_force(chunks, queries, 7)


def test_large_k_returns_everything(chunks, queries):
    assert search.similar(queries, chunks, 10_000).count() == queries.count() * chunks.count()


def test_copies_tie_by_id(spark):
    chunks = spark.createDataFrame([(i, "f", [1.0, 0.0], "t") for i in range(100)], "chunk_id int, file_path string, embedding array<float>, text string")
    queries = spark.createDataFrame([("q", [2.0, 0.0])], "query_id string, embedding array<double>")
    found = search.similar(queries, chunks.repartition(9), 3).orderBy("rank")
    assert [r["chunk_id"] for r in found.collect()] == [0, 1, 2]


def test_zero_vectors_and_missing_ones(spark):
    chunks = spark.createDataFrame([(1, "f", [0.0, 0.0], "t"), (2, "f", None, "t"), (3, "f", [1.0], "t")],
                                   "chunk_id int, file_path string, embedding array<float>, text string")
    queries = spark.createDataFrame([("q", [2.0, 0.0])], "query_id string, embedding array<double>")
    assert [(r["chunk_id"], r["score"]) for r in search.similar(queries, chunks).collect()] == [(1, 0.0)]


def test_models_are_not_compared(spark):
    chunks = spark.createDataFrame([(1, "f", [1.0, 0.0], "t", "a"), (2, "f", [1.0, 0.0], "t", "b")],
                                   "chunk_id int, file_path string, embedding array<float>, text string, model string")
    queries = spark.createDataFrame([("q", [1.0, 0.0], "b")], "query_id string, embedding array<double>, model string")
    assert [r["chunk_id"] for r in search.similar(queries, chunks).collect()] == [2]


def test_no_queries(chunks, queries):
    assert search.similar(queries.limit(0), chunks).isEmpty()


def test_long_near_vectors_keep_their_distance(spark):
    r = np.random.default_rng(1)
    base = r.normal(size=64) * 1e4
    rows = [(i, "f", (base + r.normal(size=64) * 1e-3).tolist(), "t") for i in range(300)]
    chunks = spark.createDataFrame(rows, "chunk_id int, file_path string, embedding array<double>, text string")
    queries = spark.createDataFrame([("q", base.tolist())], "query_id string, embedding array<double>")
    exact = sorted((float(np.round(np.sqrt(((np.array(v) - base) ** 2).sum()), 6)), i) for i, _, v, _ in rows)[:10]
    found = search.similar(queries, chunks, 10, metric="l2").orderBy("rank").collect()
    assert [(-r["score"], r["chunk_id"]) for r in found] == exact


def test_widths_and_missing_vectors_side_by_side(spark):
    chunks = spark.createDataFrame(
        [(1, "f", [1.0, 0.0], "t"), (2, "f", [1.0], "t"), (3, "f", [float("nan"), 1.0], "t"), (4, "f", [], "t"), (5, "f", [None, 1.0], "t")],
        "chunk_id int, file_path string, embedding array<float>, text string",
    )
    queries = spark.createDataFrame([("a", [1.0, 1.0]), ("b", [2.0]), ("c", None), ("d", [1.0, 2.0, 3.0])], "query_id string, embedding array<double>")
    found = search.similar(queries, chunks, 3)
    assert sorted((r["query_id"], r["chunk_id"]) for r in found.collect()) == [("a", 1), ("b", 2)]
    assert sorted(r["chunk_id"] for r in knn.without_vector(chunks).collect()) == [3, 4, 5]
    assert [r["query_id"] for r in knn.without_vector(queries).collect()] == ["c"]


def _recall(found, exact):
    wanted = {(q, c) for q, _, c in exact}
    return len({(r["query_id"], r["chunk_id"]) for r in found} & wanted) / len(wanted)


def test_approximate_search_recall(chunks, queries):
    found = search.similar_ann(queries, chunks, 10, knn.train_lists(chunks, 10, recall=0.97)).collect()
    assert len(found) == 10 * queries.count()
    assert _recall(found, brute_force(chunks, queries, 10)) >= 0.9


def test_approximate_search_reads_little_of_clusters(spark):
    r = np.random.default_rng(2)
    centres = r.normal(size=(30, 16)) * 5
    rows = [(i, "f", (centres[i % 30] + r.normal(size=16)).tolist(), "t") for i in range(3000)]
    chunks = spark.createDataFrame(rows, "chunk_id int, file_path string, embedding array<double>, text string")
    queries = spark.createDataFrame([(i, (centres[i] + r.normal(size=16)).tolist()) for i in range(20)], "query_id int, embedding array<double>")
    lists = knn.train_lists(chunks, 10)
    key = (16, None)
    assert lists.probes[key] <= len(lists.centres[key]) / 5
    found = search.similar_ann(queries, chunks, 10, lists).collect()
    assert len(found) == 200 and _recall(found, brute_force(chunks, queries, 10)) >= 0.9
    many = search.similar_ann(queries, chunks, 500, lists).groupBy("query_id").count().collect()
    assert [r["count"] for r in many] == [500] * 20  # lists are added until they hold k


def test_means_equal_plain_ones(spark):
    rows = [(i % 3, [float(i), 1.0]) for i in range(50)] + [(None, [2.0, 4.0]), (1, None), (7, [1.0, 2.0, 3.0])]
    got = {r["query_id"]: r["embedding"] for r in knn.means(spark.createDataFrame(rows, "label int, embedding array<float>"), "label").collect()}
    assert got == {g: [np.mean([i for i in range(50) if i % 3 == g]), 1.0] for g in range(3)} | {None: [2.0, 4.0], 7: [1.0, 2.0, 3.0]}


def test_chunks_cover_all_words(spark):
    texts = [" ".join(str(i) for i in range(n)) for n in (1, 5, 6, 23)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, content string")
    rows = search.chunk_text(df, size=5, overlap=2).orderBy("i", "chunk_no").collect()
    for i, t in enumerate(texts):
        pieces = [r["text"].split() for r in rows if r["i"] == i]
        assert pieces[0] + [w for p in pieces[1:] for w in p[2:]] == t.split()
    assert search.chunk_text(df.withColumn("content", F.lit("  "))).isEmpty()


def test_embedding_fallback(spark):
    def small(texts):
        if any(len(t) > 3 for t in texts):
            raise ValueError("413")
        return [[1.0]] * len(texts)

    def large(texts):
        if "never" in texts[0]:
            raise ValueError("refused")
        return [[2.0]]

    df = spark.createDataFrame([(0, "a"), (1, "long text"), (2, "never this")], "chunk_id int, text string").coalesce(1)
    rows = search.embed_with_fallback(df, [("s", small), ("l", large)]).orderBy("chunk_id").collect()
    assert [(r["model"], r["embedding"]) for r in rows] == [("s", [1.0]), ("l", [2.0]), (None, None)]
    assert rows[2]["error"] == "s: 413; l: refused"


def test_texts_are_embedded_whole(spark):
    long = "a " * 300 + "bbb " * 300
    df = spark.createDataFrame([(0, long), (1, "a " * 300), (2, None), (3, "")], "chunk_id int, text string")
    whole = {r["chunk_id"]: r["embedding"] for r in search.embed(df, search.word_length_embedder).collect()}
    assert whole[0][1] == 300 and whole[0][3] == 300 and whole[1] != whole[0] and whole[2] is None

    def narrow(texts):
        assert all(len(t.split()) <= 250 for t in texts)
        return search.word_length_embedder(texts)

    pieces = {r["chunk_id"]: r["embedding"] for r in search.embed(df, narrow, max_words=250).collect()}
    assert pieces[0][1] == 100 and pieces[0][3] == 100


def test_guide_queries():
    assert search.guide_query("migration", "MySQLdb", "SQLAlchemy") == "MySQLdb to SQLAlchemy migration guide best practices"
    assert search.guide_query("vulnerabilities", "eval") == "python eval security vulnerability CVE"


def test_doc_search_by_shared_words(spark):
    guides = spark.createDataFrame([("u1", "Flask guide", "migration of Flask"), ("u2", "other", "guide"), ("u3", "none", "")],
                                   "url string, title string, text string")
    found = search.doc_search(guides, [("q", "flask migration guide")], 2).orderBy("rank").collect()
    assert [(r["url"], r["score"]) for r in found] == [("u1", 1.0), ("u2", 0.333333)]
    many = spark.createDataFrame([(f"q{i:04}", "guide" if i else "flask") for i in range(1500)], "query_id string, text string")
    assert search.doc_search(guides, many, 1).count() == 1500


def test_repeated_urls_and_late_severity(spark):
    guides = spark.createDataFrame([("u", "t", "word " * 100 + "critical"), ("u", "t", "word other"), ("v", "t", "word"), (None, "t", "word"), ("w", None, None)],
                                   "url string, title string, text string")
    found = search.doc_search(guides, [("q", "word other")]).orderBy("rank").collect()
    assert [(r["rank"], r["url"], r["score"]) for r in found] == [(1, "u", 1.0), (2, "v", 0.5)]
    alone = search.doc_search(guides.limit(1), [("q", "word")]).first()
    assert alone["severity"] == "critical" and len(alone["snippet"]) == 203


def test_keyword_scores_for_many_words(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"alpha beta{i % 7} " * (i % 3 + 1)) for i in range(40)] + [(99, None)], "doc_id long, text string")
    searches = [(f"q{i}", f"beta{i} alpha") for i in range(7)]
    whole = {(r["query_id"], r["doc_id"]): r["score"] for r in search.keyword_scores(docs, searches).collect()}
    assert len(whole) == 280
    monkeypatch.setattr(search, "MOST_WORDS", 3)
    table = spark.createDataFrame(searches, "query_id string, text string")
    for given in (searches, table):
        assert {(r["query_id"], r["doc_id"]): r["score"] for r in search.keyword_scores(docs, given).collect()} == whole
    assert search.keyword_scores(docs, []).isEmpty()


def _fused_by_sorting(docs, searches, vectors, chunks, k):
    """Both whole lists sorted and joined."""
    by_words, out = {}, []
    n = len(docs)
    mean = sum(len(search.word_list(t)) for _, t in docs) / n
    for q, text in searches:
        for d, t in docs:
            own, score = Counter(search.word_list(t)), 0.0
            length = sum(own.values())
            for w in dict.fromkeys(search.word_list(text)):
                if own[w]:
                    df = sum(w in search.word_list(x) for _, x in docs)
                    score += math.log(1 + (n - df + 0.5) / (df + 0.5)) * own[w] * 2.2 / (own[w] + 1.2 * (0.25 + 0.75 * length / mean))
            if score:
                by_words.setdefault(q, []).append((-round(score, 6), d))
    for q in {q for q, _ in searches} | set(vectors):
        total = {}
        lists = [sorted(by_words.get(q, []))]
        if q in vectors:
            unit = lambda v: np.array(v) / np.linalg.norm(v)
            lists.append(sorted((-round(float(unit(vectors[q]) @ unit(v)), 6), d) for d, v in chunks))
        for own in lists:
            for rank, (_, d) in enumerate(own, 1):
                total[d] = total.get(d, 0) + 1 / (60 + rank)
        best = sorted((-round(s, 8), d) for d, s in total.items())[:k]
        out += [(q, d, -s, i + 1) for i, (s, d) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("block, candidates", [(2048, 1 << 20), (16, 500)])
def test_hybrid_lists_are_joined_without_being_sorted(spark, monkeypatch, block, candidates):
    monkeypatch.setattr(search, "POSTING_BLOCK", block)
    monkeypatch.setattr(search, "MOST_CANDIDATES", candidates)
    rng = np.random.default_rng(3)
    docs = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "other", "words"], rng.integers(1, 9)))) for i in range(400)]
    chunks = [(i, rng.integers(-3, 4, 3).astype(float).tolist()) for i in range(40, 440)]
    chunks = [(i, v if any(v) else [1.0, 0.0, 0.0]) for i, v in chunks]
    searches = [("a", "alpha gamma"), ("b", "beta beta delta nothing"), ("c", "unknown")]
    vectors = {"a": [1.0, 2.0, 0.5], "c": [0.0, 1.0, -1.0], "d": [1.0, 1.0, 1.0]}
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    vecs = spark.createDataFrame([(i, f"f{i}", v, "") for i, v in chunks], "chunk_id long, file_path string, embedding array<double>, text string").repartition(3)
    asked = spark.createDataFrame(list(vectors.items()), "query_id string, embedding array<double>")
    for k in (1, 10):
        expected = _fused_by_sorting(docs, searches, vectors, chunks, k)
        for given in (searches, spark.createDataFrame(searches, "query_id string, text string")):
            found = search.hybrid_search(df, given, asked, vecs, k=k).collect()
            assert sorted((r["query_id"], r["doc_id"], r["score"], r["rank"]) for r in found) == expected
        if block == 16:
            break


def test_depth_that_makes_the_result_certain():
    assert search.enough_depth(10) == 80 and all(2 / (61 + search.enough_depth(k)) < 1 / (60 + k) for k in (1, 5, 100, 3000))


def test_hybrid_plan_sorts_no_list_whole(spark, monkeypatch):
    """No task gets more than the first rows of each task for a search."""
    monkeypatch.setattr(search, "POSTING_BLOCK", 64)
    docs = spark.range(0, 4000, 1, 4).selectExpr("id AS doc_id", "concat('alpha ', repeat('beta ', cast(id % 7 AS int))) AS text")
    words = search._keywords(docs, {"q": ["alpha", "beta"]}, 1.2, 0.75)
    assert words.scores().count() == 4000 and words.scores(10).count() <= 10 * words.blocks.rdd.getNumPartitions()


def test_listing_holds_few_vectors_at_once():
    """A task's memory doesn't grow with the number of lists times an Arrow batch's rows."""
    import tracemalloc
    from types import SimpleNamespace

    import pyarrow as pa
    from pyspark.sql import types as T

    r = np.random.default_rng(3)
    centres = knn._unit(r.normal(size=(800, 16)))
    centres[1] = centres[0]  # the first of equals
    lists = knn.Lists({(16, None): centres}, {(16, None): 3})
    v = np.concatenate([centres[:2], r.normal(size=(9998, 16))])
    chunks = SimpleNamespace(schema=T.StructType([T.StructField("embedding", T.ArrayType(T.DoubleType()))]), mapInArrow=lambda run, schema: run)
    chunks.drop = lambda name: chunks
    batch = pa.RecordBatch.from_arrays([pa.array(v.tolist(), pa.list_(pa.float64()))], names=["embedding"])
    run = knn.with_list(chunks, lists)
    tracemalloc.start()
    got = [x for part in run(iter([batch])) for x in part.column("bucket").to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == lists.near((16, None), v)[:, 0].tolist()
    assert peak < 40 << 20


def test_blocks_of_many_lists_are_passed_on_before_they_are_full(spark, monkeypatch):
    monkeypatch.setattr(knn, "HELD", 1)
    rows = spark.createDataFrame([(i, None, i % 40, [float(i), 1.0]) for i in range(400)], "id long, model string, list int, v array<double>").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        blocks = knn._packed(rows, 60, 4).select("list", "ids", "data").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(i for b in blocks for i in b["ids"]) == list(range(400))
    assert all(i % 40 == b["list"] for b in blocks for i in b["ids"]) and all(len(b["data"]) == 16 * len(b["ids"]) for b in blocks)
    assert len(blocks) > 40
