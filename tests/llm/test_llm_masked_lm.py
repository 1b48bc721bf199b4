"""Windows, gradients, distributed counts and scores against plain loops; odd rows; what the network learns."""

import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from corpusaudit.llm import masked_lm as lm
from corpusaudit.llm import queries


def _docs(spark):
    r = random.Random(1)
    words = "the of and a to in is that for it".split()
    texts = [" ".join(r.choice(words) for _ in range(r.randint(1, 60))) for _ in range(150)]
    rows = [(i, t, 0.5, 3) for i, t in enumerate(texts)] + [(500, None, 0.5, 3), (501, "", 0.5, 3), (502, "A\0b", 0.5, 3), (503, "é", 0.5, 3), (None, texts[0], None, None), (1, texts[1], 0.5, 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, score double, tokens int")


def _plain_windows(text, symbol):
    s = [0, 0, *(symbol[b or 1] for b in (text or "").encode()), 0, 0]
    return [(s[i - 2], s[i - 1], s[i + 1], s[i + 2], s[i]) for i in range(2, len(s) - 2)]


def _code(window):
    return sum(int(x) << lm.BITS * (4 - i) for i, x in enumerate(window))


def test_windows_are_counted_exactly(spark, monkeypatch):
    docs = _docs(spark)
    symbol = lm.symbols(docs)
    assert symbol[0] == 0 and symbol.max() == lm.SYMBOLS - 1 and symbol[ord("A")] == symbol[ord("a")]
    expected = Counter(_code(w) for r in docs.collect() for w in _plain_windows(r["text"], symbol))
    monkeypatch.setattr(lm, "COUNTED", 100)
    for piece in (1 << 22, 7):
        monkeypatch.setattr(lm, "PIECE", piece)
        assert {r["code"]: r["n"] for r in lm.window_counts(docs, symbol).collect()} == expected


def test_scores_equal_a_plain_loop(spark, monkeypatch):
    docs = _docs(spark)
    network = lm.Network(lm.symbols(docs), lm.start(3))
    embedding, inner, inner_bias, outer, outer_bias = (w.astype(float) for w in network.weights)
    monkeypatch.setattr(lm, "PIECE", 50)
    got = lm.score(docs, network).collect()
    assert len(got) == docs.count()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in got:
        total, windows = 0.0, _plain_windows(texts[r["doc_id"]], network.symbol)
        for *around, target in windows:
            z = np.tanh(np.concatenate([embedding[a] for a in around]) @ inner + inner_bias[0]) @ outer + outer_bias[0]
            total += z[target] - math.log(sum(math.exp(x) for x in z[1:]))
        assert r["tokens"] == len(windows) and abs(r["log_likelihood"] - total) < 1e-3 * (1 + len(windows) / 10)
        assert (r["score"] is None) == (not windows)


def test_gradients_equal_differences():
    r = np.random.default_rng(0)
    weights = [w.astype(np.float64) for w in lm.start(1)]
    contexts = r.integers(0, lm.CONTEXTS, 20)
    counts = r.integers(0, 4, (20, lm.SYMBOLS)).astype(np.float64)
    counts[:, 0], total = 0, 50.0

    def loss():
        return -(counts * lm._forward(weights, contexts)[-1]).sum() / total

    for w, g in zip(weights, lm._gradients(weights, contexts, counts, total)):
        used = np.argwhere(np.abs(g) > 1e-4)[:3]
        for place in map(tuple, used):
            kept = w[place]
            w[place] = kept + 1e-5
            up = loss()
            w[place] = kept - 1e-5
            down = loss()
            w[place] = kept
            assert abs((up - down) / 2e-5 - g[place]) < 1e-4


def test_the_network_learns_from_both_sides(spark):
    docs = spark.createDataFrame([(i, "abcab" * 30 if i % 2 else "xbyxb" * 30) for i in range(40)], "doc_id long, text string")
    network = lm.fit(docs, rounds=10)
    new = spark.createDataFrame([(1, "abcabab" * 3), (2, "axcxbax" * 3), (3, "ccbaacb" * 3)], "doc_id long, text string")
    scores = {r["doc_id"]: r["score"] for r in lm.score(new, network).collect()}
    assert scores[1] > scores[2] and scores[1] > scores[3]
    same = lm.fit(docs, rounds=10)
    assert all(np.allclose(a, b, atol=1e-3) for a, b in zip(network.weights, same.weights))


def test_shuffled_letters_score_lower(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) > 300").limit(60)
    network = lm.fit(docs, rounds=3)
    mixed = docs.withColumn("text", F.array_join(F.shuffle(F.split("text", "")), ""))
    one = {r["doc_id"]: r["score"] for r in lm.score(docs, network).collect()}
    two = {r["doc_id"]: r["score"] for r in lm.score(mixed, network).collect()}
    assert all(one[i] > two[i] for i in one)


def test_no_documents(spark):
    docs = _docs(spark).limit(0)
    assert lm.score(docs, lm.fit(docs)).count() == 0


def test_query_scores_every_document(spark, sf_dir):
    got = queries.QUERIES["op9_masked_lm"](spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert got.select("doc_id", "tokens").exceptAll(docs.selectExpr("doc_id", "cast(octet_length(text) as bigint)")).count() == 0
    assert got.count() == docs.count()
    per_letter = got.agg(F.sum("log_likelihood") / F.sum("tokens")).first()[0]
    assert -2.4 < per_letter < -0.5  # letters alone, without neighbours, cost about 2.9


def test_every_byte_is_told_apart(spark):
    symbol = lm.symbols(_docs(spark))
    assert len({int(symbol[b]) for b in range(1, 256)}) == 255 - 26
    r = random.Random(7)
    words = lambda letters, n: " ".join("".join(r.choice(letters) for _ in range(r.randint(2, 7))) for _ in range(n))
    latin = [(i, words("abcdefghijklmnopqrstuvwxyz.,", 400)) for i in range(20)]
    other = ["мир и труд " * 40, "2468 " * 80, "日本語 " * 40, "{[(<>)]}" * 60]
    docs = spark.createDataFrame(latin + [(100 + i, x) for i, x in enumerate(other)], "doc_id long, text string")
    network = lm.fit(docs)
    mixed = [(200 + i, "".join(r.sample(x, len(x)))) for i, x in enumerate(other)]
    scores = {x["doc_id"]: x["score"] for x in lm.score(docs.unionByName(spark.createDataFrame(mixed, docs.schema)), network).collect()}
    assert all(scores[100 + i] > scores[200 + i] + 0.5 for i in range(len(other)))


def test_shards_grow_with_the_windows(spark, monkeypatch):
    docs = _docs(spark)
    whole = lm.fit(docs, rounds=1)
    monkeypatch.setattr(lm, "SHARD", 10)
    sizes = []
    made = lm.stored
    monkeypatch.setattr(lm, "stored", lambda df, name: sizes.append((name, (out := made(df, name)).count())) or out)
    small = lm.fit(docs, rounds=1)
    sizes = dict(sizes)
    assert sizes["windows"] > lm.SHARDS and sizes["windows"] >= sizes["window-counts"] / 40
    assert all(a.shape == b.shape and np.isfinite(b).all() for a, b in zip(whole.weights, small.weights))


def test_answers_that_are_forgotten_are_the_same(monkeypatch):
    r, network = np.random.default_rng(1), lm.Network(lm.symbols(), lm.start(2))
    codes = r.integers(1, 1 << 5 * lm.BITS, 5000) | 1
    plain = network.log_probabilities(codes >> lm.BITS)[np.arange(5000), codes & (lm.SYMBOLS - 1)]
    monkeypatch.setattr(lm, "KNOWN", 1000)
    answers = lm._Answers(network)
    parts = [answers.of(codes[a : a + 700]) for a in range(0, 5000, 350)]
    assert all(np.allclose(x, plain[a : a + 700], atol=1e-4) for a, x in zip(range(0, 5000, 350), parts))
