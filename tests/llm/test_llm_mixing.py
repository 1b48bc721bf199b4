"""Raking: marginals hold, plain counterpart, native plan and odd rows."""

import numpy as np
from pyspark.sql import functions as F

from corpusaudit.llm import mixing, queries

_SCHEMA = "doc_id long, text string, lang string, source string, tokens int, probability double, kept string"


def _docs(spark):
    rows = [(i, "word " * (1 + i % 17) + ("License" if i % 5 == 0 else " | " if i % 7 == 0 else ""), ["en", "de", None][i % 3], f"s{i % 4 if i % 2 else 0}") for i in range(400)]
    rows += [(900, None, "en", "s0"), (901, "", "en", "s0"), (None, "a b", "en", "s1"), (902, " \n", None, None), (903, "x" * 200_000, None, None), (5, "word", "en", "s1"), (5, "word", "en", "s1"), (904, None, "zz", "empty")]
    return spark.createDataFrame([(*r, 1, 2.0, "x") for r in rows], _SCHEMA)


def _plain(cells, targets, rounds, share=0.5):
    """Raking, and the scale by halving."""
    w = {c: float(n) for c, n in cells.items() if n > 0}
    for _ in range(rounds):
        for d, target in enumerate(targets):
            sums = {}
            for c, x in w.items():
                sums[c[d]] = sums.get(c[d], 0) + x
            w = {c: x * target[c[d]] / sums[c[d]] for c, x in w.items()}
    low, high = 0.0, 1e18
    for _ in range(300):
        c = (low + high) / 2
        low, high = (c, high) if sum(min(cells[x], c * w[x]) for x in w) < share * sum(cells.values()) else (low, c)
    return {x: min(1.0, high * w[x] / cells[x]) for x in w}


def _cells_and_targets(rows):
    cells = {}
    for r in rows:
        c = (r["source"], r["lang"], r["topic"])
        cells[c] = cells.get(c, 0) + r["tokens"]
    targets = []
    for d, name in enumerate(mixing.DIMENSIONS):
        sums = {}
        for c, n in cells.items():
            sums[c[d]] = sums.get(c[d], 0) + n
        raised = {v: n ** mixing.TEMPER[name] for v, n in sums.items() if n}
        targets.append({v: x / sum(raised.values()) for v, x in raised.items()})
    return cells, targets


def test_equals_plain_raking(spark):
    docs = _docs(spark)
    got = mixing.mix(docs, rounds=4, tolerance=0.0).collect()
    assert len(got) == docs.count()
    cells, targets = _cells_and_targets(got)
    chance = _plain(cells, targets, 4)
    for r in got:
        assert abs(r["probability"] - chance.get((r["source"], r["lang"], r["topic"]), 0)) < 1e-6
        assert (r["tokens"] > 0 or not r["kept"]) and r["fit_error"] > 0
    assert abs(sum(chance[c] * cells[c] for c in chance) / sum(cells.values()) - 0.5) < 1e-9
    assert {r["topic"] for r in got} >= {"legal", "table", "short", "prose", None}
    kept = mixing.sample(docs, rounds=4, tolerance=0.0)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r["doc_id"]) for r in got if r["kept"])


def test_equals_raking_to_convergence(spark):
    rows = [(i, "w " * (1 + i % 23), ["en", "de", "fr"][i % 3], f"s{i % 4 if i % 2 else 0}") for i in range(300)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), dimensions={"source": F.col("source"), "lang": F.col("lang")}).collect()
    cells, targets = _cells_and_targets([{**r.asDict(), "topic": None} for r in got])
    chance = _plain(cells, targets, 1000)
    assert all(abs(r["probability"] - chance[r["source"], r["lang"], None]) < 1e-6 and r["fit_error"] == 0 for r in got)


def test_the_error_that_is_left_is_told(spark):
    """Two sources that are each one language can't have other shares than their languages."""
    cells = spark.createDataFrame([("a", "x", 10), ("b", "y", 30)], "source string, lang string, tokens long")
    want = {"source": spark.createDataFrame([("a", 0.5), ("b", 0.5)], "value string, share double"), "lang": spark.createDataFrame([("x", 0.25), ("y", 0.75)], "value string, share double")}
    got = mixing.fit(cells, want, rounds=5).collect()
    assert {r["source"]: r["weight"] for r in got} == {"a": 0.25, "b": 0.75} and abs(got[0]["fit_error"] - 0.5) < 1e-12


def test_a_rare_cell_leaves_the_others_sample(spark):
    """The sample grows with the documents, and one rare document changes the others' by less than one per cent."""
    sizes = []
    for n in (200, 8_000):
        docs = spark.range(n).selectExpr("id AS doc_id", "repeat('w ', 40) AS text", "if(id % 3 = 0, 'de', 'en') AS lang", "concat('s', id % 4) AS source")
        rare = spark.createDataFrame([(10**9, "one two three four five", "zz", "rare")], docs.schema)
        alone = mixing.sample(docs).count()
        both = mixing.sample(docs.unionByName(rare)).where("doc_id < 1000000000").count()
        assert abs(both - alone) <= max(2, 0.01 * alone) and abs(alone / n - 0.5) < 0.1
        sizes.append(both)
    assert sizes[1] > 30 * sizes[0]


def test_small_probabilities_decide_unrounded(spark):
    """A cell far below the largest ratio keeps its share of documents."""
    facts = spark.range(200_000).selectExpr("id AS doc_id", "if(id < 20, 'rare', 'common') AS kind", "'a' AS text")
    want = {"kind": spark.createDataFrame([("rare", 0.5), ("common", 0.5)], "value string, share double")}
    got = mixing.mix(facts, want, dimensions={"kind": F.col("kind")}, share=0.0002).where("kind = 'common'").agg(F.sum(F.col("kept").cast("int")), F.max("probability")).first()
    assert 5 <= got[0] <= 40 and 0 < got[1] < 0.001


def test_given_targets_hold(spark):
    r = np.random.default_rng(1)
    rows = [(f"s{a}", f"l{b}", int(r.integers(1, 1000))) for a in range(6) for b in range(4)]
    cells = spark.createDataFrame(rows + [("s9", "l0", 50), (None, "l1", 70)], "source string, lang string, tokens long")
    want = {
        "source": spark.createDataFrame([(f"s{a}", 1.0 + a) for a in range(6)] + [(None, 2.0), ("none", 5.0), ("s9", -1.0)], "value string, share double"),
        "lang": spark.createDataFrame([(f"l{b}", 0.25) for b in range(4)], "value string, share double"),
    }
    got = mixing.fit(cells, want)
    assert got.count() == len(rows) + 2
    by_source = {r["source"]: r["w"] for r in got.groupBy("source").agg(F.sum("weight").alias("w")).collect()}
    by_lang = {r["lang"]: r["w"] for r in got.groupBy("lang").agg(F.sum("weight").alias("w")).collect()}
    assert by_source["s9"] == 0 and all(abs(by_source[f"s{a}"] - (1 + a) / 23) < 1e-9 for a in range(6)) and abs(by_source[None] - 2 / 23) < 1e-9
    assert all(abs(x - 0.25) < 1e-9 for x in by_lang.values())


def test_sample_follows_probabilities(spark):
    docs = spark.range(20_000).selectExpr("id AS doc_id", "'a b c' AS text", "'en' AS lang", "if(id % 4 = 0, 'x', 'y') AS source")
    mixed = mixing.mix(docs, share=0.3)
    got = mixed.groupBy("source").agg(F.avg(F.col("kept").cast("int")).alias("kept"), F.max("probability").alias("p")).collect()
    assert all(abs(r["kept"] - r["p"]) < 0.02 for r in got)
    reached = {r["value"]: r["expected"] for r in mixing.shares(mixed, "source").collect()}
    assert abs(reached["x"] - 0.5 / (0.5 + 0.75**0.5)) < 1e-5  # the tempered share


def test_no_documents(spark):
    docs = _docs(spark).limit(0)
    assert mixing.mix(docs).count() == 0 and mixing.sample(docs).count() == 0


def test_no_python_and_no_pairing_in_the_plan(spark, sf_dir):
    plan = queries.QUERIES["op6_mixing"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "Cartesian", "NestedLoop"))
