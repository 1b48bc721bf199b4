"""Contaminated documents against alignment of every item with every whole text; odd rows; pieces and passes."""

import random
import re

import pytest

from corpusaudit.llm import decontaminate as dc
from corpusaudit.llm import queries

_WORDS = [f"{a}{b}{c}" for a in "bdfg" for b in "aeiou" for c in "lmnrst"]
_SCHEMA = "doc_id long, text string, item_id int, score string"


def _words(text):
    return re.findall("[0-9a-z\u0080-\U0010ffff]+", re.sub("[ -‿]", " ", (text or "").lower()))


def _align(item, text):
    """Best points of a local alignment, cell by cell."""
    best, above = 0, [0] * (len(text) + 1)
    for a in item:
        now = [0]
        for j, b in enumerate(text):
            now.append(max(0, above[j] + (2 if a == b else -1), above[j + 1] - 1, now[j] - 1))
        best, above = max(best, *now), now
    return best


def _plain(docs, items, threshold=0.5):
    same = {}
    for i, t in items:
        if _words(t):
            same.setdefault(tuple(_words(t)), []).append(i)
    out = []
    for d, t, *_ in docs:
        for w, ids in same.items():
            least = min((i for i in ids if i is not None), default=None)
            if len(w) < dc.LEAST_WORDS:
                if tuple(_words(t)) == w:
                    out.append((d, least, 1.0, len(ids)))
                continue
            score = _align(w, _words(t)) / (2 * len(w))
            if score >= threshold - 1e-12 and score * len(w) >= dc.LEAST_WORDS - 1e-9:
                out.append((d, least, round(score, 9), len(ids)))
    return sorted(out, key=str)


def _got(spark, docs, items, **options):
    made = spark.createDataFrame(docs, _SCHEMA)
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    found = dc.contaminated(made, bench, **options).collect()
    kept = dc.keep_clean(made, bench, **options)
    assert kept.columns == made.columns
    bad = {str(r["doc_id"]) for r in found}
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(d[0]) for d in docs if str(d[0]) not in bad)
    return found, sorted(((r["doc_id"], r["item_id"], round(r["score"], 9), r["n_items"]) for r in found), key=str)


def _case(seed=1):
    r = random.Random(seed)
    text = lambda n: " ".join(r.choice(_WORDS) for _ in range(n))
    items = [(i, text(r.randint(12, 40)).capitalize() + ".") for i in range(12)]
    items += [(20, items[3][1].upper()), (21, "two words"), (22, "Lone"), (23, ""), (24, None), (None, items[1][1]), (25, "?!"), (None, text(15)), (26, "one two three four"), (27, text(5))]
    docs = []
    for d in range(60):
        words = items[r.randrange(12)][1].split()
        for _ in range(r.choice([0, 0, 1, 2, 4, 8])):
            at = r.randrange(len(words))
            words[at : at + r.choice([0, 1, 1])] = [r.choice(_WORDS)] * r.choice([0, 1, 1])
            words = words or ["x"]
        docs.append((d, text(r.randint(0, 80)) + " " + ", ".join(words) + "—" + text(r.randint(0, 80)), 1, "x"))
    docs += [(100 + d, text(100), 1, "x") for d in range(20)] + [(200, None, 1, "x"), (201, "", 1, "x"), (202, "so TWO-words", 1, "x"), (203, "a lone one", 1, "x"), (206, "Lone!", 1, "x"), (207, "Two, words", 1, "x"), (208, items[-1][1], 1, "x"), (209, items[-3][1], 1, "x")]
    docs += [(None, items[5][1], None, None), (7, items[2][1], 1, "x"), (204, (items[0][1] + " " + text(30) + " ") * 3, 1, "x"), (205, "Ünï " + items[4][1], 1, "x")]
    return docs + [(300 + i, text(20) + " " + items[6][1] + " " + text(20), 1, "x") for i in range(60)], items


def test_copies_and_edited_copies(spark):
    docs, items = _case()
    found, got = _got(spark, docs, items)
    expected = _plain(docs, items)
    whole = [x for x in expected if x[2] > 0.7]
    assert set(map(str, whole)) <= set(map(str, got)) <= set(map(str, expected))
    assert len(got) >= 0.95 * len(expected)
    for r in found:
        if r["score"] == 1.0:
            places = [_words(t)[r["start_word"] : r["end_word"]] for d, t, *_ in docs if d == r["doc_id"]]
            assert _words(dict(items)[r["item_id"]]) in places


def test_all_seeds_find_all(spark, monkeypatch):
    monkeypatch.setattr(dc, "RARE", 1.0)
    monkeypatch.setattr(dc, "MOST_WORDS", 60)
    monkeypatch.setattr(dc, "PIECE", 300)
    monkeypatch.setattr(dc, "CELLS", 500)
    docs, items = _case(2)
    assert _got(spark, docs, items, threshold=0.6)[1] == _plain(docs, items, 0.6)


def test_alignment_equals_cell_by_cell():
    import numpy as np

    r = np.random.default_rng(3)
    for _ in range(40):
        item, rows = r.integers(1, 6, r.integers(1, 12)).astype(np.uint64), r.integers(1, 6, (3, r.integers(1, 30))).astype(np.uint64)
        assert dc.align(item, rows)[0].tolist() == [_align(item.tolist(), row.tolist()) for row in rows]


@pytest.mark.parametrize("docs,items", [([], _case()[1]), (_case()[0][:5], [])])
def test_empty_tables(spark, docs, items):
    assert _got(spark, docs, items)[1] == []


def test_very_long_text(spark, monkeypatch):
    item = " ".join(_WORDS[i * 7 % len(_WORDS)] for i in range(30))
    long = "lorem ipsum dolor " * 200_000 + item + " sit amet" * 200_000
    found, got = _got(spark, [(1, long, 1, "x"), (2, "lorem " * 1000, 1, "x")], [(5, item)])
    assert got == [(1, 5, 1.0, 1)] and (found[0]["start_word"], found[0]["end_word"]) == (600_000, 600_030)


def test_query_equals_brute_force(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    got = {(r["doc_id"], r["item_id"]) for r in queries.QUERIES["op10_decontaminate"](spark, sf_dir).collect()}
    exact = {(d, i) for d, t in docs for i, b in items if f" {' '.join(_words(b))} " in f" {' '.join(_words(t))} "}
    assert exact and exact <= got
    texts, tests = dict(docs), dict(items)
    assert all(_align(_words(tests[i]), _words(texts[d])) >= len(_words(tests[i])) for d, i in got)


def test_lone_edited_copies_equal_brute_force(spark):
    r = random.Random(5)
    new = iter(range(10**6))
    item = [r.choice(_WORDS) for _ in range(39)]
    text = lambda n: " ".join(r.choice(_WORDS) for _ in range(n))
    spoilt = lambda places: " ".join(f"new{next(new)}" if i in places else w for i, w in enumerate(item))
    copies = [
        spoilt(range(4, 35, 5)),  # of 37 three-word sequences, 21 are gone
        spoilt(range(2, 39, 3)),  # all of them
        " ".join(f"{w} new{next(new)}" for w in item),  # all pairs of neighbours
        " ".join(w for i, w in enumerate(item) if i % 3),
        " ".join(item[19:]),
        " ".join(item[:20]),
    ]
    for copy in copies:  # each the only holder of the item
        docs = [(1, f"{text(50)} {copy} {text(50)}", 1, "x"), (2, text(200), 1, "x")]
        items = [(1, " ".join(item)), (2, text(30))]
        expected = _plain(docs, items)
        assert [x[:2] for x in expected] == [(1, 1)] and _got(spark, docs, items)[1] == expected


@pytest.mark.parametrize("threshold", [0.35, 0.5, 0.8])
def test_production_parameters_equal_brute_force(spark, threshold):
    docs, items = _case(4)
    assert _got(spark, docs, items, threshold=threshold)[1] == _plain(docs, items, threshold)


def test_short_items_leave_ordinary_text_alone(spark):
    docs = [(i, f"the {i} is true of the many words that {i} is true for", 1, "x") for i in range(50)] + [(60, "Is true.", 1, "x"), (61, "THE", 1, "x"), (62, "the the", 1, "x")]
    items = [(1, "the"), (2, "is true"), (None, "IS TRUE"), (3, "of")]
    assert _got(spark, docs, items)[1] == [(60, 2, 1.0, 2), (61, 1, 1.0, 1)]


def test_items_without_an_id_are_taken_out(spark):
    item = " ".join(f"item{i}" for i in range(20))
    docs = [(1, f"before {item} after", 1, "x"), (2, "something else altogether in other words", 1, "x")]
    assert _got(spark, docs, [(None, item)])[1] == [(1, None, 1.0, 1)]
    made = spark.createDataFrame(docs, _SCHEMA)
    assert [r["doc_id"] for r in dc.keep_clean(made, spark.createDataFrame([(None, item)], "item_id long, text string")).collect()] == [2]
