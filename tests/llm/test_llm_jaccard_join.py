"""The Jaccard join against all pairs, by every boundary, with hot groups and odd rows."""

import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusaudit.llm import jaccard_join, queries
from corpusaudit.operators.lists import list_components


def _set(text):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def _plain(docs):
    sets = {}
    for key, text in docs:
        sets.setdefault(_set(text), []).append(key)
    distinct = [s for s in sets if s]
    root = {s: s for s in distinct}

    def find(s):
        while root[s] is not s:
            s = root[s]
        return s

    by = {}
    for s in distinct:
        for x in s:
            by.setdefault(x, []).append(s)
    met = {frozenset(p) for own in by.values() if len(own) < 400 for p in combinations(own, 2)}
    for own in by.values():
        assert len(own) < 400
    for a, b in map(tuple, met):
        if 100 * len(a & b) >= 80 * len(a | b):
            root[find(a)] = find(b)
    least = {}
    for s in distinct:
        keys = [k for k in sets[s] if k is not None]
        least[find(s)] = min([*keys, *([least[find(s)]] if least.get(find(s)) is not None else [])], default=None)
    return [(k, len(s), least[find(s)] if s else k) for s, keys in sets.items() for k in keys]


def _sorted(rows):
    return sorted(map(tuple, rows), key=str)


def test_query_equals_all_pairs(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    found = queries.op11_jaccard_join(spark, sf_dir)
    assert found.dtypes == [("doc_id", "bigint"), ("n_shingles", "bigint"), ("component_id", "bigint")]
    expected = _plain(docs)
    assert _sorted(found.collect()) == _sorted(expected)
    assert sum(r[0] != r[2] for r in expected) > 5


def _edited(rng, words, edits):
    own = list(words)
    for _ in range(edits):
        i = rng.randrange(len(own))
        kind = rng.randrange(3)
        if kind == 0:
            own[i] = f"e{rng.randrange(10**6)}"
        elif kind == 1:
            own.insert(i, f"e{rng.randrange(10**6)}")
        elif len(own) > 1:
            del own[i]
    return " ".join(own)


def _made(seed=5):
    """Short and long texts with copies of more and fewer edits, some under one header."""
    rng, rows = random.Random(seed), []
    header = " ".join(f"h{i}" for i in range(12))
    for g in range(60):
        n = rng.choice([3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 16, 20, 30, 60])
        words = [f"w{rng.randrange(5000)}" for _ in range(n)]
        for _ in range(rng.choice([1, 2, 5, 12])):
            text = _edited(rng, words, rng.choice([0, 0, 1, 1, 2]))
            rows.append(text if g % 3 else f"{header} {text}")
    base = [f"b{i}" for i in range(90)]
    rows += [_edited(rng, base, rng.choice([1, 1, 2, 3])) for _ in range(80)]  # one large group of near copies
    return [(i + 1, t) for i, t in enumerate(rows)]


ODD = [
    (None, "a b c d e f g h"), (None, "a b c d e f g h"), (-5, None), (-6, ""), (-7, " \t\n\x0b\x0c\r "), (-8, "One"), (-9, "one"), (-10, "ONE two"), (-11, "x\xa0y z"),
    (-12, "r " * 50_000), (-13, "r r r r r"), (-14, "r r r r"), (-15, "ÄB c d e f"), (-16, "äb c d e f"), (None, "only without a key at all"), (-17, "p q r s t u"), (-17, "p q r s t u"),
    (-17, "another text of the same key here"),
]


@pytest.mark.parametrize("boundary, sent", [(None, 1 << 18), (0, 0), (12, 1 << 18)])
def test_boundaries_hot_groups_and_odd_rows(spark, monkeypatch, boundary, sent):
    monkeypatch.setattr(jaccard_join, "OFTEN", 4)
    monkeypatch.setattr(jaccard_join, "MOST_SENT", sent)
    monkeypatch.setattr(jaccard_join, "SHORT", 24 if boundary is None else 3)
    rows = _made() + ODD
    docs = spark.createDataFrame([(k, t, 1, "x") for k, t in rows], "doc_id long, text string, node int, id string")
    found = jaccard_join.near_groups(docs, boundary=boundary)
    assert _sorted(found.collect()) == _sorted(_plain(rows))


def test_sets_are_those_of_the_words(monkeypatch):
    texts = [None, "", " \t", "a", "A", "a b", "b a", "a b c d e", "A B\nc\x0bD e f", "x " * 700, "é Ünï ß a b", *("w%d " % (i % 9) * 3 + "common tail of some words" for i in range(40))]
    plain = [_set(t) for t in texts]
    for segment in (1 << 18, 64):
        monkeypatch.setattr(jaccard_join, "SEGMENT", segment)
        found = list(jaccard_join.shingle_sets(None if t is None else t.encode() for t in texts))
        assert [len(x) for x in found] == [len(x) for x in plain]
        for i, j in combinations(range(len(texts)), 2):
            assert len(np.intersect1d(found[i], found[j])) == len(plain[i] & plain[j])


def test_sketches_differ_by_no_more_than_the_sets():
    rng = np.random.default_rng(2)
    for _ in range(200):
        pool = rng.integers(0, 1 << 63, 400).astype(np.uint64)
        a, b = (np.unique(rng.choice(pool, rng.integers(0, 400))) for _ in range(2))
        bits = int(np.bitwise_count(jaccard_join.sketch_of(a).view(np.uint64) ^ jaccard_join.sketch_of(b).view(np.uint64)).sum())
        assert bits <= len(np.setxor1d(a, b))


def test_wide_sketches_of_any_two_sizes():
    rng = np.random.default_rng(3)
    for n in (1023, 2047, 2048, 4095, 4100, 9000):
        pool = np.unique(rng.integers(0, 1 << 64, 2 * n, dtype=np.uint64))
        a = np.sort(rng.permutation(pool)[:n])
        wide = jaccard_join.wide_sketch_of(a)
        assert wide is None if n < 2048 else n / 2 < 64 * len(wide) <= n
        for b in (a, a[: n // 2], np.sort(rng.permutation(a)[: n - n // 9]), np.sort(rng.permutation(pool)[:n])):
            other = jaccard_join.wide_sketch_of(b)
            if wide is not None and other is not None:
                assert jaccard_join.bits_apart(wide, other) == jaccard_join.bits_apart(other, wide) <= len(np.setxor1d(a, b))
    assert jaccard_join.bits_apart(jaccard_join.sketch_of(a), np.zeros(0, np.int64)) == 0


def test_unlike_long_sets_are_told_apart_by_sketches(spark):
    """Pairs of very long texts are discarded before any set moves; linked ones and short ones stay."""
    rng = np.random.default_rng(6)
    new = lambda n: rng.integers(0, 1 << 63, n).astype(np.uint64)
    base = new(5000)
    made = [base, np.concatenate([base[:4600], new(420)]), new(5000), np.concatenate([base[:2500], new(2300)]), base[:4050], new(40)]
    made.append(np.concatenate([made[5][:38], new(2)]))
    sets = {i: np.unique(x) for i, x in enumerate(made)}
    wide = {i: jaccard_join.wide_sketch_of(x) for i, x in sets.items()}
    rows = [(i, i, len(x), jaccard_join.sketch_of(x).tolist(), None if wide[i] is None else wide[i].tolist()) for i, x in sets.items()]
    table = spark.createDataFrame(rows, "node long, id long, n long, sketch array<long>, wide array<long>")
    pairs = [p for p in combinations(sets, 2) if 100 * min(len(sets[i]) for i in p) >= 80 * max(len(sets[i]) for i in p)]
    expected = {(a, b) for a, b in pairs if 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b]))}
    pairs = spark.createDataFrame(pairs, "a long, b long")
    found = {(r["a"], r["b"]) for r in jaccard_join.maybe_linked(pairs, table).collect()}
    assert found == expected == {(0, 1), (0, 4), (1, 4), (5, 6)}
    narrow = jaccard_join.maybe_linked(pairs, table.withColumn("wide", F.lit(None).cast("array<long>")))
    assert {(0, 2), (0, 3)} <= {(r["a"], r["b"]) for r in narrow.collect()}


def test_shingles_spread_over_many_chunks_are_frequent(spark, monkeypatch):
    """Two occurrences in each of many chunks are counted together; a shingle of one chunk isn't among them."""
    monkeypatch.setattr(jaccard_join, "CHUNK", 30)
    texts = [f"seen in all of them {' '.join(f'x{i}_{k}' for k in range(14))}" for i in range(40)] + ["only two of these here", "only two of these here"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").select("id", F.col("text").cast("binary").alias("text")).coalesce(1)
    known, times = jaccard_join._frequent(jaccard_join._facts(docs, 5, 16))
    one = next(jaccard_join.shingle_sets([b"seen in all of them"]))
    assert known.tolist() == one.tolist() and times[0] >= 30


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_join.near_groups(docs).count() == 0


def test_overlaps_and_prefixes():
    for a in range(1, 60):
        for b in range(1, 60):
            least = next(o for o in range(1, 200) if 100 * o >= 80 * (a + b - o))
            assert jaccard_join.overlap(a, b) == least
            if least <= min(a, b):  # linked sets meet in their prefixes
                assert a - least < jaccard_join.prefix(a) and b - least < jaccard_join.prefix(b)


def test_boundary_follows_the_cost():
    sets = {n: 100 for n in range(1, 17)}
    rare = {n: 100 * jaccard_join.prefix(n) for n in sets}
    often = {n: 10**6 for n in sets}
    assert jaccard_join.choose_boundary(sets, rare) < jaccard_join.choose_boundary(sets, often) == 16
    assert jaccard_join.choose_boundary({}, {}) == 0


def test_lists_across_batches(monkeypatch):
    """Any cut into batches gives the pairs of short lists and the entries of long and frequent ones; single sets give nothing."""
    monkeypatch.setattr(jaccard_join, "SHORT", 4)
    rng = np.random.default_rng(4)
    rows = sorted((int(x), int(y)) for x, y in zip(rng.integers(0, 60, 300), rng.integers(0, 9, 300)))
    of = {x: sorted({y for a, y in rows if a == x}) for x, _ in rows}
    entries = {(x, y) for x, own in of.items() for y in own if x == 7 or len(own) > 4}
    pairs = {p for x, own in of.items() if x != 7 and len(own) <= 4 for p in combinations(own, 2)}
    for step in (1, 2, 3, 7, 300):
        batches = []
        for i in range(0, len(rows), step):
            part = rows[i : i + step]
            arrays = [pa.array([r[0] for r in part]), pa.array([r[1] for r in part]), pa.array([9] * len(part), pa.int32()), pa.array([0] * len(part), pa.int32()), pa.array([r[0] == 7 for r in part])]
            batches.append(pa.RecordBatch.from_arrays(arrays, names=["list", "node", "n", "place", "often"]))
        found = [r for b in jaccard_join._scanned(batches, 0, 80) for r in b.to_pylist()]
        assert {(r["list"], r["node"]) for r in found if r["other"] is None} == entries
        assert {(r["node"], r["other"]) for r in found if r["other"] is not None} == pairs


def test_unlike_sets_of_a_long_list_leave_no_pairs(spark):
    """Where all pairs of a list meet, those whose sketches are apart don't leave the join."""
    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 63, 60).astype(np.uint64)
    sets = {i: np.concatenate([base[:10] if i else base[:57], rng.integers(0, 1 << 63, 50 if i else 3).astype(np.uint64)]) for i in range(40)} | {40: base}
    members = spark.createDataFrame([(1, i, len(x), 0) for i, x in sets.items()], "list long, node long, n int, place int")
    sketches = spark.createDataFrame([(i, jaccard_join.sketch_of(x).tolist()) for i, x in sets.items()], "node long, sketch array<long>")
    given = []

    def near(pairs):
        given.extend((r["a"], r["b"]) for r in pairs.collect())
        return pairs

    roots = list_components(members, lambda one, other: one("place") == other("place"), near, rounds=0, facts=sketches, alike=lambda one, other: jaccard_join._alike(one, other, 80))
    assert given == [(0, 40)] and [tuple(r) for r in roots.collect()] == [(40, 0)]
