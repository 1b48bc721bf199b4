"""Exact search against all products, with odd rows, ties, repeats and clusters."""

import math
import random

import pytest
from pyspark.sql import functions as F

from corpusaudit.llm import pivot_search


def _plain(rows, k, every):
    usable = {(i, tuple(math.floor(256 * x) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q in sorted({i for i, _ in usable if i % every == 0}):
        pairs = {(-sum(x * y for x, y in zip(a, b)), j) for i, a in usable if i == q for j, b in usable if j != q and len(a) == len(b)}
        out += [(q, n + 1, j, -s) for n, (s, j) in enumerate(sorted(pairs)[:k])]
    return out


def _check(spark, rows, k=5, every=3):
    made = spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id long, embedding array<double>, score int, rank double")
    got = pivot_search.exact_top_k(made, F.col("vec_id") % every == 0, k=k).collect()
    assert sorted(map(tuple, got)) == _plain(rows, k, every)


@pytest.fixture
def small(monkeypatch):
    for name, value in (("PER_ANNULUS", 8), ("BLOCK", 7), ("CHUNK", 5), ("FIRST_LOOK", 6), ("SAMPLE", 60)):
        monkeypatch.setattr(pivot_search, name, value)


def test_equals_all_products(spark, small):
    r = random.Random(5)
    centres = [[r.gauss(0, 2) for _ in range(6)] for _ in range(5)]
    rows = [(i, [c + r.gauss(0, 0.2) for c in r.choice(centres)]) for i in range(150)]
    rows += [(i, [r.gauss(0, 10**r.randint(-2, 2)) for _ in range(6)]) for i in range(150, 200)]
    _check(spark, rows)


def test_ties_repeats_and_odd_rows(spark, small):
    same = [0.5, -0.25, 0.125]
    rows = [(i, same) for i in range(40)] + [(7, same)] * 30 + [(9, [1.0, 1.0, 1.0])] * 12
    rows += [(3, [0.1, 0.2, 0.3]), (3, [0.3, 0.2, 0.1]), (None, same), (60, None), (61, [0.1, None, 0.2])]
    rows += [(63, [math.nan, 0.0, 0.0]), (66, [math.inf, 0.0, 0.0]), (72, [1.0]), (73, [2.0]), (75, []), (76, []), (78, [0.0] * 5)]
    _check(spark, rows)
    _check(spark, rows, k=50, every=20)


def test_large_values_stay_exact(spark):
    _check(spark, [(i, [1e6 + i / 7, -1e6 + i / 3, 3e5 * i]) for i in range(30)])


def test_no_rows(spark):
    _check(spark, [])
    _check(spark, [(1, [0.5])])
