"""Spelling variants against a plain version that tries every edit, and odd rows."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from corpusaudit.llm import queries, spelling


def _plain(docs):
    n = Counter()
    for key, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'null' if key is None else key}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}
    letters = sorted({c for w in n for c in w})
    near = {w: set() for w in n}
    for w in n:
        for i in range(len(w) + 1):
            made = [w[:i] + w[i + 1 :]] + [w[:i] + c + w[i + 1 :] for c in letters] + [w[:i] + c + w[i:] for c in letters]
            near[w].update(x for x in made if x in n and x != w)
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    rows = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        rows.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return rows


def _sorted(rows):
    return sorted(map(tuple, rows), key=str)


def test_query_equals_plain_version(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    found = queries.op12_spelling(spark, sf_dir)
    assert found.dtypes == [("word", "string"), ("form", "string"), ("root", "string"), ("n", "bigint"), ("n_near", "bigint"), ("form_n", "bigint")]
    expected = _plain(docs)
    assert _sorted(found.collect()) == _sorted(expected)
    assert sum(r[4] > 0 for r in expected) > 100 and any(r[1] for r in expected)


def _made(seed, n):
    """Random words of few letters, with their neighbours, in documents of very unlike frequency."""
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("abcé×ÿ"), rng.integers(6, 11))) for _ in range(n)]
    return [(i, " ".join([words[i], words[i]] * (12 if i % 9 == 0 else 200 if i % 50 == 0 else 1))) for i in range(n)]


ODD = [
    (None, "wonderful wonderful wonderfull wonderfull"), (None, None), (7, ""), (8, "WONDERFUL " * 40), (9, "wonderful-wonderful wonderfu l"), (10, "Größere größere GRÖSSERE größerE"),
    (11, "x" * 70 + " " + "x" * 71 + " " + "x" * 70 + " " + "x" * 71 + " " + "y" + "x" * 70 + " " + "y" + "x" * 70), (11, "ab" * 90 + " " + "ab" * 90 + "b"), (11, "ab" * 90 + " " + "ab" * 90 + "b"), (13, "z" * 100_000),
    (12, "wonderful " * 3000 + "wonderxul wonderxul wanderxul wanderxul"),
]


@pytest.mark.parametrize("slice_size, groups", [(1 << 13, 10), (40, 10), (5, 4)])
def test_units_slices_and_odd_rows(spark, monkeypatch, slice_size, groups):
    monkeypatch.setattr(spelling, "SLICE", slice_size)
    rows = _made(3, 600) + ODD
    docs = spark.createDataFrame([(k, t, 1, "x") for k, t in rows], "doc_id long, text string, n int, word string")
    assert _sorted(spelling.variants(docs, groups=groups).collect()) == _sorted(_plain(rows))


def test_empty_table_and_single_word(spark):
    docs = spark.createDataFrame([(1, "lonelyword lonelyword")], "doc_id long, text string")
    assert spelling.variants(docs.limit(0)).count() == 0
    assert [tuple(r) for r in spelling.variants(docs).collect()] in ([("lonelyword", None, "lonelyword", 2, 0, None)], _plain([(1, "lonelyword lonelyword")]))
