"""Fingerprints and components against plain loops, with odd rows, copies and dense groups."""

import random
import re

import pytest
import xxhash

from corpusaudit.llm import queries, simhash
from corpusaudit.operators import components


def _print(text, size=3):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] if len(words) >= size else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _groups(nodes, linked):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {x: find(x) for x in nodes}


def _plain(rows, limit=3):
    prints = [_print(t) for _, t in rows]
    distinct = sorted(set(prints))
    near = [(a, b) for n, a in enumerate(distinct) for b in distinct[:n] if (a ^ b).bit_count() <= limit]
    group = _groups(distinct, near)
    least = {}
    for (i, _), p in zip(rows, prints):
        ids = [x for x in (i, least.get(group[p])) if x is not None]
        least[group[p]] = min(ids, default=None)
    return sorted(((i, f"{p:016x}", least[group[p]]) for (i, _), p in zip(rows, prints)), key=str)


def _check(spark, rows):
    made = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, fingerprint string, fp int")
    got = simhash.near_duplicates(made).collect()
    assert sorted(map(tuple, got), key=str) == _plain(rows)
    return made, got


def _texts(n, seed=1):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(n):
        base = rows[r.randrange(len(rows))][1].split() if rows and r.random() < 0.6 else [r.choice(words) for _ in range(r.randint(0, 300))]
        for _ in range(r.randint(0, 2)):
            if base:
                base[r.randrange(len(base))] = r.choice(words)
        rows.append((i * 3 % n, " ".join(base)))
    return rows


def test_components_equal_plain_loop(spark):
    made = _texts(160) + [(500, None), (501, ""), (502, " \n\t"), (503, "One"), (504, "one"), (505, "ÀB c"), (None, "one"), (None, "alone here now"), (None, "alone here now")]
    made += [(7, made[0][1])] * 40 + [(600, "a b c\x0bd\x0ce")]
    docs, got = _check(spark, made)
    kept = simhash.one_per_group(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted({r["component_id"] for r in got} - {None}) == sorted({i for i in ids if i is not None})
    # Of the rows without an id, one group has no other: its rows are one.
    assert ids.count(None) == 1 and kept.where("doc_id IS NULL").first()["text"] == "alone here now"


def test_full_buckets_are_sliced_and_cut_finer(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SLICE", 5)
    monkeypatch.setattr(simhash, "PAIRS", 50)
    _check(spark, _texts(120, 2))
    monkeypatch.setattr(simhash, "FULL_BUCKET", 1e-3)
    _check(spark, _texts(120, 3))


def test_cuts_lose_no_pair():
    r = random.Random(4)
    for total in (10, 10**8, 10**13):
        masks = simhash._masks(total, 3)
        for _ in range(300):
            flips = sum(1 << b for b in r.sample(range(64), 3))
            assert any(not flips & m for m in masks)


def test_dense_group(spark, rows):
    centre = 0x0F0F1234ABCD5678
    r = random.Random(6)
    nodes = sorted({centre ^ sum(1 << b for b in r.sample(range(20, 34), r.randint(0, 5))) for _ in range(900)})
    made = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in nodes], "fp long")
    expected = _groups(nodes, [(a, b) for n, a in enumerate(nodes) for b in nodes[:n] if (a ^ b).bit_count() <= 3])
    found = {r["node"]: r["root"] for r in components.components(simhash.links(made)).collect()}
    assert {x: found.get(x, x) for x in nodes} == expected


def test_long_text_is_cut_at_white_space_only():
    text = ("word " * 30 + "Ünï\n") * 40_000
    assert len(text) > 5 * simhash.SEGMENT
    assert simhash.fingerprint(text.encode()) == _print(text[: len(text)])
    assert simhash.fingerprint(b"x" * (3 * simhash.SEGMENT)) == xxhash.xxh64_intdigest(b"x" * (3 * simhash.SEGMENT), 42)


@pytest.mark.parametrize("size", [1, 2, 5])
def test_other_shingle_lengths(size):
    for _, text in _texts(20, 8):
        assert simhash.fingerprint(text.encode(), size) == _print(text, size)


def test_no_documents(spark):
    _check(spark, [])


def test_chain_of_links(spark):
    chain = [(i, i + 1) for i in range(200)] + [(300, 305), (305, 300), (400, 400)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 201)} | {305: 300}


def test_query_equals_plain_loop(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, queries.QUERIES["op3_simhash"](spark, sf_dir).collect()), key=str) == _plain(docs)


def test_one_row_stays_of_ids_with_several_texts(spark):
    words = [f"word{i}" for i in range(400)]
    one, near, other = " ".join(words), " ".join(words).upper(), " ".join(reversed(words))
    rows = [(5, one), (5, near), (7, one), (5, one), (3, other), (5, other), (9, "alone"), (9, "apart from it")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    roots = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    assert len({f for _, f in roots}) == 4
    kept = sorted(tuple(r) for r in simhash.one_per_group(docs).collect())
    assert len(kept) == 4 and kept[0] == (3, other) and kept[1] in ((5, one), (5, near)) and kept[2:] == [(9, "alone"), (9, "apart from it")]
