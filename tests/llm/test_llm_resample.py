"""Importance resampling against a plain version of the whole contract, and odd rows."""

import hashlib
import math
import re
import zlib

import pytest

from corpusaudit.llm import queries, resample


def _features(text, size=2):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text)
    return words, [" ".join(words[i : i + n]) for n in range(1, size + 1) for i in range(len(words) - n + 1)]


def _plain(docs, target, percent=25, least=20, buckets=10_000):
    def counts(texts):
        out = [0] * buckets
        for t in texts:
            for f in _features(t)[1]:
                out[zlib.crc32(f.encode()) % buckets] += 1
        return out

    s, t = counts(x for _, x in docs), counts(target)
    big_s, big_t = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in range(buckets)]
    rows = []
    for key, text in docs:
        words, found = _features(text)
        weight = sum(gain[zlib.crc32(f.encode()) % buckets] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'null' if key is None else key}".encode()).hexdigest()[:8], 16)
        rows.append([key, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0]))
    for i, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = i + 1
    return [tuple(r[:5]) for r in rows]


def _sorted(rows):
    return sorted(map(tuple, rows), key=str)


def test_query_equals_plain_version(spark, sf_dir):
    read = lambda name, *columns: [tuple(r) for r in spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns).collect()]
    expected = _plain(read("documents", "doc_id", "text"), [t for (t,) in read("benchmark", "text")])
    found = queries.op13_resample(spark, sf_dir)
    assert [x[1] for x in found.dtypes] == ["bigint"] * 5 and found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert _sorted(found.collect()) == _sorted(expected)
    assert sum(r[4] is not None for r in expected) > 10


ODD = [
    (1, None), (2, ""), (3, " .,;\n"), (4, "One"), (5, "one two"), (6, "ÄRGER straße 日本 naïve " * 9), (7, "a\x00b\x7fc{d}E " * 30),
    (8, "x" * 200_000), (9, "lorem ipsum " * 40_000), (None, "some words without a key " * 8), (None, None), (10, "same text " * 20), (10, "same text " * 20), (11, "same text " * 20),
]


@pytest.mark.parametrize("rows_per_task", [3, 10_000])
def test_odd_rows(spark, rows_per_task):
    docs = spark.createDataFrame([(k, t, "x", 0) for k, t in ODD], "doc_id long, text string, rank string, id int")
    target = ["one two ärger", None, "", "LOREM ipsum dolor"]
    found = resample.resample(docs, spark.createDataFrame([(t, 1) for t in target], "text string, item_id long"), percent=50, rows_per_task=rows_per_task)
    assert _sorted(found.collect()) == _sorted(_plain(ODD, target, percent=50))


def test_empty_tables(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string")
    none, no_target = docs.limit(0), spark.createDataFrame([], "text string")
    assert resample.resample(none, no_target).count() == 0
    assert _sorted(resample.resample(docs, no_target, percent=50).collect()) == _sorted(_plain(ODD, [], percent=50))


def test_runs_of_other_sizes(monkeypatch):
    import zlib as z

    for size in (1, 2, 3):
        for text in ("", "a", "a b", "a b c d e", "A  b\nc"):
            runs = _features(text, size)[1]
            for held in (2, 1 << 16):
                monkeypatch.setattr(resample, "_MATCHES", held)
                found = [int(x) for part in resample.features(resample.words_of(text), size) for x in part]
                assert sorted(found) == sorted(z.crc32(f.encode()) for f in runs)


def test_many_buckets_and_drawn_rows(spark):
    docs = spark.createDataFrame([(i, f"w{i % 7} w{i % 5} common words here " * 6, i) for i in range(60)], "doc_id long, text string, chosen int")
    target = spark.createDataFrame([("w3 w3 w3",)], "text string")
    kept = resample.drawn(docs, target, buckets=1 << 17)
    ranked = resample.resample(docs, target, buckets=1 << 17).where("rank IS NOT NULL")
    assert kept.columns == docs.columns and kept.count() == 15
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in ranked.collect()}
    assert ranked.groupBy().agg({"rank": "max"}).first()[0] == 15
