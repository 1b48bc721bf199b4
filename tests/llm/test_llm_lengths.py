"""Length histograms against direct counts, limits, quantiles and odd rows."""

from collections import Counter

from corpusaudit.llm import lengths, queries


def _coder():
    return lengths.encoding(open(lengths.VOCABULARY, "rb").read(), lengths.PATTERN)


def _plain(sizes):
    count, n = Counter(sizes), len(sizes)
    out = []
    for x in sorted(count):
        up = [s for s in sizes if s <= x]
        out.append((x, count[x], x * count[x], len(up), sum(up), n - len(up), sum(sizes) - sum(up), sum(min(s, x) for s in sizes), len(up) / n))
    return out


def _rows():
    texts = ["", None, "one", "one two", "  ", "a\n\nb", "naïve Ünïcode 日本語"] + [f"word {i} " * (i % 60) for i in range(300)] + ["x" * 5000, "long text here. " * 400]
    return [(i, t, "abc"[i % 3] if i % 4 else None, 7) for i, t in enumerate(texts)] + [(None, "one", "a", 7), (2, "one", "a", 7)]


def test_equals_direct_counts(spark, monkeypatch):
    monkeypatch.setattr(lengths, "RANGE", 16)
    coder, rows = _coder(), _rows()
    sizes = {i: len(coder.encode_ordinary(r[1] or "")) for i, r in enumerate(rows)}
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, tokens int")
    assert sorted(map(tuple, lengths.histogram(docs).collect())) == _plain(list(sizes.values()))
    by = lengths.histogram(docs, by=("source",)).collect()
    for source in ("a", "b", "c", None):
        assert sorted(tuple(r)[1:] for r in by if r["source"] == source) == _plain([sizes[i] for i, r in enumerate(rows) if r[2] == source])


def test_limits_and_quantiles(spark):
    coder, rows = _coder(), _rows()
    sizes = [len(coder.encode_ordinary(r[1] or "")) for r in rows]
    found = lengths.histogram(spark.createDataFrame(rows, "doc_id long, text string, source string, tokens int"))
    for r in lengths.at_limits(found, [0, 1, 7, 100, 10**9]).collect():
        assert (r["documents_cut"], r["tokens_kept"]) == (sum(s > r["limit"] for s in sizes), sum(min(s, r["limit"]) for s in sizes))
    for r in lengths.at_quantiles(found, [0.0, 0.25, 0.5, 1.0]).collect():
        assert r["length"] == min(x for x in sizes if sum(s <= x for s in sizes) >= r["quantile"] * len(sizes))


def test_cuts_of_long_texts_change_nothing(monkeypatch):
    monkeypatch.setattr(lengths, "SEGMENT", 10)
    coder = _coder()
    for text in ("two  spaces\n\n and it's 12 o'clock!!  " * 30, "x" * 100, " " * 100, "a  b" * 40, "é \tz " * 40):
        pieces = list(lengths.segments(text))
        assert "".join(pieces) == text
        assert [t for p in pieces for t in coder.encode_ordinary(p)] == coder.encode_ordinary(text)


def test_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    found = lengths.histogram(docs)
    assert found.count() == 0 and lengths.at_limits(found, [5]).count() == 0 and lengths.at_quantiles(found, [0.5]).count() == 0


def test_query_equals_direct_counts(spark, sf_dir):
    coder = _coder()
    sizes = [len(coder.encode_ordinary(r["text"] or "")) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    assert sorted(map(tuple, queries.QUERIES["op8_token_lengths"](spark, sf_dir).collect())) == _plain(sizes)
