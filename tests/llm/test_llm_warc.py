"""Archives: exact round trip, revisits, look-ups, damage and odd rows."""

import base64
import glob
import gzip
import hashlib

from corpusaudit.llm import queries, warc
from corpusaudit.session import fresh_folder


def _digest(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _write(spark, rows, **options):
    folder = fresh_folder(spark, "test-warc")
    made = spark.createDataFrame(rows, "page_id long, url string, html string, id int, payload int, sha string")
    warc.write_archive(made, folder, **options)
    return folder


def _expected(rows, min_bytes=0):
    out = []
    for page, url, html, *_ in rows:
        data = (html or "").encode()
        same = [r[0] for r in rows if (r[2] or "") == (html or "") and r[0] is not None]
        first = min(same, default=None)
        again = first is not None and page != first and len(data) >= min_bytes
        out.append((None if page is None else str(page), url, len(data), _digest(data), "revisit" if again else "response", str(first) if again else None))
    return sorted(out, key=str)


def _rows():
    long = "é\r\n\r\nx" * 300_000
    rows = [(i, f"http://h{i % 5}.org/p?q={i}#f", f"text {i % 7}" * 3) for i in range(60)]
    rows += [(100, None, None), (101, "", ""), (102, "no host", long), (103, "http://é.org/\r\n a", long), (None, "http://n.org/", "text 0" * 3)]
    rows += [(105, "http://h1.org/same", "once"), (105, "http://h1.org/same", "once"), (None, None, "lonely"), (106, "http://h1.org/same", "x")]
    return [(*r, 1, None, "z") for r in rows]


def test_round_trip(spark):
    for least in (0, 20):
        folder = _write(spark, _rows(), min_bytes=least)
        got = warc.read_archive(spark, folder).collect()
        assert [r["error"] for r in got] == [None] * len(got)
        fields = ("id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to")
        assert sorted((tuple(r[c] for c in fields) for r in got), key=str) == _expected(_rows(), least)
        texts = {r[0]: (r[2] or "").encode() for r in _rows()}
        assert all(texts[int(r["id"])] == bytes(r["payload"]) for r in got if r["id"] and r["record_type"] == "response")


def test_archives_are_plain_gzip_members(spark):
    folder = _write(spark, _rows())
    text = b"".join(gzip.decompress(open(f, "rb").read()) for f in glob.glob(f"{folder}/archive/*.warc.gz"))
    assert text.count(b"WARC/1.1\r\nWARC-Type: ") == len(_rows())


def test_look_up(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 3)
    folder = _write(spark, _rows())
    asked = ["http://h1.org/same", "http://h3.org/p?q=8", "http://h3.org/none", "https://zz.org/", None, "http://h3.org/p?q=8"]
    got = warc.look_up(spark.createDataFrame([(x,) for x in asked], "url string"), folder).collect()
    found = sorted((r["asked"] or "", r["id"] or "") for r in got)
    assert found == [("", ""), ("", "100"), ("http://h1.org/same", "105"), ("http://h1.org/same", "105"), ("http://h1.org/same", "106"), ("http://h3.org/p?q=8", "8")]
    assert all(r["error"] is None for r in got)


def test_damage_stays_with_its_record(spark):
    folder = _write(spark, _rows())
    capture = spark.read.parquet(f"{folder}/captures").where("id = '102'").first()
    path = f"{folder}/{capture['file']}"
    data = bytearray(open(path, "rb").read())
    data[capture["offset"] + capture["length"] // 2] ^= 255
    open(path, "wb").write(data)
    got = warc.read_archive(spark, folder).collect()
    assert [r["id"] for r in got if r["error"]] == ["102"] and len(got) == len(_rows())


def test_no_pages(spark):
    assert warc.read_archive(spark, _write(spark, [])).count() == 0


def test_query_equals_brute_force(spark, sf_dir):
    pages = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html").collect()]
    got = queries.QUERIES["op5_warc"](spark, sf_dir).collect()
    expected = sorted((int(x[0]), x[2], x[3], x[4], x[5] and int(x[5])) for x in _expected(pages))
    assert sorted((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == expected
