"""Scans of folders and archives, decoding, outputs and the index."""

import os
import zipfile

import pytest
from pyspark.sql import functions as F

from corpusaudit.operators import knn, search
from corpusaudit.sources import archives, outputs, tables, tree, uploads


@pytest.fixture
def code_tree(tmp_path):
    files = {
        "pkg/__init__.py": b"", "pkg/_util.py": b"x = 1\r\ny = 2\r", "pkg/UP.PY": b"a", ".git/h.py": b"a",
        "node_modules/a.js": b"a", "pkg/build/x.py": b"a", "pkg/latin.py": "é = 1".encode("latin-1"),
        "big.py": b"#" * (2 << 20), ".gitignore": b"a", "a.tar.gz": b"a", "deep/a/b/c/d.go": b"package d",
        "pkg/.hidden.py": b"h", "pkg/data.R": b"r", "pkg/script.sh": b"s", "env/e.py": b"e",
    }
    for name, data in files.items():
        path = tmp_path / "repo" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    os.symlink(tmp_path / "repo", tmp_path / "repo" / "pkg" / "loop")
    return str(tmp_path / "repo")


DISCOVERED = {"pkg/__init__.py", "pkg/_util.py", "pkg/latin.py", "big.py", "deep/a/b/c/d.go", "pkg/.hidden.py"}


def test_scan_discovery(spark, code_tree):
    scanned = tree.scan_code_files(spark, {"r": code_tree})
    assert {r["file_path"] for r in scanned.collect()} == DISCOVERED
    decoded = tree.read_text(scanned)
    good = {r["file_path"]: (r["encoding"], r["content"]) for r in tree.readable(decoded).collect()}
    assert good["pkg/_util.py"] == ("utf-8", "x = 1\ny = 2\n")
    assert good["pkg/latin.py"] == ("latin-1", "é = 1")
    assert "pkg/__init__.py" not in good
    assert len(good["big.py"][1]) == 2 << 20 and tree.unreadable(decoded).isEmpty()
    limited = tree.read_text(tree.scan_code_files(spark, {"r": code_tree}, max_size=1 << 20))
    assert [r["file_path"] for r in tree.unreadable(limited).collect()] == ["big.py"]


def test_what_cannot_be_read_stops_nothing(spark, code_tree, monkeypatch):
    os.symlink("/no/such/file", os.path.join(code_tree, "pkg", "dangling.py"))
    roots = {"r": code_tree, "absent": code_tree + "/nothing", "file": code_tree + "/big.py", "odd": "nofs://x/y"}
    decoded = tree.read_text(tree.scan_code_files(spark, roots))
    bad = {(r["repo"], r["file_path"], r["error"].split(":")[0]) for r in tree.unreadable(decoded).collect()}
    assert {("absent", "", "unreadable"), ("file", "", "unreadable"), ("odd", "", "unreadable")} <= bad
    good = {r["file_path"] for r in tree.readable(decoded).filter("repo = 'r'").collect()}
    assert good == DISCOVERED - {"pkg/__init__.py"}


def test_scan_index(spark, code_tree):
    scanned = tree.scan_code_files(spark, {"r": code_tree}, profile="index")
    expected = (DISCOVERED - {"pkg/.hidden.py"}) | {"pkg/data.R", "pkg/script.sh", "env/e.py"}
    assert {r["file_path"] for r in scanned.collect()} == expected
    texts = {r["file_path"]: r["content"] for r in tree.read_text(scanned, profile="index").collect()}
    assert texts["pkg/latin.py"] == " = 1"
    assert len(texts["big.py"]) == 2 << 20


def test_scan_agrees_with_the_table_filter(spark, code_tree):
    names = [os.path.relpath(os.path.join(folder, f), code_tree) for folder, _, fs in os.walk(code_tree) for f in fs]
    listing = spark.createDataFrame([("r", n) for n in names], "repo string, file_path string")
    for profile in ("discovery", "index"):
        kept = {r["file_path"] for r in tree.select_code_files(listing, profile).collect()}
        walked = {r["file_path"] for r in tree.scan_code_files(spark, {"r": code_tree}, profile).collect()}
        assert kept == walked


def test_zip_repos(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "one.zip", "w") as z:
        z.writestr("a/x.py", "1")
        z.writestr("../evil.py", "2")
        z.writestr("empty/", "")
    (tmp_path / "bad.zip").write_bytes(b"not a zip")
    found = spark.createDataFrame([(str(p),) for p in sorted(tmp_path.glob("*.zip"))], "archive string")
    got = {(r["repo"], r["file_path"], bytes(r["content"] or b""), (r["error"] or "").split(":")[0])
           for r in archives.read_zip_repos(found, 4).collect()}
    assert got == {("one", "a/x.py", b"1", ""), ("one", None, b"", "unsafe member path"), ("bad", None, b"", "not a valid archive")}
    packed = spark.read.format("binaryFile").load(str(tmp_path) + "/*.zip").select(F.col("path").alias("archive"), "content")
    assert {(r["repo"], r["file_path"]) for r in archives.expand_archives(packed).collect()} == {g[:2] for g in got}


def test_damaged_and_encrypted_members(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "r.zip", "w") as z:
        for i in range(4):
            z.writestr(f"f{i}.py", f"text {i}")
    data = bytearray((tmp_path / "r.zip").read_bytes())
    data[data.index(b"text 1")] ^= 255
    at = data.index(b"PK\x01\x02", data.index(b"f2.py", data.index(b"PK\x01\x02")) - 60)
    data[at + 8] |= 1  # the third member says that it is encrypted
    (tmp_path / "r.zip").write_bytes(bytes(data))
    listed = spark.createDataFrame([(str(tmp_path / "r.zip"),)], "archive string")
    packed = spark.createDataFrame([("r.zip", bytes(data))], "archive string, content binary")
    for got in (archives.read_zip_repos(listed), archives.expand_archives(packed)):
        rows = {r["file_path"]: (r["content"], (r["error"] or "").split(":")[0]) for r in got.collect()}
        assert rows["f0.py"] == (b"text 0", "") and rows["f3.py"] == (b"text 3", "")
        assert rows["f1.py"] == rows["f2.py"] == (None, "unreadable member")


def test_upload_checks_in_order(spark):
    rows = [("a.md", b"x" * 20), ("a.py", b"x" * 20), ("b.py", b"\xff"), ("C.PY", b"ok")]
    df = spark.createDataFrame(rows, "file_path string, content binary")
    checked = {r["file_path"]: (r["reason"], r["language"]) for r in uploads.validate_uploads(df, max_bytes=10).collect()}
    assert checked == {"a.md": ("unsupported type", None), "a.py": ("too large", None),
                       "b.py": ("encoding error", None), "C.PY": (None, "python")}


def test_outputs_keep_full_paths(spark, tmp_path, rows):
    done = spark.createDataFrame([("a/b.py", "o", "m", "t"), ("c/b.py", "o", "m", None)],
                                 "file_path string, original_code string, modernized_code string, test_code string")
    outputs.write_outputs(done, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert rows(back, "kind", "path") == [("modernized", "a/b.py"), ("modernized", "c/b.py"), ("original", "a/b.py"),
                                          ("original", "c/b.py"), ("tests", "test_b.py")]


def test_index_is_stored_by_list(spark, tmp_path, sf_dir):
    from corpusaudit import adapters

    chunks = adapters.view(spark, sf_dir, "chunks")
    path = str(tmp_path / "index")
    lists = tables.write_index(chunks, path)
    index, again = tables.read_index(spark, path)
    assert again.probes == lists.probes and all((again.centres[k] == c).all() for k, c in lists.centres.items())
    queries = search.centroids(chunks, "label")
    everything = knn.Lists(again.centres, {k: len(c) for k, c in again.centres.items()})
    columns = ["query_id", "rank", "chunk_id", "score"]
    near = search.similar_ann(queries, index, 5, everything).select(columns)
    assert near.exceptAll(search.similar(queries, chunks, 5).select(columns)).isEmpty()
    plan = search.similar_ann(queries.limit(1), index, 5, again)._jdf.queryExecution().toString()
    assert "PartitionFilters: [bucket" in plan
