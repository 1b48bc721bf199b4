"""WARC archives with a two-level capture index.

Tasks write one archive each, every record a gzip member of its own, and report
(key, file, offset, length). The captures are sorted by a key that starts with
the reversed host; each range becomes an index file of compressed blocks of
lines, and each index file has a sparse directory beside it with the first key
of every block. A look-up finds the index file among their first keys, searches
its directory, reads one block by range, searches its lines, and reads the
records by range. Reading everything back goes through the index too, but takes
the captures in the order of the archives, so that neighbours are one read.

Files lie below a folder that all executors share. A task that runs again writes
new files under new names; only those of the attempt that Spark kept are ever
named in the index.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections import OrderedDict
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusaudit.llm.common import partitions
from corpusaudit.llm.urls import host_of
from corpusaudit.sources.storage import open_fs

#: Fixed values of the format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"

BLOCK_LINES = 1000
#: Bytes that one read of neighbouring records may span.
READ_SPAN = 8 << 20
CAPTURES = "urlkey string, id string, url string, type string, digest string, file string, offset long, length long"
RECORDS = "id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, payload binary, error string"
_DIRECTORY = "file string, first string, last string, blocks int"


def url_key(url: Column) -> Column:
    """Host labels from the right by commas, ``)``, then path and query; empty for null."""
    text = F.coalesce(url, F.lit(""))
    rest = F.regexp_extract(text, r"^[^:/?#]*://[^/?#]*([^#]*)", 1)
    host = F.array_join(F.reverse(F.split(host_of(url), r"\.", -1)), ",")
    return F.when(url.isNull(), "").otherwise(F.concat(host, F.lit(")"), rest))


def write_archive(
    pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0
) -> None:
    """Write a record per row below ``folder`` and the index of all captures.

    The payload is the text in UTF-8, or the bytes of a binary column; null is
    empty. Of rows with equal payloads of at least ``min_bytes`` bytes, the one
    with the smallest key is the response and the others revisit it; rows with a
    null key come last, and rows that repeat that smallest key with the same
    payload are responses too. Smaller payloads are always responses. Null URLs
    leave out the record's target. Other columns are ignored. Without rows the
    index is empty.
    """
    spark = pages.sparkSession
    data = F.col(payload)
    data = F.coalesce(data if dict(pages.dtypes)[payload] == "binary" else F.encode(data, "UTF-8"), F.lit(b""))
    page = pages.select(
        F.col(key).alias("id"), F.col(url).alias("url"), url_key(F.col(url)).alias("urlkey"), data.alias("payload")
    ).withColumn("sha", F.sha1("payload"))
    # One row per payload that occurs again: counted before any shuffle, so copies of one page don't meet in a task.
    first = (
        page.where(F.length("payload") >= min_bytes).groupBy("sha")
        .agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").select("sha", "first")
    )
    marked = page.join(first, "sha", "left").select(
        F.col("id").cast("string").alias("id"), "url", "urlkey", "payload", "sha",
        F.when(F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first")), F.col("first").cast("string")).alias("first"),
    )
    captures = marked.mapInArrow(lambda batches: _write_records(batches, folder), CAPTURES)
    captures.write.parquet(f"{folder}/captures")
    _write_index(spark.read.schema(CAPTURES).parquet(f"{folder}/captures"), folder)


def _base32(sha: str) -> str:
    return base64.b32encode(bytes.fromhex(sha)).decode()


def _record_id(page: str | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page}|{digest}')}>"


def _escaped(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record_bytes(page: str | None, url: str | None, payload: bytes, digest: str, first: str | None) -> bytes:
    """One record: a response with its payload, or a revisit of ``first`` without."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if first is None else http
    head = [
        VERSION, f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: {_record_id(page, digest)}",
        f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {_escaped(url)}")
    if page is not None:
        head.append(f"Page-ID: {_escaped(page)}")
    if first is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_record_id(first, digest)}", f"Refers-To-Page-ID: {_escaped(first)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _fs(folder: str) -> tuple[pafs.FileSystem, str]:
    return open_fs(re.sub(r"^s3[an]://", "s3://", folder))


def _new_file(folder: str, kind: str, suffix: str):
    fs, root = _fs(folder)
    fs.create_dir(f"{root}/{kind}", recursive=True)
    name = f"{kind}/part-{uuid.uuid4().hex}{suffix}"
    return name, fs.open_output_stream(f"{root}/{name}", compression=None)


def _write_records(batches: Iterable[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    name, out, offset = None, None, 0
    for batch in batches:
        rows = []
        for x in batch.to_pylist():
            if out is None:
                name, out = _new_file(folder, "archive", ".warc.gz")
            digest = _base32(x["sha"])
            data = _member(record_bytes(x["id"], x["url"], x["payload"], digest, x["first"]))
            out.write(data)
            kind = "response" if x["first"] is None else "revisit"
            rows.append((x["urlkey"], x["id"], x["url"], kind, digest, name, offset, len(data)))
            offset += len(data)
        yield _rows(rows, CAPTURES)
    if out is not None:
        out.close()


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [f.strip().split(" ") for f in schema.split(",")]
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], names=[n for n, _ in fields])


def _write_index(captures: DataFrame, folder: str) -> None:
    n = partitions(captures.sparkSession)
    order = ("urlkey", "file", "offset")  # one key may hold a third of all captures: places split it
    ranged = captures.repartitionByRange(n, *order).sortWithinPartitions(*order)
    ranged.mapInArrow(lambda batches: _write_blocks(batches, folder), _DIRECTORY).write.parquet(f"{folder}/directory")


def _write_blocks(batches: Iterable[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    name, out, offset, lines, sparse, last = None, None, 0, [], [], ""

    def close_block() -> None:
        nonlocal offset, lines
        data = _member("".join(lines).encode())
        out.write(data)
        sparse[-1] += (offset, len(data))
        offset += len(data)
        lines = []

    for batch in batches:
        for x in batch.to_pylist():
            if out is None:
                name, out = _new_file(folder, "index", ".cdx.gz")
            if not lines:
                sparse.append((x["urlkey"],))
            last = x["urlkey"]
            lines.append(json.dumps([x[c] for c in ("urlkey", "id", "url", "type", "digest", "file", "offset", "length")]) + "\n")
            if len(lines) == BLOCK_LINES:
                close_block()
    if out is None:
        return
    if lines:
        close_block()
    out.close()
    fs, root = _fs(folder)
    with fs.open_output_stream(f"{root}/{name}.directory", compression=None) as beside:
        beside.write(_member("".join(json.dumps(x) + "\n" for x in sparse).encode()))
    yield _rows([(name, sparse[0][0], last, len(sparse))], _DIRECTORY)


def _whole(fs: pafs.FileSystem, path: str) -> bytes:
    with fs.open_input_stream(path, compression=None) as f:
        return f.read()


def _directory(fs: pafs.FileSystem, path: str) -> list[list]:
    return [json.loads(x) for x in zlib.decompress(_whole(fs, path + ".directory"), 31).splitlines()]


def _block(source, offset: int, length: int) -> list[list]:
    return [json.loads(x) for x in zlib.decompress(source.read_at(length, offset), 31).splitlines()]


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of the archive, found through the index.

    The digest of a response is computed from the payload that was read, that of
    a revisit is the record's; ``payload_bytes`` is the length of the full
    payload for both, and ``payload`` is null for a revisit. A record that can't
    be read, or doesn't match its digest, has an ``error`` and loses no other.
    """
    n = partitions(spark)
    files = spark.read.schema(_DIRECTORY).parquet(f"{folder}/directory").select("file").repartition(n)
    captures = files.mapInArrow(lambda batches: _listed(batches, folder), CAPTURES)
    # Neighbours in an archive come together, but no archive as a whole has to fit a task.
    near = captures.repartition(n, "file", F.floor(F.col("offset") / (8 * READ_SPAN))).sortWithinPartitions("file", "offset")
    return near.mapInArrow(lambda batches: _read_records(batches, folder), RECORDS)


def _listed(batches: Iterable[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    fs, root = _fs(folder)
    for batch in batches:
        for name in batch.column("file").to_pylist():
            with fs.open_input_file(f"{root}/{name}") as source:
                for _, offset, length in _directory(fs, f"{root}/{name}"):
                    yield _rows([tuple(x) for x in _block(source, offset, length)], CAPTURES)


def _spans(rows: list[dict]) -> Iterator[list[dict]]:
    """Runs of neighbours in one file, each at most ``READ_SPAN`` long unless it is one record."""
    run: list[dict] = []
    for x in rows:
        if run and (x["file"] != run[0]["file"] or x["offset"] + x["length"] - run[0]["offset"] > READ_SPAN):
            yield run
            run = []
        run.append(x)
    if run:
        yield run


def _read_records(batches: Iterable[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    fs, root = _fs(folder)
    for batch in batches:
        for run in _spans(batch.to_pylist()):
            start = run[0]["offset"]
            rows = []
            try:
                with fs.open_input_file(f"{root}/{run[0]['file']}") as source:
                    data = source.read_at(run[-1]["offset"] + run[-1]["length"] - start, start)
            except OSError as problem:
                data, failed = b"", str(problem)
            else:
                failed = None
            for x in run:
                piece = data[x["offset"] - start : x["offset"] - start + x["length"]]
                rows.append((x["id"], x["url"], *parse_record(piece, failed)))
            yield _rows(rows, RECORDS)


def parse_record(member: bytes, failed: str | None = None) -> tuple:
    """Bytes, digest, type, revisited page, payload and error of one compressed record."""
    if failed:
        return None, None, None, None, None, failed
    try:
        data = zlib.decompress(member, 31)
        head, _, block = data.partition(b"\r\n\r\n")
        version, *lines = head.decode().split("\r\n")
        fields = dict(x.split(": ", 1) for x in lines)
        if version != VERSION or block[int(fields["Content-Length"]) :] != b"\r\n\r\n":
            raise ValueError("not a whole record")
        http, _, payload = block[:-4].partition(b"\r\n\r\n")
        size = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
        stated = fields["WARC-Payload-Digest"].removeprefix("sha1:")
        if fields["WARC-Type"] == "revisit":
            return size, stated, "revisit", fields["Refers-To-Page-ID"], None, None
        found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        problem = None if found == stated and len(payload) == size else "the payload doesn't match its digest"
        return len(payload), found, fields["WARC-Type"], None, payload, problem
    except (zlib.error, ValueError, KeyError, TypeError) as problem:
        return None, None, None, None, None, f"{type(problem).__name__}: {problem}"


def look_up(urls: DataFrame, folder: str, url: str = "url") -> DataFrame:
    """All records whose key equals that of a URL of the table, with the ``asked`` URL.

    Repeated URLs are asked once; null URLs ask for captures without a URL.
    """
    spark = urls.sparkSession
    # One row per index file, which are as many as the tasks that wrote the index.
    tops = sorted((r["first"], r["last"], r["file"]) for r in spark.read.schema(_DIRECTORY).parquet(f"{folder}/directory").collect())
    asked = urls.select(F.col(url).alias("asked"), url_key(F.col(url)).alias("urlkey")).distinct()
    ranged = asked.repartitionByRange(partitions(spark), "urlkey").sortWithinPartitions("urlkey")
    return ranged.mapInArrow(lambda batches: _find(batches, folder, tops), "asked string, " + RECORDS)


def _find(batches: Iterable[pa.RecordBatch], folder: str, tops: list[tuple[str, str, str]]) -> Iterator[pa.RecordBatch]:
    fs, root = _fs(folder)
    lasts = [x[1] for x in tops]
    directories: OrderedDict[str, list[list]] = OrderedDict()
    for batch in batches:
        for asked, key in zip(batch.column("asked").to_pylist(), batch.column("urlkey").to_pylist()):
            for first, _, name in tops[bisect_left(lasts, key) :]:
                if first > key:
                    break
                if name not in directories:
                    directories[name] = _directory(fs, f"{root}/{name}")
                    if len(directories) > 4:
                        directories.popitem(last=False)
                blocks = directories[name]
                with fs.open_input_file(f"{root}/{name}") as source:
                    firsts = [b[0] for b in blocks]
                    at = max(0, bisect_left(firsts, key) - 1)
                    for _, offset, length in blocks[at : bisect_right(firsts, key)]:
                        lines = _block(source, offset, length)
                        keys = [x[0] for x in lines]
                        for x in lines[bisect_left(keys, key) : bisect_right(keys, key)]:
                            with fs.open_input_file(f"{root}/{x[5]}") as archive:
                                piece = archive.read_at(x[7], x[6])
                            yield _rows([(asked, x[1], x[2], *parse_record(piece))], "asked string, " + RECORDS)
