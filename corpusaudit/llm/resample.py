"""Importance resampling towards a target distribution of hashed n-grams.

A text becomes lower-case words (ASCII letters and digits, and everything
outside ASCII) with one space between. An overlapped scan then finds a match at
every word: it looks behind for a space and ahead for a word's end, and the match
is the longest run from there, so that its beginnings up to each space are the
shorter runs. The checksum of each run, by the number of buckets, is a feature. Texts
are scanned once; the buckets of every document are written, and all else reads
those: the counts of the corpus and of the target, the gain of a bucket (the log
of its smoothed share in the target over that in the corpus), a document's mean
gain, and its score, which is the gain plus Gumbel noise from a hash of its key.
The highest scores are a sample without replacement by importance weights.

The driver holds one number for each bucket. Ranks come from sorted ranges of
(score, key), so no task holds the whole order.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusaudit.llm.common import stored, unused
from corpusaudit.operators.grouping import row_numbers

SIZE, BUCKETS, SEED = 2, 10_000, 7
#: Words that a document needs to be drawn, and per cent of those documents that are.
LEAST_WORDS, PERCENT = 20, 25
#: Documents whose order one task makes.
ROWS_PER_TASK = 10_000
#: Factor of gains and noise, which are whole numbers.
UNIT = 1000
#: Bytes of buckets and matches that are held at a time.
_HELD, _MATCHES = 1 << 20, 1 << 16
_KEPT = frozenset([*b"0123456789abcdefghijklmnopqrstuvwxyz", *range(128, 256)])
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c in _KEPT else 32 for c in range(256))


def words_of(text: str | None) -> bytes:
    """The text's words in lower case, one space between; nothing for null."""
    return b" ".join((text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split())


def scanner(size: int) -> regex.Pattern:
    """Matches the longest run of up to ``size`` words from a space (which isn't in the match) to a word's end."""
    more = rb"(?: [^ ]++){0,%d}+" % (size - 1) if size > 1 else rb""
    return regex.compile(rb" \K[^ ]++" + more + rb"(?![^ ])")


def features(words: bytes, size: int = SIZE, pattern: regex.Pattern | None = None) -> Iterator[np.ndarray]:
    """Checksums of all runs of 1 to ``size`` words, repeats included, some at a time."""
    matches = (pattern or scanner(size)).finditer(b" " + words, overlapped=True)
    while runs := [match[0] for match in islice(matches, _MATCHES)]:
        while runs:
            yield np.fromiter(map(zlib.crc32, runs), np.uint32, len(runs))
            runs = [head for head in [run.rpartition(b" ")[0] for run in runs] if head]


def bucketed(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, buckets: int = BUCKETS) -> DataFrame:
    """(id, n_words, n_features, buckets): the sorted buckets of each document's features, as packed numbers."""
    kind = docs.schema[key].dataType.simpleString()
    width = np.dtype("<u2" if buckets <= 1 << 16 else "<u4")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = scanner(size)
        for batch in batches:
            at, n_words, n_features, packed, held = 0, [], [], [], 0
            for i, x in enumerate(batch.column("text")):
                words = words_of(x.as_py())
                own = np.concatenate([np.zeros(0, width), *((part % np.uint32(buckets)).astype(width) for part in features(words, size, pattern))])
                own.sort()
                n_words.append(words.count(b" ") + 1 if words else 0)
                n_features.append(len(own))
                packed.append(own.tobytes())
                held += len(packed[-1])
                if held >= _HELD or i == batch.num_rows - 1:
                    ids = batch.column("id").slice(at, len(packed))
                    columns = [ids, pa.array(n_words, pa.int64()), pa.array(n_features, pa.int64()), pa.array(packed, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=["id", "n_words", "n_features", "buckets"])
                    at, n_words, n_features, packed, held = i + 1, [], [], [], 0

    read = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    return read.mapInArrow(run, f"id {kind}, n_words long, n_features long, buckets binary")


def _unpacked(column: pa.Array, buckets: int) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in column), "<u2" if buckets <= 1 << 16 else "<u4")


def bucket_counts(rows: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features fall in each bucket; the driver gets a row for each."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                total += np.bincount(_unpacked(batch.column(0).slice(start, 256), buckets), minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    out = np.zeros(buckets, object)  # sums of any size
    for row in rows.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The gain of every bucket, rounded down to a whole number of ``UNIT`` parts."""
    n, all_s, all_t = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(UNIT * math.log((t + 1.0) * (all_s + n) / ((s + 1.0) * (all_t + n)))) for s, t in zip(corpus, target)], np.int64)


def noise(key: object, seed: int = SEED) -> int:
    """Gumbel noise by hash of the key as text; a null key counts as the word null."""
    h = int(hashlib.sha256(f"{seed}:{'null' if key is None else key}".encode()).hexdigest()[:8], 16)
    return math.floor(-UNIT * math.log(-math.log((h + 0.5) / 4294967296)))


def weighed(rows: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """(id, n_words, n_features, weight, score): the mean gain of each document, and that with its noise."""
    kind, table = rows.schema["id"].dataType.simpleString(), gain.tolist()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = np.array(table, np.int64)
        for batch in batches:
            weight = []
            for x in batch.column("buckets"):
                own = np.frombuffer(x.as_py(), "<u2" if len(gain) <= 1 << 16 else "<u4")
                weight.append(int(gain[own].sum()) // len(own) if len(own) else 0)
            score = [w + noise(x.as_py(), seed) for w, x in zip(weight, batch.column("id"))]
            columns = [batch.column(c) for c in ("id", "n_words", "n_features")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(weight, pa.int64()), pa.array(score, pa.int64())], names=["id", "n_words", "n_features", "weight", "score"])

    return rows.select("id", "n_words", "n_features", "buckets").mapInArrow(run, f"id {kind}, n_words long, n_features long, weight long, score long")


def resample(
    docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", size: int = SIZE,
    buckets: int = BUCKETS, seed: int = SEED, least_words: int = LEAST_WORDS, percent: int = PERCENT, rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """One row per document: doc_id, n_features, weight, score and rank; an undrawn document's rank is null.

    Of the documents with ``least_words`` words or more, ``percent`` per cent
    (rounded down) with the highest scores are drawn; ties go to the smaller key,
    a null one first. A null or empty text has no features and weight 0. Repeated
    rows count each, in the corpus and in the order; equal keys, null too, get
    equal noise. Other columns are ignored. Empty tables are no features: without
    documents the result is empty, without a target all documents' gains come
    from the corpus alone.
    """
    rows = stored(bucketed(docs, key, text, size, buckets), "resample-buckets")
    aim = bucketed(target.select(F.lit(0).alias("id"), F.col(target_text).alias("text")), "id", "text", size, buckets)
    scored = stored(weighed(rows, gains(bucket_counts(rows, buckets), bucket_counts(aim, buckets)), seed), "resample-scores")
    able = scored.where(F.col("n_words") >= least_words).withColumn("after", -F.col("score"))
    drawn = able.count() * percent // 100
    numbered = row_numbers(able, [], ["after", "id"], "rank", rows_per_task).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return numbered.drop("after").unionByName(rest).select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


def drawn(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", **parameters) -> DataFrame:
    """The documents that ``resample`` draws, all columns; a drawn key brings every row that has it."""
    own = unused(docs, "chosen")
    chosen = resample(docs, target, key, text, **parameters).where("rank IS NOT NULL").select(F.col("doc_id").alias(own)).distinct()
    return docs.join(chosen, docs[key].eqNullSafe(F.col(own)), "left_semi")
