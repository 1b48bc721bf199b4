"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics come from whole texts, in segments cut at white space so that a very
long text needs no more memory than a segment. Trees are grown level by level on
binned statistics of a bounded sample of labelled rows, and stored as full
binary trees in flat arrays (statistic, threshold, leaf value); scoring walks all
trees of a batch of documents at once, one level per numpy step.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusaudit.llm.common import crc_remainder, spread

#: Labelled rows that a model is fitted on, in expectation, however many there are.
SAMPLE = 20_000
TREES, DEPTH, BINS, RATE, LEAST_ROWS, RIDGE = 80, 5, 64, 0.15, 10, 1.0
#: Score from which a document is kept.
THRESHOLD = 0.3
SEGMENT = 1 << 20

_CLASSES = {
    "lower": b"abcdefghijklmnopqrstuvwxyz", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "space": b" \t\r",
    "newline": b"\n", "stop": b".?", "bang": b"!", "comma": b",;:", "bar": b"|", "sign": b"#*$%&@^~+=<>_\\", "quote": b"\"'()[]{}-/",
    "high": bytes(range(128, 256)),
}
STATISTICS = [
    *_CLASSES, "log_bytes", "log_words", "entropy", "word_length", "longest_word", "unique_words", "unique_pairs", "repeated_neighbour",
    "words_per_line", "unique_lines", "packed",
]


def _segments(text: bytes) -> Iterator[bytes]:
    start = 0
    while start < len(text):
        end = start + SEGMENT
        while end < len(text) and text[end] not in b"\t\n\v\f\r ":
            end += 1
        yield text[start:end]
        start = end


def statistics(text: bytes | None) -> list[float]:
    """The values of ``STATISTICS``; zeros for a null or empty text. Repetition is counted within segments."""
    seen, words, unique, pairs, repeated, longest, lines, unique_lines, packed = np.zeros(256, np.int64), 0, 0, 0, 0, 0, 0, 0, 0
    for piece in _segments(text or b""):
        seen += np.bincount(np.frombuffer(piece, np.uint8), minlength=256)
        own = piece.split()
        words += len(own)
        unique += len(set(own))
        pairs += len(set(zip(own, own[1:])))
        repeated += sum(map(eq, own, own[1:]))
        longest = max(longest, max(map(len, own), default=0))
        rows = piece.split(b"\n")
        lines += len(rows)
        unique_lines += len(set(rows))
        packed += len(zlib.compress(piece, 1))
    size = int(seen.sum())
    if not size:
        return [0.0] * len(STATISTICS)
    share = seen / size
    used = share[share > 0]
    n = max(words, 1)
    return [
        *(share[list(c)].sum() for c in _CLASSES.values()), np.log1p(size), np.log1p(words), -(used * np.log2(used)).sum(),
        size / n, np.log1p(longest), unique / n, pairs / n, repeated / n, np.log1p(words / lines), unique_lines / lines, packed / size,
    ]


def _matrix(texts: Iterable[bytes | None]) -> np.ndarray:
    return np.array([statistics(x) for x in texts], np.float64).reshape(-1, len(STATISTICS))


@dataclass
class Trees:
    """Full trees of one depth: node k's children are 2k+1 (up to the threshold) and 2k+2."""

    base: float
    statistic: np.ndarray  # tree, node
    threshold: np.ndarray
    leaf: np.ndarray  # tree, leaf

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        n, trees = len(x), len(self.statistic)
        node, rows, tree = np.zeros((n, trees), np.int64), np.arange(n)[:, None], np.arange(trees)
        inner = self.statistic.shape[1]
        for _ in range(int(np.log2(inner + 1))):
            node = 2 * node + 1 + (x[rows, self.statistic[tree, node]] > self.threshold[tree, node])
        return 1 / (1 + np.exp(-(self.base + self.leaf[tree, node - inner].sum(1))))


def boost(x: np.ndarray, y: np.ndarray) -> Trees:
    """Trees for labels 0 and 1 by Newton steps of the logistic loss. One label only, or none, gives no trees."""
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    statistic, threshold, leaf = np.zeros((TREES, inner), np.int64), np.full((TREES, inner), np.inf), np.zeros((TREES, leaves))
    mean = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(mean / (1 - mean)))
    if not len(y) or y.min() == y.max():
        return Trees(base, statistic[:0], threshold[:0], leaf[:0])
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(cut, c, side="left") for cut, c in zip(cuts, x.T)])  # bin b holds values in (cut[b-1], cut[b]]
    raw = np.full(len(y), base)
    for t in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        gradient, curve = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)  # number within its level
        for level in range(DEPTH):
            width = 2**level
            best = np.zeros(width)
            first = width - 1
            split = np.full(width, BINS)
            for f, own in enumerate(binned):
                at = node * BINS + own
                g, h, c = (
                    np.bincount(at, w, width * BINS).reshape(width, BINS).cumsum(1) for w in (gradient, curve, np.ones(len(y)))
                )
                total_g, total_h, total_c = g[:, -1:], h[:, -1:], c[:, -1:]
                gain = g**2 / (h + RIDGE) + (total_g - g) ** 2 / (total_h - h + RIDGE) - total_g**2 / (total_h + RIDGE)
                gain[(c < LEAST_ROWS) | (total_c - c < LEAST_ROWS)] = 0
                gain[:, len(cuts[f]) :] = 0
                at_best = gain.argmax(1)
                better = gain[np.arange(width), at_best] > best + 1e-9
                best = np.where(better, gain[np.arange(width), at_best], best)
                split = np.where(better, at_best, split)
                statistic[t, first : first + width][better] = f
                threshold[t, first : first + width][better] = cuts[f][at_best[better]] if len(cuts[f]) else np.inf
            node = 2 * node + (binned[statistic[t, first + node], np.arange(len(y))] > split[node])
        leaf[t] = RATE * np.bincount(node, gradient, leaves) / (np.bincount(node, curve, leaves) + RIDGE)
        raw += leaf[t][node]
    return Trees(base, statistic, threshold, leaf)


def held_out(key: str) -> Column:
    """Rows that no model learns from: crc32 of the key as text divisible by 5, or a null key."""
    return F.coalesce(crc_remainder(key, 5) == 0, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> Trees:
    """A model of ``label`` from the texts of labelled documents that aren't held out.

    Above ``SAMPLE`` labelled documents, about as many are taken by a hash of
    their key. Of a key with several texts, one is taken by their hash. A key with several labels has the smallest; null keys and labels
    other than 0 and 1 are left out. Without usable labels every score is 0.5.
    """
    usable = (
        labels.where(F.col(label).isin(0, 1) & ~held_out(key)).groupBy(F.col(key).cast("long").alias("id")).agg(F.min(label).cast("double").alias("y"))
    )
    total = max(usable.count(), 1)
    sample = usable.where(F.pmod(spread(F.col("id")), F.lit(total)) < SAMPLE)

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = _matrix(x.as_py() for x in batch.column("text"))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * len(STATISTICS)), pa.array(values.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("y"), batch.column("print"), lists], names=["id", "y", "print", "x"])

    texts = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("binary").alias("text"), F.xxhash64(text).alias("print")).join(F.broadcast(sample), "id")
    measured = texts.select("id", "y", "text", "print").mapInArrow(measure, "id long, y double, print long, x array<double>")
    one = measured.groupBy("id", "y").agg(F.min(F.struct("print", "x")).alias("first"))  # one text of each key
    rows = one.select("id", "y", F.col("first.x").alias("x")).collect()  # bounded by SAMPLE
    rows.sort(key=lambda r: (r["id"], r["x"]))  # the same model however tasks end
    return boost(np.array([r["x"] for r in rows]).reshape(-1, len(STATISTICS)), np.array([r["y"] for r in rows]))


def score_column(model: Trees, text: str = "text") -> Column:
    """A document's score, 0 to 1, from its text alone."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(_matrix(texts)))

    return score(F.col(text).cast("binary"))


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score and predicted (1 from ``threshold`` on).

    Null and empty texts are scored like others, by statistics of zero; repeated
    rows and null keys (which count as held out) stay; other columns are ignored.
    """
    model = fit(docs, labels, key, text)
    scored = docs.select(F.col(key).alias("doc_id"), held_out(key).alias("held_out"), score_column(model, text).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents that are not rejected, all columns."""
    return docs.where(score_column(fit(docs, labels, key, text), text) >= threshold)
