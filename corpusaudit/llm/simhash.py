"""Near-duplicate documents by SimHash, compared through pivot distance tables.

Equal fingerprints are one. Two fingerprints that differ in at most ``limit``
bits are equal in one of any ``limit + 1`` groups of bit positions, so rows meet
by the bits of a group; with more fingerprints than such buckets hold well, the
positions are cut finer and several cuts must agree. Inside a bucket, the
Hamming distances to many fixed reference fingerprints are the pivot table: by
the triangle inequality, each of them differs by at most ``limit`` for a linked
pair. Rows are sorted by the first distance and swept in a window of that width,
the other distances discard pairs one after another, and what survives is
verified by its differing bits.

Pivot distances alone, without buckets, leave a fixed share of all pairs (those
of unrelated 64-bit fingerprints are all near 32), so work would grow with the
square of the documents; the buckets lose no pair.

A bucket above ``SLICE`` fingerprints is cut into slices and every two slices
meet in a task of their own. Links are reduced to stars where they are found, so
a group of n copies gives fewer than n rows, not n squared.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusaudit.llm.common import partitions, stored, unused
from corpusaudit.operators.components import components

SEED = 42
#: Expected fingerprints in a bucket above which positions are cut finer.
FULL_BUCKET = 256
#: Fingerprints of one bucket that one task compares with each other at most.
SLICE = 1024
REFERENCES = 16
#: Pairs and bytes that are held at a time.
PAIRS, SEGMENT = 1 << 20, 1 << 20

#: What meets in one task: a cut of positions, its bits, and two slices of the bucket.
_UNIT = ("cut", "bits", "low", "high")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _words(text: bytes) -> Iterator[list[bytes]]:
    """Lower-case words of a text, in lists; a long text is cut at white space."""
    start = 0
    while start < len(text):
        end = start + SEGMENT
        while end < len(text) and text[end] not in b"\t\n\v\f\r ":
            end += 1
        yield text[start:end].translate(_LOWER).split()
        start = end


def fingerprint(text: bytes | None, size: int = 3) -> int:
    """64-bit SimHash of the shingles of ``size`` words; fewer words are one shingle, none gives zero."""
    bits, n, carry = np.zeros(64, np.int64), 0, []
    for words in _words(text or b""):
        words = carry + words
        shingles = map(b" ".join, zip(*(words[i:] for i in range(size)))) if len(words) >= size else ()
        hashes = np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles], np.uint64)
        bits += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(hashes)
        carry = words[max(0, len(words) - size + 1) :] if size > 1 else []
    if not n:
        return xxhash.xxh64_intdigest(b" ".join(carry), SEED) if carry else 0
    return int(np.packbits(2 * bits > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3) -> DataFrame:
    """(id, fp, print): a row per document; the fingerprint as a signed long, and a hash of the text itself."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x.as_py(), size) for x in batch.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found), batch.column("print")], names=["id", "fp", "print"])

    read = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("binary").alias("text"), F.xxhash64(text).alias("print"))
    return read.mapInArrow(run, "id long, fp long, print long")


def _classes(docs: DataFrame, key: str, text: str, size: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """(id, fp) of every document, and (fp, root, component_id) of every fingerprint."""
    prints = stored(fingerprints(docs, key, text, size), "fingerprints")
    distinct = stored(prints.groupBy("fp").agg(F.min("id").alias("least")), "fingerprints-distinct")
    roots = components(links(distinct, limit))
    grouped = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints, grouped.join(least, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3, limit: int = 3) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits) and component_id.

    Documents are linked if their fingerprints differ in at most ``limit`` bits;
    component_id is the smallest id that links reach, the document's own
    included. A null or empty text has fingerprint zero and is linked like any
    other. Rows with a null id stay, and count for no component_id unless all
    its ids are null; repeated rows stay. Other columns are ignored; an empty
    table gives an empty result.
    """
    prints, classes = _classes(docs, key, text, size, limit)
    return prints.join(classes, "fp").select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_per_group(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3, limit: int = 3) -> DataFrame:
    """One document of each component, the one whose id is the component's; all columns.

    Rows that repeat an id with the same text are one document and stay once. If
    the id has several texts in a component, one of them stays. Of a component
    without any id, one row stays.
    """
    prints, classes = _classes(docs, key, text, size, limit)
    id_of, text_of, print_of, root_of = (unused(docs, c) for c in ("chosen", "chosen_print", "print", "root"))
    # An id may stand for several texts, in one component or more: one text of each component is chosen.
    chosen = prints.join(classes, "fp").where("id = component_id").groupBy("root").agg(F.min("id").alias(id_of), F.min("print").alias(text_of))
    # Joined and reduced by the same columns, so texts move once.
    named = docs.where(docs[key].isNotNull()).withColumn(print_of, F.xxhash64(text))
    named = named.join(chosen, (named[key] == chosen[id_of]) & (named[print_of] == chosen[text_of]), "left_semi")
    named = named.dropDuplicates([key, print_of]).drop(print_of)

    @F.pandas_udf("long")
    def print_column(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(x, size) for x in texts], np.uint64).view(np.int64))

    nameless = docs.where(docs[key].isNull()).withColumn(print_of, print_column(F.col(text).cast("binary")))
    alone = classes.where("component_id IS NULL").select(F.col("fp").alias(print_of), F.col("root").alias(root_of))
    return named.unionByName(nameless.join(alone, print_of).dropDuplicates([root_of]).select(*docs.columns))


def _masks(total: int, limit: int) -> list[int]:
    """Bit masks such that two fingerprints within ``limit`` bits agree under one of them."""
    for pieces in range(limit + 1, limit + 4):
        edges = [64 * i // pieces for i in range(pieces + 1)]
        parts = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
        masks = [sum(chosen) for chosen in combinations(parts, pieces - limit)]
        if total / 2 ** min(m.bit_count() for m in masks) <= FULL_BUCKET:
            break
    return masks


def references(n: int) -> np.ndarray:
    """Reference fingerprints: hashes of their numbers."""
    return np.array([xxhash.xxh64_intdigest(str(i).encode(), SEED) for i in range(n)], np.uint64)


def _signed(x: int) -> Column:
    return F.lit(x - (1 << 64) if x >> 63 else x).cast("long")


def links(distinct: DataFrame, limit: int = 3) -> DataFrame:
    """(a, b): fingerprints in one component, as stars within each bucket; every pair within ``limit`` bits is connected.

    ``distinct`` holds each fingerprint once, as a signed long in ``fp``.
    """
    spark = distinct.sparkSession
    masks = _masks(distinct.count(), limit)
    pivots = references(REFERENCES)
    place = F.explode(F.array(*[F.struct(F.lit(i).alias("cut"), F.col("fp").bitwiseAND(_signed(m)).alias("bits")) for i, m in enumerate(masks)]))
    rows = distinct.select("fp", F.bit_count(F.col("fp").bitwiseXOR(_signed(int(pivots[0])))).alias("near"), place.alias("p")).select("fp", "near", "p.*")
    large = rows.groupBy("cut", "bits").count().where(F.col("count") > SLICE).select("cut", "bits", F.ceil(F.col("count") / SLICE).cast("int").alias("slices"))
    n = F.coalesce("slices", F.lit(1))
    sliced = rows.join(large, ["cut", "bits"], "left").withColumn("slices", n).withColumn("slice", F.pmod(F.xxhash64("fp"), "slices").cast("int"))
    met = sliced.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).select(
        "cut", "bits", F.least("slice", "other").alias("low"), F.greatest("slice", "other").alias("high"), "near", "fp", "slice"
    )
    ordered = met.repartition(partitions(spark), *_UNIT).sortWithinPartitions(*_UNIT, "near")
    return ordered.mapInArrow(lambda batches: _sweep(batches, pivots, limit), "a long, b long")


def _sweep(batches: Iterable[pa.RecordBatch], pivots: np.ndarray, limit: int) -> Iterator[pa.RecordBatch]:
    """Rows by bucket and first pivot distance; the rows that may still meet later ones are kept between batches."""
    kept: dict[str, np.ndarray] = {}
    names = (*_UNIT, "near", "fp", "slice")
    for batch in batches:
        rows = {c: np.asarray(batch.column(c)).astype(np.int64) for c in names}
        held = len(kept["fp"]) if kept else 0
        if held:
            rows = {c: np.concatenate([kept[c], rows[c]]) for c in names}
        if not len(rows["fp"]):
            continue
        unit = np.stack([rows[c] for c in _UNIT])
        rank = np.concatenate([[0], np.cumsum((unit[:, 1:] != unit[:, :-1]).any(0))])
        place = rank * 128 + rows["near"]  # distances are at most 64, so a window never reaches the next unit
        end = np.searchsorted(place, place + limit, side="right")
        i, j = _linked(rows, pivots, end, held, limit)
        if len(i):
            nodes, at = np.unique(np.concatenate([i, j]), return_inverse=True)
            root = _stars(at[: len(i)], at[len(i) :], len(nodes))
            moved = root != np.arange(len(nodes))
            columns = [pa.array(rows["fp"][nodes[moved]]), pa.array(rows["fp"][nodes[root[moved]]])]
            yield pa.RecordBatch.from_arrays(columns, names=["a", "b"])
        tail = place >= place[-1] - limit  # places of earlier units are further away than that
        kept = {c: rows[c][tail] for c in names}


def _linked(rows: dict[str, np.ndarray], pivots: np.ndarray, end: np.ndarray, held: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the pairs within ``limit`` bits, the second of each not among the ``held`` rows."""
    fp = rows["fp"].view(np.uint64)
    table = np.bitwise_count(fp[:, None] ^ pivots).astype(np.int8)
    alone = rows["low"] == rows["high"]
    start = np.maximum(np.arange(len(fp)) + 1, held)
    count = np.maximum(end - start, 0)
    before = np.concatenate([[0], np.cumsum(count)])
    found, at = [], 0
    while at < len(fp):
        to = max(at + 1, int(np.searchsorted(before, before[at] + PAIRS, side="right")) - 1)
        own = count[at:to]
        i = np.repeat(np.arange(at, to), own)
        j = np.arange(len(i)) + np.repeat(start[at:to] - (before[at:to] - before[at]), own)
        two = alone[i] | (rows["slice"][i] != rows["slice"][j])
        i, j = i[two], j[two]
        for p in range(1, len(pivots)):
            close = np.abs(table[i, p] - table[j, p]) <= limit
            i, j = i[close], j[close]
        near = np.bitwise_count(fp[i] ^ fp[j]) <= limit
        found.append((i[near], j[near]))
        at = to
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def _stars(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The smallest row number that each of n rows is connected with."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[i], root[j])
        if (root[i] == least).all() and (root[j] == least).all():
            return root
        np.minimum.at(root, root[i], least)
        np.minimum.at(root, root[j], least)
        while (root[root] != root).any():
            root = root[root]
