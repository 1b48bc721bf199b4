"""Sketches of sets of hashes, which tell that two sets are too far apart to be near.

A sketch has a bit for each remainder of the hashes, set where an odd number of
them falls on it. A hash that only one of two sets has changes one bit, so two
sketches never differ in more bits than the sets do in hashes: what is dropped by
them is not near, whatever their size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a short sketch.
BITS = 1024


def sketch_of(hashes: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Whether an even or odd number of the hashes falls on each of ``bits`` bits, as longs; a power of two, 64 at least."""
    odd = np.bincount(hashes & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def wide_sketch_of(hashes: np.ndarray) -> np.ndarray | None:
    """A sketch with as many bits as the largest power of two that is no more than the set; None where ``BITS`` are as many."""
    bits = 1 << max(0, len(hashes).bit_length() - 1)
    return sketch_of(hashes, bits) if bits > BITS else None


def bits_apart(a: np.ndarray, b: np.ndarray) -> int:
    """The bits in which two sketches differ, 0 if one is empty. The longer is folded: what falls on a bit of it falls on that bit modulo the shorter's."""
    least = min(len(a), len(b))
    if not least:
        return 0
    a, b = (np.bitwise_xor.reduce(x.view(np.uint64).reshape(-1, least), axis=0) for x in (a, b))
    return int(np.bitwise_count(a ^ b).sum())


def sketches_of(sets: DataFrame) -> DataFrame:
    """(text, n, sketch, wide) of (text, shingles), each text once: the size, and a short and, for large sets, a wide sketch."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = list(_lists(batch.column("shingles")))
            columns = [pa.array([len(x) for x in own], pa.int32()), *(pa.array([f(x) for x in own], pa.list_(pa.int64())) for f in (sketch_of, wide_sketch_of))]
            yield pa.RecordBatch.from_arrays([batch.column("text"), *columns], names=["text", "n", "sketch", "wide"])

    return sets.mapInArrow(run, "text long, n int, sketch array<long>, wide array<long>").dropDuplicates(["text"])


def alike(one: Callable[[str], Column], other: Callable[[str], Column], similar: float) -> Column:
    """Whether two short sketches differ in no more bits than near sets do in hashes; reads n and sketch."""
    apart = F.aggregate(F.zip_with(one("sketch"), other("sketch"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, x: total + x)
    return _enough(one("n") + other("n"), apart, similar)


def _enough(total, apart, similar: float):
    """Whether sets of ``total`` hashes may share ``similar`` of their union if ``apart`` or more are in one only; for arrays or columns."""
    return (1 + similar) * (total - apart) >= 2 * similar * total - 1e-6


def maybe_near(pairs: DataFrame, sketches: DataFrame, similar: float) -> DataFrame:
    """The pairs (a, b) whose sketches aren't too far apart: short ones first, as they are the least that moves, then the wide ones of what is left."""
    one, other = (sketches.select(F.col("text").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in ("n", "sketch")]) for side in ("a", "b"))
    total = (F.col("a_n") + F.col("b_n")).alias("total")
    left = pairs.join(one, "a").join(other, "b").where(alike(lambda c: F.col(f"a_{c}"), lambda c: F.col(f"b_{c}"), similar)).select("a", "b", total)
    one, other = (sketches.where("wide IS NOT NULL").select(F.col("text").alias(side), F.col("wide").alias(f"{side}_wide")) for side in ("a", "b"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apart = np.array([bits_apart(x, y) for x, y in zip(_lists(batch.column("a_wide")), _lists(batch.column("b_wide")))], np.int64)
            yield batch.select(["a", "b"]).filter(pa.array(_enough(batch.column("total").to_numpy(), apart, similar)))

    return left.join(one, "a", "left").join(other, "b", "left").select("a", "b", "total", "a_wide", "b_wide").mapInArrow(run, "a long, b long")


def _lists(column: pa.ListArray) -> Iterator[np.ndarray]:
    """The numbers of each row; a null is empty."""
    values, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return (values[start:end] for start, end in zip(ends[:-1], ends[1:]))
