"""Jaccard join of word n-grams by a size-aware split into light and heavy sets.

Every text is the set of its shingles. Equal sets are one. Two sets are linked
if they share so large a part of their union that the overlap of sizes a and b
is at least ``overlap(a, b)``, a fixed number for two sizes.

* Light sets, up to a size ``boundary``: every subset of that fixed size is
  enumerated, and sets that meet in a subset are linked, with no check.
* Heavy sets, above it: sets are in inverted lists, by the shingles that come
  first in an order of rising frequency. Only so many are needed that two linked
  sets must meet (a fifth of a set at 0.8). Sets that meet by places from which
  the overlap can still be reached are compared in full.

Subsets cost their number, which grows fast with the size; lists cost entries
and what is scanned in them, which depends on how frequent the shingles are. Both
are summed for every size, and the boundary is where the total is least.

The frequent shingles, which decide the order, are those that occur more than
once among the texts that a task reads together, summed over all of these; the
order is the same everywhere and decides speed only. Entries of frequent shingles are dealt out by set, the others
by shingle, so a shingle of a third of all texts isn't one task's. A short list
is scanned where it is sorted and gives pairs; a long one gives its entries,
which ``operators.lists`` links without forming the list's pairs. Sketches of the
sets discard most pairs before texts are read again: short ones first, then for
large sets ones that grow with the set, as few bits tell nothing of many shingles.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusaudit.llm.common import partitions, stored
from corpusaudit.operators.lists import list_components

SIZE, SIMILAR = 5, 80
#: Largest boundary that is considered.
MOST_LIGHT = 16
#: Shingles that are counted together, how often one is counted to be frequent, and frequent ones at most that order shingles.
CHUNK, OFTEN, MOST_FREQUENT = 1 << 20, 8, 1 << 17
#: Bytes that are cut to words together, ids that go to the texts as they are, and bits that mark more of them.
SEGMENT, MOST_SENT, MARKS = 1 << 18, 1 << 18, 1 << 24
#: Entries of a list whose pairs are formed, and bits of a short sketch.
SHORT, BITS = 24, 1024
_HELD = 1 << 17


# -- sets ------------------------------------------------------------------------
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: A number for each byte of a word, 0 for white space; A to Z count as a to z.
_VALUE = np.array([0 if c in b"\t\n\v\f\r " else c + 33 if 65 <= c <= 90 else c + 1 for c in range(256)], np.uint64)


class _Powers:
    """Powers of the hash base and of its inverse, made once in a process."""

    made: tuple[np.ndarray, np.ndarray] | None = None

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if cls.made is None or len(cls.made[0]) <= n:
            inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
            cls.made = tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n, 2 * SEGMENT), x)]), dtype=np.uint64) for x in (_BASE, inverse))
        return cls.made


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word: sums of its bytes' numbers times powers of a base, for all words at once."""
    value = _VALUE[np.frombuffer(data, np.uint8)]
    inside = np.concatenate([[False], value > 0, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[::2], edges[1::2]
    up, down = _Powers.of(len(value))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value * up[: len(value)], dtype=np.uint64)])
    return _mixed((total[end] - total[start]) * down[start]), start


def _words_of(texts: Iterable[bytes | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Groups of texts: the word hashes of all, and where the words of each text end among them."""
    group, held = [], 0
    for text in texts:
        text = text or b""
        if len(text) > SEGMENT:
            if group:
                yield _grouped(group)
                group, held = [], 0
            words = np.concatenate([_word_hashes(piece)[0] for piece in _cut(text)])
            yield words, np.array([len(words)])
            continue
        group.append(text)
        held += len(text)
        if held > SEGMENT:
            yield _grouped(group)
            group, held = [], 0
    if group:
        yield _grouped(group)


def _grouped(group: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    words, start = _word_hashes(b" ".join(group))
    return words, np.searchsorted(start, np.cumsum([len(x) + 1 for x in group]) - 1, side="right")


def _cut(text: bytes) -> Iterator[bytes]:
    start = 0
    while start < len(text):
        end = start + SEGMENT
        while end < len(text) and text[end] not in b"\t\n\v\f\r ":
            end += 1
        yield text[start:end]
        start = end


def shingle_sets(texts: Iterable[bytes | None], size: int = SIZE) -> Iterator[np.ndarray]:
    """For each text the sorted hashes of its different runs of ``size`` words; fewer words are one run, none gives nothing."""
    for words, ends in _words_of(texts):
        runs = _runs(words, size)
        start = 0
        for end in ends.tolist():
            if end - start >= size:
                own = np.sort(runs[start : end - size + 1])
                yield own[np.concatenate([[True], own[1:] != own[:-1]])]
            else:
                yield _runs(words[start:end], end - start) if end > start else np.zeros(0, np.uint64)
            start = end


def _runs(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words."""
    n = max(0, len(words) - size + 1)
    h = np.full(n, size, np.uint64)
    for i in range(size):
        h = _mixed(h) + words[i : n + i]
    return _mixed(h * np.uint64(0x94D049BB133111EB))


def _texts(batch: pa.RecordBatch) -> Iterator[bytes | None]:
    return (x.as_py() for x in batch.column("text"))


def node_of(shingles: np.ndarray) -> int:
    """A number for the whole set, as a signed long."""
    h = xxhash.xxh64_intdigest(shingles.tobytes(), 7)
    return h - (1 << 64) if h >> 63 else h


def overlap(a: int, b: int, similar: int = SIMILAR) -> int:
    """The least overlap of linked sets of two sizes: ``similar`` per cent of the union, in whole numbers."""
    return -(-similar * (a + b) // (100 + similar))


def prefix(n: int, similar: int = SIMILAR) -> int:
    """How many first shingles of a set of n meet any linked set's."""
    return n - -(-similar * n // 100) + 1


def sketch_of(shingles: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Whether an even or odd number of shingles falls on each of ``bits`` bits, as longs.

    A shingle that only one of two sets has changes one bit, so the bits in which
    two sketches differ are never more than the shingles in which the sets do.
    """
    odd = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def wide_sketch_of(shingles: np.ndarray) -> np.ndarray | None:
    """A sketch with as many bits as the largest power of two that is no more than the set; None where ``BITS`` are as many."""
    bits = 1 << max(0, len(shingles).bit_length() - 1)
    return sketch_of(shingles, bits) if bits > BITS else None


def bits_apart(a: np.ndarray, b: np.ndarray) -> int:
    """The bits in which two sketches differ, 0 if one is empty. The longer is folded: what falls on a bit of it falls on that bit modulo the shorter's."""
    least = min(len(a), len(b))
    if not least:
        return 0
    a, b = (np.bitwise_xor.reduce(x.view(np.uint64).reshape(-1, least), axis=0) for x in (a, b))
    return int(np.bitwise_count(a ^ b).sum())


_FACTS = "id long, n long, node long, shingles array<long>, times array<long>, sketch array<long>, wide array<long>"


def _facts(docs: DataFrame, size: int, most_light: int) -> DataFrame:
    """A row per document: id, set size, node, sketches and, of a small set, the shingles; and rows without n: shingles that occur more than once, and their counts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held = [], 0
        for batch in batches:
            rows = []
            for key, own in zip(batch.column("id"), shingle_sets(_texts(batch), size)):
                chunk.append(own)
                held += len(own)
                small = own.view(np.int64) if len(own) <= most_light else None
                rows.append((key.as_py(), len(own), node_of(own) if len(own) else None, small, None, sketch_of(own), wide_sketch_of(own)))
                if held >= CHUNK:
                    rows.append(_often(chunk))
                    chunk, held = [], 0
            yield _rows(rows)
        yield _rows([_often(chunk)])

    return docs.mapInArrow(run, _FACTS)


def _often(chunk: list[np.ndarray]) -> tuple:
    shingles, times = np.unique(np.concatenate(chunk), return_counts=True) if chunk else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    return None, None, None, shingles[times > 1].view(np.int64), times[times > 1], None, None


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 3 + [pa.list_(pa.int64())] * 4
    columns = zip(*rows) if rows else [()] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["id", "n", "node", "shingles", "times", "sketch", "wide"])


def _frequent(facts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles in order, and their counts.

    Counts are sums over all texts, so a shingle that is spread thinly over a
    large table is known too; its list would grow with the table.
    """
    each = facts.where("n IS NULL").select(F.explode(F.arrays_zip("shingles", "times")).alias("s")).select("s.*")
    counted = each.groupBy("shingles").agg(F.sum("times").alias("times")).where(F.col("times") >= OFTEN)
    top = counted.orderBy(F.desc("times"), "shingles").limit(MOST_FREQUENT).collect()
    shingles = np.array([r["shingles"] for r in top], np.int64).view(np.uint64)
    order = np.argsort(shingles)
    return shingles[order], np.array([r["times"] for r in top], np.int64)[order]


def _times(shingles: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """How often each shingle was counted, 0 for one that isn't frequent."""
    known, times = frequent
    if not len(known):
        return np.zeros(len(shingles), np.int64)
    at = np.minimum(np.searchsorted(known, shingles), len(known) - 1)
    return np.where(known[at] == shingles, times[at], 0)


# -- the boundary ------------------------------------------------------------------
def _partners(n: int, boundary: int, similar: int) -> Iterator[tuple[int, int]]:
    """Sizes of light sets that a set of n may be linked with, and the overlap; equal sets are one already."""
    for other in range(1, boundary + 1):
        needed = overlap(n, other, similar)
        if needed <= min(n, other) and not needed == n == other:
            yield other, needed


def light_cost(n: int, boundary: int, similar: int = SIMILAR) -> int:
    """Subsets of a set of n."""
    return sum(math.comb(n, needed) for _, needed in _partners(n, boundary, similar))


def choose_boundary(sets: dict[int, int], scanned: dict[int, int], most_light: int = MOST_LIGHT, similar: int = SIMILAR) -> int:
    """The boundary of the least cost, from the number of sets of each size and what their lists hold (entries of others to be scanned).

    Light sets that a heavy one may be linked with are in the lists too.
    """

    def cost(boundary: int) -> int:
        light = sum(k * light_cost(n, boundary, similar) for n, k in sets.items() if n <= boundary)
        return light + sum(k * prefix(n, similar) + scanned.get(n, 0) for n, k in sets.items() if n >= least_listed(boundary, similar))

    return min(range(most_light + 1), key=lambda boundary: (cost(boundary), boundary))


def least_listed(boundary: int, similar: int = SIMILAR) -> int:
    """The smallest set that may be linked with one above the boundary."""
    return max(1, -(-similar * (boundary + 1) // 100))


def _costs(small: DataFrame, frequent: tuple[np.ndarray, np.ndarray], similar: int) -> tuple[dict[int, int], dict[int, int]]:
    """Of small sets, by size: how many there are, and the counts of the shingles that they would be listed by; a row per size is collected."""
    sent = small.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, scanned = {}, {}
        for batch in batches:
            for x in batch.column("shingles"):
                times = np.sort(np.maximum(_times(np.array(x.as_py(), np.int64).view(np.uint64), sent.value), 1))
                sets[len(times)] = sets.get(len(times), 0) + 1
                scanned[len(times)] = scanned.get(len(times), 0) + int(times[: prefix(len(times), similar)].sum())
        yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.int64()) for x in (sets, sets.values(), scanned.values())], names=["n", "sets", "scanned"])

    rows = small.select("shingles").mapInArrow(run, "n long, sets long, scanned long").groupBy("n").agg(F.sum("sets").alias("sets"), F.sum("scanned").alias("scanned")).collect()
    return {r["n"]: r["sets"] for r in rows}, {r["n"]: r["scanned"] for r in rows}


# -- light sets --------------------------------------------------------------------
def light_links(small: DataFrame, boundary: int, similar: int = SIMILAR) -> DataFrame:
    """(a, b): links that connect all linked pairs of light sets (node, shingles, each once).

    Sets of two sizes that share a subset of their overlap are linked. Each
    points to the smallest node of the other size, or of its own where the sizes
    are equal: minima are summed up before rows move, and joined back by key.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for node, x in zip(batch.column("node").to_pylist(), batch.column("shingles").to_pylist()):
                own = [s.to_bytes(8, "little", signed=True) for s in x]
                for other, needed in _partners(len(own), boundary, similar):
                    sizes = bytes(sorted((len(own), other)))
                    side = (len(own) > other) - (len(own) < other)
                    for chosen in combinations(own, needed):
                        rows.append((xxhash.xxh128_digest(sizes + b"".join(chosen)), node, side))
                        if len(rows) >= _HELD:
                            yield _subsets(rows)
                            rows = []
            yield _subsets(rows)

    subsets = stored(small.where(F.col("n") <= boundary).select("node", "shingles").mapInArrow(run, "subset binary, node long, side int"), "jaccard-subsets")

    def least(side: int) -> Column:
        return F.min(F.when(F.col("side") == side, F.col("node")))

    ends = subsets.groupBy("subset").agg(least(-1).alias("smaller"), least(0).alias("same"), least(1).alias("larger"))
    useful = ends.where("same IS NOT NULL OR (smaller IS NOT NULL AND larger IS NOT NULL)")
    other = F.when(F.col("side") == 0, F.col("same")).when(F.col("side") < 0, F.col("larger")).otherwise(F.col("smaller"))
    return subsets.join(useful, "subset").select(F.col("node").alias("a"), other.alias("b")).where("a <> b").distinct()


def _subsets(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.int32()))], names=["subset", "node", "side"])


# -- heavy sets --------------------------------------------------------------------
_MET = "list long, node long, n int, place int, other long"


def meetings(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray], boundary: int, size: int = SIZE, similar: int = SIMILAR) -> DataFrame:
    """What meets in the inverted lists of sets that may be linked with a heavy one.

    Rows with ``other`` are pairs of nodes of a short list that may be linked.
    Rows without are entries of a long list (list, node, n, place), where
    ``place`` counts from 0 in the set's order. A list of one set gives nothing.
    """
    sent, least = docs.sparkSession.sparkContext.broadcast(frequent), least_listed(boundary, similar)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = 0, []
        for batch in batches:
            for own in shingle_sets(_texts(batch), size):
                if len(own) < least:
                    continue
                times = _times(own, sent.value)
                first = np.argsort(times, kind="stable")[: prefix(len(own), similar)]  # equal counts in the order of hashes
                often, node = times[first] > 0, node_of(own)
                rows.append((np.where(often, node, own[first].view(np.int64)), own[first].view(np.int64), node, len(own), often))
                held += len(first)
                if held >= _HELD:
                    yield _entries(rows)
                    held, rows = 0, []
        yield _entries(rows)

    every = docs.select("text").mapInArrow(run, "deal long, list long, node long, n int, place int, often boolean")
    dealt = every.repartition(partitions(docs.sparkSession), "deal").sortWithinPartitions("list", "node")
    return dealt.mapInArrow(lambda batches: _scanned(batches, boundary, similar), _MET).distinct()


def _entries(rows: list[tuple]) -> pa.RecordBatch:
    deal, lists, node, n, often = zip(*rows) if rows else [()] * 5
    sizes = [len(x) for x in lists]
    flat = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    columns = [
        flat(deal, np.int64), flat(lists, np.int64), np.repeat(np.array(node, np.int64), sizes), np.repeat(np.array(n, np.int32), sizes),
        flat([np.arange(s, dtype=np.int32) for s in sizes], np.int32), flat(often, bool),
    ]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["deal", "list", "node", "n", "place", "often"])


def _reach(n, other_n, place, other_place, boundary: int, similar: int, least, greatest):
    """Whether one set is heavy, sizes are near, and the overlap can be reached from the shingle at these places on; for arrays or columns."""
    low, high, after = least(n, other_n), greatest(n, other_n), least(n - place, other_n - other_place)
    return (high > boundary) & (100 * low >= similar * high) & ((100 + similar) * after >= similar * (low + high))


_NAMES = ["list", "node", "n", "place"]


def _scanned(batches: Iterable[pa.RecordBatch], boundary: int, similar: int) -> Iterator[pa.RecordBatch]:
    """Rows by list and node: pairs of short lists, entries of long ones and of frequent shingles.

    The last list of a batch waits for the next one, unless it is long already.
    """
    held: dict[str, np.ndarray] | None = None
    long = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in (*_NAMES, "often")}
        direct = rows["often"] | ((rows["list"] == long) if long is not None else False)
        if direct.any():
            yield _entry_rows(rows, direct)
            rows = {c: x[~direct] for c, x in rows.items()}
        if held is not None:
            rows = {c: np.concatenate([held[c], rows[c]]) for c in rows}
        if not len(rows["list"]):
            held = None
            continue
        # A repeated text is one entry.
        new = np.concatenate([[True], (rows["list"][1:] != rows["list"][:-1]) | (rows["node"][1:] != rows["node"][:-1])])
        rows = {c: x[new] for c, x in rows.items()}
        start = int(np.searchsorted(rows["list"], rows["list"][-1]))
        yield from _lists_met({c: x[:start] for c, x in rows.items()}, boundary, similar)
        held = {c: x[start:] for c, x in rows.items()}
        if len(held["list"]) > SHORT:
            long = held["list"][0]
            yield _entry_rows(held, np.ones(len(held["list"]), bool))
            held = None
    if held is not None:
        yield from _lists_met(held, boundary, similar)


def _entry_rows(rows: dict[str, np.ndarray], keep: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array(rows[c][keep]) for c in _NAMES]
    return pa.RecordBatch.from_arrays([*columns, pa.nulls(len(columns[0]), pa.int64())], names=[*_NAMES, "other"])


def _lists_met(rows: dict[str, np.ndarray], boundary: int, similar: int) -> Iterator[pa.RecordBatch]:
    """Whole lists: the pairs of each that may be linked, each pair once for these rows, or a long list's entries."""
    lists = rows["list"]
    if not len(lists):
        return
    first = np.concatenate([[True], lists[1:] != lists[:-1]])
    size = np.diff(np.append(np.flatnonzero(first), len(lists)))[np.cumsum(first) - 1]
    if (size > SHORT).any():
        yield _entry_rows(rows, size > SHORT)
    rows = {c: x[(size > 1) & (size <= SHORT)] for c, x in rows.items()}
    found = []
    for step in range(1, SHORT):
        i = np.flatnonzero(rows["list"][step:] == rows["list"][:-step])
        if not len(i):
            break
        j = i + step
        near = _reach(rows["n"][i], rows["n"][j], rows["place"][i], rows["place"][j], boundary, similar, np.minimum, np.maximum)
        found.append(np.stack([rows["node"][i[near]], rows["node"][j[near]]], 1))  # in the order of nodes
    if found:
        pairs = np.unique(np.concatenate(found), axis=0)
        none = [pa.nulls(len(pairs), t) for t in (pa.int64(), pa.int32(), pa.int32())]
        yield pa.RecordBatch.from_arrays([none[0], pa.array(pairs[:, 0]), none[1], none[2], pa.array(pairs[:, 1])], names=[*_NAMES, "other"])


def _marks(wanted: DataFrame) -> np.ndarray:
    """``MARKS`` bits, set where a wanted id falls; a 32nd as many numbers are collected at most."""
    slot = F.xxhash64("id").bitwiseAND(MARKS - 1)
    words = wanted.select(slot.alias("slot")).groupBy(F.shiftright("slot", 5).alias("word")).agg(F.bit_or(F.pow(F.lit(2.0), F.col("slot") % 32).cast("long")).alias("bits"))
    out = np.zeros(MARKS // 32, np.uint32)
    for row in words.collect():
        out[row["word"]] = row["bits"]
    return out


def _sets_of(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(node, shingles) of the wanted (node, id).

    Only the texts of wanted ids are read as words: a few ids go to the texts,
    more of them as marks, which a few other texts may fit too.
    """
    wanted = stored(wanted, "jaccard-wanted")
    if wanted.count() <= MOST_SENT:
        picked = docs.join(F.broadcast(wanted.select(F.col("id").alias("own"))), F.col("id").eqNullSafe(F.col("own")), "left_semi").select("id", "text")
    else:
        picked = docs.select("id", "text", F.xxhash64("id").bitwiseAND(MARKS - 1).alias("slot")).mapInArrow(_marked(docs, wanted), "id long, text binary")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for key, own in zip(batch.column("id").to_pylist(), shingle_sets(_texts(batch), size)):
                if len(own):
                    rows.append((node_of(own), key, own.view(np.int64)))
                    held += len(own)
                if held >= _HELD:
                    yield _named_sets(rows)
                    rows, held = [], 0
            yield _named_sets(rows)

    read = picked.mapInArrow(run, "node long, id long, shingles array<long>")
    own = wanted.select(F.col("node").alias("own"), F.col("id").alias("own_id"))
    return read.join(own, (F.col("node") == F.col("own")) & F.col("id").eqNullSafe(F.col("own_id")), "left_semi").dropDuplicates(["node"]).select("node", "shingles")


def _marked(docs: DataFrame, wanted: DataFrame):
    sent = docs.sparkSession.sparkContext.broadcast(_marks(wanted))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = batch.column("slot").to_numpy()
            keep = (sent.value[slot >> 5] >> (slot & 31).astype(np.uint32)) & np.uint32(1)
            yield batch.select(["id", "text"]).filter(pa.array(keep.astype(bool)))

    return run


def _named_sets(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.list_(pa.int64())))], names=["node", "id", "shingles"])


def _alike(one, other, similar: int) -> Column:
    """Whether two sets' short sketches differ in no more bits than linked sets differ in shingles."""
    apart = F.aggregate(F.zip_with(one("sketch"), other("sketch"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, x: total + x)
    total = one("n") + other("n")
    return (100 + similar) * (total - apart) >= 2 * similar * total


def maybe_linked(pairs: DataFrame, sets: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """The pairs (a, b) whose sketches don't differ in more bits than linked sets differ in shingles; ``sets`` has node, n, sketch and wide.

    Short sketches first, as they are the least that moves, then the wide ones
    of what is left: these are an eighth of a byte or less for each shingle.
    """
    one, other = (sets.select(F.col("node").alias(side), F.col("n").alias(f"{side}_n"), F.col("sketch").alias(f"{side}_sketch")) for side in ("a", "b"))
    alike = _alike(lambda c: F.col(f"a_{c}"), lambda c: F.col(f"b_{c}"), similar)
    near = pairs.join(one, "a").join(other, "b").where(alike).select("a", "b", (F.col("a_n") + F.col("b_n")).alias("total"))
    one, other = (sets.where("wide IS NOT NULL").select(F.col("node").alias(side), F.col("wide").alias(f"{side}_wide")) for side in ("a", "b"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apart = np.array([bits_apart(x, y) for x, y in zip(_lists(batch.column("a_wide")), _lists(batch.column("b_wide")))], np.int64)
            total = batch.column("total").to_numpy()
            yield batch.select(["a", "b"]).filter(pa.array((100 + similar) * (total - apart) >= 2 * similar * total))

    return near.join(one, "a", "left").join(other, "b", "left").select("a", "b", "total", "a_wide", "b_wide").mapInArrow(run, "a long, b long")


def _lists(column: pa.ListArray) -> Iterator[np.ndarray]:
    """The numbers of each row; a null is empty."""
    values, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return (values[start:end] for start, end in zip(ends[:-1], ends[1:]))


def linked(pairs: DataFrame, docs: DataFrame, sets: DataFrame, size: int = SIZE, similar: int = SIMILAR) -> DataFrame:
    """The pairs of nodes (a, b) whose whole sets are linked; ``sets`` has node, n, sketches and the id of a document.

    Pairs whose sketches are too far apart are none. The texts of the others
    are read and compared in full.
    """
    pairs = stored(maybe_linked(pairs, sets, similar), "jaccard-pairs")
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    full = stored(_sets_of(docs, nodes.join(sets.select("node", "id"), "node"), size), "jaccard-compared")
    one, other = (full.select(F.col("node").alias(side), F.col("shingles").alias(f"{side}_set")) for side in ("a", "b"))
    both = F.size(F.array_intersect("a_set", "b_set"))
    enough = 100 * both >= similar * (F.size("a_set") + F.size("b_set") - both)
    return pairs.join(one, "a").join(other, "b").where(enough).select("a", "b")


# -- the join ----------------------------------------------------------------------
def near_groups(
    docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, similar: int = SIMILAR, most_light: int = MOST_LIGHT, boundary: int | None = None
) -> DataFrame:
    """One row per document: doc_id, n_shingles and component_id, the smallest key that links reach, its own included.

    Texts whose sets of ``size``-word shingles, letters A to Z in lower case,
    share ``similar`` per cent of their union are linked. Fewer words are one
    shingle; a null text and one without words has none and is linked with
    nothing, so its component_id is its own key. Rows with a null key stay and
    count for no component_id unless all its keys are null; repeated rows stay;
    other columns are ignored; an empty table gives an empty result. The boundary
    between light and heavy sets is chosen by cost unless given.
    """
    read = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("binary").alias("text"))
    facts = stored(_facts(read, size, most_light), "jaccard-facts")
    frequent = _frequent(facts)
    sets = stored(facts.where("n > 0").groupBy("node").agg(*[F.min(c).alias(c) for c in ("id", "n", "shingles", "sketch", "wide")]), "jaccard-sets")
    small = sets.where(F.col("n") <= most_light)
    if boundary is None:
        boundary = choose_boundary(*_costs(small, frequent, similar), most_light, similar)
    met = stored(meetings(read, frequent, boundary, size, similar), "jaccard-lists")
    pairs = met.where("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b"))
    links = light_links(small, boundary, similar).unionByName(linked(pairs, read, sets, size, similar))

    def fits(one, other) -> Column:
        return _reach(one("n"), other("n"), one("place"), other("place"), boundary, similar, F.least, F.greatest)

    long = met.where("other IS NULL").drop("other")
    alike, sketches = (lambda one, other: _alike(one, other, similar)), sets.select("node", "sketch")
    roots = list_components(long, fits, lambda pairs: linked(pairs, read, sets, size, similar), links, facts=sketches, alike=alike)
    classes = sets.join(roots, "node", "left").select("node", "id", F.coalesce("root", "node").alias("root"))
    least = classes.groupBy("root").agg(F.min("id").alias("component_id"))
    named = classes.join(least, "root").select(F.col("node").alias("own"), "component_id")
    rows = facts.where("n IS NOT NULL").select("id", "n", "node")
    return rows.join(named, F.col("node") == F.col("own"), "left").select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id")
    )
