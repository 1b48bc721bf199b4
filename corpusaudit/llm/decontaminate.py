"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Texts become sequences of word hashes, letters in lower case and punctuation
dropped. Seeds are pairs of words that are next to each other or have one word
between them, in the item and in the document, so that a word changed, added or
dropped between the two breaks no pair. A first reading of the corpus counts in
how many documents each pair of the test items occurs, and the rarest places of
every item are its seeds, as many as lose nothing (``Items.rare``): any
alignment that reaches the threshold meets ``needed`` of them. In a second
reading, a stretch of a document that meets that many is joined to the item, and
the words around are aligned with the whole item by local alignment. The window
around a seed is as wide as any alignment through it can be that reaches the
threshold, so the result is that of aligning every item with every text.

Both readings are narrow: the items travel to the documents. They are bounded:
items beyond ``MOST_WORDS`` words are taken in further passes, split by hash, so
that a benchmark of any size is checked whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusaudit.llm.common import stored

#: Distances of the two words of a pair, and words of all items that travel together.
GAPS, MOST_WORDS = (1, 2), 1 << 20
#: Part of an item's places that are seeds, if those that lose nothing are fewer. It decides speed only.
RARE = 0.75
#: Points of a matching word, and cost of a changed, added or dropped one; half of the points or more (``_met``).
MATCH, COST = 2, 1
#: Part of the points of a whole match from which a document holds an item.
THRESHOLD = 0.5
#: Matching words that an item needs at least. An item of fewer words is in a document that is nothing else.
LEAST_WORDS = 5
#: Bytes that are hashed together, and cells that are aligned together.
PIECE, CELLS = 1 << 20, 1 << 20

HITS = "array<struct<item:bigint,score:double,start_word:int,end_word:int>>"

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTES = np.zeros(256, np.uint64)  # 0 between words
_BYTES[[*b"abcdefghijklmnopqrstuvwxyz0123456789", *range(128, 256)]] = np.arange(1, 165)


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


class _Powers:
    """Powers of the hash base and of its inverse, made once in a process."""

    up: np.ndarray | None = None
    down: np.ndarray | None = None

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if cls.up is None or len(cls.up) < n:
            size = max(n, PIECE + (1 << 16))
            cls.up, cls.down = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, b)]), dtype=np.uint64) for b in (_BASE, np.uint64(_inverse(int(_BASE)))))
        return cls.up, cls.down


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(29))) | np.uint64(1)  # never 0, which pads windows


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word of lower-case UTF-8; typographic punctuation separates like ASCII's."""
    raw = np.frombuffer(data, np.uint8)
    value = _BYTES[raw]
    marks = np.flatnonzero((raw[:-2] == 0xE2) & (raw[1:-1] == 0x80)) if len(raw) > 2 else np.zeros(0, int)
    for i in range(3):
        value[marks + i] = 0
    inside = np.concatenate([[False], value > 0, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[::2], edges[1::2]
    up, down = _Powers.of(len(raw))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value * up[: len(raw)], dtype=np.uint64)])
    return _mixed((total[end] - total[start]) * down[start]), start


def words_of(texts: Iterable[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Groups of texts: word hashes of all, and where the words of each text end among them."""
    group, size = [], 0
    for text in texts:
        data = (text or "").lower().encode("utf-8", "surrogatepass")
        if len(data) > PIECE:
            if group:
                yield _grouped(group)
                group, size = [], 0
            hashes = np.concatenate([word_hashes(p)[0] for p in _cut(data)])
            yield hashes, np.array([len(hashes)])
            continue
        group.append(data)
        size += len(data)
        if size > PIECE:
            yield _grouped(group)
            group, size = [], 0
    if group:
        yield _grouped(group)


def _cut(data: bytes) -> Iterator[bytes]:
    start = 0
    while start < len(data):
        end = start + PIECE
        while end < len(data) and data[end] not in b" \n\t\r":
            end += 1
        yield data[start:end]
        start = end


def _grouped(group: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    hashes, start = word_hashes(b" ".join(group))
    return hashes, np.searchsorted(start, np.cumsum([len(x) + 1 for x in group]) - 1, side="right")


def pairs(words: np.ndarray, gap: int) -> np.ndarray:
    """Hash of every two words at a distance; of every word for the distance 0."""
    if not gap:
        return _mixed(words)
    return _mixed(words[:-gap] * np.uint64(0x94D049BB133111EB) + words[gap:])


def share_of(length, threshold: float):
    """The part of a whole match that an item of so many words needs."""
    return np.maximum(threshold, np.minimum(length, LEAST_WORDS) / length)


def _met(length: int, threshold: float) -> tuple[int, bool]:
    """How many places of an item any alignment at the threshold meets, and whether by pairs.

    Of m matching words and e edits, 2m - e >= 2 * threshold * length. Between
    the m words are m - 1 gaps, at most e / 2 of them with two edits or more, so
    threshold * length - 1 gaps have one edit at most: their two words are at a
    distance of 1 or 2 in the item and in the text. Where that is no gap at all,
    single words are met.
    """
    least = math.ceil(threshold * length - 1e-9)
    return (least - 1, True) if least > 1 else (1, False)


@dataclass
class Items:
    """Test items that travel together: ids, words, seeds as sorted hashes with item and offset, how many seeds are needed, and the ids of short items by their words."""

    ids: list[int]
    words: list[np.ndarray]
    threshold: float
    seeds: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    item: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    offset: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    needed: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    short: dict[bytes, int] = field(default_factory=dict)

    @classmethod
    def of(cls, ids: list[int], words: list[np.ndarray], threshold: float) -> Items:
        """With every place as a seed."""
        short = {w.tobytes(): i for i, w in zip(ids, words) if len(w) < LEAST_WORDS}
        ids, words = [i for i, w in zip(ids, words) if len(w) >= LEAST_WORDS], [w for w in words if len(w) >= LEAST_WORDS]
        found, needed = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))], []
        for i, w in enumerate(words):
            least, paired = _met(len(w), share_of(len(w), threshold))
            needed.append(least)
            for gap in GAPS if paired else (0,):
                if len(w) > gap:
                    h = pairs(w, gap)
                    found.append((h, np.full(len(h), i), np.arange(len(h))))
        return cls(ids, words, threshold, short=short)._with(*(np.concatenate(x) for x in zip(*found)), np.array(needed, np.int64))

    def _with(self, seeds: np.ndarray, item: np.ndarray, offset: np.ndarray, needed: np.ndarray) -> Items:
        order = np.lexsort((offset, item, seeds))
        return Items(self.ids, self.words, self.threshold, seeds[order], item[order], offset[order], needed, self.short)

    def parts(self) -> tuple:
        """Plain arrays, which tasks can read without this class."""
        return self.ids, self.words, self.threshold, self.seeds, self.item, self.offset, self.needed, self.short

    def rare(self, seen: dict[int, int]) -> Items:
        """With the seeds of each item's rarer places; ``seen`` counts documents by hash.

        Of an item's places, an alignment at the threshold meets ``needed``. Each
        place that is left out takes one away at most, so one fewer is needed,
        and at least one stays.
        """
        counts = np.array([seen.get(int(h), 0) for h in self.seeds.view(np.int64)], np.int64)
        place = np.concatenate([[0], np.cumsum([len(w) for w in self.words])])[self.item] + self.offset
        places, first, at = np.unique(place, return_index=True, return_inverse=True)
        often = np.bincount(at, counts)
        item = self.item[first]
        order = np.lexsort((places, often, item))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order)) - np.searchsorted(item, item[order])
        total = np.bincount(item, minlength=len(self.ids))
        most = np.minimum(total, np.maximum(total - self.needed + 1, np.ceil(RARE * total).astype(np.int64)))
        kept = (rank < most[item])[at]
        return self._with(self.seeds[kept], self.item[kept], self.offset[kept], np.maximum(1, self.needed - (total - most)))

    @cached_property
    def filter(self) -> np.ndarray:
        """Which upper 22 bits any seed has."""
        out = np.zeros(1 << 22, bool)
        out[(self.seeds >> np.uint64(42)).astype(np.int64)] = True
        return out

    @cached_property
    def gaps(self) -> list[int]:
        return sorted({gap for w in self.words for gap in (GAPS if _met(len(w), share_of(len(w), self.threshold))[1] else (0,))})

    def found(self, words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, first word and seed number (of the first equal seed) of every pair that is a seed."""
        out = []
        for gap in self.gaps:
            h = pairs(words, gap)
            at = np.flatnonzero(self.filter[(h >> np.uint64(42)).astype(np.int64)])
            seed = np.searchsorted(self.seeds, h[at])
            hit = seed < len(self.seeds)
            hit[hit] = self.seeds[seed[hit]] == h[at[hit]]
            at, seed = at[hit], seed[hit]
            text = np.searchsorted(ends, at, side="right")
            whole = at + gap < ends[np.minimum(text, len(ends) - 1)]
            out.append((text[whole], at[whole], seed[whole]))
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3


def _windows(items: Items, words: np.ndarray, ends: np.ndarray, threshold: float) -> dict[int, list[tuple[int, int, int]]]:
    """For each item, (text, first, last) of the words that an alignment may cover; overlapping ones of a text are one."""
    text, at, seed = items.found(words, ends)
    if not len(text):
        return {}
    last = np.searchsorted(items.seeds, items.seeds[seed], side="right")
    n = last - seed
    row = np.repeat(np.arange(len(text)), n)
    each = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + seed[row]
    text, at, item, offset = text[row], at[row], items.item[each], items.offset[each]
    lengths = np.array([len(w) for w in items.words])
    slack = np.floor(MATCH * lengths * (1 - share_of(lengths, threshold)) / COST + 1e-9).astype(np.int64)
    # An alignment is at most as long as its item and the words that it can add, so its seeds are that near each other.
    order = np.lexsort((at, item))
    text, at, item, offset = text[order], at[order], item[order], offset[order]
    place = item * (len(words) + 2 * (lengths + slack).max() + 1) + at
    span = (lengths + slack)[item]
    need = items.needed[item]
    begin, behind = np.searchsorted(place, place - span), np.searchsorted(place, place + span, side="right")
    near = behind - begin >= need  # on both sides together; an alignment's seeds are all among them
    text, at, item, offset = text[near], at[near], item[near], offset[near]
    starts = np.concatenate([[0], ends[:-1]])
    low = np.maximum(starts[text], at - offset - slack[item])
    high = np.minimum(ends[text], at - offset + lengths[item] + slack[item])
    out: dict[int, list[tuple[int, int, int]]] = {}
    order = np.lexsort((low, text, item))
    for i, t, a, b in zip(item[order].tolist(), text[order].tolist(), low[order].tolist(), high[order].tolist()):
        own = out.setdefault(i, [])
        if own and own[-1][0] == t and a <= own[-1][2]:
            own[-1] = (t, own[-1][1], max(b, own[-1][2]))
        else:
            own.append((t, a, b))
    return out


def align(item: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment score of the item in each window (rows, padded by 0), and the word after its end."""
    steps = COST * np.arange(windows.shape[1])
    above = np.zeros((len(windows), windows.shape[1] + 1), np.int64)
    best, end = np.zeros(len(windows), np.int64), np.zeros(len(windows), np.int64)
    for word in item:
        here = np.maximum(above[:, :-1] + np.where(windows == word, MATCH, -COST), above[:, 1:] - COST)
        # Dropping words of the window costs as many steps, so the best start before a place is a running maximum.
        above[:, 1:] = np.maximum.accumulate(np.maximum(here, 0) + steps, axis=1) - steps
        top = above[:, 1:].argmax(1)
        score = above[np.arange(len(windows)), top + 1]
        better = score > best
        best[better], end[better] = score[better], top[better] + 1
    return best, end


def contained(items: Items, texts: Iterable[str | None], threshold: float) -> Iterator[list[tuple[int, float, int, int]]]:
    """For each text, the items in it: id, score (best place), first word and the word after the last."""
    for words, ends in words_of(texts):
        starts = np.concatenate([[0], ends[:-1]])
        found: list[dict[int, tuple[float, int, int]]] = [{} for _ in ends]
        for i, places in _windows(items, words, ends, threshold).items():
            item = items.words[i]
            most = MATCH * len(item)
            least = share_of(len(item), threshold) * most - 1e-9
            # More points than its matching words have, a window can't reach.
            places = [p for p in places if MATCH * np.isin(words[p[1] : p[2]], item).sum() >= least]
            places.sort(key=lambda p: p[2] - p[1])
            while places:
                width = places[-1][2] - places[-1][1]
                group, places = places[-max(1, CELLS // width) :], places[: -max(1, CELLS // width)]
                rows = np.zeros((len(group), width), np.uint64)
                for row, (_, a, b) in zip(rows, group):
                    row[: b - a] = words[a:b]
                for row, score, end, (text, a, _) in zip(rows, *align(item, rows), group):
                    if score >= least and score / most > found[text].get(i, (0.0,))[0]:
                        start = end - align(item[::-1], row[None, end - 1 :: -1])[1][0]
                        found[text][i] = (float(score / most), int(a + start - starts[text]), int(a + end - starts[text]))
        for own, a, b in zip(found, starts.tolist(), ends.tolist()):
            if 0 < b - a < LEAST_WORDS and (whole := items.short.get(words[a:b].tobytes())) is not None:
                yield [(whole, 1.0, 0, b - a)]
                continue
            yield sorted((items.ids[i], *x) for i, x in own.items())


def _load(benchmark: DataFrame, key: str, text: str) -> DataFrame:
    """(item, words, item_id, n_items): every different word sequence under a hash of it, its smallest id and how many rows have it; items without words are left out."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = []
            for words, ends in words_of(x.as_py() for x in batch.column("text")):
                lists += np.split(words.view(np.int64), ends[:-1])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(lists, pa.list_(pa.int64()))], names=["id", "words"])

    rows = benchmark.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    made = rows.mapInArrow(run, "id long, words array<long>").where("size(words) > 0")
    same = made.groupBy("words").agg(F.min("id").alias("item_id"), F.count("*").alias("n_items"))
    return stored(same.select(F.xxhash64("words").alias("item"), "words", "item_id", "n_items"), "benchmark-items")


def _passes(docs: DataFrame, items: DataFrame, text: str, threshold: float) -> Iterator[Items]:
    """Items with their seeds, ``MOST_WORDS`` words at a time in expectation; one reading of the texts for each."""
    total = items.agg(F.sum(F.size("words"))).first()[0] or 0
    n = max(1, -(-total // MOST_WORDS))
    for i in range(n if total else 0):
        rows = items.where(F.pmod(F.xxhash64("words"), F.lit(n)) == i).select("item", "words").orderBy("item").collect()
        if rows:
            every = Items.of([r["item"] for r in rows], [np.array(r["words"], np.int64).view(np.uint64) for r in rows], threshold)
            yield every.rare(_document_counts(docs, every, text))


def _document_counts(docs: DataFrame, items: Items, text: str) -> dict[int, int]:
    """In how many documents each seed occurs, by signed hash; at most one row per seed."""
    sent = docs.sparkSession.sparkContext.broadcast(items.parts())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Items(*sent.value)
        n = np.zeros(len(own.seeds), np.int64)
        for batch in batches:
            for words, ends in words_of(x.as_py() for x in batch.column(0)):
                at, _, seed = own.found(words, ends)
                pairs = np.unique(at * len(n) + seed)  # a document counts once
                n += np.bincount(pairs % max(1, len(n)), minlength=len(n))
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(own.seeds[used].view(np.int64)), pa.array(n[used])], names=["seed", "n"])

    counted = docs.select(F.col(text)).mapInArrow(run, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n"))
    return {r["seed"]: r["n"] for r in counted.collect()}


def hits_column(items: Items, text: Column, threshold: float, spark: SparkSession) -> Column:
    """The items that a text holds, as an array of ``HITS``."""
    sent = spark.sparkContext.broadcast(items.parts())

    @F.pandas_udf(HITS)
    def hits(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Items(*sent.value)
        for texts in batches:
            found = ([dict(zip(("item", "score", "start_word", "end_word"), x)) for x in hit] for hit in contained(own, texts, threshold))
            yield pd.Series(list(found), dtype=object)

    return hits(text)


def contaminated(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """One row per document and test item that it holds: doc_id, item_id, score, start_word, end_word, n_items.

    The score is the alignment's points over those of a whole match, 1 for an
    exact copy; the words are those of the best place, counted from 0, the last
    one excluded. Test items with the same words are one, under their smallest
    id, a null one if they have no other, and ``n_items`` says how many rows they
    are. At least ``LEAST_WORDS`` words must match; an item of fewer words, such
    as ``is true``, is in a document that has its words and no others. Items
    without words are in no document. Null and empty texts hold nothing; repeated rows and null keys
    stay; other columns are ignored; empty tables give an empty result.
    """
    items = _load(benchmark, item_key, item_text)
    kind = docs.schema[key].dataType.simpleString()
    out = docs.sparkSession.createDataFrame([], f"doc_id {kind}, item long, score double, start_word int, end_word int")
    for own in _passes(docs, items, text, threshold):
        each = docs.select(F.col(key).alias("doc_id"), hits_column(own, F.col(text), threshold, docs.sparkSession).alias("hits"))
        out = out.unionByName(each.select("doc_id", F.explode("hits").alias("hit")).select("doc_id", "hit.*"))
    return out.join(items.select("item", "item_id", "n_items"), "item").select("doc_id", "item_id", "score", "start_word", "end_word", "n_items")


def keep_clean(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """The documents that hold no test item, all columns."""
    out = docs
    for own in _passes(docs, _load(benchmark, item_key, item_text), text, threshold):
        out = out.where(F.size(hits_column(own, F.col(text), threshold, docs.sparkSession)) == 0)
    return out.select(*docs.columns)
