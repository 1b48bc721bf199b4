"""Spelling variants: words one edit apart, found through a trie of letter-group counts.

Letters are dealt to ``GROUPS`` groups of about equal weight, and a word is the
vector of how many of its letters are in each. One inserted, deleted or replaced
letter raises one count by one at most (the surplus) and lowers one by one at
most (the deficit). The vectors, arranged by successive counts, are a trie: a
depth-first search goes down with all words that still have their budget of one
each, and at a leaf the words themselves are compared letter by letter.

The trie is cut below its first levels, length and the first counts, into units
that are searched apart; as many levels are taken as make units small, and what
is still large is sliced. A word goes to its own unit and to those that its
budget reaches; of two words only one is sent to the other, so every pair meets
once. A task holds one slice and a batch of the words that search it.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusaudit.llm.common import partitions, stored

#: Code points and occurrences that a word needs, and how many times as frequent a form is as its variant.
LEAST_LETTERS, LEAST_TIMES, MORE = 7, 2, 10
#: One of so many pairs of document and word is read with a letter missing.
DROPPED = 31
#: Counts in a vector, bits of each, and words of a unit that one task holds.
GROUPS, BITS, SLICE = 10, 6, 1 << 13
#: Words that are counted before they leave a task, words of a trie node that are compared at once, and cells of comparisons.
_HELD, _LEAF, _CELLS = 200_000, 16, 1 << 21
_MOST = (1 << BITS) - 1
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_PLACED = "length int, top long, slice int"


def runs_of(text: str | None, least: int = LEAST_LETTERS) -> list[str]:
    """Maximal runs of ``least`` letters or more, A to Z in lower case."""
    folded = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).decode("utf-8", "surrogatepass")
    return re.findall(f"[a-zÀ-ÿ]{{{least},}}", folded)


def read_word(key: object, run: str, dropped: int = DROPPED) -> str:
    """The run, without the letter that this document's reading drops."""
    h = zlib.crc32(run.encode(), zlib.crc32(f"{'null' if key is None else key}:".encode()))
    if h % dropped:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def vocabulary(
    docs: DataFrame, key: str = "doc_id", text: str = "text", least_letters: int = LEAST_LETTERS, least_times: int = LEAST_TIMES, dropped: int = DROPPED
) -> DataFrame:
    """(word, n): the different words of all documents, and how often each occurs."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for batch in batches:
            for own, x in zip(batch.column("id"), batch.column("text")):
                own = own.as_py()
                for found, times in Counter(runs_of(x.as_py(), least_letters)).items():
                    word = read_word(own, found, dropped)
                    if len(word) >= least_letters:
                        held[word] += times
                if len(held) >= _HELD:
                    yield _counted(held)
                    held = Counter()
        yield _counted(held)

    counted = docs.select(F.col(key).cast("string").alias("id"), F.col(text).alias("text")).mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_times)


def _counted(held: Counter[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])


# -- vectors -------------------------------------------------------------------
def letter_groups(words: DataFrame, groups: int = GROUPS) -> dict[int, int]:
    """A group for every code point of the words, the groups about equally heavy; one row per different letter is collected.

    Any choice finds the same pairs; a balanced one discards more of the others.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        for batch in batches:
            total.update("".join(batch.column(0).to_pylist()))
        yield pa.RecordBatch.from_arrays([pa.array([ord(c) for c in total], pa.int64()), pa.array(list(total.values()), pa.int64())], names=["letter", "n"])

    counts = words.select("word").mapInArrow(run, "letter long, n long").groupBy("letter").agg(F.sum("n").alias("n")).collect()
    weight, out = [0] * groups, {}
    for row in sorted(counts, key=lambda r: (-r["n"], r["letter"])):
        out[row["letter"]] = lightest = weight.index(min(weight))
        weight[lightest] += row["n"]
    return out


def _vectors(words: list[str], group_of: np.ndarray, groups: int) -> np.ndarray:
    """The words' vectors as one number each, the first group in the highest bits; larger counts are cut to the largest that fits."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    row = np.repeat(np.arange(len(words)), [len(w) for w in words])
    counts = np.bincount(row * groups + group_of[points], minlength=len(words) * groups).reshape(len(words), groups)
    shift = BITS * np.arange(groups)[::-1]
    return (np.minimum(counts, _MOST).astype(np.int64) << shift).sum(1) if len(words) else np.zeros(0, np.int64)


def with_vectors(words: DataFrame, group_of: dict[int, int], groups: int = GROUPS) -> DataFrame:
    """(word, n, length, vector)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(max(group_of, default=0) + 1, np.int64)
        table[list(group_of)] = list(group_of.values())
        for batch in batches:
            own = batch.column("word").to_pylist()
            columns = [batch.column("word"), batch.column("n"), pa.array([len(w) for w in own], pa.int32()), pa.array(_vectors(own, table, groups))]
            yield pa.RecordBatch.from_arrays(columns, names=["word", "n", "length", "vector"])

    return words.select("word", "n").mapInArrow(run, "word string, n long, length int, vector long")


# -- units of the trie -----------------------------------------------------------
def _top(levels: int, groups: int) -> Column:
    return F.shiftright("vector", BITS * (groups - levels))


def _levels(words: DataFrame, groups: int) -> int:
    """How many first counts make units of at most ``SLICE`` words, or all of them."""
    for levels in range(1, groups):
        largest = words.groupBy("length", _top(levels, groups)).count().agg(F.max("count")).first()[0] or 0
        if largest <= SLICE:
            break
    return levels


def _reached(levels: int) -> Column:
    """The units that hold words one edit away: (length, top, role); roles are 1 for the own unit, 2 for others of its length, 3 for longer words.

    Of two words of one length only the one with the smaller top is sent; of two
    lengths, the shorter one. A count that is cut changes by one or not at all.
    """
    step = [1 << (BITS * i) for i in range(levels)]
    count = [F.shiftright("top", BITS * i).bitwiseAND(_MOST) for i in range(levels)]

    def unit(longer: int, change: int, *needs: Column) -> Column:
        role = 3 if longer else 2 if change else 1
        made = F.struct((F.col("length") + longer).alias("length"), (F.col("top") + change).alias("top"), F.lit(role).alias("role"))
        for need in needs:
            made = F.when(need, made)
        return made

    units = [unit(0, 0), unit(1, 0)]
    for i in range(levels):
        units += [unit(longer, step[i], count[i] < _MOST) for longer in (0, 1)]
        units += [unit(0, step[i] - step[j], count[i] < _MOST, count[j] > 0) for j in range(i)]  # the others are smaller
    return F.array_compact(F.array(*units))


def near_words(words: DataFrame, groups: int = GROUPS) -> DataFrame:
    """(word, near, near_n): every two words (word, n, each once) that differ in one inserted, deleted or replaced code point, both ways."""
    spark = words.sparkSession
    table = stored(with_vectors(words, letter_groups(words, groups), groups), "spelling-vectors")
    levels = _levels(table, groups)
    placed = table.select("word", "n", "length", _top(levels, groups).alias("top"), "vector")
    unit = ["length", "top"]
    large = placed.groupBy(*unit).count().where(F.col("count") > SLICE).select(*unit, F.ceil(F.col("count") / SLICE).cast("int").alias("slices"))
    slices = F.coalesce("slices", F.lit(1))
    leaves = placed.join(large, unit, "left").select(*unit, F.pmod(F.xxhash64("word"), slices).cast("int").alias("slice"), F.lit(0).alias("role"), "word", "n", "vector")
    sent = placed.select(F.explode(_reached(levels)).alias("to"), "word", "n", "vector").select("to.*", "word", "n", "vector")
    sent = sent.join(placed.select(*unit).distinct(), unit, "left_semi")  # units without words aren't searched
    searches = sent.join(large, unit, "left").select(*unit, F.explode(F.sequence(F.lit(0), slices - 1)).alias("slice"), "role", "word", "n", "vector")
    place = [*unit, "slice"]
    met = leaves.unionByName(searches).repartition(partitions(spark), *place).sortWithinPartitions(*place, "role")
    pairs = met.mapInArrow(lambda batches: _searched(batches, groups), "word string, n long, near string, near_n long")
    both = F.explode(F.array(F.struct("word", "near", "near_n"), F.struct(F.col("near").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n"))))
    return pairs.select(both.alias("p")).select("p.*")


def _searched(batches: Iterable[pa.RecordBatch], groups: int) -> Iterator[pa.RecordBatch]:
    """Rows by slice, its leaves before the words that search it; one slice is held at a time."""
    place, trie, leaves = None, None, []
    for batch in batches:
        where = np.stack([batch.column(c).to_numpy() for c in ("length", "top", "slice")], 1).astype(np.int64)
        role = batch.column("role").to_numpy()
        word, n, vector = batch.column("word").to_pylist(), batch.column("n").to_numpy(), batch.column("vector").to_numpy()
        new = np.flatnonzero((where[1:] != where[:-1]).any(1) | (role[1:] != role[:-1])) + 1
        for a, b in zip([0, *new.tolist()], [*new.tolist(), batch.num_rows]):
            if a == b:
                continue
            if (here := tuple(where[a])) != place:
                place, trie, leaves = here, None, []
            if role[a] == 0:
                leaves.append((word[a:b], n[a:b], vector[a:b]))
                continue
            if trie is None and leaves:
                trie = _Trie(*(np.concatenate([np.array(x[i], object if i == 0 else np.int64) for x in leaves]) for i in range(3)), groups)
                leaves = []
            if trie is not None:
                yield from trie.near(np.array(word[a:b], object), n[a:b], vector[a:b], role[a] == 1)


def _counts(vector: np.ndarray, groups: int) -> np.ndarray:
    return ((vector[:, None] >> (BITS * np.arange(groups)[::-1])) & _MOST).astype(np.int8)


class _Trie:
    """Words in the order of their vectors, so that a node is a stretch of them."""

    def __init__(self, word: np.ndarray, n: np.ndarray, vector: np.ndarray, groups: int):
        order = np.argsort(vector, kind="stable")
        self.word, self.n, self.groups = word[order], n[order], groups
        self.counts = _counts(vector[order], groups)

    def near(self, word: np.ndarray, n: np.ndarray, vector: np.ndarray, own: bool) -> Iterator[pa.RecordBatch]:
        """Pairs of the given words and words one edit away; of those in their own unit, the pairs in order."""
        asked = _counts(vector, self.groups)
        for q, w in self._reached(asked):
            q, w = _one_edit(word, self.word, q, w)
            if own and len(q):
                ordered = word[q] < self.word[w]
                q, w = q[ordered], w[ordered]
            if len(q):
                columns = [pa.array(word[q], pa.string()), pa.array(n[q]), pa.array(self.word[w], pa.string()), pa.array(self.n[w])]
                yield pa.RecordBatch.from_arrays(columns, names=["word", "n", "near", "near_n"])

    def _reached(self, asked: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Depth-first: (asking word, leaf word) numbers of all pairs within the budget, some at a time."""
        none = np.zeros(len(asked), np.int8)
        stack, found, held = [(0, len(self.word), 0, np.arange(len(asked)), none, none)], [], 0
        while stack:
            low, high, level, q, surplus, deficit = stack.pop()
            if level == self.groups or high - low <= _LEAF:
                rows, at = np.repeat(q, high - low), np.tile(np.arange(low, high), len(q))
                if level < self.groups:
                    change = self.counts[at, level:] - asked[rows, level:]
                    up = np.repeat(surplus, high - low) + np.maximum(change, 0).sum(1)
                    down = np.repeat(deficit, high - low) - np.minimum(change, 0).sum(1)
                    inside = (up <= 1) & (down <= 1)
                    rows, at = rows[inside], at[inside]
                found.append((rows, at))
                held += len(rows)
                if held >= 1 << 18:
                    yield tuple(np.concatenate(x) for x in zip(*found))
                    found, held = [], 0
                continue
            column = self.counts[low:high, level]
            edges = [low, *(low + 1 + np.flatnonzero(column[1:] != column[:-1])).tolist(), high]
            own = asked[q, level]
            for a, b in zip(edges, edges[1:]):
                change = self.counts[a, level] - own
                up, down = surplus + np.maximum(change, 0), deficit - np.minimum(change, 0)
                inside = np.flatnonzero((up <= 1) & (down <= 1))
                if len(inside):
                    stack.append((a, b, level + 1, q[inside], up[inside], down[inside]))
        if found:
            yield tuple(np.concatenate(x) for x in zip(*found))


def _points(words: np.ndarray, width: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), width)


def _one_edit(asking: np.ndarray, leaves: np.ndarray, q: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs one edit apart; all asking words have one length, all leaves that or one letter more."""
    if not len(q):
        return q, w
    short, width = len(asking[0]), len(leaves[0])
    size, kept = max(1, _CELLS // width), []
    for start in range(0, len(q), size):
        i, i_at = np.unique(q[start : start + size], return_inverse=True)
        j, j_at = np.unique(w[start : start + size], return_inverse=True)
        a, b = _points(asking[i], short)[i_at], _points(leaves[j], width)[j_at]
        if short == width:
            kept.append((a != b).sum(1) == 1)
            continue
        # Equal letters from the start and, moved by one, from the end must cover the shorter word.
        head = np.cumprod(a == b[:, :-1], axis=1, dtype=np.int8).sum(1, dtype=np.int64)
        tail = np.cumprod((a == b[:, 1:])[:, ::-1], axis=1, dtype=np.int8).sum(1, dtype=np.int64)
        kept.append(head + tail >= short)
    kept = np.concatenate(kept)
    return q[kept], w[kept]


# -- forms -----------------------------------------------------------------------
def grouped(words: DataFrame, near: DataFrame, more: int = MORE) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of words (word, n) and their near words.

    A form is at least ``more`` times as frequent as its word, so a chain of
    forms is as long as the digits of the largest count at most.
    """
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("form"))).alias("best"))
    joined = words.join(best, "word", "left")
    much = -F.col("best.n") >= more * F.col("n")
    table = stored(
        joined.select(
            "word", F.when(much, F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(much, -F.col("best.n")).alias("form_n")
        ),
        "spelling-forms",
    )
    roots = table.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stored(roots.join(further, "root", "left"), "spelling-roots")
        roots = moved.select("word", F.coalesce("next", "root").alias("root"))
        if moved.where("next IS NOT NULL").isEmpty():
            break
    return table.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(
    docs: DataFrame, key: str = "doc_id", text: str = "text", least_letters: int = LEAST_LETTERS, least_times: int = LEAST_TIMES, more: int = MORE,
    dropped: int = DROPPED, groups: int = GROUPS,
) -> DataFrame:
    """One row per word: word, form, root, n, n_near and form_n.

    Words are maximal runs of letters of the whole texts, A to Z in lower case;
    one of ``dropped`` pairs of document and run is read with a letter missing.
    Those of ``least_letters`` code points and ``least_times`` occurrences count.
    Near words differ by one code point inserted, deleted or replaced. The form
    is the most frequent near word (ties: the first by code points), if it occurs
    ``more`` times as often; the root is where forms lead. A null or empty text
    has no words; a null key is read as the word null; repeated rows count each;
    other columns are ignored; an empty table gives an empty result.
    """
    words = stored(vocabulary(docs, key, text, least_letters, least_times, dropped), "spelling-words")
    return grouped(words, near_words(words, groups), more)
