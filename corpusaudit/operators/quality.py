"""Duplicates and measurable quality of files."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - pa.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusaudit.functions.once import with_once
from corpusaudit.functions.text import lines
from corpusaudit.operators.grouping import file_key
from corpusaudit.operators.lists import Fits, list_components
from corpusaudit.operators.sketches import alike, maybe_near, sketches_of
from corpusaudit.session import stored

BRANCH_WORDS = r"\b(if|for|while|case|catch|except|elif)\b"
COMMENT_LINE = r"^ *(#|//|[*]|--)"
ERROR_WORDS = r"\b(try|catch|except|rescue)\b"


def _hashed(files: DataFrame) -> DataFrame:
    return files.select(*file_key(files), F.sha2("content", 256).alias("content_hash"))


def duplicate_code(files: DataFrame) -> DataFrame:
    """Groups of files with the same text: hash, copies, first file by repository and path.

    Counted with partial aggregation; no group is gathered in one place.
    """
    key = file_key(files)
    first = [F.col(f"first.{c}").alias(f"first_{c.removeprefix('file_')}") for c in key]
    return (
        _hashed(files).groupBy("content_hash")
        .agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct(*key)).alias("first"))
        .filter(F.col("copies") > 1)
        .select("content_hash", "copies", *first)
    )


def duplicate_files(files: DataFrame) -> DataFrame:
    """Every file that shares its text with another, with its group."""
    return _hashed(files).join(duplicate_code(files), "content_hash")


# -- near copies -----------------------------------------------------------------
#: Words of a shingle, and least share of equal shingles.
SHINGLE, SIMILAR = 5, 0.8
#: Shingles that a task counts together, how often one must occur in all, and how many of the most frequent order the others.
CHUNK, OFTEN, MOST_FREQUENT = 1 << 20, 4, 1 << 17
#: Texts in a list whose pairs are formed where the list is read.
SHORT = 24
#: Texts in pairs whose numbers travel whole to the others, and bits that mark more of them.
TRAVEL_TEXTS, MARKS = 1 << 20, 1 << 24
#: Texts that are read together, and texts that a task remembers.
TOGETHER, REMEMBERED = 512, 1 << 17


def near_copies(files: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """Each file that is a near copy of another, with the id of its group: the first file of it.

    Two files are near copies if the sets of their five-word shingles have at
    least ``similar`` of their union in common, and so on from file to file.
    Equal texts are one. Files without words have no near copies.

    The join is exact. Shingles have one order everywhere, from rare to frequent.
    Two near sets meet in their first shingles, a fifth of each at 0.8, so only
    those are indexed; and they meet by places from which enough equal shingles
    can still follow. A header that many files share comes last in the order and
    is in no list. A short list gives its pairs, a long one is compared with its
    leaders (``list_components``). Pairs whose sketches are too far apart are
    dropped, the others are compared in full.

    Neither texts nor sets are kept: sets are made from the texts each time, and
    what moves are sketches, the indexed shingles, and the sets of compared pairs.
    """
    key = file_key(files)
    rows = files.select(F.struct(*key).alias("file"), F.xxhash64(F.sha2("content", 256)).alias("text"), "content")
    names, texts = stored(rows.select("file", "text"), "near-files"), rows.select("text", "content")
    sets = shingle_sets(texts)
    sketches = stored(sketches_of(sets), "near-sketches")
    met = near_lists(sets, similar, SHORT)

    def near(pairs: DataFrame) -> DataFrame:
        pairs = stored(maybe_near(pairs, sketches, similar), "near-pairs")
        return _compared(pairs, stored(_paired_sets(texts, pairs), "near-sets"), similar)

    links = near(met.where("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b")))
    lists, facts = met.where("other IS NULL").drop("other"), sketches.select(F.col("text").alias("node"), "sketch")
    groups = list_components(lists, _fits(similar), near, links, facts=facts, alike=lambda one, other: alike(one, other, similar))
    rooted = names.join(groups, names["text"] == groups["node"], "left").select("file", F.coalesce("root", "text").alias("root"))
    sizes = rooted.groupBy("root").agg(F.min("file").alias("first"), F.count("*").alias("files")).where("files > 1")
    return rooted.join(sizes, "root").select("file.*", *[F.col(f"first.{c}").alias(f"first_{c.removeprefix('file_')}") for c in key], "files")


def shingle_sets(texts: DataFrame) -> DataFrame:
    """(text, shingles) of (text, content): texts without words are left out, equal texts that a task reads are mostly one."""
    return texts.mapInArrow(_shingled, "text long, shingles array<long>").where("size(shingles) > 0")


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _runs(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words."""
    n = max(0, len(words) - size + 1)
    h = np.full(n, size, np.uint64)
    for i in range(size):
        h = _mixed(h) + words[i : n + i]
    return _mixed(h * np.uint64(0x94D049BB133111EB))


def _shingled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted shingle hashes of each text; fewer words than a shingle has are one."""
    seen = set()
    for batch in batches:
        for start in range(0, batch.num_rows, TOGETHER):
            texts, words = [], []
            for text, content in zip(batch.column("text")[start : start + TOGETHER].to_pylist(), batch.column("content")[start : start + TOGETHER]):
                if text not in seen:
                    texts.append(text)
                    words.append(np.fromiter(map(xxhash.xxh64_intdigest, (content.as_py() or "").split()), np.uint64))
                    seen.add(text)
            if len(seen) >= REMEMBERED:
                seen.clear()
            if not texts:
                continue
            runs, shingles, end = _runs(np.concatenate(words), SHINGLE), [], 0
            for own in words:
                end += len(own)
                if len(own) >= SHINGLE:
                    shingles.append(np.unique(runs[end - len(own) : end - SHINGLE + 1]).view(np.int64))
                else:
                    shingles.append(_runs(own, len(own)).view(np.int64) if len(own) else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.int64()), pa.array(shingles, pa.list_(pa.int64()))], names=["text", "shingles"])


def frequent_shingles(sets: DataFrame) -> dict[int, int]:
    """The most frequent shingles and how often they were counted, ``MOST_FREQUENT`` at most.

    They decide the order of shingles, and so how much is compared, never what is
    found. One that never occurs twice in what a task counts together isn't
    frequent; others are summed over all tasks, so one that is spread thinly is.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def counted() -> pa.RecordBatch:
            shingle, times = np.unique(np.concatenate(held) if held else np.zeros(0, np.int64), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(shingle[times > 1]), pa.array(times[times > 1])], names=["shingle", "n"])

        for batch in batches:
            held.append(batch.column(0).flatten().to_numpy())
            n += len(held[-1])
            if n >= CHUNK:
                yield counted()
                held, n = [], 0
        yield counted()

    counts = sets.select("shingles").mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= OFTEN)
    return {r["shingle"]: r["n"] for r in counts.orderBy(F.desc("n"), "shingle").limit(MOST_FREQUENT).collect()}


_MET = "list long, node long, n int, place int, other long"
_NAMES = ["list", "node", "n", "place"]


def near_lists(sets: DataFrame, similar: float = SIMILAR, short: int = 1) -> DataFrame:
    """(list, node, n, place, other): what meets in the inverted lists of the sets' first shingles.

    Lists of up to ``short`` texts give pairs of texts that fit, as node and
    other. Longer ones give their entries, without other. A list of one text
    gives nothing. ``sets`` has text and shingles; a repeated text counts once.
    Entries move once: those of a frequent shingle by text, as its list may be
    long and needn't be in one place, the others by shingle.
    """
    frequent = frequent_shingles(sets)
    shingle = np.array(sorted(frequent), np.int64)
    sent = sets.sparkSession.sparkContext.broadcast((shingle, np.array([frequent[int(s)] for s in shingle], np.int64)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, times = sent.value
        for batch in batches:
            column = batch.column("shingles")
            for start in range(0, batch.num_rows, TOGETHER):
                part = column.slice(start, TOGETHER)
                size = pa.compute.list_value_length(part).to_numpy()
                flat, row = part.flatten().to_numpy(), np.repeat(np.arange(len(size)), size)
                n = np.zeros(len(flat), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
                    n = np.where(known[at] == flat, times[at], 0)
                order = np.lexsort((flat, n, row))
                place = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
                first = place <= (size - np.ceil(similar * size - 1e-9))[row]
                node = batch.column("text").slice(start, TOGETHER).to_numpy()
                columns = [flat[order][first], node[row][first], size[row][first].astype(np.int32), place[first].astype(np.int32), n[order][first] > 0]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[*_NAMES, "often"])

    entries = sets.mapInArrow(run, "list long, node long, n int, place int, often boolean")
    dealt = entries.repartition(F.when(F.col("often"), F.col("node")).otherwise(F.col("list"))).sortWithinPartitions("list", "node")
    return stored(dealt.mapInArrow(lambda batches: _scanned(batches, similar, short), _MET).distinct(), "near-lists")


def _scanned(batches: Iterable[pa.RecordBatch], similar: float, short: int) -> Iterator[pa.RecordBatch]:
    """What meets, of entries by list and node. The last list of a batch waits for the next batch, unless it is long already."""
    held, long = None, None
    for batch in batches:
        rows = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in (*_NAMES, "often")}
        direct = rows["often"] if long is None else rows["often"] | (rows["list"] == long)
        yield _entry_rows(rows, direct)
        rows = {c: x[~direct] for c, x in rows.items()}
        if held is not None:
            rows = {c: np.concatenate([held[c], x]) for c, x in rows.items()}
        if not len(rows["list"]):
            continue
        once = np.concatenate([[True], (rows["list"][1:] != rows["list"][:-1]) | (rows["node"][1:] != rows["node"][:-1])])
        rows = {c: x[once] for c, x in rows.items()}
        start = int(np.flatnonzero(rows["list"] == rows["list"][-1])[0])
        yield from _lists_met({c: x[:start] for c, x in rows.items()}, similar, short)
        held = {c: x[start:] for c, x in rows.items()}
        if len(held["list"]) > short:
            long = held["list"][0]
            yield from _lists_met(held, similar, short)
            held = None
    if held is not None:
        yield from _lists_met(held, similar, short)


def _lists_met(rows: dict[str, np.ndarray], similar: float, short: int) -> Iterator[pa.RecordBatch]:
    """The entries of whole lists that are long, and the pairs of short ones that fit, each pair once for these rows."""
    first = np.concatenate([[True], rows["list"][1:] != rows["list"][:-1]])[: len(rows["list"])]
    size = np.diff(np.append(np.flatnonzero(first), len(first)))[np.cumsum(first) - 1]
    yield _entry_rows(rows, size > max(short, 1))
    rows, found = {c: x[(size > 1) & (size <= short)] for c, x in rows.items()}, []
    for step in range(1, short):
        i = np.flatnonzero(rows["list"][step:] == rows["list"][:-step])
        if not len(i):
            break
        fit = _reach(*(rows[c][at] for c in ("n", "place") for at in (i, i + step)), similar, np.minimum, np.maximum)
        found.append(np.stack([rows["node"][i[fit]], rows["node"][i[fit] + step]], 1))
    pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
    none = [pa.nulls(len(pairs), kind) for kind in (pa.int64(), pa.int32(), pa.int32())]
    yield pa.RecordBatch.from_arrays([none[0], pa.array(pairs[:, 0]), none[1], none[2], pa.array(pairs[:, 1])], names=[*_NAMES, "other"])


def _entry_rows(rows: dict[str, np.ndarray], keep: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array(rows[c][keep]) for c in _NAMES]
    return pa.RecordBatch.from_arrays([*columns, pa.nulls(len(columns[0]), pa.int64())], names=[*_NAMES, "other"])


def _reach(n, other_n, place, other_place, similar: float, least, greatest):
    """Sizes are near enough, and enough equal shingles can follow from the places where two sets meet; for arrays or columns."""
    low, high, after = least(n, other_n), greatest(n, other_n), least(n - place, other_n - other_place)
    return (low >= similar * high - 1e-9) & ((1 + similar) * after >= similar * (low + high) - 1e-9)


def _fits(similar: float) -> Fits:
    return lambda one, other: _reach(one("n"), other("n"), one("place"), other("place"), similar, F.least, F.greatest)


def _paired_sets(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """(text, shingles) of the texts that are in a pair, each once.

    Only those texts are read as words: a few numbers go to the texts, more of
    them as marks, which a few other texts may fit too.
    """
    paired = pairs.select(F.explode(F.array("a", "b")).alias("text")).distinct()
    if paired.count() <= TRAVEL_TEXTS:
        sets = shingle_sets(texts.join(F.broadcast(paired), "text", "left_semi"))
    else:
        sets = shingle_sets(_marked(texts, paired)).join(paired, "text", "left_semi")
    return sets.dropDuplicates(["text"])


def _marked(texts: DataFrame, paired: DataFrame) -> DataFrame:
    """The texts whose bit of ``MARKS`` is set by one of ``paired``, and so all of them; a 32nd as many numbers are collected at most."""
    slot = F.col("text").bitwiseAND(MARKS - 1)
    bit = F.pow(F.lit(2.0), slot % 32).cast("long")
    marks = np.zeros(MARKS // 32, np.uint32)
    for row in paired.groupBy(F.shiftright(slot, 5).alias("word")).agg(F.bit_or(bit).alias("bits")).collect():
        marks[row["word"]] = row["bits"]
    sent = texts.sparkSession.sparkContext.broadcast(marks)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = batch.column("text").to_numpy() & (MARKS - 1)
            yield batch.filter(pa.array((sent.value[slot >> 5] >> (slot & 31).astype(np.uint32) & np.uint32(1)).astype(bool)))

    return texts.mapInArrow(run, texts.schema)


def _compared(pairs: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets have enough in common. Only the sets of texts that are in a pair move, unless those are many."""
    paired = pairs.select(F.explode(F.array("a", "b")).alias("text")).distinct()
    sets = sets.join(F.broadcast(paired) if paired.count() <= TRAVEL_TEXTS else paired, "text", "left_semi")
    one, other = (sets.select(F.col("text").alias(side), F.col("shingles").alias(f"{side}_set")) for side in ("a", "b"))
    both = F.size(F.array_intersect("a_set", "b_set"))
    return pairs.join(one, "a").join(other, "b").where(both >= similar * (F.size("a_set") + F.size("b_set") - both)).select("a", "b")


def quality_metrics(files: DataFrame) -> DataFrame:
    """Line counts, branch words, comment share, error handling and a 0-100 score.

    Our own score: 20 points off for lines above 120 characters, for more than
    one branch per four lines, for no error handling, and for under 5% comments.
    """
    all_lines = lines(F.col("content"))
    numbers = F.struct(
        F.size(all_lines).cast("bigint").alias("n_lines"),
        F.array_max(F.transform(all_lines, F.length)).cast("bigint").alias("max_line"),
        F.regexp_count("content", F.lit(BRANCH_WORDS)).cast("bigint").alias("branches"),
        F.regexp_count("content", F.lit("(?dm)" + COMMENT_LINE)).cast("bigint").alias("comment_lines"),
        F.col("content").rlike(ERROR_WORDS).alias("handles_errors"),
    )
    keys = [c for c in files.columns if c != "content"]
    measured = with_once(files, "m", numbers).select(*keys, "m.*")
    comment_ratio = F.round(F.col("comment_lines") / F.col("n_lines"), 4)
    lost = (
        (F.col("max_line") > 120).cast("int")
        + (F.col("branches") * 4 > F.col("n_lines")).cast("int")
        + (~F.col("handles_errors")).cast("int")
        + (F.col("comment_ratio") < 0.05).cast("int")
    )
    return measured.withColumn("comment_ratio", comment_ratio).withColumn("quality_score", (100 - 20 * lost).cast("bigint"))


def refactor_suggestions(files: DataFrame) -> DataFrame:
    """One row per file and metric that is out of bounds."""
    m = quality_metrics(files)

    def advice(condition, category: str, priority: str):
        return F.when(condition, F.struct(F.lit(category).alias("category"), F.lit(priority).alias("priority")))

    found = F.array_compact(
        F.array(
            advice(F.col("branches") * 4 > F.col("n_lines"), "complexity", "high"),
            advice(~F.col("handles_errors"), "error handling", "medium"),
            advice(F.col("max_line") > 120, "long lines", "low"),
            advice(F.col("comment_ratio") < 0.05, "documentation", "low"),
        )
    )
    return m.select(*file_key(files), F.explode(found).alias("s")).select(*file_key(files), "s.*")
