"""Text expressions.

White space is the set Python's ``str.strip`` and ``str.split`` use, given as
explicit characters so that Java regular expressions agree with it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusaudit.functions.once import let
from corpusaudit.session import stored

# Characters Python treats as white space.
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0"
    "\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
FENCE = "```"

# Language tags that may follow an opening fence.
FIRST_BLOCK_TAGS = ["python", "java", "javascript", "typescript", "cpp", "c", "go", "js", "ts", "py"]
LARGEST_BLOCK_TAGS = ["python", "java", "javascript", "typescript", "pytest", "py", "js", "ts", "go", "ruby", "rb"]
# Beginnings that mark a reply without fences as code.
CODE_STARTS = ["import ", "from ", "def ", "class ", "async def ", "@pytest", "@test"]
# Signs that a reply was not cut off.
CLOSING_CHARS = [")", "}", "]", '"', "'"]
CLOSING_MARKERS = ["if __name__", "main()", "return"]
CUT_MARK = "\n\n# ... (truncated)"
REDACTED = "[REDACTED]"


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(SPACES))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(SPACES))


def words(c: Column) -> Column:
    """Words as Python's ``split()`` gives them.

    Translating to plain spaces first is faster than splitting by a character class.
    """
    return F.array_remove(F.split(F.translate(c, SPACES, " " * len(SPACES)), " "), "")


def lines(c: Column) -> Column:
    return F.split(c, "\n")


def any_of(c: Column, needles: Sequence[str]) -> Column:
    """True if the text holds at least one of the needles."""
    hit = F.lit(False)
    for needle in needles:
        hit = hit | c.contains(needle)
    return hit


def starts_with_any(c: Column, heads: Sequence[str]) -> Column:
    hit = F.lit(False)
    for head in heads:
        hit = hit | c.startswith(head)
    return hit


def count_of(c: Column, needle: str) -> Column:
    """Number of non-overlapping occurrences of a plain string."""
    return F.regexp_count(c, F.lit("\\Q" + needle + "\\E"))


# -- heads of texts ---------------------------------------------------------
def head(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def snippet(c: Column, n: int = 200) -> Column:
    """The first n characters, with dots only if something was left out."""
    return F.when(F.length(c) > n, F.concat(head(c, n), F.lit("..."))).otherwise(c)


def preview(c: Column, n: int) -> Column:
    """The first n characters, always with dots."""
    return F.concat(head(c, n), F.lit("..."))


def clip_marked(c: Column, n: int = 8000, mark: str = CUT_MARK) -> Column:
    return F.when(F.length(c) > n, F.concat(head(c, n), F.lit(mark))).otherwise(c)


def adaptive_head(c: Column) -> Column:
    """4000 characters of a text above 6000, else the whole of it."""
    return F.when(F.length(c) > 6000, head(c, 4000)).otherwise(c)


def batch_head(c: Column, batch_size: Column) -> Column:
    """2000 characters in a batch of more than two files, else 3000."""
    return F.when(batch_size > 2, head(c, 2000)).otherwise(head(c, 3000))


def truncate_words(c: Column, limit: int = 250) -> Column:
    """The first words joined by one space; a text within the limit is unchanged."""
    return let(words(c), lambda w: F.when(F.size(w) > limit, F.array_join(F.slice(w, 1, limit), " ")).otherwise(c))


# -- fenced blocks ----------------------------------------------------------
def _without_tag(block: Column, tags: Sequence[str], fold: bool) -> Column:
    first = F.substring_index(block, "\n", 1)
    tag = strip(first)
    tag = F.lower(tag) if fold else tag
    rest = F.substr(block, F.length(first) + 2)
    return strip(F.when(tag.isin(*tags), rest).otherwise(block))


def first_code_block(c: Column) -> Column:
    """Text of the first fenced block; of one lone fence, the text before it."""
    parts = F.split(c, FENCE)
    return F.coalesce(
        F.when(F.size(parts) >= 3, _without_tag(parts[1], FIRST_BLOCK_TAGS, fold=False))
        .when(F.size(parts) == 2, strip(parts[0]))
        .otherwise(strip(c)),
        F.lit(""),
    )


def largest_code_block(c: Column, min_length: int = 50) -> Column:
    """Longest fenced block above ``min_length``, the first of equals.

    Without one, the text itself if it begins like code, else an empty string.
    """
    fenced = F.filter(F.split(c, FENCE), lambda p, i: i % 2 == 1)
    blocks = F.transform(fenced, lambda p: _without_tag(p, LARGEST_BLOCK_TAGS, fold=True))
    ranked = F.transform(
        F.filter(blocks, lambda b: F.length(b) > min_length),
        lambda b, i: F.struct(F.length(b).alias("n"), (-i).alias("o"), b.alias("block")),
    )
    plain = strip(c)
    return F.coalesce(
        F.array_max(ranked)["block"],
        F.when(starts_with_any(plain, CODE_STARTS), plain),
        F.lit(""),
    )


def looks_truncated(c: Column) -> Column:
    """A long reply that neither ends with a closing character nor shows an end marker."""
    all_lines = lines(c)
    tail = F.array_join(F.slice(all_lines, F.greatest(F.size(all_lines) - 4, F.lit(1)), 5), "\n")
    return (
        (F.length(c) > 1000)
        & ~F.right(rstrip(c), F.lit(1)).isin(*CLOSING_CHARS)
        & ~any_of(tail, CLOSING_MARKERS)
    )


# -- secrets and severities -------------------------------------------------
#: Forms of secrets that are known without their value.
SECRET_FORMS = [
    r"AKIA[0-9A-Z]{16}",
    r"gh[pousr]_[0-9A-Za-z]{20,}",
    r"sk-[0-9A-Za-z_-]{20,}",
    r"xox[baprs]-[0-9A-Za-z-]{10,}",
    r"eyJ[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}",
    r"(?i:bearer|token|api[_-]?key|secret|password)[\"']?\s*[:=]\s*[\"']?[0-9A-Za-z_./+=-]{16,}",
]


def redact(c: Column, secrets: Sequence[str] = (), forms: Sequence[str] = ()) -> Column:
    """Replace every known secret longer than five characters, in the order given, then whatever has one of the forms."""
    for secret in secrets:
        if len(secret) > 5:
            c = F.replace(c, F.lit(secret), F.lit(REDACTED))
    for form in forms:
        c = F.regexp_replace(c, form, REDACTED)
    return c


#: Least length of a known secret; bits of the filter for each secret, and at most; characters that a task hashes together.
SHORTEST, FILTER_BITS, MOST_BITS, CHARS = 6, 64, 1 << 27, 1 << 19


def redact_all(df: DataFrame, column: str, secrets: DataFrame, block: int = 100_000) -> DataFrame:
    """Replace the known secrets of a table (column secret) of any size; those of up to five characters stay.

    One reading of the texts, however many secrets there are, marks the places
    whose characters a filter knows; the pieces there are then looked up among
    the secrets by a join, so that only secrets are replaced. The filter has room
    for whole blocks of ``block`` secrets, up to ``MOST_BITS``; a fuller one
    lets more pieces be looked up and changes no result. Marked stretches that
    overlap are one, and each is replaced once at the end, so no part of a secret
    stays, whichever others begin in it. Null texts stay null.
    """
    usable = stored(secrets.where(F.length("secret") >= SHORTEST).select("secret").distinct(), "secrets")
    n = usable.count()
    if not n:
        return df
    lengths = sorted(r["n"] for r in usable.select(F.length("secret").alias("n")).distinct().collect())
    steps = _steps(lengths)
    size = min(-(-n // block) * min(block, n) * FILTER_BITS, MOST_BITS)
    words = np.zeros(-(-size // 64), np.int64)
    slots = usable.mapInArrow(_slots(steps, size), "slot long").groupBy(F.expr("slot div 64").alias("word"))
    found = slots.agg(F.expr("bit_or(shiftleft(1L, cast(slot % 64 AS int)))").alias("bits")).toArrow()
    words[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    sent = df.sparkSession.sparkContext.broadcast(words.view(np.uint64))

    places, row, spans = _unused(df, "places"), _unused(df, "row"), _unused(df, "spans")
    numbered = df.withColumn(row, F.monotonically_increasing_id())
    schema = T.StructType([*numbered.schema.fields, T.StructField(places, T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("secret", T.StringType())])))])
    marked = stored(numbered.mapInArrow(_marker(column, places, steps, size, sent), schema), "redacted")
    some = marked.where(F.size(places) > 0)
    sure = some.select(row, F.explode(places).alias("p")).select(row, "p.*").join(usable, "secret", "left_semi")
    stretch = F.struct("start", (F.col("start") + F.length("secret")).alias("stop"))
    cut = some.drop(places).join(sure.groupBy(row).agg(F.collect_list(stretch).alias(spans)), row, "left").drop(row)
    return marked.where(F.size(places) == 0).select(*df.columns).unionByName(cut.mapInArrow(_cutter(column, spans), df.schema))


def _unused(df: DataFrame, name: str) -> str:
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def joined_spans(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Stretches that overlap as one, in order; those that only touch stay apart. Any grouping of the input gives the same."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _steps(lengths: list[int]) -> list[tuple[int, bool]]:
    """(length, whole) in the order of a search: beginnings of 6, 12, 24... characters narrow the places, whole secrets are hits."""
    begin, steps = SHORTEST, [(x, True) for x in lengths]
    while begin <= lengths[-1]:
        steps.append((begin, False))
        begin *= 2
    return sorted(steps)


class _Hashed:
    """Hashes of any stretch of joined texts, from sums over their characters; where a stretch lies doesn't matter."""

    #: Odd factors, the first with its inverse modulo 2**64.
    FACTOR = 0x9E3779B97F4A7C15
    BACK = pow(FACTOR, -1, 1 << 64)
    MIX = np.uint64(0xFF51AFD7ED558CCD)

    powers = backs = np.ones(1, np.uint64)

    def __init__(self, texts: Sequence[str]):
        self.joined = "".join(texts)
        codes = np.frombuffer(self.joined.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
        self.sizes = np.array([len(x) for x in texts], np.int64)
        ends = np.cumsum(self.sizes)
        self.starts = ends - self.sizes
        self.ends = np.repeat(ends, self.sizes)
        if len(_Hashed.powers) < len(codes):
            for name, factor in (("powers", self.FACTOR), ("backs", self.BACK)):
                each = np.full(max(len(codes), 2 * CHARS), factor, np.uint64)
                each[0] = 1
                setattr(_Hashed, name, np.cumprod(each))
        self.sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes * _Hashed.powers[: len(codes)], out=self.sums[1:])

    def room(self, at: np.ndarray, length: int) -> np.ndarray:
        """The places with so many characters left in their text."""
        return at[at + length <= self.ends[at]]

    def slots(self, at: np.ndarray, length: int, whole: bool, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The two bits of the stretches of one length that begin at these places."""
        h = (self.sums[at + length] - self.sums[at]) * _Hashed.backs[at] + np.uint64(2 * length + whole)
        for _ in range(2):
            h ^= h >> np.uint64(33)
            h *= self.MIX
        h ^= h >> np.uint64(33)
        low, bits = np.uint64(32), np.uint64(size)
        return ((h >> low) * bits) >> low, ((h & np.uint64(0xFFFFFFFF)) * bits) >> low


def _slots(steps: list[tuple[int, bool]], size: int):
    """The bits of the filter that the secrets set."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in _slices(batch.column("secret")):
                hashed = _Hashed(texts)
                bits = []
                for length, whole in steps:
                    own = hashed.starts[hashed.sizes == length if whole else hashed.sizes >= length]
                    bits += hashed.slots(own, length, whole, size)
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(bits)).view(np.int64))], names=["slot"])

    return run


def _slices(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Texts in turn, with the number of the first, as many together as have about ``CHARS`` characters; nulls as empty ones."""
    first, held, n = 0, [], 0
    for x in texts:
        held.append(x.as_py() or "")
        n += len(held[-1])
        if n >= CHARS:
            yield first, held
            first, held, n = first + len(held), [], 0
    if held:
        yield first, held


def _marker(column: str, places: str, steps: list[tuple[int, bool]], size: int, sent):
    """Adds the places of each text that the filter knows, with the pieces there."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = sent.value

        def known(slot: np.ndarray) -> np.ndarray:
            return (words[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) == 1

        def hits(hashed: _Hashed, at: np.ndarray, length: int, whole: bool) -> np.ndarray:
            one, other = hashed.slots(at, length, whole, size)
            seen = np.flatnonzero(known(one))
            return at[seen[known(other[seen])]]

        kind = pa.list_(pa.struct([("start", pa.int32()), ("secret", pa.string())]))
        for batch in batches:
            for first, texts in _slices(batch.column(column)):
                hashed = _Hashed(texts)
                at, marks = np.arange(len(hashed.joined)), [[] for _ in texts]
                for length, whole in steps:
                    if not len(at):
                        break
                    near = hits(hashed, hashed.room(at, length), length, whole)
                    if not whole:
                        at = near
                        continue
                    owner = np.searchsorted(hashed.starts, near, side="right") - 1
                    for i, a, b in zip(owner.tolist(), near.tolist(), (near - hashed.starts[owner]).tolist()):
                        marks[i].append({"start": b, "secret": hashed.joined[a : a + length]})
                part = batch.slice(first, len(texts))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(marks, kind)], names=[*part.schema.names, places])

    return run


def _cutter(column: str, spans: str):
    def cut(value: str, marked: list[dict] | None) -> str:
        if not marked:
            return value
        edges = [0, *(x for span in joined_spans((m["start"], m["stop"]) for m in marked) for x in span), len(value)]
        return REDACTED.join(value[a:b] for a, b in zip(edges[::2], edges[1::2]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [cut(x.as_py(), marked.as_py()) for x, marked in zip(batch.column(column), batch.column(spans))]
            names = [c for c in batch.schema.names if c != spans]
            columns = [pa.array(texts, batch.column(c).type) if c == column else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def extract_severity(c: Column) -> Column:
    """First severity word found as a substring, most severe first."""
    t = F.lower(c)
    return (
        F.when(t.contains("critical"), "critical")
        .when(t.contains("high"), "high")
        .when(t.contains("medium") | t.contains("moderate"), "medium")
        .when(t.contains("low"), "low")
        .otherwise("unknown")
    )
