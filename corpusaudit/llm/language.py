"""Language identification by compression.

Each language is a zstandard dictionary of raw content: running text of its
documents, up to ``DICTIONARY`` bytes. A text is reduced to lower-case letters
and single spaces, cut into blocks, and every block of the whole text is encoded
with every dictionary (a short text in several rotations of its words); the
language with the smallest total wins. If the second
is nearly as small, the text is rejected. A model takes ``DICTIONARY`` bytes for
each language, whatever the number of documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusaudit.llm.common import crc_remainder, spread, unused

#: Bytes of a dictionary, and documents of a language that it is made of in expectation.
DICTIONARY, SAMPLE = 128 << 10, 200
LEVEL, BLOCK = 6, 4096
#: Bytes up to which a text is encoded in several rotations of its words: sizes are whole bytes, too coarse for a few words.
SHORT, ROTATIONS = 256, 16
#: Part of the second-best size that the best must save, or the text is rejected.
NARROW = 0.002
#: Part at which the score is one half.
HALF = 0.01
UNKNOWN = "und"
_OTHER, _LETTER = regex.compile(r"[^\p{L}\p{M}]+"), regex.compile(r"\p{L}")


def letters(text: str | None) -> str:
    """Lower-case letters (Unicode category L) with their marks, and a space for everything between; nothing without a letter."""
    out = _OTHER.sub(" ", (text or "").lower()).strip()
    return out if _LETTER.search(out) else ""


def blocks_of(text: str | None) -> list[bytes]:
    """What is encoded of a text: its letters between spaces in blocks, or rotations of a short one; nothing without letters."""
    data = letters(text).encode()
    if not data:
        return []
    if len(data) > SHORT:
        data = b" " + data + b" "
        return [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
    words = data.split(b" ")
    return [b" " + b" ".join(words[i:] + words[:i]) + b" " for i in range(min(ROTATIONS, len(words)))]


def held_out(key: str) -> Column:
    """Rows that no dictionary is made of: remainder 1 of crc32 of the key as text by 3, or a null key."""
    return F.coalesce(crc_remainder(key, 3) == 1, F.lit(True))


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> dict[str, bytes]:
    """A dictionary for each language of documents that aren't held out.

    About ``SAMPLE`` different documents of a language are taken by a hash of key
    and text, and their whole texts fill the dictionary in the order of that hash;
    of a text that is larger than a dictionary, its first ``DICTIONARY``
    characters are fetched, and no more could be used. Texts that several
    languages share are left out. Null languages and texts without letters teach
    nothing.
    """
    at = F.xxhash64(F.lit(17), F.col(key).cast("string"), F.col(text))
    usable = docs.where(~held_out(key) & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), at.alias("at"), F.col(text).alias("text"))
    totals = {r["lang"]: max(1, r["n"]) for r in usable.groupBy("lang").agg(F.approx_count_distinct("at").alias("n")).collect()}  # one row per language
    if not totals:
        return {}
    total = F.create_map(*[F.lit(x) for pair in totals.items() for x in pair])[F.col("lang")]
    sampled = usable.where(F.pmod("at", total) < SAMPLE).select("lang", "at", F.substring("text", 1, DICTIONARY).alias("text"))
    rows = sampled.dropDuplicates(["lang", "at"]).collect()  # SAMPLE x DICTIONARY for a language, equal rows once
    first: dict[tuple[str, str], int] = {}
    for r in sorted(rows, key=lambda r: r["at"]):
        first.setdefault((r["lang"], letters(r["text"])), r["at"])
    pieces = sorted((name, at, words) for (name, words), at in first.items() if words)
    users: dict[str, set[str]] = {}
    for name, _, words in pieces:
        users.setdefault(words, set()).add(name)
    out: dict[str, bytes] = {}
    for name, _, words in pieces:
        if len(users[words]) == 1:
            out[name] = (out.get(name, b"") + words.encode() + b" ")[:DICTIONARY]
    return out


class Coder:
    """Compressors of all languages, made once in a task."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.coders = {}
        for name, content in sorted(dictionaries.items()):
            one = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            one.precompute_compress(level=LEVEL)
            self.coders[name] = zstandard.ZstdCompressor(level=LEVEL, dict_data=one, write_checksum=False, write_content_size=False)
        self.plain = zstandard.ZstdCompressor(level=LEVEL, write_checksum=False, write_content_size=False)

    def identify(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score (0 to 1, by what the best saves against the second) and whether it is accepted."""
        blocks = blocks_of(text)
        if not blocks or not self.coders:
            return UNKNOWN, 0.0, False
        sizes = sorted((sum(len(coder.compress(b)) for b in blocks), name) for name, coder in self.coders.items())
        # With a single language, the second is the text without a dictionary.
        second = sizes[1][0] if len(sizes) > 1 else sum(len(self.plain.compress(b)) for b in blocks)
        saved = max(0.0, (second - sizes[0][0]) / second)
        return sizes[0][1], saved / (saved + HALF), saved >= NARROW


def identity(dictionaries: dict[str, bytes], text: str = "text") -> Column:
    """A struct of lang_pred, score and accepted, from the text alone."""

    @F.pandas_udf("lang_pred string, score double, accepted boolean")
    def identify(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        coder = Coder(dictionaries)
        for texts in batches:
            yield pd.DataFrame([coder.identify(x) for x in texts], columns=["lang_pred", "score", "accepted"])

    return identify(F.col(text))


def classify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score and accepted.

    Texts that are null or have no letter are ``und`` with score 0 and not
    accepted, like all texts where nothing could be learnt; ties go to the first
    language by name. Repeated rows and null keys (which count as held out)
    stay; other columns are ignored.
    """
    said = docs.select(F.col(key).alias("doc_id"), held_out(key).alias("held_out"), identity(fit(docs, key, text, lang), text).alias("said"))
    return said.select("doc_id", "held_out", "said.lang_pred", "said.score", "said.accepted")


def keep_identified(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The documents whose language is told clearly, all columns."""
    said = unused(docs, "said")
    return docs.withColumn(said, identity(fit(docs, key, text, lang), text)).where(f"`{said}`.accepted").drop(said)
