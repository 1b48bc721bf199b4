"""Token counts as an exact histogram of document lengths.

Documents are encoded whole and summed to one row per length, with partial sums
before the shuffle, so that a common length costs no more than a rare one.
Running sums over the lengths then answer, for every context limit, how many
documents and tokens fit, how many are cut, and what is left of them. The sums
run in two steps, over ranges of lengths and inside each range, so that no task
needs all lengths.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pandas as pd
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusaudit.llm.common import stored

#: Ranks of a byte-level vocabulary; any file of this kind will do.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how that vocabulary cuts text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters encoded at a time, lengths in a range.
SEGMENT, RANGE = 1 << 20, 64
_BREAK = re.compile(r"\S[ \n]")


def segments(text: str) -> Iterator[str]:
    """Pieces of a long text, cut only before a space or line end that follows something else, where no token crosses."""
    start = 0
    while start < len(text):
        found = _BREAK.search(text, start + SEGMENT)
        end = found.start() + 1 if found else len(text)
        yield text[start:end]
        start = end


def encoding(ranks: bytes, pattern: str) -> tiktoken.Encoding:
    pairs = (line.split() for line in ranks.splitlines())
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})


def token_length(spark: SparkSession, text: Column, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> Column:
    """Tokens of the whole text, 0 for null. The driver reads the vocabulary file and sends it along."""
    with open(vocabulary, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())  # a vocabulary file, about a megabyte

    @F.pandas_udf("long")
    def length(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder = encoding(ranks.value, pattern)
        for texts in batches:
            yield pd.Series([sum(len(coder.encode_ordinary(s)) for s in segments(x or "")) for x in texts], dtype="int64")

    return length(text)


def histogram(docs: DataFrame, text: str = "text", by: tuple[str, ...] = (), **vocabulary) -> DataFrame:
    """One row per length that occurs, for each value of ``by``.

    Columns: ``by``, length, documents and tokens of that length; documents_up_to
    and tokens_up_to, of that length or less; documents_beyond and tokens_beyond;
    tokens_kept, all tokens that are left when every document is cut at that
    length; and quantile, the share of documents up to it. Null and empty texts
    have length 0; nulls in ``by`` are a value; repeated rows count each; other
    columns are ignored; an empty table gives an empty result.
    """
    wrong = {"length", "documents", "tokens", "quantile"} & {c.lower() for c in by}
    if wrong:
        raise ValueError(f"rename {sorted(wrong)}: the histogram has columns of that name")
    spark = docs.sparkSession
    # Written once: the running sums read the counts twice, and encoding is what costs.
    counts = stored(
        docs.select(*by, token_length(spark, F.col(text), **vocabulary).alias("length"))
        .groupBy(*by, "length").agg(F.count("*").alias("documents")), "lengths"
    ).select(*by, "length", "documents", (F.col("length") * F.col("documents")).alias("tokens"), F.floor(F.col("length") / RANGE).alias("range"))
    sums = ("documents", "tokens")
    ranges = counts.groupBy(*by, "range").agg(*[F.sum(c).alias(c) for c in sums])
    order = Window.partitionBy(*by).orderBy("range")
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*by)
    ranges = ranges.select(
        *[F.col(c).alias(f"at_{c}") for c in (*by, "range")],
        *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in sums], *[F.sum(c).over(whole).alias(f"{c}_all") for c in sums],
    )
    same = F.col("range") == F.col("at_range")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"at_{c}"))
    inside = Window.partitionBy(*by, "range").orderBy("length").rowsBetween(Window.unboundedPreceding, 0)
    up_to = counts.join(ranges, same).withColumns({f"{c}_up_to": F.col(f"{c}_before") + F.sum(c).over(inside) for c in sums})
    beyond = {c: F.col(f"{c}_all") - F.col(f"{c}_up_to") for c in sums}
    return up_to.select(
        *by, "length", *sums, *[f"{c}_up_to" for c in sums], *[beyond[c].alias(f"{c}_beyond") for c in sums],
        (F.col("tokens_up_to") + F.col("length") * beyond["documents"]).alias("tokens_kept"),
        (F.col("documents_up_to") / F.col("documents_all")).alias("quantile"),
    )


def at_limits(lengths: DataFrame, limits: list[int], by: tuple[str, ...] = ()) -> DataFrame:
    """For each value of ``by`` and each context limit: documents_cut and tokens_kept, from the histogram's running sums."""
    fits = F.struct("length", "documents_up_to", "tokens_up_to")
    total = F.sum("documents")
    rows = [
        F.struct(F.lit(x).cast("long").alias("limit"), F.max(F.when(F.col("length") <= x, fits)).alias("fit"), total.alias("all")) for x in limits
    ]
    each = lengths.groupBy(*by).agg(F.array(*rows).alias("rows")).select(*by, F.explode("rows").alias("r")).where("r.all IS NOT NULL")
    cut = F.col("r.all") - F.coalesce("r.fit.documents_up_to", F.lit(0))
    return each.select(*by, "r.limit", cut.alias("documents_cut"), (F.coalesce("r.fit.tokens_up_to", F.lit(0)) + F.col("r.limit") * cut).alias("tokens_kept"))


def at_quantiles(lengths: DataFrame, quantiles: list[float], by: tuple[str, ...] = ()) -> DataFrame:
    """For each value of ``by`` and each quantile, the smallest length that this share of the documents has at most."""
    rows = [F.struct(F.lit(float(q)).alias("quantile"), F.min(F.when(F.col("quantile") >= q, F.col("length"))).alias("length")) for q in quantiles]
    each = lengths.groupBy(*by).agg(F.array(*rows).alias("rows")).select(*by, F.explode("rows").alias("r"))
    return each.select(*by, "r.quantile", "r.length").where("length IS NOT NULL")
