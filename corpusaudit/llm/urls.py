"""URL rules as a sort-merge range join.

A host is keyed by its labels from the right, each ended by a dot
(``www.example.org`` becomes ``org.example.www.``), and the path follows. A
rule's host is then an interval of keys, from its reversed host to the next
string that doesn't start with it, and intervals either nest or are apart. URLs
and rules are cut into key ranges, sorted together, and swept once: a stack
holds the rules whose interval has begun and not ended, outermost first.

Key ranges are cut at a bounded sample of keys with a hash of the row behind
them, so a host, or one URL, that holds a third of all rows is spread over many
ranges. The sample decides balance only. A rule goes to every range that its
interval touches, which is many for a few top-level domains only.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusaudit.llm.common import partitions, spread

RULES = "host string, path string, verdict string"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Keys sampled for each range when ranges are cut.
SAMPLE_PER_RANGE = 50


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?`` or ``#``, A-Z in lower case; else empty."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?`` or ``#``; empty without ``://``."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    text = F.coalesce(url, F.lit(""))
    at = F.instr(text, "://")
    return F.when(at > 0, text.substr(at + 3, F.length(text))).otherwise("")


def reversed_host(host: Column) -> Column:
    """Labels from the right, each ended by a dot."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def judge_urls(
    urls: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow"
) -> DataFrame:
    """One row per row of ``urls``: key, host, path, the rule that decides and its verdict.

    ``rules`` has host, path and verdict. A rule fits its host and all
    subdomains where the path starts with the rule's; the longest (host and path
    together, then host) wins, and of equal rules ``block``. Without a rule the
    verdict is ``default`` and the rule null. Rules with a null host or verdict
    are ignored, a null path is empty. Null or malformed URLs have an empty host
    and path, which no rule fits; repeated rows and null keys stay; other
    columns are ignored; an empty table gives an empty result.
    """
    spark = urls.sparkSession
    ranges = partitions(spark)
    page = urls.select(
        F.col(key).alias("id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"),
        spread(F.concat_ws("|", F.col(key).cast("string"), F.col(url))).alias("salt"),
    ).withColumn("at", F.concat(reversed_host(F.col("host")), "path"))
    sample = page.select("at", "salt").orderBy("salt", "at").limit(ranges * SAMPLE_PER_RANGE).collect()
    seen = sorted((r["at"], r["salt"]) for r in sample)
    cuts = [seen[i] for i in range(SAMPLE_PER_RANGE, len(seen), SAMPLE_PER_RANGE)]

    @F.pandas_udf("int")
    def range_of(at: pd.Series, salt: pd.Series) -> pd.Series:
        return pd.Series([bisect_right(cuts, x) for x in zip(at, salt)], dtype="int32")

    start = reversed_host(F.translate(F.col("host"), _UPPER, _LOWER))
    # A start ends in "."; the next character, "/", ends the interval of all that begin with it.
    end = F.concat(F.substring(start, F.lit(1), F.length(start) - 1), F.lit("/"))
    rule = (
        rules.where("host IS NOT NULL AND verdict IS NOT NULL")
        .select("host", F.coalesce("path", F.lit("")).alias("path"), "verdict", start.alias("at"), end.alias("until"))
        .distinct()
        .withColumn("first", range_of("at", F.lit(-(1 << 63)).cast("long")))
        .withColumn("last", range_of("until", F.lit(-(1 << 63)).cast("long")))
        .withColumn("range", F.explode(F.sequence("first", "last")))
    )
    id_type = urls.schema[key].dataType
    events = page.select(
        range_of("at", "salt").alias("range"), "at", F.lit(1).alias("kind"), "id", "host", "path",
        F.lit(None).cast("string").alias("verdict"), F.lit(None).cast("string").alias("until"),
    ).unionByName(
        rule.select("range", "at", F.lit(0).alias("kind"), F.lit(None).cast(id_type).alias("id"), "host", "path", "verdict", "until")
    )
    schema = T.StructType([T.StructField(key, id_type)] + [T.StructField(c, T.StringType()) for c in ("host", "path", "rule", "verdict")])
    ordered = events.repartition(ranges, "range").sortWithinPartitions("range", "at", "kind")
    return ordered.mapInArrow(lambda batches: _sweep(batches, key, default), schema)


def _sweep(batches: Iterable[pa.RecordBatch], key: str, default: str) -> Iterator[pa.RecordBatch]:
    """Events of one or more ranges in key order; yields the judged URLs."""
    stack: list[tuple[str, str, dict[str, str], list[int]]] = []  # interval's end, host, verdict by path, path lengths
    now = None
    for batch in batches:
        ranges, ats, kinds, hosts, paths, verdicts, untils = (
            batch.column(c).to_pylist() for c in ("range", "at", "kind", "host", "path", "verdict", "until")
        )
        picked, found, said = [], [], []
        for i, (part, at, kind) in enumerate(zip(ranges, ats, kinds)):
            if part != now:
                now, stack = part, []
            while stack and at >= stack[-1][0]:
                stack.pop()
            if kind == 0:
                if not stack or stack[-1][1] != hosts[i]:
                    stack.append((untils[i], hosts[i], {}, []))
                _, _, by_path, lengths = stack[-1]
                if by_path.get(paths[i]) != "block":
                    by_path[paths[i]] = verdicts[i]
                if len(paths[i]) not in lengths:
                    lengths.append(len(paths[i]))
                    lengths.sort(reverse=True)
                continue
            best, rule, verdict = (-1, -1), None, default
            for _, host, by_path, lengths in stack:
                for n in lengths:
                    hit = by_path.get(paths[i][:n]) if n <= len(paths[i]) else None
                    if hit is not None:
                        if (size := (len(host) + n, len(host))) > best:
                            best, rule, verdict = size, host + paths[i][:n], hit
                        break
            picked.append(i)
            found.append(rule)
            said.append(verdict)
        rows = pa.array(picked, pa.int32())
        yield pa.RecordBatch.from_arrays(
            [batch.column("id").take(rows), batch.column("host").take(rows), batch.column("path").take(rows),
             pa.array(found, pa.string()), pa.array(said, pa.string())],
            names=[key, "host", "path", "rule", "verdict"],
        )
