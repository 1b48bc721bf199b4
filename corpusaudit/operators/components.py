"""Connected components of a link table, by alternating stars.

Each round points every node's larger neighbours to the smallest neighbour, then
does the same with the smaller ones; the table shrinks towards one star per
component in a number of rounds that grows with the logarithm of its longest
path. Rounds are joins and minima over the link table; nothing is collected, and
every round is a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusaudit.session import stored


def components(links: DataFrame) -> DataFrame:
    """(node, root): every node of ``links`` (a, b) that isn't its component's smallest, with the smallest.

    Nodes are longs. Loops, repeats and direction don't matter; links with a
    null end are ignored.
    """
    edge = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edge = stored(edge, "links")
    mark = None
    while (now := _mark(edge)) != mark:
        mark = now
        both = edge.unionByName(edge.select(F.col("b").alias("a"), F.col("a").alias("b")))
        edge = _star(both, F.col("b") > F.col("a"), False)
        edge = stored(_star(edge, F.col("b") < F.col("a"), True), "links")
    return edge.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _star(edge: DataFrame, moved, own: bool) -> DataFrame:
    """Neighbours b of a that are ``moved`` point to a's smallest neighbour, or a itself; with ``own``, a does too."""
    least = edge.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("least"))
    out = edge.join(least, "a").where(moved).select(F.col("b").alias("a"), F.col("least").alias("b"))
    if own:
        out = out.unionByName(least.select("a", F.col("least").alias("b")))
    return out.where("a <> b").distinct()


def _mark(edge: DataFrame) -> tuple:
    """A number that stays when a round changes nothing."""
    return tuple(edge.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first())
