"""Components of rows that share a list and are near, without forming the lists' pairs.

Where many rows of a list are near each other, nearly all of its pairs tell
nothing new: any chain of links makes the component. So a few rounds compare
every row with one row of its list, the leader of the round, and join what is
near; only rows of a list that are still in different components then meet. A
list of n near copies takes about n comparisons, not n squared. Rounds decide
speed, never the result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusaudit.operators.components import components
from corpusaudit.session import stored

#: Rounds with leaders at most, and pairs for each row of a list that are left to the last step.
ROUNDS, FEW = 2, 4

Fits = Callable[[Callable[[str], Column], Callable[[str], Column]], Column]


def list_components(
    members: DataFrame, fits: Fits, near: Callable[[DataFrame], DataFrame], links: DataFrame | None = None, rounds: int = ROUNDS,
    facts: DataFrame | None = None, alike: Fits | None = None,
) -> DataFrame:
    """(node, root) as ``components`` gives them, of all near pairs that share a list, and of the given ``links`` (a, b).

    ``members`` has list, node (a long) and what ``fits`` reads: a condition on
    two members of a list, given as functions from column names to columns, that
    every near pair meets in one of its lists at least. ``near`` takes (a, b)
    and returns the pairs that are. Leaders are minima, lists are joined by
    their key, so the rows of a large list needn't meet in one task. ``alike`` is
    a condition that every near pair meets in any list, by ``facts`` of each node
    too (node and further columns): in the last step only pairs that meet both
    leave the join, as what comes after it would move them for each pair.
    """
    fields = [c for c in members.columns if c != "list"]
    groups = components(links.select("a", "b")) if links is not None else None
    seen = None
    for number in range(rounds + 1):
        if groups is None:
            grouped = members.withColumn("group", F.col("node"))
        else:
            grouped = members.join(groups, "node", "left").select(*members.columns, F.coalesce("root", "node").alias("group"))
        spread = grouped.groupBy("list").agg(
            F.min("group").alias("low"), F.max("group").alias("high"),
            F.min(F.struct(F.xxhash64(F.lit(number), "node").alias("order"), *fields, "group")).alias("leader"),
        )
        mixed = stored(grouped.join(spread.where("low <> high").select("list", "leader"), "list"), "list-members")
        last = number == rounds or _few(mixed)
        if last:
            pairs = _all_pairs(mixed, fields, fits, facts, alike)
        else:
            apart = (F.col("group") != F.col("leader.group")) & fits(F.col, lambda c: F.col(f"leader.{c}"))
            pairs = mixed.where(apart).select(*_ends("node", "leader.node"))
        pairs = pairs.distinct()
        pairs = stored(pairs if seen is None else pairs.join(seen, ["a", "b"], "left_anti"), "list-pairs")
        known = near(pairs).select("a", "b")
        if groups is not None:  # stars are as good as the links that made them, and fewer
            known = known.unionByName(groups.select(F.col("node").alias("a"), F.col("root").alias("b")))
        groups = components(known)
        if last:
            return groups
        seen = pairs if seen is None else seen.unionByName(pairs)
    raise AssertionError


def _few(mixed: DataFrame) -> bool:
    """Whether the rows of different components that share a list make few pairs."""
    sizes = mixed.groupBy("list", "group").agg(F.count("*").alias("n")).groupBy("list").agg(F.sum("n").alias("n"), F.sum(F.col("n").cast("double") * F.col("n")).alias("same"))
    total = sizes.agg(F.sum("n").alias("rows"), F.sum(F.col("n").cast("double") * F.col("n") - F.col("same")).alias("pairs")).first()
    return (total["pairs"] or 0.0) / 2 <= FEW * (total["rows"] or 0)


def _ends(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _all_pairs(mixed: DataFrame, fields: list[str], fits: Fits, facts: DataFrame | None, alike: Fits | None) -> DataFrame:
    if facts is not None:
        mixed, fields = mixed.join(facts, "node"), [*fields, *[c for c in facts.columns if c != "node"]]
    one, other = (mixed.select("list", *[F.col(c).alias(f"{side}_{c}") for c in (*fields, "group")]) for side in ("one", "other"))
    ends = [lambda c, side=side: F.col(f"{side}_{c}") for side in ("one", "other")]
    met = one.join(other, "list").where((F.col("one_group") < F.col("other_group")) & fits(*ends))
    return (met if alike is None else met.where(alike(*ends))).select(*_ends("one_node", "other_node"))
