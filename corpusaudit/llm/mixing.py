"""Mixing sources to target weights by iterative proportional fitting.

Documents are summed to cells of source, language and topic; all fitting is on
cells. A round scales the cells of every source so that the source has its share
of the tokens, then those of every language, then of every topic, and rounds
repeat until all three marginals hold; the error that is left is returned. A
cell's fitted tokens over its tokens is its ratio, and each of its documents is
kept with the probability min(1, c x ratio), where c is such that the sample has
the wanted share of all tokens: a small cell with a large ratio is kept whole and
sets no scale for the others, and the sample grows with the corpus. A hash of
the document's key decides, so the sample is the same in every run. Everything is DataFrame and SQL expressions; a share is a sum
per value, computed from partial sums, and no source, however large, is gathered
in a task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusaudit.llm.common import stored, unused

DIMENSIONS = ("source", "lang", "topic")
#: Exponent of a dimension's own token shares that gives its targets: below one, small parts count for more.
TEMPER = {"source": 0.5, "lang": 0.7, "topic": 0.7}
#: Rounds at most, the relative error of every marginal at which they end, and the part of a round's error
#: that the next one must get below: targets that contradict each other leave an error that no round removes.
ROUNDS, TOLERANCE, STALLED = 100, 1e-12, 0.999
#: Share of all tokens that the sample has in expectation.
SHARE = 0.5
WORD = r"[^\x20\x09-\x0D]+"


def token_count(text: Column) -> Column:
    """Words between white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def topic_of(text: Column) -> Column:
    """A topic by plain marks of the text, the first that fits: legal, table, contact, short, prose; null for null."""
    return (
        F.when(text.isNull(), F.lit(None).cast("string"))
        .when(text.rlike("[Ll][Ii][Cc][Ee][Nn][CcSs][Ee]"), "legal")
        .when(F.contains(text, F.lit(" | ")), "table")
        .when(F.contains(text, F.lit("@")), "contact")
        .when(F.length(text) < 1000, "short")
        .otherwise("prose")
    )


def uniform(key: Column, seed: int = 0) -> Column:
    """A number from 0 to below 1 by hash of the key as text; null counts as the word null."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")))), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / float(1 << 52)


def tempered(cells: DataFrame, dimension: str, exponent: float) -> DataFrame:
    """Targets for a dimension of cells: (value, share), shares of tokens raised to ``exponent`` and made to sum to one."""
    sums = cells.groupBy(F.col(dimension).alias("value")).agg(F.sum("tokens").cast("double").alias("n")).where("n > 0")
    raised = sums.select("value", F.pow("n", F.lit(float(exponent))).alias("n"))
    total = raised.agg(F.sum("n").alias("n")).first()["n"]
    return raised.select("value", (F.col("n") / F.lit(total)).alias("share"))


def fit(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """The cells with ``weight``: their share of the mix, raked to the targets of all dimensions.

    ``cells`` has the dimensions of ``targets`` and tokens, each combination
    once; a target has value and share. A value without a target, or with a null
    or negative one, gets none of the mix; targets of values that have no tokens
    are spread over the others. Null is a value like any other. Rounds end when
    all marginals hold to the tolerance, or the error falls no more; ``fit_error`` is the largest relative
    error of a marginal that is left. If targets contradict each other, the last
    dimension holds after the last round and the error says how far the others
    are off.
    """
    whole = cells
    for d, target in targets.items():
        shares = target.groupBy(F.col("value").alias("v")).agg(F.sum("share").alias(f"want_{d}"))
        whole = whole.join(shares, F.col(d).eqNullSafe(F.col("v")), "left").drop("v").fillna(0.0, [f"want_{d}"])
    usable = reduce(lambda a, b: a & b, [F.col(f"want_{d}") > 0 for d in targets]) & (F.col("tokens") > 0)
    state = stored(whole.withColumn("weight", F.when(usable, F.col("tokens").cast("double")).otherwise(0.0)), "mix")
    wants = {  # one number for each dimension
        d: state.where("weight > 0").groupBy(d).agg(F.first(f"want_{d}").alias("want")).agg(F.sum("want").alias("all")).first()["all"]
        for d in targets
    }
    error = float("inf")
    for _ in range(rounds):
        for d in targets:
            sums = state.where("weight > 0").groupBy(F.col(d).alias("v")).agg(F.sum("weight").alias("n"), F.first(f"want_{d}").alias("want"))
            factor = sums.select("v", (F.col("want") / F.lit(wants[d]) / F.col("n")).alias("factor"))
            joined = state.join(factor, F.col(d).eqNullSafe(F.col("v")), "left")
            state = joined.select(*[c for c in state.columns if c != "weight"], F.coalesce(F.col("weight") * F.col("factor"), F.lit(0.0)).alias("weight"))
        state = stored(state, "mix")  # lineage ends with each round
        before, error = error, _off(state, wants)
        if error <= tolerance or (tolerance > 0 and error > STALLED * before):
            break
    return state.select(*cells.columns, "weight", F.lit(error).alias("fit_error"))


def _off(state: DataFrame, wants: dict[str, float]) -> float:
    """The largest relative error of a marginal of any dimension."""
    used = state.where("weight > 0")
    each = [used.groupBy(d).agg((F.sum("weight") * F.lit(want) / F.first(f"want_{d}") - 1).alias("off")).select("off") for d, want in wants.items()]
    return reduce(DataFrame.unionAll, each).agg(F.max(F.abs("off")).alias("off")).first()["off"] or 0.0


def scale(fitted: DataFrame, share: float = SHARE) -> float:
    """The c for which min(1, c x weight / tokens) of all cells keeps ``share`` of their tokens.

    Cells that reach one give their whole tokens, the others share what is left by
    weight. That grows c, so more cells may reach one; when none does, c is exact.
    """
    used = fitted.where("weight > 0").select("tokens", "weight")
    total = fitted.agg(F.sum("tokens").alias("n")).first()["n"] or 0
    c = 0.0
    while True:
        full = F.lit(c) * F.col("weight") >= F.col("tokens")
        parts = used.agg(F.sum(F.when(full, F.col("tokens"))).alias("full"), F.sum(F.when(~full, F.col("weight"))).alias("rest")).first()
        rest = parts["rest"] or 0.0
        if not rest:  # everything that can be kept is
            return c
        now = max(0.0, share * total - (parts["full"] or 0)) / rest
        if now <= c * (1 + 1e-15):
            return c
        c = now


def chances(cells: DataFrame, targets: dict[str, DataFrame] | None = None, share: float = SHARE, **limits) -> DataFrame:
    """The cells with the probability that a document of each is kept, and ``fit_error``. ``limits`` are those of ``fit``."""
    by = [c for c in cells.columns if c != "tokens"]
    fitted = stored(fit(cells, targets or {d: tempered(cells, d, TEMPER[d]) for d in by}, **limits), "mix-fitted")
    c = scale(fitted, share)
    chance = F.when(F.col("weight") > 0, F.least(F.lit(1.0), F.lit(c) * F.col("weight") / F.col("tokens"))).otherwise(0.0)
    return stored(fitted.select(*by, chance.alias("probability"), "fit_error"), "mix-chances")


def shares(mixed: DataFrame, dimension: str) -> DataFrame:
    """(value, tokens, expected): the tokens of each value of a dimension in ``mix``'s rows, and the share that the sample is expected to have of it."""
    sums = mixed.groupBy(F.col(dimension).alias("value")).agg(F.sum("tokens").alias("tokens"), F.sum(F.col("tokens") * F.col("probability")).alias("kept"))
    total = mixed.agg(F.sum(F.col("tokens") * F.col("probability")).alias("kept")).first()["kept"] or 1.0
    return sums.select("value", "tokens", (F.col("kept") / F.lit(total)).alias("expected"))


def _facts(docs: DataFrame, text: str, dimensions: dict[str, Column] | None) -> dict[str, Column]:
    by = dimensions or {"source": F.col("source"), "lang": F.col("lang"), "topic": topic_of(F.col(text))}
    return {d: c.cast("string") for d, c in by.items()} | {"tokens": token_count(F.col(text))}


def _cells(facts: DataFrame, by: list[str]) -> DataFrame:
    return stored(facts.groupBy(*by).agg(F.sum("tokens").alias("tokens")), "mix-cells")


def mix(
    docs: DataFrame, targets: dict[str, DataFrame] | None = None, key: str = "doc_id", text: str = "text", seed: int = 0,
    dimensions: dict[str, Column] | None = None, share: float = SHARE, **limits,
) -> DataFrame:
    """One row per document: doc_id, its value of each dimension, tokens, probability, kept and fit_error.

    The sample has ``share`` of all tokens in expectation, or all that have a
    target if that is less. Without ``targets`` each dimension's are its own
    tempered token shares; cells that are kept whole may have less than their
    part of them (``shares`` tells). The probability decides as it is and is
    shown to six decimals.
    Nulls are values of their own; a null or empty text has no tokens, no share
    of the weight, and is not kept. Documents with equal keys, null too, are kept
    by the same number; repeated rows count each; other columns are ignored; an
    empty table gives an empty result.
    """
    facts = stored(docs.select(F.col(key).alias("doc_id"), *[c.alias(n) for n, c in _facts(docs, text, dimensions).items()]), "mix-facts")
    by = [c for c in facts.columns if c not in ("doc_id", "tokens")]
    chance = chances(_cells(facts, by), targets, share, **limits).toDF(*[f"own_{d}" for d in by], "chance", "fit_error")
    same = reduce(lambda a, b: a & b, [F.col(d).eqNullSafe(F.col(f"own_{d}")) for d in by])
    return facts.join(chance, same).select(
        "doc_id", *by, "tokens", F.round("chance", 6).alias("probability"),
        ((F.col("tokens") > 0) & (uniform(F.col("doc_id"), seed) < F.col("chance"))).alias("kept"), F.round("fit_error", 9).alias("fit_error"),
    )


def sample(
    docs: DataFrame, targets: dict[str, DataFrame] | None = None, key: str = "doc_id", text: str = "text", seed: int = 0,
    dimensions: dict[str, Column] | None = None, share: float = SHARE, **limits,
) -> DataFrame:
    """The documents that ``mix`` keeps, all columns."""
    facts = {f"mix_{n}": c for n, c in _facts(docs, text, dimensions).items()}
    own = {n: unused(docs, n) for n in facts}
    by = [n for n in facts if n != "mix_tokens"]
    chance = chances(_cells(docs.select(*[facts[n].alias(n[4:]) for n in facts]), [n[4:] for n in by]), targets, share, **limits).drop("fit_error")
    chance = chance.toDF(*[unused(docs, f"own_{n}") for n in by], unused(docs, "mix_probability"))
    marked = docs.withColumns({own[n]: c for n, c in facts.items()})
    same = reduce(lambda a, b: a & b, [F.col(own[n]).eqNullSafe(F.col(c)) for n, c in zip(by, chance.columns)])
    keep = (F.col(own["mix_tokens"]) > 0) & (uniform(F.col(key), seed) < F.col(chance.columns[-1]))
    return marked.join(chance, same).where(keep).select(*docs.columns)
