"""Documents scored by a masked pseudo-likelihood.

Tokens are bytes, every one a symbol of its own, but A to Z count as a to z. A
small network reads the two symbols on either side of a position, which is
itself masked, and gives the probability of every symbol there; a document's
score is the sum of the log-probabilities of all its symbols, each predicted from
both sides.

The corpus is gathered whole: every window of five symbols of every document is
counted, in tasks first and then by a shuffle, so that the network is trained on
the exact counts of all windows. They are dealt by hash of their context into
shards of about ``SHARD`` different windows, so that tasks grow in number and not
in size. A round trains a copy of the network on each shard and averages the
copies, weighted by their windows; the sums are made by a shuffle, in whole
numbers, so that they don't depend on its order. Scoring asks the network once
for each different window of a piece, and remembers some.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusaudit.llm.common import stored

#: Bits of a symbol; symbol 0 is beyond an edge of the text, the others are bytes.
BITS = 8
SYMBOLS = 1 << BITS
CONTEXTS = 1 << 4 * BITS
EMBEDDING, HIDDEN = 12, 64
SHARDS, ROUNDS, PASSES, BATCH, RATE = 8, 6, 4, 256, 0.02
#: Different windows of a shard, about, if there are more than ``SHARDS`` shards of them.
SHARD = 1 << 17
#: Bytes taken together when windows are made, windows counted at a time, and windows that scoring remembers.
PIECE, COUNTED, KNOWN = 1 << 21, 1 << 22, 1 << 21
#: Weights are summed as whole numbers of this part of one.
UNIT = 2.0**-40

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass
class Network:
    """Symbols of the bytes, and weights: an embedding, one hidden layer over four neighbours, and the output."""

    symbol: np.ndarray
    weights: list[np.ndarray]

    def log_probabilities(self, contexts: np.ndarray) -> np.ndarray:
        """For each context (four symbols in one number) the log-probability of every symbol; edges are no symbol."""
        return _forward(self.weights, contexts)[-1]


def start(seed: int = 0) -> list[np.ndarray]:
    r = np.random.default_rng(seed)
    shapes = [(SYMBOLS, EMBEDDING), (4 * EMBEDDING, HIDDEN), (1, HIDDEN), (HIDDEN, SYMBOLS), (1, SYMBOLS)]
    return [(r.normal(size=s) * (0.5 if i == 0 else s[0] ** -0.5 if s[0] > 1 else 0)).astype(np.float32) for i, s in enumerate(shapes)]


def _around(contexts: np.ndarray) -> np.ndarray:
    return np.stack([(contexts >> shift) & (SYMBOLS - 1) for shift in (3 * BITS, 2 * BITS, BITS, 0)], axis=1)


def _forward(weights: list[np.ndarray], contexts: np.ndarray) -> tuple[np.ndarray, ...]:
    embedding, inner, inner_bias, outer, outer_bias = weights
    around = _around(contexts)
    x = embedding[around].reshape(len(contexts), 4 * EMBEDDING)
    h = np.tanh(x @ inner + inner_bias)
    z = h @ outer + outer_bias
    z[:, 0] = -1e9  # an edge is never predicted
    z -= z.max(1, keepdims=True)
    z -= np.log(np.exp(z).sum(1, keepdims=True))
    return around, x, h, z


def _gradients(weights: list[np.ndarray], contexts: np.ndarray, counts: np.ndarray, total: float) -> list[np.ndarray]:
    """Of the log-loss over the windows, by ``total``: ``counts`` has one column per symbol."""
    around, x, h, z = _forward(weights, contexts)
    each = counts.sum(1, keepdims=True)
    dz = (np.exp(z) * each - counts) / np.float32(total)
    dh = (dz @ weights[3].T) * (1 - h * h)
    dx = (dh @ weights[1].T).reshape(-1, EMBEDDING)
    flat = around.ravel()
    de = np.stack([np.bincount(flat, dx[:, j], SYMBOLS) for j in range(EMBEDDING)], axis=1)
    return [de, x.T @ dh, dh.sum(0, keepdims=True), h.T @ dz, dz.sum(0, keepdims=True)]


def train(weights: list[np.ndarray], codes: np.ndarray, counts: np.ndarray, rates: list[float], seed: int = 0) -> list[np.ndarray]:
    """Passes of Adam over all contexts of the counted windows, one for each of ``rates``."""
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    contexts, first = np.unique(codes >> BITS, return_index=True)
    edges, target = np.append(first, len(codes)), codes & (SYMBOLS - 1)
    weights = [w.copy() for w in weights]
    one, two = ([np.zeros_like(w) for w in weights] for _ in range(2))
    random, step = np.random.default_rng(seed), 0
    mean = float(counts.sum()) * BATCH / len(contexts)  # windows of an average batch, so that frequent contexts count for more
    for rate in rates:
        shuffled = random.permutation(len(contexts))
        for at in range(0, len(contexts), BATCH):
            rows, step = shuffled[at : at + BATCH], step + 1
            n = edges[rows + 1] - edges[rows]
            own = np.arange(n.sum()) + np.repeat(edges[rows] - (np.cumsum(n) - n), n)
            table = np.zeros((len(rows), SYMBOLS), np.float32)
            table[np.repeat(np.arange(len(rows)), n), target[own]] = counts[own]
            for w, a, b, g in zip(weights, one, two, _gradients(weights, contexts[rows], table, mean)):
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                w -= (rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return weights


def _pieces(texts: Iterable[tuple[int, bytes | None]]) -> Iterator[tuple[int, bytes, int, int]]:
    """Row, bytes, and how many bytes at either end are there as neighbours only. Zero bytes count as ones."""
    for row, text in texts:
        text = (text or b"").replace(b"\0", b"\1")
        for a in range(0, len(text), PIECE):
            b = min(len(text), a + PIECE)
            left, right = min(2, a), min(2, len(text) - b)
            yield row, text[a - left : b + right], left, right


def windows(texts: Iterable[tuple[int, bytes | None]], symbol: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Groups of pieces: the row of each piece, where it starts, and a code for each byte (-1 where nothing is predicted).

    A code is the four neighbours and then the symbol itself, ``BITS`` bits each.
    """

    def made(group: list[tuple[int, bytes, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        joined = np.frombuffer(b"\0\0" + b"\0\0".join(x[1] for x in group) + b"\0\0", np.uint8)
        s = symbol[joined].astype(np.int64)
        code = s[:-4] << BITS | s[1:-3]
        code = (code << BITS | s[3:-1]) << BITS | s[4:]
        code = code << BITS | s[2:-2]
        code[s[2:-2] == 0] = -1
        starts = np.concatenate([[0], np.cumsum([len(x[1]) + 2 for x in group])])[:-1]
        for at, (_, data, left, right) in zip(starts, group):
            code[at : at + left] = -1
            code[at + len(data) - right : at + len(data)] = -1
        return np.array([x[0] for x in group]), starts, code

    group, held = [], 0
    for piece in _pieces(texts):
        group.append(piece)
        held += len(piece[1]) + 2
        if held >= PIECE:
            yield made(group)
            group, held = [], 0
    if group:
        yield made(group)


def _counted(values: np.ndarray, name: str) -> pa.RecordBatch:
    keys, n = np.unique(values, return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n.astype(np.int64))], names=[name, "n"])


def symbols(docs: DataFrame | None = None) -> np.ndarray:
    """The symbol of each byte, the same whatever the documents: itself, in lower case; 0 only for the zero byte."""
    return _LOWER.copy()


def window_counts(docs: DataFrame, symbol: np.ndarray, text: str = "text") -> DataFrame:
    """(code, n): every window of all documents, counted."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for _, _, code in windows(enumerate(x.as_py() for x in batch.column(0)), symbol):
                held.append(code[code >= 0])
                size += len(held[-1])
                if size >= COUNTED:
                    yield _counted(np.concatenate(held), "code")
                    held, size = [], 0
        if held:
            yield _counted(np.concatenate(held), "code")

    made = docs.select(F.col(text).cast("binary")).mapInArrow(count, "code long, n long")
    return made.groupBy("code").agg(F.sum("n").alias("n"))


def _shard(part):
    """A shard's counted windows as one row. It holds about ``SHARD`` of them, whatever the corpus."""
    columns = (part.column(c).to_numpy().tobytes() for c in ("code", "n"))
    return pa.table({"shard": part.column("shard")[:1], **{c: pa.array([x], pa.binary()) for c, x in zip(("codes", "n"), columns)}})


def _learner(weights: list[np.ndarray], rates: list[float], seed: int, total: int):
    """From the rows of shards, trained one after another, to their part of the average: each weight's place and sum in ``UNIT``."""

    def learn(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summed = None
        for batch in batches:
            for codes, n in zip(*(batch.column(c) for c in ("codes", "n"))):
                codes, n = np.frombuffer(codes.as_py(), np.int64), np.frombuffer(n.as_py(), np.int64)
                after = np.concatenate([w.ravel() for w in train(weights, codes, n, rates, seed)]).astype(np.float64)
                part = np.rint(after * (float(n.sum()) / total / UNIT)).astype(np.int64)
                summed = part if summed is None else summed + part
        if summed is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(summed), dtype=np.int32)), pa.array(summed)], names=["place", "part"])

    return learn


def fit(docs: DataFrame, text: str = "text", rounds: int = ROUNDS, seed: int = 0) -> Network:
    """A network trained on all windows of all documents. Without any window it stays as it starts."""
    symbol, weights = symbols(docs), start(seed)
    counted = stored(window_counts(docs, symbol, text), "window-counts")
    different, total = counted.agg(F.count("*"), F.sum("n")).first()
    if not different:
        return Network(symbol, weights)
    number = F.lit(max(SHARDS, -(-different // SHARD)))
    dealt = counted.withColumn("shard", F.pmod(F.xxhash64(F.shiftright("code", BITS)), number).cast("int"))
    shards = stored(dealt.groupBy("shard").applyInArrow(_shard, "shard int, codes binary, n binary"), "windows")
    edges = np.cumsum([w.size for w in weights])[:-1]
    for r in range(rounds):
        rates = [RATE * (1 - (r * PASSES + i) / (rounds * PASSES)) for i in range(PASSES)]
        parts = shards.mapInArrow(_learner(weights, rates, seed + r, total), "place int, part long")
        summed = sorted(parts.groupBy("place").agg(F.sum("part").alias("part")).collect())  # one row per weight
        flat = (np.array([x["part"] for x in summed]) * UNIT).astype(np.float32)
        weights = [x.reshape(w.shape) for x, w in zip(np.split(flat, edges), weights)]
    return Network(symbol, weights)


class _Answers:
    """Log-probabilities of windows under a network; those asked for are remembered until they are too many."""

    def __init__(self, network: Network):
        self.network, self.codes, self.values = network, np.zeros(0, np.int64), np.zeros(0, np.float32)

    def of(self, codes: np.ndarray) -> np.ndarray:
        asked, which = np.unique(codes, return_inverse=True)
        at = np.searchsorted(self.codes, asked)
        known = at < len(self.codes)
        known[known] = self.codes[at[known]] == asked[known]
        values = np.empty(len(asked), np.float32)
        values[known] = self.values[at[known]]
        values[~known] = new = self._computed(asked[~known])
        if len(self.codes) + len(new) > KNOWN:
            self.codes, self.values = asked, values
        else:
            self.codes, self.values = np.insert(self.codes, at[~known], asked[~known]), np.insert(self.values, at[~known], new)
        return values[which]

    def _computed(self, codes: np.ndarray) -> np.ndarray:
        """For sorted codes."""
        contexts, group = np.unique(codes >> BITS, return_inverse=True)
        out = np.empty(len(codes), np.float32)
        for a in range(0, len(contexts), 1 << 12):
            low, high = np.searchsorted(group, [a, a + (1 << 12)])
            found = self.network.log_probabilities(contexts[a : a + (1 << 12)])
            out[low:high] = found[group[low:high] - a, codes[low:high] & (SYMBOLS - 1)]
        return out


def score(docs: DataFrame, network: Network, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, tokens, log_likelihood (the sum) and score (the mean, null without tokens).

    Null and empty texts have no tokens and a sum of zero; repeated rows and null
    keys stay; other columns are ignored; an empty table gives an empty result.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answers = _Answers(network)
        for batch in batches:
            total, tokens = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for rows, starts, code in windows(enumerate(x.as_py() for x in batch.column("text")), network.symbol):
                used = code >= 0
                value = np.zeros(len(code))
                value[used] = answers.of(code[used])
                np.add.at(total, rows, np.add.reduceat(value, starts))
                np.add.at(tokens, rows, np.add.reduceat(used.astype(np.int64), starts))
            with np.errstate(invalid="ignore"):
                mean = pa.array(total / tokens, mask=tokens == 0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(tokens), pa.array(total), mean], names=["doc_id", "tokens", "log_likelihood", "score"])

    kind = docs.select(F.col(key).alias("doc_id")).schema[0].dataType.simpleString()
    return docs.select(F.col(key).alias("doc_id"), F.col(text).cast("binary").alias("text")).mapInArrow(
        run, f"doc_id {kind}, tokens long, log_likelihood double, score double"
    )
