"""Exact top-k by inner product over a pivot-distance index.

Every vector is keyed by its nearest pivot and by its distance r from it, cut
into annuli; the vectors of an annulus lie sorted by r in blocks. From the
triangle inequality |q - x| >= |d(q, p) - r|, and so

    q.x = (|q|^2 + |x|^2 - |q - x|^2) / 2 <= (|q|^2 + |x|^2 - (d(q, p) - r)^2) / 2

bounds every score in an annulus or block from its range of r and its largest
norm. Each query first searches the annuli with the best bounds until they hold
enough vectors; its k-th best score then stops it from all annuli and blocks
whose bound is lower. What is left is searched, so the result is exact whatever
the pivots are; they and the annuli come from a bounded sample and decide speed
only. Queries meet blocks in chunks, as matrix products; the directory of annuli
is bounded by the parameters, whatever the number of vectors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusaudit.llm.common import partitions, spread, stored

#: Vectors from which pivots are chosen.
SAMPLE = 2048
#: Aimed-at vectors in an annulus, most annuli, and vectors in a block and queries in a chunk.
PER_ANNULUS, MAX_ANNULI, BLOCK, CHUNK = 1024, 4096, 2048, 256
#: Vectors that the first round looks at, at least, for a query's first bound.
FIRST_LOOK = 64

_KEY = ["width", "pivot", "annulus"]
_BLOCKS = "width int, pivot int, annulus int, ids binary, data binary, extra binary"


def quantised(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component; null if the vector is null or holds a null, a NaN or an infinity."""
    usable = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(usable, F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))))


def exact_top_k(
    vectors: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", scale: int = 256
) -> DataFrame:
    """For every row that ``is_query`` marks, the k rows with the highest scores: query_id, rank, vec_id, score.

    The score is the integer inner product of the quantised vectors. Ties go to
    the smaller id; a query's own id is no candidate. Fewer candidates give
    fewer rows. Vectors that are null or hold a null or non-finite component and
    rows with a null id take no part; vectors of different lengths have no
    product and don't meet. Rows that repeat an id with the same vector count
    once; an id with several vectors takes part with each. Other columns are
    ignored; an empty table gives an empty result. Scores must fit a long.
    """
    spark = vectors.sparkSession
    ready = (
        vectors.select(F.col(key).cast("long").alias("id"), is_query.alias("is_query"), quantised(F.col(vector), scale).alias("v"))
        .where("id IS NOT NULL AND v IS NOT NULL")
    )
    total = ready.count()
    sample = [np.array(r["v"], np.int64) for r in ready.select("id", "v").orderBy(spread(F.col("id")), "v").limit(SAMPLE).collect()]
    geometry = _geometry(sample, min(MAX_ANNULI, max(16, total // PER_ANNULUS)))
    placed = ready.mapInArrow(
        lambda batches: _place(batches, geometry),
        "id long, is_query boolean, v array<long>, width int, pivot int, annulus int, r double, norm double",
    )
    placed = stored(placed, "pivot-index")
    cells = placed.groupBy(*_KEY).agg(
        F.count("*").alias("n"), F.min("r").alias("low"), F.max("r").alias("high"), F.max("norm").alias("norm")
    )
    directory = _directory(cells.collect())  # one row per annulus, bounded by MAX_ANNULI for a length of vectors
    n = partitions(spark)
    blocks = stored(_packed(placed.select(*_KEY, "id", "v", F.array("r", "norm").alias("extra"), F.col("r").alias("order")), n, BLOCK), "pivot-blocks")

    query = placed.where("is_query").select("id", "v")
    probe = "width int, pivot int, annulus int, id long, v array<long>, extra array<double>"
    first = query.select("id", "v", F.lit(None).cast("double").alias("bound")).mapInArrow(
        lambda batches: _probes(batches, geometry, directory, k, False), probe
    )
    found = stored(_searched(first, blocks, k, n), "pivot-first")
    # The k-th best of a query with a single vector; a repeated id has the bound of all its vectors.
    bound = _ranked(found, k).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").cast("double").alias("bound"))
    rest = query.join(bound, "id", "left").mapInArrow(lambda batches: _probes(batches, geometry, directory, k, True), probe)
    return _ranked(found.unionByName(_searched(rest, blocks, k, n)), k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _geometry(sample: list[np.ndarray], cells: int) -> dict[int, tuple[np.ndarray, float, int]]:
    """Pivots, annulus width and number of annuli for each length of vectors that the sample has."""
    out = {}
    pivots = max(4, 1 << round(np.log2(cells) / 2 + 1))
    for width in {len(v) for v in sample}:
        rows = np.stack([v for v in sample if len(v) == width]).astype(np.float64)
        chosen = [0]
        nearest = ((rows - rows[0]) ** 2).sum(1)
        while len(chosen) < min(pivots, len(rows)) and nearest.max() > 0:  # farthest first
            chosen.append(int(nearest.argmax()))
            nearest = np.minimum(nearest, ((rows - rows[chosen[-1]]) ** 2).sum(1))
        rings = max(1, cells // len(chosen))
        out[width] = rows[chosen], float(np.sqrt(nearest.max())) / rings or 1.0, rings
    return out


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    d = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1) - 2 * (x @ pivots.T)
    return np.sqrt(np.maximum(d, 0))


def _of(geometry: dict, width: int) -> tuple[np.ndarray, float, int]:
    return geometry.get(width) or (np.zeros((1, width)), 1.0, 1)


def _by_width(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Vectors of a batch by length: length, row numbers, matrix."""
    lists = batch.column(column)
    widths = np.asarray(pc.list_value_length(lists))
    flat = np.asarray(lists.flatten())
    starts = np.concatenate([[0], np.cumsum(widths)])[:-1]
    for width in np.unique(widths):
        at = np.flatnonzero(widths == width)
        yield int(width), at, flat[starts[at][:, None] + np.arange(width)]


def _place(batches: Iterable[pa.RecordBatch], geometry: dict) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        width, pivot, annulus = (np.zeros(n, np.int32) for _ in range(3))
        r, norm = np.zeros(n), np.zeros(n)
        for size, at, x in _by_width(batch, "v"):
            x = x.astype(np.float64)
            pivots, step, rings = _of(geometry, size)
            d = _distances(x, pivots)
            width[at], pivot[at] = size, d.argmin(1)
            r[at], norm[at] = d.min(1), np.sqrt((x * x).sum(1))
            annulus[at] = np.minimum(r[at] / step, rings - 1).astype(np.int32)
        columns = [batch.column("id"), batch.column("is_query"), batch.column("v"), *map(pa.array, (width, pivot, annulus, r, norm))]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "is_query", "v", *_KEY, "r", "norm"])


def _directory(rows: list) -> dict[int, dict[str, np.ndarray]]:
    out = {}
    for width in {r["width"] for r in rows}:
        own = [r for r in rows if r["width"] == width]
        out[width] = {c: np.array([r[c] for r in own]) for c in ("pivot", "annulus", "n", "low", "high", "norm")}
    return out


def _bounds(d: np.ndarray, q_norm: np.ndarray, low: np.ndarray, high: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """Upper bounds of scores for distances of queries from pivots; a little above the exact value, for rounding."""
    slack = 1e-6 * (1 + d + high)
    gap = np.maximum(0, np.maximum(low - d, d - high) - slack)
    return (q_norm**2 + norm**2 - gap**2) / 2 * (1 + 1e-9) + 1e-6 * (1 + q_norm * norm) + 0.5


def _probes(
    batches: Iterable[pa.RecordBatch], geometry: dict, directory: dict, k: int, rest: bool
) -> Iterator[pa.RecordBatch]:
    """The annuli that a query looks at in the first round, or those left whose bound reaches its k-th best score."""
    for batch in batches:
        if not batch.num_rows:
            continue
        kth = batch.column("bound").to_numpy(zero_copy_only=False)
        for width, at, x in _by_width(batch, "v"):
            x = x.astype(np.float64)
            cells = directory[width]
            q_norm = np.sqrt((x * x).sum(1))
            d = _distances(x, _of(geometry, width)[0])[:, cells["pivot"]]
            bound = _bounds(d, q_norm[:, None], cells["low"], cells["high"], cells["norm"])
            order = np.argsort(-bound, axis=1, kind="stable")
            held = np.cumsum(cells["n"][order], axis=1)
            early = np.zeros(bound.shape, bool)
            np.put_along_axis(early, order, held - cells["n"][order] < max(FIRST_LOOK, k + 1), axis=1)
            limit = np.where(np.isnan(kth[at]), -np.inf, kth[at])
            take = ~early & (bound >= limit[:, None]) if rest else early
            rows, columns = np.nonzero(take)
            for i in range(0, len(rows), 4096):
                own, cell = rows[i : i + 4096], columns[i : i + 4096]
                picked = pa.array(at[own])
                extra = np.stack([d[own, cell], q_norm[own], limit[own]], axis=1).ravel()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(own), width, np.int32)), pa.array(cells["pivot"][cell].astype(np.int32)),
                        pa.array(cells["annulus"][cell].astype(np.int32)), batch.column("id").take(picked), batch.column("v").take(picked),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, 3 * len(own) + 1, 3), pa.int32()), pa.array(extra)),
                    ],
                    names=[*_KEY, "id", "v", "extra"],
                )


def _packed(rows: DataFrame, n: int, size: int) -> DataFrame:
    """Rows of one annulus, in order, as matrices of at most ``size`` rows; a large annulus spans many tasks."""
    order = ["order"] if "order" in rows.columns else []
    ranged = rows.repartitionByRange(n, *_KEY, *order, "id").sortWithinPartitions(*_KEY, *order, "id")
    return ranged.mapInArrow(lambda batches: _pack(batches, size), _BLOCKS)


def _pack(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    def row(key: tuple, parts: list[tuple]) -> pa.RecordBatch:
        ids, data, extra = (np.concatenate(x) for x in zip(*parts))
        cells = [pa.array([x], pa.int32()) for x in key] + [pa.array([x.tobytes()], pa.binary()) for x in (ids, data, extra)]
        return pa.RecordBatch.from_arrays(cells, names=[*_KEY, "ids", "data", "extra"])

    key, parts, held = None, [], 0
    for batch in batches:
        keys = np.stack([np.asarray(batch.column(c)) for c in _KEY], axis=1)
        if not len(keys):
            continue
        edges = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
        for start, end in zip([0, *edges], [*edges, len(keys)]):
            if key != (now := tuple(keys[start].tolist())):
                if parts:
                    yield row(key, parts)
                key, parts, held = now, [], 0
            while start < end:
                take = min(end - start, size - held)
                piece = batch.slice(start, take)
                parts.append((
                    np.asarray(piece.column("id")), np.asarray(piece.column("v").flatten()).astype(np.int64),
                    np.asarray(piece.column("extra").flatten()),
                ))
                start, held = start + take, held + take
                if held == size:
                    yield row(key, parts)
                    parts, held = [], 0
    if parts:
        yield row(key, parts)


def _searched(probes: DataFrame, blocks: DataFrame, k: int, n: int) -> DataFrame:
    chunks = _packed(probes, n, CHUNK).select(*_KEY, *[F.col(c).alias("q_" + c) for c in ("ids", "data", "extra")])
    return chunks.join(blocks, _KEY).mapInArrow(lambda batches: _score(batches, k), "query_id long, vec_id long, score long")


def _score(batches: Iterable[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            cell: Callable[[str, type], np.ndarray] = lambda c, kind: np.frombuffer(batch.column(c)[i].as_py(), kind)
            width = batch.column("width")[i].as_py()
            ids, q_ids = cell("ids", np.int64), cell("q_ids", np.int64)
            x, q = cell("data", np.int64).reshape(len(ids), width), cell("q_data", np.int64).reshape(len(q_ids), width)
            r, norm = cell("extra", np.float64).reshape(-1, 2).T
            d, q_norm, limit = cell("q_extra", np.float64).reshape(-1, 3).T
            # Queries that the block's own range of distances can still serve.
            open_ = _bounds(d, q_norm, r.min(), r.max(), norm.max()) >= limit
            q, q_ids, limit = q[open_], q_ids[open_], limit[open_]
            if not len(q_ids):
                continue
            small = width == 0 or float(np.abs(x).max()) * float(np.abs(q).max()) * width < 2**52
            scores = (q.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64) if small else q @ x.T
            yield _best(scores, q_ids, ids, limit, k)


def _best(scores: np.ndarray, q_ids: np.ndarray, ids: np.ndarray, limit: np.ndarray, k: int) -> pa.RecordBatch:
    """The best k different (id, score) of each query, ties to smaller ids, at or above its bound."""
    out: list[tuple[np.ndarray, ...]] = []
    for own, row, least in zip(q_ids, scores, limit):
        usable = np.flatnonzero((ids != own) & (row >= least))
        need = k
        while len(usable):
            near = usable
            if len(usable) > need:
                cut = np.partition(row[usable], len(usable) - need)[len(usable) - need]
                near = usable[row[usable] >= cut]
            order = near[np.lexsort((ids[near], -row[near]))]
            pairs = np.stack([ids[order], row[order]], axis=1)
            fresh = np.concatenate([[True], (pairs[1:] != pairs[:-1]).any(1)])
            if fresh.sum() >= k or len(near) == len(usable):
                kept = order[fresh][:k]
                out.append((np.full(len(kept), own), ids[kept], row[kept]))
                break
            need *= 4  # repeated rows filled the places
    columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 3
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["query_id", "vec_id", "score"])
