"""Nearest vectors, exact and approximate.

Vectors of one width and model are packed into blocks in the tasks that read
them, queries likewise into smaller ones, and blocks meet as matrix products. A
few queries travel to the blocks, after their size was measured; beyond that,
both sides are shuffled, every query block once to each part. Each pair of
blocks keeps the best k per query, so no pair of query and chunk becomes a row.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from corpusaudit.session import stored

SCORE_DIGITS = 6
BLOCK, QUERY_BLOCK = 2048, 256
#: Vectors that a task compares with all centres at once, and blocks' worth of vectors that it holds.
SLICE, HELD = 512, 32
#: Bytes of query vectors up to which they travel whole, and hits up to which their texts are looked up by broadcast.
TRAVEL_BYTES, TRAVEL_HITS = 16 << 20, 100_000
#: Vectors that lists are trained on, lists at most, and queries that their number of probes is measured with.
SAMPLE, MOST_LISTS, TRIALS = 8192, 4096, 256


def _type(df: DataFrame, column: str) -> T.DataType:
    return df.schema[column].dataType


def vectors(df: DataFrame, key: str) -> DataFrame:
    """(id, model, list, v): the rows that have a vector, of one or more finite numbers."""
    v = F.col("embedding").cast("array<double>")
    usable = df.where(F.size("embedding") > 0).where(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    model = F.col("model") if "model" in df.columns else F.lit(None).cast("string")
    bucket = F.col("bucket") if "bucket" in df.columns else F.lit(0)
    return usable.select(F.col(key).alias("id"), model.alias("model"), bucket.cast("int").alias("list"), v.alias("v"))


def without_vector(df: DataFrame) -> DataFrame:
    """The rows that no search sees: a null or empty vector, or one with a null, a NaN or an infinity."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.where(F.coalesce((F.size("embedding") > 0) & finite, F.lit(False)) == F.lit(False))


# -- blocks --------------------------------------------------------------------
def _packed(rows: DataFrame, size: int, parts: int) -> DataFrame:
    """Blocks of at most ``size`` vectors that share width, model and list; ``part`` deals them out evenly."""
    id_type = _type(rows, "id")
    schema = T.StructType([
        T.StructField("width", T.IntegerType()), T.StructField("model", T.StringType()), T.StructField("list", T.IntegerType()),
        T.StructField("part", T.IntegerType()), T.StructField("ids", T.ArrayType(id_type)), T.StructField("data", T.BinaryType()),
    ])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId()
        held: dict[tuple, tuple[list, list]] = {}
        sizes: dict[tuple, int] = {}

        def block(key: tuple) -> pa.RecordBatch:
            nonlocal number
            ids, data = held.pop(key)
            del sizes[key]
            number += 1
            cells = [pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.string()), pa.array([key[2]], pa.int32()), pa.array([number % parts], pa.int32()),
                     pa.ListArray.from_arrays(pa.array([0, sum(map(len, ids))], pa.int32()), pa.concat_arrays(ids)), pa.array([np.concatenate(data).tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(cells, names=[f.name for f in schema])

        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column("v")
            start = np.asarray(lists.offsets)
            flat = np.asarray(lists.values)
            keys = list(zip(np.diff(start).tolist(), batch.column("model").to_pylist(), batch.column("list").to_pylist()))
            rows_of: dict[tuple, list[int]] = {}
            for i, key in enumerate(keys):
                rows_of.setdefault(key, []).append(i)
            for key, rows in rows_of.items():
                for a in range(0, len(rows), size):
                    part = np.array(rows[a : a + size])
                    ids, data = held.setdefault(key, ([], []))
                    ids.append(batch.column("id").take(pa.array(part)))
                    data.append(flat[start[part][:, None] + np.arange(key[0])].ravel())
                    sizes[key] = sizes.get(key, 0) + len(part)
                    if sizes[key] >= size:
                        yield block(key)
            while sum(sizes.values()) > HELD * size:  # many lists, none of them full
                yield block(max(sizes, key=sizes.get))
        for key in list(held):
            yield block(key)

    return rows.select("id", "model", "list", "v").mapInArrow(run, schema)


def _unit(m: np.ndarray) -> np.ndarray:
    lengths = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, lengths, out=np.zeros_like(m), where=lengths > 0)


def _best(q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, metric: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each query the rows of the best k of a block, ties by id, with their rounded scores."""
    if metric == "cosine":
        rough, margin = np.round(_unit(q) @ _unit(x).T, SCORE_DIGITS), np.zeros(len(q))
    else:
        squares = (x * x).sum(1)
        rough = 2 * (q @ x.T) - squares - (q * q).sum(1)[:, None]
        # The expansion loses digits where vectors are long and near; it only chooses what is then computed directly.
        margin = 1e-13 * x.shape[1] * (squares.max() + (q * q).sum(1)) + 1e-5
    for row, own, slack in zip(rough, q, margin):
        near = np.arange(len(row))
        if len(row) > k:
            cut = np.partition(row, len(row) - k)[len(row) - k]
            if metric != "cosine":  # rounding may join distances that are this far apart
                cut = -((np.sqrt(max(0.0, -cut + slack)) + 10.0**-SCORE_DIGITS) ** 2) - slack
            near = np.flatnonzero(row >= cut)
        score = row[near] if metric == "cosine" else np.round(-np.sqrt(((x[near] - own) ** 2).sum(1)), SCORE_DIGITS)
        order = np.lexsort((ids[near], -score))[:k]
        yield near[order], score[order] + 0.0  # no negative zero


def _meet(queries: DataFrame, blocks: DataFrame, k: int, metric: str) -> DataFrame:
    """(query_id, chunk_id, score): the best k of every query block in every block that it is joined with."""
    schema = T.StructType([
        T.StructField("query_id", _type(queries, "q_ids").elementType), T.StructField("chunk_id", _type(blocks, "ids").elementType), T.StructField("score", T.DoubleType()),
    ])
    same = (F.col("width") == F.col("q_width")) & F.col("model").eqNullSafe(F.col("q_model")) & (F.col("list") == F.col("q_list"))
    if "q_part" in queries.columns:
        same &= F.col("part") == F.col("q_part")
    else:
        queries = F.broadcast(queries)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                width = batch.column("width")[i].as_py()
                x, q = (np.frombuffer(batch.column(c)[i].as_py()).reshape(-1, width) for c in ("data", "q_data"))
                all_ids, all_queries = batch.column("ids")[i].values, batch.column("q_ids")[i].values
                found = list(_best(q, x, np.array(all_ids.to_pylist()), k, metric))
                chosen = pa.array(np.concatenate([r for r, _ in found]))
                asked = pa.array(np.repeat(np.arange(len(q)), [len(r) for r, _ in found]))
                yield pa.RecordBatch.from_arrays(
                    [all_queries.take(asked), all_ids.take(chosen), pa.array(np.concatenate([s for _, s in found]))], names=[f.name for f in schema]
                )

    return blocks.join(queries, same).select("width", "ids", "data", "q_ids", "q_data").mapInArrow(run, schema)


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    window = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("chunk_id"))
    return hits.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def _query_blocks(rows: DataFrame, parts: int) -> tuple[DataFrame, int]:
    """Packed queries, to be broadcast or with a copy for each part, and their number."""
    packed = stored(_packed(rows, QUERY_BLOCK, 1).drop("part"), "query-blocks")
    size = packed.agg(F.coalesce(F.sum(F.octet_length("data")), F.lit(0)).alias("bytes"), F.coalesce(F.sum(F.size("ids")), F.lit(0)).alias("n")).first()
    named = packed.select(*[F.col(c).alias(f"q_{c}") for c in packed.columns])
    if size["bytes"] > TRAVEL_BYTES:
        named = named.withColumn("q_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return named, size["n"]


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def nearest(queries: DataFrame, chunks: DataFrame, k: int, metric: str = "cosine") -> tuple[DataFrame, int]:
    """(query_id, chunk_id, score, rank) of the k best chunks of each query, and the number of queries."""
    parts = _parts(chunks)
    asked, n = _query_blocks(vectors(queries.drop("bucket"), "query_id"), parts)
    blocks = _packed(vectors(chunks.drop("bucket"), "chunk_id"), BLOCK, parts)
    return _ranked(_meet(asked, blocks, k, metric), k), n


class Ahead:
    """How many rows come before each wanted one in the order of falling scores, ties by id."""

    def __init__(self, wanted: list[tuple[float, object]]):
        self.wanted = sorted((-score, key) for score, key in wanted)
        self.scores = np.array([s for s, _ in self.wanted])
        self.counts = np.zeros(len(self.wanted) + 1, np.int64)

    def add(self, scores: np.ndarray, ids: Sequence) -> None:
        place, behind = (np.searchsorted(self.scores, -scores, side=side) for side in ("left", "right"))
        for i in np.flatnonzero(place < behind).tolist():  # a wanted row, or one with its score
            place[i] = bisect_right(self.wanted, (-scores[i], ids[i]))
        self.counts += np.bincount(place, minlength=len(self.counts))

    def rows(self) -> list[tuple[object, int]]:
        return [(key, int(n)) for (_, key), n in zip(self.wanted, np.cumsum(self.counts))]


def _by_query(rows: list, *fields: str) -> dict:
    out: dict = {}
    for r in rows:
        out.setdefault(r["query_id"], []).append(tuple(r[f] for f in fields))
    return out


def places(queries: DataFrame, chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """(query_id, doc_id, rank): the place of each wanted (query_id, doc_id) among all chunks by cosine, counted and not sorted.

    ``wanted`` names chunks by ``doc_id`` and is small enough to travel; those
    without a vector have no place. A first pass finds their scores, a second one
    counts in every task how many chunks are better.
    """
    parts = _parts(chunks)
    asked, _ = _query_blocks(vectors(queries.drop("bucket"), "query_id"), parts)
    blocks = _packed(vectors(chunks.drop("bucket"), "chunk_id"), BLOCK, parts)
    sent = wanted.sparkSession.sparkContext.broadcast(_by_query(wanted.select("query_id", "doc_id").collect(), "doc_id"))
    query_type, id_type = _type(wanted, "query_id"), _type(wanted, "doc_id")

    def found(query, scores: np.ndarray, ids: list, held: dict) -> Iterator[tuple]:
        own = {key for (key,) in sent.value.get(query, ())}
        return ((query, key, float(scores[i])) for i, key in enumerate(ids) if key in own)

    scored = _each_pair(asked, blocks, found, lambda held: (), [query_type, id_type, T.DoubleType()], "score")
    known = wanted.sparkSession.sparkContext.broadcast(_by_query(scored.collect(), "score", "doc_id"))

    def counted(query, scores: np.ndarray, ids: list, held: dict) -> Iterator[tuple]:
        if query in known.value:
            if query not in held:
                held[query] = Ahead(known.value[query])
            held[query].add(scores, ids)
        return iter(())

    ahead = _each_pair(asked, blocks, counted, lambda held: ((q, key, n) for q, own in held.items() for key, n in own.rows()), [query_type, id_type, T.LongType()], "better")
    return ahead.groupBy("query_id", "doc_id").agg((F.sum("better") + 1).alias("rank"))


def _each_pair(queries: DataFrame, blocks: DataFrame, each, last, kinds: list[T.DataType], value: str) -> DataFrame:
    """(query_id, doc_id, value): what ``each`` says of every query and the scores of a block, and ``last`` at a task's end."""
    schema = T.StructType([T.StructField(n, t) for n, t in zip(("query_id", "doc_id", value), kinds)])
    same = (F.col("width") == F.col("q_width")) & F.col("model").eqNullSafe(F.col("q_model"))
    same &= F.col("part") == F.col("q_part") if "q_part" in queries.columns else F.lit(True)
    arrow = [to_arrow_type(t) for t in kinds]

    def rows(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*found)) or [()] * 3, arrow)], names=schema.names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            for i in range(batch.num_rows):
                width = batch.column("width")[i].as_py()
                x, q = (np.frombuffer(batch.column(c)[i].as_py()).reshape(-1, width) for c in ("data", "q_data"))
                ids = batch.column("ids")[i].as_py()
                scores = np.round(_unit(q) @ _unit(x).T, SCORE_DIGITS) + 0.0
                yield rows([r for query, own in zip(batch.column("q_ids")[i].as_py(), scores) for r in each(query, own, ids, held)])
        yield rows(list(last(held)))

    travelling = queries if "q_part" in queries.columns else F.broadcast(queries)
    return blocks.join(travelling, same).select("width", "ids", "data", "q_ids", "q_data").mapInArrow(run, schema)


# -- lists ---------------------------------------------------------------------
@dataclass
class Lists:
    """Centres of vector lists for each width and model, and how many lists a query looks at."""

    centres: dict[tuple[int, str | None], np.ndarray]
    probes: dict[tuple[int, str | None], int]

    def near(self, key: tuple[int, str | None], v: np.ndarray) -> np.ndarray:
        """List numbers of each vector, nearest first; a width or model that wasn't trained has list 0 only."""
        centres = self.centres.get(key)
        if centres is None:
            return np.zeros((len(v), 1), np.int64)
        return np.argsort(-(_unit(v) @ centres.T), axis=1, kind="stable")

    def nearest(self, key: tuple[int, str | None], v: np.ndarray) -> np.ndarray:
        """The first of ``near``."""
        centres = self.centres.get(key)
        return np.zeros(len(v), np.int64) if centres is None else (_unit(v) @ centres.T).argmax(axis=1)


def train_lists(chunks: DataFrame, k: int = 20, recall: float = 0.95) -> Lists:
    """Lists by spherical k-means over a bounded sample, about the square root of the number of chunks.

    The number of probes is measured: as many lists as hold ``recall`` of the
    exact best ``k`` of trial queries within the sample.
    """
    rows = vectors(chunks.drop("bucket"), "chunk_id")
    groups = {(r["w"], r["model"]): r["n"] for r in rows.groupBy(F.size("v").alias("w"), "model").agg(F.count("*").alias("n")).collect()}
    total = sum(groups.values())
    sample = rows.where(F.pmod(F.xxhash64("id"), F.lit(max(total, 1))) < SAMPLE).orderBy(F.xxhash64("id"), "id").limit(2 * SAMPLE).select("model", "v").collect()
    centres, probes = {}, {}
    for key, n in groups.items():
        own = [r["v"] for r in sample if (len(r["v"]), r["model"]) == key]
        if own:
            x = _unit(np.array(own))
            centres[key] = _k_means(x, int(min(MOST_LISTS, np.sqrt(n), len(x))) or 1)
            probes[key] = _probes_for(x, centres[key], k, recall)
    return Lists(centres, probes)


def _k_means(x: np.ndarray, lists: int, rounds: int = 12) -> np.ndarray:
    centres = x[np.linspace(0, len(x) - 1, lists).astype(int)].copy()
    for _ in range(rounds):
        at = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        used = np.bincount(at, minlength=lists) > 0
        centres[used] = _unit(sums[used])
    return centres


def _probes_for(x: np.ndarray, centres: np.ndarray, k: int, recall: float) -> int:
    trial = x[np.linspace(0, len(x) - 1, min(TRIALS, len(x))).astype(int)]
    best = np.argsort(-(trial @ x.T), axis=1, kind="stable")[:, :k]
    home = (x @ centres.T).argmax(1)
    place = np.argsort(np.argsort(-(trial @ centres.T), axis=1, kind="stable"), axis=1)  # of each list, by nearness
    needed = np.sort(np.take_along_axis(place, home[best], axis=1).ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) + 1


def with_list(chunks: DataFrame, lists: Lists) -> DataFrame:
    """Add ``bucket``, the number of each chunk's nearest list; null without a usable vector."""
    schema = T.StructType([T.StructField("bucket", T.IntegerType()), *chunks.drop("bucket").schema.fields])
    centres, probes = lists.centres, lists.probes

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Lists(centres, probes)
        for batch in (whole.slice(i, SLICE) for whole in batches for i in range(0, whole.num_rows, SLICE)):
            models = batch.column("model").to_pylist() if "model" in batch.schema.names else [None] * batch.num_rows
            bucket: list[int | None] = [None] * batch.num_rows
            groups: dict[tuple, list[int]] = {}
            lists_ = batch.column("embedding").to_pylist()
            for i, v in enumerate(lists_):
                if v and all(y is not None and np.isfinite(y) for y in v):
                    groups.setdefault((len(v), models[i]), []).append(i)
            for key, rows in groups.items():
                for i, b in zip(rows, own.nearest(key, np.array([lists_[i] for i in rows], float)).tolist()):
                    bucket[i] = b
            yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), *batch.columns], schema=pa.schema([("bucket", pa.int32()), *batch.schema]))

    return chunks.drop("bucket").mapInArrow(run, schema)


def nearest_in_lists(queries: DataFrame, indexed: DataFrame, lists: Lists, k: int, metric: str = "cosine") -> tuple[DataFrame, int]:
    """As ``nearest``, looking at each query's nearest lists only, and at more of them until they hold k chunks."""
    parts = _parts(indexed)
    sizes: dict[tuple, dict[int, int]] = {}
    rows = vectors(indexed, "chunk_id")
    for r in rows.groupBy(F.size("v").alias("w"), "model", "list").agg(F.count("*").alias("n")).collect():  # one row per list
        sizes.setdefault((r["w"], r["model"]), {})[r["list"]] = r["n"]
    asked = vectors(queries.drop("bucket"), "query_id")
    centres, probes = lists.centres, lists.probes

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Lists(centres, probes)
        for batch in (whole.slice(i, 8) for whole in batches for i in range(0, whole.num_rows, 8)):
            take, at = [], []
            models = batch.column("model").to_pylist()
            for i, v in enumerate(batch.column("v").to_pylist()):
                key = (len(v), models[i])
                held, sizes_of = 0, sizes.get(key, {})
                for n, b in enumerate(own.near(key, np.array([v]))[0].tolist()):
                    if n >= own.probes.get(key, 1) and held >= k:
                        break
                    held += sizes_of.get(b, 0)
                    if b in sizes_of:
                        take.append(i)
                        at.append(b)
            picked = batch.take(pa.array(take, pa.int64()))
            yield pa.RecordBatch.from_arrays([*picked.select(["id", "model"]).columns, pa.array(at, pa.int32()), picked.column("v")], names=["id", "model", "list", "v"])

    probed = stored(asked.mapInArrow(run, asked.schema), "probes")
    wanted = [r["list"] for r in probed.select("list").distinct().collect()]  # numbers of lists, at most MOST_LISTS
    packed, _ = _query_blocks(probed, parts)
    read = vectors(indexed.where(F.col("bucket").isin(*wanted)), "chunk_id")
    n = asked.count()
    return _ranked(_meet(packed, _packed(read, BLOCK, parts), k, metric), k), n


# -- means ---------------------------------------------------------------------
def means(chunks: DataFrame, by: str) -> DataFrame:
    """(query_id, embedding): the mean vector of each group; tasks sum their own rows first."""
    rows = chunks.select(F.col(by).alias("query_id"), F.col("embedding").cast("array<double>").alias("v")).where(F.size("v") > 0)
    schema = T.StructType([T.StructField("query_id", _type(rows, "query_id")), T.StructField("total", T.ArrayType(T.DoubleType())), T.StructField("n", T.LongType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, list] = {}

        def flush() -> pa.RecordBatch:
            items = list(sums.items())
            sums.clear()
            kind = pa.schema([("query_id", keys.type), ("total", pa.list_(pa.float64())), ("n", pa.int64())])
            return pa.RecordBatch.from_arrays(
                [pa.array([x[0][0] for x in items], keys.type), pa.array([x[1][0] for x in items], pa.list_(pa.float64())), pa.array([x[1][1] for x in items], pa.int64())], schema=kind
            )

        for batch in batches:
            keys = batch.column("query_id")
            for key, v in zip(keys.to_pylist(), batch.column("v").to_pylist()):
                own = sums.get((key, len(v)))
                if own is None:
                    sums[key, len(v)] = [np.array(v), 1]
                else:
                    own[0] += v
                    own[1] += 1
            if len(sums) > 10_000:
                yield flush()
        if sums:
            yield flush()

    parts = rows.mapInArrow(run, schema).select("query_id", F.size("total").alias("w"), "n", F.posexplode("total").alias("i", "x"))
    each = parts.groupBy("query_id", "w", "i").agg((F.sum("x") / F.sum("n")).alias("x"))
    packed = each.groupBy("query_id", "w").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v"))
    return packed.select("query_id", F.col("v.x").alias("embedding"))
