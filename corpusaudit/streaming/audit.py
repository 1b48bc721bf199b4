"""Audit of files as they arrive; each content is analysed once.

Two streams read the files. One appends every file with the key of its content.
The other drops contents that arrive again within ``delay`` by keys in its state,
which leave it when the watermark has passed them, so the state is as large as
what arrives in that time. What is left is looked up by key, in the analyses of
earlier batches and in a given cache, of which only the parts that a batch's keys
fall in are read; what neither holds is analysed. The analyses are a cache
themselves, in the form that batch runs read and merge. A file that occurs in
several repositories is analysed once and has a result in each.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from corpusaudit.operators import analysis
from corpusaudit.operators.cache import look_up, missing, newest_payloads, with_cache_key, write_cache
from corpusaudit.operators.grouping import file_key

CACHE = "cache_key string, payload string, created_at bigint, batch_id bigint, key_part string"
#: How long a content's key is remembered in the state.
DELAY = "1 hour"
_PAYLOAD = "patterns array<struct<pattern_type:string,severity:string>>, overall_priority string, modernization_score double, requires_modernization boolean"


class Audit:
    """The two running streams."""

    def __init__(self, queries: list[StreamingQuery]):
        self.queries = queries

    def awaitTermination(self) -> None:  # noqa: N802 - as a stream's own
        for query in self.queries:
            query.awaitTermination()


def payloads(files: DataFrame) -> DataFrame:
    """(cache_key, payload): the analyses of files (cache_key, file_path, content) as a cache stores them."""
    done = analysis.analyse_files(files)
    fields = ["patterns", "overall_priority", "modernization_score", "requires_modernization"]
    return done.select("cache_key", F.to_json(F.struct(*fields)).alias("payload"))


def analyse_batch(files: DataFrame, batch_id: int, out: str, cache: DataFrame | str | None = None) -> None:
    """Analyse the new contents of one micro-batch that neither ``cache`` nor an earlier batch holds.

    ``cache`` is a table, or the path of one that ``write_cache`` stored. A batch
    writes its own folder and replaces it when it is run again, so a restart
    after a lost executor or driver gives the same table.
    """
    spark = files.sparkSession
    fresh = files
    if isinstance(cache, str):
        fresh = missing(fresh, look_up(spark.read.parquet(cache), fresh))
    elif cache is not None:
        fresh = missing(fresh, cache)
    earlier = _analysed(spark, out)
    if earlier is not None:
        fresh = missing(fresh, look_up(earlier.where(F.col("batch_id") < batch_id), fresh))
    made = payloads(fresh.select("cache_key", "file_path", "content")).withColumn("created_at", F.lit(batch_id).cast("bigint"))
    write_cache(made, f"{out}/cache/batch_id={batch_id}", mode="overwrite")


def _analysed(spark: SparkSession, out: str) -> DataFrame | None:
    """What the stream's batches have analysed, by batch and part; nothing before the first."""
    try:
        return spark.read.schema(CACHE).parquet(f"{out}/cache")
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def stream_audit(
    files: DataFrame, out: str, checkpoint: str, cache: DataFrame | str | None = None, delay: str = DELAY, arrived: str | None = None
) -> Audit:
    """Start the audit of a streaming DataFrame (file_path, content, repo if there are several) and take all that is there.

    ``cache`` has cache_key, payload and created_at, as batch runs store it, or
    is the path of a stored one. ``arrived`` names a timestamp of the files; it
    drives the watermark, ``delay`` behind the latest one, and a file that is
    later still isn't analysed (``unanalysed`` lists such files). By default the
    time of the batch counts, and no file is late.
    """
    keyed = with_cache_key(files)
    log = keyed.select(*file_key(files), "cache_key").writeStream.format("parquet").option("path", f"{out}/files").option("checkpointLocation", f"{checkpoint}/files")
    timed = keyed.select("cache_key", "file_path", "content", (F.col(arrived) if arrived else F.current_timestamp()).cast("timestamp").alias("arrived"))
    contents = timed.withWatermark("arrived", delay).dropDuplicatesWithinWatermark(["cache_key"]).drop("arrived")
    analyses = contents.writeStream.foreachBatch(lambda batch, batch_id: analyse_batch(batch, batch_id, out, cache)).option(
        "checkpointLocation", f"{checkpoint}/analyses"
    )
    return Audit([log.trigger(availableNow=True).start(), analyses.trigger(availableNow=True).start()])


def read_cache(spark: SparkSession, out: str) -> DataFrame:
    """The analyses that the stream made, for ``cached_split`` and ``merge_cache``."""
    return spark.read.schema(CACHE).parquet(f"{out}/cache").drop("batch_id", "key_part")


def unanalysed(spark: SparkSession, out: str, cache: DataFrame | None = None) -> DataFrame:
    """The files that arrived and have no analysis, in the stream's cache or the given one: those that came too late."""
    known = read_cache(spark, out).select("cache_key")
    known = known if cache is None else known.unionByName(cache.select("cache_key"))
    return spark.read.parquet(f"{out}/files").distinct().join(known, "cache_key", "left_anti")


def read_results(spark: SparkSession, out: str, cache: DataFrame | None = None) -> DataFrame:
    """One row per file that arrived, with the summary of its content's analysis, from the stream's cache or the given one."""
    known = read_cache(spark, out)
    if cache is not None:
        known = known.unionByName(cache.select("cache_key", "payload", F.col("created_at").cast("bigint")))
    arrived = spark.read.parquet(f"{out}/files").distinct()
    joined = arrived.join(newest_payloads(known), "cache_key").withColumn("a", F.from_json("payload", _PAYLOAD))
    return joined.select(
        *file_key(arrived), "cache_key", "a.overall_priority", "a.modernization_score", "a.requires_modernization",
        F.size("a.patterns").cast("bigint").alias("n_patterns"),
    )
