"""Latest phase and share done of each run, in batch and as a stream whose state forgets runs that have ended."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.readwriter import DataStreamWriter

from corpusaudit import dims


def phase_progress(phase: Column) -> Column:
    return F.coalesce(dims.lookup(phase, dims.PHASE_PROGRESS), F.lit(dims.PHASE_PROGRESS_DEFAULT))


def latest_progress(events: DataFrame) -> DataFrame:
    """Last event per run by time and sequence number; the state is one row per run."""
    last = events.groupBy("run_id").agg(
        F.max(F.struct("ts", "seq", "phase", "message")).alias("e"), F.count(F.lit(1)).alias("events")
    )
    return last.select(
        "run_id",
        F.col("e.phase").alias("phase"),
        F.col("e.message").alias("message"),
        phase_progress(F.col("e.phase")).alias("progress"),
        "events",
    )


_LAST = "ts timestamp, seq bigint, phase string, message string, events bigint"


def stream_progress(events: DataFrame, delay: str = "1 day") -> DataStreamWriter:
    """Writer of the changed runs of each micro-batch, with ``ts`` and ``seq`` of their last event; the caller names the sink.

    The state is one row per run that had an event within ``delay`` of the latest
    ``ts`` seen; an older run leaves it. If a run goes on after that, its events
    are counted anew; those that are themselves later than ``delay`` still count.
    """
    run_type = events.schema["run_id"].dataType.simpleString()
    output = f"run_id {run_type}, {_LAST}"
    wait = int(events.sparkSession.sql(f"SELECT CAST(INTERVAL {delay} AS INTERVAL DAY TO SECOND) AS d").first()["d"].total_seconds() * 1000)

    def last(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        best, n = (state.get[:4], state.get[4]) if state.exists else (None, 0)
        for frame in frames:
            n += len(frame)
            for row in frame[["ts", "seq", "phase", "message"]].itertuples(index=False, name=None):
                row = (row[0].to_pydatetime(), int(row[1]), *row[2:])
                if best is None or _order(row) > _order(best):
                    best = row
        state.update((*best, n))
        state.setTimeoutTimestamp(max(int(best[0].timestamp() * 1000), state.getCurrentWatermarkMs()) + wait)
        yield pd.DataFrame([(key[0], *best, n)], columns=["run_id", "ts", "seq", "phase", "message", "events"])

    used = events.select("run_id", F.col("ts").cast("timestamp").alias("ts"), F.col("seq").cast("bigint").alias("seq"), "phase", "message").where("ts IS NOT NULL AND seq IS NOT NULL")
    changed = used.withWatermark("ts", delay).groupBy("run_id").applyInPandasWithState(last, output, _LAST, "update", GroupStateTimeout.EventTimeTimeout)
    shown = changed.withColumn("progress", phase_progress(F.col("phase")))
    return shown.writeStream.outputMode("update")


def _order(row: tuple) -> tuple:
    """As Spark orders (ts, seq, phase, message): a null before any text."""
    return (row[0], row[1], *[(x is not None, x or "") for x in row[2:]])


def latest_of_batches(written: DataFrame) -> DataFrame:
    """The last row of each run among those that ``stream_progress`` wrote, as ``latest_progress`` gives it."""
    last = written.groupBy("run_id").agg(F.max_by(F.struct("phase", "message", "progress", "events"), F.struct("ts", "seq", "events")).alias("e"))
    return last.select("run_id", "e.*")
