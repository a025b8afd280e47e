"""Structured Streaming forms of the logs, heartbeats and leases.

Every function takes a streaming (or batch) DataFrame and returns one; sinks and checkpoints are the caller's.  Times
are event times.  Rows without a time are dropped by the watermark's filter, rows later than it are dropped as late.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_table(spark: SparkSession, folder: str, like: DataFrame, files_per_trigger: int = 100) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder, with the schema of ``like``."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def recent_notifications(notes: DataFrame, at: str = "created_at", keep: str = "24 hours", key: str = "id") -> DataFrame:
    """Notifications once each (a repeated id within the kept time is dropped)."""
    return notes.where(F.col(at).isNotNull()).withWatermark(at, keep).dropDuplicatesWithinWatermark([key])


def failure_rates(log: DataFrame, at: str, failed: F.Column, late: str = "10 minutes", width: str = "1 hour", slide: str = "5 minutes") -> DataFrame:
    """(start, end, calls, failures, rate) of sliding windows over an operation log."""
    w = log.where(F.col(at).isNotNull()).withWatermark(at, late).groupBy(F.window(at, width, slide).alias("w"))
    rows = w.agg(F.count("*").alias("calls"), F.sum(failed.cast("long")).alias("failures"))
    return rows.select("w.start", "w.end", "calls", "failures", (F.col("failures") / F.col("calls")).alias("rate"))


def agent_sessions(beats: DataFrame, owner: str, at: str, silence: str = "600 seconds", late: str = "10 minutes") -> DataFrame:
    """(owner, started, ended, beats): stretches of heartbeats without a longer silence."""
    s = beats.where(F.col(at).isNotNull() & F.col(owner).isNotNull()).withWatermark(at, late).groupBy(F.session_window(at, silence).alias("w"), owner)
    return s.agg(F.count("*").alias("beats")).select(owner, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "beats")


def leases(requests: DataFrame, key: str, owner: str, at: str, ttl_seconds: int = 300, late: str = "10 minutes") -> DataFrame:
    """(key, owner, at, outcome): requests for leases, each acquired, refreshed, reclaimed or refused.

    The state of a document is its holder and the time of the last grant; it is dropped when the watermark passes the
    lease's end.  Requests of one micro-batch are taken in order of time.
    """
    kinds = dict(requests.dtypes)
    out = f"`{key}` {kinds[key]}, `{owner}` {kinds[owner]}, `{at}` {kinds[at]}, outcome string"

    def replay(name: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        holder, granted = state.get if state.exists else (None, 0.0)
        rows = pd.concat(list(parts)).sort_values([at, owner], kind="stable")
        outcomes = []
        for o, t in zip(rows[owner], rows[at], strict=True):
            now = t.timestamp()
            outcome = "acquired" if holder is None else "refreshed" if o == holder else "reclaimed" if now - granted > ttl_seconds else "refused"
            if outcome != "refused":
                holder, granted = o, now
            outcomes.append(outcome)
        state.update((holder, granted))
        state.setTimeoutTimestamp(max(int((granted + ttl_seconds) * 1000), state.getCurrentWatermarkMs() + 1))
        yield rows.assign(outcome=outcomes)[[key, owner, at, "outcome"]]

    timed = requests.where(F.col(key).isNotNull() & F.col(owner).isNotNull() & F.col(at).isNotNull()).select(key, owner, at).withWatermark(at, late)
    return timed.groupBy(key).applyInPandasWithState(replay, out, "holder string, granted double", "append", GroupStateTimeout.EventTimeTimeout)


def run_to_end(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """All rows of a bounded stream, by running it until its source is exhausted (tests and backfills)."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
