"""The relational store: versions, snapshots, sessions, annotations, logs and their retention, as DataFrame steps.

Time is always an argument, never the clock.  Every function keeps the columns it is not told about out of its result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert_versions(current: DataFrame, incoming: DataFrame, key: str, payload: list[str]) -> DataFrame:
    """(key, version, payload..., replaced): a known key gets the next version, a new one version 1, others stay.

    ``replaced`` marks rows whose old version moves to the history.  A key with null in ``incoming`` is left out.
    """
    inc = incoming.where(F.col(key).isNotNull()).dropDuplicates([key]).select(F.col(key).alias("_k"), *[F.col(p).alias(f"_n_{p}") for p in payload], F.lit(True).alias("_in"))
    met = current.select(key, "version", *payload).join(inc, F.col(key) == F.col("_k"), "full")
    new = F.coalesce(F.col("_in"), F.lit(False))
    return met.select(
        F.coalesce(F.col(key), F.col("_k")).alias(key),
        F.when(new, F.coalesce(F.col("version"), F.lit(0)) + 1).otherwise(F.col("version")).cast("long").alias("version"),
        *[F.when(new, F.col(f"_n_{p}")).otherwise(F.col(p)).alias(p) for p in payload],
        (new & F.col(key).isNotNull()).alias("replaced"),
    )


def snapshot_diff(stored: DataFrame, seen: DataFrame, key: str, version: str) -> DataFrame:
    """(key, status): unchanged, modified, new or removed; a null version on either side counts as modified."""
    a = stored.select(F.col(key).alias("_a"), F.col(version).alias("_va"))
    b = seen.select(F.col(key).alias("_b"), F.col(version).alias("_vb"))
    met = a.join(b, F.col("_a") == F.col("_b"), "full")
    status = F.when(F.col("_a").isNull(), "new").when(F.col("_b").isNull(), "removed").when(F.col("_va") == F.col("_vb"), "unchanged").otherwise("modified")
    return met.select(F.coalesce("_a", "_b").alias(key), status.alias("status"))


def newest(rows: DataFrame, order: list[Column], keep: int) -> DataFrame:
    """The newest ``keep`` rows of the whole table (a top-k, not a global sort)."""
    return rows.orderBy(*order).limit(keep)


def newest_per(rows: DataFrame, partition: list[str], order: list[Column], keep: int) -> DataFrame:
    w = Window.partitionBy(*partition).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= keep).drop("_r")


def since(rows: DataFrame, time: str, cutoff: Column) -> DataFrame:
    """Rows not older than the cutoff; rows without a time stay."""
    return rows.where(F.col(time).isNull() | (F.col(time) >= cutoff))


def prune_to_budget(rows: DataFrame, partition: str, cost: str, rank: list[Column], budget: int) -> DataFrame:
    """Adds ``kept``: within a partition the least relevant rows go until the total fits the budget.

    ``rank`` orders from the least relevant on; a row goes if the total less all rows before it still exceeds the budget.
    """
    w = Window.partitionBy(partition)
    before = F.coalesce(F.sum(cost).over(w.orderBy(*rank).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("kept", F.sum(cost).over(w) - before <= budget)


def annotation_search(annotations: DataFrame, like: str) -> DataFrame:
    """Annotations whose content is like the pattern, whatever its letters' case (per cent and underscore are wild)."""
    return annotations.where(F.col("content").ilike(f"%{like}%"))


def with_any_tag(annotations: DataFrame, tags: list[str]) -> DataFrame:
    return annotations.where(F.arrays_overlap("tags", F.array(*map(F.lit, tags))))


def lock_states(log: DataFrame, now: Column, key: str = "document_path", owner: str = "agent_id", at: str = "locked_at", ttl: str = "lock_ttl") -> DataFrame:
    """(key, owner, locked_at, state): the last lock on each document, expired after its time to live."""
    last = log.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(owner, at, ttl), F.struct(at, owner)).alias("l"))
    held = F.unix_timestamp(now) - F.unix_timestamp(f"l.{at}") <= F.col(f"l.{ttl}")
    return last.select(key, F.col(f"l.{owner}").alias(owner), F.col(f"l.{at}").alias(at), F.when(held, "locked").otherwise("expired").alias("state"))


def compare_and_set(documents: DataFrame, requests: DataFrame, key: str = "document_path", version: str = "doc_version") -> DataFrame:
    """(key, expected, actual, granted, new_version): optimistic version checks; a missing document is refused."""
    d = documents.select(F.col(key).alias("_k"), F.col(version).alias("actual"))
    met = requests.select(key, "expected").join(d, F.col(key) == F.col("_k"), "left")
    ok = F.coalesce(F.col("expected") == F.col("actual"), F.lit(False))
    return met.select(key, "expected", "actual", ok.alias("granted"), F.when(ok, F.col("actual") + 1).otherwise(F.col("actual")).alias("new_version"))


def agents(heartbeats: DataFrame, now: Column, stale_seconds: int = 600, owner: str = "agent_id", at: str = "created_at") -> DataFrame:
    """(owner, first_seen, last_seen, stale)."""
    a = heartbeats.where(F.col(owner).isNotNull()).groupBy(owner).agg(F.min(at).alias("first_seen"), F.max(at).alias("last_seen"))
    return a.withColumn("stale", F.unix_timestamp(now) - F.unix_timestamp("last_seen") > stale_seconds)
