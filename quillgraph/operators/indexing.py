"""Incremental indexing: which files have to be read, which chunks are what they were, and which signatures can be kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.config import EngineConfig
from quillgraph.operators.vectors import cosine, nearest_batch
from quillgraph.session import materialize


def index_plan(seen: DataFrame, stored: DataFrame, locks: DataFrame, agent: str | Column) -> DataFrame:
    """(path, step) of every seen file: locked, conflict, same_file, same_content, modified or new.

    ``seen`` is (path, modified, length, hash, expected_version), ``stored`` (path, modified, length, hash, version),
    ``locks`` (path, owner) of live locks.  A file locked by another agent is left alone; one whose stored version is not the
    expected one is in conflict (a null expectation expects nothing); time and size decide before the hash, and a stored row
    without a size decides nothing.  Files of the last two steps have to be chunked, and only these.
    """
    s = stored.select("path", F.col("modified").alias("_m"), F.col("length").alias("_l"), F.col("hash").alias("_h"), F.col("version").alias("_v"), F.lit(True).alias("_in"))
    rows = seen.join(s, "path", "left").join(locks.select("path", "owner"), "path", "left")
    same = lambda a, b: F.coalesce(F.col(a) == F.col(b), F.lit(False))
    step = (
        F.when(F.coalesce(F.col("owner") != agent, F.lit(False)), "locked")
        .when(F.coalesce(F.col("expected_version") != F.col("_v"), F.lit(False)), "conflict")
        .when(F.col("_in").isNull(), "new")
        .when(same("modified", "_m") & same("length", "_l"), "same_file")
        .when(same("hash", "_h"), "same_content")
        .otherwise("modified")
    )
    return rows.select("path", step.alias("step"))


def stored_documents(stored: DataFrame, incoming: DataFrame, key: str, payload: list[str], kept: list[str]) -> DataFrame:
    """The documents after an upsert: the payload is replaced, the columns ``kept`` (locks, versions) stay as they are; new rows have them null."""
    i = incoming.where(F.col(key).isNotNull()).dropDuplicates([key]).select(F.col(key).alias("_k"), *[F.col(p).alias(f"_n_{p}") for p in payload], F.lit(True).alias("_in"))
    met = stored.select(key, *payload, *kept).join(i, F.col(key) == F.col("_k"), "full")
    return met.select(F.coalesce(key, "_k").alias(key), *[F.when(F.col("_in"), F.col(f"_n_{p}")).otherwise(F.col(p)).alias(p) for p in payload], *kept)


def cached_signatures(chunks: DataFrame, cache: DataFrame) -> DataFrame:
    """(chunk_id, content_hash, signature): signatures known by their content's hash, null where it has to be computed.

    ``chunks`` is (chunk_id, content_hash), ``cache`` (content_hash, signature); of several signatures of one content any serves.
    """
    c = cache.where(F.col("content_hash").isNotNull() & F.col("signature").isNotNull()).groupBy("content_hash").agg(F.min("signature").alias("signature"))
    return chunks.join(c, "content_hash", "left").select("chunk_id", "content_hash", "signature")


def removed_ids(old: DataFrame, new: DataFrame) -> DataFrame:
    """The chunk ids that a file had and has no more."""
    return old.select("chunk_id").distinct().join(new.select("chunk_id").distinct(), "chunk_id", "left_anti")


def chunk_changes(new: DataFrame, old: DataFrame, dim: int = 128, by_modality: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """(chunk_id, class) of the new chunks of files: restored, reprocessed or new.

    Both sides are (chunk_id, path, start_pos, end_pos, content_hash, signature), ``new`` with modality.  A chunk at the place
    of an old one is restored if the hash is the same or the signatures' cosine reaches the modality's change threshold, else
    reprocessed.  One at no old place is compared with the nearest of all old signatures: restored if that is near enough,
    else new.
    """
    limits = EngineConfig.BY_MODALITY if by_modality is None else by_modality
    least: Column = F.lit(EngineConfig.change_threshold)
    for name, (_, change) in limits.items():
        least = F.when(F.col("modality") == name, change).otherwise(least)
    place = ["path", "start_pos", "end_pos"]
    old = materialize(old.select("chunk_id", *place, "content_hash", "signature"), "old")
    o = old.select(*place, F.col("content_hash").alias("_h"), F.col("signature").alias("_s"), F.lit(True).alias("_in")).dropDuplicates(place)
    met = materialize(new.withColumn("_least", least).join(o, place, "left"), "met")
    near = F.coalesce(cosine(F.col("signature"), F.col("_s")) >= F.col("_least"), F.lit(False))
    at_place = met.where("_in").select("chunk_id", F.when((F.col("content_hash") == F.col("_h")) | near, "restored").otherwise("reprocessed").alias("class"))
    lost = met.where("_in IS NULL").select("chunk_id", "signature", "_least")
    best = nearest_batch(lost, old.select("chunk_id", "signature"), "chunk_id", "signature", dim, 1).select(F.col("query_id").alias("chunk_id"), "similarity")
    elsewhere = lost.join(best, "chunk_id", "left").select("chunk_id", F.when(F.col("similarity") >= F.col("_least"), "restored").otherwise("new").alias("class"))
    return at_place.unionByName(elsewhere)


def capped(rows: DataFrame, kind: str, order: list[str], most: int = 200) -> tuple[DataFrame, DataFrame]:
    """(rows, totals): the first ``most`` rows of each kind, and how many there are of each (the cap is the report's, the totals are whole)."""
    from pyspark.sql import Window

    r = rows.withColumn("_r", F.row_number().over(Window.partitionBy(kind).orderBy(*order))).where(F.col("_r") <= most).drop("_r")
    return r, rows.groupBy(kind).agg(F.count("*").alias("total"))
