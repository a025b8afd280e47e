"""Notes, annotations, change history and the operation log: creation, change, removal, search and retention.

Each step gives the table as it is afterwards; nothing is changed in place.  Time is always an argument.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KINDS = ("unchanged", "removed", "modified", "new")


def where_all(rows: DataFrame, **wanted: Column | str | int | None) -> DataFrame:
    """The rows that agree in every given column; a condition that is None is no condition."""
    given = [F.col(c) == v for c, v in wanted.items() if v is not None]
    return rows.where(reduce(lambda a, b: a & b, given, F.lit(True)))


def annotations_of(annotations: DataFrame, target: str | None = None, target_type: str | None = None, tags: list[str] | None = None) -> DataFrame:
    """Annotations by target, kind of target and any of some tags."""
    rows = where_all(annotations, target=target, target_type=target_type)
    return rows.where(F.arrays_overlap("tags", F.array(*map(F.lit, tags)))) if tags else rows


def created(table: DataFrame, new: DataFrame, now: Column, order: list[str]) -> DataFrame:
    """``table`` with the new rows (target, target_type, content, tags), numbered on from its highest id in the given order.

    The new rows are one call's, so they are numbered in one window; a kind of target beyond document and chunk is refused.
    """
    top = table.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).scalar()
    ok = new.where(F.col("target_type").isin("document", "chunk") & F.col("target").isNotNull() & F.col("content").isNotNull())
    number = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order))
    rows = ok.select((top + number).cast("long").alias("id"), "target", "target_type", "content", "tags", now.alias("created_at"), now.alias("updated_at"))
    return table.select(rows.columns).unionByName(rows)


def updated(table: DataFrame, changes: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(table, missing): contents and tags replaced where given; ids that are not there are reported.

    ``changes`` is (id, content, tags), an id once; a null keeps what is there.
    """
    c = changes.where(F.col("id").isNotNull()).dropDuplicates(["id"]).select("id", F.col("content").alias("_c"), F.col("tags").alias("_t"), F.lit(True).alias("_hit"))
    met = table.join(c, "id", "left")
    rows = met.select(*[
        F.coalesce("_c", "content").alias(n) if n == "content" else F.coalesce("_t", "tags").alias(n) if n == "tags" else F.when(F.col("_hit"), now).otherwise(F.col(n)).alias(n) if n == "updated_at" else F.col(n) for n in table.columns
    ])
    return rows, c.join(table.select("id"), "id", "left_anti").select("id")


def deleted(table: DataFrame, ids: DataFrame) -> DataFrame:
    return table.join(ids.select("id").distinct(), "id", "left_anti")


def with_values(table: DataFrame, values: DataFrame, key: str, column: str) -> DataFrame:
    """``table`` with ``column`` replaced by that of ``values`` where the key is there; a null there clears it.  For notes and staleness."""
    v = values.where(F.col(key).isNotNull()).dropDuplicates([key]).select(F.col(key).alias("_k"), F.col(column).alias("_v"), F.lit(True).alias("_hit"))
    met = table.join(v, F.col(key) == F.col("_k"), "left")
    return met.select(*[F.when(F.col("_hit"), F.col("_v")).otherwise(F.col(c)).alias(c) if c == column else F.col(c) for c in table.columns])


def history_of(history: DataFrame, path: str | Column) -> DataFrame:
    """The change records that name a file, reduced to it: (id, timestamp, modified, new, removed, unchanged flags, totals).

    ``history`` has id, timestamp and, for each of KINDS, an array of paths (null: none).
    """
    path = F.lit(path) if isinstance(path, str) else path
    named = {k: F.coalesce(F.array_contains(k, path), F.lit(False)) for k in KINDS}
    rows = history.where(reduce(lambda a, b: a | b, named.values()))
    totals = F.struct(*[F.greatest(F.coalesce(F.size(k), F.lit(0)), F.lit(0)).cast("long").alias(k) for k in KINDS])
    return rows.select("id", "timestamp", *[c.alias(k) for k, c in named.items()], totals.alias("totals"))


def retained(rows: DataFrame, at: str, key: str, cutoff: Column | None = None, keep: int | None = None) -> DataFrame:
    """Rows not older than the cutoff, and of these the newest ``keep``; rows without a time are older than all."""
    out = rows if cutoff is None else rows.where(F.col(at) >= cutoff)
    return out if keep is None else out.orderBy(F.col(at).desc_nulls_last(), F.desc(key)).limit(keep)


def operation_log(log: DataFrame, tool: str | None = None, since: Column | None = None, limit: int | None = None) -> DataFrame:
    """(id, tool_name, success, duration_ms, at) newest first."""
    rows = where_all(log, tool_name=tool)
    rows = rows if since is None else rows.where(F.col("at") >= since)
    return rows if limit is None else rows.orderBy(F.col("at").desc_nulls_last(), F.desc("id")).limit(limit)


def failure_rates(log: DataFrame, now: Column, seconds: int = 3600) -> DataFrame:
    """One row: total, failures, rate and action of the operations within ``seconds`` before ``now``."""
    recent = log.where((F.col("at") <= now) & (F.unix_timestamp(now) - F.unix_timestamp("at") <= seconds))
    row = recent.agg(F.count("*").alias("total"), F.count_if(~F.coalesce("success", F.lit(False))).alias("failures"))
    rate = F.coalesce(F.try_divide("failures", "total"), F.lit(0.0))
    action = F.when(rate < 0.01, "idle").when(rate < 0.1, "vacuum").otherwise("rebuild_symbols")
    return row.select("total", "failures", F.round(rate, 6).alias("rate"), action.alias("action"))


def index_health(documents: int | Column, chunks: int | Column, symbols: int | Column, latest: Column, now: Column, one: DataFrame) -> DataFrame:
    """One row: statuses of the stores and what to do about them; an index older than seven days is called stale.  ``one`` is a row with what the columns refer to."""
    as_col = lambda x: F.lit(x) if isinstance(x, int) else x
    d, c, s = map(as_col, (documents, chunks, symbols))
    age = F.unix_timestamp(now) - F.unix_timestamp(latest)
    alerts = F.array_compact(F.array(
        F.when(d == 0, "no_documents"), F.when((c > 0) & (s == 0), "symbols_missing"), F.when((d > 0) & (age > 7 * 86400), F.concat(F.lit("stale_days_"), F.floor(age / 86400).cast("string")))
    ))
    return one.select(
        F.when(s > 0, "ready").when(c > 0, "empty_with_chunks").otherwise("empty").alias("symbol_status"), F.when(c > 0, "ready").when(d > 0, "empty_with_documents").otherwise("empty").alias("chunk_status"), age.cast("long").alias("age_seconds"), alerts.alias("alerts")
    )
