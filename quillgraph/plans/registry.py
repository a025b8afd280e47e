"""All registered queries of the core, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillgraph.operators import incremental
from quillgraph.plans import agents, answers, compose, graph, ingest, retrieval, store
from quillgraph.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    """Documents that the next run has to process; see ``operators.incremental``."""
    docs = table(spark, root, "documents").select("doc_id", "text", "content_hash", "indexed_at")
    return incremental.documents_to_process(docs, table(spark, root, "index_runs")).select("doc_id")


P2_SQL = r"""
WITH r AS (SELECT run_id, min(started_at) AS since, bool_or(coalesce(lower(trim(status)) = 'success', false)) AS ok
           FROM index_runs WHERE started_at IS NOT NULL GROUP BY run_id),
s AS (SELECT since, arg_max(ok, coalesce(run_id, -1)) AS ok FROM r GROUP BY since),
spans AS (SELECT since, lead(since) OVER (ORDER BY since) AS until, ok FROM s)
SELECT doc_id FROM documents d
LEFT JOIN spans ON d.indexed_at >= spans.since AND (spans.until IS NULL OR d.indexed_at < spans.until)
WHERE NOT coalesce(ok AND sha256(coalesce(text, ''))
    = lower(regexp_replace(regexp_replace(content_hash, '^\s*([A-Za-z][A-Za-z0-9_/-]*\s*:)?\s*', ''), '\s+$', '')), false)
"""


BOOKS = [retrieval.book, graph.book, store.book, ingest.book, compose.book, agents.book, answers.book]


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    for b in BOOKS:
        out |= b.queries
    return out | {"p2_found": p2_found}


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for b in BOOKS:
        out |= b.sql
    return out | {"p2_found": P2_SQL}
