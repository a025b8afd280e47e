"""Queries of the chunkers, the fingerprint and symbol extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions import text as T
from quillgraph.operators import chunkers, extraction, features
from quillgraph.plans.base import Book
from quillgraph.plans.store import C, _chunks, _raw
from quillgraph.sources.tables import table

book = Book()


def paragraph_chunks(spark: SparkSession, root: str) -> DataFrame:
    return chunkers.paragraphs(table(spark, root, "documents"), "doc_id", "text")


def sentence_window_chunks(spark: SparkSession, root: str) -> DataFrame:
    return chunkers.sentence_windows(table(spark, root, "documents"), "doc_id", "text")


@book.query()
def code_chunks(spark: SparkSession, root: str) -> DataFrame:
    return chunkers.code(table(spark, root, "documents").where(T.modality("document_path") == "code"), "doc_id", "text", "document_path")


def line_chunks(spark: SparkSession, root: str) -> DataFrame:
    return chunkers.by_lines(table(spark, root, "documents"), "doc_id", "text")


@book.query()
def merged_chunks(spark: SparkSession, root: str) -> DataFrame:
    """Paragraph chunks of all documents, merged where neighbours are similar."""
    d = table(spark, root, "documents").withColumn("key", F.struct("doc_id", T.modality("document_path").alias("modality")))
    c = chunkers.paragraphs(d, "key", "text").withColumn("tokens", T.estimated_tokens("content"))
    rows = c.select(F.col("doc.doc_id").alias("doc"), "chunk_index", "content", "start_pos", "end_pos", "tokens", F.col("doc.modality").alias("modality"))
    return features.merge_similar(rows)


def chunk_fingerprints(spark: SparkSession, root: str) -> DataFrame:
    return features.fingerprints(_raw(spark, root), "chunk_id", "content").dropDuplicates(["chunk_id"])


@book.query()
def extracted_symbols(spark: SparkSession, root: str) -> DataFrame:
    return extraction.extract(_chunks(spark, root), "chunk_id", "content", "document_path")


def _line_rules(language: str) -> str:
    out = []
    for pattern, kind, role, none in extraction.LINE_RULES[language]:
        p = pattern.replace("'", "''")
        skip = f" AND regexp_extract(x, '^(?:{p})', 1) NOT IN ({', '.join(repr(w) for w in none)})" if none else ""
        out.append(f"SELECT doc, regexp_extract(x, '^(?:{p})', 1) AS name, '{kind}' AS kind, '{role}' AS role, i AS line_number FROM x WHERE regexp_extract(x, '^(?:{p})', 1) <> ''{skip}")
    return " UNION ALL ".join(out)


@book.query(f"""WITH {C}, l AS (SELECT chunk_id AS doc, unnest(string_split(regexp_replace(content, '\\r\\n?', chr(10), 'g'), chr(10))) AS l, generate_subscripts(string_split(regexp_replace(content, '\\r\\n?', chr(10), 'g'), chr(10)), 1)::BIGINT AS i FROM c WHERE suffix(document_path, '.go')),
x AS (SELECT doc, i, regexp_replace(l, '^\\s+|\\s+$', '', 'g') AS x FROM l) {_line_rules('go')}""")
def go_symbols(spark: SparkSession, root: str) -> DataFrame:
    docs = _chunks(spark, root).where(F.endswith("document_path", F.lit(".go"))).select(F.col("chunk_id").alias("doc"), F.lit("go").alias("language"), F.col("content").alias("text"))
    return extraction.by_line(docs).drop("container")


_W = "regexp_extract_all(lower(content), '[a-zA-Z_][a-zA-Z0-9_]*')"


def _topic_sql() -> str:
    from quillgraph.functions.embedding import TOPICS

    return ", ".join(
        f"round(greatest(-1.0, least(1.0, ({' + '.join(f'''len(list_filter(w, lambda x: contains(x, '{k}')))''' for k in v.split())}) / greatest(1, len(w)) * 20)), 6) AS {n}" for n, v in TOPICS.items()
    )


@book.query(f"WITH {C}, w AS (SELECT chunk_id, {_W} AS w FROM c WHERE content IS NOT NULL) SELECT chunk_id, {_topic_sql()} FROM w")
def topic_figures(spark: SparkSession, root: str) -> DataFrame:
    """The topic figures of every chunk."""
    from quillgraph.functions import embedding

    rows = _raw(spark, root).where(F.col("content").isNotNull()).select("chunk_id", embedding.figures("content").alias("f")).dropDuplicates(["chunk_id"])
    return rows.select("chunk_id", *[F.round(F.col(f"f.{t}"), 6).alias(t) for t in embedding.TOPICS])
