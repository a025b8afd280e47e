"""The registered queries of this sub-package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import frequencies, generated, neighbors, packing, personal, similarity, splitting, terms, tokenizer
from quillgraph.session import materialize
from quillgraph.sources.tables import table


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    """Terms at least as heavy as the lightest case can be, then checked by their counts."""
    chunks = table(spark, root, "chunks")
    n = chunks.select("chunk_id").distinct().where(F.col("chunk_id").isNotNull()).count()
    heavy = terms.log_entropy(chunks, "chunk_id", "content", min_weight=terms.least_weight(3, 6, n))
    # the weight has chosen what is characteristic; the exact counts of the case follow
    return heavy.where((F.col("tf") >= 3) & F.col("df").between(2, 6)).select("chunk_id", "term")


def p1_weights(spark: SparkSession, root: str) -> DataFrame:
    """The weight of every term of every chunk."""
    return terms.log_entropy(table(spark, root, "chunks"), "chunk_id", "content").select("chunk_id", "term", F.round("weight", 6).alias("weight"))


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    links, members = similarity.similar_classes(table(spark, root, "chunks"), "chunk_id", "content", threshold=0.6, shingle=3, min_words=20)
    pairs = similarity.expand_pairs(links, members)
    return pairs.select(F.col("a").alias("chunk_id_a"), F.col("b").alias("chunk_id_b"))


def p3_classes(spark: SparkSession, root: str) -> DataFrame:
    """One row a chunk: its class, the class's copies, and the chunks it is similar to."""
    rows = similarity.class_rows(*similarity.similar_classes(table(spark, root, "chunks"), "chunk_id", "content", threshold=0.6, shingle=3, min_words=20))
    return rows.withColumnRenamed("id", "chunk_id")


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    symbols = table(spark, root, "symbols")
    reference = F.lower(F.trim("role")) == "reference"
    counts = frequencies.value_counts(symbols, "name", "document_path", "id", reference)
    marks = frequencies.marked(counts, frequencies.distinct_records(symbols, "document_path"))
    return marks.where(F.col("mark").isNotNull()).select(F.col("value").alias("name"), "mark")


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents").select("doc_id", "text", "document_path", "lang")
    return generated.not_hand_written(docs).select("doc_id")


def p5_reasons(spark: SparkSession, root: str) -> DataFrame:
    """What speaks for each case: its layout, its folder, its declaration."""
    return generated.reasons(table(spark, root, "documents").select("doc_id", "text", "document_path", "lang"), "doc_id")


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    return splitting.split_oversized(table(spark, root, "chunks"), "chunk_id", "content", "start_pos")


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    found = neighbors.similar_vectors(table(spark, root, "chunk_history"), "chunk_id", "version", "semantic_signature", dim=128, k=15, threshold=0.95)
    return found.select(F.col("a").alias("chunk_id_a"), F.col("b").alias("chunk_id_b"))


def p8_ids(spark: SparkSession, root: str) -> DataFrame:
    return tokenizer.token_ids(table(spark, root, "documents"), "doc_id", "text")


def p9_containers(spark: SparkSession, root: str) -> DataFrame:
    counted = tokenizer.token_counts(table(spark, root, "documents"), "doc_id", "text")
    return packing.containers(counted, "doc_id", "n_tokens")


def p9_filled(spark: SparkSession, root: str) -> DataFrame:
    """How full the containers are: by classes alone (plain), and with gaps filled by classes."""
    counted = materialize(tokenizer.token_counts(table(spark, root, "documents"), "doc_id", "text"), "p9-tokens")
    rows = [packing.filled(packing.containers(counted, "doc_id", "n_tokens", fill=f)).withColumn("packing", F.lit("filled" if f else "plain")) for f in (False, True)]
    return rows[0].unionByName(rows[1])


def p10_found(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents").select("doc_id", "text")
    return personal.listed(personal.mentions(docs, "doc_id", "text", table(spark, root, "people")), "doc_id")


def p10_redacted(spark: SparkSession, root: str) -> DataFrame:
    """Every text with its mentions replaced by typed placeholders."""
    return personal.redacted(table(spark, root, "documents"), "doc_id", "text", table(spark, root, "people"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_weights, p3_found, p3_classes, p4_found, p5_found, p5_reasons, p6_found, p7_found, p8_ids, p9_containers, p9_filled, p10_found, p10_redacted)}


_P1 = """
WITH one AS (SELECT chunk_id, any_value(content) AS content FROM chunks WHERE chunk_id IS NOT NULL GROUP BY chunk_id),
words AS (SELECT chunk_id, lower(unnest(regexp_extract_all(content, '[A-Za-z]{4,}'))) AS term FROM one),
tf AS (SELECT chunk_id, term, count(*) AS tf FROM words GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)
SELECT chunk_id, term FROM tf JOIN df USING (term) WHERE tf >= 3 AND df BETWEEN 2 AND 6
"""

_P1_WEIGHTS = """
WITH one AS (SELECT chunk_id, any_value(content) AS content FROM chunks WHERE chunk_id IS NOT NULL GROUP BY chunk_id),
words AS (SELECT chunk_id, lower(unnest(regexp_extract_all(content, '[A-Za-z]{4,}'))) AS term FROM one),
tf AS (SELECT chunk_id, term, count(*) AS tf FROM words GROUP BY ALL),
st AS (SELECT term, sum(tf) AS gf, ln(sum(tf)) - sum(tf * ln(tf)) / sum(tf) AS h FROM tf GROUP BY term),
n AS (SELECT count(*) AS n FROM one)
SELECT chunk_id, term, round(ln(1 + tf) * CASE WHEN n < 2 THEN 1 ELSE least(1.0, greatest(0.0, 1 - h / ln(n))) END, 6) AS weight FROM tf JOIN st USING (term), n
"""

_P4 = """
WITH one AS (SELECT id, any_value(trim(name)) AS name, any_value(lower(trim(role)) = 'reference') AS ref, any_value(document_path) AS doc
             FROM symbols GROUP BY id),
docs AS (SELECT count(DISTINCT document_path) AS n FROM symbols),
names AS (SELECT name, count(DISTINCT doc) AS d, count(DISTINCT CASE WHEN ref THEN doc END) AS r FROM one WHERE name IS NOT NULL GROUP BY name)
SELECT name, CASE WHEN r >= 0.05 * n AND r > 0 THEN 'common' ELSE 'rare' END AS mark FROM names, docs WHERE (r >= 0.05 * n AND r > 0) OR d = 1
"""


def oracle_sql() -> dict[str, str]:
    return {"p1_found": _P1, "p1_weights": _P1_WEIGHTS, "p4_found": _P4}
