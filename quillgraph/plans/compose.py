"""Queries of the composed operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions import text as T
from quillgraph.operators import bm25, compose
from quillgraph.operators import symbols as S
from quillgraph.operators.incremental import normal_hash, text_hash
from quillgraph.plans.base import Book
from quillgraph.plans.graph import GRAPH
from quillgraph.plans.retrieval import _PRESENT, QUERY, SCORED, TERMS
from quillgraph.plans.retrieval import _chunks as _content
from quillgraph.plans.retrieval import _index
from quillgraph.plans.store import _raw
from quillgraph.sources.tables import table

book = Book()


@book.query(f"""WITH {SCORED}, {GRAPH}, h AS (SELECT id AS chunk_id FROM scored ORDER BY score DESC, id LIMIT 10)
SELECT chunk_id, coalesce((SELECT list_sort(list(DISTINCT symbol_name)) FROM edges WHERE source_chunk_id = chunk_id), []) AS depends_on,
coalesce((SELECT list_sort(list(DISTINCT symbol_name)) FROM edges WHERE target_chunk_id = chunk_id), []) AS depended_on_by FROM h""")
def search_with_edges(spark: SparkSession, root: str) -> DataFrame:
    """The best chunks with the symbols that tie them to others."""
    hits = bm25.top(_index(spark, root).scores(QUERY), 10).select(F.col("id").alias("chunk_id"))
    return compose.attach_edges(hits, S.resolve(table(spark, root, "symbols")))


_AT = ", ".join(f"instr(lower(content), '{t}') - 1" for t in TERMS)


@book.query(f"""WITH {SCORED}, h AS (SELECT id, round(score, 6) AS score FROM scored ORDER BY scored.score DESC, id LIMIT 20),
p AS (SELECT id, score, content, [{_AT}] AS pos FROM h JOIN c ON c.chunk_id = id), f AS (SELECT *, list_filter(pos, lambda x: x >= 0) AS found, ({_PRESENT})::DOUBLE AS present FROM p),
g AS (SELECT id, score, CASE WHEN len(found) = 0 THEN 0 ELSE 0.4 * present / {max(sum(min(len(t) / 8, 1.0) for t in TERMS), 1.0)} + 0.3 * (1 - least(list_min(found) / length(content), 1.0)) + 0.3 * (1 - least((list_max(found) - list_min(found)) / 1000.0, 1.0)) END AS near FROM f)
SELECT id AS chunk_id, round(CASE WHEN near > 0 THEN round(score * 0.65 + near * 0.35, 6) ELSE score END, 5) AS score FROM g ORDER BY CASE WHEN near > 0 THEN round(score * 0.65 + near * 0.35, 6) ELSE score END DESC, id LIMIT 10""")
def proximity_rerank(spark: SparkSession, root: str) -> DataFrame:
    c = _content(spark, root)
    hits = bm25.top(_index(spark, root).scores(QUERY), 20).withColumn("score", F.round("score", 6))
    rows = hits.join(c.select(F.col("chunk_id").alias("id"), "content"), "id")
    return compose.rerank(rows, "content", TERMS, 10).select(F.col("id").alias("chunk_id"), F.round("score", 5).alias("score"))


IDENTIFIERS = ["load_chunk", "Load_Bucket", "SchemaError"]


@book.query(f"""WITH {SCORED}, h AS (SELECT id AS chunk_id, score FROM scored ORDER BY score DESC, id LIMIT 10),
d AS (SELECT DISTINCT ON (id) id, trim(name) AS name, lower(trim(role)) AS role, chunk_id, document_path FROM symbols)
SELECT chunk_id, arg_min(name, id) AS symbol, round((SELECT coalesce(min(score), 0.1) FROM h) * 0.85, 4) AS score FROM d
WHERE role = 'definition' AND document_path IS NOT NULL AND lower(name) IN ('load_chunk', 'load_bucket', 'schemaerror') AND chunk_id NOT IN (SELECT chunk_id FROM h) AND chunk_id IN (SELECT chunk_id FROM c) GROUP BY chunk_id""")
def symbol_boost(spark: SparkSession, root: str) -> DataFrame:
    c = _content(spark, root)
    ranked = bm25.top(_index(spark, root).scores(QUERY), 10).select(F.col("id").alias("chunk_id"), "score")
    return compose.symbol_boost(ranked, S.cleaned(table(spark, root, "symbols")), IDENTIFIERS, c)


@book.query(f"""WITH {SCORED}, k AS (SELECT id AS chunk_id, row_number() OVER (ORDER BY score DESC, id) AS pos FROM scored ORDER BY score DESC, id LIMIT 10),
d AS (SELECT DISTINCT ON (id) id, trim(name) AS name, lower(trim(role)) AS role, chunk_id, document_path FROM symbols),
s AS (SELECT chunk_id, min(id) AS pos FROM d WHERE role IS NOT NULL AND chunk_id IS NOT NULL AND document_path IS NOT NULL AND name = 'clamp_range' GROUP BY 1),
g AS (SELECT chunk_id, start_pos AS pos FROM c WHERE contains(content, 'clamp_range(')),
u AS (SELECT chunk_id, pos, 0 AS s, 'keyword' AS source FROM k UNION ALL SELECT chunk_id, pos, 1, 'symbol' FROM s UNION ALL SELECT chunk_id, pos, 2, 'text' FROM g),
b AS (SELECT chunk_id, arg_min(source, struct_pack(s, pos)) AS source, min(struct_pack(s, pos)) AS o FROM u GROUP BY chunk_id)
SELECT chunk_id, source FROM b ORDER BY o, chunk_id LIMIT 50""")
def combined_search(spark: SparkSession, root: str) -> DataFrame:
    """Keyword hits, then chunks with a symbol, then chunks with a text; each chunk once."""
    c = _content(spark, root)
    hits = bm25.top(_index(spark, root).scores(QUERY), 10)
    from pyspark.sql import Window

    k = hits.select(F.col("id").alias("chunk_id"), F.row_number().over(Window.orderBy(F.desc("score"), "id")).cast("long").alias("pos"))  # ten rows
    s = S.cleaned(table(spark, root, "symbols")).where("name = 'clamp_range'").groupBy("chunk_id").agg(F.min("id").alias("pos"))
    g = c.where(F.contains("content", F.lit("clamp_range("))).select("chunk_id", F.col("start_pos").alias("pos"))
    return compose.first_sources([("keyword", k), ("symbol", s), ("text", g)], 50)


_NORMAL = "lower(regexp_replace(regexp_replace(content_hash, '^\\s*([A-Za-z][A-Za-z0-9_/-]*\\s*:)?\\s*', ''), '\\s+$', ''))"


@book.query(f"""WITH one AS (SELECT document_path AS path, arg_min(text, doc_id) AS text, arg_min(content_hash, doc_id) AS content_hash, arg_min(indexed_at IS NOT NULL, doc_id) AS known, min(doc_id) AS id FROM
 (SELECT doc_id, document_path, coalesce(text, '') AS text, coalesce({_NORMAL}, '') AS content_hash, indexed_at FROM documents WHERE document_path IS NOT NULL) GROUP BY 1),
w AS (SELECT document_path AS path, max(staleness_score) AS w FROM chunks GROUP BY 1)
SELECT path, CASE WHEN NOT known THEN 'new' WHEN content_hash = sha256(text) THEN 'unchanged' ELSE 'changed' END AS status, coalesce(w, 0) >= 0.3 AS stale FROM one LEFT JOIN w USING (path)""")
def file_context(spark: SparkSession, root: str) -> DataFrame:
    """Every file: unchanged, changed or new, and whether it looks stale."""
    d = table(spark, root, "documents").where(F.col("document_path").isNotNull())
    one = d.groupBy(F.col("document_path").alias("path")).agg(F.min_by(F.struct(text_hash("text").alias("now"), F.coalesce(normal_hash("content_hash"), F.lit("")).alias("was"), F.col("indexed_at").isNotNull().alias("known")), "doc_id").alias("r"))
    stale = table(spark, root, "chunks").select(F.col("document_path").alias("path"), F.col("staleness_score").alias("score"))
    return compose.file_context(one, one.where("r.known").select("path", F.col("r.was").alias("hash")), one.select("path", F.col("r.now").alias("hash")), stale)


@book.query("""WITH v AS (SELECT DISTINCT ON (chunk_id, version) chunk_id, version, content_hash, semantic_signature AS s FROM chunk_history),
l AS (SELECT *, lag(version) OVER w AS v0, lag(content_hash) OVER w AS h0, lag(s) OVER w AS s0, max(version) OVER (PARTITION BY chunk_id) AS m FROM v WINDOW w AS (PARTITION BY chunk_id ORDER BY version)),
k AS (SELECT *, CASE WHEN len(s) = len(s0) AND list_sum(list_transform(s, lambda x: x * x)) > 0 AND list_sum(list_transform(s0, lambda x: x * x)) > 0 THEN list_cosine_similarity(s::DOUBLE[], s0::DOUBLE[]) END AS near FROM l WHERE version = m)
SELECT chunk_id, CASE WHEN v0 IS NULL THEN 'new' WHEN content_hash = h0 OR (near >= 0.85 AND NOT isnan(near)) THEN 'restored' ELSE 'reprocessed' END AS class FROM k""")
def change_classes(spark: SparkSession, root: str) -> DataFrame:
    """What each chunk's newest version is to the one before."""
    return compose.change_classes(table(spark, root, "chunk_history"))


@book.query(f"""WITH p AS (SELECT min(document_path) AS p FROM chunks), ids AS (SELECT chunk_id FROM chunks, p WHERE document_path = p)
SELECT 'documents' AS name, count(*)::BIGINT AS rows_left FROM documents, p WHERE document_path IS DISTINCT FROM p
UNION ALL SELECT 'chunks', count(*) FROM chunks, p WHERE document_path IS DISTINCT FROM p UNION ALL SELECT 'symbols', count(*) FROM symbols, p WHERE document_path IS DISTINCT FROM p
UNION ALL SELECT 'chunk_history', count(*) FROM chunk_history WHERE chunk_id NOT IN (SELECT chunk_id FROM ids WHERE chunk_id IS NOT NULL)""")
def removal_cascade(spark: SparkSession, root: str) -> DataFrame:
    """What is left of each table when one file is removed."""
    tables = {n: table(spark, root, n) for n in ("documents", "chunks", "symbols", "chunk_history")}
    path = tables["chunks"].agg(F.min("document_path")).scalar()
    left = compose.without_document(tables, path, tables["chunks"].where(F.col("document_path") == path))
    out = None
    for n, t in left.items():
        one = t.agg(F.count("*").alias("rows_left")).select(F.lit(n).alias("name"), "rows_left")
        out = one if out is None else out.unionByName(one)
    return out


@book.query()
def trimmed_contents(spark: SparkSession, root: str) -> DataFrame:
    """Every chunk's content within 60 estimated tokens."""
    return _raw(spark, root).select("chunk_id", compose.trimmed("content", 60).alias("content")).dropDuplicates(["chunk_id"])


@book.query("""WITH d AS (SELECT document_path FROM documents WHERE source = (SELECT min(source) FROM documents) AND document_path IS NOT NULL),
e AS (SELECT string_split(regexp_replace(min(document_path), '/?[^/]*$', ''), '/') AS a, string_split(regexp_replace(max(document_path), '/?[^/]*$', ''), '/') AS b FROM d)
SELECT array_to_string(list_slice(a, 1, coalesce(list_min(list_filter(range(1, greatest(len(a), len(b)) + 2), lambda i: a[i] IS DISTINCT FROM b[i] OR i > len(a))), len(a) + 1) - 1), '/') AS folder FROM e""")
def common_folder(spark: SparkSession, root: str) -> DataFrame:
    """The folder that all files of the first source share."""
    d = table(spark, root, "documents").where(F.col("document_path").isNotNull())
    first = table(spark, root, "documents").agg(F.min("source")).scalar()
    return compose.common_folder(d.where(F.col("source") == first), "document_path")


@book.query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 600 SECOND THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
SELECT user_id, min(ts) AS started, count(*)::BIGINT AS beats FROM s GROUP BY user_id, n""")
def heartbeat_sessions(spark: SparkSession, root: str) -> DataFrame:
    """Stretches of a user's events without a silence of 600 seconds."""
    e = table(spark, root, "events").groupBy("user_id", F.session_window("ts", "600 seconds").alias("w")).agg(F.count("*").alias("beats"))
    return e.select("user_id", F.col("w.start").alias("started"), "beats")
