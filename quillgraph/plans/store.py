"""Queries of search, the relational store, sessions, logs, locks and agents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.functions import text as T
from quillgraph.operators import grep, store
from quillgraph.operators import symbols as S
from quillgraph.operators.incremental import normal_hash, text_hash
from quillgraph.plans.base import Book
from quillgraph.plans.retrieval import _raw as _all_rows
from quillgraph.sources.tables import table

book = Book()
LITERAL, REGEX = "emit_trace(", "expire_[a-z]+"
NOW = "2026-02-08 12:00:00"

C = "c AS (SELECT DISTINCT ON (chunk_id) chunk_id, document_path, content, start_pos, end_pos, token_count FROM chunks WHERE chunk_id IS NOT NULL)"
LINES = f"""{C}, l AS (SELECT chunk_id, document_path, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS line_in_chunk FROM c),
m AS (SELECT *, regexp_replace(line, '^\\s+', '') AS x FROM l WHERE contains(line, '{LITERAL}')),
r AS (SELECT chunk_id, document_path, line_in_chunk, line, CASE WHEN x = '' THEN 'blank'
 WHEN {' OR '.join("starts_with(x, '" + s + "')" for s in T.COMMENT_STARTS)} THEN 'comment'
 WHEN {' OR '.join("starts_with(x, '" + s + "')" for s in T.IMPORT_STARTS)} THEN 'import'
 WHEN {' OR '.join("starts_with(x, '" + s + "')" for s in T.DEFINITION_STARTS)} THEN 'definition'
 WHEN {' OR '.join("starts_with(x, '" + s.replace("'", "''") + "')" for s in T.STRING_STARTS)} THEN 'string' ELSE 'code' END AS role FROM m)"""


def _raw(spark: SparkSession, root: str) -> DataFrame:
    return _all_rows(spark, root).where(F.col("chunk_id").isNotNull())


def _chunks(spark: SparkSession, root: str) -> DataFrame:
    c = table(spark, root, "chunks").where(F.col("chunk_id").isNotNull())
    return c.select("chunk_id", "document_path", "content", "start_pos", "end_pos", "token_count").dropDuplicates(["chunk_id"])


def _lines(spark: SparkSession, root: str) -> DataFrame:
    """The lines with the literal: filtered in the scan, repeated chunks removed after, so only matching lines are shuffled."""
    return grep.matching_lines(_raw(spark, root), LITERAL).dropDuplicates(["chunk_id", "line_in_chunk"])


def _now() -> F.Column:
    return F.lit(NOW).cast("timestamp_ntz")


@book.query(f"""WITH {C} SELECT chunk_id, document_path, start_pos, len(list_filter(range(1, length(content) + 1), lambda i: substr(content, i, {len(LITERAL)}) = '{LITERAL}'))::BIGINT AS matches
FROM c WHERE contains(content, '{LITERAL}')""")
def text_search_literal(spark: SparkSession, root: str) -> DataFrame:
    return grep.matching_chunks(_raw(spark, root), LITERAL).dropDuplicates(["chunk_id"])


@book.query(f"WITH {C}, m AS (SELECT chunk_id, document_path, start_pos, len(regexp_extract_all(content, '{REGEX}'))::BIGINT AS matches FROM c) SELECT * FROM m WHERE matches > 0")
def text_search_regex(spark: SparkSession, root: str) -> DataFrame:
    return grep.matching_chunks(_raw(spark, root), REGEX, regex=True).dropDuplicates(["chunk_id"])


@book.query(f"WITH {LINES} SELECT role, count(*)::BIGINT AS matches, count(DISTINCT document_path)::BIGINT AS files FROM r GROUP BY role")
def grep_by_role(spark: SparkSession, root: str) -> DataFrame:
    return grep.grouped(_lines(spark, root), "role")


@book.query(f"WITH {LINES} SELECT document_path, count(*)::BIGINT AS matches, count(DISTINCT document_path)::BIGINT AS files FROM r GROUP BY document_path")
def grep_by_file(spark: SparkSession, root: str) -> DataFrame:
    lines = _lines(spark, root)
    return lines.groupBy("document_path").agg(F.count("*").alias("matches"), F.count_distinct("document_path").alias("files"))


@book.query(f"WITH {LINES} SELECT trim(regexp_replace(line, '\\s+', ' ', 'g')) AS excerpt, count(*)::BIGINT AS times, count(DISTINCT document_path)::BIGINT AS files FROM r GROUP BY excerpt HAVING count(*) >= 3")
def grep_repeated(spark: SparkSession, root: str) -> DataFrame:
    return grep.repeated_lines(_lines(spark, root))


BASE = """b AS (SELECT chunk_id, document_path, (1 + coalesce(sum(coalesce(length(content) - length(replace(content, chr(10), '')) + CASE WHEN suffix(content, chr(10)) THEN 0 ELSE 1 END, 1))
 OVER (PARTITION BY document_path ORDER BY start_pos, chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS base_line FROM c)"""


@book.query(f"WITH {C}, {BASE} SELECT * FROM b")
def base_lines(spark: SparkSession, root: str) -> DataFrame:
    return grep.base_lines(_chunks(spark, root))


@book.query(f"WITH {LINES}, {BASE} SELECT chunk_id, r.document_path, base_line + line_in_chunk - 1 AS line_number, role FROM r JOIN b USING (chunk_id)")
def grep_lines(spark: SparkSession, root: str) -> DataFrame:
    """Every matching line with its line in the document."""
    return _lines(spark, root).join(grep.base_lines(_chunks(spark, root)).select("chunk_id", "base_line"), "chunk_id").select("chunk_id", "document_path", (F.col("base_line") + F.col("line_in_chunk") - 1).alias("line_number"), "role")


@book.query(f"""WITH {LINES}, d AS (SELECT DISTINCT ON (id) id, trim(name) AS name, lower(trim(role)) AS role, chunk_id, document_path, line_number FROM symbols)
SELECT r.chunk_id, line_in_chunk::BIGINT AS line_in_chunk, arg_max(name, struct_pack(l := line_number, i := id)) AS scope FROM r LEFT JOIN d ON d.chunk_id = r.chunk_id AND d.role = 'definition' AND name IS NOT NULL AND d.document_path IS NOT NULL AND line_number <= line_in_chunk
GROUP BY r.chunk_id, line_in_chunk""")
def enclosing_scope(spark: SparkSession, root: str) -> DataFrame:
    """The definition around every matching line."""
    d = S.cleaned(table(spark, root, "symbols")).where(F.col("role") == "definition")
    return grep.with_scope(_lines(spark, root).select("chunk_id", "line_in_chunk"), d)


@book.query("SELECT doc_id, document_path FROM documents WHERE indexed_at IS NOT NULL ORDER BY indexed_at DESC, doc_id LIMIT 20")
def recent_documents(spark: SparkSession, root: str) -> DataFrame:
    d = table(spark, root, "documents").where(F.col("indexed_at").isNotNull())
    return store.newest(d, [F.desc("indexed_at"), F.col("doc_id")], 20).select("doc_id", "document_path")


_EXT = "lower(regexp_extract(document_path, '[^/.][^/]*(\\.[^/.]+)$', 1))"


@book.query(f"""WITH d AS (SELECT {_EXT} AS ext FROM documents) SELECT CASE WHEN ext IN ({', '.join(repr(x) for x in T.CODE_EXTENSIONS)}) THEN 'code'
{' '.join('WHEN ext IN (' + ', '.join(repr(x) for x in v) + f") THEN '{k}'" for k, v in T.OTHER_EXTENSIONS.items())} ELSE 'unknown' END AS modality, count(*)::BIGINT AS documents FROM d GROUP BY 1""")
def detected_modalities(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "documents").groupBy(T.modality("document_path").alias("modality")).agg(F.count("*").alias("documents"))


@book.query(f"SELECT {_EXT} AS extension, count(*)::BIGINT AS documents, sum(file_size)::BIGINT AS bytes FROM documents GROUP BY 1 ORDER BY documents DESC, extension LIMIT 20")
def project_brief(spark: SparkSession, root: str) -> DataFrame:
    """The twenty commonest extensions."""
    d = table(spark, root, "documents").groupBy(T.extension("document_path").alias("extension")).agg(F.count("*").alias("documents"), F.sum("file_size").alias("bytes"))
    return d.orderBy(F.desc("documents"), "extension").limit(20)


@book.query(f"""WITH {C} SELECT document_path, count(*)::BIGINT AS chunks, sum(token_count)::BIGINT AS tokens, max(end_pos) AS end_pos FROM c GROUP BY document_path""")
def project_map(spark: SparkSession, root: str) -> DataFrame:
    """Chunks and tokens of every file."""
    return _chunks(spark, root).groupBy("document_path").agg(F.count("*").alias("chunks"), F.sum("token_count").alias("tokens"), F.max("end_pos").alias("end_pos"))


@book.query(f"""WITH {C} SELECT (SELECT count(*) FROM c)::BIGINT AS chunks, (SELECT sum(token_count) FROM c)::BIGINT AS tokens, (SELECT count(DISTINCT document_path) FROM documents)::BIGINT AS files,
(SELECT count(*) FROM (SELECT DISTINCT chunk_id, version FROM chunk_history))::BIGINT AS versions""")
def store_stats(spark: SparkSession, root: str) -> DataFrame:
    c = _chunks(spark, root).agg(F.count("*").alias("chunks"), F.sum("token_count").alias("tokens"))
    files = table(spark, root, "documents").agg(F.count_distinct("document_path")).scalar()
    versions = table(spark, root, "chunk_history").select("chunk_id", "version").distinct().agg(F.count("*")).scalar()
    return c.select("chunks", "tokens", files.alias("files"), versions.alias("versions"))


@book.query("""WITH s AS (SELECT chunk_id, any_value(document_path) AS document_path, max(staleness_score) AS staleness FROM chunks GROUP BY chunk_id)
SELECT document_path, count(*)::BIGINT AS chunks, round(max(staleness), 6) AS worst FROM s WHERE staleness >= 0.3 GROUP BY document_path""")
def stale_by_document(spark: SparkSession, root: str) -> DataFrame:
    s = table(spark, root, "chunks").groupBy("chunk_id").agg(F.min("document_path").alias("document_path"), F.max("staleness_score").alias("staleness"))
    return s.where("staleness >= 0.3").groupBy("document_path").agg(F.count("*").alias("chunks"), F.round(F.max("staleness"), 6).alias("worst"))


@book.query("""SELECT DISTINCT h.chunk_id, h.version, h.content_hash, c.document_path FROM chunk_history h JOIN (SELECT DISTINCT chunk_id, document_path FROM chunks) c USING (chunk_id)""")
def chunk_versions(spark: SparkSession, root: str) -> DataFrame:
    """The history of every chunk with its file."""
    h = table(spark, root, "chunk_history").select("chunk_id", "version", "content_hash").distinct()
    return h.join(table(spark, root, "chunks").select("chunk_id", "document_path").distinct(), "chunk_id")


@book.query("""WITH cur AS (SELECT chunk_id, max(version) AS version, arg_max(content_hash, version) AS content_hash FROM chunk_history GROUP BY chunk_id),
inc AS (SELECT DISTINCT ON (chunk_id) chunk_id, sha256(content) AS content_hash FROM chunks WHERE content IS NOT NULL)
SELECT coalesce(cur.chunk_id, inc.chunk_id) AS chunk_id, CASE WHEN inc.chunk_id IS NULL THEN version ELSE coalesce(version, 0) + 1 END AS version,
CASE WHEN inc.chunk_id IS NULL THEN cur.content_hash ELSE inc.content_hash END AS content_hash, inc.chunk_id IS NOT NULL AND cur.chunk_id IS NOT NULL AS replaced FROM cur FULL JOIN inc USING (chunk_id)""")
def versioned_upsert(spark: SparkSession, root: str) -> DataFrame:
    """The store after the present chunks are put on top of the history."""
    cur = table(spark, root, "chunk_history").groupBy("chunk_id").agg(F.max("version").alias("version"), F.max_by("content_hash", "version").alias("content_hash"))
    inc = table(spark, root, "chunks").where("content IS NOT NULL").select("chunk_id", F.sha2("content", 256).alias("content_hash"))
    return store.upsert_versions(cur, inc, "chunk_id", ["content_hash"])


_NORMAL = "lower(regexp_replace(regexp_replace(content_hash, '^\\s*([A-Za-z][A-Za-z0-9_/-]*\\s*:)?\\s*', ''), '\\s+$', ''))"


@book.query(f"""SELECT doc_id, CASE WHEN indexed_at IS NULL THEN 'new' WHEN {_NORMAL} = sha256(coalesce(text, '')) THEN 'unchanged' ELSE 'modified' END AS status FROM documents""")
def change_status(spark: SparkSession, root: str) -> DataFrame:
    """Each document against what was stored at its last indexing."""
    d = table(spark, root, "documents")
    stored = d.where(F.col("indexed_at").isNotNull()).select("doc_id", normal_hash("content_hash").alias("v"))
    return store.snapshot_diff(stored, d.select("doc_id", text_hash("text").alias("v")), "doc_id", "v")


@book.query("SELECT source, count(*)::BIGINT AS documents, count_if(indexed_at IS NULL)::BIGINT AS never_indexed, max(indexed_at) AS latest, sum(chunk_count)::BIGINT AS chunks FROM documents GROUP BY source")
def index_health(spark: SparkSession, root: str) -> DataFrame:
    d = table(spark, root, "documents")
    return d.groupBy("source").agg(F.count("*").alias("documents"), F.count_if(F.col("indexed_at").isNull()).alias("never_indexed"), F.max("indexed_at").alias("latest"), F.sum("chunk_count").alias("chunks"))


_N = "n AS (SELECT DISTINCT ON (id) * FROM change_notifications WHERE id IS NOT NULL)"


def _notes(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "change_notifications").where(F.col("id").isNotNull()).dropDuplicates(["id"])


@book.query(f"WITH {_N} SELECT id, document_path, change_type FROM n WHERE created_at >= TIMESTAMP '{NOW}' - INTERVAL 24 HOUR AND agent_id IS DISTINCT FROM (SELECT min(agent_id) FROM n)")
def notifications_since(spark: SparkSession, root: str) -> DataFrame:
    """The notifications of the last 24 hours by other agents."""
    n = _notes(spark, root)
    me = n.agg(F.min("agent_id")).scalar()
    recent = n.where(F.col("created_at") >= _now() - F.expr("INTERVAL 24 HOURS"))
    return recent.where(~F.col("agent_id").eqNullSafe(me)).select("id", "document_path", "change_type")


@book.query(f"WITH {_N} SELECT id FROM n ORDER BY created_at DESC NULLS LAST, id DESC LIMIT 100")
def notifications_newest(spark: SparkSession, root: str) -> DataFrame:
    return store.newest(_notes(spark, root), [F.col("created_at").desc_nulls_last(), F.desc("id")], 100).select("id")


@book.query(f"WITH {_N} SELECT document_path, arg_max(change_type, struct_pack(t := created_at, i := id)) AS last_change, count(*)::BIGINT AS changes FROM n WHERE created_at IS NOT NULL GROUP BY document_path")
def last_changes(spark: SparkSession, root: str) -> DataFrame:
    n = _notes(spark, root).where(F.col("created_at").isNotNull())
    return n.groupBy("document_path").agg(F.max_by("change_type", F.struct("created_at", "id")).alias("last_change"), F.count("*").alias("changes"))


@book.query(f"""WITH {_N} SELECT agent_id, min(created_at) AS first_seen, max(created_at) AS last_seen, epoch(TIMESTAMP '{NOW}') - floor(epoch(max(created_at))) > 600 AS stale FROM n WHERE agent_id IS NOT NULL GROUP BY agent_id""")
def agent_staleness(spark: SparkSession, root: str) -> DataFrame:
    return store.agents(_notes(spark, root), F.lit(NOW).cast("timestamp"))


@book.query(f"""WITH {_N}, l AS (SELECT document_path, arg_max(struct_pack(a := agent_id, t := created_at), struct_pack(t := created_at, a := agent_id)) AS l FROM n WHERE document_path IS NOT NULL AND created_at IS NOT NULL AND agent_id IS NOT NULL GROUP BY document_path)
SELECT document_path, l.a AS agent_id, CASE WHEN epoch(TIMESTAMP '{NOW}') - floor(epoch(l.t)) <= 86400 THEN 'locked' ELSE 'expired' END AS state FROM l""")
def lock_states(spark: SparkSession, root: str) -> DataFrame:
    """A change taken as a lock for a day: who holds what."""
    n = _notes(spark, root).where("created_at IS NOT NULL AND agent_id IS NOT NULL").withColumn("ttl", F.lit(86400))
    return store.lock_states(n, F.lit(NOW).cast("timestamp"), at="created_at", ttl="ttl").select("document_path", "agent_id", "state")


@book.query("""WITH q AS (SELECT document_path, min(doc_version) AS expected FROM documents WHERE document_path IS NOT NULL GROUP BY 1)
SELECT d.doc_id, expected, doc_version AS actual, coalesce(expected = doc_version, false) AS granted FROM documents d JOIN q USING (document_path)""")
def version_checks(spark: SparkSession, root: str) -> DataFrame:
    """A writer that expects each path's least version, against the rows."""
    d = table(spark, root, "documents").where(F.col("document_path").isNotNull())
    want = d.groupBy("document_path").agg(F.min("doc_version").alias("expected"))
    r = d.select("doc_id", "document_path").join(want, "document_path").select("doc_id", "expected")
    return store.compare_and_set(d, r, key="doc_id").select("doc_id", "expected", "actual", "granted")


@book.query("""SELECT lower(trim(status)) AS status, count(DISTINCT run_id)::BIGINT AS runs, count_if(finished_at IS NULL)::BIGINT AS open_rows FROM index_runs GROUP BY 1""")
def run_totals(spark: SparkSession, root: str) -> DataFrame:
    r = table(spark, root, "index_runs")
    return r.groupBy(F.lower(F.trim("status")).alias("status")).agg(F.count_distinct("run_id").alias("runs"), F.count_if(F.col("finished_at").isNull()).alias("open_rows"))


@book.query(f"""WITH {C} SELECT count(DISTINCT chunk_id)::BIGINT AS chunks, bit_xor(('0x' || substr(sha256(chunk_id), 1, 15))::BIGINT) AS digest FROM c""")
def index_manifest(spark: SparkSession, root: str) -> DataFrame:
    """Count and digest of all chunk ids, whatever their order: tells whether a stored index is fresh."""
    ids = table(spark, root, "chunks").where(F.col("chunk_id").isNotNull()).select("chunk_id").distinct()
    return ids.agg(F.count("*").alias("chunks"), F.bit_xor(F.conv(F.substring(F.sha2("chunk_id", 256), 1, 15), 16, 10).cast("long")).alias("digest"))


@book.query(f"""WITH {C}, f AS (SELECT chunk_id, document_path, token_count, sum(coalesce(token_count, 0)) OVER (PARTITION BY document_path ORDER BY start_pos, chunk_id ROWS UNBOUNDED PRECEDING) AS total FROM c) SELECT chunk_id, document_path FROM f WHERE total <= 300""")
def context_within_budget(spark: SparkSession, root: str) -> DataFrame:
    """The leading chunks of every file within 300 tokens."""
    return grep.within_budget(_chunks(spark, root), "document_path", [F.col("start_pos"), F.col("chunk_id")], F.coalesce("token_count", F.lit(0)), 300).select("chunk_id", "document_path")
