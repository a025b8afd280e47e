"""Queries of the text, keyword and vector operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.functions import text as T
from quillgraph.functions.stem import stem_sql
from quillgraph import session
from quillgraph.operators import bm25, features, vectors
from quillgraph.plans.base import Book
from quillgraph.sources.tables import table

book = Book()
QUERY = "rebuild the cached manifest when resolve_gauge fails"


def _chunks(spark: SparkSession, root: str) -> DataFrame:
    """The chunks without repeated ids."""
    return table(spark, root, "chunks").select("chunk_id", "document_path", "content", "start_pos", "end_pos", "token_count", "staleness_score", "created_at").dropDuplicates(["chunk_id"])


def _raw(spark: SparkSession, root: str) -> DataFrame:
    """The chunk rows as they are.  What is computed row by row is computed first and repeated ids removed after, so no text is shuffled."""
    return table(spark, root, "chunks").select("chunk_id", "document_path", "content", "start_pos", "end_pos", "token_count")


_BUILT: dict[tuple[str, str, int], tuple[tuple, bm25.Index]] = {}


def _index(spark: SparkSession, root: str) -> bm25.Index:
    """The index of the chunks: built once, and again only if the ids that it was built from have changed."""
    c = table(spark, root, "chunks").select("chunk_id", "content")
    state = tuple(c.agg(F.count("*"), F.bit_xor(F.xxhash64("chunk_id"))).first())
    key = (spark.sparkContext.applicationId, root, session.epoch)
    if key not in _BUILT or _BUILT[key][0] != state:
        _BUILT[key] = state, bm25.Index(c, "chunk_id", "content")
    return _BUILT[key][1]


CHUNKS = "c AS (SELECT DISTINCT ON (chunk_id) chunk_id, document_path, content, start_pos, end_pos, token_count FROM chunks)"

# DuckDB has no Unicode-aware word boundary: whole runs first, then the ASCII ones.
_WORDS = "list_filter(regexp_extract_all({t}, '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_matches(w, '^[a-zA-Z_][a-zA-Z0-9_]*$'))"


def _SPLIT_SQL(w: str) -> str:
    s = f"regexp_replace(trim({w}), '[_\\-]+', ' ', 'g')"
    for p in ("([A-Z])([A-Z][a-z])", "([a-z])([A-Z])", "([A-Za-z])([0-9])", "([0-9])([A-Za-z])"):
        s = f"regexp_replace({s}, '{p}', '\\1 \\2', 'g')"
    return f"list_filter(string_split_regex(lower({s}), ' +'), lambda p: p <> '')"


PARTS = f"""
{CHUNKS},
one AS (SELECT chunk_id AS id, content AS t FROM c WHERE content <> ''),
words AS (SELECT id, unnest({_WORDS.format(t='t')}) AS w FROM one),
parts AS (SELECT id, part, count(*) AS tf FROM (SELECT id, unnest({_SPLIT_SQL('w')}) AS part FROM words) WHERE length(part) > 1 GROUP BY ALL),
vocabulary AS (SELECT part, {stem_sql('part', True)} AS term FROM (SELECT DISTINCT part FROM parts)),
posts AS (SELECT id, term, sum(tf)::BIGINT AS tf FROM parts JOIN vocabulary USING (part) GROUP BY ALL),
dl AS (SELECT one.id, coalesce(sum(tf), 0)::BIGINT AS dl FROM one LEFT JOIN parts USING (id) GROUP BY ALL)
"""

SCORED = f"""
{PARTS},
qw AS (SELECT unnest({_WORDS.format(t="'" + QUERY + "'")}) AS w),
q AS (SELECT term, count(*) AS qtf FROM (SELECT {stem_sql('part', True)} AS term FROM (SELECT unnest({_SPLIT_SQL('w')}) AS part FROM qw) WHERE length(part) > 1) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM posts GROUP BY ALL),
total AS (SELECT count(*) AS n, avg(dl) AS a FROM dl),
scored AS (SELECT id, sum(qtf * ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1.0::DOUBLE) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / a))) AS score
           FROM posts JOIN q USING (term) JOIN dfs USING (term) JOIN dl USING (id), total GROUP BY id)
"""


@book.query(f"WITH {SCORED} SELECT id AS chunk_id, round(score, 6) AS score FROM scored ORDER BY score DESC, id LIMIT 10")
def bm25_topk(spark: SparkSession, root: str) -> DataFrame:
    """The ten best chunks for a query."""
    s = bm25.top(_index(spark, root).scores(QUERY), 10)
    return s.select(F.col("id").alias("chunk_id"), F.round("score", 6).alias("score"))


@book.query(f"WITH {SCORED} SELECT id AS chunk_id, round(coalesce(score, 0), 6) AS score FROM one LEFT JOIN scored USING (id)")
def bm25_score_batch(spark: SparkSession, root: str) -> DataFrame:
    """Every chunk's score; 0 for those without a hit."""
    index = _index(spark, root)
    return index.sizes.join(index.scores(QUERY), "id", "left").select(F.col("id").alias("chunk_id"), F.round(F.coalesce("score", F.lit(0.0)), 6).alias("score"))


@book.query(f"WITH {PARTS} SELECT term, count(*)::BIGINT AS chunks, sum(tf)::BIGINT AS uses FROM posts GROUP BY term")
def bm25_index(spark: SparkSession, root: str) -> DataFrame:
    """Document frequency and uses of every stemmed term."""
    return _index(spark, root).postings.groupBy("term").agg(F.count("*").alias("chunks"), F.sum("tf").alias("uses"))


@book.query(f"WITH {PARTS} SELECT count(*)::BIGINT AS n, round(avg(dl), 6) AS average_length, sum(dl)::BIGINT AS terms FROM dl")
def bm25_stats(spark: SparkSession, root: str) -> DataFrame:
    return _index(spark, root).stats().withColumn("average_length", F.round("average_length", 6))


@book.query(f"WITH {PARTS} SELECT part, term FROM vocabulary")
def vocabulary_stems(spark: SparkSession, root: str) -> DataFrame:
    words = table(spark, root, "chunks").where(F.col("chunk_id").isNotNull()).select(F.explode(T.identifiers("content")).alias("w"))
    return bm25.stems(words.distinct())


@book.query(f"""WITH names AS (SELECT DISTINCT name FROM symbols WHERE name IS NOT NULL), split AS (SELECT name, unnest({_SPLIT_SQL('name')}) AS part FROM names)
SELECT part, count(*)::BIGINT AS uses FROM split GROUP BY part""")
def identifier_parts(spark: SparkSession, root: str) -> DataFrame:
    """The parts of all distinct symbol names."""
    names = table(spark, root, "symbols").where(F.col("name").isNotNull()).select("name").distinct()
    return names.select(F.explode(T.split_identifier("name")).alias("part")).groupBy("part").agg(F.count("*").alias("uses"))


@book.query(f"""WITH {SCORED}, best AS (SELECT id, score FROM scored ORDER BY score DESC, id LIMIT 20)
SELECT id AS chunk_id, round(score / (SELECT max(score) FROM best), 6) AS relevance FROM best ORDER BY relevance DESC, chunk_id LIMIT 10""")
def keyword_search(spark: SparkSession, root: str) -> DataFrame:
    """The default search: keyword scores relative to the best."""
    best = bm25.top(_index(spark, root).scores(QUERY), 20)
    relative = F.round(F.col("score") / F.max("score").over(Window.partitionBy(F.lit(1))), 6)
    return best.select(F.col("id").alias("chunk_id"), relative.alias("relevance")).orderBy(F.desc("relevance"), "chunk_id").limit(10)


PREFIX = "meridian"


@book.query(f"""WITH {SCORED} SELECT id AS chunk_id, round(score, 6) AS score FROM scored JOIN c ON c.chunk_id = id
WHERE document_path = '{PREFIX}' OR starts_with(document_path, '{PREFIX}/') ORDER BY score DESC, chunk_id LIMIT 10""")
def path_prefix_search(spark: SparkSession, root: str) -> DataFrame:
    """The best chunks under a path; the filter comes before the cut."""
    s = _index(spark, root).scores(QUERY)
    inside = table(spark, root, "chunks").where(T.under_path("document_path", PREFIX)).select(F.col("chunk_id").alias("id"))
    return bm25.top(s.join(inside, "id", "left_semi"), 10).select(F.col("id").alias("chunk_id"), F.round("score", 6).alias("score"))


TERMS = ["rebuild", "cached", "manifest", "resolve_gauge", "fails"]
_AT = ", ".join(f"instr(lower(content), '{t}') - 1" for t in TERMS)
_PRESENT = " + ".join(f"CASE WHEN pos[{i + 1}] >= 0 THEN {min(len(t) / 8, 1.0)} ELSE 0 END" for i, t in enumerate(TERMS))


@book.query(f"""WITH {CHUNKS}, p AS (SELECT chunk_id, content, [{_AT}] AS pos FROM c WHERE content <> ''),
f AS (SELECT *, list_filter(pos, lambda x: x >= 0) AS found, ({_PRESENT})::DOUBLE AS present FROM p)
SELECT chunk_id, round(0.4 * present / {max(sum(min(len(t) / 8, 1.0) for t in TERMS), 1.0)} + 0.3 * (1 - least(list_min(found) / length(content), 1.0))
  + 0.3 * (1 - least((list_max(found) - list_min(found)) / 1000.0, 1.0)), 6) AS proximity FROM f WHERE len(found) > 0""")
def proximity_scores(spark: SparkSession, root: str) -> DataFrame:
    """How close together a query's terms stand in every chunk that has one."""
    scored = _raw(spark, root).select("chunk_id", F.round(T.proximity("content", TERMS), 6).alias("proximity"))
    return scored.where(F.col("proximity") > 0).dropDuplicates(["chunk_id"])


@book.query(f"""WITH {CHUNKS}, r AS (SELECT chunk_id, unnest(string_split(content, chr(10))) AS line FROM c),
b AS (SELECT chunk_id, regexp_replace(line, '^\\s+', '') AS x FROM r)
SELECT role, count(*)::BIGINT AS lines FROM (SELECT CASE WHEN x = '' THEN 'blank'
 WHEN {' OR '.join("starts_with(x, '" + s + "')" for s in T.COMMENT_STARTS)} THEN 'comment'
 WHEN {' OR '.join("starts_with(x, '" + s + "')" for s in T.IMPORT_STARTS)} THEN 'import'
 WHEN {' OR '.join("starts_with(x, '" + s + "')" for s in T.DEFINITION_STARTS)} THEN 'definition'
 WHEN {' OR '.join("starts_with(x, '" + s.replace("'", "''") + "')" for s in T.STRING_STARTS)} THEN 'string' ELSE 'code' END AS role FROM b) GROUP BY role""")
def line_roles(spark: SparkSession, root: str) -> DataFrame:
    roles = F.transform(F.split("content", "\n"), T.line_role)
    counted = _raw(spark, root).select("chunk_id", roles.alias("r")).dropDuplicates(["chunk_id"])
    return counted.select(F.explode("r").alias("role")).groupBy("role").agg(F.count("*").alias("lines"))


@book.query(f"""WITH {CHUNKS}, l AS (SELECT chunk_id, content, string_split(content, chr(10)) AS lines FROM c WHERE content IS NOT NULL),
d AS (SELECT chunk_id, content, len(lines) AS n, length(content) AS k, length(content) - length(regexp_replace(content, '[{{}}\\[\\]()<>:=|&%$#@!~`]', '', 'g')) AS special,
 len(list_filter(lines, lambda x: regexp_matches(x, '^[ \\t]'))) AS indented,
 len(list_filter(lines, lambda x: regexp_matches(x, '^\\s*[-*•]\\s'))) + len(list_filter(lines, lambda x: regexp_matches(x, '^\\s*[0-9]+[.)]\\s'))) AS marks FROM l)
SELECT chunk_id, CASE WHEN content = '' THEN 0.0 ELSE round(least(1.0, 0.3 * greatest(0.0, 1 - (k - (n - 1)) / n / 80.0) + 0.3 * least(1.0, special / greatest(k, 1) * 10) + 0.2 * indented / n + 0.2 * marks / n), 6) END AS density FROM d""")
def content_density(spark: SparkSession, root: str) -> DataFrame:
    rows = _raw(spark, root).where(F.col("content").isNotNull()).select("chunk_id", F.round(T.density("content"), 6).alias("density"))
    return rows.dropDuplicates(["chunk_id"])


@book.query(f"""WITH {CHUNKS} SELECT chunk_id, sha256(content) AS content_hash,
substr(sha256(document_path || ':' || start_pos || ':' || end_pos || ':' || substr(sha256(content), 1, 16)), 1, 32) AS made_id FROM c WHERE content IS NOT NULL AND document_path IS NOT NULL""")
def chunk_ids(spark: SparkSession, root: str) -> DataFrame:
    """The content hash of every chunk, and the id made from path, place and content."""
    c = _raw(spark, root).where(F.col("content").isNotNull() & F.col("document_path").isNotNull())
    rows = c.select("chunk_id", T.content_hash("content").alias("content_hash"), T.chunk_id("document_path", "start_pos", "end_pos", "content").alias("made_id"))
    return rows.dropDuplicates(["chunk_id"])


_Q = "(SELECT embedding FROM embeddings WHERE vec_id = 0)"


@book.query(f"""SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], {_Q}::DOUBLE[]), 6) AS similarity FROM embeddings ORDER BY similarity DESC, vec_id LIMIT 10""")
def knn_topk(spark: SparkSession, root: str) -> DataFrame:
    """The ten vectors nearest to one."""
    e = table(spark, root, "embeddings")
    q = e.where("vec_id = 0").select("embedding").first()
    s = vectors.nearest(e, "vec_id", "embedding", list(q[0]) if q else [0.0], 10)
    return s.select(F.col("id").alias("vec_id"), F.round("similarity", 6).alias("similarity")).orderBy(F.desc("similarity"), "vec_id").limit(10)


@book.query("""WITH p AS (SELECT a.vec_id AS query_id, b.vec_id AS id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0)
SELECT query_id, id, rank, round(s, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, id) AS rank FROM p) WHERE rank <= 10""")
def knn_batch(spark: SparkSession, root: str) -> DataFrame:
    """The ten nearest of every vector whose id is divisible by 50, against all vectors."""
    e = table(spark, root, "embeddings")
    out = vectors.nearest_batch(e.where("vec_id % 50 = 0"), e, "vec_id", "embedding", 64, 10, blocks=2)
    return out.select("query_id", "id", "rank", F.round("similarity", 6).alias("similarity"))


@book.query("""WITH p AS (SELECT a.vec_id AS query_id, a.label AS own, b.label, b.vec_id AS id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s
 FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, id) AS rank FROM p)
SELECT query_id, count(*) FILTER (WHERE label = own)::BIGINT AS same_label FROM r WHERE rank <= 10 GROUP BY query_id""")
def knn_label_vote(spark: SparkSession, root: str) -> DataFrame:
    """How many of the ten nearest others share the label."""
    e = table(spark, root, "embeddings")
    near = vectors.nearest_batch(e.where("vec_id % 50 = 0"), e, "vec_id", "embedding", 64, 11, blocks=2).where("query_id <> id")
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where("r <= 10")
    l = e.select(F.col("vec_id").alias("id"), "label")
    own = e.select(F.col("vec_id").alias("query_id"), F.col("label").alias("own"))
    return near.join(l, "id").join(own, "query_id").groupBy("query_id").agg(F.count_if(F.col("label") == F.col("own")).alias("same_label"))


ALPHA = vectors.blend_weight(QUERY, 0.42)
QUERY_VECTOR = [round(float(x), 9) for x in features.fingerprint(QUERY)]


@book.query(f"""WITH {SCORED},
h AS (SELECT chunk_id, semantic_signature AS v FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY version DESC) AS r FROM chunk_history) WHERE r = 1
      AND len(semantic_signature) = 128 AND NOT list_bool_or(list_transform(semantic_signature, lambda x: x IS NULL OR isnan(x)))),
qv AS (SELECT {QUERY_VECTOR}::DOUBLE[] AS w),
near AS (SELECT chunk_id AS id, CASE WHEN list_sum(list_transform(h.v, lambda x: x * x)) = 0 THEN 0.0 ELSE list_cosine_similarity(h.v::DOUBLE[], qv.w::DOUBLE[]) END AS s FROM h, qv ORDER BY round(s, 9) DESC, id LIMIT 30),
kw AS (SELECT id, score FROM scored ORDER BY score DESC, id LIMIT 20),
m AS (SELECT id, s AS v, coalesce(score, 0) AS b FROM near FULL JOIN kw USING (id)),
s AS (SELECT *, CASE WHEN v IS NOT NULL THEN row_number() OVER (ORDER BY v DESC NULLS LAST, id) END AS rv, row_number() OVER (ORDER BY b DESC, id) AS rb FROM m),
f AS (SELECT max(v) AS vmax, min(v) AS vmin, max(b) AS bmax, count(v) AS nv, sum(CASE WHEN rv <= 5 AND rb <= 5 THEN 1 ELSE 0 END) AS both_, max(CASE WHEN rv = least(4, (SELECT count(v) FROM m)) THEN v END) AS rest,
 max(CASE WHEN rv = 1 THEN rb END) AS winner FROM s),
g AS (SELECT *, ((CASE WHEN nv = 0 THEN 0 ELSE 1 - both_ / greatest(least(nv, 5), 1) END) >= 0.5 OR coalesce(nv >= 2 AND vmax - rest > 0.15 AND winner > 5, false)
 OR (nv >= 4 AND coalesce(vmax - vmin, 0) < 0.035) OR coalesce(vmax, 0) < 0.70) AND bmax > 0 AS fallback FROM f)
SELECT id AS chunk_id, round(CASE WHEN fallback THEN b / bmax ELSE {ALPHA}::DOUBLE * (CASE WHEN v IS NULL THEN 0 WHEN vmax > vmin THEN (v - vmin) / (vmax - vmin) ELSE 1 END)
 + (1 - {ALPHA}::DOUBLE) * (CASE WHEN bmax > 0 THEN b / bmax ELSE b END) END, 6) AS score, CASE WHEN fallback THEN 'keyword' ELSE 'vector' END AS source
FROM s, g ORDER BY score DESC, chunk_id LIMIT 10""")
def hybrid_search(spark: SparkSession, root: str) -> DataFrame:
    """Vector and keyword top lists blended, with the fallback to keywords; the query's vector is its own fingerprint."""
    near = vectors.nearest_current(table(spark, root, "chunk_history"), "chunk_id", "version", "semantic_signature", QUERY_VECTOR, 30)
    kw = bm25.top(_index(spark, root).scores(QUERY), 20)
    out = vectors.hybrid(near, kw, ALPHA, 10)
    return out.select(F.col("id").alias("chunk_id"), F.round("score", 6).alias("score"), "source").orderBy(F.desc("score"), "chunk_id").limit(10)
