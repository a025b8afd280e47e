"""Queries of the symbol graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph import session
from quillgraph.operators import symbols as S
from quillgraph.plans.base import Book
from quillgraph.sources.tables import table

book = Book()

_NOISE = ", ".join(f"'{x}'" for x in S.NOISE)
_SUFFIXES = "list_transform(range(1, len(string_split(p, '/')) + 1), lambda i: array_to_string(list_slice(string_split(p, '/'), i, len(string_split(p, '/'))), '/'))"
_WEB = " OR ".join(f"suffix(w, '{e}')" for e in S.WEB_ENDINGS)
_SCRIPT = ", ".join(f"r || '{e}'" for e in S.SCRIPT_ENDINGS)

GRAPH = f"""
s AS (SELECT * FROM (SELECT DISTINCT ON (id) id, trim(name) AS name, kind, lower(trim(role)) AS role, chunk_id, document_path, line_number, container FROM symbols)
      WHERE name IS NOT NULL AND role IS NOT NULL AND chunk_id IS NOT NULL AND document_path IS NOT NULL),
refs AS (SELECT DISTINCT chunk_id, document_path, name, container FROM s WHERE role = 'reference' AND length(name) >= 2 AND name NOT IN ({_NOISE})),
defs AS (SELECT DISTINCT chunk_id AS target, document_path AS target_path, name, container AS target_container FROM s WHERE role = 'definition'),
modules AS (SELECT DISTINCT chunk_id, document_path, name AS module FROM s WHERE role = 'reference' AND kind = 'module'),
keys AS (SELECT module, unnest(CASE WHEN regexp_matches(module, '^\\.{{1,2}}/') THEN CASE WHEN r = '' THEN []::VARCHAR[] ELSE [{_SCRIPT}] END
   WHEN {_WEB} THEN [d || '.py', d || '/__init__.py', w] ELSE [d || '.py', d || '/__init__.py'] END) AS key
   FROM (SELECT DISTINCT module, replace(module, '.', '/') AS d, regexp_replace(module, '^(\\.{{1,2}}/)+', '') AS r, regexp_replace(module, '^/+', '') AS w FROM modules)),
paths AS (SELECT p, unnest({_SUFFIXES}) AS key FROM (SELECT DISTINCT target_path AS p FROM defs)),
matches AS (SELECT DISTINCT module, p AS path FROM keys JOIN paths USING (key)),
hinted AS (SELECT DISTINCT chunk_id, path AS target_path FROM modules JOIN matches USING (module)),
met AS (SELECT refs.*, target, defs.target_path, coalesce(container = target_container, false) AS own, hinted.chunk_id IS NOT NULL AS hint
  FROM refs JOIN defs USING (name) LEFT JOIN hinted ON hinted.chunk_id = refs.chunk_id AND hinted.target_path = defs.target_path),
m1 AS (SELECT * FROM (SELECT *, bool_or(own) OVER (PARTITION BY chunk_id, name, container) AS any_own FROM met) WHERE own OR NOT any_own),
m2 AS (SELECT * FROM (SELECT *, bool_or(hint) OVER (PARTITION BY chunk_id, name, container) AS any_hint FROM m1) WHERE hint OR NOT any_hint),
firsts AS (SELECT document_path AS path, arg_min(chunk_id, id) AS target FROM s WHERE role = 'definition' GROUP BY 1),
lost AS (SELECT chunk_id, document_path, module, arg_min(target, path) AS target, min(path) AS target_path
  FROM modules JOIN matches USING (module) JOIN firsts USING (path) WHERE module NOT IN (SELECT name FROM defs) GROUP BY ALL),
edges AS (SELECT DISTINCT chunk_id AS source_chunk_id, target AS target_chunk_id, CASE WHEN document_path = target_path THEN 'intra_file' ELSE 'cross_file' END AS edge_type, name AS symbol_name
  FROM (SELECT chunk_id, document_path, name, target, target_path FROM m2 UNION ALL SELECT chunk_id, document_path, module, target, target_path FROM lost) WHERE chunk_id <> target)
"""


def _symbols(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "symbols")


_RESOLVED: dict[tuple[str, str, int], tuple[tuple, DataFrame]] = {}


def _edges(spark: SparkSession, root: str) -> DataFrame:
    """The edges of the symbols: resolved and written once, and again only if the symbols' ids have changed."""
    state = tuple(_symbols(spark, root).agg(F.count("*"), F.bit_xor(F.xxhash64("id"))).first())
    key = (spark.sparkContext.applicationId, root, session.epoch)
    if key not in _RESOLVED or _RESOLVED[key][0] != state:
        _RESOLVED[key] = state, session.materialize(S.resolve(_symbols(spark, root)), "edges")
    return _RESOLVED[key][1]


def _paths(spark: SparkSession, root: str) -> DataFrame:
    return S.cleaned(_symbols(spark, root)).groupBy("chunk_id").agg(F.min("document_path").alias("document_path"))


@book.query(f"WITH {GRAPH} SELECT * FROM edges")
def symbol_edges(spark: SparkSession, root: str) -> DataFrame:
    """All edges between chunks."""
    return _edges(spark, root)


@book.query(f"WITH {GRAPH} SELECT edge_type, count(*)::BIGINT AS edges, count(DISTINCT symbol_name)::BIGINT AS names FROM edges GROUP BY edge_type")
def edge_totals(spark: SparkSession, root: str) -> DataFrame:
    return _edges(spark, root).groupBy("edge_type").agg(F.count("*").alias("edges"), F.count_distinct("symbol_name").alias("names"))


@book.query(f"WITH {GRAPH} SELECT name, count(DISTINCT document_path)::BIGINT AS files FROM s WHERE role = 'definition' GROUP BY name")
def definition_file_counts(spark: SparkSession, root: str) -> DataFrame:
    return S.definition_files(_symbols(spark, root))


@book.query(f"""WITH {GRAPH} SELECT count(*)::BIGINT AS total, count_if(role = 'definition')::BIGINT AS definitions, count_if(role = 'reference')::BIGINT AS "references",
count(DISTINCT name)::BIGINT AS names, count_if(starts_with(chunk_id, 'runtime:'))::BIGINT AS runtime FROM s""")
def symbol_stats(spark: SparkSession, root: str) -> DataFrame:
    s = S.cleaned(_symbols(spark, root))
    return s.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("role") == "definition").alias("definitions"),
        F.count_if(F.col("role") == "reference").alias("references"),
        F.count_distinct("name").alias("names"),
        F.count_if(F.startswith("chunk_id", F.lit("runtime:"))).alias("runtime"),
    )


@book.query(f"""WITH {GRAPH}, u AS (SELECT name, count_if(role = 'definition')::BIGINT AS definitions, count_if(role = 'reference')::BIGINT AS uses FROM s GROUP BY name)
SELECT name, definitions, uses, CASE WHEN definitions = 0 THEN 'external' WHEN uses = 0 THEN 'unreferenced' ELSE 'referenced' END AS verdict FROM u""")
def reference_verdicts(spark: SparkSession, root: str) -> DataFrame:
    """For every name: its definitions and uses, and what that says."""
    s = S.cleaned(_symbols(spark, root)).groupBy("name").agg(F.count_if(F.col("role") == "definition").alias("definitions"), F.count_if(F.col("role") == "reference").alias("uses"))
    verdict = F.when(F.col("definitions") == 0, "external").when(F.col("uses") == 0, "unreferenced").otherwise("referenced")
    return s.withColumn("verdict", verdict)


@book.query(f"""WITH {GRAPH} SELECT id, document_path, line_number, row_number() OVER w AS shadow_index, count(*) OVER (PARTITION BY name, document_path) AS shadow_count
FROM s WHERE role = 'definition' WINDOW w AS (PARTITION BY name, document_path ORDER BY line_number NULLS FIRST, id)""")
def definition_places(spark: SparkSession, root: str) -> DataFrame:
    """Every definition with its place among those of the same name and file."""
    s = S.cleaned(_symbols(spark, root)).where(F.col("role") == "definition")
    w = Window.partitionBy("name", "document_path")
    return s.select("id", "document_path", "line_number", F.row_number().over(w.orderBy(F.col("line_number").asc_nulls_first(), "id")).cast("long").alias("shadow_index"), F.count("*").over(w).alias("shadow_count"))


def _seed(edges: DataFrame, forward: bool = False) -> DataFrame:
    """The chunk with the most edges on the side that the walk starts from."""
    side = "source_chunk_id" if forward else "target_chunk_id"
    return edges.groupBy(F.col(side).alias("chunk_id")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "chunk_id").limit(1).select("chunk_id")


def _walk(spark: SparkSession, root: str, depth: int, forward: bool = False) -> DataFrame:
    edges = _edges(spark, root)
    return S.reach(edges, _seed(edges, forward), depth, forward)


def _bfs(depth: int, forward: bool = False) -> str:
    a, b = ("source_chunk_id", "target_chunk_id") if forward else ("target_chunk_id", "source_chunk_id")
    return f"""WITH RECURSIVE {GRAPH}, e AS MATERIALIZED (SELECT DISTINCT {a} AS a, {b} AS b FROM edges),
seed AS (SELECT {a} AS chunk_id FROM edges GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1), walk AS (SELECT chunk_id, 0 AS hop FROM seed UNION SELECT b, hop + 1 FROM walk JOIN e ON e.a = walk.chunk_id WHERE hop < {depth}),
best AS (SELECT chunk_id, min(hop)::BIGINT AS hop FROM walk WHERE chunk_id IS NOT NULL GROUP BY 1)"""


@book.query(f"{_bfs(2)} SELECT chunk_id, hop FROM best")
def impact_radius(spark: SparkSession, root: str) -> DataFrame:
    """What depends on one chunk within two hops."""
    return _walk(spark, root, 2)


@book.query(f"{_bfs(2, True)} SELECT chunk_id, hop FROM best")
def dependency_reach(spark: SparkSession, root: str) -> DataFrame:
    """What one chunk depends on within two hops."""
    return _walk(spark, root, 2, forward=True)


@book.query(f"{_bfs(4)} SELECT chunk_id, round(CASE WHEN hop = 0 THEN 0.0 ELSE pow(0.8, hop) END, 6) AS staleness FROM best")
def staleness_decay(spark: SparkSession, root: str) -> DataFrame:
    """Staleness of what depends on one changed chunk."""
    edges = _edges(spark, root)
    return S.staleness(edges, _seed(edges)).withColumn("staleness", F.round("staleness", 6))


_PATH = """(SELECT b.document_path FROM edges JOIN cp b ON b.chunk_id = target_chunk_id WHERE edge_type = 'cross_file' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"""
_COUPLE = f"""WITH {GRAPH}, cp AS (SELECT chunk_id, min(document_path) AS document_path FROM s GROUP BY 1), target AS (SELECT {_PATH} AS p),
files AS (SELECT name, count(DISTINCT document_path) AS files FROM s WHERE role = 'definition' GROUP BY name),
weights AS (SELECT name, CASE WHEN name IN ({_NOISE}) OR length(name) <= 3 THEN 0 ELSE 1 / (1 + log2(greatest(coalesce(files, 1), 1))) END AS weight FROM (SELECT DISTINCT symbol_name AS name FROM edges) LEFT JOIN files USING (name))"""


def _coupled(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame, str]:
    """Edges, chunks' paths, symbols, and the file that most edges from other files lead to."""
    edges, paths = _edges(spark, root), _paths(spark, root)
    into = edges.where("edge_type = 'cross_file'").join(paths.select(F.col("chunk_id").alias("target_chunk_id"), "document_path"), "target_chunk_id")
    best = into.groupBy("document_path").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "document_path").first()
    return edges, paths, _symbols(spark, root), best[0] if best else ""


@book.query(f"""{_COUPLE}, e AS (SELECT CASE WHEN a.document_path = p THEN b.document_path ELSE a.document_path END AS path, a.document_path = p AS o, symbol_name AS name
  FROM edges JOIN cp a ON a.chunk_id = source_chunk_id JOIN cp b ON b.chunk_id = target_chunk_id, target WHERE (a.document_path = p OR b.document_path = p) AND a.document_path <> b.document_path),
n AS (SELECT path, count(*)::BIGINT AS names, round(sum(weight), 2) AS weight FROM (SELECT DISTINCT path, name FROM e) JOIN weights USING (name) GROUP BY path)
SELECT path, CASE WHEN bool_and(o) THEN 'depends_on' WHEN bool_or(o) THEN 'bidirectional' ELSE 'depended_on_by' END AS direction, count(*)::BIGINT AS edges, any_value(names) AS names, any_value(weight) AS weight FROM e JOIN n USING (path) GROUP BY path""")
def coupling(spark: SparkSession, root: str) -> DataFrame:
    """The files that share edges with one file."""
    return S.coupling(*_coupled(spark, root))


@book.query(f"""{_COUPLE}, e AS (SELECT source_chunk_id, document_path AS tp, symbol_name AS name FROM edges JOIN cp ON cp.chunk_id = target_chunk_id),
u AS (SELECT DISTINCT source_chunk_id FROM e, target WHERE tp = p),
o AS (SELECT tp AS path, cp.document_path AS sp, name FROM e JOIN u USING (source_chunk_id) JOIN cp ON cp.chunk_id = source_chunk_id, target WHERE tp <> p),
n AS (SELECT path, count(*)::BIGINT AS names, round(sum(weight), 2) AS weight FROM (SELECT DISTINCT path, name FROM o) JOIN weights USING (name) GROUP BY path)
SELECT path, count(DISTINCT sp)::BIGINT AS consumers, any_value(names) AS names, round(any_value(weight) + round(count(DISTINCT sp) * 0.5, 2), 2) AS score FROM o JOIN n USING (path) GROUP BY path""")
def co_consumers(spark: SparkSession, root: str) -> DataFrame:
    """The files that share their users with one file."""
    return S.co_consumers(*_coupled(spark, root))


@book.query(f"""WITH {GRAPH} SELECT chunk_id, count(*) FILTER (WHERE side = 'out')::BIGINT AS depends_on, count(*) FILTER (WHERE side = 'in')::BIGINT AS depended_on_by
FROM (SELECT source_chunk_id AS chunk_id, 'out' AS side FROM edges UNION ALL SELECT target_chunk_id, 'in' FROM edges) GROUP BY chunk_id""")
def edge_degrees(spark: SparkSession, root: str) -> DataFrame:
    """Edges out of and into every chunk that has one."""
    sides = _edges(spark, root).select(F.explode(F.array(F.struct(F.col("source_chunk_id").alias("c"), F.lit("out").alias("s")), F.struct(F.col("target_chunk_id").alias("c"), F.lit("in").alias("s")))).alias("x"))
    return sides.groupBy(F.col("x.c").alias("chunk_id")).agg(F.count_if(F.col("x.s") == "out").alias("depends_on"), F.count_if(F.col("x.s") == "in").alias("depended_on_by"))
