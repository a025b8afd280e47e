"""Queries of composed search answers, stored vectors, and what a reader asks about single places."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.functions import embedding
from quillgraph.functions import query as Q
from quillgraph.functions import text as T
from quillgraph import session
from quillgraph.operators import answers, bm25, chunkers, compose, extraction, features, grep, indexing, vectors
from quillgraph.operators import symbols as S
from quillgraph.plans import ingest
from quillgraph.plans.base import Book
from quillgraph.plans.graph import GRAPH, _edges, _paths, _seed
from quillgraph.plans.retrieval import _SPLIT_SQL, _WORDS, PARTS, QUERY, SCORED, _index
from quillgraph.plans.retrieval import _raw as _content
from quillgraph.functions.stem import stem_sql
from quillgraph.plans.store import BASE, LITERAL, LINES, C, _chunks
from quillgraph.sources import files
from quillgraph.sources.files import normal_path
from quillgraph.sources.tables import table

book = Book()


def tokens_sql(t: str) -> str:
    """The token estimate in DuckDB: one sign a piece, then the joined pairs.  Capital runs before a digit, an underscore or a letter of another script are no pieces."""
    k = f"translate({t}, chr(1) || chr(2) || chr(3), '!!!')"
    k = f"regexp_replace({k}, '[A-Z]+([0-9_]|[^\\x00-\\x7F\\P{{L}}]|[^\\x00-\\x7F\\P{{N}}])', '_\\1', 'g')"
    k = f"regexp_replace({k}, '[A-Z]?[a-z]+|[A-Z]+|[0-9]+', chr(1), 'g')"
    k = f"regexp_replace({k}, '[\\s\\x0b\\x1c-\\x1f\\x85\\p{{Z}}]+', chr(2), 'g')"
    k = f"regexp_replace({k}, '[\\p{{L}}\\p{{N}}_]+', '', 'g')"
    k = f"regexp_replace({k}, '[^\\x01\\x02]', chr(3), 'g')"
    return f"greatest(1, length(regexp_replace({k}, '\\x02[\\x01\\x03]|\\x03\\x03', chr(3), 'g')))::BIGINT"


@book.query(f"WITH {C} SELECT chunk_id, {tokens_sql('content')} AS estimated_tokens FROM c")
def estimated_token_counts(spark: SparkSession, root: str) -> DataFrame:
    """The token estimate of every chunk."""
    rows = _content(spark, root).where(F.col("chunk_id").isNotNull())
    return rows.select("chunk_id", T.estimated_tokens("content").alias("estimated_tokens")).dropDuplicates(["chunk_id"])


_EDGE = "[\\s\\x0b\\x1c-\\x1f\\x85\\p{Z}]+"
_STRIPPED = f"regexp_replace(regexp_replace(raw, '^{_EDGE}', ''), '{_EDGE}$', '')"


@book.query(f"""WITH d AS (SELECT doc_id AS doc, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+$') AS l FROM documents WHERE doc_id IS NOT NULL),
p AS (SELECT doc, t, l, greatest(1, 256 // greatest(1, {tokens_sql('t')} // greatest(len(l), 1)))::BIGINT AS per FROM d),
g AS (SELECT doc, unnest(CASE WHEN len(l) = 0 THEN []::VARCHAR[] ELSE list_transform(range(0, (len(l) - 1) // per + 1), lambda k: array_to_string(list_slice(l, k * per + 1, (k + 1) * per), '')) END) AS raw, generate_subscripts(range(0, (len(l) - 1) // per + 1), 1) AS k FROM p WHERE len(l) > 0),
x AS (SELECT doc, k, {_STRIPPED} AS content, coalesce(sum(length(raw)) OVER (PARTITION BY doc ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_pos FROM g),
f AS (SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY k) - 1 AS chunk_index, content, start_pos, start_pos + length(content) AS end_pos FROM x WHERE content <> '')
SELECT * FROM f UNION ALL SELECT doc, 0, '', 0, 0 FROM d WHERE doc NOT IN (SELECT doc FROM f)""")
def line_chunks(spark: SparkSession, root: str) -> DataFrame:
    return ingest.line_chunks(spark, root)


_BLANK = "[\\s\\x0b]"
_DENSITY = f"""CASE WHEN {{x}} = '' THEN 0.0 ELSE least(1.0, 0.3 * greatest(0.0, 1 - (length({{x}}) - (len(string_split({{x}}, chr(10))) - 1)) / len(string_split({{x}}, chr(10))) / 80.0)
 + 0.3 * least(1.0, (length({{x}}) - length(regexp_replace({{x}}, '[{{{{}}}}\\[\\]()<>:=|&%$#@!~`]', '', 'g'))) / greatest(length({{x}}), 1) * 10)
 + 0.2 * len(list_filter(string_split({{x}}, chr(10)), lambda l: regexp_matches(l, '^[ \\t]'))) / len(string_split({{x}}, chr(10)))
 + 0.2 * len(list_filter(string_split({{x}}, chr(10)), lambda l: regexp_matches(l, '^{_BLANK}*([-*•]|[0-9]+[.)]){_BLANK}'))) / len(string_split({{x}}, chr(10)))) END"""


@book.query(f"""WITH RECURSIVE d AS (SELECT doc_id AS doc, coalesce(text, '') AS t FROM documents WHERE doc_id IS NOT NULL),
r AS (SELECT doc, unnest(regexp_split_to_array(t, '\\n{_BLANK}*\\n')) AS raw, generate_subscripts(regexp_split_to_array(t, '\\n{_BLANK}*\\n'), 1) AS k FROM d),
p AS (SELECT doc, x, row_number() OVER (PARTITION BY doc ORDER BY k) AS i FROM (SELECT doc, k, {_STRIPPED} AS x FROM r) WHERE x <> ''),
z AS MATERIALIZED (SELECT doc, x, i, {tokens_sql('x')} AS n, greatest(128, least(floor(256 * (1 - ({_DENSITY.format(x='x')}) * 0.5)), 4096)) AS lim FROM p),
g AS (SELECT doc, i, n AS total, 0 AS run FROM z WHERE i = 1 UNION ALL SELECT z.doc, z.i, CASE WHEN g.total + z.n > z.lim THEN z.n ELSE g.total + z.n END, CASE WHEN g.total + z.n > z.lim THEN run + 1 ELSE run END FROM g JOIN z ON z.doc = g.doc AND z.i = g.i + 1),
c AS (SELECT doc, run, string_agg(x, chr(10) || chr(10) ORDER BY i) AS content FROM z JOIN g USING (doc, i) GROUP BY ALL),
f AS (SELECT doc, run AS chunk_index, content, coalesce(sum(length(content) + 2) OVER (PARTITION BY doc ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_pos FROM c)
SELECT doc, chunk_index::BIGINT AS chunk_index, content, start_pos, start_pos + length(content) + 2 AS end_pos FROM f UNION ALL SELECT doc, 0, '', 0, 0 FROM d WHERE doc NOT IN (SELECT doc FROM f)""")
def paragraph_chunks(spark: SparkSession, root: str) -> DataFrame:
    return ingest.paragraph_chunks(spark, root)


@book.query(f"""WITH RECURSIVE d AS (SELECT doc_id AS doc, coalesce(text, '') AS t FROM documents WHERE doc_id IS NOT NULL), full_ AS (SELECT doc, t FROM d WHERE regexp_matches(t, '[^\\s\\x0b\\x1c-\\x1f\\x85\\p{{Z}}]')),
s AS (SELECT doc, string_split(regexp_replace(t, '([.!?]){_BLANK}+', '\\1' || chr(1), 'g'), chr(1)) AS s, list_append(list_transform(regexp_extract_all(t, '[.!?]{_BLANK}+'), lambda x: length(x) - 1), 0) AS g FROM (SELECT doc, replace(t, chr(1), '!') AS t FROM full_)),
u AS (SELECT doc, unnest(s) AS x, unnest(g) AS gap, generate_subscripts(s, 1) AS i FROM s),
n AS MATERIALIZED (SELECT doc, x, i, {tokens_sql('x')} AS n, length(x) + gap AS w FROM u),
p AS MATERIALIZED (SELECT doc, list(x ORDER BY i) AS xs, list_prepend(0::BIGINT, list(total ORDER BY i)) AS p, list_prepend(0::BIGINT, list(at_ ORDER BY i)) AS q, count(*) AS m FROM (SELECT doc, x, i, (sum(n) OVER (PARTITION BY doc ORDER BY i ROWS UNBOUNDED PRECEDING))::BIGINT AS total, (sum(w) OVER (PARTITION BY doc ORDER BY i ROWS UNBOUNDED PRECEDING))::BIGINT AS at_ FROM n) GROUP BY doc),
a AS (SELECT doc, 0::BIGINT AS k, 0::BIGINT AS first_, e FROM (SELECT doc, least(coalesce(list_min(list_filter(range(1, m + 1), lambda j: p[j + 1] >= 256)), m), coalesce(list_max(list_filter(range(0, m + 1), lambda j: p[j + 1] <= 4096)), 0)) AS e FROM p) WHERE e > 0
 UNION ALL SELECT doc, k, first_, e FROM (SELECT doc, k, first_, least(coalesce(list_min(list_filter(range(first_ + 1, m + 1), lambda j: p[j + 1] >= p[first_ + 1] + 256)), m), coalesce(list_max(list_filter(range(first_, m + 1), lambda j: p[j + 1] <= p[first_ + 1] + 4096)), 0)) AS e
  FROM (SELECT a.doc, a.k + 1 AS k, p.p, p.m, greatest(a.first_ + 1, coalesce(list_min(list_filter(range(0, p.m + 1), lambda j: p.p[j + 1] >= p.p[a.e + 1] - 32)), 0)) AS first_ FROM a JOIN p USING (doc) WHERE a.e < p.m)) WHERE e > first_),
f AS (SELECT a.doc, k AS chunk_index, array_to_string(list_slice(xs, first_ + 1, e), ' ') AS content, q[first_ + 1] AS start_pos FROM a JOIN p USING (doc))
SELECT doc, chunk_index, content, start_pos, start_pos + length(content) AS end_pos FROM f UNION ALL SELECT doc, 0, '', 0, 0 FROM d WHERE doc NOT IN (SELECT doc FROM f)""")
def sentence_window_chunks(spark: SparkSession, root: str) -> DataFrame:
    return ingest.sentence_window_chunks(spark, root)


def _cut_sql() -> str:
    """The text cut before the definitions of its language: the boundary's line feed goes along with what it begins."""
    out = ""
    for ext, pattern in chunkers.BOUNDARIES.items():
        p = pattern.replace("'", "''").replace("\\w", "[\\p{L}\\p{N}_]").replace("[[\\p{L}\\p{N}_]", "[\\p{L}\\p{N}_")
        out += f" WHEN ext = '{ext}' THEN regexp_replace(t, '(\\A|\\n)({p})', chr(1) || '\\1\\2', 'g')"
    js = chunkers._JS.replace("'", "''")
    return f"CASE{out} ELSE regexp_replace(t, '(\\A|\\n)({js})', chr(1) || '\\1\\2', 'g') END"


@book.query(f"""WITH RECURSIVE d AS (SELECT doc_id AS doc, replace(coalesce(text, ''), chr(1), ' ') AS t, lower(regexp_extract(document_path, '[^/.][^/]*\\.([^/.]+)$', 1)) AS ext FROM documents WHERE doc_id IS NOT NULL AND NOT suffix(lower(document_path), '.py') AND lower(regexp_extract(document_path, '[^/.][^/]*(\\.[^/.]+)$', 1)) IN ({', '.join(repr(x) for x in T.CODE_EXTENSIONS)})),
c AS (SELECT doc, t, list_filter(string_split({_cut_sql()}, chr(1)), lambda x: x <> '') AS c, len(string_split({_cut_sql()}, chr(1))) AS k FROM d),
l AS (SELECT doc, t, c, k, regexp_extract_all(t, '[^\\n]*\\n|[^\\n]+$') AS l FROM c), m AS (SELECT *, greatest(1, 256 // greatest(1, {tokens_sql('t')} // greatest(len(l), 1)))::BIGINT AS per FROM l),
q AS (SELECT doc, k > 1 AS defined, CASE WHEN k > 1 THEN c WHEN len(l) = 0 THEN []::VARCHAR[] ELSE list_transform(range(0, (len(l) - 1) // per + 1), lambda j: array_to_string(list_slice(l, j * per + 1, (j + 1) * per), '')) END AS x FROM m),
u AS (SELECT doc, defined, unnest(x) AS x, generate_subscripts(x, 1) AS i FROM q), z AS MATERIALIZED (SELECT *, {tokens_sql('x')} AS n FROM u),
g AS (SELECT doc, i, n AS total, 0 AS run FROM z WHERE i = 1 UNION ALL SELECT z.doc, z.i, CASE WHEN NOT defined OR g.total + z.n > 256 THEN z.n ELSE g.total + z.n END, CASE WHEN NOT defined OR g.total + z.n > 256 THEN run + 1 ELSE run END FROM g JOIN z ON z.doc = g.doc AND z.i = g.i + 1),
r AS (SELECT doc, run, bool_and(defined) AS defined, string_agg(x, '' ORDER BY i) AS raw FROM z JOIN g USING (doc, i) GROUP BY ALL),
s AS (SELECT doc, run, defined, length(raw) AS w, {_STRIPPED} AS content, coalesce(sum(length(raw)) OVER (PARTITION BY doc ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_pos FROM r),
f AS (SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY run) - 1 AS chunk_index, content, start_pos, start_pos + CASE WHEN defined THEN w ELSE length(content) END AS end_pos FROM s WHERE content <> '')
SELECT * FROM f UNION ALL SELECT doc, 0, '', 0, 0 FROM d WHERE doc NOT IN (SELECT doc FROM f)""")
def pattern_chunks(spark: SparkSession, root: str) -> DataFrame:
    """The code chunks of all languages that are cut by patterns."""
    d = table(spark, root, "documents").where((T.modality("document_path") == "code") & ~F.endswith(F.lower("document_path"), F.lit(".py")))
    return chunkers.code(d, "doc_id", "text", "document_path")


@book.query("SELECT event_id, json(props)::VARCHAR AS notes FROM events")
def parsed_notes(spark: SparkSession, root: str) -> DataFrame:
    """Every event's properties as notes: JSON in its plain form, other text as it is."""
    return table(spark, root, "events").select("event_id", compose.parsed_notes("props").alias("notes"))


_LOWER_WORDS = _WORDS.format(t="lo")
_BARE = "regexp_replace(regexp_replace(l, '^[\\s\\x0b\\x1c-\\x1f\\x85\\p{Z}]+', ''), '[\\s\\x0b\\x1c-\\x1f\\x85\\p{Z}]+$', '')"


@book.query(f"""WITH {C}, b AS (SELECT chunk_id, content AS t, lower(content) AS lo, greatest(length(content), 1)::DOUBLE AS n FROM c WHERE content IS NOT NULL),
g3 AS (SELECT chunk_id, list(k ORDER BY k DESC)[1:64] AS v FROM (SELECT chunk_id, g, count(*) AS k FROM (SELECT chunk_id, substr(lo, unnest(range(1, length(lo) - 1)), 3) AS g FROM b) GROUP BY ALL) GROUP BY 1),
w AS (SELECT chunk_id, list_filter({_LOWER_WORDS}, lambda x: length(x) > 2) AS w FROM b),
g1 AS (SELECT chunk_id, list(k ORDER BY k DESC)[1:16] AS v FROM (SELECT chunk_id, x, count(*) AS k FROM (SELECT chunk_id, unnest(w) AS x FROM w) GROUP BY ALL) GROUP BY 1),
g2 AS (SELECT chunk_id, list(k ORDER BY k DESC)[1:16] AS v FROM (SELECT chunk_id, x, count(*) AS k FROM (SELECT chunk_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS x FROM w) GROUP BY ALL) GROUP BY 1),
ls AS (SELECT chunk_id, l, {_BARE} AS x, i FROM (SELECT chunk_id, unnest(string_split(t, chr(10))) AS l, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM b)),
st AS (SELECT chunk_id, count(*)::DOUBLE AS k, count_if(starts_with(x, '#')) AS h, count_if(starts_with(x, 'def ')) AS f, count_if(starts_with(x, 'class ')) AS s, count_if(x <> '') AS full_, lower(arg_min(x, i)) AS head,
 avg(CASE WHEN x <> '' THEN length(l) - length(regexp_replace(l, '^[\\s\\x0b\\x1c-\\x1f\\x85\\p{{Z}}]+', '')) END) AS ia, max(CASE WHEN x <> '' THEN length(l) - length(regexp_replace(l, '^[\\s\\x0b\\x1c-\\x1f\\x85\\p{{Z}}]+', '')) END) AS im, var_pop(CASE WHEN x <> '' THEN length(l) - length(regexp_replace(l, '^[\\s\\x0b\\x1c-\\x1f\\x85\\p{{Z}}]+', '')) END) AS iv FROM ls GROUP BY 1),
an AS (SELECT chunk_id, regexp_extract_all(lo, '[\\p{{L}}\\p{{N}}_]+') AS a FROM b),
v AS (SELECT b.chunk_id, list_transform(coalesce(g3.v, []), lambda k: k / n) AS v3, list_concat(list_transform(coalesce(g1.v, []), lambda k: k / greatest(len(w), 1)::DOUBLE), list_transform(coalesce(g2.v, []), lambda k: k / greatest(len(w) - 1, 1)::DOUBLE)) AS v2,
 [k / 100, (length(t) - k + 1) / n, h / k, f / k, s / k, (length(t) - length(replace(t, '(', ''))) / n, (length(t) - length(replace(t, '{{', ''))) / n, (length(t) - length(replace(t, '[', ''))) / n,
  CASE WHEN contains(head, 'def ') OR contains(head, 'function ') THEN 1.0 ELSE 0.0 END, CASE WHEN contains(head, 'class ') THEN 1.0 ELSE 0.0 END, CASE WHEN contains(head, 'import ') OR contains(head, 'from ') OR contains(head, '#include') OR contains(head, 'require') THEN 1.0 ELSE 0.0 END,
  least(coalesce(ia, 0) / 16, 1), least(coalesce(im, 0) / 32, 1), least(coalesce(iv, 0) / 64, 1), full_ / k, least((length(t) - length(replace(t, '#', ''))) / n * 10, 1), CASE WHEN len(a) > 0 THEN len(list_distinct(a)) / len(a) ELSE 0 END, CASE WHEN len(a) > 0 THEN least(list_sum(list_transform(a, lambda x: length(x))) / len(a) / 10, 1) ELSE 0 END,
  least((length(t) - length(translate(t, '.,;:!?', ''))) / n * 10, 1), least((length(t) - length(regexp_replace(t, '[\\p{{Nd}}²³¹⁰-⁹₀-₉①-⑨]', '', 'g'))) / n * 5, 1)] AS v1
 FROM b JOIN st USING (chunk_id) JOIN w USING (chunk_id) JOIN an USING (chunk_id) LEFT JOIN g3 USING (chunk_id) LEFT JOIN g1 USING (chunk_id) LEFT JOIN g2 USING (chunk_id)),
q AS (SELECT *, sqrt(coalesce(list_sum(list_transform(v3, lambda x: x * x)), 0) + coalesce(list_sum(list_transform(v2, lambda x: x * x)), 0) + list_sum(list_transform(v1, lambda x: x * x))) AS z FROM v)
SELECT chunk_id, round(coalesce(list_sum(v3), 0) / z, 2) AS trigrams, round(coalesce(list_sum(v2), 0) / z, 2) AS words, round(list_sum(v1) / z, 2) AS structure FROM q""")
def chunk_fingerprints(spark: SparkSession, root: str) -> DataFrame:
    """Every chunk's fingerprint, told by the sums of its trigram, word and structure numbers."""
    part = lambda a, n: F.round(F.aggregate(F.slice("signature", a, n), F.lit(0.0), lambda s, x: s + x.cast("double")), 2)
    v = features.fingerprints(_content(spark, root).where("chunk_id IS NOT NULL AND content IS NOT NULL"), "chunk_id", "content")
    return v.select("chunk_id", part(1, 64).alias("trigrams"), part(65, 32).alias("words"), part(97, 32).alias("structure")).dropDuplicates(["chunk_id"])


_B1, _UB = "[\\s\\x0b]", "[\\s\\x0b\\x1c-\\x1f\\x85\\p{Z}]"


def _figures_sql() -> str:
    """The 32 figures in DuckDB, from w (words), k (code lines), d (depth), and t (text)."""
    hit = lambda signs: "(" + " OR ".join(f"contains(t, '{x}')" for x in signs) + ")"
    within = lambda x: f"greatest(-1.0, least(1.0, {x}))"
    count = {n: "len(regexp_extract_all(t, '" + p.replace("'", "''").replace("\\s", _B1) + "'))::DOUBLE" for n, p in embedding.SIGNALS.items()}
    n, m = "greatest(1.0, k)", "len(w)::DOUBLE"
    f, c = count["functions"], count["comments"]
    out = {name: within(f"({' + '.join(f'''len(list_filter(w, lambda x: contains(x, '{x}')))''' for x in words.split())}) / greatest(1.0, {m}) * 20") for name, words in embedding.TOPICS.items()}
    out |= {
        "qual_abstract": within(f"{m} / 100 - 0.5"), "qual_size": within("k / 50 - 1"), "qual_stable": "0.5", "qual_legacy": f"CASE WHEN {hit(embedding.OLD)} THEN -0.5 ELSE 0.0 END", "qual_typed": f"CASE WHEN {hit(embedding.TYPED)} THEN 1.0 ELSE -1.0 END",
        "qual_pure": f"CASE WHEN {hit(embedding.IMPURE)} THEN -0.5 ELSE 1.0 END", "qual_stateful": f"CASE WHEN {hit(embedding.STATEFUL)} THEN 1.0 ELSE -1.0 END", "qual_async": f"CASE WHEN {hit(['async ', 'await '])} THEN 1.0 ELSE -1.0 END",
        "sig_imports": within(f"{count['imports']} / {n} * 10"), "sig_exports": within(f"{count['exports']} / {n} * 10"), "sig_functions": within(f"{f} / {n} * 5 - 1"), "sig_classes": within(f"{count['classes']} / {n} * 5 - 1"), "sig_tests": within(f"{count['tests']} / {n} * 10"),
        "sig_errors": within(f"{count['errors']} / {n} * 5 - 1"), "sig_comments": within(f"{c} / {n} * 10 - 2"), "sig_strings": within(f"{count['strings']} / {n} * 5 - 2"), "ctx_depth": within("d / 20 - 0.5"), "ctx_arity": within(f"(length(t) - length(replace(t, ',', '')))::DOUBLE / greatest(1.0, {f}) / 3 - 0.5"),
        "ctx_scope": within(f"{m} / 200 - 0.5"), "ctx_coupling": within(f"{count['imports']} / 10 - 0.5"), "ctx_cohesion": "0.5", "ctx_coverage": "0.0", "ctx_doc": within(f"{c} / greatest(1.0, {f} + {count['classes']}) - 1"), "ctx_maintain": within(f"{c} / {n} * 5 - 1"),
    }
    assert list(out) == embedding.FIGURES
    return ", ".join(f"({v})::DOUBLE AS {name}" for name, v in out.items())


_FADE = [math.exp(-(o**2) / (2 * embedding.SPREAD**2)) for o in range(embedding.WIDTH)]


@book.query(f"""WITH {C}, b AS (SELECT chunk_id, content AS t, regexp_extract_all(lower(content), '[a-zA-Z_][a-zA-Z0-9_]*') AS w, list_filter(string_split(regexp_replace(content, '\\r\\n|\\r', chr(10), 'g'), chr(10)), lambda x: regexp_matches(x, '[^\\s\\x0b\\x1c-\\x1f\\x85\\p{{Z}}]')) AS l FROM c WHERE content IS NOT NULL),
x AS (SELECT chunk_id, t, w, len(list_filter(l, lambda x: NOT regexp_matches(x, '^{_UB}*(#|//)')))::DOUBLE AS k, coalesce(list_max(list_transform(l, lambda x: length(regexp_extract(x, '^{_UB}*')))), 0)::DOUBLE AS d FROM b),
f AS (SELECT chunk_id, {_figures_sql()} FROM x), v AS (SELECT *, [{', '.join(embedding.FIGURES)}] AS z FROM f),
u AS (SELECT *, list_concat({', '.join(f"list_transform(z, lambda y: (y + 1) / 2 * {w!r}::DOUBLE)" for w in _FADE)}) AS q FROM v)
SELECT chunk_id, {', '.join(f'round({n}, 6) AS {n}' for n in embedding.FIGURES)}, round(list_sum(q) / sqrt(list_sum(list_transform(q, lambda y: y * y))), 4) AS vector_sum, round((z[32] + 1) / 2 * {_FADE[3]!r}::DOUBLE / sqrt(list_sum(list_transform(q, lambda y: y * y))), 4) AS vector_last FROM u""")
def text_figures(spark: SparkSession, root: str) -> DataFrame:
    """The 32 figures of every chunk, and the sum and the end of the vector spread from them."""
    rows = _content(spark, root).where("chunk_id IS NOT NULL AND content IS NOT NULL").select("chunk_id", embedding.figures("content").alias("f"))
    rows = rows.withColumn("v", embedding.spread(F.col("f")))
    total = F.aggregate("v", F.lit(0.0), lambda s, x: s + x)
    return rows.select("chunk_id", *[F.round(F.col(f"f.{n}"), 6).alias(n) for n in embedding.FIGURES], F.round(total, 4).alias("vector_sum"), F.round(F.element_at("v", 128), 4).alias("vector_last")).dropDuplicates(["chunk_id"])


_SPREAD = "list_concat(" + ", ".join(f"list_transform(z, lambda y: (y + 1) / 2 * {w!r}::DOUBLE)" for w in _FADE) + ")"


@book.query(f"""WITH c AS (SELECT chunk_id, any_value(document_path) AS document_path, any_value(substr(content, 1, 4000)) AS content, any_value(start_pos) AS start_pos FROM chunks WHERE chunk_id IS NOT NULL GROUP BY 1),
b AS (SELECT chunk_id, start_pos, content AS t, regexp_extract_all(lower(content), '[a-zA-Z_][a-zA-Z0-9_]*') AS w, list_filter(string_split(regexp_replace(content, '\\r\\n|\\r', chr(10), 'g'), chr(10)), lambda x: regexp_matches(x, '[^\\s\\x0b\\x1c-\\x1f\\x85\\p{{Z}}]')) AS l FROM c WHERE content IS NOT NULL),
x AS (SELECT chunk_id, start_pos, t, w, len(list_filter(l, lambda x: NOT regexp_matches(x, '^{_UB}*(#|//)')))::DOUBLE AS k, coalesce(list_max(list_transform(l, lambda x: length(regexp_extract(x, '^{_UB}*')))), 0)::DOUBLE AS d FROM b),
f AS (SELECT chunk_id, start_pos, {_figures_sql()} FROM x), v AS (SELECT chunk_id, CASE WHEN start_pos % 3 = 0 THEN list_transform(range(32), lambda i: i / 64.0::DOUBLE) ELSE [{', '.join(embedding.FIGURES)}] END AS z FROM f), u AS (SELECT *, {_SPREAD} AS q FROM v)
SELECT chunk_id, round(list_sum(q) / sqrt(list_sum(list_transform(q, lambda y: y * y))), 4) AS vector_sum, round((z[1] + 1) / 2 / sqrt(list_sum(list_transform(q, lambda y: y * y))), 4) AS first_ FROM u""")
def embedded_texts(spark: SparkSession, root: str) -> DataFrame:
    """The vector of every chunk's text by its figures; every third chunk comes with figures of its own."""
    given = F.when(F.col("start_pos") % 3 == 0, F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: i / 64.0))
    rows = _content(spark, root).where("chunk_id IS NOT NULL AND content IS NOT NULL").select("chunk_id", embedding.embedded("content", given).alias("v"))
    return rows.select("chunk_id", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 4).alias("vector_sum"), F.round(F.element_at("v", 1), 4).alias("first_")).dropDuplicates(["chunk_id"])


@book.query(f"WITH {C}, q AS (SELECT chunk_id, string_split(content, chr(10))[1] AS summary FROM c WHERE content <> '' UNION ALL SELECT 'no-such-' || (doc_id % 7), 'x' FROM documents) SELECT DISTINCT chunk_id, chunk_id IN (SELECT chunk_id FROM c) AS stored FROM q")
def summaries_stored(spark: SparkSession, root: str) -> DataFrame:
    """The first line of every chunk as its summary, and which summaries found their chunk."""
    c = table(spark, root, "chunks").where(F.col("chunk_id").isNotNull())
    given = c.where("content <> ''").select("chunk_id", F.element_at(F.split("content", "\n"), 1).alias("summary"))
    given = given.unionByName(table(spark, root, "documents").select(F.concat(F.lit("no-such-"), (F.col("doc_id") % 7).cast("string")).alias("chunk_id"), F.lit("x").alias("summary")))
    stored, errors = features.summary_vectors(c.select("chunk_id"), given)
    return stored.where(F.size("signature") == 128).select("chunk_id", F.lit(True).alias("stored")).unionByName(errors.select("chunk_id", F.lit(False).alias("stored")))


def _line_symbols(endings: tuple[str, ...], language: str) -> str:
    ends = " OR ".join(f"suffix(document_path, '.{e}')" for e in endings)
    return f"""WITH {C}, l AS (SELECT chunk_id AS doc, unnest(string_split(regexp_replace(content, '\\r\\n?', chr(10), 'g'), chr(10))) AS l, generate_subscripts(string_split(regexp_replace(content, '\\r\\n?', chr(10), 'g'), chr(10)), 1)::BIGINT AS i FROM c WHERE {ends}),
x AS (SELECT doc, i, regexp_replace(l, '^\\s+|\\s+$', '', 'g') AS x FROM l) {ingest._line_rules(language)}"""


@book.query(_line_symbols(("java",), "java"))
def java_symbols(spark: SparkSession, root: str) -> DataFrame:
    docs = _content(spark, root).where(F.endswith("document_path", F.lit(".java")) & F.col("chunk_id").isNotNull()).select(F.col("chunk_id").alias("doc"), F.lit("java").alias("language"), F.col("content").alias("text"))
    return extraction.by_line(docs.dropDuplicates(["doc"])).drop("container")


# --- search answers

_MATCHES = f"""fc AS (SELECT chunk_id, document_path, start_pos, content FROM c WHERE contains(content, '{LITERAL}') ORDER BY document_path, start_pos, chunk_id LIMIT 500),
mp AS (SELECT chunk_id, document_path, start_pos, content, unnest(list_slice(list_filter(range(1, length(content) + 1), lambda i: substr(content, i, {len(LITERAL)}) = '{LITERAL}'), 1, 10)) - 1 AS at_ FROM fc),
ml AS (SELECT *, length(substr(content, 1, at_)) - length(replace(substr(content, 1, at_), chr(10), '')) AS i, row_number() OVER (PARTITION BY chunk_id ORDER BY at_) AS k FROM mp),
me AS (SELECT chunk_id, document_path, start_pos, k, i + 1 AS line_in_chunk, string_split(content, chr(10))[i + 1] AS excerpt FROM ml),
ds AS (SELECT DISTINCT ON (id) id, trim(name) AS name, lower(trim(role)) AS role, kind, chunk_id, document_path, line_number FROM symbols),
sc AS (SELECT chunk_id, k, arg_max(name, struct_pack(l := line_number, i := id)) AS scope FROM me JOIN (SELECT * FROM ds WHERE role = 'definition' AND name IS NOT NULL AND document_path IS NOT NULL AND kind IN ('function', 'class', 'method')) d USING (chunk_id) WHERE line_number <= line_in_chunk GROUP BY ALL),
en AS (SELECT row_number() OVER (ORDER BY me.document_path, start_pos, me.chunk_id, me.k) AS pos, me.document_path AS file, base_line + line_in_chunk - 1 AS line, excerpt, scope,
 regexp_replace(excerpt, '^\\s+', '') AS x FROM me JOIN b ON b.chunk_id = me.chunk_id LEFT JOIN sc ON sc.chunk_id = me.chunk_id AND sc.k = me.k),
cl AS (SELECT pos, file, line, excerpt, scope, CASE WHEN x = '' THEN 'blank' WHEN {' OR '.join("starts_with(x, '" + s + "')" for s in T.COMMENT_STARTS)} THEN 'comment' WHEN {' OR '.join("starts_with(x, '" + s + "')" for s in T.IMPORT_STARTS)} THEN 'import'
 WHEN {' OR '.join("starts_with(x, '" + s + "')" for s in T.DEFINITION_STARTS)} THEN 'definition' WHEN {' OR '.join("starts_with(x, '" + s.replace("'", "''") + "')" for s in T.STRING_STARTS)} THEN 'string' ELSE 'code' END AS classification FROM en),
co AS (SELECT *, trim(regexp_replace(excerpt, '\\s+', ' ', 'g')) AS e FROM cl),
cw AS (SELECT *, count(*) OVER w AS n, min(pos) OVER w AS f FROM co WINDOW w AS (PARTITION BY e)),
kp AS (SELECT *, CASE WHEN n > 2 THEN n - 1 ELSE 0 END AS dropped FROM cw WHERE n <= 2 OR pos = f),
gr AS (SELECT file AS key, count(*)::BIGINT AS count, sum(dropped)::BIGINT AS dropped, min(f) AS o, string_agg(concat_ws(' ', excerpt, scope, classification, ':' || line), ' ' ORDER BY f, pos) AS words FROM kp GROUP BY file),
gt AS (SELECT *, {tokens_sql("concat_ws(' ', key, words)")} AS tokens FROM gr),
gp AS (SELECT *, row_number() OVER (ORDER BY o, key) AS position, sum(tokens) OVER (ORDER BY o, key ROWS UNBOUNDED PRECEDING) AS total FROM gt),
gs AS (SELECT *, position < coalesce((SELECT min(position) FROM gp WHERE total > 850 AND position > 1), 1000000000) AS shown FROM gp)"""


def _grep(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(groups, matches) of the literal, within 1,000 tokens."""
    c = _chunks(spark, root)
    m = answers.entries(c, S.cleaned(table(spark, root, "symbols")), LITERAL)
    return answers.grouped(m, max_tokens=1000), m


@book.query(f"WITH {C}, {BASE}, {_MATCHES} SELECT position, key, count, tokens, shown, dropped FROM gs")
def grep_groups(spark: SparkSession, root: str) -> DataFrame:
    """The matches by file, repeated lines collapsed, up to a budget."""
    return _grep(spark, root)[0].drop("matches")


@book.query(f"""WITH {C}, {BASE}, {_MATCHES}, t AS (SELECT count(*) AS total, count(DISTINCT file) AS files FROM cl), h AS (SELECT coalesce(sum(count) FILTER (WHERE shown), 0) AS s, coalesce(sum(tokens) FILTER (WHERE shown), 0) AS k, coalesce(sum(dropped), 0) AS d FROM gs)
SELECT total AS total_matches, s::BIGINT AS shown_matches, greatest(0, total - s - d)::BIGINT AS truncated, k::BIGINT AS total_tokens, files,
concat_ws(' ', total || CASE WHEN total = 1 THEN ' match' ELSE ' matches' END, 'in ' || files || CASE WHEN files = 1 THEN ' file' ELSE ' files' END, CASE WHEN d > 0 THEN '(' || d || ' duplicates collapsed)' END, CASE WHEN total - s - d > 0 THEN '(showing ' || s || ', ~' || k || ' tokens)' END) AS summary FROM t, h""")
def grep_summary(spark: SparkSession, root: str) -> DataFrame:
    """What a reader is told about the matches."""
    return answers.summary(*_grep(spark, root))


@book.query(f"WITH {C}, m AS (SELECT document_path, len(list_filter(range(1, length(content) + 1), lambda i: substr(content, i, {len(LITERAL)}) = '{LITERAL}'))::BIGINT AS matches FROM c WHERE contains(content, '{LITERAL}')) SELECT sum(matches)::BIGINT AS matches, count(*)::BIGINT AS chunks, count(DISTINCT document_path)::BIGINT AS files FROM m")
def text_search_totals(spark: SparkSession, root: str) -> DataFrame:
    c = _content(spark, root).where(F.col("chunk_id").isNotNull())
    return answers.text_search_totals(grep.matching_chunks(c, LITERAL).dropDuplicates(["chunk_id"]))


@book.query(f"""WITH {SCORED}, h AS (SELECT id AS chunk_id, score FROM scored ORDER BY score DESC, id LIMIT 10), t AS (SELECT chunk_id, score, {tokens_sql("substr(content, 1, 400) || CASE WHEN length(content) > 400 THEN '…' ELSE '' END")} + 32 AS cost, content FROM h JOIN c USING (chunk_id)),
s AS (SELECT *, sum(cost) OVER (ORDER BY score DESC, chunk_id ROWS UNBOUNDED PRECEDING) AS total FROM t)
SELECT chunk_id, substr(content, 1, 400) || CASE WHEN length(content) > 400 THEN '…' ELSE '' END AS content_preview, {tokens_sql("content")} AS content_token_estimate FROM s WHERE total <= 900""")
def budgeted_search(spark: SparkSession, root: str) -> DataFrame:
    """The best chunks as previews, up to a budget of tokens."""
    hits = bm25.top(_index(spark, root).scores(QUERY), 10).select(F.col("id").alias("chunk_id"), "score")
    rows = hits.join(_content(spark, root).select("chunk_id", "content"), "chunk_id").dropDuplicates(["chunk_id"])
    return answers.within_tokens(rows, [F.desc("score"), F.col("chunk_id")], 900, compact=True).drop("score")


QUESTION = "where does load_chunk call clamp_range"
NAMES = [x for x in Q.identifiers(QUESTION) if "_" in x][:3]
_QW = _WORDS.format(t=f"'{QUESTION}'")


@book.query(f"""WITH {SCORED.replace(QUERY, QUESTION)}, k AS (SELECT id AS chunk_id, row_number() OVER (ORDER BY score DESC, id) AS pos FROM scored ORDER BY score DESC, id LIMIT 20),
d AS (SELECT DISTINCT ON (id) id, trim(name) AS name, lower(trim(role)) AS role, chunk_id, document_path FROM symbols),
s AS (SELECT chunk_id, min(CASE WHEN role = 'definition' THEN 0 ELSE 1000000000000 END + id) AS pos FROM d WHERE role IS NOT NULL AND chunk_id IS NOT NULL AND document_path IS NOT NULL AND name IN ({', '.join(repr(x) for x in NAMES)}) GROUP BY 1),
g AS (SELECT chunk_id, start_pos AS pos FROM c WHERE contains(content, '{NAMES[0]}(')),
u AS (SELECT chunk_id, pos, 0 AS s, 'semantic' AS source FROM k UNION ALL SELECT chunk_id, pos, 1, 'symbol' FROM s UNION ALL SELECT chunk_id, pos, 2, 'text' FROM g),
b AS (SELECT chunk_id, arg_min(source, struct_pack(s, pos)) AS source, min(struct_pack(s, pos)) AS o FROM u GROUP BY chunk_id), f AS (SELECT chunk_id, source FROM b ORDER BY o, chunk_id LIMIT 60)
SELECT source, count(*)::BIGINT AS results FROM f GROUP BY source""")
def question_sources(spark: SparkSession, root: str) -> DataFrame:
    """A question's results by source: ranked chunks, then chunks with its names (definitions first), then chunks with its text."""
    hits = bm25.top(_index(spark, root).scores(QUESTION), 20)
    k = hits.select(F.col("id").alias("chunk_id"), F.row_number().over(Window.orderBy(F.desc("score"), "id")).cast("long").alias("pos"))  # twenty rows
    named = S.cleaned(table(spark, root, "symbols")).where(F.col("name").isin(NAMES))
    s = named.groupBy("chunk_id").agg(F.min(F.when(F.col("role") == "definition", F.col("id")).otherwise(F.col("id") + 1_000_000_000_000)).alias("pos"))
    g = _content(spark, root).where(F.contains("content", F.lit(f"{NAMES[0]}("))).select("chunk_id", F.col("start_pos").cast("long").alias("pos"))
    return compose.first_sources([("semantic", k), ("symbol", s), ("text", g)], 60).groupBy("source").agg(F.count("*").alias("results"))


EVALUATED = ["load_chunk", "clamp_range", "dispatch_decoder", "load_snapshot"]


def _term_sql() -> str:
    return stem_sql("part", True)


@book.query(f"""WITH {PARTS}, qs AS (SELECT unnest([{', '.join(repr(x) for x in EVALUATED)}]) AS query_id), qp AS (SELECT query_id, {_term_sql()} AS term FROM (SELECT query_id, unnest({_SPLIT_SQL('query_id')}) AS part FROM qs) WHERE length(part) > 1),
q AS (SELECT query_id, term, count(*) AS qtf FROM qp GROUP BY ALL), dfs AS (SELECT term, count(*) AS df FROM posts GROUP BY ALL), total AS (SELECT count(*) AS n, avg(dl) AS a FROM dl),
scored AS (SELECT query_id, id, sum(qtf * ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1.0::DOUBLE) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / a))) AS score FROM posts JOIN q USING (term) JOIN dfs USING (term) JOIN dl USING (id), total GROUP BY ALL),
h AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM scored),
w AS (SELECT DISTINCT name AS query_id, chunk_id AS id FROM (SELECT DISTINCT ON (id) id, trim(name) AS name, lower(trim(role)) AS role, chunk_id, document_path FROM symbols) WHERE role = 'definition' AND chunk_id IS NOT NULL AND document_path IS NOT NULL AND name IN (SELECT query_id FROM qs))
SELECT query_id, 'definition' AS category, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END), 6) AS recall_at_5, round(avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0.0 END), 6) AS recall_at_10 FROM w LEFT JOIN h USING (query_id, id) GROUP BY query_id""")
def search_recall(spark: SparkSession, root: str) -> DataFrame:
    """How many of the chunks that define a name are among the first hits for it."""
    index = _index(spark, root)
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")
    hits = index.scores_batch({x: x for x in EVALUATED}).select("query_id", "id", F.row_number().over(w).cast("long").alias("rank"))
    d = S.cleaned(table(spark, root, "symbols")).where((F.col("role") == "definition") & F.col("name").isin(EVALUATED))
    return answers.recall(hits, d.select(F.col("name").alias("query_id"), F.lit("definition").alias("category"), F.col("chunk_id").alias("id")))


@book.query(f"""WITH {PARTS}, qs AS (SELECT DISTINCT trim(name) AS query_id FROM symbols WHERE name IS NOT NULL ORDER BY 1 LIMIT 100), qp AS (SELECT query_id, {_term_sql()} AS term FROM (SELECT query_id, unnest({_SPLIT_SQL('w')}) AS part FROM (SELECT query_id, unnest({_WORDS.format(t='query_id')}) AS w FROM qs)) WHERE length(part) > 1),
q AS (SELECT query_id, term, count(*) AS qtf FROM qp GROUP BY ALL), dfs AS (SELECT term, count(*) AS df FROM posts GROUP BY ALL), total AS (SELECT count(*) AS n, avg(dl) AS a FROM dl),
scored AS (SELECT query_id, id, sum(qtf * ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1.0::DOUBLE) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / a))) AS score FROM posts JOIN q USING (term) JOIN dfs USING (term) JOIN dl USING (id), total GROUP BY ALL),
h AS (SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM scored) SELECT query_id, id AS chunk_id, rank, score FROM h WHERE rank <= 5""")
def bm25_batch(spark: SparkSession, root: str) -> DataFrame:
    """The five best chunks of each of a hundred queries (the first names of the symbols), in one pass."""
    names = table(spark, root, "symbols").where(F.col("name").isNotNull()).select(F.trim("name").alias("n")).distinct().orderBy("n").limit(100)
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")
    s = _index(spark, root).scores_batch({r["n"]: r["n"] for r in names.collect()}).withColumn("rank", F.row_number().over(w).cast("long"))
    return s.where("rank <= 5").select("query_id", F.col("id").alias("chunk_id"), "rank", F.round("score", 6).alias("score"))


# --- single places

@book.query("SELECT doc_id, regexp_replace(regexp_replace(replace(document_path, chr(92), '/'), '/+', '/', 'g'), '^([.]/)+|/$', '', 'g') AS path FROM documents WHERE document_path IS NOT NULL")
def normalized_paths(spark: SparkSession, root: str) -> DataFrame:
    """Every file's path in its plain form."""
    return table(spark, root, "documents").where(F.col("document_path").isNotNull()).select("doc_id", normal_path("document_path").alias("path"))


@book.query("""WITH d AS (SELECT document_path, max(indexed_at) AS t FROM documents WHERE document_path IS NOT NULL AND indexed_at IS NOT NULL GROUP BY 1), n AS (SELECT document_path FROM d ORDER BY t DESC, document_path LIMIT (SELECT greatest(1, count(*) // 4) FROM d)),
e AS (SELECT string_split(regexp_replace(min(document_path), '/?[^/]*$', ''), '/') AS a, string_split(regexp_replace(max(document_path), '/?[^/]*$', ''), '/') AS b FROM n)
SELECT array_to_string(list_slice(a, 1, coalesce(list_min(list_filter(range(1, greatest(len(a), len(b)) + 2), lambda i: a[i] IS DISTINCT FROM b[i] OR i > len(a))), len(a) + 1) - 1), '/') AS folder FROM e""")
def recent_folder(spark: SparkSession, root: str) -> DataFrame:
    """The folder that the newest quarter of the files share."""
    return compose.recent_folder(table(spark, root, "documents"), "document_path", "indexed_at")


@book.query(f"""WITH {GRAPH}, {C} SELECT (SELECT count(*) FROM documents)::BIGINT AS documents, (SELECT count(*) FROM c)::BIGINT AS chunks, (SELECT sum(token_count) FROM c)::BIGINT AS tokens, (SELECT count(*) FROM s)::BIGINT AS symbols, (SELECT count(*) FROM edges)::BIGINT AS edges,
(SELECT count(DISTINCT (chunk_id, version)) FROM chunk_history)::BIGINT AS versions, (SELECT count(DISTINCT run_id) FROM index_runs)::BIGINT AS runs""")
def doctor(spark: SparkSession, root: str) -> DataFrame:
    """What is stored, in one row."""
    one = _chunks(spark, root).agg(F.count("*").alias("chunks"), F.sum("token_count").alias("tokens"))
    n = lambda d: d.agg(F.count("*")).scalar()
    t = lambda name: table(spark, root, name)
    return one.select(
        n(t("documents")).alias("documents"), "chunks", "tokens", n(S.cleaned(t("symbols"))).alias("symbols"), n(_edges(spark, root)).alias("edges"), n(t("chunk_history").select("chunk_id", "version").distinct()).alias("versions"), t("index_runs").agg(F.count_distinct("run_id")).scalar().alias("runs")
    )


@book.query(f"""WITH {C}, h AS (SELECT DISTINCT ON (chunk_id, version) chunk_id, version, content_hash, semantic_signature AS s FROM chunk_history WHERE chunk_id IS NOT NULL), cur AS (SELECT chunk_id, arg_max(struct_pack(h := content_hash, s := s), version) AS r FROM h GROUP BY 1),
k AS (SELECT DISTINCT ON (chunk_id) chunk_id, document_path, start_pos, end_pos, modality, staleness_score FROM chunks WHERE chunk_id IS NOT NULL), w AS (SELECT chunk_id, max(staleness_score) AS w FROM chunks GROUP BY 1),
n AS (SELECT k.chunk_id, document_path, start_pos, end_pos, modality, r.h AS h, r.s AS s FROM k JOIN cur USING (chunk_id) WHERE document_path LIKE 'm%' AND start_pos < 800),
o AS (SELECT k.chunk_id, document_path, start_pos, end_pos, h.content_hash AS h, h.s AS s FROM k JOIN h USING (chunk_id) JOIN w USING (chunk_id) WHERE h.version = 1 AND w < 0.3),
fine AS (SELECT chunk_id, s FROM o WHERE len(s) = 128 AND NOT list_bool_or(list_transform(s, lambda x: x IS NULL OR isnan(x)))),
m AS (SELECT n.*, o.h AS oh, o.s AS os, o.chunk_id IS NOT NULL AS met, CASE modality WHEN 'text' THEN 0.85 WHEN 'code' THEN 0.80 ELSE 0.85 END AS least FROM n LEFT JOIN o USING (document_path, start_pos, end_pos)),
z AS (SELECT chunk_id, s, least FROM m WHERE NOT met), zf AS (SELECT chunk_id, s FROM z WHERE len(s) = 128 AND NOT list_bool_or(list_transform(s, lambda x: x IS NULL OR isnan(x)))),
b AS (SELECT zf.chunk_id, max(CASE WHEN list_sum(list_transform(zf.s, lambda x: x * x)) = 0 OR list_sum(list_transform(fine.s, lambda x: x * x)) = 0 THEN 0.0 ELSE list_cosine_similarity(zf.s::DOUBLE[], fine.s::DOUBLE[]) END) AS near FROM zf, fine GROUP BY 1)
SELECT chunk_id, CASE WHEN h = oh OR coalesce(CASE WHEN len(s) = len(os) AND list_sum(list_transform(s, lambda x: x * x)) > 0 AND list_sum(list_transform(os, lambda x: x * x)) > 0 THEN list_cosine_similarity(s::DOUBLE[], os::DOUBLE[]) >= least AND NOT isnan(list_cosine_similarity(s::DOUBLE[], os::DOUBLE[])) END, false) THEN 'restored' ELSE 'reprocessed' END AS class FROM m WHERE met
UNION ALL SELECT z.chunk_id, CASE WHEN near >= least THEN 'restored' ELSE 'new' END FROM z LEFT JOIN b USING (chunk_id)""")
def chunk_changes(spark: SparkSession, root: str) -> DataFrame:
    """The first chunks of some files against the first versions of the fresh ones: by place and hash, by place and likeness, or by the nearest anywhere."""
    c = table(spark, root, "chunks").where(F.col("chunk_id").isNotNull())
    k = c.groupBy("chunk_id").agg(F.min("document_path").alias("path"), F.min("start_pos").alias("start_pos"), F.min("end_pos").alias("end_pos"), F.min("modality").alias("modality"), F.max("staleness_score").alias("w"))
    h = table(spark, root, "chunk_history").where(F.col("chunk_id").isNotNull())
    first = k.where(F.startswith("path", F.lit("m")) & (F.col("start_pos") < 800)).drop("w")
    now = h.join(first.select("chunk_id"), "chunk_id", "left_semi").groupBy("chunk_id").agg(F.max_by(F.struct("content_hash", "semantic_signature"), "version").alias("r")).select("chunk_id", "r.content_hash", F.col("r.semantic_signature").alias("signature"))
    then = h.where("version = 1").select("chunk_id", "content_hash", F.col("semantic_signature").alias("signature")).dropDuplicates(["chunk_id"])
    new = first.join(now, "chunk_id")
    old = k.where("w < 0.3").drop("w", "modality").join(then, "chunk_id")
    return indexing.chunk_changes(new, old)


@book.query("SELECT agent_id AS session_id, document_path AS chunk_id, id AS turn_number, '{\"kind\":\"' || change_type || '\"}' AS state FROM (SELECT DISTINCT ON (id) * FROM change_notifications) WHERE agent_id IS NOT NULL AND document_path IS NOT NULL")
def stored_states(spark: SparkSession, root: str) -> DataFrame:
    """States written to the shared folder and read again."""
    n = table(spark, root, "change_notifications").where("agent_id IS NOT NULL AND document_path IS NOT NULL").dropDuplicates(["id"])
    path = f"{session.shared_dir(spark)}/states-{uuid.uuid4().hex}"
    files.write_states(n.select(F.col("agent_id").alias("session_id"), F.col("document_path").alias("chunk_id"), F.col("id").alias("turn_number"), F.struct(F.col("change_type").alias("kind")).alias("state")), path)
    return files.read_states(spark, path).select("session_id", "chunk_id", "turn_number", "state")

@book.query(f"WITH {C} SELECT chunk_id, document_path, start_pos FROM c WHERE document_path = 'meridian' OR starts_with(document_path, 'meridian/')")
def document_chunks(spark: SparkSession, root: str) -> DataFrame:
    """The chunks under a path, in order of file and place."""
    c = table(spark, root, "chunks").where(T.under_path("document_path", "meridian") & F.col("chunk_id").isNotNull()).select("chunk_id", "document_path", "start_pos").dropDuplicates(["chunk_id"])
    return c.orderBy("document_path", "start_pos", "chunk_id")


@book.query("SELECT chunk_id, max(access_count)::BIGINT AS access_count, max(last_accessed) AS last_accessed, count(*)::BIGINT AS entries FROM chunks WHERE chunk_id IS NOT NULL GROUP BY 1")
def chunk_accesses(spark: SparkSession, root: str) -> DataFrame:
    """Every chunk's accesses, from the rows in which it was delivered."""
    return table(spark, root, "chunks").where(F.col("chunk_id").isNotNull()).groupBy("chunk_id").agg(F.max("access_count").alias("access_count"), F.max("last_accessed").alias("last_accessed"), F.count("*").alias("entries"))


@book.query(f"WITH {C} SELECT chunk_id, substr(content, 1, 300) AS preview, CASE WHEN length(content) <= 80 THEN content ELSE substr(content, 1, 77) || '...' END AS short FROM c")
def chunk_previews(spark: SparkSession, root: str) -> DataFrame:
    rows = _content(spark, root).where(F.col("chunk_id").isNotNull())
    return rows.select("chunk_id", F.substring("content", 1, 300).alias("preview"), T.shortened("content", 80).alias("short")).dropDuplicates(["chunk_id"])


@book.query(f"WITH {C}, {BASE} SELECT document_path, arg_max(chunk_id, struct_pack(base_line, chunk_id)) AS chunk_id FROM b WHERE base_line <= 40 AND document_path IS NOT NULL GROUP BY 1")
def chunks_of_line(spark: SparkSession, root: str) -> DataFrame:
    """The chunk that holds line 40 of every file, or the file's last."""
    return grep.chunk_for_line(grep.base_lines(_chunks(spark, root)), 40)


# --- stored vectors

_V = """h AS (SELECT DISTINCT ON (chunk_id, version) chunk_id, version, semantic_signature AS s FROM chunk_history WHERE chunk_id IS NOT NULL),
ok AS (SELECT *, len(s) = 128 AND NOT list_bool_or(list_transform(s, lambda x: x IS NULL OR isnan(x))) AS fine FROM h),
own AS (SELECT chunk_id, arg_max(struct_pack(s := CASE WHEN fine THEN s END), version).s AS own, max(version) AS v FROM ok GROUP BY 1)"""


@book.query(f"""WITH {_V}, g AS (SELECT chunk_id, s AS given FROM ok WHERE version = 1 AND fine AND list_sum(list_transform(s, lambda x: x::DOUBLE * x::DOUBLE)) > 0), e AS (SELECT chunk_id, own, v, given, coalesce(list_transform(given, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(given, lambda y: y::DOUBLE * y::DOUBLE)))), own::DOUBLE[]) AS w FROM own LEFT JOIN g USING (chunk_id))
SELECT chunk_id, given IS NOT NULL AS by_agent, round(w[1] + w[64] + w[128], 5) AS sample FROM e WHERE w IS NOT NULL""")
def effective_vectors(spark: SparkSession, root: str) -> DataFrame:
    """Every chunk's vector: the first version's, taken as an agent's own and brought to length 1, else the current one."""
    own, given = _stored(spark, root)
    w = vectors.with_given(own, given, 128)
    return w.select("chunk_id", "by_agent", F.round(F.element_at("v", 1) + F.element_at("v", 64) + F.element_at("v", 128), 5).alias("sample"))


def _stored(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    h = table(spark, root, "chunk_history").where(F.col("chunk_id").isNotNull())
    fine = F.when(vectors.usable(F.col("semantic_signature"), 128), F.col("semantic_signature"))
    own = h.groupBy("chunk_id").agg(F.max_by(fine, "version").alias("v"))
    given = h.where("version = 1").select("chunk_id", F.col("semantic_signature").alias("v")).dropDuplicates(["chunk_id"])
    return own, given


@book.query(f"""WITH {_V}, g AS (SELECT chunk_id FROM ok WHERE version = 2 AND fine), p AS (SELECT list_cosine_similarity(own::DOUBLE[], list_transform(range(128), lambda x: 0.1::DOUBLE)) AS sim FROM own WHERE own IS NOT NULL AND list_sum(list_transform(own, lambda x: x * x)) > 0 ORDER BY round(sim, 9) DESC LIMIT 10),
t AS (SELECT count(*) AS n, (SELECT count(DISTINCT chunk_id) FROM g) AS k FROM own) SELECT n AS chunks, k AS given, round(k / greatest(n, 1) * 100.0, 2) AS coverage, round((SELECT max(sim) - min(sim) FROM p), 4) AS span, CASE WHEN k / greatest(n, 1) * 100.0 < 5 THEN 'critical' WHEN k / greatest(n, 1) * 100.0 < 80 THEN 'low' END AS advice FROM t""")
def search_quality(spark: SparkSession, root: str) -> DataFrame:
    """How much of the collection has vectors of agents (a second version is taken as one), and how far apart a probe's nearest are."""
    own, _ = _stored(spark, root)
    second = table(spark, root, "chunk_history").where("version = 2").where(vectors.usable(F.col("semantic_signature"), 128)).select("chunk_id")
    return vectors.quality(own, second, 128)


@book.query(f"WITH {_V} SELECT count(*)::BIGINT AS nodes, count(*) FILTER (WHERE own IS NOT NULL AND v > 1)::BIGINT AS replaced, (SELECT count(DISTINCT chunk_id) FROM own WHERE own IS NOT NULL AND chunk_id NOT IN (SELECT chunk_id FROM chunks WHERE staleness_score >= 0.5 AND chunk_id IS NOT NULL))::BIGINT AS left_ FROM own WHERE own IS NOT NULL")
def vector_index_counts(spark: SparkSession, root: str) -> DataFrame:
    """The vectors of the index, those replaced by a later version, and those left once stale chunks are removed."""
    h = table(spark, root, "chunk_history").where(F.col("chunk_id").isNotNull()).select("chunk_id", "version", "semantic_signature")
    rows = h.groupBy("chunk_id").agg(F.max_by(F.when(vectors.usable(F.col("semantic_signature"), 128), F.col("semantic_signature")), "version").alias("v"), F.max("version").alias("n")).where(F.col("v").isNotNull())
    left = vectors.removed(rows, table(spark, root, "chunks").where("staleness_score >= 0.5").select("chunk_id"), "chunk_id").agg(F.count("*")).scalar()
    return rows.agg(F.count("*").alias("nodes"), F.count_if(F.col("n") > 1).alias("replaced")).select("nodes", "replaced", left.alias("left_"))


@book.query(f"WITH {C} SELECT chunk_id, round(list_sum(list_transform(string_split(sha256(content), ''), lambda x: ascii(x) / 255.0)), 6) AS total FROM c WHERE content IS NOT NULL")
def binary_signatures(spark: SparkSession, root: str) -> DataFrame:
    """The signature of content without text: its hash's signs as numbers, then zeros."""
    rows = _content(spark, root).where("content IS NOT NULL AND chunk_id IS NOT NULL").select("chunk_id", vectors.binary_signature(F.col("content").cast("binary")).alias("v"))
    return rows.select("chunk_id", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 6).alias("total")).dropDuplicates(["chunk_id"])


# --- the symbol graph, by name and by file

NAME = "clamp_range"


@book.query(f"""WITH {GRAPH}, {C}, o AS (SELECT * FROM s WHERE name = '{NAME}') SELECT id, role, chunk_id, line_number, coalesce(substr(content, 1, 200), '') AS content_preview,
CASE WHEN (SELECT bool_or(role = 'definition') AND bool_or(role = 'reference') FROM o) THEN 'referenced' WHEN (SELECT bool_or(role = 'definition') FROM o) THEN 'unreferenced' ELSE 'external' END AS verdict FROM o LEFT JOIN c USING (chunk_id)""")
def references_of(spark: SparkSession, root: str) -> DataFrame:
    """Every use and definition of one name, with the text around."""
    return S.references_of(table(spark, root, "symbols"), table(spark, root, "chunks"), NAME).select("id", "role", "chunk_id", "line_number", "content_preview", "verdict")


@book.query(f"""WITH RECURSIVE {GRAPH}, e AS MATERIALIZED (SELECT DISTINCT target_chunk_id AS a, source_chunk_id AS b FROM edges WHERE symbol_name NOT IN ({', '.join(f"'{x}'" for x in S.NOISE)})), cp AS (SELECT chunk_id, min(document_path) AS document_path FROM s GROUP BY 1),
seed AS (SELECT target_chunk_id AS chunk_id FROM edges GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1), walk AS (SELECT chunk_id, 0 AS hop FROM seed UNION SELECT b, hop + 1 FROM walk JOIN e ON e.a = walk.chunk_id WHERE hop < 2),
best AS (SELECT chunk_id, min(hop)::BIGINT AS hop FROM walk GROUP BY 1)
SELECT document_path AS path, count(*)::BIGINT AS chunks, min(hop) AS depth_min, max(hop) AS depth_max FROM best JOIN cp USING (chunk_id) WHERE hop > 0 AND contains(document_path, 'lib') GROUP BY 1 ORDER BY chunks DESC, path LIMIT 15""")
def impact_files(spark: SparkSession, root: str) -> DataFrame:
    """The fifteen files under some lib that most depend on one chunk, by names that say something."""
    edges = _edges(spark, root)
    reached = S.reach(edges.where(S.significant(F.col("symbol_name"), 1.0)), _seed(edges), 2)
    return S.impact_files(reached, _paths(spark, root), "lib").orderBy(F.desc("chunks"), "path").limit(15)


_DYN = "dy AS (SELECT DISTINCT 'runtime:' || coalesce(agent_id, 'none') || ':' || 'hook_' || change_type AS chunk_id FROM change_notifications WHERE agent_id IS NOT NULL AND change_type IS NOT NULL)"


def _with_dynamic(spark: SparkSession, root: str) -> DataFrame:
    n = table(spark, root, "change_notifications").where("agent_id IS NOT NULL AND change_type IS NOT NULL").select("agent_id", F.concat(F.lit("hook_"), "change_type").alias("name"), F.lit("function").alias("kind"), F.lit("definition").alias("role"), F.lit("runtime").alias("document_path"), F.lit(None).cast("long").alias("line_number"))
    return S.with_dynamic(S.cleaned(table(spark, root, "symbols")), n)[0]


@book.query(f"WITH {_DYN}, a AS (SELECT min(agent_id) AS a FROM change_notifications) SELECT chunk_id, starts_with(chunk_id, 'runtime:' || a || ':') AS mine FROM dy, a")
def dynamic_symbols(spark: SparkSession, root: str) -> DataFrame:
    """The hooks that agents registered at run time, and whether they are one agent's."""
    me = table(spark, root, "change_notifications").agg(F.min("agent_id")).scalar()
    return S.dynamic(_with_dynamic(spark, root)).select("chunk_id", F.startswith("chunk_id", F.concat(F.lit("runtime:"), me, F.lit(":"))).alias("mine"))


@book.query(f"WITH {GRAPH} SELECT * FROM edges")
def edges_rebuilt(spark: SparkSession, root: str) -> DataFrame:
    """The edges after every fifth chunk's symbols were lost and read again: the same as resolved from all."""
    symbols = table(spark, root, "symbols")
    lost = F.pmod(F.xxhash64("chunk_id"), F.lit(5)) == 0
    old = S.resolve(symbols.where(~lost))
    return S.rebuilt(old, symbols, symbols.where(lost).select("chunk_id"))


# The test tables' files import nothing and test nothing, so these three work on names and paths made from theirs.
_MADE = GRAPH.replace(
    "FROM symbols)",
    "FROM (SELECT id, CASE WHEN id % 11 = 0 THEN replace(regexp_replace(document_path, '\\.[^./]*$', ''), '/', '.') ELSE name END AS name, CASE WHEN id % 11 = 0 THEN 'module' ELSE kind END AS kind, CASE WHEN id % 11 = 0 THEN 'reference' ELSE role END AS role, "
    "CASE WHEN id % 11 = 0 THEN 'm' || (id % 40) ELSE chunk_id END AS chunk_id, CASE WHEN id % 11 = 0 THEN 'importer' || (id % 40) || '.py' WHEN id % 13 = 0 THEN regexp_replace(document_path, '([^/]+)$', 'tests/test_\\1') ELSE document_path END AS document_path, line_number, container FROM symbols))",
)


def _made(spark: SparkSession, root: str) -> DataFrame:
    s = table(spark, root, "symbols")
    imports = F.col("id") % 11 == 0
    path = F.when(imports, F.concat(F.lit("importer"), (F.col("id") % 40).cast("string"), F.lit(".py"))).when(F.col("id") % 13 == 0, F.regexp_replace("document_path", "([^/]+)$", "tests/test_$1")).otherwise(F.col("document_path"))
    return s.withColumns({
        "name": F.when(imports, F.replace(F.regexp_replace("document_path", r"\.[^./]*$", ""), F.lit("/"), F.lit("."))).otherwise(F.col("name")), "kind": F.when(imports, "module").otherwise(F.col("kind")),
        "role": F.when(imports, "reference").otherwise(F.col("role")), "chunk_id": F.when(imports, F.concat(F.lit("m"), (F.col("id") % 40).cast("string"))).otherwise(F.col("chunk_id")), "document_path": path,
    })


@book.query(f"WITH {_MADE} SELECT module, path FROM matches")
def module_paths(spark: SparkSession, root: str) -> DataFrame:
    """The files that each imported module may mean."""
    s = S.cleaned(_made(spark, root))
    modules = s.where((F.col("role") == "reference") & (F.col("kind") == "module")).select(F.col("name").alias("module")).distinct()
    return S.module_matches(modules, s.where(F.col("role") == "definition").select(F.col("document_path").alias("path")).distinct())


@book.query(f"WITH {_MADE} SELECT DISTINCT document_path AS source_path, path AS target_path FROM (SELECT document_path, module, min(path) AS path FROM (SELECT DISTINCT document_path, module FROM modules) JOIN matches USING (module) GROUP BY ALL)")
def file_dependencies(spark: SparkSession, root: str) -> DataFrame:
    return S.file_dependencies(_made(spark, root))


@book.query(f"WITH {_MADE} SELECT * FROM edges")
def imported_edges(spark: SparkSession, root: str) -> DataFrame:
    """All edges where chunks import files: names lead to imported files first, modules to files."""
    return S.resolve(_made(spark, root))


@book.query(f"""WITH {_MADE}, d AS (SELECT document_path, arg_min(chunk_id, id) AS chunk, regexp_replace(regexp_extract(document_path, '([^/]+)$', 1), '(.)\\.[^.]*$', '\\1') AS stem,
  regexp_matches('/' || document_path, '/tests?/') AS folder FROM s GROUP BY document_path),
k AS (SELECT chunk, unnest([CASE WHEN starts_with(stem, 'test_') THEN substr(stem, 6) END, CASE WHEN suffix(stem, '_test') THEN left(stem, length(stem) - 5) END, CASE WHEN folder THEN stem END]) AS stem
  FROM d WHERE folder OR starts_with(stem, 'test_') OR suffix(stem, '_test'))
SELECT DISTINCT k.chunk AS source_chunk_id, x.chunk AS target_chunk_id, 'test_of' AS edge_type, 'test' AS symbol_name
FROM k JOIN d x ON k.stem = x.stem WHERE NOT (x.folder OR starts_with(x.stem, 'test_') OR suffix(x.stem, '_test'))""")
def test_edges(spark: SparkSession, root: str) -> DataFrame:
    return S.test_edges(_made(spark, root))
