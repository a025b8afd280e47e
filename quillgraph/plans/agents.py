"""Queries of sessions, locks, annotations, histories, the operation log and incremental indexing.

The notifications stand for what agents did: each is a turn of its agent's session, which looks at the chunks of the file,
a request for the file's lock, and an annotation of it.  The log of index runs is the operation log.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.operators import incremental, indexing, locks, records, sessions, store
from quillgraph.operators.incremental import normal_hash, text_hash
from quillgraph.plans.base import Book
from quillgraph.plans.retrieval import QUERY_VECTOR
from quillgraph.plans.store import NOW, _now
from quillgraph.sources.tables import table

book = Book()
DAY, TARGET_TURN, BUDGET = 86400, 3, 2000

N = "n AS (SELECT DISTINCT ON (id) * FROM change_notifications WHERE id IS NOT NULL)"
CC = "cc AS (SELECT chunk_id, min(document_path) AS document_path, max(token_count) AS token_count, max(staleness_score) AS staleness FROM chunks WHERE chunk_id IS NOT NULL GROUP BY chunk_id)"
SESSIONS = f"""{N}, {CC},
t AS (SELECT id, agent_id AS session_id, document_path, change_type, created_at, row_number() OVER (PARTITION BY agent_id ORDER BY created_at, id) - 1 AS turn_number FROM n WHERE agent_id IS NOT NULL AND created_at IS NOT NULL AND document_path IS NOT NULL),
sc AS (SELECT session_id, chunk_id, turn_number, round(1 - coalesce(staleness, 0), 6) AS relevance, coalesce(token_count, 0) AS token_count FROM t JOIN cc USING (document_path)),
tot AS (SELECT session_id, max(turn_number) + 1 AS turn_count, count(*)::BIGINT AS chunks, sum(token_count)::BIGINT AS total_tokens FROM sc GROUP BY session_id),
me AS (SELECT min(session_id) AS s FROM t)"""


def _notes(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "change_notifications").where(F.col("id").isNotNull()).dropDuplicates(["id"])


def _chunks(spark: SparkSession, root: str) -> DataFrame:
    """The chunks without their texts, each once."""
    c = table(spark, root, "chunks").where(F.col("chunk_id").isNotNull())
    return c.groupBy("chunk_id").agg(F.min("document_path").alias("document_path"), F.max("token_count").alias("token_count"), F.max("staleness_score").alias("staleness"))


def _turns(spark: SparkSession, root: str) -> DataFrame:
    n = _notes(spark, root).where("agent_id IS NOT NULL AND created_at IS NOT NULL AND document_path IS NOT NULL")
    turn = F.row_number().over(Window.partitionBy("agent_id").orderBy("created_at", "id")).cast("long") - 1
    return n.select("id", F.col("agent_id").alias("session_id"), "document_path", "change_type", "created_at", turn.alias("turn_number"))


def _session_chunks(spark: SparkSession, root: str) -> DataFrame:
    relevance = F.round(1 - F.coalesce("staleness", F.lit(0.0)), 6)
    return _turns(spark, root).join(_chunks(spark, root), "document_path").select("session_id", "chunk_id", "turn_number", relevance.alias("relevance"))


def _me(spark: SparkSession, root: str) -> F.Column:
    return _turns(spark, root).agg(F.min("session_id")).scalar()


@book.query(f"WITH {SESSIONS} SELECT * FROM tot")
def session_totals(spark: SparkSession, root: str) -> DataFrame:
    return sessions.totals(_session_chunks(spark, root), _chunks(spark, root))


@book.query(f"WITH {SESSIONS} SELECT row_number() OVER (ORDER BY turn_number DESC, relevance DESC, chunk_id) AS position, chunk_id, turn_number, relevance, token_count FROM sc, me WHERE session_id = s")
def session_chunks(spark: SparkSession, root: str) -> DataFrame:
    """One session's chunks, the newest turn first."""
    return sessions.chunks_of(_session_chunks(spark, root), _chunks(spark, root), _me(spark, root))


@book.query(f"""WITH {SESSIONS}, st AS (SELECT DISTINCT session_id, chunk_id FROM sc WHERE turn_number % 5 = 0 UNION SELECT 'fresh', chunk_id FROM sc, me WHERE session_id = s UNION SELECT s, 'no-such-chunk' FROM me),
w AS (SELECT session_id, count(*)::BIGINT AS k, sum(coalesce(token_count, 0))::BIGINT AS tk FROM st JOIN cc USING (chunk_id) GROUP BY 1)
SELECT i.session_id, coalesce(turn_count, 0) AS turn_number, coalesce(k, 0) AS chunks_saved, coalesce(total_tokens, 0) + coalesce(tk, 0) AS total_tokens FROM (SELECT DISTINCT session_id FROM st) i LEFT JOIN tot USING (session_id) LEFT JOIN w USING (session_id)""")
def session_saves(spark: SparkSession, root: str) -> DataFrame:
    """States of known chunks saved in each session's present turn, and in a session that is not there yet."""
    sc, cc, me = _session_chunks(spark, root), _chunks(spark, root), _me(spark, root)
    states = sc.where("turn_number % 5 = 0").select("session_id", "chunk_id")
    states = states.unionByName(sc.where(F.col("session_id") == me).select(F.lit("fresh").alias("session_id"), "chunk_id"))
    states = states.unionByName(spark.range(1).select(me.alias("session_id"), F.lit("no-such-chunk").alias("chunk_id")))
    return sessions.saved(sessions.totals(sc, cc), states, cc)


@book.query(f"""WITH {SESSIONS} SELECT session_id, turn_count AS previous_turn, CASE WHEN {TARGET_TURN} < turn_count THEN {TARGET_TURN}::BIGINT ELSE turn_count END AS current_turn,
(SELECT count(*) FROM sc WHERE sc.session_id = tot.session_id AND turn_number > {TARGET_TURN} AND {TARGET_TURN} < turn_count)::BIGINT AS removed, CASE WHEN turn_count <= {TARGET_TURN} THEN 'target turn is not before the current turn' END AS error FROM tot""")
def session_rollback(spark: SparkSession, root: str) -> DataFrame:
    """All sessions back to one turn, which stays."""
    sc = _session_chunks(spark, root)
    return sessions.rolled_back(sc, sessions.totals(sc, _chunks(spark, root)), TARGET_TURN)[1]


@book.query(f"""WITH {SESSIONS}, p AS (SELECT *, sum(token_count) OVER (PARTITION BY session_id) - coalesce(sum(token_count) OVER (PARTITION BY session_id ORDER BY relevance, turn_number, chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) <= {BUDGET} AS kept FROM sc)
SELECT session_id, chunk_id, turn_number FROM p WHERE kept""")
def session_prune(spark: SparkSession, root: str) -> DataFrame:
    """What is left of each session within a token budget: the least relevant chunks go first."""
    rows = sessions.with_tokens(_session_chunks(spark, root), _chunks(spark, root))
    kept = store.prune_to_budget(rows, "session_id", "token_count", [F.col("relevance"), F.col("turn_number"), F.col("chunk_id")], BUDGET)
    return kept.where("kept").select("session_id", "chunk_id", "turn_number")


_SEARCHES = "se AS (SELECT session_id, change_type AS pattern, max(id) AS id, max(created_at) AS searched_at, list(DISTINCT document_path) AS files FROM t GROUP BY ALL)"


def _searches(spark: SparkSession, root: str) -> DataFrame:
    """Each agent's search for the files of one kind of change."""
    t = _turns(spark, root).groupBy("session_id", F.col("change_type").alias("pattern"))
    return t.agg(F.max("id").alias("id"), F.max("created_at").alias("searched_at"), F.collect_set("document_path").alias("files"))


@book.query(f"WITH {SESSIONS}, {_SEARCHES}, f AS (SELECT session_id, unnest(files) AS path, pattern, searched_at, id FROM se) SELECT session_id, path, arg_max(pattern, struct_pack(t := searched_at, i := id)) AS pattern FROM f GROUP BY ALL")
def file_searches(spark: SparkSession, root: str) -> DataFrame:
    """The last search of each session that looked at each file."""
    return sessions.last_search_of_files(_searches(spark, root)).select("session_id", "path", "pattern")


@book.query(f"WITH {SESSIONS}, {_SEARCHES} SELECT row_number() OVER (ORDER BY searched_at, id) AS position, id, pattern, searched_at FROM se, me WHERE session_id = s")
def search_history(spark: SparkSession, root: str) -> DataFrame:
    """One session's searches, oldest first."""
    return sessions.search_history(_searches(spark, root), _me(spark, root))


@book.query(f"""WITH {SESSIONS}, r AS (SELECT session_id, document_path, max(created_at) AS read_at FROM t GROUP BY ALL), d AS (SELECT document_path, max(last_modified) AS m FROM documents WHERE document_path IS NOT NULL GROUP BY 1),
w AS (SELECT document_path, max(staleness_score) AS w FROM chunks GROUP BY 1)
SELECT session_id, r.document_path, read_at, d.document_path IS NOT NULL AS known, coalesce(m > read_at, false) AS modified_since, round(coalesce(w, 0), 6) AS staleness FROM r LEFT JOIN d USING (document_path) LEFT JOIN w USING (document_path)""")
def session_read_files(spark: SparkSession, root: str) -> DataFrame:
    """Every file that a session has read, and whether it has changed or gone stale since."""
    r = sessions.reads(_turns(spark, root).withColumnRenamed("created_at", "read_at"))
    d = table(spark, root, "documents").where(F.col("document_path").isNotNull()).groupBy("document_path").agg(F.max("last_modified").alias("last_modified"))
    stale = table(spark, root, "chunks").select("document_path", F.col("staleness_score").alias("score"))
    return sessions.read_files(r, d, stale).withColumn("staleness", F.round("staleness", 6))


@book.query(f"""WITH {SESSIONS}, h AS (SELECT chunk_id, semantic_signature AS v FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY version DESC) AS r FROM chunk_history) WHERE r = 1 AND len(semantic_signature) = 128 AND NOT list_bool_or(list_transform(semantic_signature, lambda x: x IS NULL OR isnan(x)))),
x AS (SELECT chunk_id, CASE WHEN list_sum(list_transform(v, lambda y: y * y)) = 0 THEN 0.0 ELSE list_cosine_similarity(v::DOUBLE[], {QUERY_VECTOR}::DOUBLE[]) END AS sim FROM h WHERE chunk_id IN (SELECT chunk_id FROM sc, me WHERE session_id = s))
SELECT chunk_id, round(sim, 6) AS similarity FROM x ORDER BY round(sim, 9) DESC, chunk_id LIMIT 10""")
def relevant_state(spark: SparkSession, root: str) -> DataFrame:
    """The chunks of one session nearest to a query."""
    v = table(spark, root, "chunk_history").groupBy("chunk_id").agg(F.max_by("semantic_signature", "version").alias("v"))
    sc = _session_chunks(spark, root)
    return sessions.relevant(sc, _me(spark, root), v, QUERY_VECTOR, 10).withColumn("similarity", F.round("similarity", 6))


# --- locks

LOCKS = f"""{N}, q AS (SELECT *, row_number() OVER (PARTITION BY document ORDER BY at, agent, action) AS i FROM (SELECT document_path AS document, agent_id AS agent, created_at AS at, CASE WHEN change_type = 'removed' THEN 'release' ELSE 'acquire' END AS action,
 ({DAY} * (1 + id % 5))::INTEGER AS ttl, id % 3 = 0 AS force FROM n WHERE document_path IS NOT NULL AND agent_id IS NOT NULL AND created_at IS NOT NULL)),
r AS (SELECT document, agent, at, action, ttl, i, CASE WHEN action = 'acquire' THEN 'acquired' ELSE 'not_held' END AS outcome, NULL::VARCHAR AS held_by,
  CASE WHEN action = 'acquire' THEN agent END AS owner, CASE WHEN action = 'acquire' THEN at END AS since, CASE WHEN action = 'acquire' THEN ttl END AS held FROM q WHERE i = 1
 UNION ALL SELECT document, agent, at, action, ttl, i, outcome, before, CASE WHEN outcome IN ('refused', 'not_held') THEN before WHEN outcome = 'released' THEN NULL ELSE agent END,
  CASE WHEN outcome IN ('refused', 'not_held') THEN since ELSE at END, CASE WHEN outcome IN ('refused', 'not_held') THEN held ELSE ttl END FROM (
  SELECT q.*, r.owner AS before, r.since, r.held, CASE WHEN q.action = 'release' THEN CASE WHEN r.owner = q.agent THEN 'released' ELSE 'not_held' END WHEN r.owner IS NULL THEN 'acquired' WHEN r.owner = q.agent THEN 'refreshed'
   WHEN q.at > r.since + to_seconds(r.held) THEN 'reclaimed' WHEN q.force THEN 'stolen' ELSE 'refused' END AS outcome FROM r JOIN q ON q.document = r.document AND q.i = r.i + 1)),
lst AS (SELECT document, arg_max(struct_pack(agent, at, ttl, outcome), struct_pack(at, agent, action)) AS l FROM r WHERE outcome NOT IN ('refused', 'not_held') GROUP BY document),
st AS (SELECT document, l.agent AS agent, l.at AS at, CASE WHEN epoch(TIMESTAMP '{NOW}') - floor(epoch(l.at)) > l.ttl THEN 'expired' ELSE 'locked' END AS state FROM lst WHERE l.outcome <> 'released'),
cf AS (SELECT document, held_by AS agent_a, agent AS agent_b, at FROM r WHERE outcome = 'stolen')"""


def _replayed(spark: SparkSession, root: str) -> DataFrame:
    """Each change as a request for the file's lock for some days, each removal as its release, every third one by force."""
    return locks.replay(
        _notes(spark, root).select(
            F.col("document_path").alias("document"), F.col("agent_id").alias("agent"), F.col("created_at").alias("at"), F.when(F.col("change_type") == "removed", "release").otherwise("acquire").alias("action"),
            (DAY * (1 + F.col("id") % 5)).cast("int").alias("ttl"), (F.col("id") % 3 == 0).alias("force"),
        )
    )


@book.query(f"WITH RECURSIVE {LOCKS} SELECT document, agent, at, action, outcome, held_by FROM r")
def lock_replay(spark: SparkSession, root: str) -> DataFrame:
    """Every request for a lock with its outcome."""
    return _replayed(spark, root).drop("ttl")


@book.query(f"WITH RECURSIVE {LOCKS} SELECT *, 'lock_stolen' AS conflict_type, 'force_overwritten' AS resolution FROM cf")
def lock_conflicts(spark: SparkSession, root: str) -> DataFrame:
    return locks.conflicts(_replayed(spark, root))


@book.query(f"WITH RECURSIVE {LOCKS} SELECT document, agent_a, agent_b, at FROM cf WHERE agent_a = (SELECT min(agent_a) FROM cf) OR agent_b = (SELECT min(agent_a) FROM cf)")
def agent_conflicts(spark: SparkSession, root: str) -> DataFrame:
    """The conflicts with one agent on either side."""
    c = locks.conflicts(_replayed(spark, root))
    return locks.conflicts_of(c, agent=c.agg(F.min("agent_a")).scalar()).select("document", "agent_a", "agent_b", "at")


@book.query(f"WITH RECURSIVE {LOCKS} SELECT document, agent, at FROM st WHERE state = 'locked' AND agent <> (SELECT min(agent) FROM st)")
def locks_left(spark: SparkSession, root: str) -> DataFrame:
    """The locks that are left once expired ones are reaped and one agent has released its own."""
    st = locks.states(_replayed(spark, root), _now())
    return locks.released_by(locks.reaped(st), st.agg(F.min("agent")).scalar()).select("document", "agent", "at")


@book.query(f"""WITH RECURSIVE {LOCKS} SELECT count_if(state = 'locked')::BIGINT AS locked, count_if(state = 'expired')::BIGINT AS expired, count(DISTINCT CASE WHEN state = 'locked' THEN agent END)::BIGINT AS active_agents,
(SELECT count(*) FROM cf)::BIGINT AS conflicts, (SELECT max(at) FROM cf) AS last_conflict FROM st""")
def lock_stats(spark: SparkSession, root: str) -> DataFrame:
    r = _replayed(spark, root)
    return locks.lock_stats(locks.states(r, _now()), locks.conflicts(r))


_SEEN = f"ag AS (SELECT agent_id, max(created_at) AS last_seen FROM n WHERE agent_id IS NOT NULL GROUP BY 1), live AS (SELECT agent_id FROM ag WHERE epoch(TIMESTAMP '{NOW}') - floor(epoch(last_seen)) <= 10 * {DAY})"


@book.query(f"WITH RECURSIVE {LOCKS}, {_SEEN} SELECT document, agent FROM st WHERE agent IN (SELECT agent_id FROM live)")
def locks_of_live_agents(spark: SparkSession, root: str) -> DataFrame:
    """The locks that are left once agents without a sign of life for ten days are reaped with theirs."""
    live = store.agents(_notes(spark, root), F.lit(NOW).cast("timestamp"), stale_seconds=10 * DAY).where("NOT stale").select(F.col("agent_id").alias("agent"))
    return locks.states(_replayed(spark, root), _now()).join(live, "agent", "left_semi").select("document", "agent")


# --- annotations, histories, the operation log

NOTES = f"{N}, a AS (SELECT id, document_path AS target, CASE WHEN id % 4 = 0 THEN 'chunk' ELSE 'document' END AS target_type, change_type || ' by ' || coalesce(agent_id, '?') AS content, list_filter([change_type, worktree_root], lambda x: x IS NOT NULL) AS tags, created_at FROM n)"


def _annotations(spark: SparkSession, root: str) -> DataFrame:
    n = _notes(spark, root)
    return n.select(
        "id", F.col("document_path").alias("target"), F.when(F.col("id") % 4 == 0, "chunk").otherwise("document").alias("target_type"), F.concat("change_type", F.lit(" by "), F.coalesce("agent_id", F.lit("?"))).alias("content"),
        F.array_compact(F.array("change_type", "worktree_root")).alias("tags"), "created_at", F.col("created_at").alias("updated_at"),
    )


@book.query(f"WITH {NOTES} SELECT id, target FROM a WHERE target_type = 'document' AND list_has_any(tags, ['removed', 'created'])")
def annotations_by_tag(spark: SparkSession, root: str) -> DataFrame:
    return records.annotations_of(_annotations(spark, root), target_type="document", tags=["removed", "created"]).select("id", "target")


@book.query(f"WITH {NOTES} SELECT id FROM a WHERE content ILIKE '%BY agent-re%'")
def annotations_like(spark: SparkSession, root: str) -> DataFrame:
    return store.annotation_search(_annotations(spark, root), "BY agent-re").select("id")


@book.query(f"WITH {NOTES} SELECT id, CASE WHEN id % 10 = 0 THEN upper(content) ELSE content END AS content, CASE WHEN id % 20 = 0 THEN ['seen'] ELSE tags END AS tags, id % 10 = 0 AND created_at IS DISTINCT FROM TIMESTAMP '{NOW}' AS changed FROM a")
def annotations_updated(spark: SparkSession, root: str) -> DataFrame:
    """Every tenth annotation in capitals, every twentieth with another tag; an id that is not there changes nothing."""
    a = _annotations(spark, root)
    changes = a.where("id % 10 = 0").select("id", F.upper("content").alias("content"), F.when(F.col("id") % 20 == 0, F.array(F.lit("seen"))).alias("tags"))
    changes = changes.unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("id"), F.lit("x").alias("content"), F.lit(None).cast("array<string>").alias("tags")))
    after, _ = records.updated(a, changes, _now())
    return after.select("id", "content", "tags", (~F.col("updated_at").eqNullSafe(F.col("created_at"))).alias("changed"))


@book.query(f"WITH {NOTES}, g AS (SELECT DISTINCT target FROM a WHERE list_has_any(tags, ['removed']) AND target IS NOT NULL) SELECT id, target FROM a UNION ALL SELECT (SELECT max(id) FROM a) + row_number() OVER (ORDER BY target), target FROM g")
def annotations_created(spark: SparkSession, root: str) -> DataFrame:
    """A new annotation for every file that was removed, numbered on."""
    a = _annotations(spark, root)
    new = records.annotations_of(a, tags=["removed"]).select("target").distinct().select("target", F.lit("document").alias("target_type"), F.lit("gone").alias("content"), F.array(F.lit("gone")).alias("tags"))
    return records.created(a, new, _now(), ["target"]).select("id", "target")


@book.query(f"WITH {NOTES} SELECT id FROM a WHERE NOT list_has_any(tags, ['removed'])")
def annotations_deleted(spark: SparkSession, root: str) -> DataFrame:
    a = _annotations(spark, root)
    return records.deleted(a, records.annotations_of(a, tags=["removed"])).select("id")


HISTORY = f"""{N}, hi AS (SELECT min(id) AS id, max(created_at) AS "timestamp", list(DISTINCT document_path) FILTER (WHERE change_type = 'modified') AS modified, list(DISTINCT document_path) FILTER (WHERE change_type = 'removed') AS removed,
 list(DISTINCT document_path) FILTER (WHERE change_type = 'created') AS new FROM n WHERE agent_id IS NOT NULL AND created_at IS NOT NULL AND document_path IS NOT NULL GROUP BY agent_id, created_at::DATE)"""


def _history(spark: SparkSession, root: str) -> DataFrame:
    """One record of changes an agent and day."""
    n = _notes(spark, root).where("agent_id IS NOT NULL AND created_at IS NOT NULL AND document_path IS NOT NULL")
    of = lambda kind, name: F.collect_set(F.when(F.col("change_type") == kind, F.col("document_path"))).alias(name)
    h = n.groupBy("agent_id", F.to_date("created_at").alias("day")).agg(F.min("id").alias("id"), F.max("created_at").alias("timestamp"), of("modified", "modified"), of("removed", "removed"), of("created", "new"))
    return h.select("id", "timestamp", "modified", "removed", "new", F.lit(None).cast("array<string>").alias("unchanged"))


@book.query(f"""WITH {HISTORY}, p AS (SELECT document_path AS p FROM n WHERE document_path IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT id, coalesce(list_contains(modified, p), false) AS modified, coalesce(list_contains(removed, p), false) AS removed, coalesce(list_contains(new, p), false) AS new, coalesce(len(modified), 0) + coalesce(len(removed), 0) + coalesce(len(new), 0) AS total FROM hi, p
WHERE list_contains(modified, p) OR list_contains(removed, p) OR list_contains(new, p)""")
def change_history(spark: SparkSession, root: str) -> DataFrame:
    """The change records that name the file that changed most, reduced to it."""
    n = _notes(spark, root).where(F.col("document_path").isNotNull())
    path = n.groupBy("document_path").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "document_path").limit(1).select("document_path").scalar()
    t = F.col("totals")
    return records.history_of(_history(spark, root), path).select("id", "modified", "removed", "new", (t["modified"] + t["removed"] + t["new"]).alias("total"))


@book.query(f"WITH {HISTORY} SELECT id FROM hi WHERE \"timestamp\" >= TIMESTAMP '{NOW}' - INTERVAL 20 DAY ORDER BY \"timestamp\" DESC, id DESC LIMIT 50")
def change_history_retained(spark: SparkSession, root: str) -> DataFrame:
    """The newest fifty change records of the last twenty days."""
    return records.retained(_history(spark, root), "timestamp", "id", cutoff=_now() - F.expr("INTERVAL 20 DAYS"), keep=50).select("id")


OPS = "op AS (SELECT run_id AS id, min(agent_id) AS tool_name, bool_or(coalesce(lower(trim(status)) = 'success', false)) AS success, min(started_at) AS at, max(finished_at) AS until FROM index_runs WHERE run_id IS NOT NULL GROUP BY run_id)"


def _operations(spark: SparkSession, root: str) -> DataFrame:
    """One operation a run of the indexer."""
    r = table(spark, root, "index_runs").where(F.col("run_id").isNotNull()).groupBy(F.col("run_id").alias("id"))
    ops = r.agg(F.min("agent_id").alias("tool_name"), F.max(F.coalesce(F.lower(F.trim("status")) == "success", F.lit(False))).alias("success"), F.min("started_at").alias("at"), F.max("finished_at").alias("until"))
    return ops.withColumn("duration_ms", (F.unix_timestamp("until") - F.unix_timestamp("at")) * 1000)


@book.query(f"WITH {OPS} SELECT tool_name, count(*)::BIGINT AS calls, count_if(NOT success)::BIGINT AS failures, max(at) AS latest FROM op GROUP BY 1")
def operation_stats(spark: SparkSession, root: str) -> DataFrame:
    return _operations(spark, root).groupBy("tool_name").agg(F.count("*").alias("calls"), F.count_if(~F.col("success")).alias("failures"), F.max("at").alias("latest"))


@book.query(f"WITH {OPS} SELECT id, success, (floor(epoch(until)) - floor(epoch(at)))::BIGINT * 1000 AS duration_ms FROM op WHERE at >= TIMESTAMP '{NOW}' - INTERVAL 30 DAY ORDER BY at DESC NULLS LAST, id DESC LIMIT 20")
def operation_log(spark: SparkSession, root: str) -> DataFrame:
    """The newest operations of the last thirty days."""
    return records.operation_log(_operations(spark, root), since=_now() - F.expr("INTERVAL 30 DAYS"), limit=20).select("id", "success", "duration_ms")


@book.query(f"""WITH {OPS}, f AS (SELECT count(*)::BIGINT AS total, count_if(NOT success)::BIGINT AS failures FROM op WHERE at <= TIMESTAMP '{NOW}' AND epoch(TIMESTAMP '{NOW}') - floor(epoch(at)) <= 10 * {DAY}),
g AS (SELECT *, coalesce(failures / nullif(total, 0), 0) AS x FROM f) SELECT total, failures, round(x, 6) AS rate, CASE WHEN x < 0.01 THEN 'idle' WHEN x < 0.1 THEN 'vacuum' ELSE 'rebuild_symbols' END AS action FROM g""")
def failure_rate(spark: SparkSession, root: str) -> DataFrame:
    """Failed operations of the last ten days, and what they ask for."""
    return records.failure_rates(_operations(spark, root), _now(), 10 * DAY)


@book.query(f"""WITH h AS (SELECT (SELECT count(*) FROM documents) AS d, (SELECT count(DISTINCT chunk_id) FROM chunks) AS c, (SELECT count(DISTINCT id) FROM symbols) AS s, (SELECT max(indexed_at) FROM documents) AS l),
g AS (SELECT *, (epoch(TIMESTAMP '{NOW}') - floor(epoch(l)))::BIGINT AS age FROM h)
SELECT CASE WHEN s > 0 THEN 'ready' WHEN c > 0 THEN 'empty_with_chunks' ELSE 'empty' END AS symbol_status, CASE WHEN c > 0 THEN 'ready' WHEN d > 0 THEN 'empty_with_documents' ELSE 'empty' END AS chunk_status, age AS age_seconds,
list_filter([CASE WHEN d = 0 THEN 'no_documents' END, CASE WHEN c > 0 AND s = 0 THEN 'symbols_missing' END, CASE WHEN d > 0 AND age > 7 * {DAY} THEN 'stale_days_' || floor(age / {DAY})::BIGINT END], lambda x: x IS NOT NULL) AS alerts FROM g""")
def index_status(spark: SparkSession, root: str) -> DataFrame:
    """Whether the stores are ready and what to do about them."""
    d = table(spark, root, "documents").agg(F.count("*").alias("d"), F.max("indexed_at").alias("l"))
    c = table(spark, root, "chunks").agg(F.count_distinct("chunk_id")).scalar()
    s = table(spark, root, "symbols").agg(F.count_distinct("id")).scalar()
    return records.index_health(F.col("d"), c, s, F.col("l"), _now(), d)


_SPANS = """r AS (SELECT run_id, min(started_at) AS since, bool_or(coalesce(lower(trim(status)) = 'success', false)) AS ok FROM index_runs WHERE started_at IS NOT NULL GROUP BY run_id),
s AS (SELECT since, arg_max(ok, coalesce(run_id, -1)) AS ok FROM r GROUP BY since), spans AS (SELECT since, lead(since) OVER (ORDER BY since) AS until, ok FROM s)"""


@book.query(f"""WITH {_SPANS}, {CC}, k AS (SELECT document_path, sum(coalesce(token_count, 0)) AS tokens FROM cc GROUP BY 1), d AS (SELECT DISTINCT document_path, indexed_at FROM documents WHERE indexed_at IS NOT NULL AND document_path IS NOT NULL)
SELECT since, count(*)::BIGINT AS files, sum(coalesce(tokens, 0))::BIGINT AS tokens FROM d JOIN spans ON ok AND indexed_at >= since AND (until IS NULL OR indexed_at < until) LEFT JOIN k USING (document_path) GROUP BY since""")
def run_tokens(spark: SparkSession, root: str) -> DataFrame:
    """Files and tokens of every successful run."""
    spans = incremental.runs_as_intervals(table(spark, root, "index_runs"))
    d = table(spark, root, "documents").where("indexed_at IS NOT NULL AND document_path IS NOT NULL").select("document_path", "indexed_at").distinct()
    tokens = _chunks(spark, root).groupBy("document_path").agg(F.sum(F.coalesce("token_count", F.lit(0))).alias("tokens"))
    met = incremental.with_run(d, spans).where("ok").join(tokens, "document_path", "left")
    return met.groupBy("since").agg(F.count("*").alias("files"), F.sum(F.coalesce("tokens", F.lit(0))).alias("tokens"))


@book.query(f"WITH {CC} SELECT chunk_id, CASE WHEN staleness >= 0.5 THEN 'look again' END AS note FROM cc")
def chunk_notes(spark: SparkSession, root: str) -> DataFrame:
    """Every chunk's note after stale ones were given one in bulk."""
    c = _chunks(spark, root).select("chunk_id", "staleness", F.lit(None).cast("string").alias("note"))
    given = c.where("staleness >= 0.5").select("chunk_id", F.lit("look again").alias("note"))
    return records.with_values(c, given, "chunk_id", "note").select("chunk_id", "note")


@book.query(f"WITH {CC}, {N}, p AS (SELECT document_path, max(created_at) AS t FROM n WHERE change_type = 'modified' GROUP BY 1) SELECT chunk_id, CASE WHEN p.document_path IS NOT NULL THEN 0.9 ELSE round(staleness, 6) END AS staleness FROM cc LEFT JOIN p USING (document_path)")
def staleness_set(spark: SparkSession, root: str) -> DataFrame:
    """Every chunk's staleness after the chunks of changed files were set in bulk."""
    c = _chunks(spark, root)
    changed = c.join(_notes(spark, root).where("change_type = 'modified'").select("document_path").distinct(), "document_path", "left_semi").select("chunk_id", F.lit(0.9).alias("staleness"))
    return records.with_values(c.select("chunk_id", "staleness"), changed, "chunk_id", "staleness").withColumn("staleness", F.round("staleness", 6))


# --- incremental indexing

_HASH = "lower(regexp_replace(regexp_replace(content_hash, '^\\s*([A-Za-z][A-Za-z0-9_/-]*\\s*:)?\\s*', ''), '\\s+$', ''))"
_FILES = f"""one AS (SELECT document_path AS path, min(doc_id) AS doc_id FROM documents WHERE document_path IS NOT NULL GROUP BY 1),
f AS (SELECT path, d.doc_id, d.last_modified, sha256(coalesce(d.text, '')) AS now, {_HASH} AS was, d.file_size, d.indexed_at, d.doc_version FROM one JOIN documents d USING (doc_id))"""


def _files(spark: SparkSession, root: str) -> DataFrame:
    """Of each path the row with the least id; of its text only the hash."""
    d = table(spark, root, "documents").where(F.col("document_path").isNotNull())
    r = F.struct(text_hash("text").alias("now"), normal_hash("content_hash").alias("was"), "doc_id", "last_modified", "file_size", "indexed_at", "doc_version")
    return d.groupBy(F.col("document_path").alias("path")).agg(F.min_by(r, "doc_id").alias("r")).select("path", "r.*")


@book.query(f"""WITH RECURSIVE {LOCKS}, {_FILES}, me AS (SELECT min(agent) AS me FROM st), lk AS (SELECT document AS path, agent AS owner FROM st WHERE state = 'locked')
SELECT path, CASE WHEN owner <> me THEN 'locked' WHEN doc_id % 7 = 0 AND doc_version <> 1 AND indexed_at IS NOT NULL THEN 'conflict' WHEN indexed_at IS NULL THEN 'new' WHEN doc_id % 3 = 0 AND last_modified IS NOT NULL AND file_size IS NOT NULL THEN 'same_file' WHEN now = was THEN 'same_content' ELSE 'modified' END AS step
FROM f LEFT JOIN lk USING (path), me""")
def index_plan(spark: SparkSession, root: str) -> DataFrame:
    """What the next run does with every file; every third file is known by time and size, every seventh expected at version 1."""
    f, st = _files(spark, root), locks.states(_replayed(spark, root), _now())
    me = st.agg(F.min("agent")).scalar()
    expected = F.when(F.col("doc_id") % 7 == 0, F.lit(1).cast("long"))
    seen = f.select("path", F.col("last_modified").alias("modified"), F.col("file_size").alias("length"), F.col("now").alias("hash"), expected.alias("expected_version"))
    size = F.when(F.col("doc_id") % 3 == 0, F.col("file_size"))
    stored = f.where("indexed_at IS NOT NULL").select("path", F.col("last_modified").alias("modified"), size.alias("length"), F.col("was").alias("hash"), F.col("doc_version").alias("version"))
    held = locks.reaped(st).select(F.col("document").alias("path"), F.col("agent").alias("owner"))
    return indexing.index_plan(seen, stored, held, me)


@book.query(f"WITH {_FILES} SELECT path, CASE WHEN doc_id % 2 = 0 THEN now ELSE was END AS hash, doc_version FROM f WHERE indexed_at IS NOT NULL OR doc_id % 2 = 0")
def documents_stored(spark: SparkSession, root: str) -> DataFrame:
    """The documents after every second file was stored anew: the hash is replaced, the version stays."""
    f = _files(spark, root)
    stored = f.where("indexed_at IS NOT NULL OR doc_id % 2 = 0").select("path", F.col("was").alias("hash"), "doc_version")
    return indexing.stored_documents(stored, f.where("doc_id % 2 = 0").select("path", F.col("now").alias("hash")), "path", ["hash"], ["doc_version"])


@book.query("""WITH k AS (SELECT DISTINCT chunk_id, sha256(content) AS h FROM chunks WHERE chunk_id IS NOT NULL AND content IS NOT NULL), c AS (SELECT DISTINCT content_hash AS h FROM chunk_history WHERE content_hash IS NOT NULL AND semantic_signature IS NOT NULL)
SELECT chunk_id, h IN (SELECT h FROM c) AS cached FROM k""")
def signature_cache(spark: SparkSession, root: str) -> DataFrame:
    """Whether each chunk's signature is known by its content."""
    k = table(spark, root, "chunks").where("chunk_id IS NOT NULL AND content IS NOT NULL").select("chunk_id", F.sha2("content", 256).alias("content_hash")).distinct()
    h = table(spark, root, "chunk_history").select("content_hash", F.col("semantic_signature").alias("signature"))
    return indexing.cached_signatures(k, h).select("chunk_id", F.col("signature").isNotNull().alias("cached"))


@book.query("SELECT DISTINCT chunk_id FROM chunk_history WHERE chunk_id IS NOT NULL AND chunk_id NOT IN (SELECT chunk_id FROM chunks WHERE staleness_score < 0.5 AND chunk_id IS NOT NULL)")
def removed_chunk_ids(spark: SparkSession, root: str) -> DataFrame:
    """The chunks of the history that are not among the fresh ones."""
    old = table(spark, root, "chunk_history").where(F.col("chunk_id").isNotNull())
    return indexing.removed_ids(old, table(spark, root, "chunks").where("staleness_score < 0.5"))


@book.query(f"""WITH s AS (SELECT doc_id, CASE WHEN indexed_at IS NULL THEN 'new' WHEN {_HASH} = sha256(coalesce(text, '')) THEN 'unchanged' ELSE 'modified' END AS status FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY status ORDER BY doc_id) AS r, count(*) OVER (PARTITION BY status) AS total FROM s) SELECT doc_id, status, total FROM r WHERE r <= 20""")
def changes_reported(spark: SparkSession, root: str) -> DataFrame:
    """The first twenty documents of each status, with the status's total."""
    d = table(spark, root, "documents")
    stored = d.where(F.col("indexed_at").isNotNull()).select("doc_id", normal_hash("content_hash").alias("v"))
    rows, totals = indexing.capped(store.snapshot_diff(stored, d.select("doc_id", text_hash("text").alias("v")), "doc_id", "v"), "status", ["doc_id"], 20)
    return rows.join(totals, "status").select("doc_id", "status", "total")


# "at" is a keyword of DuckDB's, so it is quoted wherever it stands.
book.sql.update({name: re.sub(r"\bat\b", '"at"', sql) for name, sql in book.sql.items()})
