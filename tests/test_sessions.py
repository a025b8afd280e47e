from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import indexing, locks, records, sessions

T0 = datetime(2026, 1, 1)


def rows(df, *cols):
    return {tuple(r[c] for c in cols) for r in df.select(*cols).collect()}


@pytest.fixture(scope="module")
def data(spark):
    sc = spark.createDataFrame([("s", "a", 0, 1.0), ("s", "b", 1, 0.5), ("s", "a", 2, 0.9), ("s", "gone", 2, 0.9), ("t", "b", 0, 1.0)], "session_id string, chunk_id string, turn_number long, relevance double")
    ch = spark.createDataFrame([("a", "x.py", 10), ("b", "y.py", None)], "chunk_id string, document_path string, token_count long")
    return sc, ch


def test_sessions(spark, data):
    sc, ch = data
    got = sessions.chunks_of(sc, ch, F.lit("s")).orderBy("position").collect()
    assert [(r["chunk_id"], r["turn_number"]) for r in got] == [("a", 2), ("b", 1), ("a", 0)]
    assert rows(sessions.chunks_of(sc, ch, F.lit("s"), 1), "chunk_id", "token_count") == {("b", 0)}
    t = sessions.totals(sc, ch)
    assert rows(t, "session_id", "turn_count", "chunks", "total_tokens") == {("s", 3, 3, 20), ("t", 1, 1, 0)}
    states = spark.createDataFrame([("s", "a"), ("s", "a"), ("s", "gone"), ("new", "b")], "session_id string, chunk_id string")
    assert rows(sessions.saved(t, states, ch), "session_id", "turn_number", "chunks_saved", "total_tokens") == {("s", 3, 1, 30), ("new", 0, 1, 0)}
    kept, report = sessions.rolled_back(sc, t, 1)
    assert rows(kept, "session_id", "turn_number") == {("s", 0), ("s", 1), ("t", 0)}
    assert {(r["session_id"], r["current_turn"], r["removed"], r["error"] is None) for r in report.collect()} == {("s", 1, 2, True), ("t", 1, 0, False)}
    assert sessions.rolled_back(sc, t, -1)[0].count() == sc.count()
    assert sessions.orphaned_states(spark.createDataFrame([("s", "a", 0), ("s", "a", 9)], "session_id string, chunk_id string, turn_number long"), sc).count() == 1


def test_searches_and_reads(spark):
    s = spark.createDataFrame([("s", 1, "p", ["x", "y"], T0), ("s", 2, "q", ["x"], T0 + timedelta(1)), ("t", 3, "r", None, T0)], "session_id string, id long, pattern string, files array<string>, searched_at timestamp")
    assert rows(sessions.last_search_of_files(s), "session_id", "path", "pattern") == {("s", "x", "q"), ("s", "y", "p")}
    assert [r["id"] for r in sessions.search_history(s, F.lit("s")).orderBy("position").collect()] == [1, 2]
    log = spark.createDataFrame([("s", "x", T0), ("s", "x", T0 + timedelta(2)), ("s", "z", T0), (None, "x", T0)], "session_id string, document_path string, read_at timestamp")
    r = sessions.reads(log)
    assert rows(r, "session_id", "document_path", "times") == {("s", "x", 2), ("s", "z", 1)}
    docs = spark.createDataFrame([("x", T0 + timedelta(3))], "document_path string, last_modified timestamp")
    stale = spark.createDataFrame([("x", 0.2), ("x", 0.7)], "document_path string, score double")
    assert rows(sessions.read_files(r, docs, stale), "document_path", "known", "modified_since", "staleness") == {("x", True, True, 0.7), ("z", False, False, 0.0)}
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", None), ("d", [1.0, 1.0])], "chunk_id string, v array<double>")
    sc = spark.createDataFrame([("s", "a"), ("s", "b"), ("s", "c")], "session_id string, chunk_id string")
    assert [r["chunk_id"] for r in sessions.relevant(sc, F.lit("s"), v, [1.0, 0.1], 2).collect()] == ["a", "b"]


def test_records(spark):
    a = spark.createDataFrame([(1, "x", "document", "one", ["t"], T0, T0), (2, "c", "chunk", "two", None, T0, T0)], "id long, target string, target_type string, content string, tags array<string>, created_at timestamp, updated_at timestamp")
    now = F.lit(T0 + timedelta(1))
    new = spark.createDataFrame([("y", "document", "three", ["u"]), ("z", "folder", "no", None), ("w", "chunk", None, None)], "target string, target_type string, content string, tags array<string>")
    made = records.created(a, new, now, ["target"])
    assert rows(made, "id", "target") == {(1, "x"), (2, "c"), (3, "y")}
    changes = spark.createDataFrame([(1, "ONE", None), (9, "x", None)], "id long, content string, tags array<string>")
    after, missing = records.updated(made, changes, now)
    assert {r["id"]: (r["content"], r["tags"], r["updated_at"] > r["created_at"]) for r in after.where("id < 3").collect()} == {1: ("ONE", ["t"], True), 2: ("two", None, False)} and rows(missing, "id") == {(9,)}
    assert rows(records.deleted(made, missing.unionByName(a.where("id = 2").select("id"))), "id") == {(1,), (3,)}
    assert rows(records.annotations_of(made, tags=["t", "u"]), "id") == {(1,), (3,)} and rows(records.annotations_of(made, target_type="chunk"), "id") == {(2,)}
    noted = records.with_values(spark.createDataFrame([("a", "old"), ("b", "old")], "chunk_id string, note string"), spark.createDataFrame([("a", None), ("zz", "n")], "chunk_id string, note string"), "chunk_id", "note")
    assert rows(noted, "chunk_id", "note") == {("a", None), ("b", "old")}
    h = spark.createDataFrame([(1, T0, ["x"], None, [], ["q"]), (2, T0 + timedelta(1), [], ["x"], None, None), (3, None, ["w"], None, None, None)], "id long, timestamp timestamp, modified array<string>, removed array<string>, new array<string>, unchanged array<string>")
    got = {r["id"]: (r["modified"], r["removed"], r["totals"]["unchanged"]) for r in records.history_of(h, "x").collect()}
    assert got == {1: (True, False, 1), 2: (False, True, 0)}
    assert rows(records.retained(h, "timestamp", "id", keep=1), "id") == {(2,)} and rows(records.retained(h, "timestamp", "id", cutoff=F.lit(T0 + timedelta(hours=1))), "id") == {(2,)}
    log = spark.createDataFrame([(1, "g", True, 5, T0), (2, "g", False, 5, T0), (3, "h", None, 5, T0 - timedelta(days=1))], "id long, tool_name string, success boolean, duration_ms long, at timestamp")
    assert rows(records.failure_rates(log, F.lit(T0)), "total", "failures", "rate", "action") == {(2, 1, 0.5, "rebuild_symbols")}
    assert rows(records.failure_rates(log.where("false"), F.lit(T0)), "total", "rate", "action") == {(0, 0.0, "idle")}
    assert [r["id"] for r in records.operation_log(log, "g", limit=1).collect()] == [2]
    one = spark.range(1)
    got = records.index_health(3, 2, 0, F.lit(T0), F.lit(T0 + timedelta(days=9)), one).first()
    assert (got["symbol_status"], got["chunk_status"], got["alerts"]) == ("empty_with_chunks", "ready", ["symbols_missing", "stale_days_9"])
    assert records.index_health(0, 0, 0, F.lit(None).cast("timestamp"), F.lit(T0), one).first()["alerts"] == ["no_documents"]


def test_locks(spark):
    s = lambda n: T0 + timedelta(seconds=n)
    log = [("d", "a", s(0), "acquire", 60, False), ("d", "b", s(10), "acquire", 60, False), ("d", "b", s(20), "acquire", 60, True), ("d", "a", s(30), "refresh", 60, False), ("d", "b", s(40), "release", None, False), ("d", "b", s(41), "release", None, False),
           ("d", "a", s(50), "acquire", 5, None), ("d", "b", s(56), "acquire", None, False), ("e", "a", s(0), "refresh", 9, False), (None, "a", s(0), "acquire", 9, False)]
    r = locks.replay(spark.createDataFrame(log, "document string, agent string, at timestamp, action string, ttl int, force boolean"))
    got = [(x["agent"], x["outcome"], x["held_by"]) for x in r.where("document = 'd'").orderBy("at").collect()]
    assert got == [("a", "acquired", None), ("b", "refused", "a"), ("b", "stolen", "a"), ("a", "refused", "b"), ("b", "released", "b"), ("b", "not_held", None), ("a", "acquired", None), ("b", "reclaimed", "a")]
    assert rows(r.where("document = 'e'"), "outcome") == {("not_held",)}
    c = locks.conflicts(r)
    assert rows(c, "agent_a", "agent_b", "conflict_type") == {("a", "b", "lock_stolen")} and locks.conflicts_of(c, agent="a").count() == 1 and locks.conflicts_of(c, document="e").count() == 0
    st = locks.states(r, F.lit(s(100)))
    assert rows(st, "document", "agent", "state") == {("d", "b", "locked")} and locks.reaped(locks.states(r, F.lit(s(900)))).count() == 0 and locks.released_by(st, "b").count() == 0
    assert rows(locks.lock_stats(st, c), "locked", "expired", "active_agents", "conflicts") == {(1, 0, 1, 1)}


def test_indexing(spark):
    seen = spark.createDataFrame([("a", 1, 1, "h", None), ("b", 2, 1, "h", None), ("c", 1, 1, "x", 5), ("d", 1, 1, "h", None), ("e", 1, 1, "h", None), ("f", 1, 1, "h", None)], "path string, modified long, length long, hash string, expected_version long")
    stored = spark.createDataFrame([("a", 1, 1, "h", 1), ("b", 1, 1, "h", 1), ("c", 1, 1, "x", 4), ("d", 1, 1, "h", 1), ("f", 1, None, "g", 1)], "path string, modified long, length long, hash string, version long")
    held = spark.createDataFrame([("d", "other"), ("a", "me")], "path string, owner string")
    assert dict(rows(indexing.index_plan(seen, stored, held, "me"), "path", "step")) == {"a": "same_file", "b": "same_content", "c": "conflict", "d": "locked", "e": "new", "f": "modified"}
    after = indexing.stored_documents(stored, spark.createDataFrame([("a", "NEW"), ("z", "Z"), (None, "n")], "path string, hash string"), "path", ["hash"], ["version"])
    assert rows(after.where("path IN ('a', 'b', 'z')"), "path", "hash", "version") == {("a", "NEW", 1), ("b", "h", 1), ("z", "Z", None)}
    cache = spark.createDataFrame([("h1", [1.0]), ("h1", [1.0]), (None, [2.0])], "content_hash string, signature array<double>")
    assert rows(indexing.cached_signatures(spark.createDataFrame([("k", "h1"), ("l", "h2"), ("m", None)], "chunk_id string, content_hash string"), cache).withColumn("hit", F.col("signature").isNotNull()), "chunk_id", "hit") == {("k", True), ("l", False), ("m", False)}
    old = spark.createDataFrame([("o1", "p", 0, 5, "h", [1.0, 0.0]), ("o2", "p", 5, 9, "g", [0.0, 1.0])], "chunk_id string, path string, start_pos long, end_pos long, content_hash string, signature array<double>")
    new = spark.createDataFrame([("n1", "p", 0, 5, "h", [0.0, 1.0], "text"), ("n2", "p", 5, 9, "x", [1.0, 0.0], "text"), ("n3", "p", 9, 12, "y", [0.1, 1.0], "code"), ("n4", "q", 0, 5, "z", [-1.0, -1.0], "text"), ("n5", "q", 5, 6, "z", None, None)], "chunk_id string, path string, start_pos long, end_pos long, content_hash string, signature array<double>, modality string")
    assert dict(rows(indexing.chunk_changes(new, old, 2), "chunk_id", "class")) == {"n1": "restored", "n2": "reprocessed", "n3": "restored", "n4": "new", "n5": "new"}
    assert rows(indexing.removed_ids(old, new), "chunk_id") == {("o1",), ("o2",)}
    shown, totals = indexing.capped(spark.createDataFrame([("new", i) for i in range(5)], "status string, id long"), "status", ["id"], 2)
    assert shown.count() == 2 and rows(totals, "status", "total") == {("new", 5)}


def test_embedded_notes(spark):
    from quillgraph.sources.files import add_memory, embed_notes

    chunks = spark.createDataFrame([("a", "p", "text", 1)], "chunk_id string, document_path string, content string, token_count long")
    req = spark.createDataFrame([("a", "def f(): pass", None), ("m", "note", [0.5] * 32), ("x", "bad", [1.0]), ("y", None, None), (None, "z", None)], "chunk_id string, text string, values array<double>")
    vectors, notes, errors = embed_notes(chunks, req)
    assert {r["chunk_id"]: round(sum(x * x for x in r["v"]), 6) for r in vectors.collect()} == {"a": 1.0, "m": 1.0}
    assert rows(notes, "memory_id", "content") == {("m", "note")} and rows(errors, "chunk_id") == {("x",), ("y",)}
    assert add_memory(chunks, notes).count() == 2
