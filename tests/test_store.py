from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import chunkers, features, incremental, store
from quillgraph.sources import files

T0 = datetime(2026, 1, 1)


def rows(df, *cols):
    return {tuple(r[c] for c in cols) for r in df.collect()}


def test_pending_and_target(spark, tmp_path):
    target = incremental.Target(spark, str(tmp_path / "t"), "k", "v")
    source = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, None, "z"), (None, "d", "w")], "k long, v string, clash string")
    assert target.pending(source).count() == 4
    target.publish(target.pending(source).where("v IS NOT NULL AND k IS NOT NULL"))
    assert rows(target.pending(source), "k", "v") == {(3, None), (None, "d")}
    changed = spark.createDataFrame([(1, "a2", "x"), (2, "b", "y")], "k long, v string, clash string")
    assert rows(target.pending(changed), "k") == {(1,)}
    # a run that writes and breaks off before committing changes nothing
    changed.write.parquet(str(tmp_path / "t" / "seg-lost"))
    assert rows(target.pending(changed), "k") == {(1,)}
    # a commit that broke off half-way has no number yet and does not block the next
    (tmp_path / "t" / "_log" / "draft-lost").write_text("seg")
    target.publish(target.pending(changed))
    assert target.pending(changed).count() == 0 and rows(target.rows(), "k", "v") == {(1, "a2"), (2, "b")}
    # back to an older version is a change
    assert rows(target.pending(source.where("k = 1")), "k") == {(1,)}
    # a number that is taken is refused, without effect
    with pytest.raises(Exception, match="(?i)exist"):
        target._commit(2, "seg-lost")
    # compaction changes what is read, not what it says; what no run names can go
    before = rows(target.rows(), "k", "v")
    assert target.compact() == 3 and len(target.commits()) == 1 and rows(target.rows(), "k", "v") == before and target.compact() is None
    assert target.vacuum() == [] and {"seg-lost", "draft-lost"} <= set(target.vacuum(older_than_seconds=-60)) and rows(target.rows(), "k", "v") == before
    target.publish(source.where("k = 1"))
    assert rows(target.rows(), "k", "v") == {(1, "a"), (2, "b")} and rows(target.pending(changed), "k") == {(1,)}


def test_documents_to_process(spark):
    from hashlib import sha256

    h = lambda t: sha256(t.encode()).hexdigest()
    runs = spark.createDataFrame(
        [(1, T0, "running"), (1, T0, " SUCCESS"), (2, T0 + timedelta(hours=1), "failed"), (3, T0 + timedelta(days=3), "success"), (4, None, "success")], "run_id long, started_at timestamp, status string"
    )
    late = T0 + timedelta(days=9)
    docs = spark.createDataFrame(
        [
            (1, "a", " SHA256: " + h("a").upper() + " ", T0), (2, "a", h("b"), T0), (3, "a", None, T0), (4, None, h(""), late), (5, "a", h("a"), None),
            (6, "a", h("a"), T0 + timedelta(days=2)), (7, "a", h("a"), T0 - timedelta(seconds=1)), (8, "", h(""), T0 + timedelta(days=3)),
        ],
        "doc_id long, text string, content_hash string, indexed_at timestamp",
    )
    assert rows(incremental.documents_to_process(docs, runs), "doc_id") == {(2,), (3,), (5,), (6,), (7,)}
    assert incremental.documents_to_process(docs, runs.where("false")).count() == 8
    assert incremental.documents_to_process(docs.where("false"), runs).count() == 0


def test_versions_and_diff(spark):
    cur = spark.createDataFrame([("a", 3, "x"), ("b", 1, "y")], "k string, version long, h string")
    inc = spark.createDataFrame([("a", "x2"), ("c", "z"), (None, "n"), ("c", "z")], "k string, h string")
    assert rows(store.upsert_versions(cur, inc, "k", ["h"]), "k", "version", "h", "replaced") == {("a", 4, "x2", True), ("b", 1, "y", False), ("c", 1, "z", False)}
    a = spark.createDataFrame([("p", "1"), ("q", "1"), ("r", None)], "k string, v string")
    b = spark.createDataFrame([("p", "1"), ("r", "1"), ("s", "1")], "k string, v string")
    assert rows(store.snapshot_diff(a, b, "k", "v"), "k", "status") == {("p", "unchanged"), ("q", "removed"), ("r", "modified"), ("s", "new")}


def test_compare_and_set(spark):
    cas = store.compare_and_set(spark.createDataFrame([("d", 2)], "document_path string, doc_version long"), spark.createDataFrame([("d", 2), ("d", 1), ("x", 1), ("d", None)], "document_path string, expected long"))
    assert sorted((r["granted"], r["new_version"]) for r in cas.collect() if r["actual"]) == [(False, 2), (False, 2), (True, 3)]


def test_prune(spark):
    s = spark.createDataFrame([("s", 1, 0.1, 5), ("s", 2, 0.9, 5), ("s", 3, 0.5, 5)], "s string, i int, r double, n long")
    assert rows(store.prune_to_budget(s, "s", "n", [F.col("r"), F.col("i")], 10).where("kept"), "i") == {(2,), (3,)}
    assert store.prune_to_budget(s, "s", "n", [F.col("r"), F.col("i")], 99).where("kept").count() == 3


def test_annotations(spark):
    a = spark.createDataFrame([(1, "Check THIS", ["x", "y"]), (2, "other", ["z"]), (3, None, None)], "id long, content string, tags array<string>")
    assert rows(store.annotation_search(a, "this"), "id") == {(1,)}
    assert rows(store.with_any_tag(a, ["z", "q"]), "id") == {(2,)}


def test_files(spark, tmp_path):
    for p, t in (("a.py", "x = 1\n"), ("sub/b.md", "hé\n"), (".git/c.py", "no"), ("node_modules/d.js", "no"), ("e.bin", "no")):
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_text(t)
    f = files.files(spark, str(tmp_path))
    assert rows(f, "path", "modality") == {("a.py", "code"), ("sub/b.md", "text")}
    assert rows(files.texts(f), "path", "text") == {("a.py", "x = 1\n"), ("sub/b.md", "hé\n")}
    stored = f.where("path = 'a.py'").select("path", "modified", "length")
    assert rows(files.changed_files(f, stored), "path") == {("sub/b.md",)}
    states = spark.createDataFrame([("s", "c", 1, '{"a": 1}'), ("s", "d", 1, "broken")], "session_id string, chunk_id string, turn_number int, state string")
    files.write_states(states, str(tmp_path / "kv"))
    assert {r["chunk_id"]: r["state"] and r["state"]["a"] for r in files.read_states(spark, str(tmp_path / "kv"), "a int").collect()} == {"c": 1, "d": None}


def greedy(sizes, limits):
    runs, total = [], 0
    for n, m in zip(sizes, limits, strict=True):
        if runs and total + n > m:
            runs.append(0)
            total = 0
        elif not runs:
            runs.append(0)
        total += n
        runs[-1] += 1
    return runs


def test_dealt():
    import random

    rng = random.Random(3)
    for _ in range(50):
        sizes = [rng.randint(1, 9) for _ in range(rng.randint(1, 30))]
        limits = [rng.randint(8, 14) for _ in sizes]
        starts = chunkers.dealt(sizes, limits)
        assert [b - a for a, b in zip(starts, [*starts[1:], len(sizes)], strict=True)] == greedy(sizes, limits)


def test_windows():
    import random

    import numpy as np

    def walk(sizes, size, most, overlap):
        out, i = [], 0
        while i < len(sizes):
            first, total = i, 0
            while i < len(sizes) and total < size and total + sizes[i] <= most:
                total += sizes[i]
                i += 1
            if i == first:
                break
            out.append((first, i))
            if i < len(sizes):
                i = next(b for b in range(first + 1, i + 1) if sum(sizes[b:i]) <= overlap)
        return out

    rng = random.Random(4)
    for _ in range(200):
        sizes = [rng.randint(1, 12) for _ in range(rng.randint(0, 25))]
        args = rng.randint(1, 20), rng.randint(8, 25), rng.randint(0, 12)
        assert chunkers.windows(np.array(sizes, np.int64), *args) == walk(sizes, *args)


def test_token_estimates_agree(spark):
    import random

    from quillgraph.functions import text as T

    rng = random.Random(8)
    signs = ["a", "Bc", "HTTP", "X", "1", "_", "é", "日", " ", "\n", "\t ", "(", ")", ":", "=", ".", "\u00a0"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 25))) for _ in range(800)]
    rows = spark.createDataFrame([(t,) for t in texts], "x string").select("x", T.estimated_tokens("x").alias("n")).collect()
    assert [(r["x"], r["n"]) for r in rows if r["n"] != T.token_estimate(r["x"])] == []


@pytest.fixture
def prose(spark):
    para = "One sentence here. Another one follows! A third? " * 6
    return spark.createDataFrame([("a", "\n\n".join([para] * 9)), ("b", ""), ("c", None), ("d", " \n\n "), ("d", " \n\n "), (None, "x")], "id string, t string")


def test_paragraphs_and_windows(spark, prose):
    c = chunkers.paragraphs(prose, "id", "t").orderBy("doc", "chunk_index").collect()
    a = [r for r in c if r["doc"] == "a"]
    assert len(a) > 1 and [r["chunk_index"] for r in a] == list(range(len(a)))
    assert all(x["end_pos"] == y["start_pos"] for x, y in zip(a, a[1:], strict=False))
    assert {(r["doc"], r["content"], r["end_pos"]) for r in c if r["doc"] != "a"} == {("b", "", 0), ("c", "", 0), ("d", "", 0)}
    w = [r for r in chunkers.sentence_windows(prose, "id", "t", size=40, overlap=8).orderBy("doc", "chunk_index").collect() if r["doc"] == "a"]
    text = prose.where("id = 'a'").first()["t"]
    assert all(text[r["start_pos"] :].startswith(r["content"][:20]) for r in w)
    assert any(y["start_pos"] < x["end_pos"] for x, y in zip(w, w[1:], strict=False))


def test_code_chunks(spark):
    py = "import os\n\n" + "\n\n".join(f"def f{i}(a):\n    return {'a + ' * 60}{i}\n" for i in range(6))
    go = "package x\n" + "\n".join(f"func F{i}(a int) int {{\n\treturn {'a + ' * 90}{i}\n}}" for i in range(4))
    df = spark.createDataFrame([("p", py, "a.py"), ("g", go, "b.go"), ("l", "word\n" * 900, "c.js"), ("e", "", "d.rs"), ("x", "def f(:", "y.py")], "id string, t string, path string")
    c = chunkers.code(df, "id", "t", "path").collect()
    by = {k: sorted((r["chunk_index"], r["content"]) for r in c if r["doc"] == k) for k in "pglex"}
    assert len(by["p"]) > 1 and "".join(x for _, x in by["p"]).count("def f") == 6
    assert len(by["g"]) >= 2 and by["g"][0][1].startswith("package x")
    assert len(by["l"]) > 1 and by["e"] == [(0, "")] and by["x"] == [(0, "def f(:")]


def test_fingerprint_and_merge(spark):
    df = spark.createDataFrame([("a", "def f(x):\n    return x\n"), ("b", ""), ("c", None)], "id string, t string")
    got = {r["id"]: r["signature"] for r in features.fingerprints(df, "id", "t").collect()}
    assert abs(sum(x * x for x in got["a"]) - 1) < 1e-5 and len(got["b"]) == 128 and got["c"] is None
    ch = spark.createDataFrame([("d", i, t, i * 10, i * 10 + 9, 5, m) for i, (t, m) in enumerate([("same words here", "text"), ("same words here", "text"), ("@#%&*{}[]()", "text")])], "doc string, chunk_index long, content string, start_pos long, end_pos long, tokens long, modality string")
    m = features.merge_similar(ch, threshold=0.9).orderBy("chunk_index").collect()
    assert m[0]["content"] == "same words here\n\nsame words here" and m[0]["tokens"] == 6 and [r["chunk_index"] for r in m] == [0, 1]
    apart = features.merge_similar(ch.withColumn("modality", F.lit("code")).replace({"same words here": "def same(words)"}, subset=["content"])).collect()
    assert len(apart) == 3  # definitions stay apart
