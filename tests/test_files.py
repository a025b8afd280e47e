from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quillgraph import session
from quillgraph.sources import files

T0 = datetime(2026, 1, 1)


@pytest.mark.parametrize(("path", "root", "want"), [("./a//b.py", None, "a/b.py"), ("a\\b\\c.py", None, "a/b/c.py"), ("/p/x/a.py", "/p/x/", "a.py"), ("/p/xy/a.py", "/p/x", "/p/xy/a.py"), ("a/b/", None, "a/b"), ("", None, "")])
def test_normal_path(spark, path, root, want):
    assert spark.createDataFrame([(path,)], "p string").select(files.normal_path("p", root)).first()[0] == want


def test_folder(spark, tmp_path):
    (tmp_path / ".hidden").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src").mkdir()
    for name, data in {"src/a.py": b"x = 1\n", "src/b.md": b"caf\xff", "src/c.bin": b"x", ".hidden/d.py": b"x", "node_modules/e.js": b"x", "f.png": b"\x89PNG"}.items():
        (tmp_path / name).write_bytes(data)
    seen = files.files(spark, str(tmp_path))
    got = {r["path"]: (r["modality"], r["text"]) for r in files.texts(seen).collect()}
    assert got == {"src/a.py": ("code", "x = 1\n"), "src/b.md": ("text", "caf�"), "f.png": ("image", None)}
    assert {r["path"] for r in files.files(spark, str(tmp_path), skipped=["src"]).collect()} == {"node_modules/e.js", "f.png"}
    stored = seen.select("path", "modified", F.when(F.col("path") != "src/b.md", F.col("length")).alias("length"))
    assert {r["path"] for r in files.changed_files(seen, stored).select("path").collect()} == {"src/b.md"}
    assert files.changed_files(seen, stored.withColumn("modified", F.lit(T0))).count() == 3


def test_states_and_snapshots(spark, tmp_path):
    rows = spark.createDataFrame([("s", "c", 1, '{"a": 1}'), ("s", "d", 2, "no json"), ("t", "c", 1, None)], "session_id string, chunk_id string, turn_number long, state string")
    files.write_states(rows, str(tmp_path / "kv"))
    assert {(r["chunk_id"], r["state"]) for r in files.read_states(spark, str(tmp_path / "kv")).collect()} == {("c", '{"a": 1}'), ("d", "no json"), ("c", None)}
    parsed = files.read_states(spark, str(tmp_path / "kv"), "struct<a:int>")
    assert {(r["session_id"], r["chunk_id"], r["state"]["a"] if r["state"] else None) for r in parsed.collect()} == {("s", "c", 1), ("s", "d", None), ("t", "c", None)}
    first, second = files.write_snapshot(rows, str(tmp_path / "v")), files.write_snapshot(rows.limit(1), str(tmp_path / "v"))
    assert first != second and spark.read.parquet(first).count() == 3 and spark.read.parquet(second).count() == 1


def test_memory(spark):
    chunks = spark.createDataFrame([("a", "p", "text", 1)], "chunk_id string, document_path string, content string, token_count long")
    notes = spark.createDataFrame([("n", "twelve signs"), ("n", "twelve signs"), (None, "x"), ("e", None)], "memory_id string, content string")
    once = files.add_memory(chunks, notes)
    assert {(r["document_path"], r["token_count"]) for r in once.collect()} == {("p", 1), ("memory:n", 3)} and files.add_memory(once, notes).count() == 2


def test_materialized_tables_have_a_schema_of_their_own(spark):
    df = session.materialize_by(spark.range(10), "id", "probe")
    assert df.count() == 10 and session.SCHEMA in {d.name for d in spark.catalog.listDatabases()}
    assert not [t for t in spark.catalog.listTables("default") if t.name.startswith("quillgraph_")]
