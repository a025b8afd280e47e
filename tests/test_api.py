import pytest

from quillgraph import config
from quillgraph.api import Engine


def test_engine_from_folder(spark, tmp_path):
    (tmp_path / "pkg").mkdir()
    (tmp_path / "pkg/base.py").write_text("def core_value(x):\n    return x + 1\n")
    (tmp_path / "pkg/mid.py").write_text("from base import core_value\n\ndef middle(y):\n    return core_value(y)\n")
    (tmp_path / "notes.md").write_text("# Notes\n\nThe middle layer calls the core.\n")
    e = Engine.from_folder(spark, str(tmp_path))
    assert {r["document_path"] for r in e.project_map().collect()} == {"pkg/base.py", "pkg/mid.py", "notes.md"}
    paths = {r["chunk_id"]: r["document_path"] for r in e.chunks.collect()}
    assert [paths[r["chunk_id"]] for r in e.search("notes layer").collect()][0] == "notes.md"
    assert e.search("core value", mode="hybrid").count() >= 2
    assert {paths[r["chunk_id"]] for r in e.search("core", path_prefix="pkg").collect()} == {"pkg/base.py", "pkg/mid.py"}
    groups, told = e.agent_grep("core_value(")
    assert {(m["file"], m["scope"], m["line"]) for g in groups.collect() for m in g["matches"]} == {("pkg/base.py", "core_value", 1), ("pkg/mid.py", "middle", 4)}
    assert told.first()["summary"] == "2 matches in 2 files"
    assert e.search("core value", max_tokens=1).count() == 0 and "content_preview" in e.search("notes", compact=True).columns
    assert e.search("zzz core_value").first()["score"] > 0 and e.search("zzzz").count() == 0
    refused = e.give_vectors(spark.createDataFrame([("nope", [1.0] * 128), (next(iter(paths)), [0.0] * 128)], "chunk_id string, v array<double>"))
    assert {r["reason"] for r in refused.collect()} == {"unknown_chunk", "unusable_vector"} and e.search("core value", mode="hybrid").count() >= 2
    assert {r["path"] for r in e.impact_files("pkg/base.py").collect()} == {"pkg/mid.py"} and e.impact_radius(symbol="core_value").count() == 2 and e.impact_radius(symbol="core_value", excluded=["core_value", "base"]).count() == 1
    assert {r["verdict"] for r in e.find_references("core_value").collect()} == {"referenced"} and e.find_definition("middle").first()["shadow_count"] == 1
    with pytest.raises(ValueError, match="must be given"):
        e.impact_radius()
    assert {paths[r["chunk_id"]] for r in e.impact_radius("pkg/base.py").collect()} == {"pkg/base.py", "pkg/mid.py"}
    assert [r["path"] for r in e.coupling("pkg/base.py").collect()] == ["pkg/mid.py"]
    assert e.find_definition("middle").count() == 1 and e.find_references("core_value").count() >= 1
    a, b = e.batch([("search_text", {"pattern": "middle"}), ("project_map", {})])
    assert a.count() == 2 and b.count() == 3
    assert e.answer("core_value").count() == 3
    with pytest.raises(ValueError, match="private"):
        e.batch([("_once", {})])


def test_config(tmp_path):
    p = tmp_path / "c.toml"
    p.write_text("[engine]\nchunk_size = 100\nskip_dirs = ['x']\n")
    c = config.load(str(p), search_alpha=0.5, merge_threshold=None)
    assert (c.chunk_size, c.search_alpha, c.merge_threshold, c.skip_dirs) == (100, 0.5, 0.70, ("x",))
    assert c.thresholds("code") == (0.85, 0.80) and c.thresholds("other") == (0.70, 0.85)
    assert config.load(None).chunk_size == 256
    with pytest.raises(ValueError, match="nope"):
        config.load(nope=1)
