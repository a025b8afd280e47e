import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.operators import bm25, grep, vectors

DOCS = [("c1", "allergen dietary compliance checking service"), ("c2", "unrelated units test boilerplate"), ("c3", "express route handler generic"), ("c3", "express route handler generic"), ("c4", ""), ("c5", None), (None, "allergen")]


@pytest.fixture(scope="module")
def index(spark):
    return bm25.Index(spark.createDataFrame(DOCS, "id string, t string").withColumn("term", F.lit(1)), "id", "t")


def test_bm25(index):
    best = bm25.top(index.scores("allergen dietary compliance"), 3).collect()
    assert [r["id"] for r in best] == ["c1"] and best[0]["score"] > 0
    assert index.stats().first()["n"] == 3
    assert index.scores("zzz").count() == 0
    double = index.scores("allergen allergen").first()["score"]
    assert abs(double - 2 * index.scores("allergen").first()["score"]) < 1e-9


def test_bm25_empty(spark):
    e = bm25.Index(spark.createDataFrame([], "id string, t string"), "id", "t")
    assert e.scores("x y").count() == 0 and e.stats().first()["n"] == 0


def test_nearest(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(100, None), (101, [1.0]), (102, [float("nan")] * 8), (103, [0.0] * 8), (104, x[3].tolist())]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    want = sorted(range(60), key=lambda i: (-round(float(unit[i] @ unit[3]), 12), i))[:5]
    got = [r["id"] for r in vectors.nearest(df, "id", "v", x[3].tolist(), 6).collect()]
    assert got[:2] == [3, 104] and got[2:] == want[1:]
    batch = vectors.nearest_batch(df.where("id % 10 = 0"), df, "id", "v", 8, 4, blocks=2).collect()
    for q in (0, 10, 50):
        mine = sorted((r["rank"], r["id"]) for r in batch if r["query_id"] == q)
        sims = {i: float(unit[i] @ unit[q]) for i in range(60)} | {103: 0.0, 104: float(unit[3] @ unit[q])}
        assert [i for _, i in mine] == sorted(sims, key=lambda i: (-round(sims[i], 12), i))[:4]


def hybrid_rows(spark, near, kw, **k):
    n = spark.createDataFrame(near, "id string, similarity double")
    b = spark.createDataFrame(kw, "id string, score double")
    return [(r["id"], round(r["score"], 6), r["source"]) for r in vectors.hybrid(n, b, 0.3, 5, **k).collect()]


def test_hybrid_blends_and_falls_back(spark):
    near = [("a", 0.95), ("b", 0.9), ("c", 0.85), ("d", 0.82)]
    kw = [("a", 4.0), ("b", 2.0), ("c", 1.0)]
    assert hybrid_rows(spark, near, kw)[0] == ("a", 1.0, "vector")
    weak = hybrid_rows(spark, [("x", 0.5), ("y", 0.4)], kw)
    assert weak[0] == ("a", 1.0, "keyword")
    assert hybrid_rows(spark, near, [])[0][2] == "vector"
    assert hybrid_rows(spark, [], []) == []
    boosted = spark.createDataFrame([("a",), ("a",)], "id string")
    assert hybrid_rows(spark, near, kw, boosted=boosted)[0][1] == round(0.3 * 1.3 + 0.7, 6)


def test_blend_weight():
    assert vectors.blend_weight("how to bake bread", 0.7) == pytest.approx(0.3)
    assert vectors.blend_weight("def parse_config(args) {}", 0.7) == pytest.approx(0.4)
    assert vectors.blend_weight("the end.", 0.7) == pytest.approx(0.3)


def test_grep(spark):
    c = spark.createDataFrame([("k1", "d", "aaaa\ndef f():\n  aa()\n", 0), ("k2", "d", "x\naa", 30), ("k3", "d", None, 50), ("k4", "e", "a.a", 0)], "chunk_id string, document_path string, content string, start_pos long")
    assert {r["chunk_id"]: r["matches"] for r in grep.matching_chunks(c, "aa").collect()} == {"k1": 4, "k2": 1}
    assert {r["chunk_id"]: r["matches"] for r in grep.matching_chunks(c, "aa", regex=True).collect()} == {"k1": 3, "k2": 1}
    assert {r["chunk_id"] for r in grep.matching_chunks(c, "a.a").collect()} == {"k4"}
    assert {r["chunk_id"]: r["base_line"] for r in grep.base_lines(c).collect()} == {"k1": 1, "k2": 4, "k3": 6, "k4": 1}
    defs = spark.createDataFrame([(1, "k1", "f", 2), (2, "k1", "g", 9)], "id long, chunk_id string, name string, line_number long")
    scoped = grep.with_scope(grep.matching_lines(c, "aa").select("chunk_id", "line_in_chunk"), defs).collect()
    assert {(r["chunk_id"], r["line_in_chunk"]): r["scope"] for r in scoped} == {("k1", 1): None, ("k1", 3): "f", ("k2", 2): None}
    with pytest.raises(ValueError, match="empty"):
        grep.matching_chunks(c, "")


def test_products_are_bounded(spark, monkeypatch):
    """However many the queries are, a task holds few similarities at once, and the best are the same as by brute force, ties by id."""
    import tracemalloc

    rng = np.random.default_rng(5)
    x, y = (v / np.linalg.norm(v, axis=1)[:, None] for v in (rng.normal(size=(5000, 8)), rng.normal(size=(4096, 8))))
    y[1::2] = y[::2]
    ids = np.array([f"i{(j * 7) % 4096:04d}" for j in range(len(y))], object)
    monkeypatch.setattr(vectors, "CELLS", 1 << 17)
    best_s, best_i = np.full((len(x), 3), -np.inf), np.empty((len(x), 3), object)
    tracemalloc.start()
    for lo in range(0, len(y), 512):
        vectors._merged(x, y[lo : lo + 512], ids[lo : lo + 512], best_s, best_i, 3)
    assert tracemalloc.get_traced_memory()[1] < 8 << 20
    tracemalloc.stop()
    for q in range(0, len(x), 100):
        s = np.round(y @ x[q], 12)
        assert list(best_i[q]) == [ids[j] for j in sorted(range(len(y)), key=lambda j: (-s[j], ids[j]))[:3]]
    # both ways of the operator
    df = spark.createDataFrame([(f"a{i:02d}", [float(z) for z in v]) for i, v in enumerate(y[:60])], "id string, v array<double>")
    told = lambda: [(r["query_id"], r["rank"], r["id"], round(r["similarity"], 9)) for r in vectors.nearest_batch(df.where("id < 'a20'"), df, "id", "v", 8, 3, blocks=2).orderBy("query_id", "rank").collect()]
    sent = told()
    monkeypatch.setattr(vectors, "SENT", 0)
    assert len(sent) == 60 and told() == sent
    assert {r["rank"] for r in vectors.nearest_batch(df.limit(2), df.limit(2), "id", "v", 8, 3).collect()} == {1, 2}
