from pyspark.sql import functions as F

from quillgraph.operators import compose
from quillgraph.functions import text as T


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column).first()[0]


def test_trimmed(spark):
    text = "alpha beta, gamma(delta): x_Y 日本 end"
    for budget in range(1, 15):
        got = one(spark, text, compose.trimmed("x", budget, mark=""))
        assert text.startswith(got) and one(spark, got, T.estimated_tokens("x")) <= budget
        if got != text:
            more = one(spark, text, compose.trimmed("x", budget + 1, mark=""))
            assert len(more) >= len(got)
    assert one(spark, text, compose.trimmed("x", 99)) == text
    assert one(spark, text, compose.trimmed("x", 1)).endswith("[truncated]")
    assert one(spark, "", compose.trimmed("x", 1)) == "" and one(spark, None, compose.trimmed("x", 1)) is None


def test_common_folder(spark):
    f = lambda *p: compose.common_folder(spark.createDataFrame([(x,) for x in p], "p string"), "p").first()[0]
    assert f("a/b/c.py", "a/b/d/e.py") == "a/b"
    assert f("a/bc/x", "a/bd/y") == "a"
    assert f("x.py", "a/y.py") == ""


def test_notes_and_actions(spark):
    assert one(spark, '{"a":  1}', compose.parsed_notes("x")) == '{"a":1}'
    assert one(spark, "plain {", compose.parsed_notes("x")) == "plain {"
    assert [one(spark, r, compose.busy_action(F.col("x").cast("double"))) for r in ("0", "0.05", "0.5")] == ["idle", "vacuum", "rebuild_symbols"]


def test_first_sources_and_boost(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "chunk_id string, pos long")
    b = spark.createDataFrame([("y", 1), ("z", 2)], "chunk_id string, pos long")
    got = [(r["chunk_id"], r["source"]) for r in compose.first_sources([("a", a), ("b", b)], 3).collect()]
    assert got == [("x", "a"), ("y", "a"), ("z", "b")]
    symbols = spark.createDataFrame([(1, "Foo", "definition", "z"), (2, "foo", "definition", "x"), (3, "foo", "reference", "w")], "id long, name string, role string, chunk_id string")
    ranked = spark.createDataFrame([("x", 0.5)], "chunk_id string, score double")
    chunks = spark.createDataFrame([("x",), ("z",), ("w",)], "chunk_id string")
    assert [tuple(r) for r in compose.symbol_boost(ranked, symbols, ["FOO"], chunks).collect()] == [("z", 0.425, "Foo")]
    assert [tuple(r) for r in compose.symbol_boost(ranked.where("false"), symbols, ["bar"], chunks).collect()] == []


def test_attach_edges(spark):
    e = spark.createDataFrame([("a", "b", "f"), ("a", "c", "e"), ("c", "a", "g")], "source_chunk_id string, target_chunk_id string, symbol_name string")
    h = spark.createDataFrame([("a",), ("q",)], "chunk_id string")
    got = {r["chunk_id"]: (r["depends_on"], r["depended_on_by"]) for r in compose.attach_edges(h, e).collect()}
    assert got == {"a": (["e", "f"], ["g"]), "q": ([], [])}


def test_change_classes(spark):
    v = [1.0, 0.0]
    rows = [("n", 1, "h", v), ("r", 1, "h", v), ("r", 2, "h", [0.0, 1.0]), ("s", 1, "a", v), ("s", 2, "b", [1.0, 0.1]), ("p", 1, "a", v), ("p", 2, "b", [0.0, 1.0]), ("p", 2, "b", [0.0, 1.0]), ("u", 1, "a", None), ("u", 2, None, v)]
    df = spark.createDataFrame(rows, "chunk_id string, version long, content_hash string, semantic_signature array<double>")
    assert {r["chunk_id"]: r["class"] for r in compose.change_classes(df).collect()} == {"n": "new", "r": "restored", "s": "restored", "p": "reprocessed", "u": "reprocessed"}
