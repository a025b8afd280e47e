import re

import pytest
from pyspark.sql import functions as F

from quillgraph.functions import query as Q
from quillgraph.operators import answers

SYMBOLS = "id long, name string, kind string, role string, chunk_id string, document_path string, line_number long"


def test_query_analysis():
    got = set(Q.identifiers("parse_config and HTTPServer for the loginHandler"))
    assert {"parse_config", "HTTPServer", "loginHandler", "HTTP", "Server", "login", "Handler"} <= got and not {"and", "for", "the"} & {x.lower() for x in got}
    assert Q.identifiers("") == [] and Q.identifiers("a the 12") == []
    terms = Q.proximity_terms("Rebuild the cached manifest when resolve_gauge fails with this")
    assert {"rebuild", "cached", "manifest", "when", "resolve_gauge", "fails"} <= set(terms) and not {"with", "this", "the"} & set(terms)
    assert Q.wants_everything("look Everywhere") and not Q.wants_everything("look here")


@pytest.mark.parametrize(("text", "pattern", "regex", "want"), [("aaaa", "aa", False, [0, 1, 2]), ("aaaa", "aa", True, [0, 2]), ("xaab\naa", "aa", False, [1, 5]), ("xab12yab3", "ab[0-9]+", True, [1, 6]), ("none", "aa", False, []), ("(a)(a)", "(a", False, [0, 3]), ("a" * 40, "a", False, list(range(10))), ("ab", "(a)(b)", True, [0])])
def test_match_starts(spark, text, pattern, regex, want):
    assert spark.createDataFrame([(text,)], "x string").select(answers.match_starts(F.col("x"), pattern, regex)).first()[0] == want


def test_grep_answer(spark):
    body = "import os\n# find_me here\nclass Service:\n    def run(self):\n        return find_me(1)\n"
    same = "import x\nfind_me(2)\n"
    rows = [("a1", "app.py", body, 0), ("b1", "b.py", same, 0), ("c1", "c.py", same, 0), ("d1", "d.py", same, 0), ("d2", "d.py", None, 40)]
    chunks = spark.createDataFrame(rows, "chunk_id string, document_path string, content string, start_pos long")
    symbols = spark.createDataFrame([(1, "Service", "class", "definition", "a1", "app.py", 3), (2, "run", "function", "definition", "a1", "app.py", 4), (3, "X", "variable", "definition", "a1", "app.py", 5)], SYMBOLS)
    m = answers.entries(chunks, symbols, "find_me")
    got = [(r["file"], r["line"], r["scope"], r["classification"]) for r in m.orderBy("pos").collect()]
    assert got == [("app.py", 2, None, "comment"), ("app.py", 5, "run", "code"), ("b.py", 2, None, "code"), ("c.py", 2, None, "code"), ("d.py", 2, None, "code")]
    g = answers.grouped(m).orderBy("position").collect()
    assert [(r["key"], r["count"], r["shown"]) for r in g] == [("app.py", 2, True), ("b.py", 1, True)]
    assert g[1]["matches"][0]["also_in"] == 2 and g[1]["matches"][0]["also_in_files"] == ["c.py", "d.py"]
    s = answers.summary(answers.grouped(m), m).first()
    assert (s["total_matches"], s["shown_matches"], s["truncated"], s["files"]) == (5, 3, 0, 4) and s["summary"] == "5 matches in 4 files (2 duplicates collapsed)"
    plain = answers.grouped(m, "classification", deduplicate=False).orderBy("position").collect()
    assert [(r["key"], r["count"]) for r in plain] == [("comment", 1), ("code", 4)]
    assert [r["key"] for r in answers.grouped(m, "scope").orderBy("position").collect()] == ["(top-level)", "run"]
    long = answers.entries(chunks.withColumn("content", F.regexp_replace("content", "find_me", "find_me" + " word" * 400)), symbols, "find_me")
    cut = answers.grouped(long, max_tokens=10, deduplicate=False)
    assert [r["shown"] for r in cut.orderBy("position").collect()] == [True, False, False, False]
    assert re.search(r"\(showing 2, ~\d+ tokens\)", answers.summary(cut, long).first()["summary"])
    near = answers.entries(chunks, symbols, "find_me", context=1).orderBy("pos").first()
    assert near["excerpt"] == "import os\n# find_me here\nclass Service:"
    assert answers.grouped(answers.entries(chunks, symbols, "absent")).count() == 0
    none = answers.entries(chunks, symbols, "absent")
    assert answers.summary(answers.grouped(none), none).first()["summary"] == "0 matches in 0 files"


def test_within_tokens(spark):
    df = spark.createDataFrame([("a", 1, "one two three"), ("b", 2, "word " * 500), ("c", 3, "x")], "id string, rank int, content string")
    assert [r["id"] for r in answers.within_tokens(df, [F.col("rank")], 10).collect()] == ["a"]
    compact = answers.within_tokens(df, [F.col("rank")], 10_000, compact=True).orderBy("rank").collect()
    assert len(compact[1]["content_preview"]) == 401 and compact[1]["content_token_estimate"] > 400 and "content" not in compact[0].asDict()
    assert answers.within_tokens(df, [F.col("rank")], None).count() == 3


def test_recall(spark):
    hits = spark.createDataFrame([("q", "a", 1), ("q", "b", 7), ("q", "z", 2)], "query_id string, id string, rank long")
    labels = spark.createDataFrame([("q", "mixed", "a"), ("q", "mixed", "b"), ("q", "mixed", "b"), ("r", "exact", "y")], "query_id string, category string, id string")
    got = {r["query_id"]: (r["recall_at_5"], r["recall_at_10"]) for r in answers.recall(hits, labels).collect()}
    assert got == {"q": (0.5, 1.0), "r": (0.0, 0.0)}
