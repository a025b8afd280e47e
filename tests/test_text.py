import random
import re

import pytest
from pyspark.sql import functions as F

from quillgraph.functions import embedding
from quillgraph.functions import text as T
from quillgraph.functions.stem import stem, stem_sql

STEMS = "caresses cares ponies poni ties ti cats cat stress stress agreed agre feed feed plastered plaster bled bled hopping hop filing file falling fall hissing hiss happy happi sky sky early earli a a at at running run connections connect hopeful hope goodness good allowance allow inference infer electrical electr generalization gener stressed stress tanned tan".split()


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column).first()[0]


def test_stems(spark):
    pairs = list(zip(STEMS[::2], STEMS[1::2], strict=True))
    rows = spark.createDataFrame(pairs, "w string, e string").withColumn("g", F.expr(stem_sql("w"))).collect()
    assert [(r["w"], r["g"]) for r in rows] == pairs
    assert [(w, stem(w)) for w, _ in pairs] == pairs


def test_stem_forms_agree(spark):
    rng = random.Random(1)
    ends = ["ational", "ed", "ing", "eed", "ies", "ness", "ement", "ion", "y", "ss", "e", "ll", "izing", "ive", "iviti"]
    words = {"".join(rng.choice("abcdeiouylstrwx") for _ in range(rng.randint(1, 6))) + rng.choice(["", *ends]) for _ in range(3000)} | {"123", "a1b2ing", "x_ed"}
    rows = spark.createDataFrame([(w,) for w in words], "w string").withColumn("g", F.expr(stem_sql("w"))).collect()
    assert [(r["w"], r["g"]) for r in rows if r["g"] != stem(r["w"])] == []


@pytest.mark.parametrize(
    ("name", "parts"),
    [("loginHandler", ["login", "handler"]), ("getHTTPSConnection", ["get", "https", "connection"]), ("HTMLParser", ["html", "parser"]), ("get-user_name", ["get", "user", "name"]), ("v2API", ["v", "2", "api"]), ("base64Encode", ["base", "64", "encode"]), ("_private", ["private"]), ("123", ["123"]), ("", [])],
)
def test_split_identifier(spark, name, parts):
    assert one(spark, name, T.split_identifier("x")) == parts


def tokens(text):
    found = re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?=[A-Z][a-z]|\b)|[0-9]+|[^\w\s]|\s+", text)
    n, i = 0, 0
    while i < len(found):
        a, b = found[i], found[i + 1] if i + 1 < len(found) else None
        sign = lambda x: len(x) == 1 and not x.isalnum() and not x.isspace()
        i += 2 if b is not None and ((a.isspace() and not b.isspace()) or (sign(a) and sign(b))) else 1
        n += 1
    return max(n, 1)


@pytest.mark.parametrize("text", ["", " ", "x", "foo(bar): a == b", "Hello, world!!  XMLFile2 café ñ_x 日本 a\n\n b", "HTTPServer ABC1 A_B ::==>>", "\t\t"])
def test_estimated_tokens(spark, text):
    assert one(spark, text, T.estimated_tokens("x")) == tokens(text)


def test_estimated_tokens_of_many(spark):
    rng = random.Random(5)
    signs = ["a", "Bc", "HTTP", "X", "1", "_", "é", "日", " ", "\n", "\t ", "(", ")", ":", "=", "\u0001", "\u0002", "."]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 25))) for _ in range(1500)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string").select("i", T.estimated_tokens("x").alias("n")).collect()
    assert [(texts[r["i"]], r["n"], tokens(texts[r["i"]])) for r in rows if r["n"] != tokens(texts[r["i"]])] == []


@pytest.mark.parametrize(("line", "role"), [("", "blank"), ("   ", "blank"), ("#include <a>", "comment"), ("  // x", "comment"), ("import os", "import"), ("async def f():", "definition"), ('"""doc', "string"), ("x = 1", "code")])
def test_line_role(spark, line, role):
    assert one(spark, line, T.line_role("x")) == role


def test_density_and_paths(spark):
    assert one(spark, "", T.density("x")) == 0
    assert one(spark, "- a\n- b\n  {x}", T.density("x")) > one(spark, "word " * 60, T.density("x"))
    assert one(spark, "src\\a\\b.py", T.under_path("x", "src/a/")) is True
    assert one(spark, "src/ab.py", T.under_path("x", "src/a")) is False
    assert [one(spark, p, T.modality("x")) for p in ("a/b.PY", "c.tar.pdf", "notes.md", "x.unknown", "noext")] == ["code", "pdf", "text", "unknown", "unknown"]
    assert one(spark, None, T.content_hash("x")) is None


def test_proximity(spark):
    close, far, none = "alpha beta", "alpha " + "z" * 2000 + " beta", "gamma"
    p = [one(spark, t, T.proximity("x", ["alpha", "beta"])) for t in (close, far, none, "", None)]
    assert p[0] > p[1] > p[2] == p[3] == p[4] == 0


def test_figures(spark):
    row = spark.createDataFrame([("def f(a, b):\n    # note\n    return self.cache\n",), (None,), ("",)], "x string").select(embedding.figures("x").alias("f"), embedding.spread(embedding.figures("x")).alias("v")).collect()
    assert row[0]["f"]["qual_stateful"] == 1 and len(row[0]["v"]) == 128 and abs(sum(x * x for x in row[0]["v"]) - 1) < 1e-9
    assert row[1]["f"] is None and row[1]["v"] is None and row[2]["f"]["qual_stable"] == 0.5


def test_parsed_vector(spark):
    v = [float(i) for i in range(128)]
    for text in (str(v), '{"vector": %s}' % v, " ".join(map(str, v)), "here:\n```\n%s\n```" % v):
        assert abs(one(spark, text, embedding.parsed_vector("x"))[127] - 127 / sum(x * x for x in v) ** 0.5) < 1e-9
    assert one(spark, "[1, 2]", embedding.parsed_vector("x")) is None


def test_topics_and_one_evaluation(spark):
    texts = ["Datadata data1data 12data édata KEY testspec describe_it( dict.list __env", "", "class_env_env CONFIG-token role\n\n# util", "nothing here"]
    df = spark.createDataFrame([(x,) for x in texts], "x string")
    for row in df.select("x", embedding.figures("x").alias("f")).collect():
        words = re.findall("[a-zA-Z_][a-zA-Z0-9_]*", row["x"].lower())
        for name, told in embedding.TOPICS.items():
            n = sum(t in w for t in told.split() for w in words)
            assert abs(row["f"][name] - min(1.0, n / max(1, len(words)) * 20)) < 1e-9
    given = F.when(F.length("x") == 0, F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: i / 64.0))
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    plan = df.select(embedding.embedded("x", given).alias("v"))._jdf.queryExecution().analyzed().toString()
    spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert plan.count(embedding.SIGNALS["tests"]) == 1
