import random

import duckdb
from pyspark.sql import functions as F

from quillgraph.operators import extraction
from quillgraph.operators import symbols as S
from quillgraph.plans.graph import GRAPH

SCHEMA = "id long, name string, kind string, role string, chunk_id string, document_path string, line_number long, container string"


def table(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA)


def d(name, chunk, path, container=None, kind="function"):
    return (name, kind, "definition", chunk, path, 1, container)


def r(name, chunk, path, container=None, kind="function"):
    return (name, kind, " Reference", chunk, path, 1, container)


def edges(df):
    return {(x["source_chunk_id"], x["target_chunk_id"], x["edge_type"], x["symbol_name"]) for x in df.collect()}


def test_resolution(spark):
    s = table(
        spark,
        [
            d("core", "b", "/p/base.py"), d("core", "o", "/p/other.py"), r("core", "m", "/p/mid.py"), r("base", "m", "/p/mid.py", kind="module"), d("middle", "m", "/p/mid.py"),
            r("middle", "t", "/p/top.py"), r("print", "t", "/p/top.py"), d("print", "b", "/p/base.py"), r("x", "t", "/p/top.py"), r("js/main.js", "h", "/p/index.html", kind="module"),
            d("boot", "j", "/p/js/main.js"), d("save", "u1", "/p/u.py", "User"), d("save", "u2", "/p/v.py", "Pet"), r("save", "u3", "/p/w.py", "Pet"), r("core", "b", "/p/base.py"),
            (None, "function", "reference", "t", "/p/top.py", 1, None),
        ],
    )
    assert edges(S.resolve(s)) == {("m", "b", "cross_file", "core"), ("m", "b", "cross_file", "base"), ("t", "m", "cross_file", "middle"), ("h", "j", "cross_file", "js/main.js"), ("u3", "u2", "cross_file", "save"), ("b", "o", "cross_file", "core")}
    deps = {(x["source_path"], x["target_path"]) for x in S.file_dependencies(s).collect()}
    assert deps == {("/p/mid.py", "/p/base.py"), ("/p/index.html", "/p/js/main.js")}


def test_reach_and_staleness(spark):
    e = spark.createDataFrame([("mid", "base", "cross_file", "core"), ("top", "mid", "cross_file", "middle"), ("base", "top", "cross_file", "loop"), ("z1", "top", "x", "y")], "source_chunk_id string, target_chunk_id string, edge_type string, symbol_name string")
    seed = spark.createDataFrame([("base",)], "chunk_id string")
    assert {(x["chunk_id"], x["hop"]) for x in S.reach(e, seed, 2).collect()} == {("base", 0), ("mid", 1), ("top", 2)}
    stale = {x["chunk_id"]: round(x["staleness"], 4) for x in S.staleness(e, seed).collect()}
    assert stale == {"base": 0, "mid": 0.8, "top": 0.64, "z1": 0.512}
    assert S.reach(e, seed.where("false"), 2).count() == 0


def test_test_edges(spark):
    s = table(spark, [d("a", "1", "src/foo.py"), d("b", "2", "src/test_foo.py"), d("c", "3", "pkg/foo_test.py"), d("e", "4", "tests/foo.py"), d("f", "5", "src/bar.py")])
    assert {(x["source_chunk_id"], x["target_chunk_id"]) for x in S.test_edges(s).collect()} == {("2", "1"), ("3", "1"), ("4", "1")}


def test_coupling(spark):
    s = table(spark, [d("alpha", "a", "A"), d("beta", "b", "B"), r("alpha", "b", "B"), r("beta", "a", "A"), r("alpha", "c", "C"), r("beta", "c", "C")])
    e = S.resolve(s)
    paths = s.groupBy("chunk_id").agg({"document_path": "min"}).toDF("chunk_id", "document_path")
    got = {x["path"]: (x["direction"], x["edges"], x["names"], x["weight"]) for x in S.coupling(e, paths, s, "A").collect()}
    assert got == {"B": ("bidirectional", 2, 2, 2.0), "C": ("depended_on_by", 1, 1, 1.0)}
    co = {x["path"]: (x["consumers"], x["names"], x["score"]) for x in S.co_consumers(e, paths, s, "A").collect()}
    assert co == {"B": (1, 1, 1.5)}


def test_dynamic_and_significance(spark):
    s = table(spark, [d("f", "a", "A"), r("f", "b", "B")])
    reg = spark.createDataFrame([("me", "hook", None, "definition", "A", 1), ("me", "hook", "function", "definition", "A", 2), ("me", "", "x", "definition", "A", 1), ("you", "h2", "x", "caller", "A", None)], "agent_id string, name string, kind string, role string, document_path string, line_number int")
    more, errors = S.with_dynamic(s, reg)
    assert errors.count() == 2 and {x["chunk_id"] for x in S.dynamic(more).collect()} == {"runtime:me:hook"} and S.dynamic(more, "you").count() == 0
    assert S.without_dynamic(more, "me").count() == 2 and more.count() == 3
    assert [x["ok"] for x in spark.createDataFrame([("print",), ("fold_it",)], "n string").select(S.significant(F.col("n"), 1.0, ["zz"]).alias("ok")).collect()] == [False, True]


def test_rebuilt(spark):
    before = table(spark, [d("f", "a", "A"), r("f", "b", "B"), d("g", "c", "C"), r("g", "b", "B"), r("A", "b", "B", kind="module")])
    after = table(spark, [d("f", "x", "A2"), r("f", "b", "B"), d("g", "c", "C"), r("g", "b", "B"), r("g", "x", "A2"), r("A", "b", "B", kind="module")])
    changed = spark.createDataFrame([("a",), ("x",)], "chunk_id string")
    assert edges(S.rebuilt(S.resolve(before), after, changed)) == edges(S.resolve(after))


def names(spark, path, text):
    df = spark.createDataFrame([("d", text, path), ("n", None, path)], "id string, t string, p string")
    return {(x["name"], x["kind"], x["role"], x["line_number"], x["container"]) for x in extraction.extract(df, "id", "t", "p").collect()}


def test_extraction_by_line(spark):
    go = names(spark, "a.go", 'import (\n  "net/http"\n)\nfunc (s *S) Run(x int) {\ntype T struct {\n')
    assert go == {("net/http", "module", "reference", 2, None), ("Run", "function", "definition", 4, None), ("T", "class", "definition", 5, None)}
    java = names(spark, "A.java", "import a.b.C;\npublic class A {\n  public int get(int x) {\n    return x;\n")
    assert {("a.b.C", "module", "reference", 1, None), ("C", "import", "reference", 1, None), ("A", "class", "definition", 2, None), ("get", "function", "definition", 3, None)} == java
    rust = names(spark, "a.rs", "use std::fmt::Display;\npub async fn go() {}\nimpl<T> Foo for T {}\n")
    assert {("std::fmt::Display", "module", "reference", 1, None), ("Display", "import", "reference", 1, None), ("go", "function", "definition", 2, None), ("Foo", "class", "reference", 3, None)} == rust


def test_extraction_markup(spark):
    html = names(spark, "a.html", '<div class="a b" id="c"><script defer src="/x.js"></script><link rel=x href="s.css"><a href="t.css" onclick="go(1)">')
    assert html == {(".a", "css_class", "reference", None, None), (".b", "css_class", "reference", None, None), ("#c", "css_id", "reference", None, None), ("/x.js", "module", "reference", None, None), ("s.css", "module", "reference", None, None), ("go", "function", "reference", None, None)}
    css = names(spark, "a.css", '/* .no { } */ .yes { } #id, x { background: url("y.png") } @import "z.css";')
    assert {(n, k) for n, k, *_ in css} >= {(".yes", "css_class"), ("#id", "css_id"), ("y.png", "module"), ("z.css", "module")} and all(n != ".no" for n, *_ in css)


def test_extraction_parsed(spark):
    py = names(spark, "a.py", "import os\nfrom x.y import z\nclass A:\n    def f(self):\n        return z(self.g(q))\n")
    assert {("os", "module", "reference", 1, None), ("x.y", "module", "reference", 2, None), ("z", "import", "reference", 2, None), ("A", "class", "definition", 3, None), ("f", "function", "definition", 4, "A"), ("z", "function", "reference", 5, "A.f"), ("g", "function", "reference", 5, "A.f"), ("q", "name", "reference", 5, "A.f"), ("self", "name", "reference", 5, "A.f")} == py
    broken = names(spark, "a.py", "def f(:\nimport os\n")
    assert broken == {("f", "function", "definition", 1, None), ("os", "module", "reference", 2, None)}
    js = names(spark, "a.js", "import { a } from './m'\nclass K {\n  run(x) {\n    return new Q( helper(x))\n  }\n}\nconst v = {\n  k: 1\n}\ndocument.querySelector('.c#d')\n")
    assert {("./m", "module", "reference", 1, None), ("a", "import", "reference", 1, None), ("K", "class", "definition", 2, None), ("run", "function", "definition", 3, "K"), ("helper", "function", "reference", 4, "K.run"), ("Q", "class", "reference", 4, "K.run"), ("v", "variable", "definition", 7, None), (".c", "css_class", "reference", 10, None), ("#d", "css_id", "reference", 10, None)} <= js


def script(spark, text, path="a.js"):
    from quillgraph.operators.scripts import script_symbols

    return set(script_symbols(text))


def test_scripts(spark):
    has = lambda text, *wanted: {(n, k, r) for n, k, r, *_ in script(spark, text)} >= set(wanted)
    d, r = "definition", "reference"
    assert has("function handleClick() {}", ("handleClick", "function", d)) and has("export class Component {}", ("Component", "class", d))
    assert has("const API_URL = 'http://x'", ("API_URL", "variable", d)) and has("export interface Config {}", ("Config", "class", d))
    assert has("const express = require('express')", ("express", "module", r)) and not has("const q = require('express')", ("q", "import", r))
    assert has("const q = require('./q')", ("q", "import", r), ("./q", "module", r)) and has("const { a, b } = require('./m')", ("a", "import", r), ("b", "import", r), ("./m", "module", r))
    assert has("const e = new Engine();", ("Engine", "class", r), ("e", "variable", d)) and has("x.compute(a, b);", ("compute", "function", r))
    assert len([x for x in script(spark, "x.compute(a, b);") if x[0] == "compute"]) == 1
    assert has("if (c) { return foo(); }", ("foo", "function", r)) and not {"if", "return"} & {x[0] for x in script(spark, "if (c) { return foo(); }")}
    assert has("const A = B;", ("A", "variable", d), ("B", "variable", r)) and not has("const X = X;", ("X", "variable", r))
    assert has("module.exports = {\n  Dyn,\n  Nav: Service,\n  ...require('./utils'),\n};", ("Dyn", "variable", r), ("Nav", "variable", d), ("Service", "variable", r), ("./utils", "module", r))
    assert has("module.exports = new Thing()", ("Thing", "class", d)) and has("el.classList.add('active on')", (".active", "css_class", r), (".on", "css_class", r))
    assert has("document.getElementById('nav')", ("#nav", "css_id", r)) and has("import {\n  a,\n  b as c\n} from 'y'", ("y", "module", r), ("a", "import", r), ("c", "import", r))


def test_scripts_read_no_strings(spark):
    text = "// call(x)\n/* new Q() */\nconst s = 'run(1) class K {';\nconst t = `go(${1})`;\nconst re = /['\"](/;\nfunction f(a = {}) {\n  const o = { k() { return g(); } };\n}\nh();\n"
    got = script(spark, text)
    assert {n for n, *_ in got} == {"s", "t", "re", "f", "o", "k", "g", "h"}
    where = {(n, line, c) for n, _, _, line, c in got}
    assert {("f", 6, None), ("o", 7, "f"), ("k", 7, "f"), ("g", 7, "f.k"), ("h", 9, None)} <= where
    assert script(spark, "class A {\n  run(x) {\n    if (x) { this.go(); }\n  }\n}\n") >= {("run", "function", "definition", 2, "A"), ("go", "function", "reference", 3, "A.run")}
    assert script(spark, "}}} ((( ]] '") == set()


def test_edges_come_out_distinct(spark):
    """Against the SQL, on rows of few names, containers and files; nothing is made distinct after the pairs are met."""
    rng = random.Random(7)
    pick = lambda *x: rng.choice(x)
    rows = []
    for _ in range(1200):
        chunk = f"c{rng.randrange(60)}"
        path = f"p/f{int(chunk[1:]) // 3}.py" if rng.random() < 0.9 else f"p/f{rng.randrange(20)}.py"
        if rng.random() < 0.03:
            rows.append((f"p.f{rng.randrange(24)}", "module", "reference", chunk, path, 1, None))
        else:
            rows.append((f"name{rng.randrange(rng.choice((3, 40)))}", "function", pick("definition", "reference"), chunk, path, 1, pick(None, None, "", "A", "B", "C")))
    s = table(spark, rows)
    got = S.resolve(s)
    con = duckdb.connect()
    con.register("symbols", s.toArrow())
    expected = con.execute(f"WITH {GRAPH} SELECT * FROM edges").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(expected) and len(expected) > 4000
    assert got._jdf.queryExecution().optimizedPlan().nodeName() == "Union"
