"""The 32 named figures of a text and the 128-number vector spread from them; all column expressions.

A null text has null figures.  Words are the identifiers of the lower-case text; a line counts as code if it is neither
blank nor begins with # or //.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillgraph.functions.text import col, let

# The words of each topic (a word counts for each of them that it contains).
TOPICS = {
    "topic_data": "data parse query sql db record schema cache dict list array obj",
    "topic_web": "http request response url api route server fetch client endpoint",
    "topic_ui": "render component style css dom element button display html view layout",
    "topic_logic": "validate check transform filter sort compute logic rule parse convert",
    "topic_test": "test mock assert expect spec describe it( coverage suite case",
    "topic_config": "config env flag option setting arg param default yaml toml ini",
    "topic_auth": "auth token session permission role user login jwt password secret",
    "topic_util": "util helper format escape copy merge deep uuid tool common",
}
# Signs that decide a quality by being there.
TYPED = [": int", ": str", ": bool", "interface", "type ", " TypedDict"]
IMPURE = ["global", "nonlocal", "setattr", "del "]
STATEFUL = ["self.", "this.", ".state", "_state", ".cache"]
OLD = ["deprecated", "__old", "legacy"]
# What is counted for a signal.
SIGNALS = {
    "imports": r"(?:import|from|require|include)\s",
    "exports": r"(?:export|module\.exports|pub\s+fn|public\s+def)",
    "functions": r"(?:def\s|function\s|fn\s|proc\s)",
    "classes": r"(?:class\s|struct\s|interface\s)",
    "tests": r"(?:describe\(|it\(|test\(|expect\(|assert |def test_)",
    "errors": r"(?:raise|throw|except|catch|Error|error:|fail)",
    "comments": r"""(?:#|//|/\*|\*/|'''|\"{3})""",
    "strings": r"""['"][^'"]*['"]""",
}
WIDTH, SPREAD = 4, 1.2


def _telling() -> str:
    """A pattern of what remains of a word from the first topic word in it on: all topic words that the word contains are there.

    Topic words are grouped by their first letter.  One with a sign that no word has is in none.
    """
    heads: dict[str, list[str]] = {}
    for x in sorted({x for list_ in TOPICS.values() for x in list_.split() if x.isalnum()}):
        heads.setdefault(x[0], []).append(x[1:])
    return "(?:" + "|".join(f"{h}(?:{'|'.join(rest)})" for h, rest in heads.items()) + ")[a-zA-Z0-9_]*+"


TELLING = _telling()


def _within(c: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))


def _any(text: Column, signs: list[str]) -> Column:
    found = F.lit(False)
    for s in signs:
        found = found | F.contains(text, F.lit(s))
    return found


def figures(text: Column | str) -> Column:
    """A struct of the 32 figures, each between -1 and 1, in order."""
    t = col(text)
    words = F.regexp_count(F.lower(t), F.lit("[a-zA-Z_][a-zA-Z0-9_]*+"))
    told = F.regexp_extract_all(F.lower(t), F.lit(TELLING), F.lit(0))
    lines = F.filter(F.split(t, r"\r\n|[\n\r]"), lambda x: x.rlike(r"(?U)\S"))
    code = F.size(F.filter(lines, lambda x: ~x.rlike(r"(?U)^\s*(?:#|//)")))
    indent = F.array_max(F.transform(lines, lambda x: F.char_length(F.regexp_extract(x, r"(?U)^\s*", 0))))
    hits = let(told, lambda w: F.struct(*[F.aggregate(w, F.lit(0), _adding(list_.split())).cast("double").alias(name) for name, list_ in TOPICS.items()]))
    counts = F.struct(
        words.cast("double").alias("words"),
        code.cast("double").alias("code"),
        F.coalesce(indent, F.lit(0)).cast("double").alias("indent"),
        F.regexp_count(t, F.lit(",")).cast("double").alias("commas"),
        hits.alias("topics"),
        *[F.regexp_count(t, F.lit(p)).cast("double").alias(n) for n, p in SIGNALS.items()],
    )

    def named(c: Column) -> Column:
        n = F.greatest(F.lit(1.0), c["code"])
        f, k = c["functions"], c["comments"]
        out = {name: _within(c["topics"][name] / F.greatest(F.lit(1.0), c["words"]) * 20) for name in TOPICS}
        out |= {
            "qual_abstract": _within(c["words"] / 100 - 0.5),
            "qual_size": _within(c["code"] / 50 - 1),
            "qual_stable": F.lit(0.5),
            "qual_legacy": F.when(_any(t, OLD), -0.5).otherwise(0.0),
            "qual_typed": F.when(_any(t, TYPED), 1.0).otherwise(-1.0),
            "qual_pure": F.when(_any(t, IMPURE), -0.5).otherwise(1.0),
            "qual_stateful": F.when(_any(t, STATEFUL), 1.0).otherwise(-1.0),
            "qual_async": F.when(_any(t, ["async ", "await "]), 1.0).otherwise(-1.0),
            "sig_imports": _within(c["imports"] / n * 10),
            "sig_exports": _within(c["exports"] / n * 10),
            "sig_functions": _within(f / n * 5 - 1),
            "sig_classes": _within(c["classes"] / n * 5 - 1),
            "sig_tests": _within(c["tests"] / n * 10),
            "sig_errors": _within(c["errors"] / n * 5 - 1),
            "sig_comments": _within(k / n * 10 - 2),
            "sig_strings": _within(c["strings"] / n * 5 - 2),
            "ctx_depth": _within(c["indent"] / 20 - 0.5),
            "ctx_arity": _within(c["commas"] / F.greatest(F.lit(1.0), f) / 3 - 0.5),
            "ctx_scope": _within(c["words"] / 200 - 0.5),
            "ctx_coupling": _within(c["imports"] / 10 - 0.5),
            "ctx_cohesion": F.lit(0.5),
            "ctx_coverage": F.lit(0.0),
            "ctx_doc": _within(k / F.greatest(F.lit(1.0), f + c["classes"]) - 1),
            "ctx_maintain": _within(k / n * 5 - 1),
        }
        return F.struct(*[v.alias(name) for name, v in out.items()])

    return F.when(t.isNotNull(), let(counts, named))


def _adding(words: list[str]):  # noqa: ANN202
    def add(total: Column, w: Column) -> Column:
        for x in words:
            total = total + F.contains(w, F.lit(x)).cast("int")
        return total

    return add


FIGURES = [*TOPICS, *"qual_abstract qual_size qual_stable qual_legacy qual_typed qual_pure qual_stateful qual_async sig_imports sig_exports sig_functions sig_classes sig_tests sig_errors sig_comments sig_strings ctx_depth ctx_arity ctx_scope ctx_coupling ctx_cohesion ctx_coverage ctx_doc ctx_maintain".split()]


def unit(v: Column) -> Column:
    """The array scaled to length 1; zeros stay."""
    return let(v, lambda x: let(F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, y: s + y * y)), lambda n: F.when(n > 0, F.transform(x, lambda y: y / n)).otherwise(x)))


def spread(named: Column) -> Column:
    """The 128-number unit vector of a struct of figures: each moved to 0..1 and faded over four places."""
    fade = [math.exp(-(o**2) / (2 * SPREAD**2)) for o in range(WIDTH)]
    faded = lambda n: F.flatten(F.transform(F.array(*[n[f] for f in FIGURES]), lambda v: F.array(*[(v + 1) / 2 * w for w in fade])))
    return let(named, lambda n: F.when(n.isNotNull(), unit(faded(n))))


#: What of a text an embedding by its figures looks at; part of what it is.
EMBEDDED = 4000


def embedded(text: Column | str, values: Column | None = None) -> Column:
    """The vector of given figures (an array of 32 numbers between -1 and 1), or of the figures of the text's beginning.

    Given figures of another number, or with a null among them, give a null vector.
    """
    own = spread(figures(F.substring(col(text), 1, EMBEDDED)))
    if values is None:
        return own
    fine = (F.size(values) == len(FIGURES)) & ~F.exists(values, lambda x: x.isNull())
    given = let(values, lambda v: F.struct(*[v[i].cast("double").alias(n) for i, n in enumerate(FIGURES)]))
    return F.when(values.isNull(), own).when(fine, spread(given))


def parsed_vector(output: Column | str, dim: int = 128) -> Column:
    """A vector of ``dim`` numbers given as text, scaled to length 1; null if there is none.

    Tried in turn: a JSON array, a JSON object with ``vector``, numbers between blanks, the first long bracketed list.
    """
    o = F.trim(col(output))
    listed = F.from_json(o, "array<double>")
    held = F.from_json(o, "struct<vector:array<double>>")["vector"]
    loose = F.transform(F.slice(F.split(o, r"\s+"), 1, dim), lambda x: x.try_cast("double"))
    block = F.from_json(F.concat(F.lit("["), F.regexp_extract(o, r"(?s)\[\s*([^\]]{200,})\]", 1), F.lit("]")), "array<double>")
    ok = lambda v: F.when((F.size(v) == dim) & ~F.exists(v, lambda x: x.isNull()), v)
    return unit(F.coalesce(ok(listed), ok(held), ok(loose), ok(block)))
