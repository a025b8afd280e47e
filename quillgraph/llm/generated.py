"""Files that nobody wrote by hand, by thresholds on layout statistics tuned per language.

Statistics of each text: maximum and mean line length, shares of white space, of letters and digits, of digits in
number literals, of long encoded runs, and of lines that carry a long token.  A file is judged by the thresholds of its
language (``LIMITS``; ``tune`` makes them from a labelled sample), other code and structured data by those common to
their kind; prose is never judged, and of files of an unknown kind only the two signs that follow are.  Two signs beside
the layout decide alone, as copies of libraries are laid out like any code: a folder that holds third-party code (whole
path segments only), and a line of the leading comments that declares a generator or a bundled licence (at the start of
the line, so that comments which mention or handle such marks do not count).  ``reasons`` tells which of the three spoke.

Defined results: null, empty and blank texts are no cases; a null path has no folder and no extension, so the language
column decides the kind, as it does for an extension outside the lists; without an extension an unknown kind is taken as
prose, and so is one whose language is a natural one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Extensions and language names by kind.
CODE = "py pyw js jsx mjs cjs ts tsx go java kt scala c cc cpp h hpp cs rs rb php swift sh css cxx hxx hh lua vue svelte scss sass less sql pl pm r dart ex exs erl hs clj groovy ps1".split()
DATA = "json yaml yml toml lock snap xml ini cfg csv sum".split()
PROSE = "md mdx markdown rst txt adoc asciidoc org tex".split()
CODE_NAMES = "python javascript typescript go java kotlin scala c c++ rust ruby php".split()
DATA_NAMES = "json yaml toml text".split()
PROSE_NAMES = "markdown restructuredtext rst asciidoc tex latex".split()

# Folders of third-party code.
THIRD_PARTY = "vendor vendored node_modules bower_components third_party third-party thirdparty 3rdparty site-packages external deps".split()

#: A released script: name and version, among static files.
RELEASED = r"(?:^|/)(?:static|public|assets|dist|www|wwwroot)/(?:.*/)?[a-z][\w.]*(?:-[a-z][\w.]*)*-v?\d+(?:\.\d+)+(?:[.-](?:min|slim|umd|bundle))*\.(?:m?js|css)$"

_COMMENT = r"^\s*(?:/\*+!?|//+!?|#+!?|<!--|--|;+|\"\"\"|\*)?\s*"
_GENERATOR = (
    r"(?:code generated (?:by|from)|auto-?\s?generated (?:by|from|file|code)|@generated\b|<auto-?generated|"
    r"(?:automatically|auto-?) ?(?:created|generated|produced) (?:by|from)|generated (?:by|from)\b|"
    r"this (?:file|code) (?:is|was|has been) (?:automatically |auto-?)?(?:generated|produced|created))"
)
_LICENCE = r"\S+ v?\d+(?:\.\d+)+ \| \(c\) |\S+ v?\d+(?:\.\d+)+ .{0,60}(?:licen[cs]ed? under|released under|all rights reserved)"
_DECLARED = "(?ism)" + _COMMENT + "(?:" + _GENERATOR + "|" + _LICENCE + ")"
#: The comments, blank lines, shebang and build tags that a text begins with (at most 500 of them), and the line after.
_HEAD = r"^(?:\s++|(?:#|//|--|;)[^\n\r]*+|/\*[\s\S]*?\*/|<!--[\s\S]*?-->){0,500}+(?:\"\"\"\s*|/\*|<!--)?[^\n\r]*"

#: Extensions and language names of the languages with thresholds of their own.
LANGUAGES = {
    "python": ("py pyw", "python py python3"), "script": ("js jsx mjs cjs", "javascript js node"), "typescript": ("ts tsx", "typescript ts"), "go": ("go", "go golang"), "java": ("java", "java"),
    "json": ("json", "json"), "yaml": ("yaml yml", "yaml yml"), "toml": ("toml", "toml"), "lock": ("lock snap sum", ""),
}
#: Thresholds by language, as ``tune`` gives the four shares on a sample of hand-written and machine-written texts; "code" and
#: "data" are for the languages without a sample.  mean: mean line length of dense text; thin: white-space share of dense
#: text; figures: digit share of tables; close, digits: white-space and digit share of machine-written listings; encoded:
#: share of long runs; tokens: share of lines with a long token.
LIMITS = {
    "python": {"mean": 198, "thin": 0.125, "figures": 0.306, "close": 0.115, "digits": 0.11, "encoded": 0.708, "tokens": 0.52},
    "script": {"mean": 180, "thin": 0.125, "figures": 0.351, "close": 0.115, "digits": 0.115, "encoded": 0.707, "tokens": 0.521},
    "typescript": {"mean": 175, "thin": 0.12, "figures": 0.304, "close": 0.115, "digits": 0.107, "encoded": 0.67, "tokens": 0.516},
    "go": {"mean": 177, "thin": 0.12, "figures": 0.301, "close": 0.115, "digits": 0.114, "encoded": 0.688, "tokens": 0.512},
    "java": {"mean": 182, "thin": 0.12, "figures": 0.307, "close": 0.115, "digits": 0.11, "encoded": 0.667, "tokens": 0.502},
    "code": {"mean": 190, "thin": 0.12, "figures": 0.30, "close": 0.115, "digits": 0.12, "encoded": 0.70, "tokens": 0.70},
    "json": {"mean": 1e9, "thin": 0.0, "figures": 1.0, "close": 0.0, "digits": 1.0, "encoded": 0.92, "tokens": 0.521},
    "yaml": {"mean": 1e9, "thin": 0.0, "figures": 1.0, "close": 0.0, "digits": 1.0, "encoded": 0.95, "tokens": 0.67},
    "toml": {"mean": 1e9, "thin": 0.0, "figures": 1.0, "close": 0.0, "digits": 1.0, "encoded": 0.93, "tokens": 0.57},
    "lock": {"mean": 1e9, "thin": 0.0, "figures": 1.0, "close": 0.0, "digits": 1.0, "encoded": 0.85, "tokens": 0.50},
    "data": {"mean": 1e9, "thin": 0.0, "figures": 1.0, "close": 0.0, "digits": 1.0, "encoded": 0.92, "tokens": 0.60},
}
#: Documents of a language that ``tune`` looks at, at most.
SAMPLE = 20_000


def layout(df: DataFrame, text: str) -> DataFrame:
    """Adds the layout statistics of ``text``; one pass of built-in expressions."""
    t, n = F.col(text), F.greatest(F.char_length(text), F.lit(1))
    lines = F.split(F.regexp_replace(t, r"\r\n?", "\n"), "\n")
    without = lambda signs: F.char_length(F.translate(t, signs, ""))
    runs = F.char_length(F.regexp_replace(t, r"[A-Za-z0-9+/=_-]{48,}", ""))
    tokens = F.size(F.filter(lines, lambda x: x.rlike(r"[A-Za-z0-9+/=]{28,}")))
    solid = F.greatest(F.size(F.filter(lines, lambda x: F.char_length(F.trim(x)) > 2)), F.lit(1))
    return df.withColumns(
        {
            "max_line": F.array_max(F.transform(lines, lambda x: F.char_length(x))),
            "mean_line": F.char_length(text) / F.size(lines),
            "white": (n - without(" \t\r\n")) / n,
            "alnum": 1 - F.char_length(F.regexp_replace(t, r"[A-Za-z0-9]+", "")) / n,
            "figures": (n - F.char_length(F.regexp_replace(t, r"(?<![A-Za-z_\d])(?:0x[0-9a-fA-F]+|\d+(?:\.\d+)?)", ""))) / n,
            "digits": (n - without("0123456789")) / n,
            "encoded": (n - runs) / n,
            "tokens": tokens / solid,
        }
    )


def kind_of(path: Column, language: Column) -> Column:
    """'code', 'data', 'prose' or 'other' (an extension and a language outside the lists), from the extension, else from the language."""
    ext = F.lower(F.regexp_extract(F.coalesce(path, F.lit("")), r"\.([A-Za-z0-9]+)$", 1))
    name = F.lower(F.trim(F.coalesce(language, F.lit(""))))
    by_name = F.when(name.isin(CODE_NAMES), "code").when(name.isin(DATA_NAMES), "data").when(
        (ext == "") | name.isin(PROSE_NAMES) | name.rlike("^[a-z]{2}(?:[-_][a-z]{2,4})?$"), "prose"
    ).otherwise("other")
    return F.when(ext.isin(CODE), "code").when(ext.isin(DATA), "data").when(ext.isin(PROSE), "prose").otherwise(by_name)


def language_of(path: Column, language: Column) -> Column:
    """The key of ``LIMITS`` for a file, or null: its language, else its kind, if that is judged by layout."""
    ext = F.lower(F.regexp_extract(F.coalesce(path, F.lit("")), r"\.([A-Za-z0-9]+)$", 1))
    name = F.lower(F.trim(F.coalesce(language, F.lit(""))))
    own = F.lit(None).cast("string")
    for key, (extensions, names) in LANGUAGES.items():
        known = [*CODE, *DATA, *PROSE]
        own = F.when(ext.isin(extensions.split()) | (~ext.isin(known) & name.isin(names.split())), key).otherwise(own)
    kind = kind_of(path, language)
    return F.when(kind.isin("code", "data"), F.coalesce(own, kind))


def third_party(path: Column) -> Column:
    """Whether a folder of the path holds third-party code, or the file is a released script (name and version) among static files."""
    p = F.lower(F.coalesce(path, F.lit("")))
    return p.rlike("(?:^|/)(?:" + "|".join(THIRD_PARTY) + ")/") | p.rlike(RELEASED)


def machine_layout(language: Column) -> Column:
    """Whether the layout alone shows that a machine wrote the file; ``language`` is a key of ``LIMITS`` or null."""

    def limit(name: str) -> Column:
        pairs = [F.lit(x) for key, limits in LIMITS.items() for x in (key, float(limits[name]))]
        return F.try_element_at(F.create_map(*pairs), language)

    thin = (F.col("white") < limit("thin")) & ((F.col("digits") > 0.05) | (F.col("white") < 0.6 * limit("thin")))
    dense = (F.col("mean_line") > limit("mean")) & thin
    table = F.col("figures") > limit("figures")
    listing = (F.col("white") < limit("close")) & (F.col("digits") > limit("digits")) & (F.col("encoded") < 0.3) & (F.col("alnum") > 0.4)
    blob = (F.col("encoded") > limit("encoded")) & (F.col("max_line") < 1000)  # rows of it: one long line may stand in a hand-written file
    return F.coalesce(dense | table | listing | blob | (F.col("tokens") > limit("tokens")), F.lit(False))


def _judged(df: DataFrame, text: str, path: str, language: str) -> DataFrame:
    """(_row, _layout, _folder, _declared) of the texts that may be cases; the columns of ``df`` are kept apart, so names may clash."""
    rows = df.where(F.col(text).rlike(r"(?U)\S")).select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"),
        F.col(text).alias("_text"),
        kind_of(F.col(path), F.col(language)).alias("_kind"),
        language_of(F.col(path), F.col(language)).alias("_key"),
        third_party(F.col(path)).alias("_folder"),
        F.coalesce(F.regexp_extract(text, _HEAD, 0).rlike(_DECLARED), F.lit(False)).alias("_declared"),
    )
    return layout(rows.where(F.col("_kind") != "prose"), "_text").select("_row", machine_layout(F.col("_key")).alias("_layout"), "_folder", "_declared")


def not_hand_written(df: DataFrame, text: str = "text", path: str = "document_path", language: str = "lang") -> DataFrame:
    """The rows of ``df`` that are, as a whole, generated, minified, third-party, locked, recorded, or data saved as code."""
    return _judged(df, text, path, language).where("_layout OR _folder OR _declared").select("_row.*")


def reasons(df: DataFrame, id_col: str, text: str = "text", path: str = "document_path", language: str = "lang") -> DataFrame:
    """(id, by_layout, by_folder, by_declaration) of the same rows: what speaks for each."""
    found = _judged(df, text, path, language).where("_layout OR _folder OR _declared")
    return found.select(F.col(f"_row.{id_col}").alias(id_col), F.col("_layout").alias("by_layout"), F.col("_folder").alias("by_folder"), F.col("_declared").alias("by_declaration"))


def tune(df: DataFrame, case_col: str, text: str = "text", path: str = "document_path", language: str = "lang", sample: int = SAMPLE) -> dict[str, dict[str, float]]:
    """Thresholds by language from labelled texts: for each share, the middle of the widest gap that lies beyond all hand-written texts, among the values of the cases.

    For the share of digits it is the nearest gap, as tables, which have the most, are told by their figures.
    Looks at no more than ``sample`` texts of a language.  A language without texts of both kinds, and a share that parts
    none, keep what ``LIMITS`` says.
    """
    rows = layout(df.select(F.col(text).alias("_t"), F.col(case_col).alias("_case"), language_of(F.col(path), F.col(language)).alias("_key")).where("_key IS NOT NULL AND _t IS NOT NULL"), "_t")
    few = rows.withColumn("_r", F.row_number().over(Window.partitionBy("_key").orderBy(F.xxhash64("_t")))).where(F.col("_r") <= sample)
    shares = [F.struct(F.lit(c).alias("share"), F.round(c, 3).alias("value")) for c in ("figures", "digits", "encoded", "tokens")]
    flat = few.select("_key", "_case", F.explode(F.array(*shares)).alias("s")).groupBy("_key", "s.share")
    # values of three places between 0 and 1, so a list holds a thousand at most
    found = flat.agg(F.max(F.when(~F.col("_case"), F.col("s.value"))).alias("most"), F.sort_array(F.collect_set(F.when(F.col("_case"), F.col("s.value")))).alias("cases"))
    out = {k: dict(v) for k, v in LIMITS.items()}
    for r in found.where("most IS NOT NULL").collect():
        steps = [r["most"], *(x for x in r["cases"] if x > r["most"])]
        if len(steps) > 1 and LIMITS[r["_key"]][r["share"]] < 1:
            gaps = list(zip(steps, steps[1:], strict=False))
            low, high = gaps[0] if r["share"] == "digits" else max(gaps, key=lambda g: g[1] - g[0])
            out[r["_key"]][r["share"]] = round((low + high) / 2, 3)
    return out
