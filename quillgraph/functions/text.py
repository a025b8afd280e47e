"""Scalar text functions as column expressions.

None of them runs Python.  Loop-invariant parts stay outside lambdas, and a value that is used many times is bound once
by ``let``.  Where a pattern speaks of word signs it spells out the Unicode classes, as the engines differ on ``\\w``.
A null text gives null unless a function says otherwise.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_SIGN = r"\p{L}\p{N}_"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def content_hash(text: Column | str) -> Column:
    """SHA-256 of the UTF-8 text in hex."""
    return F.sha2(col(text), 256)


def chunk_id(path: Column | str, start: Column | str, end: Column | str, text: Column | str) -> Column:
    """32 hex digits that name a chunk by its path, place and content."""
    tail = F.substring(content_hash(text), 1, 16)
    return F.substring(F.sha2(F.concat_ws(":", col(path), col(start).cast("string"), col(end).cast("string"), tail), 256), 1, 32)


def identifiers(text: Column | str) -> Column:
    """The words of the text that are ASCII identifiers (runs of word signs of any script that have only ASCII ones)."""
    return F.regexp_extract_all(col(text), F.lit(f"(?<![{WORD_SIGN}])[a-zA-Z_][a-zA-Z0-9_]*+(?![{WORD_SIGN}])"), F.lit(0))


def split_identifier(name: Column | str) -> Column:
    """The lower-case parts of a camelCase, PascalCase, snake_case or kebab-case name; digits are parts of their own."""
    spaced = F.regexp_replace(F.trim(col(name)), r"[_\-]+", " ")
    for pattern in (r"([A-Z])([A-Z][a-z])", r"([a-z])([A-Z])", r"([A-Za-z])([0-9])", r"([0-9])([A-Za-z])"):
        spaced = F.regexp_replace(spaced, pattern, "$1 $2")
    parts = F.filter(F.split(F.lower(spaced), " +"), lambda p: p != "")
    return F.when(col(name).rlike("^[a-z]+$"), F.array(col(name))).otherwise(parts)  # most words are one part


_IDENTIFIER = re.compile(r"\b[a-zA-Z_][a-zA-Z0-9_]*\b")
_CASES = [re.compile(p) for p in (r"([A-Z])([A-Z][a-z])", r"([a-z])([A-Z])", r"([A-Za-z])([0-9])", r"([0-9])([A-Za-z])")]


def identifier_list(text: str) -> list[str]:
    """``identifiers`` of one value, such as a query."""
    return _IDENTIFIER.findall(text)


def identifier_parts(name: str) -> list[str]:
    """``split_identifier`` of one value."""
    spaced = re.sub(r"[_\-]+", " ", name.strip())
    for pattern in _CASES:
        spaced = pattern.sub(r"\1 \2", spaced)
    return spaced.lower().split()


def estimated_tokens(text: Column | str) -> Column:
    """An estimate of a text's BPE tokens: pieces of a fixed pattern, less the pairs that BPE usually joins.

    A blank piece joins the piece after it and a punctuation sign the sign after it, from left to right and each piece
    once.  The text is rewritten with one sign a piece (word, blank, punctuation); the joined pairs are then the
    leftmost matches of one pattern, so the whole needs no array and no fold.
    """
    word, blank, sign = "\u0001", "\u0002", "\u0003"
    kinds = F.translate(col(text), word + blank + sign, "!!!")
    kinds = F.regexp_replace(kinds, rf"[A-Z]?[a-z]+|[A-Z]+(?=[A-Z][a-z]|[^{WORD_SIGN}]|$)|[0-9]+", word)
    kinds = F.regexp_replace(kinds, r"(?U)[\s\x1c-\x1f]+", blank)
    kinds = F.regexp_replace(kinds, f"[{WORD_SIGN}]+", "")  # what the pattern passes over
    kinds = F.regexp_replace(kinds, f"[^{word}{blank}]", sign)
    return F.greatest(F.lit(1), F.char_length(F.regexp_replace(kinds, f"{blank}[{word}{sign}]|{sign}{sign}", sign))).cast("long")


_PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?=[A-Z][a-z]|\b)|[0-9]+|[^\w\s]|\s+")


def token_estimate(text: str) -> int:
    """``estimated_tokens`` of one value, for steps that run in Arrow batches."""
    kinds = "".join(["b" if x[0].isspace() else "w" if x[0].isalnum() else "s" for x in _PIECE.findall(text)])
    return max(1, len(re.sub("b[ws]|ss", "x", kinds)))


def density(text: Column | str) -> Column:
    """0 for sparse prose to 1 for dense code and lists: short lines, special signs, indentation and list marks."""
    t = col(text)
    special = F.char_length(t) - F.char_length(F.translate(t, "{}[]()<>:=|&%$#@!~`", ""))

    def scored(lines: Column) -> Column:
        n, length = F.size(lines), F.char_length(t)
        # an indented line and a list mark may be the same line; each counts
        marked = F.filter(lines, lambda x: x.rlike(r"^\s*(?:[-*•]|[0-9]+[.)])\s"))
        indented = F.filter(lines, lambda x: x.rlike("^[ \t]"))
        short = F.greatest(F.lit(0.0), 1 - (length - (n - 1)) / n / 80.0)
        return 0.3 * short + 0.3 * F.least(F.lit(1.0), special / F.greatest(length, F.lit(1)) * 10) + 0.2 * F.size(indented) / n + 0.2 * F.size(marked) / n

    score = let(F.split(t, "\n"), scored)
    return F.when(t == "", F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)))


# How a line of source begins, by its role.  The order decides ("#include" counts as a comment).
COMMENT_STARTS = ("#", "//", "--", ";", "%", "/*", "* ", "///", "/**")
IMPORT_STARTS = ("import ", "from ", "require(", "use ", "include ", "#include", "using ", "extern crate ")
DEFINITION_STARTS = ("def ", "async def ", "class ", "function ", "async function ", "fn ", "pub fn ", "func ", "type ", "interface ", "struct ", "enum ", "trait ", "impl ")
STRING_STARTS = ('"""', "'''", 'r"""', "r'''")


def line_role(line: Column | str) -> Column:
    """blank, comment, import, definition, string or code."""
    bare = F.regexp_replace(col(line), r"^\s+", "")

    def begins(starts: tuple[str, ...]) -> Column:
        found = F.lit(False)
        for s in starts:
            found = found | F.startswith(bare, F.lit(s))
        return found

    return (
        F.when(bare == "", "blank")
        .when(begins(COMMENT_STARTS), "comment")
        .when(begins(IMPORT_STARTS), "import")
        .when(begins(DEFINITION_STARTS), "definition")
        .when(begins(STRING_STARTS), "string")
        .otherwise("code")
    )


def one_line(text: Column | str) -> Column:
    """The text with every run of white space as one blank and none at the ends."""
    return F.trim(F.regexp_replace(col(text), r"\s+", " "))


def shortened(text: Column | str, most: int) -> Column:
    """At most ``most`` signs; a cut text ends in three dots."""
    t = col(text)
    return F.when(F.char_length(t) <= most, t).otherwise(F.concat(F.substring(t, 1, most - 3), F.lit("...")))


def under_path(path: Column | str, prefix: str | None) -> Column:
    """Whether the path is the prefix or lies under it (whole segments)."""
    if not prefix:
        return F.lit(True)
    p = F.replace(col(path), F.lit("\\"), F.lit("/"))
    bare = prefix.replace("\\", "/").rstrip("/")
    return (p == bare) | F.startswith(p, F.lit(bare + "/"))


def proximity(text: Column | str, terms: list[str]) -> Column:
    """How early and how close together the terms first occur in the text, 0 to 1.

    Four tenths for the share of terms present (weighted by length, eight signs count full), three tenths each for an
    early first occurrence and for a small distance between first occurrences (a thousand signs count as far).
    A null or empty text, or one without any of the terms, has 0.
    """
    if not terms:
        return F.lit(0.0)
    weights = [min(len(t) / 8.0, 1.0) for t in terms]
    t = col(text)

    def score(low: Column) -> Column:
        at = F.array(*[F.instr(low, x) - 1 for x in terms])
        found = F.filter(at, lambda p: p >= 0)
        present = F.aggregate(F.zip_with(at, F.array(*map(F.lit, weights)), lambda p, w: F.when(p >= 0, w).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x)
        first = 1 - F.least(F.array_min(found) / F.greatest(F.char_length(t), F.lit(1)), F.lit(1.0))
        near = 1 - F.least((F.array_max(found) - F.array_min(found)) / 1000.0, F.lit(1.0))
        return F.when(F.size(found) == 0, F.lit(0.0)).otherwise(0.4 * present / max(sum(weights), 1.0) + 0.3 * first + 0.3 * near)

    return F.coalesce(F.when(t == "", F.lit(0.0)).otherwise(let(F.lower(t), score)), F.lit(0.0))


def extension(path: Column | str) -> Column:
    """The file name's extension in lower case with its dot, or the empty string."""
    return F.lower(F.regexp_extract(col(path), r"[^/.][^/]*(\.[^/.]+)$", 1))


# Extensions by modality.
CODE_EXTENSIONS = ".py .pyw .pyx .js .jsx .mjs .cjs .ts .tsx .java .kt .scala .c .h .cpp .cc .hpp .cs .go .rs .rb .php .swift .sh .bash .zsh .sql .html .css .scss .less".split()
OTHER_EXTENSIONS = {
    "image": ".png .jpg .jpeg .gif .bmp .webp .tiff .svg".split(),
    "pdf": [".pdf"],
    "audio": ".mp3 .wav .flac .ogg .m4a .aac".split(),
    "video": ".mp4 .avi .mov .mkv .webm".split(),
    "text": ".txt .md .rst .log .csv .json .yaml .yml .toml .xml .ini .cfg".split(),
}


def modality(path: Column | str) -> Column:
    """code, image, pdf, audio, video, text or unknown, by the extension."""
    ext = extension(path)
    out = F.when(ext.isin(CODE_EXTENSIONS), "code")
    for name, known in OTHER_EXTENSIONS.items():
        out = out.when(ext.isin(known), name)
    return out.otherwise("unknown")
