"""Chunkers: one text in, its chunks out, in one pass and without a shuffle.

The pieces of a text (paragraphs, definitions, line groups, sentences) and their sizes are found by expressions inside the
JVM.  Dealing pieces into runs depends on what the run holds so far, so it is done over the sizes in Arrow batches, where
the text of a run is put together too.  A text's chunks come from its own row, so no text is brought together with others.

Defined results: a text without content (null, empty, blank) gives one empty chunk at 0; a null id is left out; a repeated
row gives its chunks again; positions are code points.  Results have doc (the text's id), chunk_index, content, start_pos,
end_pos.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import text as T

SIZE, MOST = 256, 4096
_CHUNK = ("doc", "chunk_index", "content", "start_pos", "end_pos")
Placed = tuple[str, int, int]


def dealt(sizes: list[int], limits: list[int]) -> list[int]:
    """Where runs of pieces begin: a piece opens a run if it would push the open one beyond the piece's own limit."""
    starts, total = [], 0
    for i, (n, limit) in enumerate(zip(sizes, limits, strict=True)):
        if not starts or total + n > limit:
            starts.append(i)
            total = 0
        total += n
    return starts


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _rows(owner: list[int], placed: list[Placed], index: list[int], ids: pa.Array) -> pa.RecordBatch:
    content, start, end = zip(*placed, strict=True) if placed else ((), (), ())
    cols = [ids.take(pa.array(owner, pa.int64())), pa.array(index, pa.int64()), pa.array(content, pa.string()), pa.array(start, pa.int64()), pa.array(end, pa.int64())]
    return pa.RecordBatch.from_arrays(cols, list(_CHUNK))


def _per_text(pieces: DataFrame, chunks_of) -> DataFrame:  # noqa: ANN001
    """The chunks of every row; ``chunks_of`` makes them from the row's other columns, and a text without any has the empty one."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            owner, placed, index = [], [], []
            for i, values in enumerate(zip(*(c.to_pylist() for c in b.columns[1:]), strict=True)):
                found = chunks_of(*values) or [("", 0, 0)]
                owner += [i] * len(found)
                index += range(len(found))
                placed += found
            yield _rows(owner, placed, index, b[0])

    return pieces.mapInArrow(work, f"doc {dict(pieces.dtypes)['doc']}, chunk_index bigint, content string, start_pos bigint, end_pos bigint")


def _runs(pieces: DataFrame, joined: str) -> DataFrame:
    """Chunks of the runs: ``pieces`` has doc, text, n, limit (arrays) and exact; pieces are joined with ``joined``, which also ends a run.

    Blank runs are left out and the others numbered; an exact run ends where its stripped content ends.
    """

    def chunks_of(texts: list[str], sizes: list[int], limits: list[int], exact: bool) -> list[Placed]:
        out, at = [], 0
        starts = dealt(sizes, limits)
        for s, e in zip(starts, [*starts[1:], len(texts)], strict=False):
            raw = joined.join(texts[s:e]) + joined
            if content := raw.strip():
                out.append((content, at, at + len(content if exact else raw)))
            at += len(raw)
        return out

    return _per_text(pieces.select("doc", "text", "n", "limit", "exact"), chunks_of)


def _docs(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc"), F.coalesce(text_col, F.lit("")).alias("t"))


def _sized(texts: Column) -> Column:
    return F.transform(texts, lambda x: T.estimated_tokens(x))


def paragraphs(df: DataFrame, id_col: str, text_col: str, size: int = SIZE, most: int = MOST, adaptive: bool = True) -> DataFrame:
    """Runs of paragraphs (split at blank lines) of about ``size`` estimated tokens; denser paragraphs allow less.

    Positions refer to the paragraphs joined by an empty line each, not to the source.
    """
    docs = _docs(df, id_col, text_col).select("doc", F.filter(F.transform(F.split("t", r"\n\s*\n"), _strip), lambda p: p != "").alias("text"))
    limit = lambda p: F.greatest(F.lit(size // 2), F.least(F.floor(size * (1 - T.density(p) * 0.5)).cast("int"), F.lit(most))) if adaptive else F.lit(size)
    return _runs(docs.select("doc", "text", _sized(F.col("text")).alias("n"), F.transform("text", limit).alias("limit"), F.lit(False).alias("exact")), "\n\n")


# Where a top-level definition begins, by extension.
_JS = r"(?:export\s+)?(?:async\s+)?function\s+\w+|(?:export\s+)?class\s+\w+|(?:const|let|var)\s+\w+\s*=\s*(?:async\s+)?(?:function|\()|module\.exports\s*=|describe\s*\(|(?:it|test)\s*\("
_TS = r"(?:export\s+)?(?:async\s+)?function\s+\w+|(?:export\s+)?(?:abstract\s+)?class\s+\w+|(?:export\s+)?interface\s+\w+|(?:export\s+)?type\s+\w+"
_ACCESS = r"(?:public\s+)?(?:private\s+)?(?:protected\s+)?(?:static\s+)?"
BOUNDARIES = {
    "java": _ACCESS + r"(?:abstract\s+)?(?:class|interface|enum)\s+\w+|" + _ACCESS + r"(?:final\s+)?(?:synchronized\s+)?(?:native\s+)?(?:abstract\s+)?[\w<>\[\]]+\s+\w+\s*\(",
    "cpp": r"(?:[\w:]+\s+)?(?:[\w:]+\s+)?[\w:]+\s+\w+\s*\([^)]*\)\s*(?:const\s*)?\{",
    "c": r"(?:[\w*]+\s+)+\w+\s*\([^)]*\)\s*\{",
    "go": r"func\s+(?:\([^)]+\)\s+)?\w+\s*\(",
    "rs": r"(?:pub\s+)?(?:async\s+)?fn\s+\w+|(?:pub\s+)?(?:struct|enum|trait|impl)\s+\w+",
    "rb": r"def\s+\w+|class\s+\w+|module\s+\w+",
    "php": r"(?:abstract\s+)?(?:class|interface|trait)\s+\w+|(?:public\s+)?(?:private\s+)?(?:protected\s+)?(?:static\s+)?function\s+\w+",
    "swift": r"(?:public\s+)?(?:private\s+)?(?:internal\s+)?(?:open\s+)?(?:final\s+)?class\s+\w+|(?:public\s+)?(?:private\s+)?(?:internal\s+)?(?:static\s+)?func\s+\w+",
} | dict.fromkeys(("sh", "bash", "zsh"), r"(?:function\s+)?\w+\s*\(\s*\)\s*\{") | dict.fromkeys(("ts", "tsx"), _TS)
_CUT = "\u0001"


def _cut_before(text: Column, pattern: str) -> Column:
    """The text in pieces, each but the first beginning where the pattern begins at a line's start (the line feed goes along)."""
    return F.split(F.regexp_replace(F.replace(text, F.lit(_CUT), F.lit(" ")), f"(?U)(?=(?:\\A|\n)(?:{pattern}))", _CUT), _CUT)


def code(df: DataFrame, id_col: str, text_col: str, path_col: str, size: int = SIZE) -> DataFrame:
    """Runs of top-level definitions of about ``size`` estimated tokens.

    Python is cut where its parser says (texts that do not parse by pattern), other languages by pattern, unknown ones
    by the script pattern; a text without definitions is cut by lines.
    """
    docs = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc"), F.coalesce(text_col, F.lit("")).alias("t"), F.coalesce(F.regexp_replace(T.extension(path_col), r"^\.", ""), F.lit("")).alias("ext"))
    cut = F.lit(None).cast("array<string>")
    for ext, pattern in BOUNDARIES.items():
        cut = F.when(F.col("ext") == ext, _cut_before(F.col("t"), pattern)).otherwise(cut)
    by_pattern = docs.where(~F.col("ext").isin(PYTHON)).select("doc", "t", F.coalesce(cut, _cut_before(F.col("t"), _JS)).alias("c"))
    parsed = docs.where(F.col("ext").isin(PYTHON)).select("doc", "t").mapInArrow(_python_pieces, f"doc {dict(docs.dtypes)['doc']}, t string, c array<string>")
    cuts = by_pattern.unionByName(parsed.select("doc", "t", F.coalesce("c", _cut_before(F.col("t"), _JS)).alias("c")))
    defined = F.filter("c", lambda x: x != "")
    p = T.let(F.when(F.size("c") > 1, F.struct(defined.alias("text"), F.lit(False).alias("exact"))).otherwise(F.struct(_line_groups(F.col("t"), size).alias("text"), F.lit(True).alias("exact"))), lambda x: x)
    rows = cuts.select("doc", p.alias("p")).select("doc", "p.text", "p.exact")
    # a line group is a run of its own: its size exceeds its limit
    n = F.when(F.col("exact"), F.transform("text", lambda x: F.lit(1).cast("long"))).otherwise(_sized(F.col("text")))
    return _runs(rows.select("doc", "text", n.alias("n"), F.transform("text", lambda x: F.when(F.col("exact"), 0).otherwise(size)).alias("limit"), "exact"), "")


PYTHON = ["py", "pyw", "pyx"]


def _python_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text with its pieces: what stands before a top-level definition, and the definition; null if it does not parse or defines nothing."""
    for b in batches:
        out = []
        for text in b[1].to_pylist():
            try:
                tree = ast.parse(text)
            except (SyntaxError, ValueError, RecursionError, MemoryError):
                out.append(None)
                continue
            lines = text.splitlines(keepends=True)
            marks = [(n.lineno - 1, n.end_lineno) for n in tree.body if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef)]
            at, parts = 0, []
            for s, e in marks:
                parts += ["".join(lines[at:s]), "".join(lines[s:e])]
                at = e
            out.append([*parts, "".join(lines[at:])] if marks else None)
        yield pa.RecordBatch.from_arrays([b[0], b[1], pa.array(out, pa.list_(pa.string()))], ["doc", "t", "c"])


def _line_groups(text: Column, size: int) -> Column:
    """The text's lines in equal groups of about ``size`` estimated tokens."""
    lines = F.regexp_extract_all(text, F.lit("[^\n]*\n|[^\n]+$"), F.lit(0))

    def grouped(v: Column) -> Column:
        n, per = F.size(v["l"]), v["per"]
        starts = F.sequence(F.lit(0), F.floor((n - 1) / per).cast("int"))
        return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.transform(starts, lambda k: F.array_join(F.slice(v["l"], k * per + 1, per), "")))

    per = lambda l: F.greatest(F.lit(1), F.floor(size / F.greatest(F.lit(1), F.floor(T.estimated_tokens(text) / F.greatest(F.size(l), F.lit(1)))))).cast("int")  # noqa: E731, E741
    return T.let(lines, lambda l: T.let(F.struct(l.alias("l"), per(l).alias("per")), grouped))  # noqa: E741


def by_lines(df: DataFrame, id_col: str, text_col: str, size: int = SIZE) -> DataFrame:
    """Equal numbers of lines a chunk, of about ``size`` estimated tokens; blank chunks are left out."""
    docs = _docs(df, id_col, text_col).select("doc", _line_groups(F.col("t"), size).alias("text"))
    ones = lambda v: F.transform("text", lambda x: F.lit(v).cast("long"))
    return _runs(docs.select("doc", "text", ones(1).alias("n"), ones(0).alias("limit"), F.lit(True).alias("exact")), "")


def windows(sizes: np.ndarray, size: int, most: int, overlap: int) -> list[tuple[int, int]]:
    """The runs (first, end) of sentences of these sizes, by binary search over their running sums.

    A run ends with the sentence that brings it to ``size``, or before the one that would bring it beyond ``most``; the next
    one begins with the first sentence from which on the rest of the run is at most ``overlap``, but never with the same.
    """
    upto = np.concatenate([[0], np.cumsum(sizes)])
    find = lambda value, side: int(np.searchsorted(upto, value, side))
    out, first = [], 0
    while first < len(sizes):
        end = min(find(upto[first] + size, "left"), find(upto[first] + most, "right") - 1, len(sizes))
        if end <= first:  # one sentence beyond the most
            break
        out.append((first, end))
        first = len(sizes) if end == len(sizes) else max(first + 1, find(upto[end] - overlap, "left"))
    return out


def sentence_windows(df: DataFrame, id_col: str, text_col: str, size: int = SIZE, most: int = MOST, overlap: int = 32) -> DataFrame:
    """Overlapping runs of sentences: each run begins with the last sentences of the one before that fit ``overlap``.

    A sentence beyond ``most`` ends the text's chunks.
    """
    between = r"(?<=[.!?])\s+"
    docs = _docs(df, id_col, text_col).where(F.col("doc").isNotNull()).select("doc", F.when(F.col("t").rlike(r"(?U)\S"), F.col("t")).otherwise("").alias("t"))
    d = docs.select("doc", F.when(F.col("t") == "", F.array().cast("array<string>")).otherwise(F.split("t", between)).alias("s"), F.transform(F.regexp_extract_all("t", F.lit(between), F.lit(0)), lambda g: F.char_length(g)).alias("g"))

    def chunks_of(sentences: list[str], gaps: list[int], sizes: list[int]) -> list[Placed]:
        starts = np.concatenate([[0], np.cumsum([len(x) + g for x, g in zip(sentences, [*gaps, 0][: len(sentences)], strict=True)])])
        out = []
        for s, e in windows(np.array(sizes, np.int64), size, most, overlap):
            content = " ".join(sentences[s:e])
            out.append((content, int(starts[s]), int(starts[s]) + len(content)))
        return out

    return _per_text(d.select("doc", "s", "g", _sized(F.col("s")).alias("n")), chunks_of)
