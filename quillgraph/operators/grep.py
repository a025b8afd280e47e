"""Literal and regular-expression search over chunks, with line numbers, roles and enclosing scopes.

Chunks are (chunk_id, document_path, content, start_pos).  A null content has no matches; a literal pattern's matches
may overlap, a regular expression's do not.  An empty pattern is refused.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import text as T


def match_count(text: Column, pattern: str, regex: bool = False) -> Column:
    if not pattern:
        raise ValueError("an empty pattern matches everywhere")
    return F.regexp_count(text, F.lit(pattern if regex else "(?=" + java_literal(pattern) + ")")).cast("long")


def java_literal(pattern: str) -> str:
    return re.sub(r"([\\^$.|?*+()\[\]{}\-#&~ ])", r"\\\1", pattern)


def matching_chunks(chunks: DataFrame, pattern: str, regex: bool = False) -> DataFrame:
    """(chunk_id, document_path, start_pos, matches) of the chunks with a match."""
    c = chunks
    if not regex:
        c = c.where(F.contains("content", F.lit(pattern)))
    return c.select("chunk_id", "document_path", "start_pos", match_count(F.col("content"), pattern, regex).alias("matches")).where("matches > 0")


def base_lines(chunks: DataFrame) -> DataFrame:
    """(chunk_id, document_path, base_line): the line of its document on which each chunk begins, from 1.

    A running sum over the chunks of a document in order of position; a chunk that does not end in a line feed counts
    its last line.
    """
    lines = F.char_length("content") - F.char_length(F.replace("content", F.lit("\n"), F.lit(""))) + F.when(F.endswith("content", F.lit("\n")), 0).otherwise(1)
    w = Window.partitionBy("document_path").orderBy("start_pos", "chunk_id").rowsBetween(Window.unboundedPreceding, -1)
    return chunks.select("chunk_id", "document_path", (1 + F.coalesce(F.sum(F.coalesce(lines, F.lit(1))).over(w), F.lit(0))).cast("long").alias("base_line"))


def chunk_for_line(based: DataFrame, line: int) -> DataFrame:
    """(document_path, chunk_id): the chunk of each file that holds a line (from 1), or the file's last chunk if it is shorter.

    ``based`` is what ``base_lines`` gives.
    """
    at = based.where((F.col("base_line") <= line) & F.col("document_path").isNotNull())
    return at.groupBy("document_path").agg(F.max_by("chunk_id", F.struct("base_line", "chunk_id")).alias("chunk_id"))


def matching_lines(chunks: DataFrame, pattern: str, regex: bool = False) -> DataFrame:
    """(chunk_id, document_path, line_in_chunk, line, role) of every line with a match; both kinds are filtered before the split."""
    hit = F.contains("content", F.lit(pattern)) if not regex else F.col("content").rlike(pattern)
    lines = chunks.where(hit).select("chunk_id", "document_path", F.posexplode(F.split("content", "\n")).alias("_i", "line"))
    keep = F.contains("line", F.lit(pattern)) if not regex else F.col("line").rlike(pattern)
    return lines.where(keep).select("chunk_id", "document_path", (F.col("_i") + 1).cast("long").alias("line_in_chunk"), "line", T.line_role("line").alias("role"))


def with_scope(lines: DataFrame, definitions: DataFrame) -> DataFrame:
    """Adds ``scope``: the last definition of the same chunk at or above the line, or null.

    An as-of join within a chunk: both sides are grouped by chunk, so it costs the lines times the definitions of one
    chunk, and the best is kept by aggregation.
    """
    d = definitions.select(F.col("chunk_id").alias("_c"), F.col("line_number").alias("_l"), "name", F.col("id").alias("_id")).where(F.col("_l").isNotNull())
    met = lines.join(d, (lines["chunk_id"] == F.col("_c")) & (F.col("_l") <= lines["line_in_chunk"]), "left")
    return met.groupBy(*lines.columns).agg(F.max_by("name", F.struct("_l", "_id")).alias("scope"))


def grouped(lines: DataFrame, key: str) -> DataFrame:
    """(key, matches, files): totals of the matching lines by file, role or scope."""
    return lines.groupBy(key).agg(F.count("*").alias("matches"), F.count_distinct("document_path").alias("files"))


def repeated_lines(lines: DataFrame, least: int = 3) -> DataFrame:
    """(excerpt, times, files): lines that are the same but for white space, ``least`` times or more."""
    return lines.groupBy(T.one_line("line").alias("excerpt")).agg(F.count("*").alias("times"), F.count_distinct("document_path").alias("files")).where(F.col("times") >= least)


def within_budget(ranked: DataFrame, partition: str, order: list[Column], cost: Column, budget: int) -> DataFrame:
    """The leading rows of each partition up to the first that would exceed the budget."""
    w = Window.partitionBy(partition).orderBy(*order)
    return ranked.withColumn("_sum", F.sum(cost).over(w.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("_sum") <= budget).drop("_sum")
