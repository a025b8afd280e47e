"""Search answers for a reader with a budget: matches with their surroundings, grouped, deduplicated and cut to size.

Everything here works on the matches of a limited number of chunks (a parameter of the search), so the whole-table windows
that number and sum them are over a few thousand rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from quillgraph.functions import text as T
from quillgraph.operators import grep

CHUNKS, PER_CHUNK, RESERVED, LEAST_BUDGET = 500, 10, 150, 200
#: Kinds of definitions that make a scope.
SCOPES = ("function", "class", "method")


def _whole() -> WindowSpec:
    """All rows; what is numbered here is bounded by the search's limit."""
    return Window.partitionBy(F.lit(1))


def match_starts(text: Column, pattern: str, regex: bool = False, most: int = PER_CHUNK) -> Column:
    """The places (from 0) of the first ``most`` matches: of a literal all that overlap, of a regular expression those that do not."""
    if not pattern:
        raise ValueError("an empty pattern matches everywhere")
    ahead = pattern if regex else f"(?={grep.java_literal(pattern)})"
    parts = F.split(text, ahead, -1) if regex else F.split(text, ahead)
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)) if regex else F.array().cast("array<string>")
    first = F.lit(0) if regex else F.when(F.startswith(text, F.lit(pattern)), 0).otherwise(1)

    def places(p: Column) -> Column:
        n = F.least(F.lit(most), F.size(p) - (1 if regex else first))
        lengths = F.zip_with(p, found, lambda x, y: F.struct(F.coalesce(F.char_length(x), F.lit(0)).alias("a"), F.coalesce(F.char_length(y), F.lit(0)).alias("b")))
        upto = lambda i: F.aggregate(F.slice(lengths, 1, i), F.lit(0), lambda s, x: s + x["a"] + x["b"])
        last = F.aggregate(F.slice(lengths, 1, 0), F.lit(0), lambda s, x: s)
        at = lambda i: upto(i) + F.element_at(lengths, i + 1)["a"] if regex else upto(i + first)
        return F.when(n <= 0, F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(0), n - 1), lambda i: at(i) + last))

    return T.let(parts, places)


def entries(chunks: DataFrame, symbols: DataFrame, pattern: str, regex: bool = False, context: int = 0, most: int = CHUNKS) -> DataFrame:
    """(pos, chunk_id, file, line, excerpt, scope, classification): every match of the first ``most`` chunks, in order of file and place.

    ``chunks`` has chunk_id, document_path, content, start_pos, each chunk once; ``symbols`` is cleaned.
    """
    hit = F.contains("content", F.lit(pattern)) if not regex else F.col("content").rlike(pattern)
    found = chunks.where(hit).select("chunk_id", "document_path", "start_pos", "content").orderBy("document_path", "start_pos", "chunk_id").limit(most)
    lines = F.split("content", "\n")
    one = found.select("chunk_id", "document_path", "start_pos", "content", lines.alias("lines"), F.posexplode(match_starts(F.col("content"), pattern, regex)).alias("k", "at"))
    before = F.substring("content", F.lit(1), F.col("at"))
    one = one.withColumn("i", F.char_length(before) - F.char_length(F.replace(before, F.lit("\n"), F.lit(""))))
    first = F.greatest(F.lit(0), F.col("i") - context)
    excerpt = F.array_join(F.slice("lines", first + 1, F.least(F.size("lines"), F.col("i") + 1 + context) - first), "\n")
    placed = one.select("chunk_id", "document_path", "start_pos", "k", (F.col("i") + 1).cast("long").alias("line_in_chunk"), excerpt.alias("excerpt"), T.line_role(F.element_at("lines", F.col("i") + 1)).alias("classification"))
    defs = symbols.where((F.col("role") == "definition") & F.col("kind").isin(list(SCOPES)))
    scoped = grep.with_scope(placed, defs.join(found.select("chunk_id"), "chunk_id", "left_semi"))
    files = chunks.join(found.select("document_path").distinct(), "document_path", "left_semi")
    based = scoped.join(grep.base_lines(files).select("chunk_id", "base_line"), "chunk_id")
    pos = F.row_number().over(_whole().orderBy("document_path", "start_pos", "chunk_id", "k")).cast("long")
    return based.select(pos.alias("pos"), "chunk_id", F.col("document_path").alias("file"), (F.col("base_line") + F.col("line_in_chunk") - 1).alias("line"), "excerpt", "scope", "classification")


def collapsed(matches: DataFrame) -> DataFrame:
    """The matches with those of the same excerpt, but for white space, brought together; three or more are one, with how many others and up to five other files."""
    w = Window.partitionBy(T.one_line("excerpt"))
    rows = matches.withColumns({"_n": F.count("*").over(w), "_f": F.min("pos").over(w), "_first": F.min_by("file", "pos").over(w), "_files": F.sort_array(F.collect_set("file").over(w))})
    kept = rows.where((F.col("_n") <= 2) | (F.col("pos") == F.col("_f")))
    many = F.col("_n") > 2
    others = F.slice(F.filter("_files", lambda x: x != F.col("_first")), 1, 5)
    return kept.select(
        *matches.columns, F.when(many, F.col("_n") - 1).alias("also_in"), F.when(many & (F.size(others) > 0), others).alias("also_in_files"), F.col("_f").alias("first_pos"), F.when(many, F.col("_n") - 1).otherwise(0).alias("dropped")
    )


def grouped(matches: DataFrame, group_by: str = "file", max_tokens: int = 4000, deduplicate: bool = True) -> DataFrame:
    """(position, key, count, tokens, shown, dropped, matches): groups in order of first appearance; ``shown`` ends where the token budget would be exceeded, but the first is shown.

    ``matches`` (sorted structs) has file, line, excerpt, scope, classification, also_in, also_in_files.
    """
    rows = collapsed(matches) if deduplicate else matches.select("*", F.lit(None).cast("long").alias("also_in"), F.lit(None).cast("array<string>").alias("also_in_files"), F.col("pos").alias("first_pos"), F.lit(0).cast("long").alias("dropped"))
    key = {"scope": F.coalesce("scope", F.lit("(top-level)")), "classification": F.coalesce("classification", F.lit("code"))}.get(group_by, F.col("file"))
    cols = ["file", "line", "excerpt", "scope", "classification", "also_in", "also_in_files"]
    g = rows.groupBy(key.alias("key")).agg(F.array_sort(F.collect_list(F.struct("first_pos", "pos", *cols))).alias("m"), F.count("*").alias("count"), F.sum("dropped").alias("dropped"))
    words = F.flatten(F.transform("m", lambda x: F.array_compact(F.array(x["excerpt"], x["scope"], x["classification"], F.concat(F.lit(":"), x["line"].cast("string"))))))
    tokens = T.estimated_tokens(F.concat_ws(" ", "key", words))
    g = g.withColumns({"tokens": tokens, "_o": F.col("m")[0]["first_pos"]})
    order = _whole().orderBy("_o", "key")
    g = g.withColumns({"position": F.row_number().over(order).cast("long"), "_sum": F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0))})
    over = F.min(F.when((F.col("_sum") > max(LEAST_BUDGET, max_tokens - RESERVED)) & (F.col("position") > 1), F.col("position"))).over(_whole())
    shown = F.coalesce(F.col("position") < over, F.lit(True))
    return g.select("position", "key", "count", "tokens", shown.alias("shown"), "dropped", F.transform("m", lambda x: F.struct(*[x[c].alias(c) for c in cols])).alias("matches"))


def summary(groups: DataFrame, matches: DataFrame) -> DataFrame:
    """One row: total_matches, shown_matches, truncated, total_tokens, files, summary (what a reader is told)."""
    total = matches.agg(F.count("*").alias("total_matches"), F.count_distinct("file").alias("files"))
    g = groups.agg(F.coalesce(F.sum(F.when(F.col("shown"), F.col("count"))), F.lit(0)).alias("shown_matches"), F.coalesce(F.sum(F.when(F.col("shown"), F.col("tokens"))), F.lit(0)).alias("total_tokens"), F.coalesce(F.sum("dropped"), F.lit(0)).alias("_d"))
    row = total.withColumn("_j", F.lit(1)).join(g.withColumn("_j", F.lit(1)), "_j")
    cut = F.col("total_matches") - F.col("shown_matches") - F.col("_d")
    plural = lambda c, one, many: F.concat(c.cast("string"), F.when(c == 1, one).otherwise(many))
    told = F.concat_ws(
        " ", plural(F.col("total_matches"), " match", " matches"), F.concat(F.lit("in "), plural(F.col("files"), " file", " files")),
        F.when(F.col("_d") > 0, F.concat(F.lit("("), F.col("_d").cast("string"), F.lit(" duplicates collapsed)"))),
        F.when(cut > 0, F.concat(F.lit("(showing "), F.col("shown_matches").cast("string"), F.lit(", ~"), F.col("total_tokens").cast("string"), F.lit(" tokens)"))),
    )
    return row.select("total_matches", "shown_matches", F.greatest(F.lit(0), cut).cast("long").alias("truncated"), "total_tokens", "files", told.alias("summary"))


def within_tokens(results: DataFrame, order: list[Column], budget: int | None, compact: bool = False) -> DataFrame:
    """The leading results (with content) up to the first that would exceed the budget of estimated tokens.

    ``compact`` gives content_preview (400 signs) and content_token_estimate in place of content, and counts 32 tokens more each.
    """
    preview = F.concat(F.substring("content", 1, 400), F.when(F.char_length("content") > 400, "…").otherwise(""))
    body = F.coalesce(preview if compact else F.col("content"), F.lit(""))
    cost = T.estimated_tokens(body) + (32 if compact else 0)
    rows = results.withColumn("_t", F.sum(cost).over(_whole().orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    kept = (rows if budget is None else rows.where(F.col("_t") <= budget)).drop("_t")
    if not compact:
        return kept
    return kept.withColumns({"content_preview": preview, "content_token_estimate": T.estimated_tokens(F.coalesce("content", F.lit("")))}).drop("content")


def text_search_totals(found: DataFrame) -> DataFrame:
    """One row (matches, chunks, files) of the chunks found by a text search."""
    return found.agg(F.coalesce(F.sum("matches"), F.lit(0)).alias("matches"), F.count("*").alias("chunks"), F.count_distinct("document_path").alias("files"))


def recall(hits: DataFrame, labels: DataFrame, at: tuple[int, ...] = (5, 10)) -> DataFrame:
    """(query_id, category, recall_at_k ...): the share of each query's expected ids among its first k hits.

    ``hits`` is (query_id, id, rank), ``labels`` (query_id, category, id); repeated labels count once.
    """
    want = labels.select("query_id", "category", "id").distinct()
    met = want.join(hits.groupBy("query_id", "id").agg(F.min("rank").alias("rank")), ["query_id", "id"], "left")
    return met.groupBy("query_id", "category").agg(*[F.round(F.avg(F.coalesce((F.col("rank") <= k).cast("double"), F.lit(0.0))), 6).alias(f"recall_at_{k}") for k in at])
