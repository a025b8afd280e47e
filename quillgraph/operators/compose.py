"""Operators that put the others together: search answers, file context, change classes, removal, health."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import text as T
from quillgraph.operators.vectors import cosine


def attach_edges(hits: DataFrame, edges: DataFrame) -> DataFrame:
    """Adds ``depends_on`` and ``depended_on_by``: the sorted symbol names of each hit's edges, empty if there are none.

    ``hits`` is a top list with chunk_id; only its edges are grouped.
    """
    out = hits
    for side, name in (("source_chunk_id", "depends_on"), ("target_chunk_id", "depended_on_by")):
        mine = edges.join(hits.select(F.col("chunk_id").alias(side)).distinct(), side, "left_semi")
        names = mine.groupBy(F.col(side).alias("chunk_id")).agg(F.array_sort(F.collect_set("symbol_name")).alias(name))
        out = out.join(names, "chunk_id", "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    return out


def symbol_boost(ranked: DataFrame, symbols: DataFrame, identifiers: list[str], chunks: DataFrame) -> DataFrame:
    """(chunk_id, score, symbol): chunks that define a query's identifier and are not ranked yet.

    Their score is 0.85 of the last ranked score, rounded to four places, or of 0.1 if nothing is ranked.
    """
    wanted = [i.lower() for i in identifiers]
    defs = symbols.where((F.lower("role") == "definition") & F.lower("name").isin(wanted))
    first = defs.groupBy("chunk_id").agg(F.min_by("name", "id").alias("symbol"))
    last = ranked.agg(F.coalesce(F.min("score"), F.lit(0.1))).scalar()
    found = first.join(ranked.select("chunk_id"), "chunk_id", "left_anti").join(chunks.select("chunk_id"), "chunk_id", "left_semi")
    return found.select("chunk_id", F.round(last * 0.85, 4).alias("score"), "symbol")


def rerank(hits: DataFrame, text: str, terms: list[str], k: int) -> DataFrame:
    """(id, score): scores blended with the proximity of the query's terms (0.35 of it for five terms or more, else 0.28); hits without any term keep theirs."""
    w = 0.35 if len(terms) >= 5 else 0.28
    p = T.proximity(text, terms)
    return hits.select("id", F.when(p > 0, F.round(F.col("score") * (1 - w) + p * w, 6)).otherwise(F.col("score")).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def first_sources(parts: list[tuple[str, DataFrame]], k: int) -> DataFrame:
    """(chunk_id, source): chunks of several ranked lists (chunk_id, pos), each chunk from the first list that has it; the first k."""
    all_rows = reduce(DataFrame.unionByName, [d.select("chunk_id", "pos", F.lit(i).alias("_s"), F.lit(name).alias("source")) for i, (name, d) in enumerate(parts)])
    best = all_rows.groupBy("chunk_id").agg(F.min_by("source", F.struct("_s", "pos")).alias("source"), F.min(F.struct("_s", "pos")).alias("_o"))
    return best.orderBy("_o", "chunk_id").limit(k).select("chunk_id", "source")


def file_context(paths: DataFrame, stored: DataFrame, seen: DataFrame, staleness: DataFrame, hint: float = 0.3) -> DataFrame:
    """(path, status, stale): whether each asked file is unchanged, changed, new or missing, and whether its chunks look stale.

    ``stored`` and ``seen`` are (path, hash); ``staleness`` is (path, score).
    """
    s = stored.select("path", F.col("hash").alias("_s"), F.lit(True).alias("_in"))
    n = seen.select("path", F.col("hash").alias("_n"), F.lit(True).alias("_there"))
    worst = staleness.groupBy("path").agg(F.max("score").alias("_w"))
    rows = paths.select("path").distinct().join(s, "path", "left").join(n, "path", "left").join(worst, "path", "left")
    status = F.when(F.col("_there").isNull(), "missing").when(F.col("_in").isNull(), "new").when(F.col("_s") == F.col("_n"), "unchanged").otherwise("changed")
    return rows.select("path", status.alias("status"), (F.coalesce("_w", F.lit(0.0)) >= hint).alias("stale"))


def change_classes(versions: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(chunk_id, class) of the newest version of each chunk: new (no older one), restored (same hash, or a cosine of at least the threshold), reprocessed.

    ``versions`` has chunk_id, version, content_hash, semantic_signature; repeated versions count once.
    """
    w = Window.partitionBy("chunk_id").orderBy("version")
    v = versions.dropDuplicates(["chunk_id", "version"]).select(
        "chunk_id", "version", "content_hash", "semantic_signature", F.lag("version").over(w).alias("_v"), F.lag("content_hash").over(w).alias("_h"), F.lag("semantic_signature").over(w).alias("_s"), F.max("version").over(Window.partitionBy("chunk_id")).alias("_m")
    )
    near = F.coalesce(cosine(F.col("semantic_signature"), F.col("_s")) >= threshold, F.lit(False))
    kind = F.when(F.col("_v").isNull(), "new").when((F.col("content_hash") == F.col("_h")) | near, "restored").otherwise("reprocessed")
    return v.where(F.col("version") == F.col("_m")).select("chunk_id", kind.alias("class"))


def without_document(tables: dict[str, DataFrame], path: Column, chunk_ids: DataFrame) -> dict[str, DataFrame]:
    """The tables after a document is removed: rows of its path go, and rows that only have a chunk_id go by its chunks."""
    out = {}
    for name, t in tables.items():
        if "document_path" in t.columns:
            out[name] = t.where(~F.col("document_path").eqNullSafe(path))
        elif "chunk_id" in t.columns:
            out[name] = t.join(chunk_ids.select("chunk_id").distinct(), "chunk_id", "left_anti")
        else:
            out[name] = t
    return out


def trimmed(text: Column | str, budget: int, mark: str = "\n…[truncated]") -> Column:
    """The longest run of whole pieces of a text within a budget of estimated tokens, with a mark if anything was cut."""
    t = T.col(text)
    sign = T.WORD_SIGN
    # what the estimate counts, and what it does not, so that the pieces are the whole text
    pieces = F.regexp_extract_all(t, F.lit(rf"[A-Z]?[a-z]+|[A-Z]+(?=[A-Z][a-z]|[^{sign}]|$)|[0-9]+|[^{sign}\s]|\s+|[{sign}]"), F.lit(0))

    def step(s: Column, p: Column) -> Column:
        kind = F.when(p.rlike(r"^\s"), 1).when(p.rlike(rf"^[^{sign}\s]$"), 2).when(p.rlike("^[a-z0-9]|^[A-Z]"), 0).otherwise(-1)
        joined = ((s["open"] == 1) & (kind != 1) & (kind != -1)) | ((s["open"] == 2) & (kind == 2))
        n = s["n"] + F.when(joined | (kind == -1), 0).otherwise(1)
        fits = (n <= budget) & ~s["full"]
        return F.struct(
            F.when(joined, F.lit(0)).when(kind == -1, s["open"]).otherwise(kind).alias("open"), n.alias("n"), F.when(fits, s["len"] + F.char_length(p)).otherwise(s["len"]).alias("len"), (~fits).alias("full")
        )

    start = F.struct(F.lit(0).alias("open"), F.lit(0).alias("n"), F.lit(0).alias("len"), F.lit(False).alias("full"))
    return T.let(F.aggregate(pieces, start, step), lambda s: F.when(s["full"], F.concat(t.substr(F.lit(1), s["len"]), F.lit(mark))).otherwise(t))


def common_folder(paths: DataFrame, column: str) -> DataFrame:
    """One row (folder): the longest common folder of all paths, from the least and the greatest alone."""
    ends = paths.agg(F.min(column).alias("a"), F.max(column).alias("b"))
    a, b = F.split(F.regexp_replace("a", "/?[^/]*$", ""), "/"), F.split(F.regexp_replace("b", "/?[^/]*$", ""), "/")
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    n = F.aggregate(same, F.struct(F.lit(True).alias("on"), F.lit(0).alias("n")), lambda s, e: F.struct((s["on"] & e).alias("on"), (s["n"] + (s["on"] & e).cast("int")).alias("n")), lambda s: s["n"])
    return ends.select(F.array_join(F.slice(a, 1, n), "/").alias("folder"))


def recent_folder(documents: DataFrame, path: str, at: str, share: int = 4) -> DataFrame:
    """One row (folder): the folder that the newest part (one in ``share``, at least one) of the files have in common; files without a time take no part."""
    d = documents.where(F.col(path).isNotNull() & F.col(at).isNotNull()).groupBy(path).agg(F.max(at).alias("_t"))
    return common_folder(d.orderBy(F.desc("_t"), path).limit(max(1, d.count() // share)), path)


def parsed_notes(notes: Column | str) -> Column:
    """Notes that are JSON as their canonical JSON text, others as they are."""
    n = T.col(notes)
    return F.coalesce(F.to_json(F.try_parse_json(n)), n)


def busy_action(rate: Column) -> Column:
    """What a rate of failed operations asks for: idle below one in a hundred, vacuum below one in ten, else rebuild."""
    return F.when(rate < 0.01, "idle").when(rate < 0.1, "vacuum").otherwise("rebuild_symbols")
