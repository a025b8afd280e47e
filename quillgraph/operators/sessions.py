"""Sessions: what was looked at in which turn, searches, reads and stored states, as DataFrame steps.

A session chunk is (session_id, chunk_id, turn_number, relevance).  Time is always an argument or a column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.operators.vectors import cosine, usable


def with_tokens(session_chunks: DataFrame, chunks: DataFrame) -> DataFrame:
    """The session chunks of known chunks, with document_path and token_count (null counts as 0)."""
    c = chunks.select("chunk_id", "document_path", F.coalesce("token_count", F.lit(0)).alias("token_count"))
    return session_chunks.join(c, "chunk_id")


def chunks_of(session_chunks: DataFrame, chunks: DataFrame, session: Column, turn: int | None = None) -> DataFrame:
    """(position, chunk_id, turn_number, relevance, token_count): one session's chunks, the newest turn first, the most relevant first within it."""
    mine = session_chunks.where(F.col("session_id") == session)
    mine = with_tokens(mine if turn is None else mine.where(F.col("turn_number") == turn), chunks)
    order = Window.partitionBy("session_id").orderBy(F.desc("turn_number"), F.desc("relevance"), "chunk_id")
    return mine.select(F.row_number().over(order).cast("long").alias("position"), "chunk_id", "turn_number", "relevance", "token_count")


def totals(session_chunks: DataFrame, chunks: DataFrame) -> DataFrame:
    """(session_id, turn_count, chunks, total_tokens): the turn count is one more than the last turn."""
    return with_tokens(session_chunks, chunks).groupBy("session_id").agg((F.max("turn_number") + 1).alias("turn_count"), F.count("*").alias("chunks"), F.sum("token_count").alias("total_tokens"))


def saved(sessions: DataFrame, states: DataFrame, chunks: DataFrame) -> DataFrame:
    """(session_id, turn_number, chunks_saved, total_tokens): states (session_id, chunk_id) of known chunks are saved in the session's present turn.

    ``sessions`` is (session_id, turn_count, total_tokens); a session that is not there begins at turn 0.
    """
    new = with_tokens(states.select("session_id", "chunk_id").distinct(), chunks).groupBy("session_id").agg(F.count("*").alias("chunks_saved"), F.sum("token_count").alias("_t"))
    all_ids = states.select("session_id").distinct()
    rows = all_ids.join(sessions, "session_id", "left").join(new, "session_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return rows.select("session_id", zero("turn_count").alias("turn_number"), zero("chunks_saved").alias("chunks_saved"), (zero("total_tokens") + zero("_t")).alias("total_tokens"))


def rolled_back(session_chunks: DataFrame, sessions: DataFrame, target: int) -> tuple[DataFrame, DataFrame]:
    """(kept, report): chunks up to the target turn, which stays; a session that is not beyond it keeps all.

    The report is (session_id, previous_turn, current_turn, removed, error); the error is null where it went well.
    """
    s = sessions.select("session_id", "turn_count")
    ok = (F.lit(target) >= 0) & (F.lit(target) < F.col("turn_count"))
    rows = session_chunks.join(s, "session_id")
    goes = ok & (F.col("turn_number") > target)
    gone = rows.groupBy("session_id").agg(F.count_if(goes).alias("removed"))
    error = F.when(F.lit(target) < 0, "target turn must not be negative").when(F.col("turn_count") <= target, "target turn is not before the current turn")
    report = s.join(gone, "session_id", "left").select(
        "session_id", F.col("turn_count").alias("previous_turn"), F.when(ok, F.lit(target).cast("long")).otherwise(F.col("turn_count")).alias("current_turn"), F.coalesce("removed", F.lit(0)).alias("removed"), error.alias("error")
    )
    return rows.where(~goes).select(session_chunks.columns), report


def search_history(searches: DataFrame, session: Column) -> DataFrame:
    """A session's searches (session_id, id, pattern, files, searched_at), oldest first."""
    order = Window.partitionBy("session_id").orderBy("searched_at", "id")
    return searches.where(F.col("session_id") == session).select(F.row_number().over(order).cast("long").alias("position"), "id", "pattern", "searched_at")


def last_search_of_files(searches: DataFrame) -> DataFrame:
    """(session_id, path, pattern, searched_at): the last search of each session that looked at each file."""
    rows = searches.select("session_id", "id", "pattern", "searched_at", F.explode("files").alias("path"))
    last = rows.groupBy("session_id", "path").agg(F.max_by(F.struct("pattern", "searched_at"), F.struct("searched_at", "id")).alias("l"))
    return last.select("session_id", "path", "l.pattern", "l.searched_at")


def reads(log: DataFrame) -> DataFrame:
    """(session_id, document_path, read_at, times): each file once a session, as last read."""
    return log.where(F.col("session_id").isNotNull() & F.col("document_path").isNotNull()).groupBy("session_id", "document_path").agg(F.max("read_at").alias("read_at"), F.count("*").alias("times"))


def read_files(file_reads: DataFrame, documents: DataFrame, staleness: DataFrame) -> DataFrame:
    """(session_id, document_path, read_at, known, modified_since, staleness) of every read file.

    ``documents`` is (document_path, last_modified), a path once; ``staleness`` is (document_path, score).  A file that is
    not stored any more is not known; a staleness is the worst of the file's chunks, 0 without any.
    """
    d = documents.select("document_path", "last_modified", F.lit(True).alias("_in"))
    worst = staleness.groupBy("document_path").agg(F.max("score").alias("_w"))
    rows = file_reads.join(d, "document_path", "left").join(worst, "document_path", "left")
    since = F.coalesce(F.col("last_modified") > F.col("read_at"), F.lit(False))
    return rows.select("session_id", "document_path", "read_at", F.coalesce("_in", F.lit(False)).alias("known"), since.alias("modified_since"), F.coalesce("_w", F.lit(0.0)).alias("staleness"))


def relevant(session_chunks: DataFrame, session: Column, vectors: DataFrame, query: list[float], k: int) -> DataFrame:
    """(chunk_id, similarity): the k chunks of a session nearest to a query vector, exactly; a chunk without a usable vector takes no part.

    ``vectors`` is (chunk_id, v), each chunk once.  Only the session's vectors are compared.
    """
    mine = session_chunks.where(F.col("session_id") == session).select("chunk_id").distinct()
    q = F.array(*[F.lit(float(x)) for x in query])
    near = vectors.join(mine, "chunk_id", "left_semi").where(usable(F.col("v"), len(query))).select("chunk_id", cosine(F.col("v"), q).alias("similarity"))
    return near.orderBy(F.desc(F.round("similarity", 9)), "chunk_id").limit(k)


def orphaned_states(states: DataFrame, session_chunks: DataFrame) -> DataFrame:
    """Stored states that no session chunk refers to any more."""
    keys = ["session_id", "chunk_id", "turn_number"]
    return states.join(session_chunks.select(*keys).distinct(), keys, "left_anti")
