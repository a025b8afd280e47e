"""Keyword ranking (Okapi BM25) over a postings table that is built once and asked many times.

A posting is (id, term, tf); a term is a stemmed part of an identifier of at least two signs.  The texts are read once; each
distinct word of the collection is split and stemmed once and joined back.  Postings are written in buckets by term, so a
query reads the buckets of its terms only; record lengths and totals are written with them.  Records with a null id, null or
empty text are left out of the index; a repeated id counts once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import text as T
from quillgraph.functions.stem import stem, with_stems
from quillgraph.operators.repeats import kept_rows
from quillgraph.session import materialize, materialize_by

K1, B = 1.5, 0.75


def split_words(words: DataFrame) -> DataFrame:
    """(w, part): the parts of at least two signs of each word of ``words`` (w), repeats included."""
    return words.select("w", F.explode(T.split_identifier("w")).alias("part")).where(F.char_length("part") > 1)


def stems(words: DataFrame) -> DataFrame:
    """(part, term): each distinct part of the words (w) with its stem."""
    return with_stems(split_words(words).select("part").distinct(), "part", "term")


def word_terms(words: DataFrame) -> DataFrame:
    """(w, term, k): the terms of each distinct word and how often it holds them, in Arrow batches over the vocabulary."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once = lru_cache(1 << 16)(stem)
        for b in batches:
            rows = [(w, t, k) for w in b[0].to_pylist() for t, k in Counter(once(p) for p in T.identifier_parts(w) if len(p) > 1).items()]
            w, t, k = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(w, pa.string()), pa.array(t, pa.string()), pa.array(k, pa.int64())], ["w", "term", "k"])

    return words.select("w").mapInArrow(work, "w string, term string, k bigint")


def word_counts(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(counts (id, w, n), ids (id)): the identifiers of every record that has a text, and all such records."""
    rows, ids = kept_rows(df.where(F.col(text_col) != ""), id_col, text_col, "bm25-records")
    words = rows.select(F.col("_id").alias("id"), "_copies", F.explode(T.identifiers("_text")).alias("w"))
    counts = words.groupBy("id", "w").agg((F.count("*") / F.max("_copies")).cast("long").alias("n"))
    return materialize(counts, "bm25-words"), ids.select(F.col("_id").alias("id"))


class Index:
    """Postings (id, term, tf), lengths (id, dl; 0 for records without terms) and totals, written once."""

    def __init__(self, df: DataFrame, id_col: str, text_col: str):
        counts, ids = word_counts(df, id_col, text_col)
        terms = materialize(word_terms(counts.select("w").distinct()), "bm25-terms")
        made = counts.join(terms, "w").groupBy("id", "term").agg(F.sum(F.col("n") * F.col("k")).alias("tf"))
        self.postings = materialize_by(made, "term", "bm25_postings")
        lengths = self.postings.groupBy("id").agg(F.sum("tf").alias("dl"))
        self.sizes = materialize(ids.join(lengths, "id", "left").select("id", F.coalesce("dl", F.lit(0)).alias("dl")), "bm25-sizes")
        self.n, self.average_length = self.stats().select("n", "average_length").first()

    def stats(self) -> DataFrame:
        """One row: records (n), average length (average_length), terms."""
        return self.sizes.agg(F.count("*").alias("n"), F.avg("dl").alias("average_length"), F.coalesce(F.sum("dl"), F.lit(0)).alias("terms"))

    def scores(self, query: str) -> DataFrame:
        """(id, score) of every record that shares a term with the query; repeated query terms count."""
        wanted = query_terms(query)
        if not wanted:
            return self.sizes.where("false").select("id", F.lit(0.0).alias("score"))
        hits = self.postings.where(F.col("term").isin(list(wanted)))
        docs = hits.groupBy("term").agg(F.count("*").alias("df"))  # a row a query term
        times = F.element_at(F.create_map(*[F.lit(x) for pair in wanted.items() for x in pair]), F.col("term"))
        rows = hits.join(F.broadcast(docs), "term").join(self.sizes, "id")
        weight = times * idf(F.lit(self.n), F.col("df"))
        part = weight * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(self.average_length or 1.0)))
        return rows.groupBy("id").agg(F.sum(part).alias("score"))


    def scores_batch(self, queries: dict[str, str]) -> DataFrame:
        """(query_id, id, score) of several queries at once: one pass over the postings of all their terms."""
        wanted = [(q, t, n) for q, text in queries.items() for t, n in query_terms(text).items()]
        spark = self.postings.sparkSession
        terms = spark.createDataFrame(wanted, "query_id string, term string, times long")
        hits = self.postings.where(F.col("term").isin(sorted({t for _, t, _ in wanted}))) if len(wanted) <= 1000 else self.postings.join(F.broadcast(terms.select("term").distinct()), "term", "left_semi")
        docs = hits.groupBy("term").agg(F.count("*").alias("df"))  # a row a query term
        weight = idf(F.lit(self.n), F.col("df"))
        rows = hits.join(F.broadcast(docs), "term").join(self.sizes, "id")
        rows = rows.select("id", "term", (weight * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(self.average_length or 1.0)))).alias("part"))
        return rows.join(F.broadcast(terms), "term").groupBy("query_id", "id").agg(F.sum(F.col("times") * F.col("part")).alias("score"))


def query_terms(query: str) -> dict[str, int]:
    """The terms of a query and how often each is named."""
    return dict(Counter(stem(p) for w in T.identifier_list(query) for p in T.identifier_parts(w) if len(p) > 1))


def idf(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1.0)


def top(scored: DataFrame, k: int) -> DataFrame:
    """The k best by score, ties by id."""
    return scored.orderBy(F.desc("score"), "id").limit(k)
