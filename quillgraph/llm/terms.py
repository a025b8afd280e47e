"""Log-entropy term weights: how characteristic a term is of one record.

weight(record, term) = ln(1 + tf) * (1 - H(term) / ln N), where H is the entropy of the term's spread over the N
records.  With gf the term's total frequency, H = ln gf - sum(tf * ln tf) / gf, so a term needs three sums and no
second pass: one aggregation by (record, term), written once, and one by term.

Defined results: records with a null id are left out; of a repeated id the text with the least hash counts, once; null,
empty and term-free texts give no rows but count in N; with N < 2 the entropy part is 1.  Extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.operators.repeats import kept_rows
from quillgraph.session import materialize

#: Maximal runs of four or more ASCII letters.
TERM_PATTERN = "[A-Za-z]{4,}"
#: What sums of logarithms may differ by.
SLACK = 1e-9


def row_terms(text: str, pattern: str = TERM_PATTERN) -> Column:
    """The terms of a row with their counts (array of structs term, tf), found within the row.

    The words are sorted and put together, so that a term's uses stand side by side; each run of one is a match, and its
    length tells how many there are.
    """
    words = F.split(F.lower(F.array_join(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), " ")), " ")
    line = F.concat(F.array_join(F.array_sort(words), " "), F.lit(" "))
    runs = F.regexp_extract_all(line, F.lit(r"([a-z]+ )\1*+"), F.lit(0))
    return F.transform(runs, lambda r: F.struct(F.substring_index(r, " ", 1).alias("term"), (F.char_length(r) / (F.instr(r, " "))).cast("long").alias("tf")))


def term_counts(rows: DataFrame, pattern: str = TERM_PATTERN) -> DataFrame:
    """(_id, term, tf), written: every later step reads it, and no text is read again.

    A row's counts need no other row, so nothing is shuffled but the counts of repeated ids, of which one copy is kept.
    """
    flat = rows.select("_id", "_copies", F.explode(row_terms("_text", pattern)).alias("t")).select("_id", "_copies", "t.*")
    once = flat.where("_copies = 1").select("_id", "term", "tf")
    again = flat.where("_copies > 1").groupBy("_id", "term").agg(F.max("tf").alias("tf"))
    return materialize(once.unionByName(again), "p1-counts")


def term_stats(counts: DataFrame) -> DataFrame:
    """(term, df, gf, tlt): records, occurrences and sum(tf ln tf) of each term."""
    return counts.groupBy("term").agg(
        F.count("*").alias("df"),
        F.sum("tf").alias("gf"),
        F.sum(F.col("tf") * F.log("tf")).alias("tlt"),
    )


def global_weight(n: Column | int) -> Column:
    """1 - H / ln N, kept within [0, 1]."""
    h = F.log("gf") - F.col("tlt") / F.col("gf")
    n = F.lit(n) if isinstance(n, int) else n
    return F.when(n < 2, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - h / F.log(n.cast("double")))))


def log_entropy(df: DataFrame, id_col: str, text_col: str, min_weight: float | None = None) -> DataFrame:
    """(id, term, tf, df, weight) of every term of every record, or of those that weigh at least ``min_weight``.

    As no term weighs more than ln(1 + tf), rows below ``min_weight`` by that bound are left out before the join by
    term.  The statistics side has one row a term, so adaptive execution can split the other side at a hot term.
    """
    rows, ids = kept_rows(df, id_col, text_col, "p1-records")
    n = ids.count()
    counts = term_counts(rows)
    able = counts if min_weight is None else counts.where(F.log(1.0 + F.col("tf")) >= min_weight - SLACK)
    out = able.join(term_stats(counts), "term").select(F.col("_id").alias(id_col), "term", "tf", "df", (F.log(1.0 + F.col("tf")) * global_weight(n)).alias("weight"))
    return out if min_weight is None else out.where(F.col("weight") >= min_weight - SLACK)


def least_weight(tf: int, df: int, n: int) -> float:
    """The least weight of a term with ``tf`` uses in a record and ``df`` records among ``n``: its entropy is at most ln df."""
    return math.log(1 + tf) * (1.0 if n < 2 else max(0.0, 1 - math.log(max(df, 1)) / math.log(n)))
