"""Rows that repeat an id, told apart without moving their texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.session import materialize


def kept_rows(df: DataFrame, id_col: str, text_col: str, name: str = "records") -> tuple[DataFrame, DataFrame]:
    """(rows (_id, _text, _copies), ids (_id)): of each id the rows with one text, and how many they are.

    Counting over the rows and dividing by ``_copies`` counts each id once.  Repeated ids are found by hashes of their texts;
    only if they are too many to be broadcast, by the optimizer's measure, does the join move texts.  Null ids are left out;
    of different texts under one id the one with the least hash is kept.
    """
    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.xxhash64(text_col).alias("_h"))
    seen = rows.groupBy("_id", "_h").agg(F.count("*").alias("_n")).groupBy("_id").agg(F.min(F.struct("_h", "_n")).alias("_k"), F.sum("_n").alias("_all"))
    seen = materialize(seen.select("_id", F.col("_k._h").alias("_keep"), F.col("_k._n").alias("_copies"), "_all"), name)
    repeated = materialize(seen.where("_all > 1").drop("_all"), f"{name}-repeated")
    kept = rows.join(repeated, "_id", "left").where(F.col("_keep").isNull() | (F.col("_h") == F.col("_keep")))
    return kept.select("_id", "_text", F.coalesce("_copies", F.lit(1)).alias("_copies")), seen.select("_id")
