"""Pairs within groups of a bounded size, and exact block pairs for groups beyond it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sized(members: DataFrame, key: str) -> DataFrame:
    """(key, n) of groups with at least two members; counted with a map-side combine, so a hot key costs no task its rows."""
    return members.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def within_limit(members: DataFrame, sizes: DataFrame, key: str, limit: int) -> DataFrame:
    return members.join(sizes.where(F.col("n") <= limit).select(key), key)


def beyond_limit(members: DataFrame, sizes: DataFrame, key: str, limit: int) -> DataFrame:
    return members.join(sizes.where(F.col("n") > limit), key)


def listed(members: DataFrame, key: str, member: str) -> DataFrame:
    """(members): the sorted members of each group; only for groups within the limit."""
    return members.groupBy(key).agg(F.array_sort(F.collect_set(member)).alias("members"))


def pairs(lists: DataFrame) -> DataFrame:
    """(a, b), a before b, of every list of ``members``."""
    first = lists.select(F.posexplode("members").alias("_i", "a"), "members")
    rest = F.slice("members", F.col("_i") + 2, F.greatest(F.size("members"), F.lit(1)))
    return first.select("a", F.explode(rest).alias("b"))


def block_pairs(big: DataFrame, key: str, member: str, limit: int) -> DataFrame:
    """Every pair of the groups in ``big`` (which has the group's size as ``n``), exactly, by blocks of about ``limit`` members.

    A group of n members becomes n / limit blocks; each task meets one pair of blocks, whatever the group's size.
    """
    b = big.select(key, member, F.ceil(F.col("n") / limit).alias("_nb")).withColumn("_b", F.pmod(F.xxhash64(member), F.col("_nb")))
    left = b.select(key, F.col(member).alias("a"), F.col("_b").alias("_x"), F.explode(F.sequence(F.col("_b"), F.col("_nb") - 1)).alias("_y"))
    right = b.select(key, F.col(member).alias("b"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_b"))).alias("_x"), F.col("_b").alias("_y"))
    met = left.join(right, [key, "_x", "_y"]).where((F.col("a") < F.col("b")) | ((F.col("a") > F.col("b")) & (F.col("_x") != F.col("_y"))))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
