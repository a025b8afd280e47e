"""Readers for the Parquet tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One table of a data directory, stored as ``<root>/<name>.parquet`` (a file or a folder of part files)."""
    return spark.read.parquet(f"{root}/{name}.parquet")
