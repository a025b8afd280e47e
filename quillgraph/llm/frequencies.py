"""Occurrences and records of every distinct value, by last-seen counters.

Rows are partitioned by value and ordered by record.  A counter per value then needs its occurrences, its records and
the record it saw last; no set of records is kept.  Hot values are spread over salts that are a function of the record,
so no record straddles two salts and the partial counters add up.

Defined results: null values are left out, blanks around a value are removed, an empty value counts as a value; rows
that repeat an id count once, rows with a null id count each; a null record is no record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 64
#: Blanks in any script (with (?U), \s is Unicode white space).
_EDGES = r"(?U)^[\s\p{Z}]+|[\s\p{Z}]+$"


def strip(c: Column | str) -> Column:
    return F.regexp_replace(c, _EDGES, "")


def value_counts(df: DataFrame, value: str, record: str, row_id: str, flag: Column, salts: int = SALTS) -> DataFrame:
    """(value, occurrences, records, flagged_records): flagged_records counts the records with a flagged row of the value."""
    rows = df.select(
        strip(value).alias("value"),
        F.col(record).alias("_rec"),
        F.col(row_id).alias("_row"),
        F.coalesce(flag, F.lit(False)).alias("_flag"),
    ).where(F.col("value").isNotNull())
    # rows without a record are spread by their own ids, so that they are no hot group
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64("_rec", F.when(F.col("_rec").isNull(), F.col("_row"))), F.lit(salts)))
    seen = Window.partitionBy("value", "_salt").orderBy(F.col("_rec").asc_nulls_first(), F.col("_flag").desc(), "_row")
    counted = rows.select(
        "value",
        "_salt",
        "_flag",
        (F.col("_row").isNull() | ~F.col("_row").eqNullSafe(F.lag("_row").over(seen)) | (F.row_number().over(seen) == 1)).alias("_new_row"),
        (F.col("_rec").isNotNull() & ~F.col("_rec").eqNullSafe(F.lag("_rec").over(seen))).alias("_new_rec"),
    )
    return counted.groupBy("value").agg(
        F.sum(F.col("_new_row").cast("long")).alias("occurrences"),
        F.sum(F.col("_new_rec").cast("long")).alias("records"),
        F.sum((F.col("_new_rec") & F.col("_flag")).cast("long")).alias("flagged_records"),
    )


def marked(counts: DataFrame, total_records: Column, common_share: float = 0.05) -> DataFrame:
    """Adds ``mark``: 'common' if flagged records reach the share of all records, else 'rare' if all rows are in one record, else null."""
    common = (F.col("flagged_records") > 0) & (F.col("flagged_records") >= common_share * total_records)
    return counts.withColumn("mark", F.when(common, "common").when(F.col("records") == 1, "rare"))


def distinct_records(df: DataFrame, record: str) -> Column:
    """The number of distinct records, as a scalar."""
    return df.agg(F.count_distinct(record)).scalar()
