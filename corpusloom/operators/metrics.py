"""Snapshots of metrics over time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LAST = 50
PARTS = 32


def retained(snapshots: DataFrame, key: str, at: str, tie: str, last: int = LAST) -> DataFrame:
    """The ``last`` snapshots of each key by time, then by the larger ``tie``.

    They are cut in salted parts of a key first, so that a key of very many
    snapshots is never sorted in one task.
    """
    order = (F.desc(at), F.desc(tie))
    part = F.pmod(F.xxhash64(tie), F.lit(PARTS))
    few = snapshots.withColumn("_n", F.row_number().over(Window.partitionBy(key, part).orderBy(*order))).filter(F.col("_n") <= last)
    return few.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("_n") <= last).drop("_n")


def trend(snapshots: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """(key, day, n, mean, change): daily means of positive values of each key and their change to the day before that has any."""
    daily = snapshots.filter(F.col(value) > 0).groupBy(key, F.to_date(at).alias("day")).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))
    return daily.withColumn("change", F.col("mean") - F.lag("mean").over(Window.partitionBy(key).orderBy("day")))


def pattern_adoption(files: DataFrame, pattern: str) -> DataFrame:
    """(repo, month, files, matching): live files with content by month of their scan, and those that hold the literal pattern.

    ``files`` is ``live_files(files, "content", "scanned_at")``.
    """
    rows = files.filter("content is not null and scanned_at is not null")
    return rows.groupBy("repo", F.date_format("scanned_at", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("content").contains(pattern)).alias("matching"))
