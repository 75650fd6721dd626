"""Counts per hour of day and calendar day, with filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse_post_date(text: Column) -> Column:
    """UTC timestamp of dates like ``Sun Jan 23 00:05:09 -0500 2011``; null if it cannot be read.

    The day's name is skipped: Spark's parser takes none, and it carries nothing.
    """
    return F.try_to_timestamp(F.substring(F.trim(text), 5, 100), F.lit("MMM d HH:mm:ss Z yyyy"))


def hourly_counts(events: DataFrame, ts: str = "ts") -> DataFrame:
    """(md, h, count): events per month/day (``1/23``) and two-digit hour. Rows without a time are dropped."""
    timed = events.where(F.col(ts).isNotNull())
    md = F.concat_ws("/", F.month(ts), F.dayofmonth(ts))
    return timed.groupBy(md.alias("md"), F.lpad(F.hour(ts).cast("string"), 2, "0").alias("h")).agg(F.count(F.lit(1)).alias("count"))


def filtered_hourly_counts(events: DataFrame, pattern: str, column: str, ts: str = "ts") -> DataFrame:
    """``hourly_counts`` of the rows whose ``column`` contains a match of ``pattern``."""
    return hourly_counts(events.where(F.col(column).rlike(pattern)), ts)


def complete_rows(events: DataFrame, columns: list[str]) -> DataFrame:
    """Rows without a null in any of ``columns``."""
    return events.dropna(subset=columns)


def hourly_posts(posts: DataFrame, pattern: str | None = None) -> DataFrame:
    """(md, h, count) of posts (post_id, user_id, date, text) by their UTC hour; unreadable dates are dropped."""
    kept = posts.dropna(subset=["post_id", "user_id", "date", "text"])
    if pattern:
        kept = kept.where(F.col("text").rlike(pattern))
    return hourly_counts(kept.select(parse_post_date(F.col("date")).alias("ts")))


def ordered(counts: DataFrame) -> DataFrame:
    """Counts in the order of their text, first md then h, over all partitions: ``1/23`` stands before ``1/4``."""
    return counts.orderBy("md", "h")
