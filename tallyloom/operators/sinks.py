"""Sinks: text, columnar files, sorted indexes, tables. All but one overwrite what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_text(df: DataFrame, path: str, sep: str = "\t") -> None:
    """One line for each row, columns separated by ``sep``; null is the empty string."""
    columns = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]
    df.select(F.concat_ws(sep, *columns).alias("value")).write.mode("overwrite").text(path)


def write_columnar(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_sorted(df: DataFrame, path: str, key: str, *then: str) -> None:
    """Files with disjoint, sorted ranges of ``key``: a filter on it reads few row groups."""
    df.repartitionByRange(key, *then).sortWithinPartitions(key, *then).write.mode("overwrite").parquet(path)


def write_table(df: DataFrame, name: str, key: str | None = None, buckets: int = 16, path: str | None = None) -> None:
    """A table, replaced if it exists; with ``key`` bucketed and sorted by it, for point reads and joins. ``path``: where its files go, if not to the warehouse."""
    writer = df.write.mode("overwrite").format("parquet")
    if key:
        writer = writer.bucketBy(buckets, key).sortBy(key)
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(name)


def write_key_values(df: DataFrame, path: str) -> None:
    """Two columns without nulls as Hadoop sequence files, for readers that know no columnar files. Fails if ``path`` exists."""
    df.rdd.map(tuple).saveAsSequenceFile(path)
