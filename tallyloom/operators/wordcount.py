"""Token counts.

All of them are algebraic aggregates: Spark combines on the map side, spills when the hash table is full, and only
partial counts are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.tokens import alphabetic, tokens


def terms(lines: DataFrame, style: str = "java") -> DataFrame:
    """(term): each token of each line. Null, empty and blank lines have none."""
    return lines.select(F.explode(tokens(F.col("line"), style)).alias("term"))


def word_count(lines: DataFrame, style: str = "java", only_alphabetic: bool = False) -> DataFrame:
    """(term, count) over all lines; an empty collection gives no rows."""
    found = terms(lines, style)
    if only_alphabetic:
        found = found.where(alphabetic(F.col("term")))
    return found.groupBy("term").agg(F.count(F.lit(1)).alias("count"))


def line_frequency(lines: DataFrame, style: str = "java") -> DataFrame:
    """(term, df): the number of lines that hold the term, repeats within a line counted once."""
    return lines.select(F.explode(F.array_distinct(tokens(F.col("line"), style))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def vocabulary_sizes(lines: DataFrame, style: str = "java") -> DataFrame:
    """One row: number of different terms, of alphabetic ones, and of tokens."""
    counts = word_count(lines, style)
    return counts.agg(
        F.count(F.lit(1)).alias("terms"),
        F.count(F.when(alphabetic(F.col("term")), 1)).alias("alphabetic_terms"),
        F.coalesce(F.sum("count"), F.lit(0)).alias("tokens"),
    )


def fetch(counts: DataFrame, words: list[str], value: str = "count") -> DataFrame:
    """(term, value) for each of ``words``, 0 where the term is unknown; a repeated word is one row.

    The filter on the term reaches the scan of a stored table.
    """
    spark = counts.sparkSession
    wanted = spark.createDataFrame([(w,) for w in dict.fromkeys(words)], "term string")
    found = counts.where(F.col("term").isin(*words)).select("term", value)
    return wanted.join(found, "term", "left").select("term", F.coalesce(F.col(value), F.lit(0).cast("bigint")).alias(value))


