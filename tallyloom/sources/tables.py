"""Parquet tables and the rows that are in force in them.

Of several rows with one key the newest counts; of rows with one key and one time the one with the
greatest values does, so that the outcome never depends on the order of rows. A row without a time is older than
any row with one. Columns beyond those named are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate tokens: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \\t\\n\\x0B\\f\\r"


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def current_rows(df: DataFrame, keys: Sequence[str], newest: str, values: Sequence[str]) -> DataFrame:
    """One row for each key: keys and ``values`` of its newest row. Rows with a null key are dropped.

    One algebraic maximum, so that a key with very many versions is reduced before the shuffle.
    """
    kept = df.select(*keys, newest, *values).dropna(subset=list(keys))
    best = kept.groupBy(*keys).agg(F.max(F.struct(newest, *values)).alias("_best"))
    return best.select(*keys, *[F.col("_best")[v].alias(v) for v in values])


def not_blank(term: Column) -> Column:
    """Whether a term has any character besides blanks; null for null."""
    return term.rlike(f"[^{BLANKS}]")


def lines_in_force(passages: DataFrame) -> DataFrame:
    """(docno, line) in force, without those whose line in force is null."""
    return current_rows(passages, ["docno"], "loaded_at", ["line"]).where("line IS NOT NULL")


def valid_postings(postings: DataFrame) -> DataFrame:
    """Rows that are postings at all: a term that is not blank, a docno, and a tf of at least 1."""
    return postings.where(not_blank(F.col("term")) & F.col("docno").isNotNull() & (F.col("tf") >= 1))


def postings_in_force(postings: DataFrame) -> DataFrame:
    """(term, docno, tf) in force."""
    return current_rows(valid_postings(postings), ["term", "docno"], "written_at", ["tf"])


def lists_in_force(adjacency: DataFrame) -> DataFrame:
    """(node_id, nbrs) in force; ``nbrs`` without null elements, empty where the node is dangling."""
    rows = current_rows(adjacency, ["node_id"], "crawled_at", ["nbrs"])
    return rows.select("node_id", F.coalesce(F.filter("nbrs", lambda x: x.isNotNull()), F.expr("array()").cast("array<bigint>")).alias("nbrs"))


def ranks_in_force(page_ranks: DataFrame) -> DataFrame:
    """(source_id, node_id, pr) in force, without pairs whose rank in force is null or NaN.

    Of two ranks of one iteration the greater counts, and any number counts over null and NaN.
    Minus zero is zero.
    """
    clean = page_ranks.withColumn("pr", F.when(~F.isnan("pr"), F.col("pr") + F.lit(0.0)))
    return current_rows(clean, ["source_id", "node_id"], "iteration", ["pr"]).where("pr IS NOT NULL")
