"""Inverted index: long postings, lists, gaps, look-up and histogram.

The long form (term, docno, tf) is the index proper: it has no rows that grow with a term's
frequency. Lists are cut into blocks of docnos, so that no row grows with it either.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyloom.functions.codec import decode_postings, encode_postings
from tallyloom.functions.tokens import tokens
from tallyloom.session import ship

BLOCK_BITS = 16
GAP_BITS = 24


def postings(lines: DataFrame, style: str = "blanks") -> DataFrame:
    """(term, docno, tf): occurrences of each term in each document. Lines without a docno are left out."""
    found = lines.where("docno IS NOT NULL").select("docno", F.explode(tokens(F.col("line"), style)).alias("term"))
    return found.groupBy("term", "docno").agg(F.count(F.lit(1)).alias("tf"))


def document_frequency(index: DataFrame) -> DataFrame:
    """(term, df, cf): documents that hold the term, and its occurrences."""
    return index.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def _block() -> Column:
    return F.shiftright("docno", BLOCK_BITS)


def postings_lists(index: DataFrame) -> DataFrame:
    """(term, block, docs, postings): lists in the order of docno, one for each term and block of 65,536 docnos.

    The list of a term in very many documents is never whole in one row or task; its df is the sum of ``docs``.
    """
    lists = index.groupBy("term", _block().alias("block")).agg(F.sort_array(F.collect_list(F.struct("docno", "tf"))).alias("postings"))
    return lists.select("term", "block", F.size("postings").cast("bigint").alias("docs"), "postings")


def gaps(index: DataFrame) -> DataFrame:
    """(term, docno, gap, tf): distance to the term's previous docno, for the first one the docno itself.

    Sorting is by term and block of 16 million docnos, so a hot term is spread; the last docno before a block comes from one row for each block, of
    which even a term in every line of 100 TB, docnos being byte offsets, has only some 6 million.
    """
    block = F.shiftright("docno", GAP_BITS).alias("block")
    blocks = index.groupBy("term", block).agg(F.max("docno").alias("last"))
    before = blocks.select("term", "block", F.lag("last", 1, 0).over(Window.partitionBy("term").orderBy("block")).alias("before"))
    inside = Window.partitionBy("term", "block").orderBy("docno")
    rows = index.select("term", "docno", "tf", block).withColumn("previous", F.lag("docno").over(inside))
    return rows.join(before, ["term", "block"]).select("term", "docno", (F.col("docno") - F.coalesce("previous", "before")).alias("gap"), "tf")


def compressed(index: DataFrame) -> DataFrame:
    """(term, block, docs, data): each list as variable-length bytes of its gaps, counted from the block's begin, and counts."""
    ship(index.sparkSession)
    lists = postings_lists(index)
    begin = F.shiftleft("block", BLOCK_BITS)
    return lists.select("term", "block", "docs", encode_postings(begin, F.col("postings.docno"), F.col("postings.tf")).alias("data"))


def decompressed(data: DataFrame) -> DataFrame:
    """(term, docno, tf) of ``compressed``."""
    ship(data.sparkSession)
    begin = F.shiftleft("block", BLOCK_BITS)
    lists = data.select("term", decode_postings(begin, F.col("data")).alias("p"))
    pairs = F.arrays_zip(F.col("p.docno").alias("docno"), F.col("p.tf").alias("tf"))
    return lists.select("term", F.inline(pairs))


def lookup(index: DataFrame, term: str) -> DataFrame:
    """(docno, tf) of one term by docno; no rows for an unknown term. The filter reaches the scan of a stored index."""
    return index.where(F.col("term") == F.lit(term)).select("docno", "tf").orderBy("docno")


def tf_histogram(index: DataFrame, words: list[str]) -> DataFrame:
    """(term, tf, docs): for each of ``words``, how many documents hold it how often."""
    return index.where(F.col("term").isin(*words)).groupBy("term", "tf").agg(F.count(F.lit(1)).alias("docs"))
