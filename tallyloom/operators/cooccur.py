"""Pairs of terms that share a line, and their pointwise mutual information."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyloom.functions.tokens import tokens
from tallyloom.operators import pairing
from tallyloom.operators.skew import lookup
from tallyloom.operators.wordcount import word_count
from tallyloom.session import cut

#: Partners of a term in one row of its stripe, about.
STRIPE_ITEMS = 65_536


def _records(lines: DataFrame, style: str) -> DataFrame:
    return pairing.written_records(lines.select("docno", tokens(F.col("line"), style).alias("items")))


def pair_counts(lines: DataFrame, min_count: int = 10, style: str = "java") -> DataFrame:
    """(x, y, pairs): x < y by code points and the number of lines that hold both, if at least ``min_count``.

    ``lines`` (docno, line) has one row for each docno; null and blank lines hold nothing, rows without a docno are left out. A pair can only reach ``min_count`` if both its
    terms do, so the others leave the lines before any pair is made.
    """
    held = _records(lines, style)
    frequent = cut(pairing.item_counts(held).where(F.col("n") >= min_count))
    return pairing.count_pairs(held, frequent, min_count).select("x", "y", "pairs")


def pmi(lines: DataFrame, min_count: int = 10, marginals: str = "df", style: str = "java") -> DataFrame:
    """(x, y, pairs, pmi): log10 of how much more often a pair shares a line than chance would have it.

    ``marginals``: "df" takes the number of lines that hold a term, "cf" the number of its occurrences. The number
    of lines counts all lines with a docno, blank ones too.
    """
    if marginals not in ("df", "cf"):
        raise ValueError(f"marginals must be df or cf, not {marginals!r}")
    held = _records(lines, style)
    frequent = pairing.item_counts(held).where(F.col("n") >= min_count)
    if marginals == "cf":
        # a term is in min_count lines only if it occurs as often
        occurrences = word_count(lines, style).select(F.col("term").alias("item"), F.col("count").alias("n")).where(F.col("n") >= min_count)
        frequent = frequent.select("item").join(occurrences, "item")
    total = held.agg(F.count(F.lit(1)).cast("double").alias("n")).scalar()
    both = pairing.count_pairs(held, cut(frequent), min_count)
    return both.select("x", "y", "pairs", F.log10((F.col("pairs") / total) / ((F.col("x_n") / total) * (F.col("y_n") / total))).alias("pmi"))


def stripes(scored: DataFrame, value: str = "pmi", items: int = STRIPE_ITEMS) -> DataFrame:
    """(x, block, stripe): for each left term maps from right term to value.

    A term with more than ``items`` partners has several blocks, over which a hash of the right term spreads them, so that no
    row holds all partners of a term however many there are.
    """
    scored = cut(scored.select("x", "y", value))
    partners = cut(scored.groupBy("x").agg(F.count(F.lit(1)).alias("n")))
    if (partners.agg(F.max("n")).first()[0] or 0) <= items:
        placed = scored.withColumn("block", F.lit(0).cast("bigint"))
    else:
        blocks = F.ceil(F.col("n") / F.lit(items)).cast("bigint")
        placed = lookup(scored, partners, "x", "n").withColumn("block", F.pmod(F.xxhash64("y"), blocks))
    return placed.groupBy("x", "block").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("y", value)))).alias("stripe"))


def top_pair(scored: DataFrame, digits: int = 6) -> DataFrame:
    """The one pair of highest PMI; of equal ones the greatest (x, y)."""
    rounded = scored.withColumn("pmi", F.round("pmi", digits))
    return rounded.orderBy(F.desc("pmi"), F.desc("x"), F.desc("y")).limit(1)


def top_partners(scored: DataFrame, words: list[str], n: int = 3, digits: int = 6) -> DataFrame:
    """(term, rank, x, y, pmi): the ``n`` pairs of highest PMI that hold each of ``words``; equal ones by x, y."""
    rounded = scored.withColumn("pmi", F.round("pmi", digits))
    sides = F.array_distinct(F.filter(F.array("x", "y"), lambda t: t.isin(*words)))
    held = rounded.where(F.col("x").isin(*words) | F.col("y").isin(*words)).withColumn("term", F.explode(sides))
    order = Window.partitionBy("term").orderBy(F.desc("pmi"), "x", "y")
    return held.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select("term", "rank", "x", "y", "pmi")
