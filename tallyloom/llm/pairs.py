"""Items that appear together: how often, and how much more often than chance.

Method: every pair of a record becomes one packed 64-bit code. Tasks fill a buffer of codes, sort it, count
its runs and hand the sorted run on; Spark's external sort spills and merges the runs of a range
of codes; one pass over the merged codes counts equal neighbours (``operators.pairing``, which the core's own pair counts use too). Then come
the odds ratios with a continuity correction of one half in each cell, and the base-10 mutual information.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.tokens import tokens
from tallyloom.operators import pairing
from tallyloom.session import cut


def records_of_lines(lines: DataFrame) -> DataFrame:
    """(docno, items) of lines (docno, line): the tokens of each line."""
    return lines.select("docno", tokens(F.col("line")).alias("items"))


def item_pairs(records: DataFrame, min_count: int = 10, dictionary_items: int | None = None) -> DataFrame:
    """(x, y, pairs, x_records, y_records, records, pmi, log_odds) of the pairs in at least ``min_count`` records.

    ``records`` (docno, items) has one row for each docno; items are strings, repeats within a record count once, x < y by
    code points. Rows with a null docno are left out. ``records`` counts those with at least one item that is not null. Null and empty lists hold nothing, null items are ignored, an empty
    table gives no rows; other columns are ignored.
    ``pmi`` is log10(pairs * records / (x_records * y_records)); ``log_odds`` the natural logarithm of the odds ratio with one half added to each cell.

    A pair in ``min_count`` records has both items in as many, so rarer items are dropped before pairs are made. A very long record is
    cut into blocks whose pairs are made by different tasks; a dictionary that is not small (``dictionary_items``: its largest number of items) stays a
    table, and 2**31 items or more are counted as two numbers: no size is left out.
    """
    if min_count < 1:
        raise ValueError("min_count must be at least 1")
    held = pairing.written_records(records)
    frequent = cut(pairing.item_counts(held).where(F.col("n") >= min_count))
    named = pairing.count_pairs(held, frequent, min_count, dictionary_items).withColumnsRenamed({"x_n": "x_records", "y_n": "y_records"})
    total = held.where("k > 0").count()
    n, c, cx, cy = F.lit(float(total)), *(F.col(k).cast("double") for k in ("pairs", "x_records", "y_records"))
    half = F.lit(0.5)
    odds = (c + half) * (n - cx - cy + c + half) / ((cx - c + half) * (cy - c + half))
    return named.select(
        "x", "y", "pairs", "x_records", "y_records", F.lit(total).cast("bigint").alias("records"), F.log10(c * n / (cx * cy)).alias("pmi"), F.log(odds).alias("log_odds")
    )
