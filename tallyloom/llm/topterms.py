"""Most frequent items: exact sums, bounded memory, a local top k on every task.

Method: a spillable hash aggregate combines on the map side and again after the shuffle by item; each task keeps its
own k largest sums, and one ordered limit joins these.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.skew import at_least_share
from tallyloom.sources.tables import not_blank

LOW = (1 << 31) - 1


def valid_counts(counts: DataFrame, item: str = "term", count: str = "cell_count") -> DataFrame:
    """(item, n): rows with an item that is not blank and a count of at least 1; every other row counts for nothing."""
    return counts.select(F.col(item).alias("item"), F.col(count).cast("bigint").alias("n")).where(not_blank(F.col("item")) & (F.col("n") >= 1))


def _wide_sum(n: Column) -> Column:
    """Sum as decimal(38,0) in two halves: no overflow, and buffers of fixed width."""
    high, low = F.sum(F.shiftright(n, 31)), F.sum(n.bitwiseAND(F.lit(LOW)))
    return (high.cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(10,0)") + low.cast("decimal(20,0)")).cast("decimal(38,0)")


def item_totals(counts: DataFrame, item: str = "term", count: str = "cell_count") -> DataFrame:
    """(item, total) of all items, compared exactly; an empty table gives no rows."""
    return valid_counts(counts, item, count).groupBy("item").agg(_wide_sum(F.col("n")).alias("total"))


def top_items(counts: DataFrame, k: int, item: str = "term", count: str = "cell_count") -> DataFrame:
    """(item, total) of the ``k`` largest totals, equal ones by item; fewer if there are fewer items.

    No more than ``k`` rows of each task reach the last one.
    """
    return item_totals(counts, item, count).orderBy(F.desc("total"), "item").limit(k)


def heavy_items(counts: DataFrame, share: float, item: str = "term", count: str = "cell_count") -> DataFrame:
    """(item, total, share) of the items with at least ``share`` of the sum over all items, compared exactly (``at_least_share``).

    No more than 1/share items can have it, so they are among the top 1/share. The column ``share`` is a double, for display.
    """
    if not 0 < share <= 1:
        raise ValueError("share must be above 0 and at most 1")
    everything = valid_counts(counts, item, count).agg(_wide_sum(F.col("n")).alias("n")).scalar()
    top = top_items(counts, math.floor(1 / share + 1e-9), item, count)
    part = F.col("total").cast("double") / F.nullif(everything.cast("double"), F.lit(0.0))
    return top.where(at_least_share(F.col("total"), everything, share)).withColumn("share", part)
