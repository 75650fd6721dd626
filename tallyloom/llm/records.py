"""Postings in force with the rows of a record together, in one shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.skew import heavy_hitters
from tallyloom.sources.tables import current_rows, postings_in_force, valid_postings

#: Rows of a record from which on they are spread over tasks, if they are a thousandth of all rows too.
HOT_ROWS = 1 << 20


def postings_by_record(postings: DataFrame, hot_rows: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(docno, term, tf) in force of (term, docno, tf, written_at), in two tables.

    The first has the rows of a record in one partition, sorted by docno and term; windows and sorts by docno need no further shuffle there. The
    second has those of records with very many rows, spread over all tasks; None if there are none, as it mostly is.
    """
    hot = heavy_hitters(postings, "docno", HOT_ROWS if hot_rows is None else hot_rows)
    rest = postings.where(~F.col("docno").isin(hot)) if hot else postings
    together = valid_postings(rest).select("term", "docno", "tf", "written_at").repartition("docno")
    rows = current_rows(together, ["docno", "term"], "written_at", ["tf"])
    if not hot:
        return rows, None
    return rows, postings_in_force(postings.where(F.col("docno").isin(hot))).select("docno", "term", "tf")
