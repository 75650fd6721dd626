"""Boolean retrieval over postings by postfix queries of terms, AND and OR."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.postfix import OPERATORS, compile_postfix, parse_postfix


def matches(index: DataFrame, query: str) -> DataFrame:
    """(docno) of the documents that satisfy ``query``; an unknown term matches none.

    Only postings of the query's terms leave the scan; one aggregate turns them into a flag per
    term and document, and the whole query is one predicate over the flags.
    """
    items = parse_postfix(query)
    words = list(dict.fromkeys(i for i in items if i not in OPERATORS))
    flags = {w: f"has_{k}" for k, w in enumerate(words)}
    seen = index.where(F.col("term").isin(*words)).groupBy("docno").agg(*[F.max(F.col("term") == F.lit(w)).alias(flags[w]) for w in words])
    return seen.where(compile_postfix(items, lambda w: F.col(flags[w]))).select("docno")


def retrieve(index: DataFrame, lines: DataFrame, query: str, snippet: int | None = None) -> DataFrame:
    """(docno, line) of the matches, the line cut to its first ``snippet`` characters if that is given."""
    text = F.col("line") if snippet is None else F.substring("line", 1, snippet)
    return matches(index, query).join(lines.select("docno", text.alias("line")), "docno")
