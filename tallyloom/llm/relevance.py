"""How distinctive a term is of a record: probabilistic relevance weighting (BM25) and tf-idf.

Method: term frequencies saturate, lengths of records are normalised by the average, and a term weighs by how few
records hold it. Collection frequencies, lengths and the average cover all records.

One shuffle brings the postings of a record together; there its rows in force, its length and its first row are found, and the whole is
written once. Frequencies of terms come by broadcast where a count shows that they are small; else those of terms with a noticeable
share of all rows, a bounded number of them, by broadcast, and the rest by a shuffle in which no key is large.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyloom.llm.records import postings_by_record
from tallyloom.operators.skew import lookup
from tallyloom.session import cut


def _index(postings: DataFrame, lengths: bool) -> DataFrame:
    """(docno, term, tf, first) and, if asked for, doc_length: ``first`` marks one row of each record; written."""
    rows, hot = postings_by_record(postings)
    record = Window.partitionBy("docno")
    index = rows.withColumn("first", F.row_number().over(record.orderBy("term")) == 1)
    if lengths:
        index = index.withColumn("doc_length", F.sum("tf").over(record))
    if hot is not None:
        hot = cut(hot)
        whole = hot.groupBy("docno").agg(F.min("term").alias("least"), F.sum("tf").alias("doc_length"))
        more = hot.join(F.broadcast(whole), "docno").withColumn("first", F.col("term") == F.col("least"))
        index = index.unionByName(more.select(*index.columns))
    return cut(index)


def _scored(postings: DataFrame, lengths: bool) -> tuple[DataFrame, int, float]:
    """Postings in force with df, the number of records, and the average length of a record."""
    index = _index(postings, lengths)
    counted = index.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.count(F.when(F.col("first"), 1)).alias("records"), F.sum(F.col("tf").cast("double")).alias("tokens"))
    frequencies = cut(counted)
    whole = frequencies.agg(F.coalesce(F.sum("records"), F.lit(0)).alias("n"), F.sum("tokens").alias("tokens")).first()
    return lookup(index.drop("first"), frequencies.select("term", "df"), "term", "df"), whole.n, (whole.tokens or 0.0) / max(whole.n, 1) or 1.0


def score_terms(postings: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(docno, term, tf, df, doc_length, records, bm25, tf_idf) of each posting in force of (term, docno, tf, written_at).

    ``bm25`` = ln(1 + (N - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / average)); never negative.
    ``tf_idf`` = tf * log10(N / df). ``doc_length`` is the sum of tf of a record, N the number of records. Rows
    that are no posting are left out; an empty table gives no rows.
    """
    joined, records, average = _scored(postings, True)
    n, df, tf = F.lit(float(records)), F.col("df"), F.col("tf")
    idf = F.log1p((n - df + 0.5) / (df + 0.5))
    norm = F.lit(k1) * (F.lit(1 - b) + F.lit(b) * F.col("doc_length") / F.lit(average))
    return joined.select(
        "docno", "term", "tf", "df", "doc_length", F.lit(records).cast("bigint").alias("records"), (idf * tf * F.lit(k1 + 1) / (tf + norm)).alias("bm25"), (tf * F.log10(n / df)).alias("tf_idf")
    )


def tf_idf(postings: DataFrame) -> DataFrame:
    """(docno, term, tf, df, records, tf_idf): the ``tf_idf`` of ``score_terms``, without the lengths of records, which it does not need."""
    joined, records, _ = _scored(postings, False)
    score = F.col("tf") * F.log10(F.lit(float(records)) / F.col("df"))
    return joined.select("docno", "term", "tf", "df", F.lit(records).cast("bigint").alias("records"), score.alias("tf_idf"))


def leading_terms(scored: DataFrame, margin: float, score: str = "tf_idf") -> DataFrame:
    """(docno, term): the term of highest score of a record with at least two terms, if that is above 0 and at
    least ``margin`` times the second highest.

    Spark keeps the two best rows of a record on each task before it shuffles, so no record is gathered whole.
    """
    order = Window.partitionBy("docno").orderBy(F.desc(score), "term")
    two = scored.select("docno", "term", score).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= 2)
    best = two.groupBy("docno").agg(
        F.max(F.when(F.col("rank") == 1, F.col("term"))).alias("term"),
        F.max(F.when(F.col("rank") == 1, F.col(score))).alias("first"),
        F.max(F.when(F.col("rank") == 2, F.col(score))).alias("second"),
    )
    return best.where((F.col("first") > 0) & F.col("second").isNotNull() & (F.col("first") >= F.lit(margin) * F.col("second"))).select("docno", "term")
