"""Results per key when a few keys hold most of the rows.

Every result here is algebraic: a task folds its rows into one mergeable state for each key (Spark's
partial hash aggregate: a table of bounded memory that spills), and only these states are shuffled.
A key with a third of all rows reaches its final task as one state from each task, as any other key does.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.numbering import is_small
from tallyloom.session import cut

#: A key with at least this share of the rows is attached by broadcast; there can be 2,048 at most.
HOT_SHARE = 1 / 2048
#: Totals of at most so many kinds are broadcast.
FEW_KINDS = 10_000


def per_term(index: DataFrame) -> DataFrame:
    """(term, entries, tf): the number of documents and the sum of tf of each term.

    ``index`` (term, docno, tf) has each posting once, as ``postings_in_force`` gives it: it is spread by term
    and docno together, so the rows of a hot term lie in all tasks when they are folded.
    """
    return index.groupBy("term").agg(F.count(F.lit(1)).alias("entries"), F.sum("tf").alias("tf"))


def per_node(graph: DataFrame) -> DataFrame:
    """(node_id, entries, pointers): for each element of the lists how often it occurs and how many different
    nodes point to it.

    ``graph`` (node_id, nbrs) has each node once, so the first occurrence of an element in a sorted list stands
    for one pointing node: no distinct count is needed.
    """
    ordered = graph.select(F.sort_array("nbrs").alias("n"))
    first = F.expr("transform(n, (x, i) -> struct(x AS node_id, i = 0 OR n[greatest(i - 1, 0)] <> x AS first))")
    each = ordered.select(F.explode(first).alias("e")).select("e.node_id", "e.first")
    return each.groupBy("node_id").agg(F.count(F.lit(1)).alias("entries"), F.count(F.when(F.col("first"), 1)).alias("pointers"))


def at_least_share(part: Column, whole: Column, share: float) -> Column:
    """Whether ``part`` is at least ``share`` of ``whole``, both integers or decimals without fraction, compared exactly.

    ``share`` is taken as the nearest fraction with a denominator of at most 10**9, as 1/1000 for 0.001.
    """
    exact = Fraction(repr(float(share))).limit_denominator(10**9)
    return part.cast("decimal(29,0)") * F.lit(exact.denominator).cast("decimal(10,0)") >= whole.cast("decimal(29,0)") * F.lit(exact.numerator).cast("decimal(10,0)")


def heavy_keys(results: DataFrame, share: float, kind: str | None = None, entries: str = "entries") -> DataFrame:
    """The rows of ``results`` whose entries are at least ``share`` of the entries of all rows, or of all rows of one ``kind``.

    The per-key results are written once and read twice: for the totals and for the filter. No more than 1/share
    keys of a kind are left; the shares are compared exactly (``at_least_share``). No rows for an empty table.
    """
    results = cut(results.withColumn("_kind", F.col(kind) if kind else F.lit("")))
    totals = results.groupBy("_kind").agg(F.sum(F.col(entries).cast("decimal(20,0)")).alias("_total"))
    few = totals.limit(FEW_KINDS + 1).collect()
    if len(few) <= FEW_KINDS:
        totals = F.broadcast(totals.sparkSession.createDataFrame(few, totals.schema))
    return results.join(totals, "_kind").where(at_least_share(F.col(entries), F.col("_total"), share)).drop("_kind", "_total")


def heavy_hitters(rows: DataFrame, key: str, least: int) -> list:
    """Values of ``key`` that about ``least`` rows or more have, if these are a thousandth of all rows: 1,000 at most, without nulls.

    One mergeable sketch of bounded size for each task, and no shuffle of keys. It is approximate, so it may decide how a
    result is computed, never what it is.
    """
    sketch = F.expr(f"approx_top_k(`{key}`, 1000, 16384)")
    found = rows.where(F.col(f"`{key}`").isNotNull()).agg(sketch.alias("t")).first().t
    return [r["item"] for r in found or [] if r["count"] >= least]


def attach(rows: DataFrame, facts: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """``rows`` joined with written ``facts``, which has one row for each key and in ``count`` how many of the ``total`` rows have it.

    Keys with a noticeable share of the rows, a bounded number of them, come by broadcast, so that their rows stay where
    they are; the rest by a shuffle in which no key is large. Rows whose key has no facts are left out. Should the few
    hot keys not be small in bytes, all rows are shuffled, and splitting them is left to adaptive execution.
    """
    hot = F.col(count) >= total * HOT_SHARE
    if not is_small(facts.where(hot)):
        return rows.join(facts, key)
    names = [c for c in facts.columns if c != key]
    marked = rows.join(F.broadcast(facts.where(hot).withColumn("_hot", F.lit(True))), key, "left")
    done = marked.where("_hot").drop("_hot")
    rest = marked.where("_hot IS NULL").drop("_hot", *names).join(facts.where(~hot), key)
    return done.unionByName(rest)


def lookup(rows: DataFrame, facts: DataFrame, key: str, count: str, limit: int | None = None) -> DataFrame:
    """``attach`` for written ``facts``: broadcast as a whole if a count shows that they are small (``is_small``; ``limit``: rows)."""
    if is_small(facts, limit):
        return rows.join(F.broadcast(facts), key)
    return attach(rows, facts, key, count, facts.agg(F.sum(count)).first()[0])
