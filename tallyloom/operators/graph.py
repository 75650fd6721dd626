"""Personalized PageRank for several sources at once, top nodes, weak components.

A graph is (node_id, nbrs) with one row for each node: ``lists_in_force`` gives one. Repeated
neighbours count repeatedly, neighbours without a row of their own are no nodes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyloom.operators.skew import lookup
from tallyloom.session import cut, discard, scratch

#: Of so many edges even one node may have all: only beyond are hot nodes looked for.
FEW_EDGES = 1 << 20


def graph_counters(graph: DataFrame) -> DataFrame:
    """One row: nodes, edges, nodes with an out-edge, dangling nodes."""
    degree = F.size("nbrs").cast("bigint")
    return graph.agg(
        F.count(F.lit(1)).alias("nodes"),
        F.coalesce(F.sum(degree), F.lit(0)).alias("edges"),
        F.count(F.when(degree > 0, 1)).alias("active_nodes"),
        F.count(F.when(degree == 0, 1)).alias("dangling_nodes"),
    )


def require_unique_nodes(graph: DataFrame) -> DataFrame:
    """``graph`` itself, if no node has two rows; else ValueError."""
    twice = graph.groupBy("node_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(5).collect()
    if twice:
        raise ValueError(f"nodes with several rows, such as {[r.node_id for r in twice]}")
    return graph


def message_counters(graph: DataFrame) -> DataFrame:
    """One row about a round of PageRank: shares sent, nodes and unknown ids that get any, shares lost to unknown ids."""
    sent = graph.select(F.explode("nbrs").alias("node_id")).groupBy("node_id").agg(F.count(F.lit(1)).alias("n"))
    known = sent.join(graph.select("node_id", F.lit(True).alias("known")), "node_id", "left")
    return known.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("messages"),
        F.count("known").alias("receivers"),
        F.count(F.when(F.col("known").isNull(), 1)).alias("missing_nodes"),
        F.coalesce(F.sum(F.when(F.col("known").isNull(), F.col("n"))), F.lit(0)).alias("lost_messages"),
    )


def dangling(graph: DataFrame) -> DataFrame:
    """(node_id) of the nodes without out-edges."""
    return graph.where(F.size("nbrs") == 0).select("node_id")


def initial_ranks(graph: DataFrame, sources: Sequence[int]) -> DataFrame:
    """(node_id, source_id, pr) of every node and source: 1 where a node is its source, else 0."""
    if len(set(sources)) != len(sources):
        raise ValueError("sources must differ")
    each = F.explode(F.array(*[F.lit(int(s)) for s in sources]).cast("array<bigint>"))
    return graph.select("node_id", each.alias("source_id")).withColumn("pr", F.when(F.col("node_id") == F.col("source_id"), 1.0).otherwise(0.0))


def spread(graph: DataFrame, ranks: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """(node_id, source_id, mass): what each node sends along its list, summed where it arrives. ``seeds`` have a row even if nothing does.

    Lists and ranks are joined by node, where both sides hold a key once for each source, so no key
    is hot there; a node that many point to is summed on the map side first.
    """
    lists = graph.where(F.size("nbrs") > 0).select("node_id", "nbrs")
    sent = ranks.where("pr > 0").select("node_id", "source_id", "pr").join(lists, "node_id")
    moved = sent.select(F.explode("nbrs").alias("node_id"), "source_id", (F.col("pr") / F.size("nbrs")).alias("share"))
    if seeds is not None:
        moved = moved.unionByName(seeds.withColumn("share", F.lit(0.0)))
    return moved.groupBy("node_id", "source_id").agg(F.sum("share").alias("mass"))


def arrived(graph: DataFrame, ranks: DataFrame) -> DataFrame:
    """(node_id, source_id, mass) for every row of ``ranks``, 0 where nothing arrives: mass sent to no node is lost here."""
    return ranks.select("node_id", "source_id").join(spread(graph, ranks), ["node_id", "source_id"], "left").select(
        "node_id", "source_id", F.coalesce("mass", F.lit(0.0)).alias("mass")
    )


def missing_mass(mass: DataFrame) -> DataFrame:
    """(source_id, missing): what dangling nodes and unknown neighbours lost, never below 0."""
    return mass.groupBy("source_id").agg(F.greatest(F.lit(0.0), F.lit(1.0) - F.sum("mass")).alias("missing"))


def _seeds(graph: DataFrame, sources: Sequence[int]) -> DataFrame:
    """(node_id, source_id) of the sources that are nodes; there are no more than the caller named."""
    if len(set(sources)) != len(sources):
        raise ValueError("sources must differ")
    named = graph.sparkSession.createDataFrame([(int(s), int(s)) for s in sources], "node_id bigint, source_id bigint")
    return cut(graph.select("node_id").join(F.broadcast(named), "node_id"))


def _reached(graph: DataFrame, ranks: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node_id, source_id, mass) where any mass arrives, and of the sources; nodes that a source does not reach have no row."""
    return spread(graph, ranks, seeds).join(graph.select("node_id"), "node_id")


def _next_ranks(mass: DataFrame, sources: Sequence[int], jump: float) -> DataFrame:
    """Ranks after a round. The lost mass is one row a source, joined by broadcast: the caller named the sources."""
    lost = missing_mass(mass)
    restart = jump + (1 - jump) * (F.col("mass") + F.col("missing"))
    rank = F.when(F.col("node_id") == F.col("source_id"), restart).otherwise((1 - jump) * F.col("mass"))
    return mass.join(F.broadcast(lost), "source_id").select("node_id", "source_id", rank.alias("pr"))


def personalized_pagerank(graph: DataFrame, sources: Sequence[int], iterations: int = 20, jump: float = 0.15) -> DataFrame:
    """(node_id, source_id, pr) of every node and source after ``iterations``; the ranks of a source sum to 1.

    The random jump and the lost mass return to the source. A source that is no node gets no mass at all. The rounds hold rows only
    for nodes that a source has reached; the zeros come at the end. Each
    round is written to the shared folder: the plan stays short and a lost executor costs one round.
    """
    graph = cut(graph.select("node_id", "nbrs"))
    seeds = _seeds(graph, sources)
    ranks = seeds.withColumn("pr", F.lit(1.0))
    older = last = None
    for _ in range(iterations):
        mass = cut(_reached(graph, ranks, seeds))
        if older is not None:
            discard(older)
        older, last = last, mass
        ranks = _next_ranks(mass, sources, jump)
    if older is not None:
        discard(older)
    every = graph.select("node_id", F.explode(F.array(*[F.lit(int(s)) for s in sources]).cast("array<bigint>")).alias("source_id"))
    return every.join(ranks, ["node_id", "source_id"], "left").select("node_id", "source_id", F.coalesce("pr", F.lit(0.0)).alias("pr"))


def linked_nodes(graph: DataFrame) -> DataFrame:
    """(node_id, nbrs) of the nodes with any link in or out; an element without a row of its own is a node with an empty list."""
    linked = graph.select(F.explode("nbrs").alias("node_id")).union(graph.where(F.size("nbrs") > 0).select("node_id")).distinct()
    none = F.expr("array()").cast("array<bigint>")
    return linked.join(graph.select("node_id", "nbrs"), "node_id", "left").select("node_id", F.coalesce("nbrs", none).alias("nbrs"))


def pagerank_to_convergence(graph: DataFrame, source: int, jump: float = 0.15, tolerance: float = 1e-9, max_iterations: int = 500) -> DataFrame:
    """(node_id, source_id, pr) of the ``linked_nodes`` once no rank moves by more than ``tolerance``.

    Raises ValueError if the source is not among them, RuntimeError if ``max_iterations`` do not do. Each round is
    written, and the one before it deleted.
    """
    graph = cut(linked_nodes(graph))
    if graph.where(F.col("node_id") == source).isEmpty():
        raise ValueError(f"{source} is not in the graph")
    seeds = _seeds(graph, [source])
    ranks = cut(seeds.withColumn("pr", F.lit(1.0)))
    for _ in range(max_iterations):
        mass = cut(_reached(graph, ranks, seeds))
        after = cut(_next_ranks(mass, [source], jump))
        # a node that has no rank any more had one before, and the other way round
        both = after.join(ranks.withColumnRenamed("pr", "before"), ["node_id", "source_id"], "full")
        change = F.abs(F.coalesce("pr", F.lit(0.0)) - F.coalesce("before", F.lit(0.0)))
        moved = both.agg(F.max(change).alias("m")).first().m
        discard(mass)
        discard(ranks)
        ranks = after
        if moved <= tolerance:
            return graph.select("node_id", F.lit(int(source)).cast("bigint").alias("source_id")).join(ranks, ["node_id", "source_id"], "left").select(
                "node_id", "source_id", F.coalesce("pr", F.lit(0.0)).alias("pr")
            )
    raise RuntimeError(f"ranks still move after {max_iterations} iterations")


def descending(ranks: DataFrame) -> DataFrame:
    """``ranks`` from the highest on, equal ones by node_id: sorted over all partitions, and gathered in none."""
    return ranks.orderBy(F.desc("pr"), "node_id", "source_id")


def top_nodes(ranks: DataFrame, n: int = 10, digits: int = 9) -> DataFrame:
    """(source_id, rank, node_id, pr): the ``n`` highest ranks of each source, equal ones by node_id.

    Spark keeps only ``n`` rows of a group on each task before it shuffles.
    """
    rounded = ranks.withColumn("pr", F.round("pr", digits))
    order = Window.partitionBy("source_id").orderBy(F.desc("pr"), "node_id")
    return rounded.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select("source_id", "rank", "node_id", "pr")


def rank_lines(top: DataFrame) -> DataFrame:
    """(source_id, rank, line): ranks as text, five decimals and the node."""
    return top.select("source_id", "rank", F.format_string("%.5f %d", "pr", "node_id").alias("line"))


def weak_components(graph: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node_id, component): the smallest id that can be reached ignoring directions; neighbours without a row count.

    Alternating star contraction: in each round every node hands its larger, then its smaller
    neighbours to the smallest one, until no edge moves. Rounds grow with the logarithm of the
    number of nodes, edges never multiply, and nothing is gathered on one machine: what a node with very many edges is told goes
    to its edges by broadcast (``lookup``). Raises RuntimeError if ``max_rounds`` do not do.
    """
    pairs = graph.select("node_id", F.explode("nbrs").alias("other"))
    nodes = pairs.select(F.explode(F.array("node_id", "other")).alias("node_id")).union(graph.select("node_id")).distinct()
    links = cut(
        pairs.where("node_id <> other").select(F.greatest("node_id", "other").alias("u"), F.least("node_id", "other").alias("v")).distinct()
    )
    before, edges = None, links.count()
    for _ in range(max_rounds):
        many = edges > FEW_EDGES
        with scratch(graph.sparkSession) as keep:
            last, links = links, keep(cut(_small_star(cut(_large_star(links, many)), many)))
        discard(last)
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before, edges = now, now[0]
    else:
        raise RuntimeError(f"components are not settled after {max_rounds} rounds")
    return nodes.join(links.select(F.col("u").alias("node_id"), F.col("v").alias("component")), "node_id", "left").select(
        "node_id", F.coalesce("component", "node_id").alias("component")
    )


def _told(links: DataFrame, least: DataFrame, many: bool) -> DataFrame:
    """``links`` (u, v) with what ``least`` (u, m, n) says about u. ``many``: hot nodes are told apart, by broadcast."""
    return lookup(links, cut(least), "u", "n") if many else links.join(least, "u")


def _large_star(links: DataFrame, many: bool) -> DataFrame:
    """Every node links its larger neighbours to its smallest neighbour or itself. links: u > v."""
    both = links.union(links.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    told = _told(links.select(F.col("v").alias("u"), F.col("u").alias("v")), least, many)
    return told.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame, many: bool) -> DataFrame:
    """Every node links itself and its smaller neighbours to the smallest of them."""
    least = links.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    told = _told(links, least, many)
    ends = F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
    return told.select(F.explode(ends).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
