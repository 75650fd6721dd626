import random

import pytest
from pyspark.sql import functions as F
from rows import rows

from tallyloom.operators import graph as G
from tallyloom.operators.partitioning import partition_sizes, place_by_hash, place_by_range, placed_sizes, range_partition


def make(spark, lists):
    return spark.createDataFrame([(n, list(v), 1.0, 7) for n, v in lists.items()], "node_id bigint, nbrs array<bigint>, pr double, source_id bigint")


def brute(lists, source, rounds, jump=0.15):
    ranks = {n: float(n == source) for n in lists}
    for _ in range(rounds):
        mass = dict.fromkeys(lists, 0.0)
        for n, nbrs in lists.items():
            for m in nbrs:
                if m in mass:
                    mass[m] += ranks[n] / len(nbrs)
        lost = max(0.0, 1 - sum(mass.values()))
        ranks = {n: (1 - jump) * m + (jump + (1 - jump) * lost if n == source else 0) for n, m in mass.items()}
    return ranks


CASES = {
    "no dangling node": {1: [2], 2: [3], 3: [1, 2]},
    "dangling node": {1: [2, 3], 2: [], 3: [1]},
    "repeated neighbour": {1: [2, 2, 3], 2: [1], 3: [3]},
    "unknown neighbour": {1: [2, 99], 2: [1], 3: [98]},
}


@pytest.mark.parametrize("name", CASES)
def test_pagerank_against_brute_force(spark, name):
    found = G.personalized_pagerank(make(spark, CASES[name]), [1, 3], 4)
    got = {(r.source_id, r.node_id): r.pr for r in found.collect()}
    for source in (1, 3):
        expected = brute(CASES[name], source, 4)
        assert {n: got[source, n] for n in expected} == pytest.approx(expected, abs=1e-12)
        assert sum(got[source, n] for n in expected) == pytest.approx(1)
    assert len(got) == 2 * len(CASES[name])


def test_unknown_and_repeated_sources(spark):
    data = make(spark, CASES["dangling node"])
    assert all(r.pr == 0 for r in G.personalized_pagerank(data, [77], 2).collect())
    with pytest.raises(ValueError):
        G.personalized_pagerank(data, [1, 1], 1)


def test_convergence(spark):
    lists = {1: [2, 3], 2: [3], 3: [1], 4: [], 5: [99]}
    nodes = {n: v for n, v in lists.items() if n != 4} | {99: []}
    for source in (1, 5):
        got = {r.node_id: r.pr for r in G.pagerank_to_convergence(make(spark, lists), source, jump=0.6, tolerance=1e-6).collect()}
        assert got == pytest.approx(brute(nodes, source, 100, 0.6), abs=1e-5)
    with pytest.raises(ValueError):
        G.pagerank_to_convergence(make(spark, lists), 4)
    with pytest.raises(RuntimeError):
        G.pagerank_to_convergence(make(spark, lists), 1, max_iterations=1)


def test_messages_and_unique_nodes(spark):
    data = make(spark, CASES["unknown neighbour"])
    assert rows(G.message_counters(data)) == [(4, 2, 2, 2)]
    assert rows(G.message_counters(data.limit(0))) == [(0, 0, 0, 0)]
    assert G.require_unique_nodes(data) is data
    with pytest.raises(ValueError):
        G.require_unique_nodes(data.union(data))


def test_counters_and_dangling(spark):
    data = make(spark, CASES["dangling node"])
    assert rows(G.graph_counters(data)) == [(3, 3, 2, 1)]
    assert rows(G.dangling(data)) == [(2,)]
    assert rows(G.graph_counters(data.limit(0))) == [(0, 0, 0, 0)]


def test_top_nodes_with_ties(spark):
    data = spark.createDataFrame([(3, 1, 0.5), (2, 1, 0.5), (9, 1, 0.7), (4, 2, 0.1)], "node_id bigint, source_id bigint, pr double")
    assert rows(G.top_nodes(data, 2), "source_id", "rank", "node_id") == [(1, 1, 9), (1, 2, 2), (2, 1, 4)]


def test_components(spark):
    assert rows(G.weak_components(make(spark, {1: [2], 3: [4], 5: [], 6: [6]}))) == [(1, 1), (2, 1), (3, 3), (4, 3), (5, 5), (6, 6)]
    chain = {n: [n + 1] for n in range(100, 140)}
    assert {c for _, c in rows(G.weak_components(make(spark, chain)))} == {100}
    draw = random.Random(1)
    lists = {n: [draw.randrange(200) for _ in range(draw.choice((0, 0, 1, 1, 2)))] for n in range(200)}
    label = {n: n for n in range(200)}
    for _ in range(200):
        for n, nbrs in lists.items():
            for m in nbrs:
                label[n] = label[m] = min(label[n], label[m])
    assert dict(rows(G.weak_components(make(spark, lists)))) == label


def test_components_of_a_star(spark, monkeypatch):
    """The hub of a star is told apart: no task of the join holds much more than its share of the edges."""
    from tallyloom.operators import numbering, skew

    monkeypatch.setattr(G, "FEW_EDGES", 0)
    star = spark.createDataFrame([(0, list(range(1, 5001))), (9000, [9001])], "node_id bigint, nbrs array<bigint>")
    found = rows(G.weak_components(star))
    assert found == sorted([(n, 0) for n in range(5001)] + [(9000, 9000), (9001, 9000)])
    monkeypatch.setattr(skew, "HOT_SHARE", 0.1)
    links = spark.range(1, 20001).select(F.lit(0).cast("bigint").alias("u"), F.col("id").alias("v")).union(spark.range(30000, 30100).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v")))
    facts = G.cut(links.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")))
    monkeypatch.setattr(numbering, "BROADCAST_ROWS", 50)
    told = skew.lookup(links.repartition(8), facts, "u", "n").groupBy(F.spark_partition_id().alias("p")).count()
    counts = [r["count"] for r in told.collect()]
    assert sum(counts) == 20100 and max(counts) <= 3000


def test_reached_nodes_only(spark):
    """Rounds hold no rows for nodes that no source has reached; the result has them."""
    data = make(spark, {n: [n + 1] for n in range(50)} | {50: []})
    seeds = G._seeds(data, [0])
    assert G._reached(data, seeds.withColumn("pr", F.lit(1.0)), seeds).count() == 2
    assert G.personalized_pagerank(data, [0], 2).count() == 51
    assert rows(G.personalized_pagerank(data.limit(0), [0], 2)) == rows(G.personalized_pagerank(data, [], 2)) == []
    assert G.personalized_pagerank(data, [3], 0).where("pr > 0").collect() == [(3, 3, 1.0)]


def test_descending_order(spark):
    ranks = spark.createDataFrame([(3, 1, 0.5), (2, 1, 0.5), (9, 1, 0.7), (4, 1, 0.1)], "node_id bigint, source_id bigint, pr double")
    assert [r.node_id for r in G.descending(ranks).collect()] == [9, 2, 3, 4]


def test_placing_by_hash(spark):
    df = spark.createDataFrame([(5,), (15,), (0,), (9,), (-1,), (None,)], "node_id bigint")
    assert rows(place_by_hash(df, 4).select("node_id", F.spark_partition_id())) == [(-1, 3), (0, 0), (5, 1), (9, 1), (15, 3), (None, 0)]
    assert rows(placed_sizes(place_by_hash(df, 4), "hash")) == [("hash", 0, 2), ("hash", 1, 2), ("hash", 3, 2)]


def test_partition_formula(spark):
    df = spark.createDataFrame([(5,), (15,), (0,), (9,)], "node_id bigint")
    assert rows(df.select("node_id", range_partition(F.col("node_id"), 10, 4))) == [(0, 0), (5, 2), (9, 3), (15, 2)]
    assert sum(r.nodes for r in partition_sizes(df, 10, 4).collect()) == 8
    placed = place_by_range(df, 10, 4).select("node_id", F.spark_partition_id().alias("p"))
    assert rows(placed) == [(0, 0), (5, 2), (9, 3), (15, 2)]
