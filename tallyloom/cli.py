"""Programs on the command line: ``spark-submit`` or ``python -m tallyloom PROGRAM --help``.

Collections are text files of one document a line, graphs text files of a node and its neighbours, posts tab-separated. An index
remembers nothing of the collection but byte offsets, so retrieval takes both. Results that are not written are printed in order.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import boolean, cooccur, graph, invindex, partitioning, sinks, timebucket, wordcount
from tallyloom.session import scratch
from tallyloom.sources import adjacency_text, lines_with_offset, tweets_tsv


def _numbers(text: str) -> list[int]:
    return [int(x) for x in text.split(",") if x.strip()]


def word_count(spark: SparkSession, o: argparse.Namespace) -> None:
    counts = wordcount.word_count(lines_with_offset(spark, o.input), only_alphabetic=o.alphabetic)
    if o.table:
        sinks.write_table(counts, o.table, "term", path=o.output)
    else:
        sinks.write_text(counts, o.output)


def fetch(spark: SparkSession, o: argparse.Namespace) -> DataFrame:
    return wordcount.fetch(spark.table(o.table), o.word)


def pmi(spark: SparkSession, o: argparse.Namespace) -> None:
    scored = cooccur.pmi(lines_with_offset(spark, o.input), o.min_count, o.marginals)
    sinks.write_columnar(cooccur.stripes(scored) if o.stripes else scored, o.output)


def analyze(spark: SparkSession, o: argparse.Namespace) -> DataFrame:
    scored = spark.read.parquet(o.input)
    if "stripe" in scored.columns:
        scored = scored.select("x", F.explode("stripe").alias("y", "pmi"))
    top = cooccur.top_pair(scored).select(F.lit("").alias("term"), F.lit(1).alias("rank"), "x", "y", "pmi")
    return top.unionByName(cooccur.top_partners(scored, o.word).select("term", "rank", "x", "y", "pmi")).orderBy("term", "rank")


def build_index(spark: SparkSession, o: argparse.Namespace) -> None:
    index = invindex.postings(lines_with_offset(spark, o.input))
    if o.compressed:
        sinks.write_sorted(invindex.compressed(index), o.output, "term", "block")
    else:
        sinks.write_sorted(index, o.output, "term", "docno")


def _index(spark: SparkSession, path: str, words: Sequence[str]) -> DataFrame:
    """Postings of ``words`` of a stored index of either form; only their lists are read and decoded."""
    stored = spark.read.parquet(path).where(F.col("term").isin(*words))
    return invindex.decompressed(stored) if "data" in stored.columns else stored


def look_up(spark: SparkSession, o: argparse.Namespace) -> DataFrame:
    index = _index(spark, o.index, o.term)
    return invindex.tf_histogram(index, o.term).orderBy("term", "tf") if o.histogram else index.orderBy("term", "docno")


def retrieve(spark: SparkSession, o: argparse.Namespace) -> DataFrame:
    index = _index(spark, o.index, o.query.split())
    return boolean.retrieve(index, lines_with_offset(spark, o.collection), o.query, o.snippet).orderBy("docno")


def pagerank_records(spark: SparkSession, o: argparse.Namespace) -> DataFrame:
    nodes = graph.require_unique_nodes(adjacency_text(spark, o.input))
    sinks.write_columnar(nodes, o.output + "/graph")
    sinks.write_columnar(graph.initial_ranks(nodes, o.sources), o.output + "/ranks")
    return graph.graph_counters(nodes)


def partition_graph(spark: SparkSession, o: argparse.Namespace) -> None:
    nodes = spark.read.parquet(o.input)
    placed = partitioning.place_by_range(nodes, o.num_nodes, o.num_partitions) if o.range else partitioning.place_by_hash(nodes, o.num_partitions)
    sinks.write_columnar(placed, o.output)


def pagerank(spark: SparkSession, o: argparse.Namespace) -> None:
    sinks.write_columnar(graph.personalized_pagerank(spark.read.parquet(o.input), o.sources, o.iterations, o.jump), o.output)


def top_nodes(spark: SparkSession, o: argparse.Namespace) -> DataFrame:
    ranks = spark.read.parquet(o.input)
    kept = ranks.where(F.col("source_id").isin(*o.sources)) if o.sources else ranks
    return graph.rank_lines(graph.top_nodes(kept, o.top)).orderBy("source_id", "rank")


def converged(spark: SparkSession, o: argparse.Namespace) -> DataFrame:
    nodes = adjacency_text(spark, o.input)
    linked = graph.linked_nodes(nodes)
    components = graph.weak_components(linked).agg(F.count_distinct("component").alias("components")).first().components
    counters = graph.graph_counters(linked).first()
    print(f"components: {components}\nedges: {counters.edges}\nnodes: {counters.nodes}\njump: {o.jump}")
    return graph.descending(graph.pagerank_to_convergence(nodes, o.source, o.jump)).select("pr", "node_id")


def hourly(spark: SparkSession, o: argparse.Namespace) -> None:
    sinks.write_text(timebucket.ordered(timebucket.hourly_posts(tweets_tsv(spark, o.input), o.pattern)), o.output)


def parser() -> argparse.ArgumentParser:
    root = argparse.ArgumentParser(prog="tallyloom", description=__doc__)
    programs = root.add_subparsers(dest="program", required=True)

    def program(name: str, run: Callable, about: str, *paths: str) -> argparse.ArgumentParser:
        one = programs.add_parser(name, help=about, description=about)
        one.set_defaults(run=run)
        one.add_argument("--num-reducers", type=int, help="partitions of a shuffle; the session's if not given")
        for path in paths:
            one.add_argument(f"--{path}", required=True)
        return one

    p = program("word-count", word_count, "count tokens, to text or to a table", "input", "output")
    p.add_argument("--alphabetic", action="store_true", help="only tokens of ASCII letters")
    p.add_argument("--table", help="write a table of this name, its files to the output folder")
    p = program("fetch", fetch, "counts of words from a table", "table")
    p.add_argument("--word", nargs="+", required=True)
    p = program("pmi", pmi, "pairs of tokens that share a line, with their mutual information", "input", "output")
    p.add_argument("--stripes", action="store_true", help="maps from right to left term instead of pairs")
    p.add_argument("--marginals", choices=("df", "cf"), default="df")
    p.add_argument("--min-count", type=int, default=10)
    p = program("analyze-pmi", analyze, "the best pair of all, and the best of given words", "input")
    p.add_argument("--word", nargs="*", default=[])
    p = program("build-index", build_index, "inverted index of a collection", "input", "output")
    p.add_argument("--compressed", action="store_true")
    p = program("lookup", look_up, "postings of terms", "index")
    p.add_argument("--term", nargs="+", required=True)
    p.add_argument("--histogram", action="store_true", help="how many documents hold a term how often")
    p = program("retrieve", retrieve, "documents of a postfix query of terms, AND and OR", "index", "collection", "query")
    p.add_argument("--snippet", type=int, help="first characters of each line")
    p = program("pagerank-records", pagerank_records, "a graph from its text, and the ranks to begin with", "input", "output")
    p.add_argument("--sources", type=_numbers, required=True)
    p = program("partition-graph", partition_graph, "place a graph by hash or by range of its ids", "input", "output")
    p.add_argument("--num-nodes", type=int, required=True)
    p.add_argument("--num-partitions", type=int, required=True)
    p.add_argument("--range", action="store_true")
    p = program("pagerank", pagerank, "personalized PageRank of several sources", "input", "output")
    p.add_argument("--sources", type=_numbers, required=True)
    p.add_argument("--iterations", type=int, default=20)
    p.add_argument("--jump", type=float, default=0.15)
    p = program("top-nodes", top_nodes, "nodes of highest rank of each source", "input")
    p.add_argument("--sources", type=_numbers, default=[])
    p.add_argument("--top", type=int, default=10)
    p = program("pagerank-to-convergence", converged, "ranks of one source and the components of a graph", "input")
    p.add_argument("--source", type=int, required=True)
    p.add_argument("--jump", type=float, default=0.15)
    p = program("hourly-counts", hourly, "posts of each hour", "input", "output")
    p.add_argument("--pattern", help="only texts that match this expression")
    return root


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> None:
    options = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("tallyloom").getOrCreate()
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    try:
        if options.num_reducers:
            spark.conf.set(key, str(options.num_reducers))
        with scratch(spark):
            result = options.run(spark, options)
            if result is not None:
                for row in result.toLocalIterator():
                    print("\t".join("" if v is None else str(v) for v in row))
    finally:
        spark.conf.set(key, before)


if __name__ == "__main__":
    main(sys.argv[1:])
