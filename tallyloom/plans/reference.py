"""Queries over whole tables, and the same in SQL for comparison.

``passages`` is the line collection, ``adjacency`` the graph, ``events`` the time series.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import boolean, cooccur, graph, invindex, partitioning, sinks, skew, timebucket, wordcount
from tallyloom.session import cut, shared_folder
from tallyloom.sources import adjacency_text, key_value_file, lines_in_force, lines_with_offset, lists_in_force, load, postings_in_force, tweets_tsv

Query = Callable[[SparkSession, str], DataFrame]

WORDS = ["and", "the", "king", "temple", "no-such-term"]
BOOLEAN = {
    "q23_boolean_and": "the and AND",
    "q24_boolean_and_rare": "king temple AND",
    "q25_boolean_and_unknown": "the no-such-term AND",
    "q26_boolean_or_and_and": "king temple OR the AND of AND",
    "q27_boolean_deep": "king temple OR unto shall AND OR stone AND",
}
#: So many sources, the first of the nodes that every graph holds.
SOURCES = 2
ROUNDS = 5
PARTS = 5
NODE_COUNT = 200_000_000
#: Ranks to convergence: a jump with which few rounds do, and a tolerance far below the digits that are shown.
CONVERGING_JUMP, TOLERANCE = 0.7, 1e-14


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    return lines_in_force(load(spark, folder, "passages"))


def _graph(spark: SparkSession, folder: str) -> DataFrame:
    return lists_in_force(load(spark, folder, "adjacency"))


def _sources(spark: SparkSession, folder: str) -> list[int]:
    nodes = load(spark, folder, "core_nodes").select("node_id").dropna().distinct()
    return [r.node_id for r in nodes.orderBy("node_id").limit(SOURCES).collect()]


def _ranks(spark: SparkSession, folder: str, rounds: int = ROUNDS) -> DataFrame:
    return graph.personalized_pagerank(_graph(spark, folder), _sources(spark, folder), rounds)


def _index(spark: SparkSession, folder: str) -> DataFrame:
    return invindex.postings(_lines(spark, folder))


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "events")


def _rounded(df: DataFrame, column: str = "pmi", digits: int = 6) -> DataFrame:
    return df.withColumn(column, F.round(column, digits))


def _stripes(spark: SparkSession, folder: str, marginals: str = "df") -> DataFrame:
    wide = cooccur.stripes(_rounded(cooccur.pmi(_lines(spark, folder), marginals=marginals)))
    return wide.select("x", F.explode("stripe").alias("y", "pmi"))


def _partition_sizes(spark: SparkSession, folder: str) -> DataFrame:
    nodes = _graph(spark, folder).select("node_id")
    return partitioning.partition_sizes(nodes, NODE_COUNT, PARTS)


def _placed(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes in each physical partition after placing by hash and by range."""
    nodes = _graph(spark, folder).select("node_id")
    by_hash = partitioning.placed_sizes(partitioning.place_by_hash(nodes, PARTS), "hash")
    return by_hash.union(partitioning.placed_sizes(partitioning.place_by_range(nodes, NODE_COUNT, PARTS), "range"))


def _converged(spark: SparkSession, folder: str) -> DataFrame:
    """Ranks of the first common node with neighbours to convergence, from the highest on."""
    nodes = _graph(spark, folder)
    common = nodes.where(F.size("nbrs") > 0).join(load(spark, folder, "core_nodes").select("node_id"), "node_id", "left_semi")
    source = common.agg(F.min("node_id")).first()[0]
    return graph.descending(_rounded(graph.pagerank_to_convergence(nodes, source, CONVERGING_JUMP, TOLERANCE), "pr", 9))


# What goes out through a sink and comes back through its source.


def _text_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """(line, n): lines of a text collection, read with their offsets."""
    path = shared_folder(spark)
    sinks.write_text(_lines(spark, folder).select(F.regexp_replace("line", "[\\r\\n]", " ")), path)
    return lines_with_offset(spark, path).where("docno >= 0").groupBy("line").agg(F.count(F.lit(1)).alias("n"))


def _posts_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Hourly counts of posts from a tab-separated file, in order."""
    path = shared_folder(spark)
    sinks.write_text(_posts(spark, folder).dropna(), path)
    return timebucket.ordered(timebucket.hourly_posts(tweets_tsv(spark, path)))


def _adjacency_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """(node_id, degree, total): nodes of an adjacency text, with the number and the sum of their neighbours."""
    path = shared_folder(spark)
    lists = _graph(spark, folder)
    sinks.write_text(lists.select(F.concat_ws(" ", F.col("node_id").cast("string"), F.col("nbrs").cast("array<string>"))), path)
    total = F.aggregate("nbrs", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return adjacency_text(spark, path).select("node_id", F.size("nbrs").cast("bigint").alias("degree"), total.alias("total"))


def _key_values_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Word counts by sequence files."""
    path = shared_folder(spark)
    sinks.write_key_values(wordcount.word_count(_lines(spark, folder)), path)
    return key_value_file(spark, path, 'term string, `count` bigint')


def _sorted_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Look-up in an index in sorted files."""
    path = shared_folder(spark)
    sinks.write_sorted(_index(spark, folder), path, "term", "docno")
    return invindex.lookup(spark.read.parquet(path), "king")


def _table_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Words fetched from a table that is dropped and created again."""
    sinks.write_table(wordcount.word_count(_lines(spark, folder)), "tallyloom_word_counts", "term", 4, shared_folder(spark))
    return wordcount.fetch(spark.table("tallyloom_word_counts"), WORDS)


def _decoded_boolean(spark: SparkSession, folder: str) -> DataFrame:
    """Boolean retrieval over the compressed index."""
    lines = _lines(spark, folder)
    index = invindex.decompressed(cut(invindex.compressed(invindex.postings(lines))))
    return boolean.retrieve(index, lines, BOOLEAN["q27_boolean_deep"], 80)


def _first_mass(spark: SparkSession, folder: str) -> DataFrame:
    mass = cut(graph.arrived(_graph(spark, folder), _ranks(spark, folder, 1)))
    total = mass.groupBy("source_id").agg(F.round(F.sum("mass"), 9).alias("total"))
    return total.join(graph.missing_mass(mass).select("source_id", F.round("missing", 9).alias("missing")), "source_id")


def _boolean(query: str, snippet: int | None = None) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        lines = _lines(spark, folder)
        return boolean.retrieve(invindex.postings(lines), lines, query, snippet)

    return run


def _posts(spark: SparkSession, folder: str) -> DataFrame:
    """Events as posts of text fields, dates in the form of a feed."""
    date = F.date_format("ts", "EEE MMM d HH:mm:ss '+0000' yyyy").alias("date")
    return _events(spark, folder).select(F.col("event_id").cast("string").alias("post_id"), F.col("user_id").cast("string").alias("user_id"), date, F.col("event_type").alias("text"))


def _compressed_size(spark: SparkSession, folder: str) -> DataFrame:
    data = invindex.compressed(_index(spark, folder))
    return data.agg(F.count(F.lit(1)).alias("lists"), F.sum("docs").alias("entries"), F.sum(F.length("data").cast("bigint")).alias("bytes"))


QUERIES: dict[str, Query] = {
    "q01_word_count": lambda s, d: wordcount.word_count(_lines(s, d)),
    "q02_word_count_alpha": lambda s, d: wordcount.word_count(_lines(s, d), only_alphabetic=True),
    "q03_vocabulary_sizes": lambda s, d: wordcount.vocabulary_sizes(_lines(s, d)),
    "q04_word_fetch": lambda s, d: wordcount.fetch(wordcount.word_count(_lines(s, d)), WORDS),
    "q05_hourly_counts": lambda s, d: timebucket.hourly_counts(_events(s, d)),
    "q06_hourly_counts_filtered": lambda s, d: timebucket.filtered_hourly_counts(_events(s, d), "(?i)click|purchase", "event_type"),
    "q07_hourly_counts_complete": lambda s, d: timebucket.hourly_counts(timebucket.complete_rows(_events(s, d), ["event_id", "ts", "user_id", "event_type"])),
    "q08_line_frequency": lambda s, d: wordcount.line_frequency(_lines(s, d)),
    "q09_collection_frequency": lambda s, d: invindex.document_frequency(_index(s, d)),
    "q10_pair_counts": lambda s, d: cooccur.pair_counts(_lines(s, d)),
    "q11_pmi": lambda s, d: _rounded(cooccur.pmi(_lines(s, d))),
    "q12_pmi_cf": lambda s, d: _rounded(cooccur.pmi(_lines(s, d), marginals="cf")),
    "q13_stripes": _stripes,
    "q14_top_pair": lambda s, d: cooccur.top_pair(cooccur.pmi(_lines(s, d))),
    "q15_top_partners": lambda s, d: cooccur.top_partners(cooccur.pmi(_lines(s, d)), WORDS),
    "q16_postings": _index,
    "q17_document_frequency": lambda s, d: invindex.postings_lists(_index(s, d)).groupBy("term").agg(F.sum("docs").alias("df")),
    "q18_gaps": lambda s, d: invindex.gaps(_index(s, d)),
    "q19_gap_round_trip": lambda s, d: invindex.decompressed(invindex.compressed(_index(s, d))),
    "q20_lookup": lambda s, d: invindex.lookup(_index(s, d), "king"),
    "q21_tf_histogram": lambda s, d: invindex.tf_histogram(_index(s, d), WORDS),
    "q22_compressed_size": _compressed_size,
    **{name: _boolean(query) for name, query in BOOLEAN.items()},
    "q28_boolean_snippet_80": _boolean(BOOLEAN["q27_boolean_deep"], 80),
    "q29_boolean_snippet_100": _boolean(BOOLEAN["q26_boolean_or_and_and"], 100),
    "q30_graph_counters": lambda s, d: graph.graph_counters(_graph(s, d)),
    "q31_dangling": lambda s, d: graph.dangling(_graph(s, d)),
    "q32_mass_and_loss": _first_mass,
    "q33_pagerank": lambda s, d: _rounded(_ranks(s, d), "pr", 9),
    "q34_pagerank_top": lambda s, d: graph.top_nodes(_ranks(s, d)),
    "q35_partition_sizes": _partition_sizes,
    "q36_weak_components": lambda s, d: graph.weak_components(_graph(s, d)),
    "q37_hourly_posts": lambda s, d: timebucket.hourly_posts(_posts(s, d)),
    "q38_hourly_posts_filtered": lambda s, d: timebucket.hourly_posts(_posts(s, d), ".*(?i:view|error).*"),
    "q39_message_counters": lambda s, d: graph.message_counters(_graph(s, d)),
    "q40_rank_lines": lambda s, d: graph.rank_lines(graph.top_nodes(_ranks(s, d))),
    "q41_hourly_ordered": lambda s, d: timebucket.ordered(timebucket.hourly_counts(_events(s, d))),
    "q42_boolean_decoded": _decoded_boolean,
    "q43_stripes_cf": lambda s, d: _stripes(s, d, "cf"),
    "q44_placed_partitions": _placed,
    "q45_pagerank_converged": _converged,
    "q46_text_round_trip": _text_round_trip,
    "q47_posts_round_trip": _posts_round_trip,
    "q48_adjacency_round_trip": _adjacency_round_trip,
    "q49_key_values_round_trip": _key_values_round_trip,
    "q50_sorted_round_trip": _sorted_round_trip,
    "q51_table_round_trip": _table_round_trip,
    "p4_found": lambda s, d: p4_found(s, d),
    "p4_terms": lambda s, d: skew.per_term(postings_in_force(load(s, d, "postings"))),
    "p4_nodes": lambda s, d: skew.per_node(_graph(s, d)),
}

HEAVY_SHARE = 0.01


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """(key_kind, key_text): terms and pointed-to nodes that hold at least a hundredth of all entries."""
    terms = skew.per_term(postings_in_force(load(spark, folder, "postings")))
    nodes = skew.per_node(_graph(spark, folder))
    results = terms.select(F.lit("term").alias("key_kind"), F.col("term").alias("key_text"), "entries").union(
        nodes.select(F.lit("node"), F.col("node_id").cast("string"), "entries")
    )
    return skew.heavy_keys(results, HEAVY_SHARE, "key_kind").select("key_kind", "key_text")


# The same in SQL.

LINES = """lines AS (
  SELECT docno, line FROM (
    SELECT docno, line, row_number() OVER (PARTITION BY docno ORDER BY loaded_at DESC NULLS LAST, line DESC NULLS LAST) AS rn
    FROM passages WHERE docno IS NOT NULL) WHERE rn = 1 AND line IS NOT NULL)"""
JAVA, BLANK = "[ \\t\\n\\r\\f]+", "[ \\t\\n\\x0B\\f\\r]+"


def _tok(pattern: str) -> str:
    return f"""tok AS (SELECT docno, term FROM (
    SELECT docno, unnest(string_split_regex(line, '{pattern}')) AS term FROM lines) WHERE term <> '')"""


IN_FORCE = """post AS (
  SELECT term, docno, tf FROM (
    SELECT term, docno, tf, row_number() OVER (PARTITION BY term, docno ORDER BY written_at DESC NULLS LAST, tf DESC) AS rn
    FROM postings WHERE regexp_matches(term, '[^ \\t\\n\\x0B\\f\\r]') AND docno IS NOT NULL AND tf >= 1) WHERE rn = 1)"""
GRAPH = """lists AS (
  SELECT node_id, nbrs FROM (
    SELECT node_id, nbrs, row_number() OVER (PARTITION BY node_id ORDER BY crawled_at DESC NULLS LAST, nbrs DESC NULLS LAST) AS rn
    FROM adjacency WHERE node_id IS NOT NULL) WHERE rn = 1),
edges AS (SELECT src, dst FROM (SELECT node_id AS src, unnest(nbrs) AS dst FROM lists) WHERE dst IS NOT NULL),
deg AS (SELECT src, count(*) AS d FROM edges GROUP BY src)"""

L, J, B = f"WITH {LINES}", _tok(JAVA), _tok(BLANK)
DF = "df AS (SELECT term, count(DISTINCT docno) AS df FROM tok GROUP BY term)"
CF = "df AS (SELECT term, count(*) AS df FROM tok GROUP BY term)"
PAIRS = """line_terms AS (SELECT DISTINCT docno, term FROM tok),
pairs AS (SELECT a.term AS x, b.term AS y, count(*) AS pairs FROM line_terms a JOIN line_terms b ON a.docno = b.docno AND a.term < b.term
  GROUP BY 1, 2 HAVING count(*) >= 10)"""
PMI = """pmi AS (SELECT x, y, pairs, round(log10((pairs / n) / ((c.df / n) * (d.df / n))), 6) AS pmi
  FROM pairs JOIN df c ON c.term = x JOIN df d ON d.term = y, (SELECT count(*)::DOUBLE AS n FROM lines))"""
SCORED = f"{L}, {J}, {DF}, {PAIRS}, {PMI}"
POSTINGS = f"{L}, {B}, idx AS (SELECT term, docno, count(*) AS tf FROM tok GROUP BY term, docno)"
WORD_LIST = ", ".join(f"'{w}'" for w in WORDS)
MD, HH = "concat(month(ts), '/', day(ts)) AS md", "lpad(CAST(hour(ts) AS VARCHAR), 2, '0') AS h"


def _flags(where: str, line: str = "line") -> str:
    """A Boolean query as a predicate over sets of documents; %word% stands for a term's set."""
    import re

    return f"{POSTINGS} SELECT docno, {line} AS line FROM lines WHERE " + re.sub(r"%(.+?)%", r"docno IN (SELECT docno FROM idx WHERE term = '\1')", where)


def _pagerank(rounds: int) -> str:
    steps = [
        f"{GRAPH}, src AS MATERIALIZED (SELECT DISTINCT node_id AS source_id FROM core_nodes WHERE node_id IS NOT NULL ORDER BY node_id LIMIT {SOURCES})",
        "r0 AS MATERIALIZED (SELECT node_id, source_id, CASE WHEN node_id = source_id THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS pr FROM lists, src)",
    ]
    for i in range(rounds):
        steps += [
            f"s{i} AS (SELECT dst AS node_id, source_id, sum(pr / d) AS mass FROM r{i} JOIN deg ON deg.src = node_id JOIN edges ON edges.src = node_id GROUP BY 1, 2)",
            f"m{i} AS MATERIALIZED (SELECT r.node_id, r.source_id, coalesce(mass, 0) AS mass FROM r{i} r LEFT JOIN s{i} USING (node_id, source_id))",
            f"t{i} AS (SELECT source_id, sum(mass) AS total, greatest(0, 1 - sum(mass)) AS missing FROM m{i} GROUP BY 1)",
            f"r{i + 1} AS MATERIALIZED (SELECT node_id, m.source_id, CASE WHEN node_id = m.source_id THEN 0.15 + 0.85 * (mass + missing) ELSE 0.85 * mass END::DOUBLE AS pr"
            f" FROM m{i} m JOIN t{i} USING (source_id))",
        ]
    return "WITH " + ", ".join(steps)


def _converging(rounds: int = 34) -> str:
    """Ranks of one source after so many rounds over all nodes with a link; 0.3 to their power is far below the digits that are compared."""
    jump, source = f"{CONVERGING_JUMP}::DOUBLE", "(SELECT s FROM seed)"
    steps = [
        f"{GRAPH}, ids AS MATERIALIZED (SELECT src AS node_id FROM edges UNION SELECT dst FROM edges)",
        "seed AS MATERIALIZED (SELECT min(src) AS s FROM edges WHERE src IN (SELECT node_id FROM core_nodes))",
        f"r0 AS MATERIALIZED (SELECT node_id, (CASE WHEN node_id = {source} THEN 1 ELSE 0 END)::DOUBLE AS pr FROM ids)",
    ]
    for i in range(rounds):
        steps += [
            f"m{i} AS MATERIALIZED (SELECT ids.node_id, coalesce(mass, 0) AS mass FROM ids LEFT JOIN (SELECT dst AS node_id, sum(pr / d) AS mass FROM r{i} JOIN deg ON src = node_id"
            " JOIN edges ON edges.src = node_id GROUP BY 1) USING (node_id))",
            f"r{i + 1} AS MATERIALIZED (SELECT node_id, (CASE WHEN node_id = {source} THEN {jump} + (1 - {jump}) * (mass + (SELECT greatest(0, 1 - sum(mass)) FROM m{i}))"
            f" ELSE (1 - {jump}) * mass END)::DOUBLE AS pr FROM m{i})",
        ]
    return "WITH " + ", ".join(steps) + f" SELECT node_id, {source} AS source_id, round(pr, 9) AS pr FROM r{rounds} ORDER BY pr DESC, node_id"


def _components(rounds: int = 12) -> str:
    steps = [
        f"{GRAPH}, both_ways AS MATERIALIZED (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges)",
        "c0 AS (SELECT node_id AS id, node_id AS label FROM lists UNION SELECT dst, dst FROM edges)",
    ]
    for i in range(rounds):
        steps.append(
            f"c{i + 1} AS MATERIALIZED (SELECT c.id, least(min(c.label), min(n.label)) AS label FROM c{i} c LEFT JOIN both_ways ON a = c.id LEFT JOIN c{i} n ON n.id = b GROUP BY c.id)"
        )
    return "WITH " + ", ".join(steps) + f" SELECT id AS node_id, label AS component FROM c{rounds}"


ORACLE: dict[str, str] = {
    "q01_word_count": f'{L}, {J} SELECT term, count(*) AS "count" FROM tok GROUP BY term',
    "q02_word_count_alpha": f"""{L}, {J} SELECT term, count(*) AS "count" FROM tok WHERE regexp_full_match(term, '[A-Za-z]+') GROUP BY term""",
    "q03_vocabulary_sizes": f"""{L}, {J} SELECT count(DISTINCT term) AS terms,
      count(DISTINCT term) FILTER (regexp_full_match(term, '[A-Za-z]+')) AS alphabetic_terms, count(*) AS tokens FROM tok""",
    "q04_word_fetch": f"""{L}, {J} SELECT w.term, count(tok.term) AS "count" FROM (SELECT unnest([{WORD_LIST}]) AS term) w LEFT JOIN tok ON tok.term = w.term GROUP BY w.term""",
    "q05_hourly_counts": f'SELECT {MD}, {HH}, count(*) AS "count" FROM events WHERE ts IS NOT NULL GROUP BY 1, 2',
    "q06_hourly_counts_filtered": f"""SELECT {MD}, {HH}, count(*) AS "count" FROM events WHERE ts IS NOT NULL AND regexp_matches(event_type, '(?i)click|purchase') GROUP BY 1, 2""",
    "q07_hourly_counts_complete": f"""SELECT {MD}, {HH}, count(*) AS "count" FROM events
      WHERE event_id IS NOT NULL AND ts IS NOT NULL AND user_id IS NOT NULL AND event_type IS NOT NULL GROUP BY 1, 2""",
    "q08_line_frequency": f"{L}, {J}, {DF} SELECT term, df FROM df",
    "q09_collection_frequency": f"{L}, {B} SELECT term, count(DISTINCT docno) AS df, count(*) AS cf FROM tok GROUP BY term",
    "q10_pair_counts": f"{L}, {J}, {PAIRS} SELECT x, y, pairs FROM pairs",
    "q11_pmi": f"{SCORED} SELECT * FROM pmi",
    "q12_pmi_cf": f"{L}, {J}, {CF}, {PAIRS}, {PMI} SELECT * FROM pmi",
    "q13_stripes": f"{SCORED} SELECT x, y, pmi FROM pmi",
    "q14_top_pair": f"{SCORED} SELECT * FROM pmi ORDER BY pmi DESC, x DESC, y DESC LIMIT 1",
    "q15_top_partners": f"""{SCORED} SELECT term, rank, x, y, pmi FROM (SELECT w.term, row_number() OVER (PARTITION BY w.term ORDER BY pmi DESC, x, y)::INT AS rank, x, y, pmi
      FROM pmi JOIN (SELECT unnest([{WORD_LIST}]) AS term) w ON w.term = x OR w.term = y) WHERE rank <= 3""",
    "q16_postings": f"{POSTINGS} SELECT * FROM idx",
    "q17_document_frequency": f"{POSTINGS} SELECT term, count(*) AS df FROM idx GROUP BY term",
    "q18_gaps": f"{POSTINGS} SELECT term, docno, docno - lag(docno, 1, 0) OVER (PARTITION BY term ORDER BY docno) AS gap, tf FROM idx",
    "q19_gap_round_trip": f"{POSTINGS} SELECT * FROM idx",
    "q20_lookup": f"{POSTINGS} SELECT docno, tf FROM idx WHERE term = 'king'",
    "q21_tf_histogram": f"{POSTINGS} SELECT term, tf, count(*) AS docs FROM idx WHERE term IN ({WORD_LIST}) GROUP BY term, tf",
    "q22_compressed_size": f"""{POSTINGS}, b AS (SELECT *, docno >> 16 AS block FROM idx),
      g AS (SELECT docno - lag(docno, 1, block * 65536) OVER (PARTITION BY term, block ORDER BY docno) AS gap, tf FROM b),
      heads AS (SELECT count(*) AS docs FROM b GROUP BY term, block),
      numbers AS (SELECT gap AS v FROM g UNION ALL SELECT tf FROM g UNION ALL SELECT docs FROM heads)
      SELECT (SELECT count(*) FROM heads) AS lists, (SELECT sum(docs)::BIGINT FROM heads) AS entries,
        (SELECT sum(CASE WHEN v < 128 THEN 1 WHEN v < 16384 THEN 2 WHEN v < 2097152 THEN 3 ELSE 4 END)::BIGINT FROM numbers) AS bytes""",
    "q23_boolean_and": _flags("%the% AND %and%"),
    "q24_boolean_and_rare": _flags("%king% AND %temple%"),
    "q25_boolean_and_unknown": _flags("%the% AND %no-such-term%"),
    "q26_boolean_or_and_and": _flags("(%king% OR %temple%) AND %the% AND %of%"),
    "q27_boolean_deep": _flags("((%king% OR %temple%) OR (%unto% AND %shall%)) AND %stone%"),
    "q28_boolean_snippet_80": _flags("((%king% OR %temple%) OR (%unto% AND %shall%)) AND %stone%", "substring(line, 1, 80)"),
    "q29_boolean_snippet_100": _flags("(%king% OR %temple%) AND %the% AND %of%", "substring(line, 1, 100)"),
    "q30_graph_counters": f"""WITH {GRAPH} SELECT count(*) AS nodes, (SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM deg) AS active_nodes,
      count(*) - (SELECT count(*) FROM deg) AS dangling_nodes FROM lists""",
    "q31_dangling": f"WITH {GRAPH} SELECT node_id FROM lists WHERE node_id NOT IN (SELECT src FROM edges)",
    "q32_mass_and_loss": f"{_pagerank(2)} SELECT source_id, round(total, 9) AS total, round(missing, 9) AS missing FROM t1",
    "q33_pagerank": f"{_pagerank(ROUNDS)} SELECT node_id, source_id, round(pr, 9) AS pr FROM r{ROUNDS}",
    "q34_pagerank_top": f"""{_pagerank(ROUNDS)} SELECT source_id, rank, node_id, pr FROM (
      SELECT source_id, node_id, pr, row_number() OVER (PARTITION BY source_id ORDER BY pr DESC, node_id)::INT AS rank
      FROM (SELECT node_id, source_id, round(pr, 9) AS pr FROM r{ROUNDS})) WHERE rank <= 10""",
    "q35_partition_sizes": f"""WITH {GRAPH}, p AS (
      SELECT 'hash' AS scheme, (((node_id % {PARTS}) + {PARTS}) % {PARTS})::INT AS part FROM lists UNION ALL
      SELECT 'range', (((floor(node_id::DOUBLE / 200000000.0 * {PARTS})::BIGINT % {PARTS}) + {PARTS}) % {PARTS})::INT FROM lists)
      SELECT scheme, part, count(*) AS nodes FROM p GROUP BY scheme, part""",
    "q36_weak_components": _components(),
    "q37_hourly_posts": f'SELECT {MD}, {HH}, count(*) AS "count" FROM events WHERE ts IS NOT NULL AND event_id IS NOT NULL AND user_id IS NOT NULL AND event_type IS NOT NULL GROUP BY 1, 2',
    "q38_hourly_posts_filtered": f"""SELECT {MD}, {HH}, count(*) AS "count" FROM events
      WHERE ts IS NOT NULL AND event_id IS NOT NULL AND user_id IS NOT NULL AND regexp_matches(event_type, '(?i)view|error') GROUP BY 1, 2""",
    "q39_message_counters": f"""WITH {GRAPH}, t AS (SELECT dst, count(*) AS n, dst IN (SELECT node_id FROM lists) AS known FROM edges GROUP BY dst)
      SELECT sum(n)::BIGINT AS messages, count(*) FILTER (known) AS receivers, count(*) FILTER (NOT known) AS missing_nodes,
        coalesce(sum(n) FILTER (NOT known), 0)::BIGINT AS lost_messages FROM t""",
    "q40_rank_lines": f"""{_pagerank(ROUNDS)} SELECT source_id, rank, printf('%.5f %d', pr, node_id) AS line FROM (
      SELECT source_id, node_id, pr, row_number() OVER (PARTITION BY source_id ORDER BY pr DESC, node_id)::INT AS rank
      FROM (SELECT node_id, source_id, round(pr, 9) AS pr FROM r{ROUNDS})) WHERE rank <= 10""",
    "q45_pagerank_converged": _converging(),
    "q46_text_round_trip": f"{L} SELECT regexp_replace(line, '[\\r\\n]', ' ', 'g') AS line, count(*) AS n FROM lines GROUP BY 1",
    "q48_adjacency_round_trip": f"""WITH {GRAPH} SELECT node_id, count(dst) AS degree, coalesce(sum(dst), 0)::BIGINT AS total
      FROM lists LEFT JOIN edges ON src = node_id GROUP BY node_id""",
    "p4_found": f"""WITH {IN_FORCE}, {GRAPH},
      t AS (SELECT term, count(*) AS n FROM post GROUP BY term), e AS (SELECT dst, count(*) AS n FROM edges GROUP BY dst)
      SELECT 'term' AS key_kind, term AS key_text FROM t WHERE 100 * n >= (SELECT sum(n) FROM t)
      UNION ALL SELECT 'node', dst::VARCHAR FROM e WHERE 100 * n >= (SELECT sum(n) FROM e)""",
    "p4_terms": f"WITH {IN_FORCE} SELECT term, count(*) AS entries, sum(tf)::BIGINT AS tf FROM post GROUP BY term",
    "p4_nodes": f"WITH {GRAPH} SELECT dst AS node_id, count(*) AS entries, count(DISTINCT src) AS pointers FROM edges GROUP BY dst",
}

ORACLE |= {
    "q41_hourly_ordered": ORACLE["q05_hourly_counts"] + " ORDER BY md, h",
    "q42_boolean_decoded": ORACLE["q28_boolean_snippet_80"],
    "q43_stripes_cf": f"{L}, {J}, {CF}, {PAIRS}, {PMI} SELECT x, y, pmi FROM pmi",
    "q44_placed_partitions": ORACLE["q35_partition_sizes"],
    "q47_posts_round_trip": ORACLE["q37_hourly_posts"] + " ORDER BY md, h",
    "q49_key_values_round_trip": ORACLE["q01_word_count"],
    "q50_sorted_round_trip": ORACLE["q20_lookup"],
    "q51_table_round_trip": ORACLE["q04_word_fetch"],
}
