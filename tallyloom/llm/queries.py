"""Queries pN_... over whole tables, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import bitmaps, packing, pairs, relevance, sentences, tokenizer, topn, topterms
from tallyloom.session import cut
from tallyloom.sources import lines_in_force, load, ranks_in_force

Query = Callable[[SparkSession, str], DataFrame]

MIN_PAIRS, MIN_PMI = 10, 1.1
HEAVY_SHARE, TOP_TERMS = 0.001, 100
RARE_BELOW, COMMON_ABOVE = 3, 0.1
TOP_NODES = 5
MARGIN = 2.1
CAPACITY = 2048
#: A container of the constrained packing: few documents, and half the attention cost of one long text.
CONSTRAINED = packing.Limits(CAPACITY, items=6, attention=CAPACITY**2 // 2, rule="dot")


def _pairs(spark: SparkSession, folder: str, min_count: int = MIN_PAIRS) -> DataFrame:
    return pairs.item_pairs(pairs.records_of_lines(lines_in_force(load(spark, folder, "passages"))), min_count)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return _pairs(spark, folder).where(F.col("pmi") >= MIN_PMI).select("x", "y")


def p1_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return _pairs(spark, folder).withColumns({c: F.round(c, 6) for c in ("pmi", "log_odds")})


def p1_all_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Every pair of tokens that share a line, also those in one line only."""
    return _pairs(spark, folder, 1).withColumns({c: F.round(c, 6) for c in ("pmi", "log_odds")})


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return topterms.heavy_items(load(spark, folder, "word_counts"), HEAVY_SHARE).select(F.col("item").alias("term"))


def p2_top(spark: SparkSession, folder: str) -> DataFrame:
    return topterms.top_items(load(spark, folder, "word_counts"), TOP_TERMS).select(F.col("item").alias("term"), F.col("total").cast("bigint").alias("total"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return bitmaps.marked_terms(load(spark, folder, "postings"), RARE_BELOW, COMMON_ABOVE).where("mark IS NOT NULL").select("term", "mark")


def p3_terms(spark: SparkSession, folder: str) -> DataFrame:
    return bitmaps.marked_terms(load(spark, folder, "postings"), RARE_BELOW, COMMON_ABOVE)


def _top_nodes(spark: SparkSession, folder: str) -> DataFrame:
    return topn.top_n(ranks_in_force(load(spark, folder, "page_ranks")), "source_id", "node_id", "pr", TOP_NODES)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return _top_nodes(spark, folder).select("source_id", "node_id")


def p6_scores(spark: SparkSession, folder: str) -> DataFrame:
    scored = relevance.score_terms(load(spark, folder, "postings"))
    return scored.select("docno", "term", F.round("bm25", 6).alias("bm25"), F.round("tf_idf", 6).alias("tf_idf"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return relevance.leading_terms(relevance.tf_idf(load(spark, folder, "postings")), MARGIN)


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokenizer.encode_texts(load(spark, folder, "documents"))


def p7_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, text) again from the ids; null texts come back empty."""
    ids = tokenizer.encode_texts(load(spark, folder, "documents"))
    return tokenizer.decode_ids(ids).select("doc_id", F.decode("data", "UTF-8").alias("text"))


def _packed(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(tokenizer.count_tokens(load(spark, folder, "documents")), packing.Limits(CAPACITY))


def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    return packing.containers(_packed(spark, folder))


def p8_constrained(spark: SparkSession, folder: str) -> DataFrame:
    """A packing under all three constraints, as the number of breaks of each."""
    packed = cut(packing.pack(tokenizer.count_tokens(load(spark, folder, "documents")), CONSTRAINED))
    return packing.broken_limits(packed, CONSTRAINED)


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return sentences.split_sentences(load(spark, folder, "documents"))


QUERIES: dict[str, Query] = {
    "p1_found": p1_found,
    "p1_pairs": p1_pairs,
    "p1_all_pairs": p1_all_pairs,
    "p2_found": p2_found,
    "p2_top": p2_top,
    "p3_found": p3_found,
    "p3_terms": p3_terms,
    "p5_found": p5_found,
    "p5_top": _top_nodes,
    "p6_found": p6_found,
    "p6_scores": p6_scores,
    "p7_ids": p7_ids,
    "p7_round_trip": p7_round_trip,
    "p8_pack": _packed,
    "p8_containers": p8_containers,
    "p8_constrained": p8_constrained,
    "p9_found": p9_found,
}

BLANK = "[ \\t\\n\\x0B\\f\\r]"
LINES = f"""lines AS (SELECT docno, line FROM (
    SELECT docno, line, row_number() OVER (PARTITION BY docno ORDER BY loaded_at DESC NULLS LAST, line DESC NULLS LAST) AS rn
    FROM passages WHERE docno IS NOT NULL) WHERE rn = 1 AND line IS NOT NULL),
  tok AS (SELECT DISTINCT docno, term FROM (SELECT docno, unnest(string_split_regex(line, '{BLANK}+')) AS term FROM lines) WHERE term <> ''),
  df AS (SELECT term, count(*) AS df FROM tok GROUP BY term), total AS (SELECT count(DISTINCT docno)::DOUBLE AS n FROM tok),
  pairs AS (SELECT a.term AS x, b.term AS y, count(*) AS pairs FROM tok a JOIN tok b ON a.docno = b.docno AND a.term < b.term GROUP BY 1, 2 HAVING count(*) >= {MIN_PAIRS}),
  scored AS (SELECT x, y, pairs, c.df AS x_records, d.df AS y_records, n FROM pairs JOIN df c ON c.term = x JOIN df d ON d.term = y, total)"""
COUNTS = "counts AS (SELECT term, cell_count AS n FROM word_counts WHERE regexp_matches(term, '[^ \\t\\n\\x0B\\f\\r]') AND cell_count >= 1), sums AS (SELECT term, sum(n) AS total FROM counts GROUP BY term)"
POSTINGS = """post AS (SELECT term, docno, tf FROM (
    SELECT term, docno, tf, row_number() OVER (PARTITION BY term, docno ORDER BY written_at DESC NULLS LAST, tf DESC) AS rn
    FROM postings WHERE regexp_matches(term, '[^ \\t\\n\\x0B\\f\\r]') AND docno IS NOT NULL AND tf >= 1) WHERE rn = 1),
  df AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS tf FROM post GROUP BY term), total AS (SELECT count(DISTINCT docno)::DOUBLE AS n FROM post)"""
MARKS = f"""marks AS (SELECT term, df, tf, CASE WHEN df < {RARE_BELOW} THEN 'rare' WHEN df / n > {COMMON_ABOVE} THEN 'common' END AS mark FROM df, total)"""
RANKED = f"""ranked AS (SELECT source_id, node_id, pr, row_number() OVER (PARTITION BY source_id ORDER BY pr DESC, node_id)::INT AS rank FROM (
    SELECT source_id, node_id, pr + 0 AS pr FROM (
      SELECT *, row_number() OVER (PARTITION BY source_id, node_id ORDER BY iteration DESC NULLS LAST, CASE WHEN isnan(pr) THEN NULL ELSE pr END DESC NULLS LAST) AS rn
      FROM page_ranks WHERE source_id IS NOT NULL AND node_id IS NOT NULL) WHERE rn = 1 AND pr IS NOT NULL AND NOT isnan(pr)))"""
SCORES = """lengths AS (SELECT docno, sum(tf)::DOUBLE AS len FROM post GROUP BY docno), average AS (SELECT avg(len) AS a FROM lengths),
  scores AS (SELECT docno, term, post.tf * log10(n / df) AS tf_idf,
    ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * post.tf * 2.2::DOUBLE / (post.tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / a)) AS bm25
    FROM post JOIN df USING (term) JOIN lengths USING (docno), total, average)"""

ORACLE: dict[str, str] = {
    "p1_found": f"WITH {LINES} SELECT x, y FROM scored WHERE log10(pairs * n / (x_records * y_records)) >= {MIN_PMI}",
    "p1_pairs": f"""WITH {LINES} SELECT x, y, pairs, x_records, y_records, n::BIGINT AS records, round(log10(pairs * n / (x_records * y_records)), 6) AS pmi,
      round(ln((pairs + 0.5::DOUBLE) * (n - x_records - y_records + pairs + 0.5::DOUBLE) / ((x_records - pairs + 0.5::DOUBLE) * (y_records - pairs + 0.5::DOUBLE))), 6) AS log_odds FROM scored""",
    "p2_found": f"WITH {COUNTS} SELECT term FROM sums WHERE 1000 * total >= (SELECT sum(total) FROM sums)",
    "p2_top": f"WITH {COUNTS} SELECT term, total::BIGINT AS total FROM sums ORDER BY total DESC, term LIMIT {TOP_TERMS}",
    "p3_found": f"WITH {POSTINGS}, {MARKS} SELECT term, mark FROM marks WHERE mark IS NOT NULL",
    "p3_terms": f"WITH {POSTINGS}, {MARKS} SELECT * FROM marks",
    "p5_found": f"WITH {RANKED} SELECT source_id, node_id FROM ranked WHERE rank <= {TOP_NODES}",
    "p5_top": f"WITH {RANKED} SELECT source_id, rank, node_id, pr FROM ranked WHERE rank <= {TOP_NODES}",
    "p6_scores": f"WITH {POSTINGS}, {SCORES} SELECT docno, term, round(bm25, 6) AS bm25, round(tf_idf, 6) AS tf_idf FROM scores",
    "p6_found": f"""WITH {POSTINGS}, {SCORES}, two AS (SELECT *, row_number() OVER (PARTITION BY docno ORDER BY tf_idf DESC, term) AS rank FROM scores)
      SELECT docno, a.term FROM two a JOIN two b USING (docno) WHERE a.rank = 1 AND b.rank = 2 AND a.tf_idf > 0 AND a.tf_idf >= {MARGIN}::DOUBLE * b.tf_idf""",
    "p8_constrained": "SELECT * FROM (VALUES ('tokens', 0), ('items', 0), ('attention', 0), ('whole', 0)) t(\"limit\", broken) UNION ALL SELECT 'items_packed', count(*) FROM documents",
    "p7_round_trip": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
