import os

import pytest
from pyspark.sql import functions as F
from test_queries import FOLDER, compare

from tallyloom.llm import queries
from tallyloom.llm.pairs import records_of_lines
from tallyloom.sources import lines_in_force, load

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, name):
    compare(spark, queries.QUERIES[name], queries.ORACLE[name])


def test_columns(spark):
    found = {n: queries.QUERIES[n](spark, FOLDER).columns for n in queries.QUERIES if n.endswith("_found") or n == "p7_ids"}
    assert found == {
        "p1_found": ["x", "y"],
        "p2_found": ["term"],
        "p3_found": ["term", "mark"],
        "p5_found": ["source_id", "node_id"],
        "p6_found": ["docno", "term"],
        "p7_ids": ["doc_id", "ids"],
        "p9_found": ["doc_id", "end_pos"],
    }


def test_all_pairs(spark):
    """Every pair is there: each record of k different tokens adds k * (k - 1) / 2, and the frequent pairs are those of p1_pairs."""
    items = records_of_lines(lines_in_force(load(spark, FOLDER, "passages"))).select(F.size(F.array_distinct("items")).cast("bigint").alias("k")).where("k > 0")
    expected = items.agg(F.sum(F.expr("k * (k - 1) div 2"))).first()[0]
    found = queries.QUERIES["p1_all_pairs"](spark, FOLDER).cache()
    assert found.agg(F.sum("pairs")).first()[0] == expected
    assert found.where("pairs < 10").count() > 0
    frequent, listed = found.where("pairs >= 10"), queries.QUERIES["p1_pairs"](spark, FOLDER)
    assert frequent.exceptAll(listed).count() == listed.exceptAll(frequent).count() == 0
    found.unpersist()
