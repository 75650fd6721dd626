from datetime import datetime

import pytest
from pyspark.sql import functions as F
from rows import rows

from tallyloom.operators import sinks, skew, timebucket
from tallyloom.streaming import hourly_stream, run_once


def test_dates(spark):
    posts = [("1", "u", "Sun Jan 23 00:05:09 -0500 2011", "Cairo"), ("2", "u", "Sun Jan 23 05:59:59 +0000 2011", "eGyPt"), ("3", "u", "yesterday", "cairo"), ("4", "u", "Tue Feb 1 23:00:00 +0000 2011", "none"), ("5", None, "Tue Feb 1 23:00:00 +0000 2011", "cairo"), ("6", "u", None, "cairo")]
    data = spark.createDataFrame(posts, "post_id string, user_id string, date string, text string")
    assert rows(timebucket.hourly_posts(data)) == [("1/23", "05", 2), ("2/1", "23", 1)]
    assert rows(timebucket.hourly_posts(data, "(?i)egypt|cairo")) == [("1/23", "05", 2)]


def test_hourly_counts(spark):
    data = spark.createDataFrame([(datetime(2024, 1, 2, 3), "click", 1), (datetime(2024, 1, 2, 3, 59), "view", 1), (None, "click", 1)], "ts timestamp, event_type string, md int")
    assert rows(timebucket.hourly_counts(data)) == [("1/2", "03", 2)]
    assert rows(timebucket.filtered_hourly_counts(data, "CLICK(?-i)|click", "event_type")) == [("1/2", "03", 1)]
    assert rows(timebucket.complete_rows(data, ["ts"]), "event_type") == [("click",), ("view",)]
    assert rows(timebucket.hourly_counts(data.limit(0))) == []


def test_hours_in_order(spark):
    data = spark.createDataFrame([(datetime(2024, m, d, h),) for m, d, h in ((2, 1, 5), (1, 4, 0), (1, 23, 11), (1, 23, 2), (12, 1, 1))], "ts timestamp")
    assert [(r.md, r.h) for r in timebucket.ordered(timebucket.hourly_counts(data)).collect()] == [("1/23", "02"), ("1/23", "11"), ("1/4", "00"), ("12/1", "01"), ("2/1", "05")]


def test_stream(spark, tmp_path):
    data = spark.createDataFrame([(datetime(2024, 1, 2, 3, m),) for m in range(5)] + [(datetime(2024, 1, 2, 4),)], "ts timestamp")
    data.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(data.schema).parquet(str(tmp_path / "in"))
    assert sorted(r["count"] for r in run_once(spark, hourly_stream(stream), "hours").collect()) == [1, 5]


def test_heavy_keys(spark):
    index = spark.createDataFrame([("hot", d, 2, "x") for d in range(99)] + [("cold", 5, 1, "x")], "term string, docno bigint, tf bigint, entries string")
    per_term = skew.per_term(index)
    assert rows(per_term) == [("cold", 1, 1), ("hot", 99, 198)]
    assert rows(skew.heavy_keys(per_term, 0.01), "term") == [("cold",), ("hot",)]
    assert rows(skew.heavy_keys(per_term, 0.0101), "term") == [("hot",)]
    assert rows(skew.heavy_keys(per_term.limit(0), 0.01)) == []
    kinds = spark.createDataFrame([("a", "x", 99), ("a", "y", 1), ("b", "x", 1)], "kind string, key string, entries int")
    assert rows(skew.heavy_keys(kinds, 0.5, "kind"), "kind", "key") == [("a", "x"), ("b", "x")]
    graph = spark.createDataFrame([(1, [7, 7, 8]), (2, [7]), (3, [])], "node_id bigint, nbrs array<bigint>")
    assert rows(skew.per_node(graph)) == [(7, 3, 2), (8, 1, 1)]
    assert rows(skew.per_node(graph.limit(0))) == []


@pytest.mark.parametrize("limit", [100, 0])
def test_lookup_splits_hot_keys(spark, limit, monkeypatch):
    monkeypatch.setattr(skew, "HOT_SHARE", 0.3)
    data = spark.createDataFrame([("hot", k) for k in range(60)] + [("warm", k) for k in range(30)] + [(f"c{k}", k) for k in range(10)] + [(None, 1), ("unknown", 1)], "term string, v int")
    facts = spark.createDataFrame([("hot", 60, 1), ("warm", 30, 2), *[(f"c{k}", 1, 3) for k in range(10)]], "term string, n int, code int")
    found = skew.lookup(data, facts, "term", "n", limit)
    assert found.count() == 100 and rows(found.where("term = 'hot'").select("code").distinct()) == [(1,)]
    assert rows(found.groupBy("term").count()) == rows(facts, "term", "n")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b", 1), ("a", None)], "term string, n int")
    for _ in range(2):
        sinks.write_text(df, str(tmp_path / "text"))
        sinks.write_columnar(df, str(tmp_path / "columns"))
        sinks.write_sorted(df, str(tmp_path / "sorted"), "term")
    assert rows(spark.read.text(str(tmp_path / "text"))) == [("a\t",), ("b\t1",)]
    assert rows(spark.read.parquet(str(tmp_path / "columns"))) == rows(df)
    found = spark.read.parquet(str(tmp_path / "sorted")).where(F.col("term") == "a")
    assert rows(found) == [("a", None)]
    assert "EqualTo(term,a)" in found._jdf.queryExecution().executedPlan().toString()


def test_table_sink(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2)], "term string, n int")
    for _ in range(2):
        sinks.write_table(df, "counts_sink", "term", 4)
    assert rows(spark.table("counts_sink")) == [("a", 2), ("b", 1)]
    spark.sql("DROP TABLE counts_sink")


def test_key_values(spark, tmp_path):
    from tallyloom.sources import key_value_file

    df = spark.createDataFrame([("a", 1), ("b", 2)], "term string, n int")
    sinks.write_key_values(df, str(tmp_path / "seq"))
    assert rows(key_value_file(spark, str(tmp_path / "seq"), "term string, n int")) == [("a", 1), ("b", 2)]
