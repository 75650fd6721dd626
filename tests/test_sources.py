import math
from datetime import datetime

import pytest
from pyspark.sql import types as T
from rows import rows

from tallyloom.sources import adjacency_text, lines_in_force, lines_with_offset, lists_in_force, postings_in_force, ranks_in_force, tweets_tsv

OLD, NEW = datetime(2014, 1, 1), datetime(2014, 1, 2)
PASSAGES = "docno bigint, line string, loaded_at timestamp_ntz, _best string"
POSTINGS = "term string, docno bigint, tf bigint, written_at timestamp_ntz, n int"
ADJACENCY = "node_id bigint, nbrs array<bigint>, crawled_at timestamp_ntz, pr double"
RANKS = "node_id bigint, source_id bigint, pr double, iteration int, rank int"


def test_newest_line_counts(spark):
    data = [(1, "old", OLD, "x"), (1, "new", NEW, "y"), (1, "new", NEW, "y"), (2, "b", NEW, None), (2, "a", NEW, None), (3, "gone", OLD, "z"), (3, None, NEW, "z"), (None, "x", NEW, "z"), (4, "no time", None, "z"), (4, "time", OLD, "z"), (5, "", NEW, "z")]
    assert rows(lines_in_force(spark.createDataFrame(data, PASSAGES))) == [(1, "new"), (2, "b"), (4, "time"), (5, "")]
    assert rows(lines_in_force(spark.createDataFrame([], PASSAGES))) == []


def test_rows_that_are_no_postings_supersede_nothing(spark):
    data = [("a", 1, 2, OLD, 0), ("a", 1, None, NEW, 0), ("a", 1, 0, NEW, 0), ("a", 2, 5, OLD, 0), ("a", 2, 3, NEW, 0), ("a", 2, 3, NEW, 0), ("a", 3, 4, NEW, 0), ("a", 3, 9, NEW, 0), (None, 1, 1, NEW, 0), (" \t", 1, 1, NEW, 0), ("", 1, 1, NEW, 0), ("b", None, 1, NEW, 0), ("c", 1, 7, None, 0), ("c", 1, 6, OLD, 0), ("d", -5, 2**62, NEW, 0)]
    assert rows(postings_in_force(spark.createDataFrame(data, POSTINGS))) == [("a", 1, 2), ("a", 2, 3), ("a", 3, 9), ("c", 1, 6), ("d", -5, 2**62)]
    assert rows(postings_in_force(spark.createDataFrame([], POSTINGS))) == []


def test_times_do_not_depend_on_the_zone_of_the_session(spark):
    # in this zone one wall clock hour comes twice on that day
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        times = [datetime(2014, 11, 2, 0, 59, 59, 999999), datetime(2014, 11, 2, 1, 30), datetime(2014, 11, 2, 1, 30, 0, 1), datetime(1969, 12, 31, 23, 59, 59, 1)]
        for kind in ("timestamp_ntz", "timestamp"):
            data = [("a", 1, k + 1, t, 0) for k, t in enumerate(times)]
            df = spark.createDataFrame(data, POSTINGS.replace("timestamp_ntz", kind))
            assert rows(postings_in_force(df)) == [("a", 1, 3)]
            assert rows(postings_in_force(df.where("tf <> 3 AND tf <> 2"))) == [("a", 1, 1)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_lists_lose_null_elements_only(spark):
    data = [(1, [3, None, 3], NEW, 0.0), (1, [9], OLD, 0.0), (2, None, NEW, 0.0), (2, [1], OLD, 0.0), (3, [], NEW, 0.0), (None, [1], NEW, 0.0)]
    assert rows(lists_in_force(spark.createDataFrame(data, ADJACENCY))) == [(1, [3, 3]), (2, []), (3, [])]


def test_ranks_by_iteration(spark):
    nan = float("nan")
    data = [(1, 9, 0.5, 1, 0), (1, 9, 0.4, 2, 0), (2, 9, 0.5, 1, 0), (2, 9, nan, 2, 0), (3, 9, 0.5, 1, 0), (3, 9, None, 2, 0), (4, 9, nan, 2, 0), (4, 9, 0.1, 2, 0), (5, 9, -0.0, 1, 0), (None, 9, 1.0, 1, 0), (6, None, 1.0, 1, 0), (7, 9, 0.7, None, 0)]
    found = rows(ranks_in_force(spark.createDataFrame(data, RANKS)))
    assert found == [(9, 1, 0.4), (9, 4, 0.1), (9, 5, 0.0), (9, 7, 0.7)]
    assert math.copysign(1, found[2][2]) == 1


def test_text_sources(spark, tmp_path):
    (tmp_path / "lines").write_bytes("first\nzwölf\n\nlast".encode())
    assert rows(lines_with_offset(spark, str(tmp_path / "lines"))) == [(0, "first"), (6, "zwölf"), (13, ""), (14, "last")]
    (tmp_path / "graph").write_text("1 2 3\n 4\t1\n5\n\nx 1\n6 y 7\n")
    assert rows(adjacency_text(spark, str(tmp_path / "graph"))) == [(1, [2, 3]), (4, [1]), (5, []), (6, [7])]
    (tmp_path / "posts").write_text('1\tu\tSun Jan 23 00:05:09 -0500 2011\tsay "hi"\n2\tu\tshort\n3\tu\td\tt\tmore\n')
    assert rows(tweets_tsv(spark, str(tmp_path / "posts")), "post_id", "text") == [("1", 'say "hi"'), ("3", "t")]


def test_checkpoint_folder_is_demanded_on_a_cluster(spark, monkeypatch):
    from tallyloom import session

    class Context:
        master = "spark://x:7077"
        _jsc = type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: type("O", (), {"isDefined": lambda self: False})()})()})()

        def getConf(self):
            return {}

    with pytest.raises(RuntimeError):
        session.ensure_checkpoint_dir(type("Session", (), {"sparkContext": Context()})())


def test_cut_keeps_rows_and_types(spark):
    from tallyloom.session import cut, discard

    df = spark.createDataFrame([(1, ["a", None], {"k": 1.5}), (None, None, None)], T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.ArrayType(T.StringType())), T.StructField("c", T.MapType(T.StringType(), T.DoubleType()))]))
    again = cut(df)
    assert again.dtypes == df.dtypes and rows(again, "a", "b") == rows(df, "a", "b")
    discard(again)


def test_nothing_stays_in_the_shared_folder(spark):
    """What operators write goes at the end of the block; the rounds of an iteration go as they are superseded."""
    from pathlib import Path

    from tallyloom.operators import cooccur, graph
    from tallyloom.session import cut, ensure_checkpoint_dir, scratch

    folder = Path(ensure_checkpoint_dir(spark).removeprefix("file:")) / "tables"
    lines = spark.createDataFrame([(k, "a b c") for k in range(20)], "docno bigint, line string")
    chain = spark.createDataFrame([(k, [(k + 1) % 9]) for k in range(9)], "node_id bigint, nbrs array<bigint>")
    before = set(folder.iterdir()) if folder.exists() else set()
    with scratch(spark):
        assert cooccur.pmi(lines).count() == 3
        ranks = graph.pagerank_to_convergence(chain, 0, jump=0.5, tolerance=1e-6)
        assert len(set(folder.iterdir()) - before) < 10
        assert ranks.count() == 9
        with scratch(spark) as keep:
            cut(lines)
            kept = keep(cut(lines))
        assert kept.count() == 20
        found = graph.weak_components(chain)
        assert found.count() == 9
    assert set(folder.iterdir()) - before == set()
