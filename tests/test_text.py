import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from rows import rows

from tallyloom.functions.codec import decode_varints, encode_varints
from tallyloom.functions.postfix import parse_postfix
from tallyloom.functions.tokens import alphabetic, distinct_tokens, tokens
from tallyloom.operators import boolean, cooccur, invindex, wordcount

LINES = "docno bigint, line string, term string, count int"


def lines(spark, *texts):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)], LINES)


def test_token_styles(spark):
    df = spark.createDataFrame([("  a b\tc\vd  ",), (None,), ("",), (" \n",)], "line string")
    java, blank = (df.select(tokens(F.col("line"), s)).collect() for s in ("java", "blanks"))
    assert [r[0] for r in java] == [["a", "b", "c\vd"], [], [], []]
    assert [r[0] for r in blank] == [["a", "b", "c", "d"], [], [], []]
    assert df.select(distinct_tokens(F.lit("b a b é Z"))).first()[0] == ["Z", "a", "b", "é"]


def test_alphabetic_terms(spark):
    df = spark.createDataFrame([(t,) for t in ("don't", "für", "Abc", "x1", "Abc\n")], "t string")
    assert rows(df.where(alphabetic(F.col("t")))) == [("Abc",)]


def test_word_counts(spark):
    data = lines(spark, "a b a", None, "", "b c! a", "a b a")
    assert rows(wordcount.word_count(data)) == [("a", 5), ("b", 3), ("c!", 1)]
    assert rows(wordcount.word_count(data, only_alphabetic=True)) == [("a", 5), ("b", 3)]
    assert rows(wordcount.line_frequency(data)) == [("a", 3), ("b", 3), ("c!", 1)]
    assert rows(wordcount.vocabulary_sizes(data)) == [(3, 2, 9)]
    assert rows(wordcount.fetch(wordcount.word_count(data), ["a", "zz", "a"])) == [("a", 5), ("zz", 0)]
    assert rows(wordcount.vocabulary_sizes(lines(spark).limit(0))) == [(0, 0, 0)]


def test_one_pair_for_repeats(spark):
    assert rows(cooccur.pair_counts(lines(spark, "b a b", None, " "), 1)) == [("a", "b", 1)]


def test_pmi_of_a_known_case(spark):
    data = spark.range(156215).select(F.col("id").alias("docno"), F.when(F.col("id") < 14, "meshach shadrach").otherwise("x").alias("line"))
    (found,) = cooccur.pmi(data).collect()
    assert (found.x, found.y, found.pairs) == ("meshach", "shadrach", 14)
    assert found.pmi == pytest.approx(4.047594697476721, abs=1e-12)


def brute_pairs(texts, least):
    counts = Counter()
    for t in texts:
        words = sorted(set((t or "").split()))
        counts.update((x, y) for i, x in enumerate(words) for y in words[i + 1 :])
    return sorted((x, y, n) for (x, y), n in counts.items() if n >= least)


def test_pairs_against_brute_force(spark):
    draw = random.Random(3)
    texts = [" ".join(draw.choices("abcdefghij", k=draw.randrange(0, 9))) for _ in range(300)]
    data = lines(spark, *texts)
    assert rows(cooccur.pair_counts(data, 20)) == brute_pairs(texts, 20)
    flat = cooccur.stripes(cooccur.pmi(data, 20)).select("x", F.explode("stripe").alias("y", "pmi"))
    assert rows(flat) == rows(cooccur.pmi(data, 20), "x", "y", "pmi")


def test_marginals(spark):
    data = lines(spark, *["a a b"] * 10)
    df, cf = (cooccur.pmi(data, marginals=m).first().pmi for m in ("df", "cf"))
    assert df == pytest.approx(0) and cf == pytest.approx(-0.30103, abs=1e-5)
    with pytest.raises(ValueError):
        cooccur.pmi(data, marginals="x")


def test_top_pairs_and_ties(spark):
    scored = spark.createDataFrame([("a", "b", 1, 2.0), ("a", "c", 1, 2.0), ("b", "c", 1, 1.0)], "x string, y string, pairs int, pmi double")
    assert rows(cooccur.top_pair(scored), "x", "y") == [("a", "c")]
    found = rows(cooccur.top_partners(scored, ["a", "c", "zz"], 3), "term", "rank", "x", "y")
    assert found == [("a", 1, "a", "b"), ("a", 2, "a", "c"), ("c", 1, "a", "c"), ("c", 2, "b", "c")]


def test_index(spark):
    data = spark.createDataFrame([(42, "x y x"), (0, "x"), (15, "y"), (10, None), (11, ""), (None, "lost")], "docno bigint, line string")
    index = invindex.postings(data)
    assert rows(index) == [("x", 0, 1), ("x", 42, 2), ("y", 15, 1), ("y", 42, 1)]
    assert rows(invindex.document_frequency(index)) == [("x", 2, 3), ("y", 2, 2)]
    lists = invindex.postings_lists(index).orderBy("term", "block").collect()
    assert [(r.term, r.block, r.docs, [tuple(p) for p in r.postings]) for r in lists] == [("x", 0, 2, [(0, 1), (42, 2)]), ("y", 0, 2, [(15, 1), (42, 1)])]
    assert rows(invindex.gaps(index), "term", "gap") == [("x", 0), ("x", 42), ("y", 15), ("y", 27)]
    assert rows(invindex.decompressed(invindex.compressed(index))) == rows(index)
    assert rows(invindex.lookup(index, "nope")) == []
    assert rows(invindex.tf_histogram(index, ["x", "nope"])) == [("x", 1, 1), ("x", 2, 1)]
    assert rows(invindex.postings_lists(index.limit(0))) == []


def test_lists_in_many_blocks(spark):
    docnos = [-70000, -65536, -1, 0, 65535, 65536, 10**12]
    index = spark.createDataFrame([("t", d, 1 + k) for k, d in enumerate(docnos)], "term string, docno bigint, tf bigint")
    assert rows(invindex.gaps(index), "docno", "gap") == [(d, d - p) for d, p in zip(docnos, [0, *docnos])]
    assert rows(invindex.decompressed(invindex.compressed(index))) == rows(index)
    assert rows(invindex.postings_lists(index).groupBy("term").sum("docs")) == [("t", 7)]
    assert max(r.docs for r in invindex.postings_lists(index).collect()) == 2


def test_numbering(spark):
    from tallyloom.operators.numbering import numbered, sized

    words = [chr(0x61 + k % 26) + str(k) for k in range(500)] + ["é", "\U0001f600", "｡"]
    found = numbered(spark.createDataFrame([(w, 1) for w in words], "term string, n int").repartition(7), "term")
    assert [r.term for r in found.orderBy("code").collect()] == sorted(words, key=str.encode)
    assert [r.code for r in found.orderBy("code").collect()] == list(range(503))
    assert rows(numbered(found.limit(0).drop("code"), "term")) == []
    hinted = [("strategy=broadcast" in d._jdf.queryExecution().toString()) for d in (sized(spark.range(6)), sized(spark.range(6), rows=5), sized(spark.range(6), size=40))]
    assert hinted == [True, False, False]


def test_varints():
    values = np.array([0, 1, 127, 128, 16383, 16384, 2**32, 2**63 - 1, 2**64 - 1], dtype=np.uint64)
    assert (decode_varints(encode_varints(values)) == values).all()
    assert encode_varints(np.array([300])) == b"\xac\x02" and encode_varints(np.array([])) == b"" and len(decode_varints(b"")) == 0


def test_coded_lists_with_nulls(spark):
    from tallyloom.functions.codec import decode_postings, encode_postings

    data = [(0, [0, 5, 300], [1, 2, 70000]), (7, None, None), (10, [], []), (-65536, [-65536, -1], [1, 2**40]), (5, [2**62], [3])]
    df = spark.createDataFrame(data, "b bigint, d array<bigint>, t array<bigint>").coalesce(1)
    coded = df.select("b", encode_postings("b", "d", "t").alias("x")).cache()
    assert [None if r.x is None else bytes(r.x) for r in coded.collect()][:3] == [b"\x03\x00\x01\x05\x02\xa7\x02\xf0\xa2\x04", None, b"\x00"]
    back = [(r.b, r.p.docno, r.p.tf) for r in coded.select("b", decode_postings("b", "x").alias("p")).collect()]
    assert back == data


def test_boolean_queries(spark):
    data = lines(spark, "white rose pluck", "red rose", "red rose pluck", "white pluck", None)
    index = invindex.postings(data)
    assert rows(boolean.matches(index, "white red OR rose AND pluck AND")) == [(0,), (2,)]
    assert rows(boolean.matches(index, "rose")) == [(0,), (1,), (2,)]
    assert rows(boolean.matches(index, "rose nothing AND")) == []
    assert rows(boolean.matches(index, "rose nothing OR")) == [(0,), (1,), (2,)]
    assert rows(boolean.retrieve(index, data, "rose pluck AND", 5)) == [(0, "white"), (2, "red r")]
    for bad in ("AND", "a AND", "a b", ""):
        with pytest.raises(ValueError):
            parse_postfix(bad)
