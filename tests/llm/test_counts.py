import random
from collections import defaultdict
from datetime import datetime

import numpy as np
import pytest
from rows import rows

from tallyloom.llm import bitmaps as B
from tallyloom.llm import records, relevance, topterms
from tallyloom.operators import numbering, skew

COUNTS = "term string, cell_count bigint, total int, item int"
POSTINGS = "term string, docno bigint, tf bigint, written_at timestamp_ntz, df int, block int"
AT = datetime(2014, 1, 1)


def test_totals(spark):
    data = [("a", 5, 0, 0), ("a", 5, 0, 0), ("A", 1, 0, 0), (None, 9, 0, 0), ("", 9, 0, 0), (" \v", 9, 0, 0), ("b", None, 0, 0), ("b", 0, 0, 0), ("c", -4, 0, 0), ("d", 2**62, 0, 0), ("d", 2**62, 0, 0), ("d", 2**62, 0, 0)]
    df = spark.createDataFrame(data, COUNTS)
    assert [(t, int(n)) for t, n in rows(topterms.item_totals(df))] == [("A", 1), ("a", 10), ("d", 3 * 2**62)]
    assert rows(topterms.heavy_items(df, 0.5), "item") == [("d",)]
    assert rows(topterms.top_items(df.limit(0), 3)) == rows(topterms.heavy_items(df.limit(0), 0.5)) == []
    with pytest.raises(ValueError):
        topterms.heavy_items(df, 0)


def test_share_is_exact_and_ties_by_item(spark):
    df = spark.createDataFrame([(f"t{k}", 7, 0, 0) for k in range(100)], COUNTS)
    assert topterms.heavy_items(df, 0.01).count() == 100
    assert rows(topterms.top_items(df, 3), "item") == [("t0",), ("t1",), ("t10",)]


@pytest.mark.parametrize("more, found", [(-1, ["x", "y"]), (0, ["x", "y"]), (1, ["y"])])
def test_share_beyond_the_precision_of_doubles(spark, more, found):
    x = 9007199254740993
    df = spark.createDataFrame([("x", x, 0, 0), ("y", 999 * x + more, 0, 0)], COUNTS)
    assert rows(topterms.heavy_items(df, 0.001), "item") == [(f,) for f in found]


def test_containers():
    draw = np.random.default_rng(1)
    for n in (1, 100, 4096, 4097, 65536):
        low = np.sort(draw.choice(65536, n, replace=False))
        assert (B.from_container(B.to_container(low), n) == low).all()


def decoded(index):
    """Docnos of each term, by the rows that name the records of a block."""
    records = {r.block: np.frombuffer(bytes(r.container), dtype="<i8") for r in index if r.term is None}
    held = defaultdict(list)
    for r in index:
        if r.term is not None:
            held[r.term] += records[r.block][B.from_container(bytes(r.container), r.docs)].tolist()
    assert all(len(d) == len(set(d)) for d in held.values())
    return {t: set(d) for t, d in held.items()}, records


@pytest.mark.parametrize("records, postings_, size", [(65536, 1 << 22, 1 << 28), (100, 1 << 22, 1 << 28), (65536, 700, 1 << 28), (65536, 1 << 22, 1000), (1, 1, 1)])
def test_blocks_end_with_a_record(records, postings_, size, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(B, "BLOCK_RECORDS", records)
    monkeypatch.setattr(B, "BLOCK_POSTINGS", postings_)
    monkeypatch.setattr(B, "BLOCK_BYTES", size)
    draw = random.Random(3)
    rows_ = sorted({(draw.randrange(-300, 300), f"t{draw.randrange(40)}") for _ in range(5000)} | {(7, f"u{k}") for k in range(900)})
    batches = [pa.record_batch([pa.array([t for _, t in part]), pa.array([d for d, _ in part]), pa.array([2] * len(part))], ["t", "d", "n"]) for part in (rows_[k : k + 37] for k in range(0, len(rows_), 37))]
    out = [r for b in B._blocks(iter([*batches[:5], batches[0].slice(0, 0), *batches[5:]])) for r in b.to_pylist()]
    index = [type("R", (), r) for r in out]
    truth = defaultdict(set)
    for d, t in rows_:
        truth[t].add(d)
    held, blocks = decoded(index)
    assert held == truth and sum(r["tf"] for r in out) == 2 * len(rows_)
    assert sorted(d for b in blocks.values() for d in b.tolist()) == sorted({d for d, _ in rows_})
    assert max(map(len, blocks.values())) <= records
    assert len({(r["term"], r["block"]) for r in out}) == len(out)


def brute(data):
    best = {}
    for term, docno, tf, at, *_ in data:
        if term is not None and term.strip(" \t\n\v\f\r") and docno is not None and tf is not None and tf >= 1:
            best[term, docno] = max(best.get((term, docno), (datetime.min, 0)), (at or datetime.min, tf))
    out = defaultdict(dict)
    for (term, docno), (_, tf) in best.items():
        out[term][docno] = tf
    return out


def postings(spark):
    draw = random.Random(5)
    data = [("hot", d, 1 + d % 3, AT, 0, 0) for d in range(-70000, 70000, 7)]
    data += [("mid", d, 2, AT, 0, 0) for d in range(0, 200000, 900)]
    data += [(f"r{draw.randrange(300)}", draw.randrange(10**6), draw.randrange(-1, 4), AT.replace(day=draw.randrange(1, 9)), 0, 0) for _ in range(2000)]
    data += [("dense", d, 1, AT, 0, 0) for d in range(65536, 65536 + 6000)] + [("x", None, 1, AT, 0, 0), (None, 1, 1, AT, 0, 0), (" ", 1, 1, AT, 0, 0), ("x", 1, None, AT, 0, 0), ("y", 5, 2, None, 0, 0), ("y", 5, 2, None, 0, 0)]
    return spark.createDataFrame(data, POSTINGS), brute(data)


def test_frequencies_against_brute_force(spark):
    df, truth = postings(spark)
    df = df.repartition(5).cache()
    assert rows(B.term_frequencies(df)) == sorted((t, len(d), sum(d.values())) for t, d in truth.items())
    index = B.vertical_index(df).collect()
    held, blocks = decoded(index)
    assert held == {t: set(d) for t, d in truth.items()}
    assert len({(r.term, r.block) for r in index}) == len(index)
    assert max(r.docs for r in index if r.term is not None) > B.ARRAY_MOST
    assert B.term_bitmaps(df).count() == len(index) - len(blocks)
    docs = {d for t in truth.values() for d in t}
    assert rows(B.record_count(df)) == [(len(docs),)]
    marks = {r.term: r.mark for r in B.marked_terms(df).collect()}
    assert marks == {t: "rare" if len(d) < 3 else "common" if len(d) / len(docs) > 0.1 else None for t, d in truth.items()}


def test_records_of_very_many_rows(spark, monkeypatch):
    """They are spread by term, and counted once."""
    monkeypatch.setattr(records, "HOT_ROWS", 50)
    data = [(f"t{k}", d, 1, AT, 0, 0) for d in (1, 2) for k in range(200)] + [("t0", 1, 1, AT, 0, 0)] * 300 + [("t0", d, 3, AT, 0, 0) for d in range(10, 40)] + [(None, 3, 1, AT, 0, 0)] * 99
    df, truth = spark.createDataFrame(data, POSTINGS), brute(data)
    assert rows(B.term_frequencies(df)) == sorted((t, len(d), sum(d.values())) for t, d in truth.items())
    assert rows(B.record_count(df)) == [(32,)]
    held, blocks = decoded(B.vertical_index(df).collect())
    assert held == {t: set(d) for t, d in truth.items()} and {1, 2} < set(blocks)


def test_no_postings(spark):
    df = spark.createDataFrame([], POSTINGS)
    assert rows(B.marked_terms(df)) == rows(B.term_bitmaps(df)) == [] and rows(B.record_count(df)) == [(0,)]
    assert rows(relevance.score_terms(df)) == rows(relevance.tf_idf(df)) == []


@pytest.mark.parametrize("hot, dictionary, hot_rows", [(1 / 2048, 400_000, 1 << 20), (0.05, 0, 1 << 20), (1 / 2048, 400_000, 12)])
def test_scores_against_brute_force(spark, hot, dictionary, hot_rows, monkeypatch):
    """Frequencies by broadcast and by joins; ordinary records and ones that are spread."""
    monkeypatch.setattr(skew, "HOT_SHARE", hot)
    monkeypatch.setattr(numbering, "BROADCAST_ROWS", dictionary)
    monkeypatch.setattr(records, "HOT_ROWS", hot_rows)
    if hot_rows == 12:
        real = records.heavy_hitters
        monkeypatch.setattr(records, "heavy_hitters", lambda rows, key, least: [*real(rows, key, least), 65600, 66500, 7])
    df, truth = postings(spark)
    lengths, docs = defaultdict(int), defaultdict(dict)
    for t, d in truth.items():
        for docno, tf in d.items():
            lengths[docno] += tf
            docs[docno][t] = tf
    n, average = len(docs), sum(lengths.values()) / len(docs)
    scored = relevance.score_terms(df).cache()
    got = {(r.docno, r.term): r for r in scored.collect()}
    assert len(got) == sum(map(len, docs.values()))
    for (docno, term), r in random.Random(2).sample(sorted(got.items()), 500):
        df_, tf = len(truth[term]), docs[docno][term]
        idf = np.log(1 + (n - df_ + 0.5) / (df_ + 0.5))
        assert r.bm25 == pytest.approx(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * lengths[docno] / average)))
        assert (r.tf, r.df, r.doc_length, r.records) == (tf, df_, lengths[docno], n) and r.tf_idf == pytest.approx(tf * np.log10(n / df_))
    leading = []
    for docno, terms in docs.items():
        scores = sorted(((tf * np.log10(n / len(truth[t])), t) for t, tf in terms.items()), reverse=True)
        if len(scores) > 1 and scores[0][0] > 0 and scores[0][0] >= 2.1 * scores[1][0]:
            leading.append((docno, scores[0][1]))
    assert rows(relevance.leading_terms(scored, 2.1)) == sorted(leading)
    plain = relevance.tf_idf(df)
    assert rows(plain) == rows(scored, *plain.columns)
    assert "doc_length" not in plain._jdf.queryExecution().toString()
