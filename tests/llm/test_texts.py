import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from rows import rows
from tokenizers import Tokenizer

from tallyloom.llm import packing as K
from tallyloom.llm import tokenizer as Z

DOCS = "doc_id bigint, text string, lang string, k string, ids int"
TEXTS = ["", None, " ", "Hello world", "<|endoftext|> is text", "a\r\n\r\nb  \t c", "don't we'll I'VE", "naïve ﬁx ２０１４ 中𠮷🇺🇳", "👩‍🌾👩‍🌾", "ราชา ดร. 12", "x" * 5000, "\x00\x01\x07", "Hello world", "é" * 50, "﻿q"]


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_ids_equal_the_other_library(spark, reference):
    df = spark.createDataFrame([(i, t, "l", "clash", 1) for i, t in enumerate(TEXTS)], DOCS)
    got = dict(rows(Z.encode_texts(df)))
    assert got == {i: reference(t) if t else [] for i, t in enumerate(TEXTS)}
    assert dict(rows(Z.count_tokens(df))) == {i: len(v) for i, v in got.items()}
    back = {r.doc_id: bytes(r.data) for r in Z.decode_ids(Z.encode_texts(df)).collect()}
    assert back == {i: (t or "").encode() for i, t in enumerate(TEXTS)}
    assert rows(Z.encode_texts(df.limit(0))) == []


def test_all_documents_equal_the_other_library(spark, reference):
    import os

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test data")
    df = spark.read.parquet(f"{folder}/documents.parquet")
    texts = {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}
    assert dict(rows(Z.encode_texts(df))) == {i: reference(t) if t else [] for i, t in texts.items()}


def test_cut_texts_have_the_same_ids(monkeypatch):
    vocabulary = Z.Vocabulary.read()
    coder = vocabulary.encoding()
    draw = random.Random(3)
    bits = ["word", " ", "  ", "\n", "don't", "'s", "…", "12.5", "中文。", "ไทย", "!?", " ", "\x1c", "é", "x,y", "I'll"]
    for _ in range(200):
        text = "".join(draw.choices(bits, k=400))
        whole = coder.encode_ordinary(text)
        cut = [list(coder.encode_ordinary(p)) for p in Z.parts(text, 17)]
        assert sum(cut, []) == whole and len(cut) > 5
    assert list(Z.parts("x" * 100, 10)) == ["x" * 100]
    monkeypatch.setattr(Z, "PART", 50)
    text = "a word, and another one. " * 100
    assert list(Z.encode(vocabulary, text)) == coder.encode_ordinary(text)


def test_workers_need_no_file(spark, tmp_path):
    """Tasks get the ranks from the driver; another file needs its own pattern."""
    import shutil

    own = shutil.copy(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), tmp_path / "ranks")
    df = spark.createDataFrame([(i, t, "l", "clash", 1) for i, t in enumerate(TEXTS)], DOCS)
    expected = {i: Z.Vocabulary.read(own, public_tokenizers.PATTERN).encoding().encode_ordinary(t or "") for i, t in enumerate(TEXTS)}
    by_words = Z.Vocabulary.read(own, r"\S+|\s+")
    assert not by_words.safe
    encoded, words = Z.encode_texts(df, path=own, pattern=public_tokenizers.PATTERN), Z.encode_texts(df, path=own, pattern=by_words.pattern)
    (tmp_path / "ranks").unlink()
    assert dict(rows(encoded)) == expected
    assert dict(rows(words)) == {i: by_words.encoding().encode_ordinary(t or "") for i, t in enumerate(TEXTS)}
    with pytest.raises(ValueError):
        Z.encode_texts(df, path=str(tmp_path / "ranks"))


def check_packing(sizes, packed, limits):
    """Every item whole but for those beyond the capacity; no container beyond any limit."""
    bins, parts = {}, {}
    for key, part, n, name in packed:
        bins.setdefault(name, []).append(n)
        parts.setdefault(key, []).append((part, n))
    for key, n in sizes.items():
        n = max(n or 0, 0)
        assert sorted(parts[key]) == [(k, min(limits.tokens, n - k * limits.tokens)) for k in range(max(1, -(-n // limits.tokens)))]
    for held in bins.values():
        assert sum(held) <= limits.tokens
        assert len(held) <= (limits.items or len(held))
        assert len(held) == 1 or sum(n * n for n in held) <= (limits.attention or limits.tokens**2)
    return len(bins)


@pytest.mark.parametrize("limits", [K.Limits(100), K.Limits(100, rule="dot"), K.Limits(100, items=3), K.Limits(100, attention=3000), K.Limits(100, 4, 5000, rule="dot")])
@pytest.mark.parametrize("shard", [10**6, 150])
def test_packing(spark, limits, shard):
    draw = random.Random(9)
    sizes = {i: draw.choice([None, 0, -3, 1, 5, 40, 60, 99, 100, 101, 250]) if i % 3 else draw.randrange(1, 120) for i in range(900)}
    df = spark.createDataFrame([(i, n, 0, "x") for i, n in sizes.items()], "doc_id bigint, n_tokens bigint, part int, container string")
    packed = [tuple(r) for r in K.pack(df, limits, shard_items=shard).collect()]
    used = check_packing(sizes, packed, limits)
    broken = dict(rows(K.broken_limits(K.pack(df, limits, shard_items=shard), limits)))
    assert broken == {"tokens": 0, "items": 0, "attention": 0, "whole": 0, "items_packed": len(sizes)}
    if limits == K.Limits(100):
        assert used <= 1.02 * K.least_containers(sum(max(n or 0, 0) for n in sizes.values()), 100) + 2
    if shard == 150:
        again = [tuple(r) for r in K.pack(df.repartition(7), limits, shard_items=shard).collect()]
        assert sorted(again) == sorted(packed)


def test_packing_of_little(spark):
    schema = "doc_id bigint, n_tokens bigint"
    assert rows(K.pack(spark.createDataFrame([], schema), K.Limits(10))) == []
    assert {r[3] for r in rows(K.pack(spark.createDataFrame([(1, 0), (2, None)], schema), K.Limits(10)))} == {"a0-0"}
    with pytest.raises(ValueError):
        K.Limits(0)


def test_broken_limits_are_found(spark):
    packed = spark.createDataFrame([(1, 0, 60, "a"), (2, 0, 50, "a"), (3, 0, 1, "b"), (4, 0, 1, "b"), (5, 0, 1, "b"), (6, 0, 5, "c"), (6, 1, 5, "d"), (7, 0, 95, "e")], "doc_id int, part int, n_tokens bigint, container string")
    assert dict(rows(K.broken_limits(packed, K.Limits(100, 2, 6000)))) == {"tokens": 1, "items": 1, "attention": 1, "whole": 1, "items_packed": 7}
    assert dict(rows(K.broken_limits(packed.limit(0), K.Limits(100)))) == {"tokens": 0, "items": 0, "attention": 0, "whole": 0, "items_packed": 0}


def test_each_shard_has_a_task(spark):
    """Small rows do not make adaptive execution pack all shards in one task."""
    df = spark.range(4000).select(F.col("id").alias("doc_id"), (F.col("id") % 50 + 1).alias("n_tokens"))
    packed = K.pack(df, K.Limits(100), shard_items=500)
    first = packed.where("container LIKE 'a%'").select(F.regexp_extract("container", "a([0-9]+)-", 1).alias("shard")).distinct().count()
    assert first == 8
    shards = df.select(F.col("doc_id").alias("k"), F.lit(0).alias("part"), F.col("n_tokens").alias("n"), F.pmod("doc_id", F.lit(8)).alias("shard"))
    assert K._packed(shards, 8, K.Limits(100), "a", "bigint").select(F.spark_partition_id().alias("p"), "shard").distinct().groupBy("p").count().count() == 8


def test_best_fit_prefers_the_tightest():
    assert list(K.best_fit(np.array([70, 60, 30, 30, 10]), K.Limits(100))) == [0, 1, 0, 1, 1]
