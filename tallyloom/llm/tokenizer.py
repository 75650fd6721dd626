"""Encoding of texts with a public tokenizer, and decoding to raw bytes.

Method: a byte-pair encoding by tiktoken, read from a local file of ranks. Only the driver reads the file; tasks get its content by broadcast,
so their machines need neither the file nor the module that names it. Long texts are first cut where the tokenizer's own pattern always
begins a new piece, so that no call sees an endless text and the ids stay the same. Ids are decoded to
bytes, not to text, since a token may hold part of a character.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.session import ship

DEFAULT = "byte_bpe_50k.tiktoken"
#: Longest part, in characters, that one call encodes if there is a safe place to cut.
PART = 1 << 16
#: A letter before a blank or a mark: every piece of the public pattern that holds the letter ends there, and a new one begins.
SAFE = regex.compile(r"(?<=\p{L})(?=[ \n.,!?;:()、。，！？।])")


def rank_path(name: str = DEFAULT) -> str:
    """Where a public tokenizer's file lies on the driver's machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def public_pattern() -> str:
    """The pattern that all public rank files share."""
    import public_tokenizers

    return public_tokenizers.PATTERN


@dataclass(frozen=True)
class Vocabulary:
    """A file of ranks, the pattern that cuts texts into pieces, and whether ``SAFE`` places are safe in it."""

    ranks: bytes
    pattern: str
    safe: bool
    digest: str

    @staticmethod
    def read(path: str | None = None, pattern: str | None = None) -> Vocabulary:
        """Of the public tokenizer; or of ``path`` and the ``pattern`` that belongs to it, without which ids would be wrong."""
        if path and not pattern:
            raise ValueError("a file of ranks needs the pattern that belongs to it")
        with open(path or rank_path(), "rb") as file:
            ranks = file.read()
        pattern = pattern or public_pattern()
        safe = not path or pattern == public_pattern()
        return Vocabulary(ranks, pattern, safe, hashlib.sha256(ranks + pattern.encode()).hexdigest())

    def encoding(self) -> tiktoken.Encoding:
        """One for each Python process and vocabulary."""
        if self.digest not in _encodings:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, self.ranks.splitlines())}
            _encodings[self.digest] = tiktoken.Encoding(self.digest, pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
        return _encodings[self.digest]


_encodings: dict[str, tiktoken.Encoding] = {}


@functools.cache
def _shared(spark: SparkSession, vocabulary: Vocabulary) -> Broadcast:
    return spark.sparkContext.broadcast(vocabulary)


def parts(text: str, most: int = PART) -> Iterator[str]:
    """``text`` in parts of about ``most`` characters, cut at safe places only; a run without one stays whole."""
    begin = 0
    while len(text) - begin > most:
        place = SAFE.search(text, begin + most)
        if place is None:
            break
        yield text[begin : place.start()]
        begin = place.start()
    yield text[begin:]


def encode(vocabulary: Vocabulary, text: str | None) -> np.ndarray:
    """Ids of a text as 32-bit integers; none for null and empty texts. Strings of special tokens are ordinary text."""
    if not text:
        return np.zeros(0, dtype=np.int32)
    coder = vocabulary.encoding()
    if len(text) <= PART or not vocabulary.safe:
        return coder.encode_to_numpy(text, disallowed_special=()).view(np.int32)
    return np.concatenate([coder.encode_to_numpy(p, disallowed_special=()) for p in parts(text)]).view(np.int32)


def _encoded(column: pa.Array, vocabulary: Vocabulary) -> list[np.ndarray]:
    return [encode(vocabulary, t) for t in column.to_pylist()]


def _sliced(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def encode_texts(documents: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(key, ids): one row for each row of ``documents``; an empty list for empty and null texts.

    Nothing is shuffled; repeated texts are encoded each. Other columns are ignored and not read. ``path`` and ``pattern``: another file of
    ranks and the pattern that belongs to it.
    """
    ship(documents.sparkSession)
    shared = _shared(documents.sparkSession, Vocabulary.read(path, pattern))
    rows = documents.select(F.col(key).alias("k"), F.col(text).alias("t"))
    kind = dict(rows.dtypes)["k"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches):
            ids = _encoded(batch.column(1), shared.value)
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            values = np.concatenate(ids) if ids else np.zeros(0, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], ["k", "ids"])

    return rows.mapInArrow(run, f"k {kind}, ids array<int>").withColumnRenamed("k", key)


def count_tokens(documents: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(key, n_tokens): the number of ids of each text, 0 for empty and null texts."""
    ship(documents.sparkSession)
    shared = _shared(documents.sparkSession, Vocabulary.read(path, pattern))
    rows = documents.select(F.col(key).alias("k"), F.col(text).alias("t"))
    kind = dict(rows.dtypes)["k"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches):
            sizes = np.array([len(x) for x in _encoded(batch.column(1), shared.value)], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes)], ["k", "n_tokens"])

    return rows.mapInArrow(run, f"k {kind}, n_tokens bigint").withColumnRenamed("k", key)


def decode_ids(encoded: DataFrame, key: str = "doc_id", ids: str = "ids", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(key, data): the bytes of each list of ids; null for a null list. Unknown ids raise KeyError."""
    ship(encoded.sparkSession)
    shared = _shared(encoded.sparkSession, Vocabulary.read(path, pattern))
    rows = encoded.select(F.col(key).alias("k"), F.col(ids).cast("array<int>").alias("i"))
    kind = dict(rows.dtypes)["k"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = shared.value.encoding()
        for batch in _sliced(batches):
            data = [None if x is None else coder.decode_bytes(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], ["k", "data"])

    return rows.mapInArrow(run, f"k {kind}, data binary").withColumnRenamed("k", key)
