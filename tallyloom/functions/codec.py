"""Variable-length integers for gap-encoded postings, vectorised over whole batches.

Seven bits to a byte, the low group first; the high bit marks that another byte follows. A list of
postings is its number of documents, then gap and count of each posting in turn.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

LISTS = T.StructType([T.StructField(n, T.ArrayType(T.LongType())) for n in ("docno", "tf")])


def varint_lengths(values: np.ndarray) -> np.ndarray:
    """How many bytes each number takes."""
    limits = np.uint64(1) << (np.arange(1, 10, dtype=np.uint64) * np.uint64(7))
    return np.searchsorted(limits, values.astype(np.uint64), side="right") + 1


def encode_varints(values: np.ndarray) -> bytes:
    """Bytes of non-negative integers, one after another."""
    values = np.asarray(values, dtype=np.uint64)
    lengths = varint_lengths(values)
    owner = np.repeat(np.arange(len(values)), lengths)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    groups = ((values[owner] >> (place * 7).astype(np.uint64)) & np.uint64(0x7F)).astype(np.uint8)
    groups[place < lengths[owner] - 1] |= 0x80
    return groups.tobytes()


def decode_varints(data: bytes) -> np.ndarray:
    """The integers of ``encode_varints``."""
    raw = np.frombuffer(data, dtype=np.uint8)
    if not len(raw):
        return np.zeros(0, dtype=np.uint64)
    ends = np.flatnonzero(raw < 0x80)
    starts = np.concatenate([[0], ends[:-1] + 1])
    places = np.arange(len(raw)) - np.repeat(starts, ends - starts + 1)
    parts = (raw & 0x7F).astype(np.uint64) << (places * 7).astype(np.uint64)
    return np.add.reduceat(parts, starts)


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


@F.arrow_udf(T.BinaryType())
def encode_postings(begin: pa.Array, docnos: pa.Array, tfs: pa.Array) -> pa.Array:
    """Bytes of lists of ascending docnos and their counts; the first gap is counted from ``begin``. Null for a null list.

    All lists of a batch are encoded at once, without a loop over them.
    """
    null = pc.is_null(docnos).to_numpy(zero_copy_only=False)
    sizes = pc.fill_null(pc.list_value_length(docnos), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values, counts = docnos.flatten().to_numpy(), tfs.flatten().to_numpy()
    heads = _starts(sizes)
    gaps = np.diff(values, prepend=0)
    filled = sizes > 0
    gaps[heads[filled]] = values[heads[filled]] - begin.to_numpy(zero_copy_only=False)[filled]
    width = np.where(null, 0, 1 + 2 * sizes)
    first = _starts(width)
    flat = np.empty(int(width.sum()), dtype=np.int64)
    flat[first[~null]] = sizes[~null]
    at = np.repeat(first, sizes) + 1 + 2 * (np.arange(len(values)) - np.repeat(heads, sizes))
    flat[at], flat[at + 1] = gaps, counts
    lengths = np.concatenate([[0], np.cumsum(varint_lengths(flat))])
    offsets = lengths[np.append(first, len(flat))].astype(np.int32)
    valid = pa.py_buffer(np.packbits(~null, bitorder="little").tobytes())
    return pa.BinaryArray.from_buffers(pa.binary(), len(null), [valid, pa.py_buffer(offsets.tobytes()), pa.py_buffer(encode_varints(flat))])


@F.arrow_udf(LISTS)
def decode_postings(begin: pa.Array, data: pa.Array) -> pa.Array:
    """Arrays of docnos and of counts from the bytes of ``encode_postings``; null arrays for null."""
    null = pc.is_null(data).to_numpy(zero_copy_only=False)
    joined = b"".join(x for x in data.to_pylist() if x is not None)
    bytes_ = pc.fill_null(pc.binary_length(data), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = decode_varints(joined).astype(np.int64)
    ends = np.flatnonzero(np.frombuffer(joined, dtype=np.uint8) < 0x80)
    first = np.searchsorted(ends, _starts(bytes_))
    sizes = np.zeros(len(null), dtype=np.int64)
    sizes[~null] = flat[first[~null]]
    heads = _starts(sizes)
    at = np.repeat(first, sizes) + 1 + 2 * (np.arange(int(sizes.sum())) - np.repeat(heads, sizes))
    running = np.concatenate([[0], np.cumsum(flat[at])])
    docnos = running[1:] - np.repeat(running[heads], sizes) + np.repeat(begin.to_numpy(zero_copy_only=False), sizes)
    offsets = pa.array(np.append(heads, sizes.sum()).astype(np.int32), mask=np.append(null, False))
    return pa.StructArray.from_arrays([pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (docnos, flat[at + 1])], ["docno", "tf"])
