"""Frequency of every term from compressed bitmaps of record identifiers.

Method: a vertical layout. Records are numbered densely in blocks of up to 65,536; for each term and block there is a container of the
numbers of its records: a sorted array of two bytes each up to 4,096 of them, else a bitmap of 8,192 bytes. Beside
it runs a counter of occurrences. The bitmap of a term is the union of its containers, whose blocks share no record; the document
frequency is the sum of their cardinalities.

One shuffle brings the postings of a record together. There a task finds the rows in force, numbers its records in the order of their docnos and builds all
containers of a block at once, so containers are as full as the terms allow, and none has to be shuffled to be united: only one
count for each term and task is. A term in very many records has many blocks, which lie in different tasks; none of its lists is ever whole
in one place. Records with very many rows are found first and spread by term.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.records import postings_by_record
from tallyloom.session import cut, ship

#: Records of a block.
BLOCK_RECORDS = 1 << 16
#: Postings of a block, beyond which it ends with its record: so many a task holds at once.
BLOCK_POSTINGS = 1 << 22
#: The same in bytes of terms.
BLOCK_BYTES = 1 << 28
#: Records of a container up to which it is an array.
ARRAY_MOST = 4096
SCHEMA = "term string, block bigint, docs int, tf bigint, container binary"
NAMES = ["term", "block", "docs", "tf", "container"]


def to_container(low: np.ndarray) -> bytes:
    """Container of sorted, different 16-bit numbers."""
    if len(low) <= ARRAY_MOST:
        return low.astype("<u2").tobytes()
    bits = np.zeros(1 << 16, dtype=np.uint8)
    bits[low] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def from_container(data: bytes, docs: int) -> np.ndarray:
    """The numbers of a container that holds ``docs`` of them."""
    if docs <= ARRAY_MOST:
        return np.frombuffer(data, dtype="<u2")
    return np.flatnonzero(np.unpackbits(np.frombuffer(data, dtype=np.uint8), bitorder="little")).astype("<u2")


def block_containers(term: pa.Array, low: np.ndarray, tf: np.ndarray, block: int) -> pa.RecordBatch:
    """Containers of all terms of a block; rows come by record, each term once in it. Without a loop over the short ones."""
    coded = term.dictionary_encode()
    code = coded.indices.to_numpy()
    order = np.argsort(code, kind="stable")
    code, short = code[order], low[order].astype("<u2")
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    bounds = np.append(first, len(code))
    docs = np.diff(bounds).astype(np.int32)
    if (docs > ARRAY_MOST).any():
        made = pa.array([to_container(short[a:b]) for a, b in zip(bounds, bounds[1:])], pa.binary())
    else:
        offsets = bounds.astype(np.int32) * 2
        made = pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(short.tobytes())])
    columns = [coded.dictionary.take(pa.array(code[first])).cast(pa.string()), pa.array(np.full(len(first), block)), pa.array(docs), pa.array(np.add.reduceat(tf[order], first)), made]
    return pa.RecordBatch.from_arrays(columns, NAMES)


def block_records(docnos: np.ndarray) -> pa.RecordBatch:
    """The row of a block that says which records it numbers: their docnos as 64-bit integers, without a term."""
    data = docnos.astype("<i8").tobytes()
    columns = [pa.array([None], pa.string()), pa.array(docnos[:1]), pa.array([len(docnos)], pa.int32()), pa.array([0], pa.int64()), pa.array([data], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, NAMES)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Containers and records of postings (term, docno, tf) sorted by docno."""
    held: list[pa.RecordBatch] = []
    rows = records = size = 0
    last: int | None = None

    def built() -> Iterator[pa.RecordBatch]:
        docno = np.concatenate([b.column(1).to_numpy() for b in held])
        starts = np.concatenate([[True], docno[1:] != docno[:-1]])
        low, docnos = np.cumsum(starts) - 1, docno[starts]
        tf = np.concatenate([b.column(2).to_numpy() for b in held])
        yield block_records(docnos)
        terms = pa.concat_arrays([b.column(0).cast(pa.large_string()) for b in held])
        whole = block_containers(terms, low, tf, int(docnos[0]))
        for k in range(0, whole.num_rows, 1 << 14):
            yield whole.slice(k, 1 << 14)

    for batch in batches:
        begin = 0
        docno = batch.column(1).to_numpy()
        changes = np.flatnonzero(docno[1:] != docno[:-1]) + 1 if len(docno) else np.zeros(0, dtype=np.int64)
        starts = np.concatenate([[0], changes]) if len(docno) and docno[0] != last else changes
        while begin < len(docno):
            # the records that begin from here on, and how many of them the block still takes
            ahead = starts[np.searchsorted(starts, begin) :]
            room = 0 if size > BLOCK_BYTES else min(BLOCK_RECORDS - records, int(np.searchsorted(ahead, begin + BLOCK_POSTINGS - rows)))
            end = len(docno) if room >= len(ahead) else int(ahead[room])
            if end > begin:
                held.append(batch.slice(begin, end - begin))
                size += held[-1].get_total_buffer_size() * (end - begin) // len(docno)
                rows, records, begin = rows + end - begin, records + min(room, len(ahead)), end
            if begin < len(docno):
                yield from built()
                held, rows, records, size = [], 0, 0, 0
        last = docno[-1] if len(docno) else last
    if held:
        yield from built()


def vertical_index(postings: DataFrame) -> DataFrame:
    """(term, block, docs, tf, container) of postings (term, docno, tf, written_at) in force.

    A row with a term is its container in the block, whose name is the block's first docno; each block has one row without a term, which holds
    the docnos of its records in the order of their numbers. Records of very many rows have blocks of their own. Rows that are no posting are left out (see ``postings_by_record``); docnos may be negative. An empty table gives no rows.
    """
    ship(postings.sparkSession)
    rows, spread = postings_by_record(postings)
    index = rows.sortWithinPartitions("docno").select("term", "docno", "tf").mapInArrow(_blocks, SCHEMA)
    if spread is None:
        return index
    spread = cut(spread.select("term", "docno", "tf"))
    names = spread.select("docno").distinct().mapInArrow(_hot_records, SCHEMA)
    return index.unionByName(spread.mapInArrow(_hot_containers, SCHEMA)).unionByName(names)


def _hot_containers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each posting is a container of the one record of its block."""
    for batch in batches:
        n = batch.num_rows
        zero, offsets = np.zeros(n, dtype="<u2").tobytes(), np.arange(n + 1, dtype=np.int32) * 2
        made = pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(zero)])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.ones(n, dtype=np.int32)), batch.column(2), made], NAMES)


def _hot_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for docno in batch.column(0).to_numpy():
            yield block_records(np.array([docno]))


def term_bitmaps(postings: DataFrame) -> DataFrame:
    """The containers of ``vertical_index``, without the rows that name the records."""
    return vertical_index(postings).where("term IS NOT NULL")


def frequencies(postings: DataFrame) -> DataFrame:
    """(term, df, tf): records that hold the term, from the cardinalities of its containers, and its occurrences; written.

    The row without a term has the number of all records in df; an empty table has no rows.
    """
    index = vertical_index(postings).select("term", "docs", "tf")
    return cut(index.groupBy("term").agg(F.sum(F.col("docs").cast("bigint")).alias("df"), F.sum("tf").alias("tf")))


def term_frequencies(postings: DataFrame) -> DataFrame:
    """(term, df, tf): records that hold the term and its occurrences, from the cardinalities of its bitmaps."""
    return frequencies(postings).where("term IS NOT NULL")


def record_count(postings: DataFrame) -> DataFrame:
    """One row (records): different docnos of postings in force."""
    return frequencies(postings).where("term IS NULL").agg(F.coalesce(F.sum("df"), F.lit(0)).alias("records"))


def marked_terms(postings: DataFrame, rare_below: int = 3, common_above: float = 0.1) -> DataFrame:
    """(term, df, tf, mark): ``rare`` below ``rare_below`` records, ``common`` above the share ``common_above`` of all records, else null.

    A term that is both is rare.
    """
    found = frequencies(postings)
    records = found.where("term IS NULL").agg(F.sum("df")).scalar()
    mark = F.when(F.col("df") < rare_below, "rare").when(F.col("df") / records > common_above, "common")
    return found.where("term IS NOT NULL").withColumn("mark", mark)
