"""Pairs of items that share a record, counted as packed 64-bit codes.

Items are numbered in the order of their bytes; a pair is the smaller number and the larger one in one 64-bit code. Tasks fill a
buffer of codes, sort it, count its runs and hand the sorted run on; Spark's external sort spills and merges the runs
of a range of codes; one pass over the merged codes counts equal neighbours.

A pair of very frequent items leaves a task as one code and a count for each run, whatever its number of records, so no task
gets more than its share. A record's pairs come from its own list: no record is joined with another. A very long record is cut into blocks, and
each two of its blocks may go to another task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.operators.numbering import is_small, numbered
from tallyloom.operators.skew import lookup
from tallyloom.session import cut, parallelism, ship

#: Codes in one sorted run: 16 MB.
RUN = 1 << 21
#: Longest record, in items, whose pairs one task makes alone: some two million pairs.
BLOCK_ITEMS = 2048
#: Numbers below it fit into half a code.
HALF_CODE = 1 << 31

COUNTS = "code bigint, pairs bigint"
NAMED = "x string, y string, pairs bigint, x_n bigint, y_n bigint"


def pair_codes(values: np.ndarray, lengths: np.ndarray, most: int = RUN) -> Iterator[np.ndarray]:
    """Codes of all pairs of each record, in pieces of about ``most``.

    ``values``: the records' item numbers one after another, ascending and different within a record.
    """
    starts = np.cumsum(lengths) - lengths
    for n in np.unique(lengths):
        if n < 2:
            continue
        begin, each = starts[lengths == n], int(n) * (int(n) - 1) // 2
        if each > most:
            for s in begin:
                line = values[s : s + n]
                for i in range(n - 1):
                    yield (line[i] << 32) | line[i + 1 :]
            continue
        i, j = np.triu_indices(n, 1)
        step = max(1, most // each)
        for k in range(0, len(begin), step):
            block = values[begin[k : k + step, None] + np.arange(n)]
            yield ((block[:, i] << 32) | block[:, j]).ravel()


def count_runs(codes: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Different codes of a sorted array and how often each occurs (or the sum of its counts)."""
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    if counts is None:
        return codes[first], np.diff(np.append(first, len(codes)))
    return codes[first], np.add.reduceat(counts, first)


def _batches(codes: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    table = pa.RecordBatch.from_arrays([pa.array(codes, pa.int64()), pa.array(counts, pa.int64())], ["code", "pairs"])
    for k in range(0, len(codes), 1 << 16):
        yield table.slice(k, 1 << 16)


def sorted_runs(pieces: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Sorted runs of about ``RUN`` codes with their counts."""
    held: list[np.ndarray] = []
    size = 0
    for codes in pieces:
        held.append(codes)
        size += len(codes)
        if size >= RUN:
            merged = np.concatenate(held)
            merged.sort()
            yield from _batches(*count_runs(merged))
            held, size = [], 0
        elif len(held) >= 4096:
            held = [np.concatenate(held)]
    if size:
        merged = np.concatenate(held)
        merged.sort()
        yield from _batches(*count_runs(merged))


def merged_runs(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sums of the runs of equal codes in sorted batches, if at least ``least``; a run may span batches."""
    code, count = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        codes, counts = count_runs(batch.column(0).to_numpy(), batch.column(1).to_numpy())
        if code is not None:
            if codes[0] == code:
                counts = np.concatenate([[counts[0] + count], counts[1:]])
            elif count >= least:
                yield np.array([code]), np.array([count])
        code, count = codes[-1], int(counts[-1])
        keep = counts[:-1] >= least
        if keep.any():
            yield codes[:-1][keep], counts[:-1][keep]
    if code is not None and count >= least:
        yield np.array([code]), np.array([count])


def ascending_numbers(dictionary: pa.Array, lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ascending, different numbers of the items of each list, one list after another, and how many each has; unknown items are dropped."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    number = pc.index_in(lists.flatten(), value_set=dictionary, skip_nulls=True)
    known = number.is_valid().to_numpy(zero_copy_only=False)
    record = np.repeat(np.arange(len(sizes), dtype=np.int64), sizes)[known]
    keys = np.unique((record << 32) | pc.drop_null(number).to_numpy().astype(np.int64))
    return keys & 0xFFFFFFFF, np.bincount(keys >> 32, minlength=len(sizes))


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return column.flatten().to_numpy(), pc.list_value_length(column).to_numpy()


def _block_codes(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """Codes of each two blocks (a, b, same) of a list: all numbers of an earlier block are below those of a later one."""
    for a, b, same in zip(batch.column(0), batch.column(1), batch.column(2).to_pylist()):
        a = a.values.to_numpy()
        if same:
            yield from pair_codes(a, np.array([len(a)]))
        else:
            yield ((a[:, None] << 32) | b.values.to_numpy()).ravel()


def written_records(records: DataFrame, key: str = "docno", items: str = "items") -> DataFrame:
    """(docno, items, k): different items of each record without nulls, and how many; a written table. Rows without a key are left out."""
    held = records.where(F.col(key).isNotNull()).select(F.col(key).alias("docno"), F.array_distinct(F.filter(items, lambda x: x.isNotNull())).alias("items"))
    none = F.expr("array()").cast("array<string>")
    return cut(held.select("docno", F.coalesce("items", none).alias("items"), F.greatest(F.size("items"), F.lit(0)).alias("k")))


def item_counts(held: DataFrame) -> DataFrame:
    """(item, n): in how many of the ``written_records`` each item is."""
    return held.select(F.explode("items").alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("n"))


def count_pairs(held: DataFrame, frequent: DataFrame, min_count: int, dictionary_items: int | None = None) -> DataFrame:
    """(x, y, pairs, x_n, y_n) of the pairs of ``frequent`` items, x < y by code points, in at least ``min_count`` of the ``written_records``.

    ``frequent`` (item, n) is a written table with one row for each item; n is handed through. A dictionary that a count shows to be small goes to every
    task; another one stays a table (``dictionary_items``: its largest number of items). Of 2**31 items or more, pairs are counted as
    two numbers instead of one code.
    """
    ship(held.sparkSession)
    if is_small(frequent, dictionary_items):
        return _by_dictionary(held, frequent, min_count)
    return _by_joins(held, frequent, min_count)


def _brought_together(runs: DataFrame) -> DataFrame:
    """Sorted runs: equal codes lie side by side in one partition."""
    return runs.repartition("code").sortWithinPartitions("code")


def _by_dictionary(held: DataFrame, frequent: DataFrame, min_count: int) -> DataFrame:
    """Neither numbering nor naming shuffles."""
    terms = sorted(((r.item, r.n) for r in frequent.collect()), key=lambda x: x[0].encode())
    shared = held.sparkSession.sparkContext.broadcast((pa.array([t for t, _ in terms], pa.string()), np.array([n for _, n in terms], dtype=np.int64)))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from sorted_runs(c for b in batches for c in pair_codes(*ascending_numbers(shared.value[0], b.column(0))))

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def numbers(lists: pa.Array) -> pa.Array:
        values, counts = ascending_numbers(shared.value[0], lists)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values, pa.int64()))

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, counts = shared.value
        for codes, pairs in merged_runs(batches, min_count):
            x, y = codes >> 32, codes & 0xFFFFFFFF
            columns = [items.take(pa.array(x)), items.take(pa.array(y)), pa.array(pairs, pa.int64()), pa.array(counts[x]), pa.array(counts[y])]
            yield pa.RecordBatch.from_arrays(columns, ["x", "y", "pairs", "x_n", "y_n"])

    short = held.where(F.col("k").between(2, BLOCK_ITEMS)).select("items").mapInArrow(make, COUNTS)
    long = _block_runs(held.where(F.col("k") > BLOCK_ITEMS).select(numbers("items").alias("t")))
    return _brought_together(short.union(long)).mapInArrow(name, NAMED)


def blocks(lists: DataFrame, most: int | None = None) -> DataFrame:
    """(a, b, same) of ascending lists t: each two blocks of a list, ``same`` for a block with itself; spread over all tasks."""
    most = most or BLOCK_ITEMS
    last = F.ceil(F.size("t") / F.lit(most)).cast("int") - 1
    first = lists.where(F.size("t") > 1).select("t", last.alias("last"), F.explode(F.sequence(F.lit(0), last)).alias("i"))
    both = first.select("t", "i", F.explode(F.sequence(F.col("i"), F.col("last"))).alias("j"))
    at = lambda k: F.slice("t", F.col(k) * most + 1, F.lit(most))
    cuts = both.select(at("i").alias("a"), at("j").alias("b"), (F.col("i") == F.col("j")).alias("same"))
    return cuts.repartition(parallelism(lists.sparkSession), F.xxhash64("a", "b"))


def _block_runs(lists: DataFrame) -> DataFrame:
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from sorted_runs(c for b in batches for c in _block_codes(b))

    return blocks(lists).mapInArrow(make, COUNTS)


def _by_joins(held: DataFrame, frequent: DataFrame, min_count: int) -> DataFrame:
    """The dictionary stays a table; the few items that hold much of all occurrences are joined apart."""
    coded = numbered(frequent, "item")
    each = held.where("k > 1").select("docno", F.explode("items").alias("item"))
    lists = cut(lookup(each, coded, "item", "n").groupBy("docno").agg(F.sort_array(F.collect_list("code")).alias("t")).select("t", F.size("t").alias("k")))
    short, long = lists.where(F.col("k").between(2, BLOCK_ITEMS)).select("t"), lists.where(F.col("k") > BLOCK_ITEMS).select("t")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from sorted_runs(c for b in batches for c in pair_codes(*_lists(b.column(0))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for codes, pairs in merged_runs(batches, min_count):
            yield from _batches(codes, pairs)

    if coded.count() < HALF_CODE:
        counted = _brought_together(short.mapInArrow(make, COUNTS).union(_block_runs(long))).mapInArrow(count, COUNTS)
        sides = counted.select(F.shiftright("code", 32).alias("xc"), F.col("code").bitwiseAND(F.lit(0xFFFFFFFF)).alias("yc"), "pairs")
    else:
        sides = _two_numbers(short, long).groupBy("xc", "yc").agg(F.count(F.lit(1)).alias("pairs")).where(F.col("pairs") >= min_count)
    left = coded.select(F.col("code").alias("xc"), F.col("item").alias("x"), F.col("n").alias("x_n"))
    right = coded.select(F.col("code").alias("yc"), F.col("item").alias("y"), F.col("n").alias("y_n"))
    return sides.join(left, "xc").join(right, "yc").select("x", "y", "pairs", "x_n", "y_n")


def _two_numbers(short: DataFrame, long: DataFrame) -> DataFrame:
    """(xc, yc): the pairs of lists whose numbers do not fit into half a code."""

    def within(lists: DataFrame, t: str) -> DataFrame:
        left = lists.select(t, F.posexplode(t).alias("i", "xc")).select("xc", F.slice(t, F.col("i") + 2, F.size(t)).alias("rest"))
        return left.select("xc", F.explode("rest").alias("yc"))

    parts = blocks(long)
    across = parts.where("NOT same").select("b", F.explode("a").alias("xc")).select("xc", F.explode("b").alias("yc"))
    return within(short, "t").unionByName(within(parts.where("same"), "a")).unionByName(across)
