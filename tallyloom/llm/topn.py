"""The N highest-scoring items of every group by simultaneous bisection.

Method: score and identifier make one order-preserving code (a higher score first, then the smaller identifier). For all groups at once,
the cutoff of each is bisected by counting the rows at or above its midpoint, until exactly N rows of the group lie above it. Rows
outside the interval that is left need no further look, so a round costs less than the one before.

The bisection runs twice: on each task over the rows it happens to hold, which leaves at most N rows a group and buffer, and, after a shuffle of
these few, over whole groups. A group with a third of all rows therefore reaches its last task as N rows from each buffer. Nothing is sorted to be ranked but the rows
that stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.session import ship

#: Rows that a task holds before it reduces them.
BUFFER = 1 << 18
SIGN = np.uint64(1 << 63)


def score_code(score: np.ndarray) -> np.ndarray:
    """Unsigned integers in the order of the doubles; minus zero as zero, no NaN."""
    bits = (score + 0.0).view(np.uint64)
    return np.where(bits & SIGN, ~bits, bits | SIGN)


def identifier_code(identifier: np.ndarray) -> np.ndarray:
    """Unsigned integers in the reverse order of the signed integers."""
    return ~(identifier.astype(np.int64).view(np.uint64) ^ SIGN)


def _bisect(group: np.ndarray, code: np.ndarray, want: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each group: rows above the cutoff, rows that tie at it, and how many of the ties are still wanted.

    ``group`` numbers the groups 0.. in ascending order of rows; ``want`` is below each group's number of rows.
    Returns two row masks and a number for each group.
    """
    groups = len(want)
    start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    low, high = np.minimum.reduceat(code, start), np.maximum.reduceat(code, start)
    sure, tied = np.zeros(len(code), dtype=bool), np.zeros(len(code), dtype=bool)
    left = want.copy()  # wanted among the rows inside the interval [low, high]
    live, at = np.arange(len(code)), group
    open_ = np.ones(groups, dtype=bool)
    while len(live):
        # groups whose interval is one value end with ties
        single = open_ & (low == high)
        if single.any():
            ends = single[at]
            tied[live[ends]] = True
            open_ &= ~single
            live, at = live[~ends], at[~ends]
            continue
        middle = low + (high - low) // np.uint64(2) + np.uint64(1)
        values = code[live]
        above = values >= middle[at]
        count = np.bincount(at[above], minlength=groups)
        exact, more, less = open_ & (count == left), open_ & (count > left), open_ & (count < left)
        # exactly enough: these rows and no others
        sure[live[above & exact[at]]] = True
        left[exact] = 0
        open_ &= ~exact
        # too many: the cutoff is at or above the middle
        low[more] = middle[more]
        # too few: these rows are in, the rest is wanted from below
        sure[live[above & less[at]]] = True
        left[less] -= count[less]
        high[less] = middle[less] - np.uint64(1)
        keep = (above & more[at]) | (~above & less[at])
        live, at = live[keep], at[keep]
    return sure, tied, left


def select_top(group: np.ndarray, score: np.ndarray, identifier: np.ndarray, n: int) -> np.ndarray:
    """Mask of the ``n`` first rows of each group by score, descending, then identifier, ascending.

    Of rows equal in all three any may stay; ``n`` of them do.
    """
    mask = np.ones(len(group), dtype=bool)
    order = np.argsort(group, kind="stable")
    _, number, size = np.unique(group, return_inverse=True, return_counts=True)
    large = size > n
    if not large.any():
        return mask
    rows = order[large[number[order]]]
    mask[rows] = False
    compact = np.cumsum(large) - 1
    at = compact[number[rows]]
    want = np.full(int(large.sum()), n)
    sure, tied, left = _bisect(at, score_code(score[rows]), want)
    mask[rows[sure]] = True
    rows, at = rows[tied], at[tied]
    if len(rows):
        held, at, count = np.unique(at, return_inverse=True, return_counts=True)
        left = left[held]
        whole = left >= count
        mask[rows[whole[at]]] = True
        part = (~whole & (left > 0))[at]
        rows, at = rows[part], at[part]
        if len(rows):
            held, at = np.unique(at, return_inverse=True)
            left = left[held]
            sure, tied, left = _bisect(at, identifier_code(identifier[rows]), left)
            mask[rows[sure]] = True
            rows, at = rows[tied], at[tied]
            if len(rows):  # equal in score and identifier
                begin = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
                nth = np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at))))
                mask[rows[nth < left[at]]] = True
    return mask


def _columns(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)]


def _emit(columns: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["g", "i", "s"])


def top_n(rows: DataFrame, group: str, identifier: str, score: str, n: int) -> DataFrame:
    """(group, rank, identifier, score): the first ``n`` rows of each group by score, descending, then identifier.

    Groups and identifiers are integers. Rows with a null group, identifier or score, or a NaN score, are left out; minus zero equals zero. Groups with fewer rows give all of them, an empty table none. Repeated rows are rows
    of their own. Other columns are ignored.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    ship(rows.sparkSession)
    clean = rows.select(F.col(group).cast("bigint").alias("g"), F.col(identifier).cast("bigint").alias("i"), (F.col(score).cast("double") + F.lit(0.0)).alias("s"))
    clean = clean.dropna().where(~F.isnan("s"))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        count = 0
        for batch in batches:
            held.append(_columns(batch))
            count += batch.num_rows
            if count >= BUFFER:
                columns = [np.concatenate(c) for c in zip(*held)]
                mask = select_top(columns[0], columns[2], columns[1], n)
                columns = [c[mask] for c in columns]
                held, count = [columns], len(columns[0])
                if count > BUFFER // 2:  # mostly small groups: keeping them would not reduce anything
                    yield _emit(columns)
                    held, count = [], 0
        if count:
            columns = [np.concatenate(c) for c in zip(*held)]
            mask = select_top(columns[0], columns[2], columns[1], n)
            yield _emit([c[mask] for c in columns])

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wait: list[np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = _columns(batch)
            if wait is not None:
                columns = [np.concatenate(c) for c in zip(wait, columns)]
            last = np.searchsorted(columns[0], columns[0][-1])
            if last:
                yield ranked([c[:last] for c in columns])
            wait = [c[last:] for c in columns]
            if len(wait[0]) > BUFFER:
                mask = select_top(wait[0], wait[2], wait[1], n)
                wait = [c[mask] for c in wait]
        if wait is not None:
            yield ranked(wait)

    def ranked(columns: list[np.ndarray]) -> pa.RecordBatch:
        mask = select_top(columns[0], columns[2], columns[1], n)
        g, i, s = (c[mask] for c in columns)
        order = np.lexsort((i, -s, g))
        g, i, s = g[order], i[order], s[order]
        begin = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        rank = np.arange(len(g)) - np.repeat(begin, np.diff(np.append(begin, len(g)))) + 1
        return pa.RecordBatch.from_arrays([pa.array(g), pa.array(rank.astype(np.int32)), pa.array(i), pa.array(s)], ["g", "r", "i", "s"])

    few = clean.mapInArrow(local, "g bigint, i bigint, s double")
    whole = few.repartition("g").sortWithinPartitions("g").mapInArrow(final, "g bigint, r int, i bigint, s double")
    return whole.select(F.col("g").alias(group), F.col("r").alias("rank"), F.col("i").alias(identifier), F.col("s").alias(score))
