"""Filling containers of fixed capacity with items of varying size.

Method: vector best-fit. A container has three residual capacities: tokens, number of items, and attention cost (the sum of the squared sizes). Items
are placed from the largest to the smallest; of the open containers that can take an item under every
constraint the one is chosen whose weighted residual has the smallest norm after it, or the largest weighted dot product with the
item. Only an item beyond the capacity is split: into full pieces and a rest.

Items are spread by a hash over shards of a bounded number of items, packed independently, each shard in a task of its own as long as there are not
very many; what is left in containers that are not well filled is packed once more over many shards together. Where all items are one shard, there
is nothing to put together, and one round does.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.session import cut, parallelism, ship

#: Items of a shard, on average.
SHARD_ITEMS = 8192
#: Shards that a task packs one after another, where there are more shards than tasks are wanted.
SHARDS_OF_A_TASK = 16
#: Containers filled below this share go to the second round.
WELL_FILLED = 0.98


@dataclass(frozen=True)
class Limits:
    """What a container holds at most. ``None`` sets no limit of its own: then tokens alone bind."""

    tokens: int
    items: int | None = None
    attention: int | None = None
    weights: tuple[float, float, float] = (1.0, 0.001, 0.01)
    rule: str = "norm"

    def __post_init__(self) -> None:
        if self.tokens < 1 or self.rule not in ("norm", "dot") or min(x for x in (self.items, self.attention, 1) if x is not None) < 1:
            raise ValueError("limits must be positive and the rule norm or dot")

    @property
    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.items or 1 << 40, self.attention or self.tokens**2], dtype=np.float64)


def best_fit(sizes: np.ndarray, limits: Limits) -> np.ndarray:
    """Container number of each item. ``sizes`` descend and are at most ``limits.tokens``.

    An item whose attention cost alone is beyond the limit gets a container of its own.
    """
    cap = limits.vector
    weight = np.sqrt(np.array(limits.weights)) / cap
    most = len(sizes)
    residual = np.empty((3, most + 1))
    name = np.empty(most + 1, dtype=np.int64)
    out = np.empty(most, dtype=np.int64)
    opened = used = 0
    smallest = sizes[sizes > 0].min() if (sizes > 0).any() else 0
    for k, size in enumerate(sizes):
        need = (float(size), 1.0, float(size) ** 2)
        r = residual[:, :used]
        fits = (r[0] >= need[0]) & (r[1] >= need[1]) & (r[2] >= need[2])
        at = -1
        if fits.any():
            if limits.rule == "norm":
                score = ((r[0] - need[0]) * weight[0]) ** 2 + ((r[1] - need[1]) * weight[1]) ** 2 + ((r[2] - need[2]) * weight[2]) ** 2
            else:
                score = -(r[0] * need[0] * weight[0] ** 2 + r[1] * need[1] * weight[1] ** 2 + r[2] * need[2] * weight[2] ** 2)
            at = int(np.where(fits, score, np.inf).argmin())
        if at < 0:
            at = used
            residual[:, at] = cap
            name[at] = opened
            opened += 1
            used += 1
        residual[0, at] -= need[0]
        residual[1, at] -= need[1]
        residual[2, at] -= need[2]
        out[k] = name[at]
        # a container that can take none of the items to come is closed; the last of its kind takes items without tokens
        if residual[0, at] < smallest and used > 1:
            used -= 1
            residual[:, at] = residual[:, used]
            name[at] = name[used]
    return out


def pieces(items: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """(k, part, n): items as they are, or, beyond the capacity, full pieces and a rest. Null and negative sizes count 0."""
    n = F.greatest(F.coalesce(F.col(size).cast("bigint"), F.lit(0)), F.lit(0))
    rows = items.select(F.col(key).alias("k"), n.alias("all"))
    last = F.greatest(F.ceil(F.col("all") / F.lit(capacity)) - 1, F.lit(0))
    split = rows.select("k", "all", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("part"))
    return split.select("k", F.col("part").cast("int").alias("part"), F.least(F.lit(capacity).cast("bigint"), F.col("all") - F.col("part") * capacity).alias("n"))


def pack(items: DataFrame, limits: Limits, key: str = "doc_id", size: str = "n_tokens", shard_items: int = SHARD_ITEMS) -> DataFrame:
    """(key, part, n_tokens, container): every item, or every piece of an item beyond the capacity, in one container.

    Container names are unique strings. ``part`` is 0 but for split items. Items of size 0 take no tokens, only a place. Equal
    items are packed each; the result depends on the items only, not on how the table is partitioned. An empty table gives no rows.
    """
    ship(items.sparkSession)
    cuts = cut(pieces(items, key, size, limits.tokens))
    count = cuts.count()
    shards = max(1, round(count / shard_items))
    # ties between equal items of one shard are settled by key and part
    sharded = cuts.withColumn("shard", F.pmod(F.xxhash64("k", "part"), F.lit(shards)))
    first = cut(_packed(sharded, shards, limits, "a", dict(cuts.dtypes)["k"]))
    if shards == 1:
        return _named(first, key)
    again = first.where("NOT well")
    groups = max(1, round(again.count() / shard_items))
    regrouped = again.select("k", "part", "n", F.pmod(F.xxhash64("shard"), F.lit(groups)).alias("shard"))
    second = _packed(regrouped, groups, limits, "b", dict(cuts.dtypes)["k"])
    return _named(first.where("well").unionByName(second), key)


def _named(packed: DataFrame, key: str) -> DataFrame:
    return packed.select(F.col("k").alias(key), "part", F.col("n").alias("n_tokens"), "container")


def _packed(sharded: DataFrame, shards: int, limits: Limits, level: str, kind: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wait: list[pa.RecordBatch] = []
        for batch in batches:
            shard = batch.column(3).to_numpy()
            begin = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if len(shard) else []
            for a, b in zip(begin, np.append(begin[1:], len(shard)) if len(shard) else []):
                if wait and wait[-1].column(3)[0].as_py() != shard[a]:
                    yield one(wait)
                    wait = []
                wait.append(batch.slice(a, b - a))
        if wait:
            yield one(wait)

    def one(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows).combine_chunks()
        sizes = table.column("n").to_numpy()
        at = best_fit(sizes, limits)
        fill = np.bincount(at, weights=sizes)
        shard = table.column("shard")[0].as_py()
        names = pa.array([f"{level}{shard}-{k}" for k in range(len(fill))]).take(pa.array(at))
        well = fill[at] >= WELL_FILLED * limits.tokens
        columns = [table.column(c).combine_chunks() for c in ("k", "part", "n", "shard")]
        return pa.RecordBatch.from_arrays([*columns, names, pa.array(well)], ["k", "part", "n", "shard", "container", "well"])

    # a number of partitions of one's own: adaptive execution would put all shards into one task, since their rows are small
    tasks = max(min(shards, 16 * parallelism(sharded.sparkSession)), shards // SHARDS_OF_A_TASK)
    ordered = sharded.select("k", "part", "n", "shard").repartitionById(tasks, F.pmod("shard", F.lit(tasks)).cast("int")).sortWithinPartitions("shard", F.desc("n"), "k", "part")
    return ordered.mapInArrow(run, f"k {kind}, part int, n bigint, shard bigint, container string, well boolean")


def containers(packed: DataFrame) -> DataFrame:
    """(container, items, tokens) of a packing."""
    return packed.groupBy("container").agg(F.count(F.lit(1)).alias("items"), F.sum("n_tokens").alias("tokens"))


def broken_limits(packed: DataFrame, limits: Limits, key: str = "doc_id") -> DataFrame:
    """(limit, broken): for each constraint how many containers or items a packing breaks; a proof that it is one.

    ``attention`` leaves out items alone in their container, ``whole`` counts items in several pieces that are not beyond the capacity, ``items_packed`` is
    the number of items, for comparison with the table.
    """
    n = F.col("n_tokens").cast("bigint")
    filled = packed.groupBy("container").agg(F.sum(n).alias("tokens"), F.count(F.lit(1)).alias("items"), F.sum(n.cast("decimal(38,0)") * n).alias("attention"))
    over = filled.agg(
        F.count(F.when(F.col("tokens") > limits.tokens, 1)).alias("tokens"),
        F.count(F.when(F.col("items") > (limits.items or 1 << 62), 1)).alias("items"),
        F.count(F.when((F.col("attention") > (limits.attention or limits.tokens**2)) & (F.col("items") > 1), 1)).alias("attention"),
    )
    each = packed.groupBy(key).agg(F.sum(n).alias("tokens"), F.count(F.lit(1)).alias("parts"), F.max("part").alias("last"))
    split = F.col("parts") != F.greatest(F.lit(1), F.ceil(F.col("tokens") / F.lit(limits.tokens)))
    items = each.agg(F.count(F.when(split | (F.col("last") != F.col("parts") - 1), 1)).alias("whole"), F.count(F.lit(1)).alias("items_packed"))
    wide = over.select("tokens", "items", "attention", F.lit(None).cast("bigint").alias("whole"), F.lit(None).cast("bigint").alias("items_packed"))
    wide = wide.unionByName(items.select(*[F.lit(None).cast("bigint").alias(c) for c in ("tokens", "items", "attention")], "whole", "items_packed"))
    return wide.unpivot([], ["tokens", "items", "attention", "whole", "items_packed"], "limit", "broken").where("broken IS NOT NULL")


def least_containers(total_tokens: int, capacity: int) -> int:
    """No packing can do with fewer containers."""
    return math.ceil(total_tokens / capacity)
