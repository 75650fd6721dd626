"""Where nodes of a graph go: by hash or by range of the id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def range_partition(node_id: Column, node_count: int, n: int) -> Column:
    """Partition 0..n-1 of an id by its share of ``node_count``; ids beyond it wrap around."""
    return F.pmod(F.floor(node_id.cast("double") / F.lit(float(node_count)) * F.lit(n)).cast("bigint"), F.lit(n)).cast("int")


def hash_partition(node_id: Column, n: int) -> Column:
    """Partition 0..n-1 by the id modulo ``n``."""
    return F.pmod(node_id, F.lit(n)).cast("int")


def partition_sizes(nodes: DataFrame, node_count: int, n: int) -> DataFrame:
    """(scheme, part, nodes): how many nodes each partition of either scheme gets."""
    part = F.explode(
        F.array(
            F.struct(F.lit("hash").alias("scheme"), hash_partition(F.col("node_id"), n).alias("part")),
            F.struct(F.lit("range").alias("scheme"), range_partition(F.col("node_id"), node_count, n).alias("part")),
        )
    )
    return nodes.where("node_id IS NOT NULL").select(part.alias("p")).groupBy("p.scheme", "p.part").agg(F.count(F.lit(1)).alias("nodes"))


def place_by_range(nodes: DataFrame, node_count: int, n: int) -> DataFrame:
    """The same rows, physically placed by ``range_partition``."""
    return nodes.repartitionById(n, range_partition(F.col("node_id"), node_count, n))


def place_by_hash(nodes: DataFrame, n: int) -> DataFrame:
    """The same rows, physically placed by ``hash_partition``. Rows without an id go to partition 0."""
    return nodes.repartitionById(n, F.coalesce(hash_partition(F.col("node_id"), n), F.lit(0)))


def placed_sizes(placed: DataFrame, scheme: str) -> DataFrame:
    """(scheme, part, nodes): how many nodes lie in each partition of a placed table that has any."""
    return placed.select(F.lit(scheme).alias("scheme"), F.spark_partition_id().alias("part")).groupBy("scheme", "part").agg(F.count(F.lit(1)).alias("nodes"))
