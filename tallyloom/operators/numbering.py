"""Dense numbers for the rows of a table in the order of a key, without gathering the table anywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.session import cut

#: Largest table that a join may broadcast: rows, and bytes of its values.
BROADCAST_ROWS = 400_000
BROADCAST_BYTES = 64 << 20


def numbered(df: DataFrame, key: str, name: str = "code") -> DataFrame:
    """``df`` with ``name``: 0, 1, 2 ... in the order of ``key``, which must be different in each row.

    A range shuffle puts the rows in order; each partition's first number is the sum of the sizes before it, one number for each partition
    on the driver. The numbered table is written, since a range shuffle may cut differently when it is repeated.
    """
    place = F.monotonically_increasing_id()
    ordered = df.repartitionByRange(key).sortWithinPartitions(key)
    placed = cut(ordered.withColumns({"_part": F.shiftright(place, 33), "_row": place.bitwiseAND(F.lit((1 << 33) - 1))}))
    sizes = {r["_part"]: r["n"] for r in placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}
    begin, offsets = 0, []
    for part in sorted(sizes):
        offsets.append((part, begin))
        begin += sizes[part]
    first = F.broadcast(df.sparkSession.createDataFrame(offsets, "_part bigint, _first bigint"))
    return placed.join(first, "_part").withColumn(name, F.col("_row") + F.col("_first")).drop("_part", "_row", "_first")


def value_bytes(df: DataFrame) -> Column:
    """About the bytes of a row's values: lengths of texts, 8 for a number, and of nested values their text."""
    total = F.lit(0).cast("bigint")
    for field in df.schema:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            total = total + F.coalesce(F.octet_length(column), F.lit(0)) + 16
        elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            total = total + F.coalesce(F.octet_length(F.to_json(F.struct(column))), F.lit(0)) + 16
        else:
            total = total + 8
    return total


def is_small(df: DataFrame, rows: int | None = None, size: int | None = None) -> bool:
    """Whether a count shows that ``df`` has at most ``rows`` rows and ``size`` bytes of values. It stops soon after the bound."""
    rows, size = BROADCAST_ROWS if rows is None else rows, BROADCAST_BYTES if size is None else size
    found = df.limit(rows + 1).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(value_bytes(df)), F.lit(0)).alias("b")).first()
    return found.n <= rows and found.b <= size


def sized(df: DataFrame, rows: int | None = None, size: int | None = None) -> DataFrame:
    """``df`` marked for broadcast if ``is_small`` says so, else as it is."""
    return F.broadcast(df) if is_small(df, rows, size) else df
