"""Joins of many rows to a small-rowed table, by measured size and by skew.

The lookup is a stored table, so it can be measured in one pass. If it is small enough it is
broadcast and the rows are not shuffled at all. Beyond that both sides are shuffled, and keys with
very many rows are cut into pieces.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType, StructType

from stagecast.workspace import materialise

BROADCAST_BYTES = 64 * 1024 * 1024
# Groups of fewer rows than this fit one task comfortably and are left alone.
HOT_ROWS = 2_000_000
_ROW_BYTES = 32  # header and NULL flags of a row, at most


def _width(column: Column, kind: DataType) -> Column:
    """Bytes of a value in memory."""
    if isinstance(kind, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(column), F.lit(0)).cast("long") + 16
    if isinstance(kind, ArrayType):
        if isinstance(kind.elementType, (StringType, BinaryType, ArrayType, StructType)):
            inner = F.aggregate(column, F.lit(0).cast("long"), lambda total, x: total + _width(x, kind.elementType))
        else:
            inner = F.size(column).cast("long") * 8
        return F.coalesce(inner, F.lit(0)) + 24
    if isinstance(kind, StructType):
        total = F.lit(16).cast("long")
        for field in kind.fields:
            total = total + _width(column.getField(field.name), field.dataType)
        return total
    return F.lit(16).cast("long")


def measured_bytes(table: DataFrame) -> int:
    """Bytes that all rows of a table take in memory, summed over the rows themselves."""
    row = F.lit(_ROW_BYTES).cast("long")
    for field in table.schema.fields:
        row = row + _width(F.col(f"`{field.name}`"), field.dataType)
    return table.agg(F.sum(row)).first()[0] or 0


def fits_broadcast(lookup: DataFrame, limit: int | None = None) -> bool:
    """Whether the rows of a stored table stay within the broadcast limit."""
    return measured_bytes(lookup) <= (BROADCAST_BYTES if limit is None else limit)


def row_counts(rows: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows per group, for the ``sizes`` of a join. Only evaluated if the join has to shuffle."""
    return rows.groupBy(*on).agg(F.count(F.lit(1)).alias("n"))


def lookup_join(
    rows: DataFrame, lookup: DataFrame, on: Sequence[str], sizes: DataFrame | None = None, how: str = "inner"
) -> DataFrame:
    """Join ``rows`` to a stored ``lookup``.

    ``sizes`` has one row per group: the ``on`` columns and ``n``, its number of rows. It is
    needed where a group of ``rows`` can grow without bound.
    """
    if how not in ("inner", "left", "left_semi"):
        raise ValueError(f"unsupported join type: {how}")
    if fits_broadcast(lookup):
        return rows.join(F.broadcast(lookup), list(on), how)
    if sizes is None:
        return rows.join(lookup.hint("merge"), list(on), how)
    return split_join(rows, lookup, on, sizes, how)


def hot_groups(sizes: DataFrame, on: Sequence[str], hot_rows: int) -> DataFrame:
    """Every group of ``hot_rows`` rows or more, and how many pieces it is cut into.

    There are at most rows / hot_rows of them. They are a stored table without a hint, so Spark
    knows its size: short lists are broadcast, long ones are shuffled.
    """
    pieces = F.ceil(F.col("n") / F.lit(hot_rows)).cast("int")
    return materialise(sizes.where(F.col("n") >= hot_rows).select(*on, pieces.alias("_pieces")), "hot-groups")


def split_join(
    rows: DataFrame, lookup: DataFrame, on: Sequence[str], sizes: DataFrame, how: str = "inner",
    hot_rows: int | None = None,
) -> DataFrame:
    """Shuffled join in which hot groups are cut into pieces of about ``hot_rows`` rows.

    The lookup rows of a hot group are repeated once per piece. All rows take part; only their
    distribution changes.
    """
    on = list(on)
    hot = hot_groups(sizes, on, HOT_ROWS if hot_rows is None else hot_rows)
    if hot.isEmpty():  # nothing to cut: every row would get piece 0
        return rows.join(lookup.hint("merge"), on, how)
    # Content hash plus input partition: stable when a lost task runs again, and identical
    # copies that sit in different input partitions still spread.
    spread = F.xxhash64(*rows.columns) + F.spark_partition_id()
    left = (
        rows.withColumn("_spread", spread)
        .join(hot, on, "left")
        .withColumn("_piece", F.coalesce(F.pmod("_spread", "_pieces"), F.lit(0)).cast("int"))
        .drop("_spread", "_pieces")
    )
    right = (
        lookup.join(hot, on, "left")
        .withColumn("_piece", F.explode(F.sequence(F.lit(0), F.coalesce("_pieces", F.lit(1)) - 1)))
        .drop("_pieces")
    )
    return left.join(right.hint("merge"), on + ["_piece"], how).drop("_piece")
