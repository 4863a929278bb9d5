"""Average-tie ranks within groups of any size."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from stagecast.operators.lookup import row_counts, split_join
from stagecast.workspace import materialise

#: Distinct values of one range, about.
RANGE_VALUES = 500_000


def value_counts(df: DataFrame, key: str, value: str) -> DataFrame:
    """Rows per distinct value, as a stored table: (key, value, n)."""
    return materialise(df.groupBy(key, value).agg(F.count(F.lit(1)).alias("n")), "value-counts")


def rank_counts(counts: DataFrame, key: str, value: str, range_values: int | None = None) -> DataFrame:
    """Exact average-tie rank of every counted value: (key, value, n, rank).

    The counts are range-partitioned by key and value, so a key of any size lies in neighbouring
    ranges. Each range is summed on its own and shifted by what the key has in earlier ranges. Only
    the first key of a range can have begun before it, so there is at most one shift per range.
    """
    ranges = max(1, math.ceil(counts.count() / (RANGE_VALUES if range_values is None else range_values)))
    placed = counts.repartitionByRange(ranges, key, value).withColumn("_range", F.spark_partition_id())
    ranged = materialise(placed, "ranged-values")
    first = ranged.groupBy("_range").agg(F.min(key).alias(key)).select(key).distinct()
    before = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        ranged.join(F.broadcast(first), key, "left_semi")  # at most one key per range
        .groupBy(key, "_range").agg(F.sum("n").alias("_total"))
        .select(key, "_range", F.sum("_total").over(before).alias("_shift"))
    )
    below = Window.partitionBy("_range", key).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0)
    return (
        ranged.withColumn("_below", F.coalesce(F.sum("n").over(below), none))
        .join(F.broadcast(shifts), [key, "_range"], "left")
        .select(key, value, "n", (F.coalesce("_shift", none) + F.col("_below") + (F.col("n") + 1) / F.lit(2.0)).alias("rank"))
    )


def rank_table(df: DataFrame, key: str, value: str, range_values: int | None = None) -> DataFrame:
    """Exact average-tie rank of every distinct value of a group: (key, value, n, rank).

    Equal values are counted before anything is ordered.
    """
    return rank_counts(value_counts(df, key, value), key, value, range_values)


def with_rank(df: DataFrame, key: str, value: str, out: str, range_values: int | None = None) -> DataFrame:
    """Add ``out``, the average-tie rank of ``value`` within ``key``; rows without key or value have none and go.

    Groups of no more rows than a range has values are sorted as they are, and several ranks of the
    same key share one shuffle. In larger groups equal values are counted first, and values that very many rows
    share are joined in pieces.
    """
    rows = df.where(F.col(key).isNotNull() & F.col(value).isNotNull())
    sizes = row_counts(rows, [key]).where(F.col("n") > (RANGE_VALUES if range_values is None else range_values))
    large = materialise(sizes.select(key), "large-groups")
    if large.isEmpty():
        return _sorted_rank(rows, key, value, out)
    counted = rows.join(large, key, "left_semi")
    counts = value_counts(counted, key, value)
    ranks = rank_counts(counts, key, value, range_values).select(key, value, F.col("rank").alias(out))
    ranked = split_join(counted, ranks, [key, value], counts)
    return _sorted_rank(rows.join(large, key, "left_anti"), key, value, out).unionByName(ranked)


def _sorted_rank(rows: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Average-tie ranks of groups that each fit a task."""
    below, ties = Window.partitionBy(key).orderBy(value), Window.partitionBy(key, value)
    return rows.withColumn(out, F.rank().over(below)).withColumn(out, F.col(out) + (F.count(F.lit(1)).over(ties) - 1) / F.lit(2.0))
