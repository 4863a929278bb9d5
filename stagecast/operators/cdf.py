"""Monthly empirical distributions and the two interpolations between them.

A distribution is one row per (key, month):

* ``base``   datum taken off every value before the floor is applied,
* ``low``, ``high``, ``n``  extremes and number of the prepared values,
* ``step``   bin width; bin i covers [-step + i*step, -step + (i+1)*step),
* ``last``   right edge of the last bin of the histogram,
* ``first``  number of the first bin of ``cdf``,
* ``cdf``    cumulative share at the right edge of bins first, first+1, ..

``cdf`` covers only the bins between the extremes. These are at most two more than there are
classes, whatever the datum, so a row is small and its size does not depend on the rows of
its group beyond their logarithm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from stagecast.functions.scalar import clamp, class_count
from stagecast.functions.search import count_below
from stagecast.operators.clean import series
from stagecast.operators.lookup import lookup_join
from stagecast.workspace import materialise



def edge(step: Column, number: Column) -> Column:
    """Left edge of a bin."""
    return -step + number.cast("double") * step


def bin_number(value: Column, step: Column) -> Column:
    """Bin with left edge <= value < right edge, compared on the edges themselves."""
    guess = F.floor(value / step) + 1
    return (
        guess
        - F.when(value < edge(step, guess), 1).otherwise(0)
        + F.when(value >= edge(step, guess + 1), 1).otherwise(0)
    ).cast("int")


def bin_number_right(value: Column, step: Column) -> Column:
    """Bin with left edge < value <= right edge, compared on the edges themselves."""
    guess = F.ceil(value / step)
    return (
        guess
        - F.when(value <= edge(step, guess), 1).otherwise(0)
        + F.when(value > edge(step, guess + 1), 1).otherwise(0)
    ).cast("int")


def month_extremes(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Extremes and row count per (key, month) of a formatted series."""
    return rows.groupBy(key, F.month("datetime").alias("month")).agg(
        F.min(value).alias("min_value"), F.max(value).alias("max_value"), F.count(value).alias("n")
    )


def histogram_layout(extremes: DataFrame, key: str, shift_min: bool) -> DataFrame:
    """Bin layout per (key, month), from extremes alone.

    Shift and floor never swap two values, so the extremes of the prepared series are the
    prepared extremes of the stored one, and no second pass over the rows is needed.
    """
    if shift_min:
        lowest = F.min("min_value").over(Window.partitionBy(key))  # at most 12 rows per key
    else:
        lowest = F.lit(0.0)
    top, bottom = F.ceil("high").cast("double"), F.floor("low").cast("double")
    return (
        extremes.withColumn("base", lowest)
        .withColumn("low", clamp(F.col("min_value") - F.col("base")))
        .withColumn("high", clamp(F.col("max_value") - F.col("base")))
        .withColumn("top", F.when(top == bottom, top + F.lit(0.1)).otherwise(top))
        .withColumn("step", (F.col("top") - bottom) / class_count(F.col("n")))
        .withColumn(
            "last",
            edge(
                F.col("step"),
                F.ceil((F.col("top") + F.lit(2.0) * F.col("step") + F.col("step")) / F.col("step")) - 1,
            ),
        )
        .select(key, "month", "n", "base", "low", "high", "step", "last")
    )


_LAYOUT = ("n", "base", "low", "high", "step", "last")


def month_histogram(df: DataFrame, key: str, value: str, shift_min: bool = False) -> DataFrame:
    """Non-empty bins: layout columns plus ``bin`` and its ``rows``.

    Counting carries the layout along, as it is the same for all rows of a group: the counts do
    not have to meet the layout a second time.
    """
    rows = series(df, key, value).withColumn("month", F.month("datetime"))
    layout = materialise(histogram_layout(month_extremes(rows, key, value), key, shift_min), "histogram-layout")
    binned = lookup_join(rows.select(key, "month", value), layout, [key, "month"], layout)
    number = bin_number(clamp(F.col(value) - F.col("base")), F.col("step"))
    return binned.groupBy(key, "month", number.alias("bin")).agg(
        F.count(F.lit(1)).alias("rows"), *[F.first(c).alias(c) for c in _LAYOUT]
    )


def month_cdf(df: DataFrame, key: str, value: str, shift_min: bool = False) -> DataFrame:
    """Running share over the non-empty bins: layout columns plus ``bin``, ``rows``, ``cdf``."""
    upto = Window.partitionBy(key, "month").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    return month_histogram(df, key, value, shift_min).withColumn(
        "cdf", F.sum("rows").over(upto).cast("double") / F.col("n").cast("double")
    )


def packed_cdf(df: DataFrame, key: str, value: str, shift_min: bool = False) -> DataFrame:
    """One row per (key, month) in the form described above.

    A group has at most 66 bins here, so they are collected and summed within their row; a bin
    without rows repeats the share before it.
    """
    def share(number):
        upto = F.filter("bins", lambda b: b["bin"] <= number)
        total = F.aggregate(upto, F.lit(0).cast("long"), lambda acc, b: acc + b["rows"])
        return total.cast("double") / F.col("n").cast("double")

    return (
        month_histogram(df, key, value, shift_min)
        .groupBy(key, "month")
        .agg(
            *[F.first(c).alias(c) for c in _LAYOUT],
            F.min("bin").alias("first"), F.max("bin").alias("final"),
            F.collect_list(F.struct("bin", "rows")).alias("bins"),
        )
        .withColumn("cdf", F.transform(F.sequence("first", "final"), share))
        .drop("bins", "final")
    )


def _share(array: str, index: Column) -> Column:
    return F.coalesce(F.get(F.col(array), index.cast("int")), F.lit(0.0))


def to_probability(df: DataFrame, value: str, out: str, dist: str, right_closed: bool) -> DataFrame:
    """Add ``out``, the probability of ``value`` in its own distribution (columns ``<dist>_*``).

    ``right_closed`` assigns a value on an edge to the bin that ends there, as the forecast
    interpolation does; the historical one assigns it to the bin that starts there.
    """
    step, value_col = F.col(f"{dist}_step"), F.col(value)
    number = bin_number_right(value_col, step) if right_closed else bin_number(value_col, step)
    low_edge = edge(step, F.col("_bin"))
    slope = (F.col("_hi") - F.col("_lo")) / (edge(step, F.col("_bin") + 1) - low_edge)
    index = F.col("_bin") - F.col(f"{dist}_first")
    size = F.size(f"{dist}_cdf")
    return (
        df.withColumn("_bin", number)
        .withColumn("_lo", F.when(index > size, F.lit(1.0)).otherwise(_share(f"{dist}_cdf", index - 1)))
        .withColumn("_hi", F.when(index >= size, F.lit(1.0)).otherwise(_share(f"{dist}_cdf", index)))
        .withColumn("_p_raw", slope * (value_col - low_edge) + F.col("_lo"))
        # Rounding may put the product one unit above a share of 1 (``least`` would fill NULL).
        .withColumn(out, F.when(F.col("_p_raw") > 1, F.lit(1.0)).otherwise(F.col("_p_raw")))
        .drop("_bin", "_lo", "_hi", "_p_raw")
    )


def from_probability(df: DataFrame, prob: str, out: str, dist: str, first_edge: bool) -> DataFrame:
    """Add ``out``, the value with probability ``prob`` in another distribution.

    On a flat stretch of the distribution the historical interpolation takes its last edge and
    the forecast interpolation (``first_edge``) its first. Where the forecast interpolation has
    two equal shares at its lower end (probability 0 and an empty lowest bin) it is undefined,
    and ``out`` is NULL.
    """
    step, p = F.col(f"{dist}_step"), F.col(prob)
    number = F.col("_at") + F.col(f"{dist}_first")
    low_edge = edge(step, number)
    level = (edge(step, number + 1) - low_edge) / (F.col("_hi") - F.col("_lo")) * (p - F.col("_lo")) + low_edge
    if first_edge:
        undefined = (p <= 0) & (F.col(f"{dist}_first") > 1)
        level = F.when(p.isNotNull() & ~undefined, level)
    else:
        level = F.when(F.col("_hi").isNotNull(), level).when(p.isNotNull(), F.col(f"{dist}_last"))
    return (
        count_below(df, f"{dist}_cdf", prob, "_at", inclusive=not first_edge)
        .withColumn("_lo", _share(f"{dist}_cdf", F.col("_at") - 1))
        .withColumn("_hi", F.get(F.col(f"{dist}_cdf"), F.col("_at")))
        .withColumn(out, level)
        .drop("_at", "_lo", "_hi")
    )
