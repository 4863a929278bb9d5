"""Day-of-year and month climatologies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def _averages(observed: DataFrame, corrected: DataFrame, key: Column, name: str) -> DataFrame:
    """Averages of both series side by side; a key found in one series only has NULL in the other.

    Both series pass one aggregation, which merges per task before its shuffle, in place of two
    aggregations and an outer join.
    """
    nothing = F.lit(None).cast("double")
    obs = observed.select("hydroweb", key.alias(name), F.col("level").alias("o"), nothing.alias("s"))
    sim = corrected.select("hydroweb", key.alias(name), nothing.alias("o"), F.col("corrected").alias("s"))
    return obs.unionByName(sim).groupBy("hydroweb", name).agg(F.avg("o").alias("obs"), F.avg("s").alias("sim"))


def _day_of_year(moment: str) -> Column:
    """Month and day as one number, which rows are grouped by."""
    return F.month(moment) * 100 + F.day(moment)


def _day_label(number: Column, between: str) -> Column:
    """The number as text, written once per group instead of once per row."""
    part = lambda n: F.lpad(n.cast("string"), 2, "0")
    return F.concat_ws(between, part(F.floor(number / 100)), part(number % 100))


def daily_average(observed: DataFrame, corrected: DataFrame) -> DataFrame:
    """Mean per day of the year: (hydroweb, day 'MM/dd', obs, sim)."""
    return _averages(observed, corrected, _day_of_year("datetime"), "_day").select(
        "hydroweb", F.when(F.col("_day").isNotNull(), _day_label(F.col("_day"), "/")).alias("day"), "obs", "sim"
    )


def monthly_average(observed: DataFrame, corrected: DataFrame) -> DataFrame:
    """Mean per month of the year: (hydroweb, month, obs, sim)."""
    return _averages(observed, corrected, F.month("datetime"), "month")


def day_extremes(observed: DataFrame) -> DataFrame:
    """Lowest and highest observed level per day of the year: (hydroweb, month_day as a number, ..)."""
    return observed.groupBy("hydroweb", _day_of_year("datetime").alias("month_day")).agg(
        F.min("level").alias("level_min"), F.max("level").alias("level_max")
    )


def calendar_values(spans: DataFrame, climatology: DataFrame) -> DataFrame:
    """Every day of each span with its climatology.

    ``spans``: (hydroweb, initialized, start, end). Days are a day apart from the moment of
    ``start``; the climatology is found by month and day and is NULL where there is none.
    """
    days = spans.select(
        "hydroweb", "initialized",
        F.explode(F.sequence("start", "end", F.expr("INTERVAL 1 DAY"))).alias("datetime"),
    ).withColumn("month_day", _day_of_year("datetime"))
    return days.join(climatology, ["hydroweb", "month_day"], "left").drop("month_day")
