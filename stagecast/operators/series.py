"""The series shown for a station: history, forecast, recent records, bands."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stagecast.schemas import RECORD_DAYS

_STATS = ("flow_max", "flow_75", "flow_avg", "flow_25", "flow_min", "high_res")


def historical_series(corrected: DataFrame, observed: DataFrame) -> DataFrame:
    """Corrected and observed points, three decimals: (hydroweb, series, datetime, value)."""
    sim = corrected.select("hydroweb", F.lit("simulation").alias("series"), "datetime", F.col("corrected").alias("value"))
    obs = observed.select("hydroweb", F.lit("observed").alias("series"), "datetime", F.col("level").alias("value"))
    return sim.unionByName(obs).withColumn("value", F.round("value", 3))


def stats_span(stats: DataFrame) -> DataFrame:
    """First and last moment of the statistics of a run: (hydroweb, initialized, start, end)."""
    return stats.groupBy("hydroweb", "initialized").agg(
        F.min("datetime").alias("start"), F.max("datetime").alias("end")
    )


def recent_records(records: DataFrame, span: DataFrame) -> DataFrame:
    """Corrected records of the eight days up to the first statistic of a run.

    A run is listed under each of its nine or ten calendar days and joined on station and day, so
    a station with many runs and records pairs only those that can match.
    """
    earliest = F.col("start") - F.expr(f"INTERVAL {RECORD_DAYS} DAYS")
    days = span.select(
        "hydroweb", "initialized", "start",
        F.explode(F.sequence(F.to_date(earliest), F.to_date("start"))).alias("day"),
    )
    return (
        records.withColumn("day", F.to_date("datetime"))
        .join(days, ["hydroweb", "day"])
        .where(F.col("datetime").between(earliest, F.col("start")))
        .select("hydroweb", "initialized", "datetime", "corrected")
    )


def chart_span(span: DataFrame, recent: DataFrame) -> DataFrame:
    """Extent of the forecast chart: from the first recent record, if any, to the last statistic."""
    first = recent.groupBy("hydroweb", "initialized").agg(F.min("datetime").alias("first_record"))
    return span.join(first, ["hydroweb", "initialized"], "left").select(
        "hydroweb", "initialized", F.coalesce("first_record", "start").alias("start"), "end"
    )


def forecast_series(stats: DataFrame, recent: DataFrame, bands: DataFrame, extent: DataFrame) -> DataFrame:
    """Everything the forecast chart draws: (hydroweb, initialized, series, datetime, value, upper).

    Bands run from ``value`` to ``upper`` over the chart's extent; other series have no ``upper``.
    """
    no_upper = F.lit(None).cast("double").alias("upper")
    lines = stats.select(
        "hydroweb", "initialized", "datetime",
        F.explode(F.array(*[
            F.struct(F.lit(c).alias("series"), F.col(c).alias("value")) for c in _STATS
        ])).alias("p"),
    ).select("hydroweb", "initialized", "p.series", "datetime", "p.value", no_upper).where(F.col("value").isNotNull())
    past = recent.select(
        "hydroweb", "initialized", F.lit("records").alias("series"), "datetime",
        F.col("corrected").alias("value"), no_upper,
    )
    edges = bands.join(extent, ["hydroweb", "initialized"]).select(
        "hydroweb", "initialized", F.concat(F.lit("return_period_"), F.col("rp").cast("string")).alias("series"),
        F.explode(F.array("start", "end")).alias("datetime"), F.col("lower").alias("value"), "upper",
    )
    return lines.unionByName(past).unionByName(edges)
