"""Alert classes, the warning table, and the map layers read from it."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from stagecast.functions.scalar import point_geometry
from stagecast.operators.bias import Model, forecast_runs, forecast_rows
from stagecast.operators.ensemble import exceedance_daily
from stagecast.operators.extremes import annual_maxima, return_periods
from stagecast.schemas import (
    ACTIVE_CLASSES, ALERT_PERCENT, FORECAST_DAYS, RETURN_PERIODS, STORED_DAYS, day_columns,
)
from stagecast.tables import Tables

_STATION_FIELDS = ("hydroweb", "reachid", "basin", "river", "name", "latitude", "longitude", "state", "country")


def alert_class(prefix: str = "pct_") -> Column:
    """Highest return period that at least 40 % of the members exceed, else R0."""
    chain: Column | None = None
    for rp in reversed(RETURN_PERIODS):
        raised = F.col(f"{prefix}{rp}") >= F.lit(ALERT_PERCENT)
        chain = F.when(raised, f"R{rp}") if chain is None else chain.when(raised, f"R{rp}")
    return chain.otherwise("R0")


def alerts_long(exceedance: DataFrame) -> DataFrame:
    """Alert per station and forecast day 1..14: (hydroweb, initialized, day_no, day, alert)."""
    return exceedance.where(F.col("day_no") <= FORECAST_DAYS).select(
        "hydroweb", "initialized", "day_no", "day", alert_class().alias("alert")
    )


def station_alerts(tables: Tables, model: Model, thresholds: DataFrame) -> DataFrame:
    """Alerts of every station whose history and forecast could be corrected."""
    return alerts_long(exceedance_daily(tables, model, thresholds, FORECAST_DAYS))


def _days_to_columns(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("hydroweb", "initialized").agg(*[
        F.max(F.when(F.col("day_no") == i + 1, F.col("alert"))).alias(name)
        for i, name in enumerate(day_columns())
    ])


def warnings_wide(
    tables: Tables, model: Model, date: dt.datetime | str, thresholds: DataFrame | None = None,
) -> DataFrame:
    """The warning rows of one forecast date: (hydroweb, datetime, wd01 .. wd15), all stations.

    A station that fails anywhere gets R0 on all 14 days; one with a shorter forecast has NULL
    on the missing days. wd15 is stored but never computed.
    """
    moment = F.lit(str(date)).cast("timestamp_ntz")
    todays = Tables(
        tables.station, tables.observed, tables.simulation,
        tables.ensemble.where(F.col("initialized") == moment), tables.records,
    )
    if thresholds is None:
        thresholds = return_periods(annual_maxima(tables, model))
    wide = _days_to_columns(station_alerts(todays, model, thresholds))
    failed = F.col("initialized").isNull()
    return (
        tables.station.select("hydroweb")
        .join(wide, "hydroweb", "left")
        .select(
            "hydroweb", moment.alias("datetime"),
            *[F.when(failed, "R0").otherwise(F.col(c)).alias(c) for c in day_columns()],
            *[F.lit(None).cast("string").alias(c) for c in day_columns(STORED_DAYS)[FORECAST_DAYS:]],
        )
    )


def warning_status(tables: Tables, model: Model, thresholds: DataFrame, date: dt.datetime | str) -> DataFrame:
    """Why a station has the warning it has: (hydroweb, datetime, status)."""
    moment = F.lit(str(date)).cast("timestamp_ntz")
    rows = forecast_rows(tables.ensemble.where(F.col("initialized") == moment))
    runs = forecast_runs(rows).select("reachid", F.month("first_time").alias("forecast_month"))
    months = model.mapping.groupBy("hydroweb").agg(
        F.first("complete").alias("complete"), F.collect_set("month").alias("months")
    )
    return (
        tables.station.select("hydroweb", "reachid")
        .join(months, "hydroweb", "left")
        .join(runs, "reachid", "left")
        .join(thresholds.select("hydroweb", "degenerate"), "hydroweb", "left")
        .select(
            "hydroweb", moment.alias("datetime"),
            F.when(F.col("complete").isNull(), "no simulation")
            .when(~F.col("complete"), "month without observation")
            .when(F.col("forecast_month").isNull(), "no forecast")
            .when(~F.array_contains("months", F.col("forecast_month")), "forecast month not simulated")
            .when(F.col("degenerate"), "degenerate")
            .otherwise("ok").alias("status"),
        )
    )


def water_level_alerts(station: DataFrame, warning: DataFrame, date: dt.datetime | str) -> DataFrame:
    """Stations joined to their warnings at one moment (a bare date means midnight)."""
    moment = F.lit(str(date)).cast("timestamp_ntz")
    return (
        station.join(warning.where(F.col("datetime") == moment), "hydroweb")
        .select(*_STATION_FIELDS, "datetime", *day_columns())
    )


def alerts_by_day(alerts: DataFrame, days: int = STORED_DAYS) -> DataFrame:
    """One row per station and day: the station fields, ``day_no`` and ``alert``."""
    stored = [F.col(c) if c in alerts.columns else F.lit(None).cast("string") for c in day_columns(days)]
    return alerts.select(
        *_STATION_FIELDS, "datetime", F.posexplode(F.array(*stored)).alias("day_no", "alert")
    ).withColumn("day_no", F.col("day_no") + 1)


def alerts_for_day(alerts: DataFrame, day: int) -> DataFrame:
    """Map layer of one forecast day: the day's column as ``alert``."""
    if not 1 <= day <= STORED_DAYS:
        raise ValueError(f"day must be 1..{STORED_DAYS}")
    name = f"wd{day:02d}"
    value = F.col(name) if name in alerts.columns else F.lit(None).cast("string")
    return alerts.select(*_STATION_FIELDS, "datetime", value.alias("alert"))


def alerts_by_class(layer: DataFrame, alert: str) -> DataFrame:
    """Only the stations with one alert class."""
    return layer.where(F.col("alert") == alert)


def alerts_active(layer: DataFrame, active: Sequence[str] = ACTIVE_CLASSES) -> DataFrame:
    """Only the stations whose class is switched on (R0 is off by default)."""
    return layer.where(F.col("alert").isin(*active))


def features(alerts: DataFrame) -> DataFrame:
    """One GeoJSON feature per row: (hydroweb, feature)."""
    properties = [
        F.date_format("datetime", "yyyy-MM-dd'T'HH:mm:ss").alias("datetime") if c == "datetime" else F.col(c)
        for c in alerts.columns
    ]
    lon, lat = F.col("longitude"), F.col("latitude")
    feature = F.struct(
        F.col("hydroweb").alias("id"),
        F.lit("Feature").alias("type"),
        F.struct(*properties).alias("properties"),
        point_geometry(lon, lat).alias("geometry"),
        F.array(lon, lat, lon, lat).alias("bbox"),
    )
    return alerts.select("hydroweb", F.to_json(feature, {"ignoreNullFields": "false"}).alias("feature"))


def collection_lines(feature_rows: DataFrame) -> DataFrame:
    """One FeatureCollection as lines: (place, hydroweb, feature, copy, line), to be written in that order.

    ``place`` is 0 for the opening line, 1 for features, 2 for the closing line. Every feature but
    the first has its comma in front, so a line needs to know nothing of its neighbours and no row
    holds more than one feature. Repeated features are numbered as copies.
    """
    spark = feature_rows.sparkSession
    rows = feature_rows.groupBy("hydroweb", "feature").agg(F.count(F.lit(1)).alias("n")).select(
        "hydroweb", "feature", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy")
    )
    first = rows.agg(F.min(F.struct("hydroweb", "feature", "copy")).alias("f")).select("f.*").first()
    leads = F.col("hydroweb").eqNullSafe(F.lit(first[0])) & F.col("feature").eqNullSafe(F.lit(first[1])) & (F.col("copy") == F.lit(first[2]))
    lines = rows.select(
        F.lit(1).alias("place"), "hydroweb", "feature", "copy", F.concat(F.when(leads, "").otherwise(","), F.col("feature")).alias("line")
    )
    ends = spark.createDataFrame([(0, '{"type":"FeatureCollection","features":['), (2, "]}")], "place int, line string")
    none = F.lit(None).cast("string")
    return lines.unionByName(ends.select("place", none.alias("hydroweb"), none.alias("feature"), F.lit(0).cast("long").alias("copy"), "line"))
