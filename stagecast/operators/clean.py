"""Series preparation: one row per (key, datetime), no NaN, no level below the floor."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stagecast.functions.scalar import clamp, present
from stagecast.operators.lookup import lookup_join
from stagecast.workspace import materialise



def series(df: DataFrame, key: str, value: str) -> DataFrame:
    """Rows of a stored series that have a value: (key, datetime, value)."""
    return df.select(key, "datetime", present(F.col(value)).alias(value)).where(F.col(value).isNotNull())


def simulated(simulation: DataFrame) -> DataFrame:
    """Simulation with the floor applied: (reachid, datetime, value)."""
    return series(simulation, "reachid", "value").withColumn("value", clamp(F.col("value")))


def station_minimum(observed: DataFrame) -> DataFrame:
    """Lowest observation and number of observations per station: (hydroweb, base, n)."""
    return (
        series(observed, "hydroweb", "waterlevel")
        .groupBy("hydroweb")
        .agg(F.min("waterlevel").alias("base"), F.count("waterlevel").alias("n"))
    )


def observed_levels(observed: DataFrame, shift_min: bool = True) -> DataFrame:
    """Observations above the station's own minimum, with the floor: (hydroweb, datetime, level).

    ``shift_min=False`` keeps the original datum and only applies the floor.
    """
    rows = series(observed, "hydroweb", "waterlevel")
    if not shift_min:
        return rows.select("hydroweb", "datetime", clamp(F.col("waterlevel")).alias("level"))
    bases = materialise(station_minimum(observed), "station-minimum")
    return lookup_join(rows, bases.drop("n"), ["hydroweb"], bases).select(
        "hydroweb", "datetime", clamp(F.col("waterlevel") - F.col("base")).alias("level")
    )
