"""The base tables every operator starts from, and where they are stored."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql.types import DateType, DoubleType, StringType, StructField, StructType

from stagecast.schemas import ENSEMBLE, OBSERVED, RECORDS, SIMULATION
from stagecast.sinks.loads import LoadedTable

# Names of partitions. Decades and years are derived, so no range of time is left out.
_DECADE = (("decade", "year(datetime) - pmod(year(datetime), 10)"),)
_RUN = "date_format({0}, 'yyyyMMddHHmmss')"
_OF_RUN = (("init_month", "date_format(initialized, 'yyyy-MM')"), ("run", _RUN.format("initialized")))
_OF_RECORD = (("year", "year(datetime)"), ("run", _RUN.format("datetime")))
_MONTH = (("month", "date_format(datetime, 'yyyy-MM')"),)
_DAY = (("on_day", "day"),)

DAILY_LEVEL = StructType([
    StructField("hydroweb", StringType()), StructField("day", DateType()), StructField("max_level", DoubleType()),
])


@dataclass(frozen=True)
class Tables:
    """DataFrames in the schemas of :mod:`stagecast.schemas`.

    Moments are whole seconds: the load steps cut fractions off.
    """

    station: DataFrame
    observed: DataFrame
    simulation: DataFrame
    ensemble: DataFrame
    records: DataFrame


def observed_table(root: str) -> LoadedTable:
    """Observations by decade."""
    return LoadedTable(f"{root}/waterlevel_data", OBSERVED, _DECADE, ("hydroweb", "datetime"))


def simulation_table(root: str) -> LoadedTable:
    """Retrospective simulation by decade."""
    return LoadedTable(f"{root}/historical_simulation", SIMULATION, _DECADE, ("reachid", "datetime"))


def ensemble_table(root: str) -> LoadedTable:
    """Forecast runs, by month and moment of their start."""
    return LoadedTable(f"{root}/ensemble_forecast", ENSEMBLE, _OF_RUN, ("reachid", "datetime"))


def records_table(root: str) -> LoadedTable:
    """First values of past runs, by year and moment."""
    return LoadedTable(f"{root}/forecast_records", RECORDS, _OF_RECORD, ("reachid",))


def readings_table(path: str) -> LoadedTable:
    """Observations that arrive as a stream, by month."""
    return LoadedTable(path, OBSERVED, _MONTH, ("hydroweb", "datetime"))


def daily_table(path: str) -> LoadedTable:
    """Daily maxima kept up to date by a stream, by day."""
    return LoadedTable(path, DAILY_LEVEL, _DAY, ("hydroweb",))
