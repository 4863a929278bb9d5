"""The jobs a platform runs: initial load, observation refresh, daily warnings, exports."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from stagecast.operators import alerts, bias, climatology, clean, ensemble, extremes, metrics, series
from stagecast.schemas import RECORD_DAYS, STATION
from stagecast.sinks import writers
from stagecast.sources import readers
from stagecast.tables import Tables, ensemble_table, observed_table, records_table, simulation_table
from stagecast.workspace import DENSE, mark, materialise, release


@dataclass(frozen=True)
class Refresh:
    """What changes only with new observations or simulation: distributions and thresholds."""

    model: bias.Model
    thresholds: DataFrame


def refresh(tables: Tables) -> Refresh:
    """Fit all stations once; daily jobs and exports reuse the result."""
    model = bias.fit(tables)
    thresholds = extremes.return_periods(extremes.annual_maxima(tables, model))
    return Refresh(model, materialise(thresholds, "thresholds"))


def save_refresh(state: Refresh, path: str) -> None:
    """Keep a refresh for later sessions."""
    state.model.mapping.write.mode("overwrite").parquet(f"{path}/mapping")
    state.thresholds.write.mode("overwrite").parquet(f"{path}/thresholds")


def open_refresh(spark: SparkSession, path: str) -> Refresh:
    return Refresh(
        bias.Model(spark.read.parquet(f"{path}/mapping")), spark.read.parquet(f"{path}/thresholds")
    )


def initial_load(
    spark: SparkSession, stations: str, observations: str, qout: DataFrame, root: str,
    forecasts: Mapping[str, DataFrame] | None = None,
) -> None:
    """Station list, compiled observations, retrospective simulation and past runs into stored tables.

    ``forecasts`` maps the moment of a run to its model output. Running the load again replaces what
    it loaded before.
    """
    station = readers.read_stations(spark, stations)
    station.write.mode("overwrite").parquet(f"{root}/station")
    observed_table(root).load(readers.read_observed(spark, observations), replace=True)
    simulation_table(root).load(readers.load_simulation(qout, station), replace=True)
    for initialized, run in (forecasts or {}).items():
        forecast_load(run, station, initialized, root)


def forecast_load(qout: DataFrame, station: DataFrame, initialized: str, root: str) -> None:
    """Model output of one run into the stored ensemble, and its first values into the records.

    The run's reaches replace what was stored of them, so loading a run twice changes nothing.
    Readers see each of the two tables as it was before the load or after it.
    """
    begun = mark()
    moments = materialise(ensemble.packed(readers.load_forecast(qout, station, initialized)), "forecast", DENSE)
    writers.upsert_runs(records_table(root), ensemble.packed_records(moments), "datetime")
    writers.upsert_members(ensemble_table(root), moments)
    release(qout.sparkSession, begun)


def daily_update(
    spark: SparkSession, qout: DataFrame, initialized: str, root: str, state: Refresh, warnings: str
) -> None:
    """The daily job: load the new run, then score it for every station."""
    station = spark.read.schema(STATION).parquet(f"{root}/station")
    forecast_load(qout, station, initialized, root)
    daily_warnings(readers.open_tables(spark, root, initialized), state, initialized, warnings)


def observation_refresh(spark: SparkSession, products: str, station: DataFrame, out: str) -> DataFrame:
    """Altimetry products below a folder into one compiled observation file set."""
    compiled = readers.compile_observed(readers.read_altimetry(spark, products), station)
    compiled.write.mode("overwrite").option("header", True).option(
        "timestampNTZFormat", "yyyy-MM-dd HH:mm:ss"
    ).csv(out)
    return compiled


def daily_warnings(tables: Tables, state: Refresh, date: str, out: str) -> None:
    """Score one forecast date for every station; a second run of a date replaces the first."""
    writers.write_warnings(alerts.warnings_wide(tables, state.model, date, state.thresholds), out)


def map_alerts(spark: SparkSession, station: DataFrame, warnings: str, date: str) -> DataFrame:
    """Stations with their stored warnings of one date; nothing is scored again."""
    return alerts.water_level_alerts(station, readers.read_warnings(spark, warnings, date), date)


@dataclass(frozen=True)
class Charts:
    """The tables behind the charts of all stations."""

    historical: DataFrame
    daily: DataFrame
    monthly: DataFrame
    forecast: DataFrame
    climatology: DataFrame
    skill: DataFrame


def forecast_parts(tables: Tables, state: Refresh) -> dict[str, DataFrame]:
    """Statistics, recent records, bands and extents of all runs of complete stations.

    The statistics are stored once: four of the results read them.
    """
    # Stations without thresholds go before their members are corrected.
    complete = state.thresholds.select("hydroweb")
    model = bias.Model(state.model.mapping.join(complete, "hydroweb", "left_semi"))
    stats = materialise(ensemble.forecast_stats(tables, model), "ensemble-stats")
    span = series.stats_span(stats)
    records = bias.corrected_records(tables.records, state.model)
    recent = series.recent_records(records, span)
    return {
        "stats": stats,
        "recent": recent,
        "bands": extremes.return_period_bands(state.thresholds, stats),
        "extent": series.chart_span(span, recent),
    }


def charts(tables: Tables, state: Refresh) -> Charts:
    observed = clean.observed_levels(tables.observed)
    corrected = bias.corrected_simulation(tables, state.model)
    parts = forecast_parts(tables, state)
    return Charts(
        historical=series.historical_series(corrected, observed),
        daily=climatology.daily_average(observed, corrected),
        monthly=climatology.monthly_average(observed, corrected),
        forecast=series.forecast_series(parts["stats"], parts["recent"], parts["bands"], parts["extent"]),
        climatology=climatology.calendar_values(parts["extent"], climatology.day_extremes(observed)),
        skill=metrics.skill_metrics(metrics.sim_obs_pairs(tables, state.model)),
    )


def station_charts(spark: SparkSession, root: str, state: Refresh, hydroweb: str, initialized: str) -> Charts:
    """The charts of one station and one run, from the stored tables.

    The run decides folders; station and reach decide row groups, as rows lie in their order within
    the files. Records are read from the months around the run.
    """
    tables = readers.station_tables(spark, root, hydroweb, initialized, RECORD_DAYS)
    own = F.col("hydroweb") == hydroweb
    return charts(tables, Refresh(bias.Model(state.model.mapping.where(own)), state.thresholds.where(own)))


def export_simulation(tables: Tables, path: str) -> None:
    """Raw simulation as CSV per reach."""
    writers.write_csv(tables.simulation.select("reachid", "datetime", "value"), path, "reachid")


def export_observed(tables: Tables, path: str) -> None:
    """Raw observations as CSV per station, neither shifted nor floored."""
    writers.write_csv(tables.observed.select("hydroweb", "datetime", "waterlevel"), path, "hydroweb")


def export_corrected_simulation(tables: Tables, path: str, model: bias.Model | None = None) -> None:
    """Corrected simulation as CSV per station, on the original datum of the observations.

    ``model`` is ``bias.fit(tables, shift_min=False)``; exports of one refresh can share it.
    """
    model = bias.fit(tables, shift_min=False) if model is None else model
    corrected = bias.corrected_simulation(tables, model).select("hydroweb", "datetime", "corrected")
    begun = mark()
    # Stored, as the ranges of the files are found in a pass of its own.
    writers.write_csv(materialise(corrected, "corrected"), path, "hydroweb")
    release(corrected.sparkSession, begun)


def export_forecast_stats(tables: Tables, state: Refresh, path: str) -> None:
    """Corrected forecast statistics as CSV per station."""
    writers.write_csv(forecast_parts(tables, state)["stats"], path, "hydroweb")


__all__ = [
    "Charts", "Refresh", "charts", "daily_update", "daily_warnings", "export_corrected_simulation",
    "export_forecast_stats", "export_observed", "export_simulation", "forecast_load", "forecast_parts", "initial_load", "map_alerts",
    "observation_refresh", "open_refresh", "refresh", "save_refresh", "station_charts",
]
