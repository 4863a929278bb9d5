"""One query per operator, each over the whole derived tables of a test data folder."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import cached_property

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pa_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from stagecast.fixtures import INITIALIZED, Fixtures, StoredFixtures
from stagecast.functions.scalar import gumbel
from stagecast.operators import alerts, bias, cdf, clean, climatology, ensemble, extremes, metrics, series
from stagecast.plans import jobs
from stagecast.schemas import RETURN_PERIODS
from stagecast.sinks import writers
from stagecast.sources import readers
from stagecast.streaming import ingest
from stagecast.tables import Tables, daily_table, ensemble_table, observed_table, readings_table, records_table, simulation_table
from stagecast.workspace import DENSE, empty, fresh_dir

_contexts: dict[tuple[str, str], "_Context"] = {}


def context(spark: SparkSession, folder: str) -> "_Context":
    """Base tables and refresh of a folder, derived and stored once per application."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _contexts:
        _contexts[key] = _Context(spark, folder)
    return _contexts[key]


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six digits, by arithmetic that every engine does alike.

    The built-in roundings of two engines differ in the last bit. Cells are moved by 0.03 of
    their width because results are often short decimal fractions, which would lie on the border
    between two cells.
    """
    return df.select(*[
        (F.floor(F.col(c) * F.lit(1e6) + F.lit(0.53)).cast("double") / F.lit(1e6)).alias(c) if t == "double" else F.col(c)
        for c, t in df.dtypes
    ])


class _Context:
    """What a platform keeps between queries: stored base tables and the last refresh."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.fx = spark, StoredFixtures(spark, folder)

    @cached_property
    def tables(self) -> Tables:
        return self.fx.tables()

    @cached_property
    def past(self) -> Tables:
        """The base tables for queries that read no forecast: the ensemble is not stored for them."""
        return Tables(self.fx.station(), self.fx.observed(), self.fx.simulation(), Fixtures.ensemble(self.fx), self.fx.records())

    @cached_property
    def _state(self) -> jobs.Refresh:
        return jobs.refresh(self.tables)

    def model(self) -> bias.Model:
        return self._state.model

    def state(self) -> jobs.Refresh:
        return self._state

    def warnings(self) -> DataFrame:
        return alerts.warnings_wide(self.tables, self.model(), INITIALIZED, self.state().thresholds)

    @cached_property
    def stored_warnings(self) -> str:
        """Folder of the warnings that the daily job has left."""
        path = self.dir("daily-warnings")
        jobs.daily_warnings(self.tables, self.state(), INITIALIZED, path)
        return path

    @cached_property
    def store(self) -> str:
        """Folder of forecast tables with three runs, the middle one loaded twice."""
        root, station, runs = self.dir("store"), self.fx.station(), self.fx.runs()
        for started, qout in [*runs, runs[1]]:
            jobs.forecast_load(qout, station, started, root)
        return root

    @cached_property
    def whole_store(self) -> str:
        """As ``store``, with the station list, observations and simulation."""
        root, tables = self.store, self.past
        tables.station.write.parquet(f"{root}/station")
        observed_table(root).load(tables.observed, replace=True)
        simulation_table(root).load(tables.simulation, replace=True)
        return root

    def station_alerts(self) -> DataFrame:
        return jobs.map_alerts(self.spark, self.tables.station, self.stored_warnings, INITIALIZED)

    def pairs(self) -> DataFrame:
        return metrics.sim_obs_pairs(self.tables, self.model())

    def dir(self, label: str) -> str:
        return fresh_dir(self.spark, label)


# --- sources and sinks ------------------------------------------------------------------------

def station_dim(c: _Context) -> DataFrame:
    path = c.dir("stations-tsv")
    writers.write_stations(c.tables.station, path)
    return readers.station_dimension(readers.read_stations(c.spark, path))


def observed_load(c: _Context) -> DataFrame:
    path = c.dir("compiled-csv")
    compiled = c.tables.observed.join(bias.station_reach(c.tables.station), "hydroweb")
    compiled.select("datetime", "waterlevel", "hydroweb", "reachid").write.option("header", True).option(
        "timestampNTZFormat", "yyyy-MM-dd HH:mm:ss"
    ).csv(path)
    return readers.read_observed(c.spark, path)


def partition_route(c: _Context) -> DataFrame:
    path = c.dir("routed")
    table = observed_table(path)
    for _ in range(2):  # loading again replaces
        table.load(c.tables.observed, replace=True)
    return table.read(c.spark).select(F.col("decade").cast("int").alias("decade"), "hydroweb", "datetime", "waterlevel")


def simulation_load(c: _Context) -> DataFrame:
    qout = c.tables.simulation.select(
        F.col("datetime").alias("time"), F.col("reachid").alias("rivid"), F.col("value").alias("Qout")
    )
    return readers.load_simulation(qout, c.tables.station)


def forecast_load(c: _Context) -> DataFrame:
    """What three loaded runs give, one of them loaded twice: complete moments of every run."""
    rows = ensemble_table(c.store).rows(c.spark)
    totals = rows.groupBy("reachid", "initialized", "datetime").agg(
        F.count(F.lit(1)).alias("n_rows"), F.max("value").alias("largest")
    )
    return totals.join(ensemble.complete_rows(rows), ["reachid", "initialized", "datetime"], "left")


def stored_records(c: _Context) -> DataFrame:
    """The records that the loaded runs leave."""
    return records_table(c.store).rows(c.spark)


def ensemble_scan(c: _Context) -> DataFrame:
    return readers.ensemble_scan(c.spark, c.store, INITIALIZED)


def ensemble_wide(c: _Context) -> DataFrame:
    return ensemble.ensemble_wide(c.tables.ensemble)


def forecast_records(c: _Context) -> DataFrame:
    return ensemble.forecast_records(c.tables.ensemble)


def _altimetry_folder(c: _Context) -> str:
    """Product texts ``hydroprd_*.txt``: a header of 40 lines, then 'date time level uncertainty'."""
    texts = c.dir("altimetry-texts")
    named = c.tables.station.select(
        "hydroweb", F.concat(F.lit("hydroprd_R_"), F.upper("name"), F.lit("_exp.txt")).alias("product")
    )
    rows = c.tables.observed.join(named, "hydroweb").select(
        "product", F.concat_ws(" ", F.date_format("datetime", "yyyy-MM-dd"), F.lit("10:30"), "waterlevel", F.lit("0.05")).alias("value")
    )
    header = named.select("product", F.explode(F.sequence(F.lit(1), F.lit(40))).alias("i")).select(
        "product", F.concat(F.lit("# line "), F.col("i").cast("string")).alias("value")
    )
    lines = header.unionByName(rows).where(~F.col("product").rlike(_NO_FILE_NAME)).select("product", "value")
    lines.repartitionByRange("product", "value").sortWithinPartitions("product", "value").mapInArrow(
        _text_writer(re.sub("^file:/+", "/", texts)), "files long"
    ).agg(F.sum("files")).collect()
    return texts


#: What a product that becomes a file of its own may not have in its name.
_NO_FILE_NAME = r"""[\x00-\x1f\x7f"'*/:=?\\{\[\]^]"""


def _text_writer(texts: str):
    """Writes sorted lines (product, value) to a file per product, in a folder per task.

    A task writes its own files and no one has to list, move or rename them; one that runs again
    writes the same files again.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = pa_fs.FileSystem.from_uri(texts)
        place, current, out, n = f"{root}/{TaskContext.get().partitionId()}", None, None, 0
        for batch in batches:
            runs, start = pc.run_end_encode(batch.column("product")), 0
            for product, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist()):
                if product != current:
                    if out is not None:
                        out.close()
                    files.create_dir(place, recursive=True)
                    current, out, n = product, files.open_output_stream(f"{place}/{product}"), n + 1
                out.write(("\n".join(batch.column("value").slice(start, end - start).to_pylist()) + "\n").encode())
                start = end
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["files"])

    return write


def altimetry_text(c: _Context) -> DataFrame:
    return readers.read_altimetry(c.spark, _altimetry_folder(c))


def observed_compile(c: _Context) -> DataFrame:
    return readers.compile_observed(altimetry_text(c), c.tables.station)


def series_scan(c: _Context) -> DataFrame:
    return readers.series_scan(c.tables.simulation, c.tables.station, c.tables.station.select("hydroweb"))


def export_simulation(c: _Context) -> DataFrame:
    path = c.dir("export-simulation")
    jobs.export_simulation(c.past, path)
    return readers.read_export(c.spark, path, "datetime timestamp_ntz, value double, reachid int")


def export_observed(c: _Context) -> DataFrame:
    path = c.dir("export-observed")
    jobs.export_observed(c.past, path)
    return readers.read_export(c.spark, path, "datetime timestamp_ntz, waterlevel double, hydroweb string")


def export_corrected_sim(c: _Context) -> DataFrame:
    path = c.dir("export-corrected")
    jobs.export_corrected_simulation(c.past, path)
    return rounded(readers.read_export(c.spark, path, "datetime timestamp_ntz, corrected double, hydroweb string"))


def export_forecast_stats(c: _Context) -> DataFrame:
    path = c.dir("export-forecast")
    jobs.export_forecast_stats(c.tables, c.state(), path)
    schema = (
        "initialized timestamp_ntz, datetime timestamp_ntz, flow_max double, flow_75 double, flow_avg double, "
        "flow_25 double, flow_min double, high_res double, hydroweb string"
    )
    return rounded(readers.read_export(c.spark, path, schema))


# --- cleaning, distributions, correction ------------------------------------------------------

def clamp_floor(c: _Context) -> DataFrame:
    return clean.simulated(c.tables.simulation)


def datum_shift(c: _Context) -> DataFrame:
    return rounded(clean.observed_levels(c.tables.observed))


def monthly_extremes(c: _Context) -> DataFrame:
    rows = clean.simulated(c.tables.simulation)
    return cdf.month_extremes(rows, "reachid", "value")


def monthly_histogram(c: _Context) -> DataFrame:
    return rounded(
        cdf.month_histogram(c.tables.simulation, "reachid", "value").select("reachid", "month", "bin", "step", "rows")
    )


def monthly_cdf(c: _Context) -> DataFrame:
    shares = cdf.month_cdf(c.tables.observed, "hydroweb", "waterlevel", shift_min=True)
    right = cdf.edge(F.col("step"), F.col("bin") + 1)
    return rounded(shares.select("hydroweb", "month", "bin", right.alias("right_edge"), "cdf"))


def corrected_simulation(c: _Context) -> DataFrame:
    return rounded(bias.corrected_simulation(c.tables, c.model()))


def forecast_clip_factors(c: _Context) -> DataFrame:
    return rounded(bias.corrected_forecast(c.tables, c.model()).select(
        "hydroweb", "initialized", "datetime", "member", "value", "clipped", "min_factor", "max_factor"
    ))


def corrected_forecast_raw(c: _Context) -> DataFrame:
    return rounded(bias.mapped_forecast(c.tables, c.model()).drop("reachid"))


def corrected_forecast_last_month(c: _Context) -> DataFrame:
    return rounded(bias.mapped_forecast(c.tables, c.model(), use_month=-1).drop("reachid"))


def corrected_forecast(c: _Context) -> DataFrame:
    return rounded(bias.corrected_forecast(c.tables, c.model()).select(
        "hydroweb", "initialized", "datetime", "member", "corrected"
    ))


def corrected_records(c: _Context) -> DataFrame:
    return rounded(bias.corrected_records(c.tables.records, c.model()))


def corrected_records_new_year(c: _Context) -> DataFrame:
    return rounded(bias.corrected_records(c.fx.records_over_new_year(), c.model()))


# --- extremes ---------------------------------------------------------------------------------

def annual_maxima(c: _Context) -> DataFrame:
    return rounded(extremes.annual_maxima(c.tables, c.model()))


def gumbel_quantile(c: _Context) -> DataFrame:
    yearly = (
        clean.simulated(c.tables.simulation)
        .groupBy("reachid", F.year("datetime").alias("year")).agg(F.max("value").alias("peak"))
        .groupBy("reachid").agg(F.stddev_pop("peak").alias("spread"), F.avg("peak").alias("mean"))
    )
    years = yearly.withColumn("rp", F.explode(F.array(*[F.lit(y) for y in (1, *RETURN_PERIODS)])))
    return rounded(years.select("reachid", "rp", gumbel(F.col("spread"), F.col("mean"), F.col("rp")).alias("level")))


def return_periods(c: _Context) -> DataFrame:
    return rounded(extremes.return_periods(extremes.annual_maxima(c.tables, c.model())))


def return_period_bands(c: _Context) -> DataFrame:
    return rounded(jobs.forecast_parts(c.tables, c.state())["bands"])


# --- ensemble and alerts ----------------------------------------------------------------------

def ensemble_complete_rows(c: _Context) -> DataFrame:
    return ensemble.complete_rows(c.tables.ensemble)


def ensemble_stats(c: _Context) -> DataFrame:
    return rounded(ensemble.forecast_stats(c.tables, c.model()))


def ensemble_daily_max(c: _Context) -> DataFrame:
    return rounded(ensemble.daily_maximum(bias.corrected_forecast(c.tables, c.model())))


def exceedance_daily(c: _Context) -> DataFrame:
    state = c.state()
    return rounded(ensemble.exceedance_daily(c.tables, state.model, state.thresholds))


def alerts_long(c: _Context) -> DataFrame:
    state = c.state()
    return alerts.station_alerts(c.tables, state.model, state.thresholds)


def warnings_wide(c: _Context) -> DataFrame:
    return c.warnings()


def warning_status(c: _Context) -> DataFrame:
    state = c.state()
    return alerts.warning_status(c.tables, state.model, state.thresholds, INITIALIZED)


def warning_sink(c: _Context) -> DataFrame:
    path, state = c.dir("warnings"), c.state()
    for _ in range(2):  # a second run of the same date must not add rows
        jobs.daily_warnings(c.tables, state, INITIALIZED, path)
    return c.spark.read.parquet(path).drop("date")


def probability_table(c: _Context) -> DataFrame:
    state = c.state()
    return ensemble.probability_table(c.tables, state.model, state.thresholds)


def forecast_date_range(c: _Context) -> DataFrame:
    return ensemble.forecast_dates(bias.forecast_runs(bias.forecast_rows(c.tables.ensemble)))


def water_level_alerts(c: _Context) -> DataFrame:
    return c.station_alerts()


def alerts_geojson(c: _Context) -> DataFrame:
    path = c.dir("geojson")
    writers.write_geojson(alerts.features(c.station_alerts()), path)
    return c.spark.read.text(path).withColumnRenamed("value", "feature")


def alerts_collection(c: _Context) -> DataFrame:
    """The map layer as one FeatureCollection, line by line."""
    path = c.dir("collection")
    writers.write_collection(alerts.collection_lines(alerts.features(c.station_alerts())), path)
    return c.spark.read.text(path).withColumnRenamed("value", "line")


def alerts_for_day(c: _Context) -> DataFrame:
    return alerts.alerts_for_day(c.station_alerts(), 1)


def alerts_by_class(c: _Context) -> DataFrame:
    return alerts.alerts_by_class(alerts.alerts_by_day(c.station_alerts()), "R100")


def alerts_active_classes(c: _Context) -> DataFrame:
    return alerts.alerts_active(alerts.alerts_by_day(c.station_alerts()))


# --- climatology, skill, series ---------------------------------------------------------------

def daily_average(c: _Context) -> DataFrame:
    return rounded(climatology.daily_average(
        clean.observed_levels(c.tables.observed), bias.corrected_simulation(c.tables, c.model())
    ))


def monthly_average(c: _Context) -> DataFrame:
    return rounded(climatology.monthly_average(
        clean.observed_levels(c.tables.observed), bias.corrected_simulation(c.tables, c.model())
    ))


def climatology_band(c: _Context) -> DataFrame:
    extent = jobs.forecast_parts(c.tables, c.state())["extent"]
    return rounded(climatology.calendar_values(extent, climatology.day_extremes(clean.observed_levels(c.tables.observed))))


def sim_obs_pairs(c: _Context) -> DataFrame:
    return rounded(c.pairs())


def skill_metrics(c: _Context) -> DataFrame:
    return rounded(metrics.skill_metrics(c.pairs()))


def metrics_comparison(c: _Context) -> DataFrame:
    return rounded(metrics.metrics_comparison(c.pairs()))


def historical_series(c: _Context) -> DataFrame:
    return series.historical_series(
        bias.corrected_simulation(c.tables, c.model()), clean.observed_levels(c.tables.observed)
    )


def recent_records(c: _Context) -> DataFrame:
    return rounded(jobs.forecast_parts(c.tables, c.state())["recent"])


def forecast_series(c: _Context) -> DataFrame:
    parts = jobs.forecast_parts(c.tables, c.state())
    return rounded(series.forecast_series(parts["stats"], parts["recent"], parts["bands"], parts["extent"]))


def station_charts(c: _Context) -> DataFrame:
    """The series of one station and run, found by their keys in the stored tables."""
    hydroweb = c.tables.station.agg(F.min("hydroweb")).first()[0]
    found = jobs.station_charts(c.spark, c.whole_store, c.state(), hydroweb, INITIALIZED)
    shown = found.forecast.where(F.col("series").like("flow%") | (F.col("series") == "high_res"))
    return found.historical.select("hydroweb", "series", "datetime", "value").unionByName(
        rounded(shown.select("hydroweb", "series", "datetime", "value"))
    )


def reach_intersection(c: _Context) -> DataFrame:
    return readers.reach_intersection(c.tables.simulation, c.tables.station)


# --- streams ----------------------------------------------------------------------------------

def _stream_input(c: _Context, copies: bool) -> tuple[str, DataFrame]:
    """Readings as files; with ``copies`` every tenth reading comes a second time in a later file."""
    path, readings = c.dir("readings"), c.fx.readings()
    readings.write.mode("append").parquet(path)
    if copies:
        readings.where(F.pmod(F.xxhash64("datetime"), F.lit(10)) == 0).write.mode("append").parquet(path)
    return path, readings


def stream_ingest(c: _Context) -> DataFrame:
    path, readings = _stream_input(c, copies=False)
    out, state = c.dir("ingested"), c.dir("ingest-state")
    ingest.drain(ingest.read_stream(c.spark, path, readings.schema), out, state)
    ingest.drain(ingest.read_stream(c.spark, path, readings.schema), out, state)  # nothing new arrives
    return c.spark.read.parquet(out)


def stream_dedup(c: _Context) -> DataFrame:
    path, readings = _stream_input(c, copies=True)
    table, late = readings_table(c.dir("deduplicated")), readings_table(c.dir("late"))
    stream = ingest.read_stream(c.spark, path, readings.schema, files_per_batch=1)  # copies come in later batches
    ingest.ingest_readings(stream, table, c.dir("dedup-state"), late, "1 hour")
    return table.rows(c.spark)


def stream_daily_max(c: _Context) -> DataFrame:
    path, readings = _stream_input(c, copies=True)
    table = daily_table(c.dir("daily-max"))
    ingest.ingest_daily_maximum(ingest.read_stream(c.spark, path, readings.schema, files_per_batch=1), table, c.dir("daily-max-state"))
    return table.rows(c.spark)


def stream_forecast_ingest(c: _Context) -> DataFrame:
    """Three runs that arrive as files, each in several parts, and the first of them once more."""
    path, root, state = c.dir("arrivals"), c.dir("streamed"), c.dir("forecast-state")
    runs = Fixtures(c.spark, c.fx.folder).runs()  # made as they arrive, not stored besides their files
    for started, qout in [*runs, runs[0]]:
        rows = readers.load_forecast(qout, c.fx.station(), started)
        rows.write.mode("append").option("compression", DENSE).parquet(path)
        # All files of an arrival are one micro-batch, so it doesn't matter which of them holds a reach.
        stream = ingest.read_stream(c.spark, path, rows.schema)
        ingest.ingest_forecasts(stream, ensemble_table(root), records_table(root), state)
        empty(c.spark, path)  # the stream goes on from its checkpoint with what arrives next
    return ensemble_table(root).rows(c.spark)


_QUERIES = (
    station_dim, observed_load, partition_route, simulation_load, forecast_load, stored_records, ensemble_scan,
    ensemble_wide, forecast_records,
    altimetry_text, observed_compile, series_scan, export_simulation, export_observed,
    export_corrected_sim, export_forecast_stats, clamp_floor, datum_shift, monthly_extremes,
    monthly_histogram, monthly_cdf, corrected_simulation, forecast_clip_factors, corrected_forecast_raw,
    corrected_forecast_last_month, corrected_forecast, corrected_records, corrected_records_new_year,
    annual_maxima, gumbel_quantile, return_periods, return_period_bands, ensemble_complete_rows,
    ensemble_stats, ensemble_daily_max, exceedance_daily, alerts_long, warnings_wide, warning_status,
    warning_sink, probability_table, forecast_date_range, water_level_alerts, alerts_geojson, alerts_collection,
    alerts_for_day, alerts_by_class, alerts_active_classes, daily_average, monthly_average,
    climatology_band, sim_obs_pairs, skill_metrics, metrics_comparison, historical_series,
    recent_records, forecast_series, station_charts, reach_intersection, stream_ingest, stream_dedup, stream_daily_max,
    stream_forecast_ingest,
)


def registry() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(query):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return query(context(spark, sf_dir.rstrip("/")))

        run.__name__ = query.__name__
        run.__doc__ = query.__doc__
        return run

    return {query.__name__: bind(query) for query in _QUERIES}
