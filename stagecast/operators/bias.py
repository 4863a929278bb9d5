"""Bias correction by monthly quantile mapping, for all stations at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from stagecast.functions.scalar import above_factor, below_factor, clip, present
from stagecast.operators.cdf import edge, from_probability, packed_cdf, to_probability
from stagecast.operators.clean import series, simulated
from stagecast.operators.lookup import lookup_join, row_counts
from stagecast.tables import Tables
from stagecast.workspace import materialise

_SIM = ("n", "low", "high", "step", "first", "cdf")
_OBS = ("step", "last", "first", "cdf")


@dataclass(frozen=True)
class Model:
    """What a data refresh derives from observations and simulation.

    ``mapping``: one row per (hydroweb, reachid, month) with the simulated (``sim_*``) and the
    observed (``obs_*``) distribution; the latter is NULL where the month was never observed.
    ``complete`` says whether the station has observations in every simulated month: without
    them its history cannot be corrected, and the whole station is reported as failed.
    """

    mapping: DataFrame


def station_reach(station: DataFrame) -> DataFrame:
    return station.select("hydroweb", "reachid")


def fit(tables: Tables, shift_min: bool = True) -> Model:
    """Distributions of every station-month, as a stored table.

    Simulation is fitted once per reach, not per station.
    """
    sim = packed_cdf(tables.simulation, "reachid", "value")
    obs = packed_cdf(tables.observed, "hydroweb", "waterlevel", shift_min)
    months = Window.partitionBy("hydroweb")  # at most 12 rows per station
    mapping = (
        station_reach(tables.station)
        .join(sim.select("reachid", "month", *[F.col(c).alias(f"sim_{c}") for c in _SIM]), "reachid")
        .join(
            obs.select("hydroweb", "month", *[F.col(c).alias(f"obs_{c}") for c in _OBS]),
            ["hydroweb", "month"], "left",
        )
        .withColumn("complete", F.count("obs_step").over(months) == F.count("sim_step").over(months))
    )
    return Model(materialise(mapping, "mapping"))


def group_sizes(mapping: DataFrame) -> DataFrame:
    """Simulated rows per (reachid, month), for a join that cuts large groups."""
    return mapping.groupBy("reachid", "month").agg(F.max("sim_n").alias("n"))


def map_historical(df: DataFrame, value: str, out: str) -> DataFrame:
    """Add ``out``: ``value`` moved from the simulated to the observed distribution of its row."""
    df = to_probability(df, value, "_p", "sim", right_closed=False)
    return from_probability(df, "_p", out, "obs", first_edge=False).drop("_p")


def map_forecast(df: DataFrame, value: str, out: str) -> DataFrame:
    """As :func:`map_historical` with the forecast interpolation.

    Where that is undefined the value is left as it was.
    """
    df = to_probability(df, value, "_p", "sim", right_closed=True)
    df = from_probability(df, "_p", "_mapped", "obs", first_edge=True)
    return df.withColumn(out, F.coalesce("_mapped", value)).drop("_p", "_mapped")


def corrected_simulation(tables: Tables, model: Model) -> DataFrame:
    """Corrected history of every complete station: (hydroweb, datetime, value, corrected)."""
    rows = simulated(tables.simulation).withColumn("month", F.month("datetime"))
    mapping = model.mapping.where("complete").drop("complete", "sim_n", "sim_low", "sim_high")
    joined = lookup_join(rows, mapping, ["reachid", "month"], group_sizes(model.mapping))
    return map_historical(joined, "value", "corrected").select("hydroweb", "datetime", "value", "corrected")


def clip_factors(df: DataFrame, value: str) -> DataFrame:
    """Add ``clipped``, ``min_factor``, ``max_factor`` against the simulated extremes of the row."""
    v, low, high = F.col(value), F.col("sim_low"), F.col("sim_high")
    return (
        df.withColumn("clipped", clip(v, low, high))
        .withColumn("min_factor", below_factor(v, low))
        .withColumn("max_factor", above_factor(v, high))
    )


def forecast_rows(ensemble: DataFrame) -> DataFrame:
    """Formatted ensemble rows; missing members stay as NULL rows, as they date the forecast."""
    return ensemble.select(
        "reachid", "initialized", "datetime", "member", present(F.col("value")).alias("value")
    )


def forecast_runs(rows: DataFrame) -> DataFrame:
    """One row per forecast run: (reachid, initialized, first_time, last_time, n)."""
    return rows.groupBy("reachid", "initialized").agg(
        F.min("datetime").alias("first_time"), F.max("datetime").alias("last_time"),
        F.count(F.lit(1)).alias("n"),
    )


def run_mapping(runs: DataFrame, model: Model, use_month: int = 0, extra: DataFrame | None = None) -> DataFrame:
    """The distributions a run is corrected with: those of its first (0) or last (-1) month.

    A stored table, one row per (hydroweb, reachid, initialized). ``extra`` holds per-station
    columns to add.
    """
    if use_month not in (0, -1):
        raise ValueError("use_month must be 0 (first month) or -1 (last month)")
    anchor = "first_time" if use_month == 0 else "last_time"
    usable = model.mapping.where(F.col("obs_step").isNotNull())
    mapped = runs.drop("n").withColumn("month", F.month(anchor)).join(usable, ["reachid", "month"])
    return materialise(mapped if extra is None else mapped.join(extra, "hydroweb"), "run-mapping")


def corrected_members(
    rows: DataFrame, runs: DataFrame, mapping: DataFrame, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Corrected ensemble rows: clip, map, multiply by both factors.

    Output: (hydroweb, reachid, initialized, datetime, member, value, clipped, min_factor,
    max_factor, mapped, corrected) and the ``keep`` columns of the mapping.
    """
    return corrected_values(lookup_join(rows, mapping, ["reachid", "initialized"], runs), keep)


def corrected_values(joined: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """As :func:`corrected_members`, of rows that have met their mapping."""
    mapped = map_forecast(clip_factors(joined, "value"), "clipped", "mapped")
    return mapped.withColumn("corrected", F.col("mapped") * F.col("min_factor") * F.col("max_factor")).select(
        "hydroweb", "reachid", "initialized", "datetime", "member", "value", "clipped",
        "min_factor", "max_factor", "mapped", "corrected", *keep,
    )


def with_order(mapping: DataFrame) -> DataFrame:
    """Add ``ordered`` to a run mapping: whether its correction never swaps two values of a station's run.

    Between the simulated extremes the mapping rises; beyond them a value is scaled, which rises where
    the mapped extreme isn't negative. Left is the lowest value where the mapping is undefined: it stays as
    it is, and may come to lie above mapped ones. A station with several reaches has no order either.
    """
    ends = map_forecast(map_forecast(mapping, "sim_low", "_low"), "sim_high", "_high")
    ends = to_probability(ends, "sim_low", "_p", "sim", right_closed=True)
    undefined = (F.col("_p") <= 0) & (F.col("obs_first") > 1)
    rises = (F.col("_low") >= 0) & (F.col("_high") >= 0) & (~undefined | (F.col("_low") <= edge(F.col("obs_step"), F.col("obs_first"))))
    run = Window.partitionBy("hydroweb", "initialized")  # as many rows as the station has reaches
    return (
        ends.withColumn("_rises", F.coalesce(rises, F.lit(False)))
        .withColumn("ordered", F.min("_rises").over(run) & (F.min("reachid").over(run) == F.max("reachid").over(run)))
        .drop("_low", "_high", "_p", "_rises")
    )


def corrected_forecast(
    tables: Tables, model: Model, use_month: int = 0
) -> DataFrame:
    """Corrected ensemble of every station whose forecast month has been observed."""
    rows = forecast_rows(tables.ensemble)
    runs = forecast_runs(rows)
    return corrected_members(rows, runs, run_mapping(runs, model, use_month))


def mapped_forecast(tables: Tables, model: Model, use_month: int = 0) -> DataFrame:
    """Quantile mapping of the ensemble on its own, without clipping or factors.

    Values outside the simulated range get the nearest end of the distribution's share.
    """
    rows = forecast_rows(tables.ensemble)
    runs = forecast_runs(rows)
    mapping = run_mapping(runs, model, use_month)
    joined = lookup_join(rows, mapping, ["reachid", "initialized"], runs)
    return map_forecast(joined, "value", "mapped").select(
        "hydroweb", "reachid", "initialized", "datetime", "member", "value", "mapped"
    )


def corrected_records(
    records: DataFrame, model: Model, compat: bool = False
) -> DataFrame:
    """Past records corrected month by month: (hydroweb, datetime, value, corrected).

    Records of a month without simulation or observation are dropped. ``compat=True`` also
    drops months outside first..last month *number* of the reach's records, so that a series
    running from December into January has no rows at all.
    """
    rows = series(records, "reachid", "value").withColumn("month", F.month("datetime"))
    sizes = row_counts(rows, ["reachid", "month"])
    mapping = model.mapping.where(F.col("obs_step").isNotNull())
    if compat:
        span = rows.groupBy("reachid").agg(
            F.month(F.min("datetime")).alias("_from"), F.month(F.max("datetime")).alias("_to")
        )
        mapping = (
            mapping.join(span, "reachid").where(F.col("month").between(F.col("_from"), F.col("_to")))
            .drop("_from", "_to")
        )
    joined = lookup_join(rows, mapping, ["reachid", "month"], sizes)
    mapped = map_forecast(clip_factors(joined, "value"), "clipped", "mapped")
    return mapped.select(
        "hydroweb", "datetime", "value",
        (F.col("mapped") * F.col("min_factor") * F.col("max_factor")).alias("corrected"),
    )
