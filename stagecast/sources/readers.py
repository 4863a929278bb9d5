"""Readers and load steps. Schemas are always given, never inferred."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F

from stagecast.functions.scalar import decade, display_name, present, second
from stagecast.operators.lookup import lookup_join, row_counts
from stagecast.schemas import COMPILED, STATION, WARNING
from stagecast.tables import Tables, ensemble_table, observed_table, records_table, simulation_table
from stagecast.workspace import materialise

_NTZ = "yyyy-MM-dd HH:mm:ss"


def read_export(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV export with a folder per key, in as many tasks as its bytes need.

    Spark plans a file as one of several MB at least: a file per key would make a task of every few keys.
    """
    rows = spark.read.schema(schema).option("header", True).csv(path)
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    most = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return rows.coalesce(max(spark.sparkContext.defaultParallelism, -(-size // most)))


def read_stations(spark: SparkSession, path: str) -> DataFrame:
    """Station list: tab-separated with a header."""
    return spark.read.schema(STATION).option("sep", "\t").option("header", True).csv(path)


def station_dimension(station: DataFrame) -> DataFrame:
    """Station list with the name as it is displayed."""
    return station.withColumn("display_name", display_name(F.col("name")))


def read_observed(spark: SparkSession, path: str) -> DataFrame:
    """Compiled observations: comma-separated with a header; the reach id is not kept."""
    return (
        spark.read.schema(COMPILED).option("header", True).option("timestampNTZFormat", _NTZ).csv(path)
        .select(second(F.col("datetime")).alias("datetime"), "hydroweb", "waterlevel")
    )


def route_decades(df: DataFrame) -> DataFrame:
    """Add the ten-year range of each row, whatever its year; rows without a moment have none."""
    return df.withColumn("decade", decade(F.col("datetime")))


def reach_intersection(model: DataFrame, station: DataFrame) -> DataFrame:
    """Reach ids found both in the model data and in the station list."""
    return model.select("reachid").distinct().join(
        station.select("reachid").distinct(), "reachid", "left_semi"
    )


def of_stations(rows: DataFrame, station: DataFrame) -> DataFrame:
    """Rows whose reach belongs to a station."""
    reaches = station.select("reachid").distinct()
    return lookup_join(rows, reaches, ["reachid"], row_counts(rows, ["reachid"]), "left_semi")


def unpack_blocks(blocks: DataFrame) -> DataFrame:
    """Array blocks (rivid, time array, Qout array) as rows (time, rivid, Qout)."""
    return blocks.select("rivid", F.posexplode("time").alias("_at", "time"), "Qout").select(
        "time", "rivid", F.get(F.col("Qout"), F.col("_at")).alias("Qout")
    )


def load_simulation(qout: DataFrame, station: DataFrame, since: str = "2000-01-01") -> DataFrame:
    """Model output (time, rivid, Qout) as simulation rows of the stations' reaches."""
    rows = (
        qout.where(F.col("time") >= F.lit(since).cast("timestamp_ntz"))
        .select(
            second(F.col("time")).alias("datetime"), F.col("rivid").alias("reachid"),
            present(F.col("Qout")).alias("value"),
        )
    )
    return of_stations(rows, station).select("datetime", "reachid", "value")


def load_forecast(qout: DataFrame, station: DataFrame, initialized: str) -> DataFrame:
    """Model output (time, rivid, ensemble, Qout) as ensemble rows of one run."""
    rows = qout.select(
        second(F.col("time")).alias("datetime"), F.col("rivid").alias("reachid"),
        F.lit(initialized).cast("timestamp_ntz").alias("initialized"),
        F.col("ensemble").cast("int").alias("member"), present(F.col("Qout")).alias("value"),
    )
    return of_stations(rows, station).select("datetime", "reachid", "initialized", "member", "value")


def parse_altimetry(lines: DataFrame) -> DataFrame:
    """Lines (value, file) of altimetry products: (product, datetime, waterlevel), dates only.

    Every line that begins with a date is data, whatever the length of the header. Fields are
    separated by one blank: date, time, level. ``product`` is the file name without prefix and
    ending.
    """
    fields = F.split("value", " ")
    return lines.where(F.col("value").rlike(r"^\d{4}-\d{2}-\d{2}")).select(
        F.regexp_extract("file", r"hydroprd_([^/]*)\.txt", 1).alias("product"),
        F.to_date(F.get(fields, F.lit(0)), "yyyy-MM-dd").cast("timestamp_ntz").alias("datetime"),
        F.get(fields, F.lit(2)).try_cast("double").alias("waterlevel"),
    )


def read_altimetry(spark: SparkSession, path: str) -> DataFrame:
    """All product texts ``hydroprd*.txt`` below ``path``, read in parallel."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "hydroprd*.txt").text(path)
    # File paths in the metadata are URL-encoded; a plus sign in a name is literal there.
    name = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return parse_altimetry(lines.select("value", name.alias("file")))


def compile_observed(products: DataFrame, station: DataFrame) -> DataFrame:
    """Products of known stations as observations; stations without a product are left out.

    A station ``name`` owns the product ``R_<NAME>_exp``.
    """
    owners = station.select(
        F.concat(F.lit("R_"), F.upper("name"), F.lit("_exp")).alias("product"), "hydroweb", "reachid"
    )
    joined = lookup_join(products, owners, ["product"], row_counts(products, ["product"]))
    return joined.select("datetime", "waterlevel", "hydroweb", "reachid")


def series_scan(
    simulation: DataFrame, station: DataFrame, hydroweb: Iterable[str] | DataFrame | None = None
) -> DataFrame:
    """Simulation of stations by way of their reach: (hydroweb, reachid, datetime, value).

    Without ``hydroweb`` all stations are read, else those of a list or of a table with that column.
    Only the least and the largest wanted reach come to the driver: they let the scan skip row
    groups. The join does the rest: a table that fits is broadcast, so other rows are dropped where
    they are read; beyond that Spark sends the scan a Bloom filter of the table at run time.
    """
    wanted = station.select("hydroweb", "reachid")
    if hydroweb is None:
        joined = lookup_join(simulation, wanted, ["reachid"], row_counts(simulation, ["reachid"]))
        return joined.select("hydroweb", "reachid", "datetime", "value")
    if not isinstance(hydroweb, DataFrame):
        hydroweb = station.sparkSession.createDataFrame([(code,) for code in hydroweb], "hydroweb string")
    codes = hydroweb.select("hydroweb").distinct()
    wanted = materialise(wanted.join(codes, "hydroweb", "left_semi"), "wanted-stations")
    ends = wanted.agg(F.min("reachid").alias("first"), F.max("reachid").alias("last")).first()
    simulation = simulation.where(F.col("reachid").between(F.lit(ends["first"]), F.lit(ends["last"])))
    joined = lookup_join(simulation, wanted, ["reachid"], row_counts(simulation, ["reachid"]))
    return joined.select("hydroweb", "reachid", "datetime", "value")


def ensemble_scan(spark: SparkSession, root: str, initialized: str, reaches: Iterable[int] | None = None) -> DataFrame:
    """One stored run, without its keys if one reach is asked for: (reachid, datetime, member, value).

    The run's moment decides folders, the reaches decide row groups: rows lie in the order of
    reach and moment within the files.
    """
    moment = F.lit(str(initialized)).cast("timestamp_ntz")
    run = F.date_format(moment, "yyyyMMddHHmmss")
    month = F.date_format(moment, "yyyy-MM")
    rows = ensemble_table(root).read(spark, (F.col("init_month") == month) & (F.col("run") == run))
    rows = rows.where(F.col("initialized") == moment)
    if reaches is not None:
        rows = rows.where(F.col("reachid").isin(*reaches))
    return rows.select("reachid", "datetime", "member", "value")


def open_tables(spark: SparkSession, root: str, initialized: str | None = None) -> Tables:
    """Tables written by :func:`stagecast.sinks.writers.write_tables` and by the load jobs.

    With ``initialized`` the ensemble is that run's only, read from its folder.
    """
    run = None
    if initialized is not None:
        run = F.col("run") == F.date_format(F.lit(str(initialized)).cast("timestamp_ntz"), "yyyyMMddHHmmss")
    return Tables(
        station=spark.read.schema(STATION).parquet(f"{root}/station"),
        observed=observed_table(root).rows(spark),
        simulation=simulation_table(root).rows(spark),
        ensemble=ensemble_table(root).rows(spark, run),
        records=records_table(root).rows(spark),
    )


def station_tables(spark: SparkSession, root: str, hydroweb: str, initialized: str, record_days: int) -> Tables:
    """What the stored tables hold of one station and one run: its reach comes to the driver, no more."""
    every = open_tables(spark, root, initialized)
    station = every.station.where(F.col("hydroweb") == hydroweb)
    row = station.select("reachid").first()
    reach = F.col("reachid") == F.lit(row["reachid"] if row else None).cast("int")
    start = F.lit(str(initialized)).cast("timestamp_ntz")
    day = F.expr("INTERVAL 1 DAY")
    run = lambda moment: F.date_format(moment, "yyyyMMddHHmmss")
    # A run may have statistics only later than its start, never earlier than it.
    near = (F.col("run") >= run(start - day * record_days)) & (F.col("run") <= run(start + day * 16))
    return Tables(
        station=station,
        observed=every.observed.where(F.col("hydroweb") == hydroweb),
        simulation=every.simulation.where(reach),
        ensemble=every.ensemble.where(reach),
        records=records_table(root).rows(spark, near).where(reach),
    )


def read_warnings(spark: SparkSession, path: str, date: str | None = None) -> DataFrame:
    """Stored warnings of one moment, or of all; a moment reads the folder of its day only."""
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in WARNING.fields)
    rows = spark.read.schema(f"{columns}, date date").parquet(path)
    if date is not None:
        moment = F.lit(str(date)).cast("timestamp_ntz")
        rows = rows.where((F.col("date") == F.to_date(moment)) & (F.col("datetime") == moment))
    return rows.drop("date")
