import datetime as dt
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from stagecast.operators import alerts, bias, ensemble
from stagecast.plans import jobs
from stagecast.schemas import ENSEMBLE, OBSERVED
from stagecast.sinks import writers
from stagecast.sources import readers
from stagecast.tables import ensemble_table, observed_table
from tests.small import INIT, make_tables
from tests.test_ensemble import flat_tables, members
from verification import queries

NTZ = dt.datetime


@pytest.fixture()
def tables(spark):
    return flat_tables(spark, members(52, days=3), stations=(("A", 10), ("B", 10), ("C", 12)))


def test_station_list(spark, tables, tmp_path):
    path = str(tmp_path / "s")
    writers.write_stations(tables.station, path)
    got = readers.station_dimension(readers.read_stations(spark, path))
    assert got.drop("display_name").exceptAll(tables.station).count() == 0
    assert {r.display_name for r in got.collect()} == {"NAME A", "NAME B", "NAME C"}


def test_compiled_observations_drop_the_reach(spark, tmp_path):
    (tmp_path / "o.csv").write_text("datetime,waterlevel,hydroweb,reachid\n2001-02-03 04:05:06,7.25,A,10\n2001-02-04 00:00:00,,A,10\n")
    got = readers.read_observed(spark, str(tmp_path / "o.csv")).collect()
    assert [tuple(r) for r in got] == [(NTZ(2001, 2, 3, 4, 5, 6), "A", 7.25), (NTZ(2001, 2, 4), "A", None)]


def test_decades(spark):
    days = [NTZ(1999, 12, 31), NTZ(2000, 1, 1), NTZ(2009, 12, 31, 23, 59), NTZ(2010, 1, 1), NTZ(2035, 6, 1), None]
    df = spark.createDataFrame([(d,) for d in days], "datetime timestamp_ntz")
    assert [r.decade for r in readers.route_decades(df).orderBy("datetime").collect()] == [None, 1990, 2000, 2000, 2010, 2030]


def test_no_year_is_left_out_of_the_stored_tables(spark, tmp_path):
    days = [NTZ(1895, 3, 1), NTZ(1999, 12, 31), NTZ(2035, 6, 1), None]
    rows = spark.createDataFrame([(d, "A", 1.0) for d in days], OBSERVED)
    table = observed_table(str(tmp_path))
    table.load(rows, replace=True)
    table.load(rows, replace=True)
    assert sorted((str(r.datetime), r.decade) for r in table.read(spark).collect()) == [
        ("1895-03-01 00:00:00", "1890"), ("1999-12-31 00:00:00", "1990"), ("2035-06-01 00:00:00", "2030"), ("None", None)
    ]


def test_altimetry_products(spark, tmp_path):
    def product(folder, name, header, lines):
        os.makedirs(tmp_path / folder, exist_ok=True)
        (tmp_path / folder / name).write_text("".join(f"# header {i}\n" for i in range(header)) + "".join(line + "\n" for line in lines))

    product("x/y", "hydroprd_R_NAME-A_exp.txt", 45, ["2010-01-02 10:30 5.25 0.1 9 9", "2010-01-12 10:30 6.5 0.1 9 9"])
    product("z", "hydroprd_R_NAME-B_exp.txt", 3, ["2011-05-06 00:10 7.75 0.2"])          # short header: no row is lost
    product("z", "hydroprd_R_A+B #1_exp.txt", 40, ["2011-05-06 00:10 1.0 0.2"])           # no station of that name
    product("z", "hydroprd_R_NAME-B_ope.txt", 40, ["2012-05-06 00:10 2.0 0.2"])           # other product
    product("z", "other_R_NAME-A_exp.txt", 40, ["2012-05-06 00:10 3.0 0.2"])              # not a product
    got = readers.read_altimetry(spark, str(tmp_path))
    assert {r.product for r in got.collect()} == {"R_NAME-A_exp", "R_NAME-B_exp", "R_A+B #1_exp", "R_NAME-B_ope"}
    station = spark.createDataFrame([("hA", 10, "name-A"), ("hB", 11, "Name-b"), ("hC", 12, "name-C")], "hydroweb string, reachid int, name string")
    compiled = readers.compile_observed(got, station)
    assert {tuple(r) for r in compiled.collect()} == {
        (NTZ(2010, 1, 2), 5.25, "hA", 10), (NTZ(2010, 1, 12), 6.5, "hA", 10), (NTZ(2011, 5, 6), 7.75, "hB", 11)
    }
    out = str(tmp_path / "compiled")
    jobs.observation_refresh(spark, str(tmp_path), station, out)
    assert readers.read_observed(spark, out).count() == 3


def test_model_output(spark, tables):
    blocks = spark.createDataFrame(
        [(10, [NTZ(1999, 12, 31), NTZ(2000, 1, 1), NTZ(2000, 1, 2, 0, 0, 0, 500000)], [1.0, 2.0, float("nan")]), (99, [NTZ(2001, 1, 1)], [4.0])],
        "rivid int, time array<timestamp_ntz>, Qout array<double>",
    )
    got = readers.load_simulation(readers.unpack_blocks(blocks), tables.station).orderBy("datetime").collect()
    assert [tuple(r) for r in got] == [(NTZ(2000, 1, 1), 10, 2.0), (NTZ(2000, 1, 2), 10, None)]
    qout = spark.createDataFrame([(INIT.to_pydatetime(), r, 3, 1.5) for r in (10, 99)], "time timestamp_ntz, rivid int, ensemble int, Qout double")
    rows = readers.load_forecast(qout, tables.station, str(INIT)).collect()
    assert [tuple(r) for r in rows] == [(INIT.to_pydatetime(), 10, INIT.to_pydatetime(), 3, 1.5)]


def test_reaches_and_scans(spark, tables):
    model = spark.createDataFrame([(10,), (10,), (77,)], "reachid int")
    assert [r.reachid for r in readers.reach_intersection(model, tables.station).collect()] == [10]
    both = readers.series_scan(tables.simulation, tables.station)
    one = readers.series_scan(tables.simulation, tables.station, ["B"])
    assert both.count() == 3 * one.count() and {r.hydroweb for r in one.select("hydroweb").distinct().collect()} == {"B"}
    assert readers.series_scan(tables.simulation, tables.station, []).count() == 0


def test_scan_for_a_long_list_of_stations(spark, tables, tmp_path):
    """100,000 codes stay a table: they are joined, never listed in the plan."""
    codes = spark.range(100_000).selectExpr("CASE WHEN id = 7 THEN 'C' ELSE concat('X', id) END AS hydroweb")
    got = readers.series_scan(tables.simulation, tables.station, codes)
    assert {r.hydroweb for r in got.select("hydroweb").distinct().collect()} == {"C"}
    plan = got._jdf.queryExecution().toString()
    assert " IN (" not in plan and "INSET" not in plan


def test_stored_layout(spark, tables, tmp_path):
    root = str(tmp_path / "store")
    writers.write_tables(tables, root)
    again = readers.open_tables(spark, root)
    for name, table in vars(tables).items():
        got = getattr(again, name)
        assert got.columns == table.columns
        assert got.exceptAll(table).count() == 0 and got.count() == table.count(), name
    assert os.path.isdir(f"{root}/ensemble_forecast/data/init_month=2002-01/run=20020128000000")
    assert os.path.isdir(f"{root}/historical_simulation/data/decade=2000")
    writers.write_tables(tables, root)  # again: nothing is doubled
    assert readers.open_tables(spark, root).ensemble.count() == tables.ensemble.count()
    assert readers.open_tables(spark, root).simulation.count() == tables.simulation.count()


def test_scan_of_one_run_reads_its_folder_only(spark, tables, tmp_path):
    root = str(tmp_path / "store")
    runs = [str(INIT - dt.timedelta(days=d)) for d in range(3)]
    for d, started in enumerate(runs):
        qout = tables.ensemble.select(
            (F.col("datetime") - F.expr(f"INTERVAL {d} DAYS")).alias("time"), F.col("reachid").alias("rivid"),
            F.col("member").alias("ensemble"), (F.col("value") + d).alias("Qout"),
        )
        jobs.forecast_load(qout, tables.station, started, root)
    scan = readers.ensemble_scan(spark, root, runs[1], [10])
    want = tables.ensemble.where("reachid = 10").count()
    assert scan.count() == want and scan.columns == ["reachid", "datetime", "member", "value"]
    plan = scan._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters"):]
    assert "run" in filters.split("]")[0] and "(reachid" in plan[plan.index("DataFilters"):].split("]")[0]
    files = {r.f for r in scan.select(F.input_file_name().alias("f")).distinct().collect()}
    assert files and all("run=20020127000000" in f for f in files)
    assert readers.ensemble_scan(spark, root, "1990-01-01 00:00:00").count() == 0


def test_loading_a_run_again_changes_nothing(spark, tables, tmp_path):
    root, state = str(tmp_path / "store"), jobs.refresh(tables)
    writers.write_tables(tables, root)
    qout = tables.ensemble.select(F.col("datetime").alias("time"), F.col("reachid").alias("rivid"), F.col("member").alias("ensemble"), F.col("value").alias("Qout"))

    def results():
        stored = readers.open_tables(spark, root, str(INIT))
        stats = ensemble.ensemble_stats(bias.corrected_forecast(stored, state.model))
        return sorted(map(str, stats.collect())), sorted(map(str, stored.records.collect())), stored.ensemble.count()

    jobs.daily_update(spark, qout, str(INIT), root, state, str(tmp_path / "w"))
    first = results()
    jobs.daily_update(spark, qout, str(INIT), root, state, str(tmp_path / "w"))
    assert results() == first and first[2] == tables.ensemble.count() and len(first[0])
    layer = jobs.map_alerts(spark, tables.station, str(tmp_path / "w"), str(INIT))
    assert layer.count() == 3
    plan = layer._jdf.queryExecution().executedPlan().toString()
    assert "date" in plan[plan.index("PartitionFilters"):].split("]")[0]


def test_keyed_scan_is_pushed_to_the_files(spark, tables, tmp_path):
    root = str(tmp_path / "store")
    writers.write_tables(tables, root)
    scan = readers.open_tables(spark, root).simulation.where("reachid = 10").select("datetime")
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(reachid,10)" in plan and "ReadSchema: struct<datetime:timestamp_ntz,reachid:int>" in plan


def test_warnings_can_be_run_again(spark, tables, tmp_path):
    out, state = str(tmp_path / "w"), jobs.refresh(tables)
    for date in (str(INIT), str(INIT), "2002-01-29 00:00:00"):
        jobs.daily_warnings(tables, state, date, out)
    got = spark.read.parquet(out)
    assert got.groupBy("datetime").count().orderBy("datetime").collect() == [
        (INIT.to_pydatetime(), 3), (NTZ(2002, 1, 29), 3)
    ]


def test_refresh_is_kept(spark, tables, tmp_path):
    state = jobs.refresh(tables)
    jobs.save_refresh(state, str(tmp_path / "r"))
    again = jobs.open_refresh(spark, str(tmp_path / "r"))
    rows = [alerts.warnings_wide(tables, s.model, INIT, s.thresholds).orderBy("hydroweb").collect() for s in (state, again)]
    assert rows[0] == rows[1]


def test_initial_load(spark, tables, tmp_path):
    stations, compiled, root = (str(tmp_path / n) for n in ("s", "o", "root"))
    writers.write_stations(tables.station, stations)
    tables.observed.withColumn("reachid", F.lit(1)).select("datetime", "waterlevel", "hydroweb", "reachid").write.option("header", True).option(
        "timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(compiled)
    qout = tables.simulation.select(F.col("datetime").alias("time"), F.col("reachid").alias("rivid"), F.col("value").alias("Qout"))
    run = tables.ensemble.select(F.col("datetime").alias("time"), F.col("reachid").alias("rivid"), F.col("member").alias("ensemble"), F.col("value").alias("Qout"))
    for _ in range(2):
        jobs.initial_load(spark, stations, compiled, qout, root, {str(INIT): run})
        got = readers.open_tables(spark, root)
        for name in ("station", "observed", "simulation", "ensemble"):
            assert getattr(got, name).exceptAll(getattr(tables, name)).count() == 0, name
            assert getattr(got, name).count() == getattr(tables, name).count(), name
        assert got.records.count() == 1  # member 1 of the only reach


def test_exports_read_back(spark, tables, tmp_path):
    jobs.export_observed(tables, str(tmp_path / "o"))
    got = spark.read.schema("datetime timestamp_ntz, waterlevel double, hydroweb string").option("header", True).csv(str(tmp_path / "o"))
    assert got.select("datetime", "hydroweb", "waterlevel").exceptAll(tables.observed).count() == 0
    assert os.path.isdir(tmp_path / "o" / "hydroweb=A")


def test_charts_have_rows(spark):
    days = [dt.datetime(y, 1, d) for y in (2000, 2001) for d in range(1, 29)]
    tables = make_tables(
        spark, [("A", 10)], [(t, "A", float(t.day)) for t in days], [(t, 10, float(t.day + t.year - 2000)) for t in days],
        members(30, days=2), [((INIT - dt.timedelta(days=3)).to_pydatetime(), 10, 4.0)],
    )
    charts = jobs.charts(tables, jobs.refresh(tables))
    counts = {name: table.count() for name, table in vars(charts).items()}
    assert counts["historical"] == 112 and counts["skill"] == 9 and counts["monthly"] == 1
    assert {r.series for r in charts.forecast.select("series").distinct().collect()} >= {"flow_max", "high_res", "records", "return_period_100"}


def test_charts_of_one_station_are_those_of_all(spark, tmp_path):
    days = [dt.datetime(y, 1, d) for y in (2000, 2001) for d in range(1, 29)]
    stations = [("A", 10), ("B", 12)]
    both = [(INIT + pd.Timedelta(days=d, hours=6 * k), r, INIT, m, float(m + d + k + r)) for d in range(2) for k in range(3) for r in (10, 12) for m in range(1, 53)]
    tables = make_tables(
        spark, stations, [(t, s, float(t.day)) for t in days for s, _ in stations], [(t, r, float(t.day + t.year - 2000 + r)) for t in days for _, r in stations],
        both, [((INIT - dt.timedelta(days=3)).to_pydatetime(), r, 4.0) for r in (10, 12)],
    )
    root = str(tmp_path / "store")
    writers.write_tables(tables, root)
    state = jobs.refresh(tables)
    one, every = jobs.station_charts(spark, root, state, "B", str(INIT)), jobs.charts(tables, state)

    def rows(df):  # sums may differ in the last bits
        return sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in df.collect())

    for name, table in vars(one).items():
        assert rows(table) == rows(getattr(every, name).where("hydroweb = 'B'")) != [], name
    scan = readers.station_tables(spark, root, "B", str(INIT), 8)
    plan = scan.ensemble._jdf.queryExecution().executedPlan().toString()
    assert "run" in plan[plan.index("PartitionFilters"):].split("]")[0] and "(reachid" in plan[plan.index("DataFilters"):].split("]")[0]
    plan = scan.observed._jdf.queryExecution().executedPlan().toString()
    assert "(hydroweb" in plan[plan.index("DataFilters"):].split("]")[0]
    assert readers.station_tables(spark, root, "nowhere", str(INIT), 8).simulation.count() == 0


def test_texts_are_written_where_they_are_made(spark, tmp_path):
    lines = spark.createDataFrame([("hydroprd_R_A_exp.txt", "# head"), ("hydroprd_R_A_exp.txt", "2001-01-01 10:30 5.5 0.05"), ("hydroprd_R_B_exp.txt", "# head")], "product string, value string")
    sorted_lines = lines.coalesce(1).sortWithinPartitions("product", "value")
    assert sorted_lines.mapInArrow(queries._text_writer(str(tmp_path)), "files long").first()[0] == 2
    assert (tmp_path / "0" / "hydroprd_R_A_exp.txt").read_text() == "# head\n2001-01-01 10:30 5.5 0.05\n"
    assert [tuple(r)[::2] for r in readers.read_altimetry(spark, str(tmp_path)).collect()] == [("R_A_exp", 5.5)]


def test_partitions_known_beforehand_are_loaded(spark, tmp_path):
    table = ensemble_table(str(tmp_path))
    row = lambda start, value: spark.createDataFrame([(dt.datetime(2002, 1, 1), 4, start, 1, value)], ENSEMBLE)
    start = dt.datetime(2002, 1, 1)
    parts = {("2002-01", "20020101000000"): [row(start, 1.0), row(start, 2.0)], (None, None): [row(None, 3.0)]}
    for batch in (0, 0, 1):
        table.load_partitions(list(parts), parts.get, True, "s", batch)
    assert sorted((r.value, r.initialized == start) for r in table.rows(spark).collect()) == [(1.0, True), (2.0, True), (3.0, False)]


def test_missing_keys_of_an_export_share_a_folder(spark, tmp_path):
    rows = [(dt.datetime(2002, 1, 1), k, v) for k, v in (("A", 1.0), (None, 2.0), ("", 3.0))]
    writers.write_csv(spark.createDataFrame(rows, OBSERVED).select("hydroweb", "datetime", "waterlevel"), str(tmp_path / "out"), "hydroweb")
    got = spark.read.schema("datetime timestamp_ntz, waterlevel double, hydroweb string").option("header", True).csv(str(tmp_path / "out"))
    assert sorted((r.waterlevel, r.hydroweb) for r in got.collect()) == [(1.0, "A"), (2.0, None), (3.0, None)]
